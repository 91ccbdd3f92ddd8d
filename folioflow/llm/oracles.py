"""DuckDB SQL for the queries that SQL can express at the size of the correctness tables."""

from __future__ import annotations

from folioflow.llm import lines, pieces, quality

#: Windows of 50 bytes as hexadecimal strings; a byte goes if a repeated window covers it.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
seg AS (SELECT doc_id, s, substr(h, 2 * s + 1, 2098) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT), 1000)) AS s FROM d)),
w AS (SELECT doc_id, s + k AS pos, substr(g, 2 * k + 1, 100) AS w FROM (SELECT doc_id, s, g, unnest(range(least(1000, CAST(len(g) // 2 - 49 AS BIGINT)))) AS k FROM seg WHERE len(g) >= 100)),
r AS (SELECT doc_id, pos FROM w JOIN (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)) f USING (w) WHERE doc_id > first),
s AS (SELECT doc_id, pos, coalesce(pos > 50 + max(pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM r),
g AS (SELECT doc_id, pos, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM s),
span AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM span),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + 50], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS pos FROM d WHERE len(ws) >= 50)),
r AS (SELECT doc_id, pos FROM w JOIN (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)) f USING (w) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, range(50) t(k)),
x AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
k AS (SELECT x.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (WHERE c.pos IS NULL) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = vec_id), 0) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS component_id,
  (SELECT min(b) FROM reach WHERE reach.a = vec_id) = vec_id AS kept FROM v
"""


def _quality() -> str:
    ratio = {r: f"{top} * {factor} // nullif({bottom}, 0)" for r, (top, factor, bottom, *_) in quality.RATIOS.items()}
    buckets = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {x} AS bucket FROM m WHERE {x} IS NOT NULL AND NOT failed" for r, x in ratio.items())
    rule = ", ".join(f"('{r}', {upper}, {'NULL' if lower is None else lower}, {reach})" for r, (_, _, _, upper, lower, reach) in quality.RATIOS.items())
    odd = " OR ".join(f"coalesce({x} > (SELECT high FROM own WHERE own.of_lang IS NOT DISTINCT FROM m.lang AND own.of_source IS NOT DISTINCT FROM m.source AND own.ratio = '{r}') AND {quality.RATIOS[r][0]} > 1, false) OR coalesce({x} < (SELECT low FROM own WHERE own.of_lang IS NOT DISTINCT FROM m.lang AND own.of_source IS NOT DISTINCT FROM m.source AND own.ratio = '{r}'), false)" for r, x in ratio.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + 8], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(len(ws) - 7)) AS pos FROM d WHERE len(ws) >= 8)),
r AS (SELECT doc_id, pos FROM w JOIN (SELECT doc_id, w FROM w GROUP BY ALL HAVING count(*) > 1) USING (doc_id, w)),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, range(8) t(k) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
st AS (SELECT doc_id, sum(CAST(same AS INTEGER)) AS n FROM (SELECT doc_id, coalesce(word = lag(word) OVER (PARTITION BY doc_id ORDER BY pos), false) AS same FROM x) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(st.n, 0) AS BIGINT) AS n_stutters
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN st USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM c),
b AS ({buckets}),
lv AS (SELECT 0 AS level, lang, source, ratio, bucket FROM b UNION ALL SELECT 1, lang, NULL, ratio, bucket FROM b UNION ALL SELECT 2, NULL, NULL, ratio, bucket FROM b),
rk AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS k, count(*) OVER (PARTITION BY level, lang, source, ratio) AS total FROM lv),
q AS (SELECT level, lang, source, ratio, reach, max(total) AS total, min(bucket) FILTER (WHERE k * 100 >= total * 50) AS mid, min(bucket) FILTER (WHERE k * 100 >= total * upper) AS top,
  min(bucket) FILTER (WHERE k * 100 >= total * lower) AS bottom FROM rk JOIN (VALUES {rule}) rule(ratio, upper, lower, reach) USING (ratio) GROUP BY ALL),
fence AS (SELECT level, lang, source, ratio, mid - (mid - bottom) * reach AS low, mid + (top - mid) * reach AS high FROM q
  WHERE level = 2 OR total >= {quality.LEAST_GROUP} AND top > coalesce(bottom, mid)),
own AS (SELECT g.lang AS of_lang, g.source AS of_source, f.ratio, f.low, f.high FROM (SELECT DISTINCT lang, source FROM m) g JOIN fence f ON f.level = 2
  OR f.level = 1 AND f.lang IS NOT DISTINCT FROM g.lang OR f.level = 0 AND f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source
  QUALIFY row_number() OVER (PARTITION BY g.lang, g.source, f.ratio ORDER BY f.level) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT ({odd}) AS kept FROM m
"""


ORACLES = {
    "op1_substring_dedup": SUBSTRINGS,
    "op2_embedding_near_dedup": VECTORS,
    "op7_passage_dedup": PASSAGES,
    "op8_line_dedup": lines.ORACLE,
    "op9_quality_rules": _quality(),
    "sentencepiece_decode": pieces.DECODED,
}
