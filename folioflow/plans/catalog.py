"""Every operator of the engine as a query over the driver tables, with the same in DuckDB SQL.

A row of ``documents`` stands for a source file (text: content, n_chars: size), ``pages`` for bundles
with a title, ``conversations`` for documents of several pages, ``embeddings`` for brightness
profiles, ``events`` for file events, ``labels`` for split markers. State records follow from doc_id.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.operators import backends, bands, cache, gate, state, transcript
from folioflow.options import Options
from folioflow.sources import bundles
from folioflow.streaming import loop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The time of the pass, and where the first file's modification time lies.
NOW, EPOCH = 1_700_021_000, 1_700_000_000
OPTIONS = Options(max_age_hours=5.0, min_reprocess_interval=300.0, require_split=True)

_LISTING = f"""
listing AS (SELECT doc_id, text, n_chars AS size, {EPOCH} + doc_id * 60 AS mtime, sha256(text) AS token, source,
  'notes/' || source || '/doc' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.zip' WHEN 2 THEN '.RMDOC' WHEN 3 THEN '.rm' ELSE '.txt' END AS rel FROM documents)"""
_STATE = f"""
state AS (SELECT rel, CASE WHEN doc_id % 7 = 0 THEN mtime ELSE mtime - 3600 END AS mtime, size,
  CASE WHEN doc_id % 7 = 1 THEN sha256(text || 'x') ELSE token END AS sha256,
  CASE WHEN doc_id % 7 IN (3, 4) THEN 'error' WHEN doc_id % 7 = 5 THEN 'pending_split' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 7 = 3 THEN 3 WHEN doc_id % 7 = 4 THEN 1 WHEN doc_id % 7 < 3 THEN 0 END AS retries,
  CASE WHEN doc_id % 7 < 3 THEN {NOW} - doc_id % 10 * 60 END AS processed_at, doc_id % 4 AS pages,
  CASE WHEN doc_id % 7 IN (3, 4) THEN 'render: broken' END AS error, doc_id FROM listing WHERE doc_id % 7 <> 6)"""
_GATED = f"""
gated AS (SELECT l.doc_id, CASE
  WHEN s.status = 'ok' AND s.mtime = l.mtime AND s.size = l.size THEN 'prefilter-skip'
  WHEN s.sha256 = l.token AND s.status = 'ok' THEN 'hash-unchanged'
  WHEN s.sha256 = l.token AND s.status = 'pending_split' THEN 'still-pending-split'
  WHEN s.sha256 = l.token AND coalesce(s.retries, 0) >= 3 THEN 'retry-capped'
  WHEN s.processed_at IS NOT NULL AND {NOW} - s.processed_at < 300 THEN 'cooldown' ELSE 'queued' END AS gate
  FROM listing l LEFT JOIN state s USING (rel) WHERE l.mtime >= {NOW} - 5 * 3600)"""


def query(sql: str, name: str | None = None):
    """Register a query under its function's name with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql.strip()
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    ext = F.when(n % 5 == 0, ".pdf").when(n % 5 == 1, ".zip").when(n % 5 == 2, ".RMDOC").when(n % 5 == 3, ".rm").otherwise(".txt")
    rel = F.concat(F.lit("notes/"), "source", F.lit("/doc"), n.cast("string"), ext)
    return read(spark, d, "documents").select(
        "doc_id", "text", F.col("n_chars").alias("size"), (n * 60 + EPOCH).cast("double").alias("mtime"), C.content_token(F.col("text")).alias("token"), "source", rel.alias("rel"), F.concat(F.lit("/vault/"), rel).alias("path")
    )


def records(files: DataFrame) -> DataFrame:
    m = F.col("doc_id") % 7
    known = {
        "rel": F.col("rel"),
        "mtime": F.when(m == 0, F.col("mtime")).otherwise(F.col("mtime") - 3600),
        "size": F.col("size"),
        "sha256": F.when(m == 1, C.content_token(F.concat("text", F.lit("x")))).otherwise(F.col("token")),
        "status": F.when(m.isin(3, 4), "error").when(m == 5, "pending_split").otherwise("ok"),
        "retries": F.when(m == 3, 3).when(m == 4, 1).when(m < 3, 0),
        "processed_at": F.when(m < 3, NOW - F.col("doc_id") % 10 * 60),
        "pages": F.col("doc_id") % 4,
        "error": F.when(m.isin(3, 4), "render: broken"),
    }
    kinds = {part.split()[0]: part.split()[1] for part in state.SCHEMA.split(", ")}
    return files.where(m != 6).select(*(known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in state.COLUMNS))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    files = listing(spark, d)
    return gate.change_gate(gate.recent(files, OPTIONS, NOW), records(files), OPTIONS, NOW)


# --- the gate -------------------------------------------------------------------------------------


@query(f"WITH {_LISTING}, {_STATE}, {_GATED} SELECT doc_id, gate FROM gated")
def change_gate(spark, d):
    return _gated(spark, d).select("doc_id", "gate")


@query(f"WITH {_LISTING}, {_STATE}, {_GATED} SELECT gate, count(*) AS n FROM gated GROUP BY gate")
def gate_summary(spark, d):
    return gate.summary(_gated(spark, d))


@query(f"WITH {_LISTING} SELECT doc_id FROM listing WHERE mtime >= {NOW} - 5 * 3600")
def recency_filter(spark, d):
    return gate.recent(listing(spark, d), OPTIONS, NOW).select("doc_id")


@query("""SELECT event_id, coalesce(epoch(ts) // 1 - lag(epoch(ts) // 1) OVER (PARTITION BY user_id ORDER BY ts) < 3600, false) AS deferred FROM events""")
def cooldown_gate(spark, d):
    return loop.cooled_down(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600, "event_id").select("event_id", "deferred")


@query("SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS wake, count(*) AS n FROM events GROUP BY 1")
def wake_coalesce(spark, d):
    return loop.wake_ups(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", 600)


@query("""SELECT event_id, m BETWEEN 60 AND 420 AS night, m >= 1380 OR m <= 360 AS wrapped, true AS broken
FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def run_window(spark, d):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return read(spark, d, "events").select("event_id", *(C.in_window(minute, w).alias(n) for n, w in (("night", "01:00-07:00"), ("wrapped", "23:00-06:00"), ("broken", "sometimes"))))


@query("""SELECT d.doc_id, coalesce(l.quality = 1, false) OR d.n_chars / 1000.0 <= 2.0 AS ready FROM documents d LEFT JOIN labels l USING (doc_id)""")
def split_ready(spark, d):
    marked = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "processed").alias("marker"))
    boxes = read(spark, d, "documents").join(marked, "doc_id", "left").select("doc_id", "marker", (F.col("n_chars") / 1000.0).alias("max_aspect"), F.lit(True).alias("readable"))
    return gate.split_ready(boxes, OPTIONS).select("doc_id", "ready")


@query("""SELECT conv_id, coalesce(max(CASE WHEN turn % 3 <> 0 THEN CAST(length(text) AS DOUBLE) / (turn % 3) END), 0.0) > 100 AS tall FROM conversations GROUP BY conv_id""")
def aspect_max(spark, d):
    boxes = read(spark, d, "conversations").select("conv_id", (F.col("turn") % 3).cast("double").alias("width"), F.length("text").cast("double").alias("height"))
    return gate.max_aspect(boxes, "conv_id").select("conv_id", (F.col("max_aspect") > 100).alias("tall"))


# --- state ----------------------------------------------------------------------------------------


@query(f"""WITH {_LISTING}, {_STATE} SELECT CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error,
CAST(count(*) FILTER (status = 'pending_split') AS BIGINT) AS pending_split, CAST(coalesce(sum(pages) FILTER (status = 'ok'), 0) AS BIGINT) AS total_pages FROM state""")
def manifest_status(spark, d):
    return state.counters(records(listing(spark, d)))


@query(f"WITH {_LISTING}, {_STATE} SELECT rel, status, CAST(coalesce(retries, 0) AS INTEGER) AS retries, coalesce(error, '') AS error FROM state WHERE status <> 'ok' ORDER BY rel")
def manifest_problems(spark, d):
    return state.problems(records(listing(spark, d)))


@query(f"""WITH {_LISTING}, {_STATE}, new AS (SELECT doc_id, rel, mtime, size, token AS sha256,
  CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'touched' END AS status FROM listing WHERE doc_id % 2 = 0 AND (doc_id % 3 <> 2 OR doc_id % 7 <> 6))
SELECT coalesce(n.rel, o.rel) AS rel,
  CASE WHEN n.status IS NULL THEN o.status WHEN n.status = 'touched' THEN o.status ELSE n.status END AS status,
  CAST(CASE WHEN n.status = 'ok' THEN 0 WHEN n.status = 'error' THEN 1 + CASE WHEN n.sha256 = o.sha256 THEN coalesce(o.retries, 0) ELSE 0 END ELSE o.retries END AS INTEGER) AS retries,
  CAST(coalesce(n.mtime, o.mtime) AS BIGINT) AS mtime,
  CASE WHEN n.status IS NULL OR n.status = 'touched' THEN o.sha256 ELSE n.sha256 END AS sha256,
  CAST(CASE WHEN n.status = 'ok' THEN 2 ELSE o.pages END AS INTEGER) AS pages
FROM state o FULL JOIN new n ON o.rel = n.rel""")
def manifest_upsert(spark, d):
    files = listing(spark, d)
    n = F.col("doc_id")
    status = F.when(n % 3 == 0, "ok").when(n % 3 == 1, "error").otherwise("touched")
    given = {"rel": F.col("rel"), "mtime": F.col("mtime"), "size": F.col("size"), "sha256": F.col("token"), "status": status, "retries": F.when(n % 3 == 0, 0), "pages": F.when(n % 3 == 0, 2)}
    kinds = {part.split()[0]: part.split()[1] for part in state.SCHEMA.split(", ")}
    new = files.where((n % 2 == 0) & ((n % 3 != 2) | (n % 7 != 6))).select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in state.COLUMNS))
    return state.merge(records(files), new).select("rel", "status", "retries", F.col("mtime").cast("bigint").alias("mtime"), "sha256", "pages")


# --- content and cache ----------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS token FROM documents")
def content_hash(spark, d):
    return listing(spark, d).select("doc_id", "token")


@query("SELECT substr(sha256(text), 1, 2) AS shard, count(*) AS n FROM documents GROUP BY 1")
def cache_shard(spark, d):
    return listing(spark, d).groupBy(C.cache_shard(F.col("token")).alias("shard")).agg(F.count("*").alias("n"))


def _halves(spark, d):
    files = listing(spark, d).select("doc_id", F.col("token").alias("sha256"))
    return files.where("doc_id % 2 = 1"), files.where("doc_id % 2 = 0").select("sha256")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def cache_hit(spark, d):
    return cache.hits(*_halves(spark, d)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def cache_miss(spark, d):
    return cache.misses(*_halves(spark, d)).select("doc_id")


@query("SELECT doc_id, base64(encode(text)) AS b64 FROM documents")
def base64_encode(spark, d):
    return read(spark, d, "documents").select("doc_id", C.one_line_base64(F.col("text")).alias("b64"))


@query(f"WITH {_LISTING} SELECT doc_id, 'mtime:' || mtime || ':' || size AS token FROM listing")
def mtime_token(spark, d):
    return listing(spark, d).select("doc_id", C.mtime_token(F.col("mtime").cast("bigint"), F.col("size")).alias("token"))


# --- page cutting ---------------------------------------------------------------------------------

#: Profile values above this are white, bands have so many rows, and this is the target height.
WHITE, BAND, TARGET = 0.0, 2, 10
_BANDS = f"""
y AS (SELECT vec_id, unnest(range(len(embedding))) AS y, unnest(embedding) AS b FROM embeddings),
i AS (SELECT vec_id, y, y - row_number() OVER (PARTITION BY vec_id ORDER BY y) AS island FROM y WHERE b > {WHITE}),
band AS (SELECT vec_id, min(y) AS start, count(*) AS height, min(y) + count(*) // 2 AS y FROM i GROUP BY vec_id, island HAVING max(y) < 63 AND count(*) >= {BAND})"""
_CUTS = f"""
g AS (SELECT vec_id, y, height AS gap, row_number() OVER (PARTITION BY vec_id ORDER BY y) AS k FROM band),
fold AS (
  SELECT DISTINCT vec_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS cut FROM g
  UNION ALL
  SELECT f.vec_id, f.k + 1, coalesce(c.cut, f.last), c.cut FROM fold f JOIN g ON g.vec_id = f.vec_id AND g.k = f.k + 1,
  LATERAL (SELECT CASE WHEN g.y - f.last >= 0.7 * {TARGET} THEN coalesce((SELECT min_by(h.y, h.y) FROM g h WHERE h.vec_id = g.vec_id AND h.y > g.y AND h.y - f.last <= 1.3 * {TARGET} AND h.gap > 1.3 * g.gap), g.y) END AS cut) c),
cut AS (SELECT vec_id, cut FROM fold WHERE cut IS NOT NULL)"""


def _bands(spark, d):
    return bands.white_bands(bands.rows_of(read(spark, d, "embeddings"), "vec_id", "embedding"), "vec_id", WHITE, BAND)


@query(f"WITH {_BANDS} SELECT vec_id, CAST(start AS BIGINT) AS start, CAST(height AS BIGINT) AS height, CAST(y AS BIGINT) AS y FROM band")
def whitespace_bands(spark, d):
    return _bands(spark, d)


@query(f"WITH RECURSIVE {_BANDS}, {_CUTS} SELECT vec_id, CAST(cut AS BIGINT) AS cut FROM cut")
def greedy_cuts(spark, d):
    return bands.cuts(_bands(spark, d), "vec_id", TARGET).select("vec_id", F.explode("cuts").alias("cut"))


@query(f"""WITH RECURSIVE {_BANDS}, {_CUTS},
e AS (SELECT vec_id, 640 - cut * 10 AS edge FROM cut UNION ALL SELECT vec_id, unnest([640, 0]) FROM (SELECT DISTINCT vec_id FROM cut)),
p AS (SELECT vec_id, edge AS top, lead(edge) OVER (PARTITION BY vec_id ORDER BY edge DESC) AS bottom FROM e)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY top DESC) AS segment, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom FROM p WHERE top - bottom >= 80""")
def segment_bounds(spark, d):
    pages = bands.cuts(_bands(spark, d), "vec_id", TARGET).where(F.size("cuts") > 0).withColumns({"image_height": F.lit(64), "page_height": F.lit(640.0)})
    return bands.segments(pages, "vec_id", 80).select("vec_id", "segment", F.col("top").cast("bigint").alias("top"), F.col("bottom").cast("bigint").alias("bottom"))


@query("""WITH p AS (SELECT label, unnest(range(len(embedding))) AS y, unnest(embedding) AS b FROM embeddings)
SELECT label, CAST(y AS INTEGER) AS y, CAST(floor(avg(CAST(b * 1024 AS BIGINT)) * 16) AS BIGINT) AS mean FROM p GROUP BY label, y""")
def row_mean(spark, d):
    pixels = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("y", "b")).select("label", "y", F.rint(F.col("b") * 1024).cast("bigint").alias("value"))
    return bands.row_mean(pixels, "label").select("label", "y", F.floor(F.col("brightness") * 16).alias("mean"))


@query("""SELECT doc_id, CAST(floor(w * s) AS INTEGER) AS width, CAST(floor(h * s) AS INTEGER) AS height
FROM (SELECT doc_id, w, h, least(1.0, CAST(1568 AS DOUBLE) / greatest(w, h)) AS s FROM (SELECT doc_id, n_chars + 1 AS w, doc_id % 4000 + 1 AS h FROM documents))""")
def fit_scale(spark, d):
    w, h = F.col("n_chars") + 1, F.col("doc_id") % 4000 + 1
    s = C.fit_scale(w, h, Options().max_px)
    return read(spark, d, "documents").select("doc_id", (w * s).cast("int").alias("width"), (h * s).cast("int").alias("height"))


# --- transcripts ----------------------------------------------------------------------------------


def _pages(spark, d):
    return read(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page_no"), "text")


_PAGES = "p AS (SELECT conv_id, list(struct_pack(n := turn + 1, t := text) ORDER BY turn) AS pages FROM conversations GROUP BY conv_id)"
_REL = "'notes/conv' || conv_id || '.zip'"


@query(f"""WITH {_PAGES} SELECT conv_id, '---\nsource: ' || {_REL} || '\nmodel: vision\n' || CASE WHEN conv_id % 2 = 0 THEN 'source_modified: 2024-01-01T00:00:00\n' ELSE '' END
|| 'processed_at: 2024-01-02T00:00:00\npages: ' || len(pages) || '\nchars_per_page: [' || list_aggregate(list_transform(pages, lambda x: CAST(length(x.t) AS VARCHAR)), 'string_agg', ', ') || ']\nstatus: ok\n---\n\n# Conversation '
|| conv_id || '\n\nSource: [[' || {_REL} || ']]\n\n' || list_aggregate(list_transform(pages, lambda x: '## Page ' || x.n || '\n\n' || x.t || '\n'), 'string_agg', '\n') AS transcript FROM p""")
def transcript_render(spark, d):
    title, rel = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.concat(F.lit("notes/conv"), F.col("conv_id").cast("string"), F.lit(".zip"))
    modified = F.when(F.col("conv_id") % 2 == 0, "2024-01-01T00:00:00")
    return transcript.collect_pages(_pages(spark, d), "conv_id").select("conv_id", transcript.with_front_matter(F.col("pages"), title, rel, "vision", modified, F.lit("2024-01-02T00:00:00")).alias("transcript"))


@query(f"""WITH {_PAGES} SELECT conv_id, '# Conversation ' || conv_id || '\n' || list_aggregate(list_transform(pages, lambda x: '\n\n## Page ' || x.n || '\n\n' || x.t || '\n'), 'string_agg', '') AS transcript FROM p""")
def transcript_plain(spark, d):
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return transcript.collect_pages(_pages(spark, d), "conv_id").select("conv_id", transcript.plain(F.col("pages"), title).alias("transcript"))


@query("SELECT conv_id, '[' || string_agg(CAST(length(text) AS VARCHAR), ', ' ORDER BY turn) || ']' AS chars_per_page FROM conversations GROUP BY conv_id")
def chars_per_page(spark, d):
    return transcript.collect_pages(_pages(spark, d), "conv_id").select("conv_id", C.json_int_list(F.col("chars_per_page")).alias("chars_per_page"))


@query("SELECT conv_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def pages_per_doc(spark, d):
    return transcript.collect_pages(_pages(spark, d), "conv_id").select("conv_id", "n_pages", "chars")


@query("""SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn) FILTER (trim(text) <> ''), '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def stream_fold(spark, d):
    return transcript.fold_tokens(read(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("""WITH listed AS (SELECT conv_id, list(turn ORDER BY turn * 7 % 5, turn) AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY list_position(ids, turn)) AS page_no FROM listed JOIN conversations c USING (conv_id) WHERE turn % 4 <> 3""")
def page_order(spark, d):
    turns = read(spark, d, "conversations")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 7 % 5).alias("k"), "turn"))).alias("ids"))
    pages = F.transform("ids", lambda x: F.struct(x["turn"].cast("string").alias("id")))
    # Both shapes of a content document, read by the bundle source.
    content = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.struct(pages.alias("pages")).alias("cPages")))).otherwise(F.to_json(F.struct(F.transform("ids", lambda x: x["turn"].cast("string")).alias("pages"))))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bundles.page_ids(c) for c in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["conv_id", "ids"])

    found = listed.select(F.col("conv_id").cast("long"), content.alias("content")).mapInArrow(run, "conv_id long, ids array<string>")
    ids = found.select("conv_id", F.posexplode("ids").alias("pos", "turn")).withColumn("turn", F.col("turn").cast("int"))
    stored = turns.where("turn % 4 <> 3").select("conv_id", "turn")
    return ids.join(stored, ["conv_id", "turn"]).select(F.col("conv_id").cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("turn").cast(turns.schema["turn"].dataType).alias("turn"), F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")).cast("bigint").alias("page_no"))


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'Talk ' || conv_id END AS title, CAST(count(*) AS BIGINT) AS n_pages, md5(string_agg(text, '' ORDER BY turn DESC)) AS pages_md5 FROM conversations GROUP BY conv_id""")
def bundle_extract(spark, d):
    """Each conversation as an archive with a page order and mostly a name, and read again."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                out, n = io.BytesIO(), row["conv_id"]
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("x.metadata", json.dumps({"visibleName": " " if n % 3 == 0 else f" Talk {n} "}))
                    z.writestr("x.content", json.dumps({"pages": [f"p{t['turn']}" for t in reversed(row["turns"])]}))
                    for t in row["turns"]:
                        z.writestr(f"x/p{t['turn']}.rm", t["text"].encode())
                got = bundles.read_bundle(out.getvalue())
                rows.append({"conv_id": n, "title": got.title, "n_pages": len(got.pages), "pages_md5": hashlib.md5(b"".join(p for _, p in got.pages)).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("title", pa.string()), ("n_pages", pa.int64()), ("pages_md5", pa.string())]))

    return turns.select(F.col("conv_id").cast("long"), "turns").mapInArrow(run, "conv_id long, title string, n_pages long, pages_md5 string")


@query("""SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id""")
def token_stream(spark, d):
    """Each conversation as the lines that a model streams, folded by the model client."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct(F.col("text").alias("response"))).alias("line")))).alias("lines"))

    def run(batches):
        for batch in batches:
            folded = [backends.fold_stream([*(x["line"].encode() for x in lines), b"", b'{"done": true}', b"not read"]) for lines in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(folded, pa.string())], ["conv_id", "text"])

    return turns.select(F.col("conv_id").cast("long"), "lines").mapInArrow(run, "conv_id long, text string")


@query("SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_match(spark, d):
    return read(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- names and paths ------------------------------------------------------------------------------

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _titles(spark, d):
    return read(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("visible"))


@query(f"SELECT page_id, coalesce(nullif(trim(regexp_replace({_TITLE} || ' / ' || url, '[^\\p{{L}}\\p{{N}} ._-]', '_', 'g')), ''), 'untitled') AS safe FROM pages")
def safe_title(spark, d):
    return _titles(spark, d).select("page_id", C.safe_title(F.concat("visible", F.lit(" / "), "url")).alias("safe"))


@query(f"SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN nullif(trim({_TITLE}), '') END, nullif(CASE WHEN page_id % 2 = 0 THEN 'page' || page_id ELSE '' END, ''), 'untitled') AS title FROM pages")
def title_precedence(spark, d):
    visible = F.when(F.col("page_id") % 3 == 0, F.col("visible"))
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("page"), F.col("page_id").cast("string"))).otherwise(" ")
    return _titles(spark, d).select("page_id", C.title(visible, name).alias("title"))


@query(f"""WITH {_LISTING} SELECT doc_id, '/vault/notes/_transcripts/' || source || '/doc' || doc_id || '-handwriting_converted.md' AS mirrored,
'/vault/notes/' || source || '/doc' || doc_id || '-handwriting_converted.md' AS beside FROM listing""")
def output_path(spark, d):
    path, stem = F.col("path"), C.stem(F.col("path"))
    return listing(spark, d).select("doc_id", C.output_path(path, stem, Options()).alias("mirrored"), C.output_path(path, stem, Options(out_alongside=True)).alias("beside"))


@query(f"""WITH {_LISTING} SELECT doc_id, 'doc' || doc_id AS stem, lower('.' || split_part(rel, '.', 2)) AS suffix, '/vault/notes/' || source AS parent FROM listing""")
def path_parts(spark, d):
    path = F.col("path")
    return listing(spark, d).select("doc_id", C.stem(path).alias("stem"), F.lower(C.suffix(path)).alias("suffix"), C.parent(path).alias("parent"))


@query(f"WITH {_LISTING} SELECT doc_id, rel FROM listing WHERE doc_id % 9 <> 0")
def rel_path(spark, d):
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("/elsewhere/"), "rel")).otherwise(F.col("path"))
    return listing(spark, d).select("doc_id", C.relative(path, "/vault/").alias("rel")).where("rel is not null")


@query(f"""WITH {_LISTING}, due AS (SELECT doc_id, rel, source, token, 'T' || doc_id % 40 AS title FROM listing),
own AS (SELECT source, title, min(rel) AS owner FROM due WHERE doc_id % 11 = 0 GROUP BY ALL),
ranked AS (SELECT due.*, owner, row_number() OVER (PARTITION BY source, title ORDER BY CASE WHEN owner = rel THEN 0 ELSE 1 END, string_split(rel, '/')) AS turn FROM due LEFT JOIN own USING (source, title)),
named AS (SELECT doc_id, rel, source, title, token, '/vault/notes/_transcripts/' || source || '/' || title AS base, coalesce(owner = rel, owner IS NULL AND turn = 1) AS first FROM ranked),
o AS (SELECT *, base || CASE WHEN first THEN '' ELSE '-' || substr(token, 1, 8) END || '-handwriting_converted.md' AS out_path FROM named)
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY out_path ORDER BY string_split(rel, '/')) = 1 THEN out_path
ELSE base || '-' || substr(token, 1, 8) || '-' || sha256(rel) || '-handwriting_converted.md' END AS out_path FROM o""")
def name_collision(spark, d):
    due = listing(spark, d).select("doc_id", "path", "rel", F.col("token").alias("sha256"), F.concat(F.lit("T"), (F.col("doc_id") % 40).cast("string")).alias("title"))
    owned = due.where("doc_id % 11 = 0").groupBy(C.output_path(F.col("path"), F.col("title"), Options()).alias("out_path")).agg(F.min("rel").alias("rel"))
    return transcript.name_outputs(due, owned, Options()).select("doc_id", "out_path")


@query(f"WITH {_LISTING} SELECT doc_id FROM listing WHERE doc_id % 5 <> 4")
def scan_suffix_filter(spark, d):
    return listing(spark, d).where(C.is_input(F.col("path"))).select("doc_id")


@query(f"WITH {_LISTING} SELECT doc_id, row_number() OVER (ORDER BY string_split(rel, '/')) AS place FROM listing")
def scan_path_order(spark, d):
    # A total order of paths: places within folders, and a running sum over the folders' sizes.
    files = listing(spark, d).select("doc_id", "source", "rel")
    inside = files.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(C.components(F.col("rel")))))
    sizes = files.groupBy("source").agg(F.count("*").alias("size"))
    before = sizes.withColumn("skip", F.sum("size").over(Window.orderBy("source")) - F.col("size")).drop("size")
    return inside.join(before, "source").select("doc_id", (F.col("n") + F.col("skip")).cast("bigint").alias("place"))


@query(f"WITH {_LISTING} SELECT doc_id FROM listing WHERE source <> 'src1'")
def exclude_prefix(spark, d):
    return listing(spark, d).where(~C.under(F.col("path"), "/vault/notes/src1/")).select("doc_id")


@query(f"""WITH {_LISTING} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'not-md' WHEN 1 THEN 'overwrites-source' WHEN 2 THEN 'forbidden' WHEN 3 THEN 'escapes-output' WHEN 4 THEN 'escapes-output' END AS violation FROM listing""")
def path_guard(spark, d):
    o, n, out = Options(forbidden_paths=("/secret",)), F.col("doc_id") % 6, "/vault/notes/_transcripts/"
    target = F.when(n == 0, out + "a.txt").when(n == 1, out + "b.md").when(n == 2, "/secret/c.md").when(n == 3, "/elsewhere/d.md").when(n == 4, out + "../e.md").otherwise(out + "f.md")
    source = F.when(n == 1, out + "b.md").otherwise(F.col("path"))
    return listing(spark, d).select("doc_id", C.path_violation(target, source, o).alias("violation"))


# --- small scalars --------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS back FROM events")
def iso_timestamp(spark, d):
    iso = C.iso_seconds(F.col("ts"))
    return read(spark, d, "events").select("event_id", iso.alias("iso"), C.from_iso(F.when(F.col("event_id") % 4 == 0, "at some time").otherwise(iso)).alias("back"))


@query("""SELECT event_id, list_filter(list_transform(string_split(event_type || ', ,' || user_id || ' ,', ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second,
CAST(len(list_filter(list_transform(string_split(event_type || ', ,' || user_id || ' ,', ','), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM events""")
def csv_list(spark, d):
    parts = C.csv_list(F.concat("event_type", F.lit(", ,"), F.col("user_id").cast("string"), F.lit(" ,")))
    return read(spark, d, "events").select("event_id", F.element_at(parts, 2).alias("second"), F.size(parts).alias("n"))


@query("""SELECT event_id, lower(trim(CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE ' WHEN 2 THEN 'on' WHEN 3 THEN '1' WHEN 4 THEN 'off' ELSE '' END)) IN ('1', 'true', 'yes', 'on') AS value FROM events""")
def bool_parse(spark, d):
    n = F.col("event_id") % 6
    raw = F.when(n == 0, " Yes").when(n == 1, "TRUE ").when(n == 2, "on").when(n == 3, "1").when(n == 4, "off").otherwise("")
    return read(spark, d, "events").select("event_id", C.truth(raw).alias("value"))


@query("SELECT CAST(event_id AS BIGINT) AS attempt, CAST(floor(least(2 * pow(1.5, least(event_id, 100)), 30) * 1000) AS BIGINT) AS ms FROM events")
def backoff_schedule(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("attempt"), F.floor(C.backoff(F.col("event_id")) * 1000).alias("ms"))
