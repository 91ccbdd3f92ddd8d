"""Column expressions: paths, names, tokens, times. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.options import INPUT_SUFFIXES, TRUE_WORDS, Options


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """Folder of a path without the last slash; empty for a bare name."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"/+$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, empty if there is none; a leading dot begins a name, not a suffix."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(path)))


def is_input(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*INPUT_SUFFIXES)


def components(path: Column) -> Column:
    """Sort key that orders paths folder by folder rather than byte by byte."""
    return F.split(path, "/")


def under(path: Column, prefix: str) -> Column:
    prefix = prefix.rstrip("/")
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def relative(path: Column, root: str) -> Column:
    """Path below root; null for a path that isn't."""
    root = root.rstrip("/")
    return F.when(F.startswith(path, F.lit(root + "/")), path.substr(F.lit(len(root) + 2), F.length(path)))


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.regexp_replace(text, r"^(?U:\s)+|(?U:\s)+$", "")


def safe_title(title: Column) -> Column:
    """Title as a file name: other characters than letters, numbers, space and ._- become underscores."""
    kept = F.regexp_replace(title, r"[^\p{L}\p{N} ._-]", "_")
    return F.coalesce(F.nullif(F.trim(kept), F.lit("")), F.lit("untitled"))


def title(visible: Column, name_stem: Column) -> Column:
    return F.coalesce(F.nullif(strip(visible), F.lit("")), F.nullif(strip(name_stem), F.lit("")), F.lit("untitled"))


def output_path(path: Column, title_: Column, o: Options, tag: Column | None = None) -> Column:
    """Where a source's transcript goes; ``tag`` tells apart sources of one title."""
    name = F.concat(safe_title(title_), *([F.lit("-"), tag] if tag is not None else []), F.lit(o.out_suffix + ".md"))
    if o.out_alongside:
        folder = parent(path)
    else:
        inside = parent(relative(path, o.source_dir))
        folder = F.when(inside == "", F.lit(o.output_dir)).otherwise(F.concat(F.lit(o.output_dir + "/"), inside))
    return F.concat(folder, F.lit("/"), name)


def path_violation(target: Column, source: Column, o: Options) -> Column:
    """Why a transcript must not be written to target; null if it may."""
    bad = F.when(F.lower(suffix(target)) != ".md", "not-md").when(target == source, "overwrites-source")
    for prefix in o.forbidden_paths:
        bad = bad.when(under(target, prefix), "forbidden")
    if not o.out_alongside:
        bad = bad.when(~F.startswith(target, F.lit(o.output_dir + "/")), "escapes-output")
    return bad.when(target.contains("/../"), "escapes-output")


def content_token(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def mtime_token(mtime: Column, size: Column) -> Column:
    return F.concat_ws(":", F.lit("mtime"), mtime.cast("string"), size.cast("string"))


def cache_shard(sha: Column) -> Column:
    return F.substring(sha, 1, 2)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(text: Column) -> Column:
    """Epoch seconds of an ISO timestamp; what can't be read is 0."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0))


def json_int_list(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*TRUE_WORDS)


def fit_scale(width: Column, height: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


def backoff(attempt: Column) -> Column:
    """Seconds before the next readiness probe."""
    return F.least(F.lit(2.0) * F.pow(F.lit(1.5), attempt), F.lit(30.0))


def one_line_base64(content: Column) -> Column:
    return F.regexp_replace(F.base64(content.cast("binary")), r"[\r\n]", "")


def in_window(minute: Column, window: str) -> Column:
    """Is a minute of the day inside a window such as 23:00-06:00; ends included, an empty or malformed
    window is always open, and a window whose start is after its end runs over midnight."""
    found = parse_window(window)
    if found is None:
        return F.lit(True)
    start, end = found
    inside = (minute >= start, minute <= end)
    return inside[0] & inside[1] if start <= end else inside[0] | inside[1]


def parse_window(window: str) -> tuple[int, int] | None:
    parts = [p.strip().split(":") for p in window.split("-")]
    try:
        (h1, m1, *_), (h2, m2, *_) = parts
        ends = int(h1) * 60 + int(m1), int(h2) * 60 + int(m2)
    except ValueError:
        return None
    fits = all(0 <= int(h) < 24 and 0 <= int(m) < 60 for h, m in ((h1, m1), (h2, m2)))
    return ends if fits else None
