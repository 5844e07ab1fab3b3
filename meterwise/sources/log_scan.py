"""Invocation-log scan and decode.

Files live under ``<root>/<log dir>/
<region>/YYYY/MM/DD/HH/<name>``; the same layout written by a Spark writer
reads ``region=<r>/y=YYYY/m=MM/d=DD/h=HH/...``. Both are accepted: the
path parser allows the ``key=`` prefixes, and globs are built per layout.

Region and hour pruning happen in the *load paths* (non-Hive layout, so
not Catalyst partition pruning): unlisted regions and hours are never
listed. Modification-time pruning uses ``modifiedAfter`` in batch and a
filter on ``_metadata.file_modification_time`` in streams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterwise.functions import invocation, variant as V

PATH_RE = (r"/(?:region=)?([^/=]+)/(?:y=)?([0-9]{4})/(?:m=)?([0-9]{2})/(?:d=)?([0-9]{2})/"
           r"(?:h=)?([0-9]{2})/(.*)$")
HOUR_DIR_RE = (r"^(.*?/(?:region=)?[^/=]+/(?:y=)?[0-9]{4}/(?:m=)?[0-9]{2}/(?:d=)?[0-9]{2}/"
               r"(?:h=)?[0-9]{2})/")
# Python's str.splitlines() line boundaries.
LINE_SPLIT = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


@dataclass(frozen=True)
class LogLayout:
    base: str            # <root>/<log dir> (see raw_records.LOG_DIR)
    hive: bool = False   # region=/y=/m=/d=/h= directory names

    def region_dir(self, region: str) -> str:
        return f"{self.base}/region={region}" if self.hive else f"{self.base}/{region}"

    def all_regions_glob(self) -> str:
        return f"{self.base}/*"

    def hour_dir(self, hour: datetime) -> str:
        if self.hive:
            return hour.strftime("y=%Y/m=%m/d=%d/h=%H")
        return hour.strftime("%Y/%m/%d/%H")

    def day_glob(self, day: datetime) -> str:
        """All hour directories of one day."""
        if self.hive:
            return day.strftime("y=%Y/m=%m/d=%d/h=*")
        return day.strftime("%Y/%m/%d/*")


def regions_to_scan(raw: str | None) -> list[str] | None:
    """``auto`` (or empty) -> None = every region present; otherwise a
    comma list, trimmed, blanks dropped."""
    s = (raw or "auto").strip()
    if s.lower() == "auto":
        return None
    out = [r.strip() for r in s.split(",") if r.strip()]
    return out or None


def hour_floor(t: datetime) -> datetime:
    return t.replace(minute=0, second=0, microsecond=0)


def hour_prefixes(cutoff: datetime, now: datetime) -> list[datetime]:
    """S3: each hour from floor(cutoff) to floor(now), both ends included."""
    first = hour_floor(cutoff)
    last = (hour_floor(now) - first) // timedelta(hours=1)
    return [first + timedelta(hours=h) for h in range(last + 1)]


def hour_prefixes_df(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """S3 as a DataFrame: one ``YYYY/MM/DD/HH`` prefix per hour between the
    two time columns of each input row."""
    seq = F.sequence(F.date_trunc("hour", F.col(start)), F.date_trunc("hour", F.col(end)),
                     F.expr("INTERVAL 1 HOUR"))
    return bounds.select(F.explode(seq).alias("hour")).select(
        F.date_format("hour", "yyyy/MM/dd/HH").alias("prefix"))


def scan_window(now: Column, checkpoint: Column, lookback_minutes: int, max_lookback_minutes: int) -> Column:
    """S5 / ST10: no checkpoint -> now - look-back; else
    max(min(checkpoint, now - look-back), now - max look-back)."""
    lb = now - F.expr(f"INTERVAL {int(lookback_minutes)} MINUTES")
    mx = now - F.expr(f"INTERVAL {int(max_lookback_minutes)} MINUTES")
    return F.when(checkpoint.isNull(), lb).otherwise(F.greatest(F.least(checkpoint, lb), mx))


def previous_run(runs: DataFrame, col: str = "now") -> DataFrame:
    """Checkpoint of each run = the previous run (none for the first).

    Two levels, so no window holds every run: ``lag`` within each day, and
    the first run of a day takes the last run of the previous day from a
    one-row-per-day table (a window over days).
    """
    from pyspark.sql import Window
    d = runs.withColumn("_day", F.to_date(F.col(col)))
    d = d.withColumn("checkpoint", F.lag(col).over(Window.partitionBy("_day").orderBy(col)))
    days = d.groupBy("_day").agg(F.max(col).alias("_last"))
    days = days.withColumn("_prev_last", F.lag("_last").over(Window.orderBy("_day"))).select("_day", "_prev_last")
    d = d.join(days, "_day")
    return d.withColumn("checkpoint", F.coalesce(F.col("checkpoint"), F.col("_prev_last"))).drop("_day", "_prev_last")


def load_paths(layout: LogLayout, regions: list[str] | None, hours: list[datetime] | None) -> list[str]:
    """Globs to load: every (region, hour) directory asked for."""
    rdirs = [layout.region_dir(r) for r in regions] if regions else [layout.all_regions_glob()]
    if hours is None:
        return [f"{d}/*/*/*/*/**" if not layout.hive else f"{d}/*/*/*/*" for d in rdirs]
    # a day whose 24 hours are all in the window is listed with one glob
    by_day: dict = {}
    for h in hours:
        by_day.setdefault(h.date(), []).append(h)
    parts = []
    for day, hs in by_day.items():
        if len(hs) == 24:
            parts.append(layout.day_glob(hs[0]))
        else:
            parts.extend(layout.hour_dir(h) for h in hs)
    return [f"{d}/{p}" for d in rdirs for p in parts]


def scan_files(spark: SparkSession, paths: list[str], modified_after: datetime | None = None) -> DataFrame:
    """S1 (+S4): one row per object: whole decompressed text and metadata.

    ``wholetext`` is passed as an argument (an ``.option`` would be
    ignored); ``.gz`` objects are decompressed by the codec. Keys ending in
    ``/`` are directories and never returned.
    """
    from meterwise.session import glob_exists
    # an hour or region prefix without objects lists nothing (Spark's loader
    # would reject a missing path): one glob status call per prefix
    paths = [p for p in paths if glob_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "path string, modified timestamp, size long, text string")
    reader = spark.read.option("recursiveFileLookup", "true")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    df = reader.text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(
        path.alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("text"))


def list_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path and modification time of every object below ``paths``; no content is read."""
    from meterwise.session import glob_exists
    paths = [p for p in paths if glob_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "path string, modified timestamp")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
                 .select("path", F.col("modificationTime").alias("modified")))


def _decompress(batches):
    """gzip -> text; bytes that are not gzip are taken as UTF-8 text with
    replacement (the metered system's fallback); a damaged gzip stream
    yields no text and a ``read_error``. An archive of several members is read
    whole."""
    import gzip
    import zlib

    import pandas as pd

    for pdf in batches:
        texts, errors = [], []
        for b in pdf.pop("content"):
            raw = bytes(b) if b is not None else b""
            if raw[:2] == b"\x1f\x8b":
                try:
                    texts.append(gzip.decompress(raw).decode("utf-8", errors="replace"))
                    errors.append(None)
                except (zlib.error, EOFError, gzip.BadGzipFile) as e:
                    texts.append(None)
                    errors.append(f"gzip: {e}")
            else:
                texts.append(raw.decode("utf-8", errors="replace"))
                errors.append(None)
        pdf["text"] = pd.Series(texts, dtype=object)
        pdf["read_error"] = pd.Series(errors, dtype=object)
        yield pdf


def scan_files_robust(spark: SparkSession, paths: list[str], since: datetime | None = None,
                      until: datetime | None = None) -> DataFrame:
    """S1 robust mode: every object below ``paths`` (folders or globs of folders) read as bytes
    (``binaryFile``) and decompressed in a vectorised ``mapInPandas``, so ``.gz``-named plain
    objects and truncated archives neither fail the job nor vanish
    (``ignoreCorruptFiles`` would drop them). Same columns as
    :func:`scan_files` plus ``read_error``.

    Objects come from listing their folders, so no name is ever taken for a
    pattern. ``since`` and ``until`` bound the modification time; the file
    reader applies them before it opens an object.
    """
    from meterwise.session import glob_exists
    paths = [p for p in paths if glob_exists(spark, p)]
    schema = "path string, modified timestamp, size long, text string, read_error string"
    if not paths:
        return spark.createDataFrame([], schema)
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    if since is not None:
        b = b.where(F.col("modificationTime") >= F.lit(since))
    if until is not None:
        b = b.where(F.col("modificationTime") <= F.lit(until))
    b = b.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return b.mapInPandas(_decompress, schema)


def hour_folder(path: Column) -> Column:
    """The hour directory of an object path."""
    return F.regexp_extract(path, HOUR_DIR_RE, 1)


def literal(path: str) -> str:
    """A path as a pattern that matches nothing but itself."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def with_path_parts(files: DataFrame) -> DataFrame:
    """Region, hour and object key parsed from the object path."""
    p = F.col("path")
    hour = F.concat_ws("/", *[F.regexp_extract(p, PATH_RE, i) for i in (2, 3, 4, 5)])
    return (files.withColumn("region", F.regexp_extract(p, PATH_RE, 1))
                 .withColumn("hour", hour)
                 .withColumn("object_key", F.concat_ws("/", F.col("region"), F.col("hour"),
                                                       _object_name(F.regexp_extract(p, PATH_RE, 6)))))


def _object_name(rest: Column) -> Column:
    """Object name below the hour directory; the fixture's partition folders
    ``shape=<s>/chunk=<c>/part-...`` collapse to ``<s>-<c>``."""
    return F.when(rest.rlike(r"^shape=[0-9]+/chunk=[0-9]+/"),
                  F.regexp_replace(rest, r"^shape=([0-9]+)/chunk=([0-9]+)/.*$", "$1-$2")).otherwise(rest)


def _documents(s: Column) -> Column:
    """The text's JSON documents, read as the elements of a list (so one of them means that
    nothing trails it); null if it is not JSON."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))), "$", "array<variant>")


def _strict_parse(s: Column) -> Column:
    """Exactly one JSON document (trailing text rejected) -> VARIANT, else null."""
    arr = _documents(s)
    return F.when(F.array_size(arr) == 1, F.element_at(arr, 1))


def _long_items(s: Column) -> Column:
    """Records of a document too long for one VARIANT: the elements of its
    list (or of its ``records`` list) are read one by one; else null."""
    one = F.concat(F.lit("["), s, F.lit("]"))
    as_list = F.from_json(one, "array<array<variant>>")
    as_records = F.from_json(one, "array<struct<records:array<variant>>>")
    return F.coalesce(F.when(F.array_size(as_list) == 1, F.element_at(as_list, 1)),
                      F.when(F.array_size(as_records) == 1, F.element_at(as_records, 1)["records"]))


def decode_records(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Every object's text -> one row per record (VARIANT ``rec``).

    Whole text a JSON list -> its objects; an object with a ``records`` list
    -> those objects; another object -> itself; lists too long for one VARIANT
    are read element by element; not one JSON document -> each non-blank line
    parsed on its own, bad lines dropped. Non-object values and bad lines are
    counted in ``malformed`` (per object) instead of failing the run; an
    object that could not be read (null text) counts as 1.
    """
    t = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", "")
    unread = F.col(text_col).isNull().cast("int")
    # every text is parsed once: what is looked at twice is a column of its own or an array's element
    d = files.withColumn("_t", t).withColumn("_docs", _documents(F.col("_t")))
    d = d.withColumn("_doc", F.when(F.array_size("_docs") == 1, F.element_at("_docs", 1)))
    doc = F.col("_doc")
    doc_arr = V.as_array(doc)
    recs_arr = F.try_variant_get(doc, "$.records", "array<variant>")
    from_doc = (F.when(doc_arr.isNotNull(), doc_arr)
                 .when(recs_arr.isNotNull(), recs_arr)
                 .when(V.is_object(doc), F.array(doc))
                 .otherwise(F.array().cast("array<variant>")))
    lines = F.filter(F.transform(F.split(F.col("_t"), LINE_SPLIT), lambda l: F.trim(l)), lambda l: l != "")
    parsed_lines = F.filter(F.transform(lines, _documents), lambda a: F.array_size(a) == 1)
    from_lines = F.filter(F.flatten(parsed_lines), lambda v: v.isNotNull())
    d = d.withColumn("_long", F.when(doc.isNull(), _long_items(F.col("_t"))))
    by_line = doc.isNull() & F.col("_long").isNull() & (F.col("_t") != "")
    d = d.withColumn("_items", F.when(F.col("_t") == "", F.array().cast("array<variant>"))
                               .when(doc.isNotNull(), from_doc)
                               .when(F.col("_long").isNotNull(), F.col("_long"))
                               .otherwise(from_lines))
    bad_lines = F.when(by_line, F.size(lines) - F.size(F.col("_items"))).otherwise(F.lit(0))
    other = F.filter(F.col("_items"), lambda v: ~F.coalesce(V.is_object(v), F.lit(False)))
    d = d.withColumn("malformed", (unread + bad_lines + F.size(other)).cast("bigint"))
    keep = [c for c in files.columns if c != text_col]
    out = d.select(*keep, "malformed", F.posexplode_outer("_items").alias("pos", "rec"))
    return out


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON-lines mode of S1: one row per line through Spark's line reader.

    For layouts known to hold JSON lines only, this replaces the whole-text
    read: uncompressed objects are split across tasks at any size (a whole
    text must fit one task and one string). Line breaks are LF, CR or CRLF.
    """
    from meterwise.session import glob_exists
    paths = [p for p in paths if glob_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "path string, modified timestamp, size long, line string")
    df = spark.read.option("recursiveFileLookup", "true").text(paths)
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_modification_time").alias("modified"),
                     F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"))


def decode_lines(lines: DataFrame) -> DataFrame:
    """Lines -> one row per record (VARIANT ``rec``); blank lines skipped,
    ``malformed`` = 1 for a line that is not exactly one JSON object."""
    t = F.trim(F.regexp_replace(F.col("line"), r"^\s+|\s+$", ""))
    d = lines.where(t != "").select(*[c for c in lines.columns if c != "line"],
                                    F.explode(F.array(_strict_parse(t))).alias("rec"))
    ok = F.col("rec").isNotNull() & V.is_object(F.col("rec"))
    return d.withColumn("malformed", F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("bigint"))


def records_only(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("rec").isNotNull() & V.is_object(F.col("rec"))).drop("malformed")


def decoded_rows(files: DataFrame, fallback_month: Column, zone: str = "offset") -> DataFrame:
    """Objects -> one narrow row per decoded item, at least one per object.

    ``present`` marks the items that are JSON objects, ``counted`` those of the
    wanted schema type; ``first`` marks one row of each object, which carries the
    object's ``malformed`` count. So one pass over the content serves the usage
    and the run's own counts.
    """
    rec = F.col("rec")
    d = (decode_records(files).withColumn("first", F.coalesce(F.col("pos"), F.lit(0)) == 0).drop("pos")
         .withColumn("present", F.coalesce(rec.isNotNull() & V.is_object(rec), F.lit(False)))
         .withColumn("counted", F.coalesce(F.col("present") & invocation.schema_type_ok(rec), F.lit(False))))
    return invocation.every_record(d, fallback_month, "rec", zone, F.col("modified"))


def decode_invocations(files: DataFrame, fallback_month: Column, zone: str = "offset") -> DataFrame:
    """Objects -> canonical invocations (schema-type filter applied)."""
    recs = records_only(decode_records(files))
    return invocation.canonical(recs, fallback_month, "rec", zone, F.col("modified") if "modified" in files.columns else None)


def decode_invocations_lines(lines: DataFrame, fallback_month: Column, zone: str = "offset") -> DataFrame:
    """JSON-lines mode: lines -> canonical invocations."""
    recs = decode_lines(lines).where(F.col("malformed") == 0).drop("malformed")
    return invocation.canonical(recs, fallback_month, "rec", zone, F.col("modified") if "modified" in lines.columns else None)
