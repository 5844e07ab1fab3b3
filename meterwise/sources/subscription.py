"""Subscription payloads (S7): base64(gzip(JSON envelope)).

Envelope: ``{logGroup, logStream, logEvents: [{id, timestamp, message}]}``,
each ``message`` one invocation record as JSON text. Spark SQL has no gzip
expression, so (de)compression runs in a vectorised ``mapInPandas`` over
Arrow batches; everything else is built-in expressions.
"""

from __future__ import annotations

import base64
import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from meterwise.functions import invocation, variant as V

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("logGroup", T.StringType()),
    T.StructField("logStream", T.StringType()),
    T.StructField("logEvents", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("message", T.StringType())]))),
])
# Fixed fixture values.
LOG_GROUP = "/aws/invocation-logs"
EVENTS_PER_ENVELOPE = 100


ENVELOPES_HELD = 64  # texts a task holds at once: an Arrow batch has up to 10,000 envelopes


def _slices(batches):
    for pdf in batches:
        for i in range(0, len(pdf), ENVELOPES_HELD):
            yield pdf.iloc[i:i + ENVELOPES_HELD].copy()


def _gzip_b64(batches):
    for pdf in _slices(batches):
        pdf["data"] = [base64.b64encode(gzip.compress(s.encode("utf-8"), mtime=0)).decode("ascii")
                       for s in pdf.pop("payload")]
        yield pdf


def _gunzip(batches):
    for pdf in _slices(batches):
        out, err = [], []
        for b in pdf["raw"]:
            if b is None:
                out.append(None)
                err.append("missing")
                continue
            try:
                out.append(gzip.decompress(bytes(b)).decode("utf-8"))
                err.append(None)
            except (zlib.error, EOFError, gzip.BadGzipFile, UnicodeDecodeError) as e:
                out.append(None)
                err.append(type(e).__name__)
        pdf = pdf.drop(columns=["raw"])
        pdf["payload"] = pd.Series(out, dtype=object, index=pdf.index)
        pdf["error"] = pd.Series(err, dtype=object, index=pdf.index)
        yield pdf


def encode_envelopes(raw: DataFrame) -> DataFrame:
    """Fixture: raw records (event_id, ts, region, json) grouped into
    envelopes of at most 100 log events per (region, event-id block)."""
    ev = F.struct(F.col("event_id").cast("string").alias("id"),
                  F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                  F.col("json").alias("message"))
    g = (raw.groupBy("region", F.floor(F.col("event_id") / EVENTS_PER_ENVELOPE).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("event_id"), ev.alias("e")))).alias("evs")))
    env = F.to_json(F.struct(F.lit(LOG_GROUP).alias("logGroup"),
                             F.concat(F.col("region"), F.lit("/"), F.col("block").cast("string")).alias("logStream"),
                             F.transform("evs", lambda x: x["e"]).alias("logEvents")))
    p = g.select("region", "block", env.alias("payload"))
    return p.mapInPandas(_gzip_b64, "region string, block bigint, data string")


def decode_envelopes(df: DataFrame, data_col: str = "data") -> DataFrame:
    """base64 -> gunzip -> envelope -> one row per log event (message text,
    event epoch ms). Undecodable payloads keep a row with ``error`` set."""
    raw = df.select("*", F.unbase64(F.col(data_col)).alias("raw")).drop(data_col)
    schema = T.StructType([f for f in raw.schema.fields if f.name != "raw"]
                          + [T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])
    unz = raw.mapInPandas(_gunzip, schema)
    env = unz.withColumn("env", F.from_json("payload", ENVELOPE_SCHEMA))
    return env.select(*[c for c in unz.columns if c not in ("payload",)],
                      F.col("env.logGroup").alias("log_group"), F.col("env.logStream").alias("log_stream"),
                      F.explode_outer("env.logEvents").alias("ev")) \
              .select("*", F.col("ev.id").alias("log_event_id"), F.col("ev.message").alias("message"),
                      F.col("ev.timestamp").alias("event_ms")).drop("ev")


def subscription_invocations(events: DataFrame, zone: str = "offset") -> DataFrame:
    """Log events -> canonical invocations. A missing or unparseable message,
    or one that is not a JSON object, is skipped (``skipped`` in the legacy
    summary); absent timestamps fall back to the log event's month."""
    from meterwise.sources.log_scan import _strict_parse
    # the parse goes through a generator so it runs once per message (a
    # plain alias would be re-evaluated by every filter pushed below it)
    d = events.select("*", F.explode(F.array(_strict_parse(F.col("message")))).alias("rec"))
    d = d.where(F.col("rec").isNotNull() & V.is_object(F.col("rec")))
    fallback = F.date_format(F.timestamp_millis(F.col("event_ms")), "yyyy-MM")
    return invocation.canonical(d.drop("message"), fallback, "rec", zone, F.timestamp_millis(F.col("event_ms")))


def event_rows(events: DataFrame, zone: str = "offset") -> DataFrame:
    """Log events -> one narrow row each, in the form of ``log_scan.decoded_rows``.

    An event whose message is missing or not one JSON document is ``malformed``; one that is
    not an object of the wanted schema type is present but not counted. An undecodable payload
    is one row with its error.
    """
    from meterwise.sources.log_scan import _strict_parse
    rec, at = F.col("rec"), F.timestamp_millis(F.col("event_ms"))
    unread = F.col("error").isNotNull()
    d = events.select("*", F.explode(F.array(_strict_parse(F.col("message")))).alias("rec"))
    d = d.select(F.coalesce("log_stream", F.lit("")).alias("path"), "region", at.alias("modified"),
                 F.col("error").alias("read_error"), F.lit(True).alias("first"),
                 F.when(~unread & rec.isNull(), 1).otherwise(0).cast("bigint").alias("malformed"),
                 F.coalesce(V.is_object(rec), F.lit(False)).alias("present"),
                 F.coalesce(V.is_object(rec) & invocation.schema_type_ok(rec), F.lit(False)).alias("counted"), "rec")
    return invocation.every_record(d, F.date_format(F.col("modified"), "yyyy-MM"), "rec", zone, F.col("modified"))
