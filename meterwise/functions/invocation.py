"""Invocation-record projections on a parsed VARIANT record.

Pure expressions: no UDF, the whole projection stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterwise.config import SCHEMA_TYPE, UNKNOWN_MODEL, UNKNOWN_USER
from meterwise.functions import variant as V

# Token field names, in fallback order, per kind.
INPUT_FIELDS = ("$.input.inputTokenCount", "$.input.inputTokens")
OUTPUT_FIELDS = ("$.output.outputTokenCount", "$.output.outputTokens")
CACHE_WRITE_FIELDS = ("$.input.cacheWriteInputTokenCount", "$.input.cacheCreationInputTokenCount")
CACHE_READ_FIELDS = ("$.input.cacheReadInputTokenCount", "$.input.cacheReadInputTokens")
USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
# ARN markers after which the label is the last '/' segment.
ARN_LABEL_PATTERN = ":(assumed-role|user|federated-user)/"


def schema_type_ok(rec: Column) -> Column:
    """keep when schemaType is missing/empty or equals ModelInvocationLog."""
    st = V.field(rec, "$.schemaType")
    return ~V.truthy(st) | F.coalesce(V.text(st) == SCHEMA_TYPE, F.lit(False))


def model_id(rec: Column) -> Column:
    """modelId, falsy -> unknown-model."""
    m = V.field(rec, "$.modelId")
    return F.when(V.truthy(m), V.text(m)).otherwise(F.lit(UNKNOWN_MODEL))


def identity_label(rec: Column) -> Column:
    """User label from identity.arn / identity.callerArn."""
    ident = V.field(rec, "$.identity")
    arn_v = V.first_truthy(V.field(ident, "$.arn"), V.field(ident, "$.callerArn"))
    arn = V.text(arn_v)
    last = F.substring_index(arn, "/", -1)
    return (F.when(~V.truthy(ident) | arn.isNull() | (arn == ""), F.lit(UNKNOWN_USER))
             .when(arn.rlike(ARN_LABEL_PATTERN), F.coalesce(F.nullif(last, F.lit("")), arn))
             .otherwise(arn))


def usage_object(rec: Column) -> Column:
    """The usage object of ``output.outputBodyJson``.

    Object body -> its ``usage``; array body -> the last ``usage`` or
    ``message.usage`` object seen, replacing the whole object each time
    (inside one element ``message.usage`` wins); otherwise null (= {}).
    """
    body = V.field(rec, "$.output.outputBodyJson")
    arr = V.as_array(body)
    last = F.aggregate(
        arr, F.lit(None).cast("variant"),
        lambda acc, e: F.coalesce(V.as_object(V.field(e, "$.message.usage")),
                                  V.as_object(V.field(e, "$.usage")), acc))
    return (F.when(arr.isNotNull(), last)
             .when(V.is_object(body), V.as_object(V.field(body, "$.usage"))))


def with_tokens(df: DataFrame, rec: str = "rec", usage: str | None = None) -> DataFrame:
    """P2 + P4: four token counts with the fallback chain and coercion.

    First truthy of the two top-level names per kind; if input, output or
    cache-write is missing, all four are back-filled from the usage object;
    any value that ``int()`` would reject zeroes all four. Values are
    handled as their compact JSON text.
    """
    r = F.col(rec)
    u = F.col(usage) if usage else usage_object(r)
    js = [V.first_truthy_text(*[V.json_text(V.field(r, p)) for p in paths])
          for paths in (INPUT_FIELDS, OUTPUT_FIELDS, CACHE_WRITE_FIELDS, CACHE_READ_FIELDS)]
    names = ("_in", "_out", "_cw", "_cr")
    d = df.select("*", *[j.alias(n) for j, n in zip(js, names)], u.alias("_u"))
    need = ~(V.truthy_text(F.col("_in")) & V.truthy_text(F.col("_out")) & V.truthy_text(F.col("_cw")))
    filled = []
    for name, uf in zip(names, USAGE_FIELDS):
        uj = V.json_text(V.field(F.col("_u"), "$." + uf))
        filled.append(F.when(V.truthy_text(F.col(name)), F.col(name))
                       .when(need & V.truthy_text(uj), uj).alias(name))
    d = d.select(*df.columns, *filled)
    d = d.select("*", *[V.int_from_text(F.col(n)).alias(n + "_i") for n in names])
    bad = None
    for n in names:
        b = F.col(n).isNotNull() & F.col(n + "_i").isNull()
        bad = b if bad is None else (bad | b)
    outs = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
    zero = F.lit(0).cast("bigint")
    return d.select(*df.columns, *[F.when(bad, zero).otherwise(F.coalesce(F.col(n + "_i"), zero)).alias(o)
                                   for n, o in zip(names, outs)])


# ISO date forms accepted for the month: extended YYYY-MM-DD[...] (checked
# by a timestamp parse) and basic YYYYMMDD[...].
_EXTENDED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_BASIC = r"^([0-9]{4})([0-9]{2})([0-9]{2})(T[0-9]{2}([0-9]{2}([0-9]{2}([.,][0-9]+)?)?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$"

_BASIC_TIME = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:T([0-9]{2})([0-9]{2})?([0-9]{2})?([.,][0-9]+)?)?(Z|[+-][0-9]{2}:?(?:[0-9]{2})?)?$"


def month_bucket(rec: Column, fallback_month: Column, zone: str = "offset") -> Column:
    """P5: YYYY-MM of the timestamp *as written* (its own offset); absent or
    unparseable -> ``fallback_month`` (processing time or file time, passed
    in so runs are reproducible). ``zone='utc'`` converts to UTC first."""
    tsv = V.field(rec, "$.timestamp")
    s = F.when(V.truthy(tsv), V.text(tsv))
    parsed = F.try_to_timestamp(s)
    ext_ok = s.rlike(_EXTENDED) & parsed.isNotNull()
    basic_date = F.regexp_extract(s, _BASIC, 1)
    basic_ok = s.rlike(_BASIC) & F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(s, _BASIC, 1),
                                                                F.regexp_extract(s, _BASIC, 2),
                                                                F.regexp_extract(s, _BASIC, 3))).isNotNull()
    if zone == "utc":
        ext = F.date_format(parsed, "yyyy-MM")
    else:
        ext = F.substring(s, 1, 7)
    basic = F.concat(basic_date, F.lit("-"), F.regexp_extract(s, _BASIC, 2))
    return (F.when(F.coalesce(ext_ok, F.lit(False)), ext)
             .when(F.coalesce(basic_ok, F.lit(False)), basic)
             .otherwise(fallback_month))


def event_time(rec: Column, fallback: Column | None = None) -> Column:
    """Parsed event time (UTC instant): the extended form, else the basic form
    (YYYYMMDD[Thh[mm[ss]]]), else ``fallback`` (file or log-event time)."""
    tsv = V.field(rec, "$.timestamp")
    s = F.when(V.truthy(tsv), V.text(tsv))
    part = lambda i: F.regexp_extract(s, _BASIC_TIME, i)
    two = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    basic = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"),
                     two(6), F.regexp_replace(part(7), ",", "."), F.regexp_replace(part(8), r"^([+-][0-9]{2})([0-9]{2})$", "$1:$2"))
    times = [F.try_to_timestamp(s), F.when(s.rlike(_BASIC), F.try_to_timestamp(basic))]
    return F.coalesce(*times, *([] if fallback is None else [fallback]))


def canonical(df: DataFrame, fallback_month: Column, rec: str = "rec", zone: str = "offset",
              fallback_time: Column | None = None) -> DataFrame:
    """Record VARIANT -> canonical invocation columns (after the schema-type
    filter). Keeps any other columns of ``df``. ``fallback_time`` is the event
    time of records without a readable timestamp."""
    return every_record(df.where(schema_type_ok(F.col(rec))), fallback_month, rec, zone, fallback_time)


def every_record(df: DataFrame, fallback_month: Column, rec: str = "rec", zone: str = "offset",
                 fallback_time: Column | None = None) -> DataFrame:
    """The columns of :func:`canonical` for every row, whatever its schema type."""
    r = F.col(rec)
    d = with_tokens(df, rec)
    return d.select(
        *[c for c in df.columns if c != rec],
        V.text(V.field(r, "$.requestId")).alias("request_id"),
        event_time(r, fallback_time).cast("timestamp_ntz").alias("ts"),
        identity_label(r).alias("user"),
        model_id(r).alias("model_id"),
        month_bucket(r, fallback_month, zone).alias("month"),
        "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
