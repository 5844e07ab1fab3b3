"""Hand-computed edge rows for the record projections (FIXTURES.md E1-E7,
E10) and the file-shape decode rules (E15)."""

import json

from pyspark.sql import functions as F

from meterwise.functions import invocation as inv
from meterwise.functions.models import short_model
from meterwise.sources import log_scan


def _recs(spark, docs):
    rows = [(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("rec"))


def _tokens(spark, docs):
    d = inv.with_tokens(_recs(spark, docs), "rec").orderBy("i")
    return [tuple(r[c] for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"))
            for r in d.collect()]


def test_month_in_own_offset(spark):  # E1
    d = _recs(spark, [{"timestamp": "2024-01-31T23:30:00-05:00"}, {"timestamp": "2024-02-01T01:00:00Z"},
                      {"timestamp": "20240315T101500Z"}, {"timestamp": "not a time"}, {}])
    got = [r[0] for r in d.orderBy("i").select(inv.month_bucket(F.col("rec"), F.lit("1999-12"))).collect()]
    assert got == ["2024-01", "2024-02", "2024-03", "1999-12", "1999-12"]
    utc = [r[0] for r in d.orderBy("i").select(inv.month_bucket(F.col("rec"), F.lit("x"), zone="utc")).collect()]
    assert utc[0] == "2024-02"


def test_zero_counts_as_missing(spark):  # E2, E3
    e2 = {"input": {"inputTokenCount": 0}, "output": {"outputTokenCount": 3, "outputBodyJson": {"usage": {"input_tokens": 7}}}}
    e3 = {"input": {"inputTokenCount": 1, "cacheWriteInputTokenCount": 2},
          "output": {"outputTokenCount": 3, "outputBodyJson": {"usage": {"cache_read_input_tokens": 9}}}}
    assert _tokens(spark, [e2, e3]) == [(7, 3, 0, 0), (1, 3, 2, 0)]


def test_last_usage_replaces_whole_object(spark):  # E4
    e4 = {"output": {"outputBodyJson": [
        {"message": {"usage": {"input_tokens": 5, "cache_read_input_tokens": 7}}},
        "not an object",
        {"usage": {"output_tokens": 9}}]}}
    both = {"output": {"outputBodyJson": [
        {"usage": {"input_tokens": 1}, "message": {"usage": {"input_tokens": 2}}}]}}
    assert _tokens(spark, [e4, both]) == [(0, 9, 0, 0), (2, 0, 0, 0)]


def test_coercion(spark):  # E5
    ok = {"input": {"inputTokenCount": "12", "cacheWriteInputTokenCount": 1.9}, "output": {"outputTokens": " 3 "}}
    bad = {"input": {"inputTokenCount": "x", "cacheWriteInputTokenCount": 4}, "output": {"outputTokenCount": 5}}
    assert _tokens(spark, [ok, bad]) == [(12, 3, 1, 0), (0, 0, 0, 0)]


def test_identity_labels(spark):  # E6
    docs = [{"identity": {"arn": "arn:aws:sts::1:assumed-role/R/alice"}},
            {"identity": {"arn": "arn:aws:iam::1:user/bob"}},
            {"identity": {"arn": "arn:aws:iam::1:root"}},
            {"identity": {"arn": "arn:aws:iam::1:user/"}},
            {"identity": None},
            {"identity": {"arn": "", "callerArn": "arn:aws:sts::1:federated-user/carol"}}]
    got = [r[0] for r in _recs(spark, docs).orderBy("i").select(inv.identity_label(F.col("rec"))).collect()]
    assert got == ["alice", "bob", "arn:aws:iam::1:root", "arn:aws:iam::1:user/", "unknown", "carol"]


def test_short_model(spark):  # E7
    df = spark.createDataFrame([("arn:x:inference-profile/a/inference-profile/b",), ("plain",), ("",), (None,)], "m string")
    assert [r[0] for r in df.select(short_model(F.col("m"))).collect()] == ["a/inference-profile/b", "plain", "?", "?"]


def test_schema_type_filter(spark):  # E10
    docs = [{"schemaType": "Other"}, {"schemaType": ""}, {}, {"schemaType": "ModelInvocationLog"}]
    kept = [r[0] for r in _recs(spark, docs).where(inv.schema_type_ok(F.col("rec"))).orderBy("i").select("i").collect()]
    assert kept == [1, 2, 3]


def test_file_shapes(spark):  # E15 and the shape table
    texts = ['[{"a":1},{"b":2},3]', '{"records":[{"a":1},{"b":2}]}', '{\n  "a": 1\n}\n',
             '{"a":1}\n\n{"broken": \n{"b":2}', '{"a":1}\r\n{"b":2}\r\n', '{"a":1} trailing',
             "42", "[]", "   ", '{"records": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    recs = log_scan.records_only(log_scan.decode_records(df))
    counts = {r["i"]: r["n"] for r in recs.groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert [counts.get(i, 0) for i in range(len(texts))] == [2, 2, 1, 2, 2, 0, 0, 0, 0, 1]
    bad = {r["i"]: r["m"] for r in log_scan.decode_records(df).groupBy("i").agg(F.max("malformed").alias("m")).collect()}
    assert bad[3] == 1 and bad[0] == 1 and bad[5] == 1
