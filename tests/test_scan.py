"""Native log layout: region and hour pruning in the load paths."""

import gzip
import json
import os
import subprocess
import sys
import tempfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from meterwise.sources import log_scan
from meterwise.sources.raw_records import LOG_DIR


def _write(base, region, hour, name, records, gz=True):
    d = os.path.join(base, region, hour.strftime("%Y/%m/%d/%H"))
    os.makedirs(d, exist_ok=True)
    body = "\n".join(json.dumps(r) for r in records).encode()
    with open(os.path.join(d, name), "wb") as f:
        f.write(gzip.compress(body) if gz else body)


def _rec(user, model, n):
    return {"timestamp": "2024-05-01T10:00:00Z", "modelId": model,
            "identity": {"arn": f"arn:aws:sts::1:assumed-role/R/{user}"},
            "input": {"inputTokenCount": n}, "output": {"outputTokenCount": n}}


def test_native_layout_pruning(spark):
    root = tempfile.mkdtemp(prefix="mw-scan-")
    base = f"{root}/" + LOG_DIR.format(account="1")
    h9, h10, h11 = (datetime(2024, 5, 1, h) for h in (9, 10, 11))
    _write(base, "us-east-1", h9, "a.json.gz", [_rec("u1", "m-opus", 1)])
    _write(base, "us-east-1", h10, "b.json.gz", [_rec("u1", "m-opus", 2), _rec("u2", "m", 3)])
    _write(base, "eu-west-1", h10, "c.json.gz", [_rec("u3", "m", 4)])
    _write(base, "ap-south-1", h11, "d.json.gz", [_rec("u4", "m", 5)])
    lay = log_scan.LogLayout(base)
    hours = log_scan.hour_prefixes(datetime(2024, 5, 1, 9, 50), datetime(2024, 5, 1, 10, 5))
    assert hours == [h9, h10]
    files = log_scan.scan_files(spark, log_scan.load_paths(lay, ["us-east-1", "eu-west-1"], hours))
    files = log_scan.with_path_parts(files)
    assert sorted(r["region"] for r in files.collect()) == ["eu-west-1", "us-east-1", "us-east-1"]
    inv = log_scan.decode_invocations(files, F.lit("1999-01"))
    got = sorted((r["user"], r["input_tokens"]) for r in inv.collect())
    assert got == [("u1", 1), ("u1", 2), ("u2", 3), ("u3", 4)]
    everything = log_scan.scan_files(spark, log_scan.load_paths(lay, None, None))
    assert everything.count() == 4
    assert log_scan.regions_to_scan(" us-east-1 , ,eu-west-1") == ["us-east-1", "eu-west-1"]
    assert log_scan.regions_to_scan("auto") is None


def test_scan_window(spark):
    df = spark.createDataFrame([(datetime(2024, 5, 10, 12), None), (datetime(2024, 5, 10, 12), datetime(2024, 5, 10, 11)),
                                (datetime(2024, 5, 10, 12), datetime(2024, 5, 10, 11, 55)),
                                (datetime(2024, 5, 10, 12), datetime(2024, 4, 1))], "now timestamp, ck timestamp")
    got = [r[0] for r in df.select(log_scan.scan_window(F.col("now"), F.col("ck"), 15, 7 * 24 * 60)).collect()]
    assert got == [datetime(2024, 5, 10, 11, 45), datetime(2024, 5, 10, 11), datetime(2024, 5, 10, 11, 45),
                   datetime(2024, 5, 3, 12)]


def test_robust_scan_plain_and_truncated_gzip(spark):
    root = tempfile.mkdtemp(prefix="mw-robust-")
    base = f"{root}/" + LOG_DIR.format(account="1")
    h = datetime(2024, 5, 1, 9)
    _write(base, "us-east-1", h, "good.json.gz", [_rec("u1", "m", 1), _rec("u2", "m", 2)])
    _write(base, "us-east-1", h, "plain.json.gz", [_rec("u3", "m", 3)], gz=False)   # not gzip despite the name
    d = os.path.join(base, "us-east-1", h.strftime("%Y/%m/%d/%H"))
    whole = gzip.compress(("\n".join(json.dumps(_rec("u4", "m", 4)) for _ in range(50))).encode())
    with open(os.path.join(d, "cut.json.gz"), "wb") as f:
        f.write(whole[: len(whole) // 2])                                          # truncated archive
    lay = log_scan.LogLayout(base)
    files = log_scan.scan_files_robust(spark, log_scan.load_paths(lay, None, [h]))
    errs = {os.path.basename(r["path"]): r["read_error"] for r in files.collect()}
    assert errs["good.json.gz"] is None and errs["plain.json.gz"] is None and errs["cut.json.gz"].startswith("gzip")
    inv = log_scan.decode_invocations(log_scan.with_path_parts(files.drop("read_error")), F.lit("1999-01"))
    assert sorted(r["user"] for r in inv.collect()) == ["u1", "u2", "u3"]


def test_json_lines_mode_equals_whole_text_decode(spark, sf):
    from meterwise.plans import catalog
    lay = catalog.f2_layout(spark, sf)
    paths = [f"{lay.base}/*/*/*/*/*/shape={s}" for s in (0, 4)]      # the JSON-lines objects of the fixture
    whole = log_scan.records_only(log_scan.decode_records(log_scan.scan_files(spark, paths)))
    lines = log_scan.decode_lines(log_scan.scan_lines(spark, paths))
    key = lambda df: sorted(r[0] for r in df.select(F.to_json("rec")).collect())
    assert key(lines.where("malformed = 0")) == key(whole)
    bad = lines.where("malformed = 1").count()
    assert bad == log_scan.scan_files(spark, [paths[1]]).count()                 # one bad line per plain object


LONG_DOCUMENTS = """
import sys
from pyspark.sql import functions as F
from meterwise.functions import variant as V
from meterwise.session import build_session
from meterwise.sources import log_scan
spark = build_session("local[1]", app="long", shuffle_partitions=2, extra={"spark.driver.memory": "6g"})
d = log_scan.decode_records(log_scan.scan_files(spark, [sys.argv[1]]))
ok = F.col("rec").isNotNull() & V.is_object(F.col("rec"))
print([(r["n"], r["bad"]) for r in d.groupBy("path").agg(F.count_if(ok).alias("n"), F.max("malformed").alias("bad")).collect()])
"""


def test_a_document_longer_than_one_variant_is_read_whole():
    """A list and a ``records`` list of 140 MB each, with one value that is no record (its own JVM, for the heap)."""
    rec = json.dumps({"schemaType": "ModelInvocationLog", "timestamp": "2024-05-01T10:00:00Z", "modelId": "y",
                      "input": {"inputTokenCount": 3}, "pad": "p" * 14_000})
    root, n = tempfile.mkdtemp(prefix="mw-long-"), 10_000
    for name, head, tail in (("a", "[7,", "]"), ("b", '{"records":[7,', "]}")):
        with gzip.open(os.path.join(root, f"{name}.json.gz"), "wt", compresslevel=1) as f:
            f.write(head + ",".join([rec] * n) + tail)
    done = subprocess.run([sys.executable, "-c", LONG_DOCUMENTS, root], capture_output=True, text=True, timeout=300,
                          cwd=Path(__file__).resolve().parents[1])
    assert done.stdout.strip().endswith(str([(n, 1), (n, 1)])), done.stderr[-2000:]
