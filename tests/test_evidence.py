"""Sources, sinks, run folders, manifests and streams."""

import datetime as dt
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark.operators import evidence
from panelspark.plans import evaluate
from panelspark.sources import paged
from panelspark.streaming import bars as stream
from test_panel import frame, prediction


def test_pages_advance_retry_and_never_cut_short():
    calls, waits = [], []

    def client(since):
        calls.append(since)
        if len(calls) == 2:
            raise ConnectionError
        return [[t] for t in range(since, min(since + 3, 8))]

    assert [p[0][0] for p in paged.pages(client, 0, 100, wait=waits.append)] == [0, 3, 6] and waits == [1.0]

    def dead(since):
        raise TimeoutError

    with pytest.raises(TimeoutError):
        list(paged.pages(dead, 0, 10, wait=waits.append))
    assert len(list(paged.pages(lambda since: [[5]], 5, 100))) == 1


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedOhlcv)
    rows = spark.read.format("paged_ohlcv").option("client", "fake_exchange:klines").option("symbols", "A/USDT,B/USDT").option("since", "5").load()
    assert rows.groupBy("symbol").agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).orderBy("symbol").collect() == [("A/USDT", 9, 10, 90), ("B/USDT", 9, 10, 90)]


def test_run_folders(tmp_path):
    day = dt.date(2026, 1, 2)
    assert evidence.reserve(str(tmp_path), "tree", "t", "r1", day).name == "tree-t-20260102-r1"
    with pytest.raises(FileExistsError):
        evidence.reserve(str(tmp_path), "tree", "t", "r1", day)
    for bad in ("../x", "a/b", ".hidden", "dot.", ""):
        with pytest.raises(ValueError, match="unsafe"):
            evidence.reserve(str(tmp_path), "tree", "t", bad)


def test_portable_paths(tmp_path):
    (tmp_path / "a").mkdir()
    assert evidence.portable({"x": [str(tmp_path / "a"), "plain", 3]}, tmp_path) == {"x": ["a", "plain", 3]}
    for bad in ("/elsewhere", r"C:\x", "a/../../b"):
        with pytest.raises(ValueError):
            evidence.inside(Path(bad), tmp_path)


def test_files_are_written_once_or_replaced(tmp_path):
    p = tmp_path / "x"
    evidence.create_once(p, "1")
    with pytest.raises(FileExistsError):
        evidence.create_once(p, "2")
    evidence.replace(p, "3")
    assert p.read_text() == "3" and [f.name for f in tmp_path.iterdir()] == ["x"]


def test_manifest_finds_tampering(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    with pytest.raises(ValueError, match="missing metadata"):
        evidence.finalize(spark, tmp_path, {}, ["seed"])
    evidence.finalize(spark, tmp_path, {"seed": 1}, ["seed"])
    evidence.verify(spark, tmp_path)
    (tmp_path / "b").write_text("2")
    with pytest.raises(ValueError, match="extra file"):
        evidence.verify(spark, tmp_path)
    (tmp_path / "b").unlink()
    (tmp_path / "a").write_text("x")
    with pytest.raises(ValueError, match="changed file"):
        evidence.verify(spark, tmp_path)
    (tmp_path / "a").unlink()
    with pytest.raises(ValueError, match="missing file"):
        evidence.verify(spark, tmp_path)
    evidence.record_failure(tmp_path, ValueError("first\nsecond"))
    assert json.loads((tmp_path / "failure.json").read_text())["message"] == "first"


def test_a_forged_listing_is_found(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    evidence.finalize(spark, tmp_path, {"seed": 1}, ["seed"])
    (tmp_path / "a").write_text("2")
    forged = evidence.hashed_files(spark, str(tmp_path)).where("name <> 'manifest.json'").drop("root").toPandas()
    spark.createDataFrame(forged).write.mode("overwrite").parquet(str(tmp_path / evidence.LISTING))
    with pytest.raises(ValueError, match="changed listing"):
        evidence.verify(spark, tmp_path)


def test_hashes_of_nested_long_and_oddly_named_files(spark, tmp_path):
    """Names are below their root; a file over several pieces hashes as it does whole."""
    files = {"x/day=1/a b.bin": b"1", "x/long": bytes(range(256)) * 12_000, "y/empty": b"", "y/50% é": b"2", "y/_hidden": b"3"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    roots = [str(tmp_path / "x"), str(tmp_path / "y"), str(tmp_path / "x" / "long")]
    found = {(r["root"], r["name"]): (r["bytes"], r["sha256"]) for r in evidence.hashed_files(spark, *roots[:2]).collect()}
    assert found == {(str(tmp_path / n[0]), n[2:]): (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if "_hidden" not in n}
    assert [(r["name"], r["bytes"]) for r in evidence.hashed_files(spark, roots[2]).collect()] == [("long", 256 * 12_000)]
    sums = {r["root"]: (r["files"], r["bytes"]) for r in evidence.totals(evidence.hashed_files(spark, *roots[:2]), "root").collect()}
    assert sums == {roots[0]: (2, 1 + 256 * 12_000), roots[1]: (2, 1)}


def test_listing_by_executors(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    now = evidence.hashed_files(spark, str(tmp_path))
    was = now.select("name", F.when(F.col("name") == "a", "0").otherwise(F.col("sha256")).alias("sha256")).union(spark.createDataFrame([("c", "1")], "name string, sha256 string"))
    assert sorted(map(tuple, evidence.compare_listing(was, now).collect())) == [("a", "changed"), ("c", "missing")]


def test_log_and_evaluation(spark, tmp_path):
    rows = frame(spark, *(prediction(model=m, h=h) for m in ("vol_21d", "xgb") for h in (1, 2)))
    bundles = []
    for m in ("vol_21d", "xgb"):
        folder = evidence.reserve(str(tmp_path), m.replace("_", "-"), "t", "r")
        evidence.save_bundle(rows.where(F.col("model") == m), folder, {"data_cutoff": "2025-02-01"})
        bundles.append(str(folder))
        with pytest.raises(ValueError, match="not empty"):
            evidence.save_bundle(rows, folder, {})
    tables = evaluate.evaluate(spark, bundles, str(tmp_path / "out"), str(tmp_path))
    assert tables.where("grain = 'overall'").count() == 2
    body = evidence.read_json(tmp_path / "out" / "manifest.json")
    assert body["rows"] == 4 and len(body["outputs"]) == 5 and body["models"] == ["vol_21d", "xgb"]
    with pytest.raises(FileExistsError):
        evaluate.evaluate(spark, bundles, str(tmp_path / "out"), str(tmp_path))
    with pytest.raises(ValueError, match="is missing"):
        evaluate.evaluate(spark, bundles[1:], str(tmp_path / "other"), str(tmp_path))
    log = evidence.melted(tables.where("grain = 'overall'"), "r", "t", {"k": 1}, ["pinball", "coverage"])
    for _ in range(2):
        evidence.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8


def test_stream_keeps_the_latest_batch(spark, tmp_path):
    schema, table = "asset string, v long", str(tmp_path / "table")
    for i, rows in enumerate(([("A", 1), ("B", 1)], [("B", 2), ("C", 2)], [("C", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(stream.keep_latest(table, ["asset"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    last = stream.versions(spark, table)[-1]
    assert sorted(map(tuple, spark.read.parquet(f"{table}/v{last}").collect())) == [("A", 1), ("B", 2), ("C", 3)]
