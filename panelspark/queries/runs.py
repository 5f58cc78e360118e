"""Paged sources, read once and as a stream, and the bundles, tables and manifests of a run."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import evidence
from panelspark.plans import evaluate
from panelspark.queries import frames as fr
from panelspark.queries.registry import query
from panelspark.sources import demo, ingest, paged
from panelspark.spark import kept, scratch

CLIENT = "panelspark.sources.demo:klines"
START = 10 * demo.HOUR
MADE = f"made AS (SELECT i, i * {demo.HOUR} AS ts_ms, 100.0 + i AS open, 102.0 + i AS high, 99.0 + i AS low, 101.0 + i AS close, i % 7 + 1.0 AS volume FROM range(10, {demo.BARS}) AS r(i))"
BARS = "symbol, ts_ms:i, open:2, high:2, low:2, close:2, volume:2"


def pages(spark, symbols: str, **options) -> DataFrame:
    spark.dataSource.register(paged.PagedOhlcv)
    return spark.read.format("paged_ohlcv").options(client=CLIENT, symbols=symbols, since=str(START), **options).load()


query("src4_paged_read", f"seq:i, {BARS}", lambda s, d: pages(s, "BTC/USDT,ETH/USDT"), "SELECT i - 10 AS seq, symbol, made.* FROM made, (VALUES ('BTC/USDT'), ('ETH/USDT')) AS t(symbol)", MADE)


def fallback(spark, d) -> DataFrame:
    """Perpetuals of a universe, one of which is listed under its second name alone."""
    chosen = spark.createDataFrame([("BTC", 2.0), ("PEPE", 1.0)], "base string, quote_volume double")
    return pages(spark, ingest.perpetual_symbols(chosen))


query("src9_symbol_fallback", BARS, fallback, "SELECT symbol, made.* FROM made, (VALUES ('BTC/USDT:USDT'), ('PEPE/USDT:USDT')) AS t(symbol)", MADE)
query("src6_hourly_preset", "asset, date, close:2", lambda s, d: ingest.ohlcv(pages(s, "BTC/USDT,ETH/USDT"), F.lit("1970-01-15 12:30:00").cast("timestamp_ntz"), ingest.PRESETS["1h"], 300), "SELECT asset, CAST(epoch_ms(ts_ms) AS TIMESTAMP) AS date, close FROM made, (VALUES ('BTC'), ('ETH')) AS t(asset) WHERE epoch_ms(ts_ms) < TIMESTAMP '1970-01-15 12:00:00'", MADE)


def cursor(spark, d) -> DataFrame:
    """A stream of pages that stops after half of them and goes on from its checkpoint."""
    spark.dataSource.register(paged.PagedOhlcv)
    folder = f"{scratch(spark)}/cursor-{uuid.uuid4().hex}"
    for until in (demo.BARS // 2, demo.BARS):
        rows = spark.readStream.format("paged_ohlcv").options(client=CLIENT, symbols="BTC/USDT,PEPE/USDT|1000PEPE/USDT", since=str(START), until=str(until * demo.HOUR)).load()
        run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").start()
        run.processAllAvailable()
        run.stop()
    return spark.read.parquet(f"{folder}/rows")


query("stream_cursor", BARS, cursor, "SELECT symbol, made.* FROM made, (VALUES ('BTC/USDT'), ('PEPE/USDT')) AS t(symbol)", MADE)


def bundles(spark, d) -> tuple[Path, list[str]]:
    """A reserved folder with predictions and metadata for each baseline."""
    root = Path(scratch(spark).removeprefix("file://").removeprefix("file:")) / f"runs-{uuid.uuid4().hex}"
    rows, out = fr.preds(spark, d), []
    for model in ("vol_5d", "vol_21d", "vol_63d"):
        folder = evidence.reserve(str(root), "daily", model.replace("_", "-"))
        evidence.save_bundle(rows.where(F.col("model") == model), folder, {"data_cutoff": "2001-08-02"})
        out.append(str(folder))
    return root, out


def saved(spark, d) -> DataFrame:
    return spark.read.parquet(*(f"{b}/predictions.parquet" for b in bundles(spark, d)[1]))


def tables(spark, d) -> Path:
    root, listed = bundles(spark, d)
    evaluate.evaluate(spark, listed, str(root / "out"), str(root))
    return root / "out"


query("snk5_saved_bundles", "model, asset, origin, h, y:3, sigma:8, q10:3, q50:3, q90:3", saved, "SELECT * FROM pred", fr.DAILY)
query("snk2_metric_tables", f"model, {fr.METRIC_SPEC}", lambda s, d: s.read.option("header", True).option("inferSchema", True).csv(str(tables(s, d) / "metrics_overall.csv")), f"SELECT model, {fr.METRICS} FROM pred GROUP BY model", fr.DAILY)


def manifest(spark, d) -> DataFrame:
    body = evidence.read_json(tables(spark, d) / "manifest.json")
    return spark.createDataFrame([(body["rows"], body["folds"], body["origins"], len(body["models"]), len(body["inputs"]), len(body["outputs"]))], "rows long, folds long, origins long, models long, inputs long, outputs long")


query("snk7_manifest", "rows, folds, origins, models, inputs, outputs", manifest, "SELECT count(*) AS rows, count(DISTINCT fold) AS folds, count(DISTINCT (asset, origin)) AS origins, count(DISTINCT model) AS models, 3 AS inputs, 5 AS outputs FROM pred", fr.DAILY)


def verified(spark, d) -> DataFrame:
    """A finished run, whole and then with a file too many, one changed and one lost: files that differ, and
    the rows of predictions that stay."""
    folder = Path(bundles(spark, d)[1][0])
    evidence.finalize(spark, folder, dict.fromkeys(evidence.REQUIRED, "x"))
    rows = spark.read.parquet(str(folder / "predictions.parquet")).agg(F.count("*").alias("rows"))
    out = None
    for step, act in (("whole", lambda: None), ("extra", lambda: (folder / "more").write_text("x")), ("changed", lambda: ((folder / "more").unlink(), (folder / "metadata.json").write_text("{}"))), ("missing", (folder / "metadata.json").unlink)):
        act()
        found = kept(evidence.differences(spark, folder), "differences").select(F.lit(step).alias("step"), "name", "state")
        out = found if out is None else out.unionByName(found)
    return out.crossJoin(F.broadcast(rows))


query("snk8_verified_run", "step, name, state, rows", verified, "SELECT step, name, step AS state, (SELECT count(*) FROM pred WHERE model = 'vol_5d') AS rows FROM (VALUES ('extra', 'more'), ('changed', 'metadata.json'), ('missing', 'metadata.json')) AS t(step, name)", fr.DAILY)


def attempt(act) -> str:
    """ok, or the kind of error."""
    try:
        act()
    except (ValueError, OSError) as e:
        return type(e).__name__
    return "ok"


def base(spark) -> Path:
    root = Path(scratch(spark).removeprefix("file://").removeprefix("file:")) / f"files-{uuid.uuid4().hex}"
    root.mkdir(parents=True)
    return root


def verdicts(spark, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "step string, verdict string")


def reserved(spark, d) -> DataFrame:
    root = str(base(spark))
    names = (("first", "r1"), ("taken", "r1"), ("other", "r2"), ("parent", "../x"), ("nested", "a/b"), ("hidden", ".x"), ("dot", "x."))
    return verdicts(spark, [(step, attempt(lambda n=name: evidence.reserve(root, "tree", "t", n))) for step, name in names])


def written(spark, d) -> DataFrame:
    file = base(spark) / "x"
    steps = (("create", lambda: evidence.create_once(file, "1")), ("again", lambda: evidence.create_once(file, "2")), ("replace", lambda: evidence.replace(file, "3")))
    rows = [(step, attempt(act)) for step, act in steps]
    return verdicts(spark, [*rows, ("text", file.read_text()), ("files", str(len(list(file.parent.iterdir()))))])


def portable(spark, d) -> DataFrame:
    root = base(spark)
    rows = [("inside", evidence.portable([str(root / "a")], root)[0]), ("plain", evidence.portable("plain", root))]
    return verdicts(spark, rows + [(step, attempt(lambda p=path: evidence.inside(Path(p), root))) for step, path in (("outside", "/elsewhere"), ("drive", r"C:\x"), ("leaves", "a/../../b"))])


def failed(spark, d) -> DataFrame:
    root = base(spark)
    evidence.record_failure(root, ValueError("first line\nsecond line"))
    body = evidence.read_json(root / "failure.json")
    return verdicts(spark, sorted(body.items()))


def listed(*rows: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") AS t(step, verdict)"


query("snk4_reserved_runs", "step, verdict", reserved, listed(("first", "ok"), ("taken", "FileExistsError"), ("other", "ok"), *((s, "ValueError") for s in ("parent", "nested", "hidden", "dot"))))
query("snk6_files_once", "step, verdict", written, listed(("create", "ok"), ("again", "FileExistsError"), ("replace", "ok"), ("text", "3"), ("files", "1")))
query("snk9_portable_paths", "step, verdict", portable, listed(("inside", "a"), ("plain", "plain"), *((s, "ValueError") for s in ("outside", "drive", "leaves"))))
query("snk10_failure_record", "step, verdict", failed, listed(("message", "first line"), ("status", "incomplete"), ("type", "ValueError")))
