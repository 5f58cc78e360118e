"""Evaluation of prediction bundles: validate, score, write tables and a manifest."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from panelspark.operators import evidence, score, validate
from panelspark.schemas import KEY, PREDICTIONS
from panelspark.spark import kept

COLUMNS = [c.split()[0] for c in PREDICTIONS.split(", ")]


def evaluate(spark: SparkSession, bundles: Sequence[str], out: str, root: str, baseline: str = "vol_21d") -> DataFrame:
    """Reads bundles below root, checks that they compare, and only then makes `out` with five metric
    tables, each a folder of one CSV file, and a manifest. Returns all metric tables, computed once."""
    frames = [spark.read.parquet(f"{b}/predictions.parquet") for b in bundles]
    for f in frames:
        validate.check_predictions(f, COLUMNS)
    validate.check_comparable(frames, [f.agg({"h": "max"}).first()[0] for f in frames])
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    if not validate.has_model(rows, baseline).first()["present"]:
        raise ValueError(f"{baseline} is missing")
    cutoffs = {evidence.read_json(f"{b}/metadata.json")["data_cutoff"] for b in bundles}
    if len(cutoffs) != 1:
        raise ValueError("bundles differ in data cutoff")
    target = Path(out)
    evidence.inside(target, Path(root))
    target.mkdir(parents=True, exist_ok=False)
    tables = kept(score.metric_tables(rows), "metrics")
    keys = {"overall": [], "horizon": ["h"], "asset": ["asset"], "fold": ["fold"], "regime": ["fold", "regime"]}
    outputs = []
    for grain, more in keys.items():
        path = target / f"metrics_{grain}.csv"
        tables.where(f"grain = '{grain}'").select("model", *more, "pinball", "coverage", "width", "med_MAPE", "`pinball_%`").coalesce(1).sortWithinPartitions("model", *more).write.option("header", True).csv(str(path))
        outputs.append(path)
    facts = rows.agg(*evidence.facts()).first().asDict()
    evidence.write_manifest(spark, target / "manifest.json", root, [Path(b) / "predictions.parquet" for b in bundles], outputs, facts | {"cutoff": cutoffs.pop(), "key": KEY})
    return tables
