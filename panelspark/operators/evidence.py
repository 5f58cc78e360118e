"""Evidence: results log, run folders, bundles, manifests, portable paths, failure records.

Tables go through Spark; small documents are written by the driver."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import Path, PurePosixPath

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.validate import RUN_ID, check_predictions
from panelspark.schemas import PREDICTIONS

# What the metadata of a finished run must state.
REQUIRED = (
    "run_id", "pipeline", "family", "data_path", "data_end", "data_start", "assets", "rows", "gap_stats", "features", "future_features", "config",
    "train_end", "validation_start", "validation_end", "calibration_start", "calibration_end", "test_start", "test_end", "package_versions", "git_commit", "elapsed_seconds", "device",
)


def melted(metrics: DataFrame, run: str, tag: str, meta: Mapping[str, object], values: Sequence[str]) -> DataFrame:
    """Wide metrics by model to the rows of the results log."""
    note = ";".join(f"{k}={v}" for k, v in meta.items())
    long = metrics.select("model", *(F.col(f"`{v}`").cast("double").alias(v) for v in values)).unpivot("model", [f"`{v}`" for v in values], "metric", "value")
    return long.select(F.lit(run).alias("run"), F.lit(tag).alias("tag"), F.lit(note).alias("meta"), "model", "metric", "value")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def reserve(root: str, pipeline: str, tag: str, run_id: str | None = None, today: dt.date | None = None) -> Path:
    """Makes the run's own folder below root; raises if its name is unsafe or taken."""
    run_id = uuid.uuid4().hex if run_id is None else run_id
    for part in (pipeline, tag, run_id):
        if not re.fullmatch(RUN_ID, part) or part.endswith("."):
            raise ValueError(f"unsafe name {part!r}")
    base = Path(root).resolve()
    path = base / f"{pipeline}-{tag}-{(today or dt.date.today()):%Y%m%d}-{run_id}"
    inside(path, base)
    path.mkdir(parents=True, exist_ok=False)
    return path


def inside(path: Path, root: Path) -> str:
    """The path relative to root in POSIX form; raises where it lies outside."""
    text = str(path)
    if re.match(r"[A-Za-z]:[\\/]", text) or "\\" in text:
        raise ValueError(f"not a portable path: {text}")
    if ".." in PurePosixPath(text).parts:
        raise ValueError(f"path leaves its root: {text}")
    whole = path if path.is_absolute() else root / path
    try:
        return whole.resolve().relative_to(root.resolve()).as_posix()
    except ValueError:
        raise ValueError(f"path lies outside its root: {text}") from None


def portable(value, root: Path):
    """A JSON value with the absolute paths below root made relative."""
    if isinstance(value, Mapping):
        return {k: portable(v, root) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [portable(v, root) for v in value]
    if isinstance(value, Path) or isinstance(value, str) and os.path.isabs(value):
        return inside(Path(value), root)
    return value


def create_once(path: Path, text: str) -> None:
    """Writes a file that must not exist, whole or not at all."""
    own = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    own.write_text(text)
    try:
        os.link(own, path)
    finally:
        own.unlink()


def replace(path: Path, text: str) -> None:
    """Writes a file, whole or not at all."""
    own = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    own.write_text(text)
    os.replace(own, path)


def read_json(path: str | Path):
    return json.loads(Path(path).read_text())


def save_bundle(rows: DataFrame, folder: Path, metadata: Mapping[str, object]) -> None:
    """Valid predictions and metadata into a reserved folder that is still empty."""
    if any(folder.iterdir()):
        raise ValueError(f"{folder} is not empty")
    check_predictions(rows, [c.split()[0] for c in PREDICTIONS.split(", ")])
    rows.write.mode("errorifexists").parquet(str(folder / "predictions.parquet"))
    create_once(folder / "metadata.json", json.dumps(dict(metadata), sort_keys=True, default=str))


def facts() -> list[Column]:
    """Range, folds, origins, rows, models and horizons of predictions."""
    return [F.min("origin").cast("string").alias("first_origin"), F.max("origin").cast("string").alias("last_origin"), F.count_distinct("fold").alias("folds"), F.count_distinct("asset", "origin").alias("origins"), F.count("*").alias("rows"), F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("h")).alias("horizons")]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


def listed(root: str) -> list[tuple[str, str, int]]:
    """root, name below it and bytes of its files; names that begin with a dot or underscore are left out."""
    store, base = opened(root)
    if store.get_file_info(base).type == fs.FileType.File:
        return [(root, PurePosixPath(base).name, store.get_file_info(base).size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    names = ((f.path[len(base.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File)
    return [(root, n, size) for n, size in names if not any(p[0] in "._" for p in n.split("/"))]


def file_digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the SHA-256 of the files, read in pieces."""
    for b in batches:
        found = []
        for root, name in zip(b["root"], b["name"], strict=True):
            store, base = opened(root)
            alone = store.get_file_info(base).type == fs.FileType.File
            digest = hashlib.sha256()
            with store.open_input_stream(base if alone else f"{base.rstrip('/')}/{name}") as f:
                while piece := f.read(1 << 20):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield b.assign(sha256=found)


def hashed_files(spark: SparkSession, *paths: str) -> DataFrame:
    """root (one of the paths), name below it, bytes and sha256 of all files below the paths. The driver lists
    them, as for any scan (Spark's own leaves empty files out); the executors read them in pieces."""
    files = spark.createDataFrame([row for p in paths for row in listed(str(p))], "root string, name string, bytes long")
    return files.mapInPandas(file_digests, "root string, name string, bytes long, sha256 string")


def totals(listing: DataFrame, *keys: str) -> DataFrame:
    """files, bytes and a checksum of a listing that does not hang on its order: the sum of the first 48
    bits of the hash of each name and content."""
    part = F.conv(F.substring(F.sha2(F.concat_ws(" ", "name", "sha256"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return listing.groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum"))


def write_manifest(spark: SparkSession, path: Path, root: str, inputs: Sequence[Path], outputs: Sequence[Path], details: Mapping[str, object]) -> None:
    """Files, bytes and checksum of each input and output, hashed in one job, with the details."""
    base = Path(root)
    named = {str(p): inside(Path(p), base) for p in (*inputs, *outputs)}
    found = {r["root"]: {"files": r["files"], "bytes": r["bytes"], "checksum": r["checksum"]} for r in totals(hashed_files(spark, *named), "root").collect()}
    nothing = {"files": 0, "bytes": 0, "checksum": "0"}
    entries = lambda ps: [{"path": named[str(p)], **found.get(str(p), nothing)} for p in ps]
    create_once(path, json.dumps(portable({"inputs": entries(inputs), "outputs": entries(outputs), **details}, base), sort_keys=True, indent=1, default=str))


def compare_listing(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded against actual (name, sha256): what is missing, extra or changed."""
    a, b = recorded.select("name", F.col("sha256").alias("was")), actual.select("name", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").otherwise("changed")
    return a.join(b, "name", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("name", state.alias("state"))


#: Where a finished run lists its files.
LISTING = "_listing"


def finalize(spark: SparkSession, folder: Path, metadata: Mapping[str, object], required: Sequence[str] = REQUIRED) -> None:
    """Lists name, size and hash of every file as a table, states its totals in manifest.json with status
    complete, and reads the files again to verify them; needs all required metadata."""
    lost = sorted(set(required) - set(metadata))
    if lost:
        raise ValueError(f"missing metadata: {lost}")
    hashed_files(spark, str(folder)).where("name <> 'manifest.json'").drop("root").write.mode("overwrite").parquet(str(folder / LISTING))
    listed = totals(spark.read.parquet(str(folder / LISTING))).first().asDict()
    replace(folder / "manifest.json", json.dumps({"status": "complete", "metadata": dict(metadata), "listing": listed}, sort_keys=True, default=str))
    verify(spark, folder)


def differences(spark: SparkSession, folder: Path) -> DataFrame:
    """name and state (missing, extra, changed) of files of a finished run that are not as listed."""
    actual = hashed_files(spark, str(folder)).where("name <> 'manifest.json'")
    return compare_listing(spark.read.parquet(str(folder / LISTING)), actual)


def verify(spark: SparkSession, folder: Path) -> None:
    """Raises for a file that is missing, extra, changed or named in no canonical way, and for another listing
    than the manifest states."""
    body = read_json(folder / "manifest.json")
    if body["status"] != "complete":
        raise ValueError("run is not complete")
    listing = spark.read.parquet(str(folder / LISTING))
    if totals(listing).first().asDict() != body["listing"]:
        raise ValueError("changed listing")
    odd = listing.where(F.col("name").rlike(r"^/|\\|(^|/)\.{0,2}(/|$)")).first()
    if odd:
        raise ValueError(f"not a canonical path: {odd['name']}")
    first = differences(spark, folder).orderBy("name").first()
    if first:
        raise ValueError(f"{first['state']} file: {first['name']}")


def record_failure(folder: Path, error: BaseException) -> None:
    """failure.json with the kind of error and the first line of its message."""
    line = (str(error).splitlines() or [""])[0][:500]
    replace(folder / "failure.json", json.dumps({"status": "incomplete", "type": type(error).__name__, "message": line}))
