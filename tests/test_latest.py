"""The keep-latest table: only slots of a batch are written, a batch can be run again, readers see whole batches."""

import datetime as dt
import os

import pytest

from panelspark.streaming import bars

SCHEMA = "asset string, date timestamp_ntz, close double, arrival int"


def day(i, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i, minutes=minute)


def table(path):
    return bars.Latest(str(path), ["asset", "date"], "arrival", "date_format(date, 'yyyyMMdd')")


def rows_of(spark, t):
    return sorted(tuple(r) for r in t.read(spark, SCHEMA).collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_batch_writes_its_slots_alone(spark, tmp_path):
    t = table(tmp_path / "t")
    first = [(a, day(i, m), float(i), 0) for a in "AB" for i in range(20) for m in (0, 15)]
    t.write(spark.createDataFrame(first, SCHEMA), 0)
    before = files(tmp_path / "t" / "data")
    t.write(spark.createDataFrame([("A", day(19), 5.0, 1), ("A", day(20), 6.0, 1), ("B", day(3), 7.0, -1)], SCHEMA), 1)
    after = files(tmp_path / "t" / "data")
    assert all(after[f] == before[f] for f in before if f in after) and len(set(after) - set(before)) == 3
    want = {(a, d): (c, n) for a, d, c, n in first} | {("A", day(19)): (5.0, 1), ("A", day(20)): (6.0, 1)}
    assert rows_of(spark, t) == sorted((a, d, c, n) for (a, d), (c, n) in want.items())


def test_a_batch_can_be_run_again(spark, tmp_path, monkeypatch):
    t = table(tmp_path / "t")
    t.write(spark.createDataFrame([("A", day(0), 1.0, 0), ("A", day(1), 1.0, 0)], SCHEMA), 0)
    one = rows_of(spark, t)
    batch = spark.createDataFrame([("A", day(1), 2.0, 1)], SCHEMA)
    real = bars._fs

    def lost(spark, path):
        if "/new/" in path:
            raise RuntimeError("lost")
        return real(spark, path)

    monkeypatch.setattr(bars, "_fs", lost)
    with pytest.raises(RuntimeError, match="lost"):
        t.write(batch, 1)
    monkeypatch.setattr(bars, "_fs", real)
    assert rows_of(spark, t) == one
    for _ in range(2):
        t.write(batch, 1)
        assert rows_of(spark, t) == [("A", day(0), 1.0, 0), ("A", day(1), 2.0, 1)]


def test_two_versions_stay(spark, tmp_path):
    t = table(tmp_path / "t")
    for n in range(5):
        t.write(spark.createDataFrame([("A", day(0), float(n), n), ("A", day(n + 1), 1.0, n)], SCHEMA), n)
    assert bars.versions(spark, f"{tmp_path}/t/log") == [3, 4]
    assert len(rows_of(spark, t)) == 6 and ("A", day(0), 4.0, 4) in rows_of(spark, t)
    kept = [d for d in os.listdir(tmp_path / "t" / "data" / "v0") if d.startswith("_slot")]
    assert kept == ["_slot=20240102"]


def test_empty_batches_and_tables(spark, tmp_path):
    t = table(tmp_path / "t")
    assert rows_of(spark, t) == []
    t.write(spark.createDataFrame([], SCHEMA), 0)
    assert rows_of(spark, t) == []
