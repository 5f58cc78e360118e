"""Gap bars of a stream whose bars come in any order, some behind the watermark."""

import datetime as dt
import random

from panelspark.streaming import bars as stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double"


def bar(asset, i, close=None):
    close = float(i) if close is None else close
    return (asset, START + dt.timedelta(minutes=15 * i), close, close + 1, close - 1, close, 2.0)


def run(spark, folder, batches):
    """Rows by asset after all batches, and the query."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    name = f"late_{folder.name}".replace("-", "_")
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = stream.late_gap_bars(arriving, "1 hour").writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(folder / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r["asset"], (r["date"] - START).seconds // 900, r["close"], r["missing_bar"]) for r in spark.table(name).collect()), query


def grid(at, until, close=float):
    """What a list of bar numbers becomes, up to `until`."""
    out, last = [], None
    for i in sorted(set(at)):
        if i <= until:
            out += [(k, close(last), 1) for k in range(last + 1, i)] if last is not None else []
            out.append((i, close(i), 0))
            last = i
    return out


def test_shuffled_arrival_gives_the_grid_and_timers_serve_idle_assets(spark, tmp_path):
    """B has bars in the first batch alone; the watermark of the others' bars lets them go."""
    a = [i for i in range(48) if i % 5 != 3 and not 20 <= i < 26]
    late = random.Random(4)
    order = sorted(a, key=lambda i: i + late.uniform(0, 3.9))
    batches = [[bar("A", i) for i in order[k : k + 12]] for k in range(0, len(order), 12)]
    batches[0] += [bar("B", 5), bar("B", 2), bar("B", 3)]
    found, query = run(spark, tmp_path, batches)
    assert found == [("A", *r) for r in grid(a, max(a) - 4)] + [("B", *r) for r in grid([2, 3, 5], 5)]
    assert stream.dropped_late(query) == 0


def test_bars_behind_the_watermark_are_counted_and_repeats_keep_the_last(spark, tmp_path):
    """The bars 1 and 2 come after 20 has moved the watermark to 16; of the two bars 18 the later stays."""
    found, query = run(spark, tmp_path, [[bar("A", 0), bar("A", 20)], [bar("A", 18), bar("A", 21)], [bar("A", 1), bar("A", 2), bar("A", 18, 99.0)], [bar("A", 30)]])
    want = [(0, 0.0, 0)] + [(i, 0.0, 1) for i in range(1, 18)] + [(18, 99.0, 0), (19, 99.0, 1), (20, 20.0, 0), (21, 21.0, 0)]
    assert found == [("A", *r) for r in want]
    assert stream.dropped_late(query) == 2
