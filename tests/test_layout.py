"""Laid-out tables: what is written comes back, and readers by asset move nothing."""

import datetime as dt
import re

import pytest

from panelspark.operators import features
from panelspark.plans import daily
from panelspark.sources import layout

START = dt.datetime(2020, 1, 1)


def panel(spark, assets=5, days=120):
    rows = [(f"A{a}", START + dt.timedelta(days=i), *[100.0 + (a * 31 + i * 17) % 23] * 4, 1.0 + i) for a in range(assets) for i in range(days)]
    return spark.createDataFrame(rows[::-1], "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.fixture
def ordered(spark):
    before = spark.conf.get(layout.ORDERED)
    spark.conf.set(layout.ORDERED, "true")
    yield
    spark.conf.set(layout.ORDERED, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_labels_and_mask_read_a_table_as_it_lies(spark, ordered):
    rows = panel(spark)
    table = layout.kept_in_buckets(rows, "panel", 3)
    assert len(table.inputFiles()) <= 3
    made = daily.prepared(table)
    text = plan(made)
    assert "Exchange" not in text and not re.search(r"\bSort\b", text) and "Exchange" in plan(daily.prepared(rows))
    assert made.exceptAll(daily.prepared(rows)).isEmpty() and made.count() == rows.count()


def test_two_tables_join_and_group_without_an_exchange(spark):
    a, b = (layout.kept_in_buckets(features.with_return(panel(spark)), n, 3) for n in ("left", "right"))
    a, b = a.hint("merge").groupBy("asset").agg({"lr": "avg"}), b.groupBy("asset").agg({"close": "max"})
    text = plan(a.join(b.hint("merge"), "asset"))
    assert "hashpartitioning" not in text and "SortMergeJoin" in text


def test_later_rows_are_appended_and_still_move_nothing(spark, tmp_path):
    rows = panel(spark, 4, 60)
    layout.laid_out(rows.where("date < '2020-02-01'"), "grown", str(tmp_path / "grown"), 2)
    table = layout.appended(rows.where("date >= '2020-02-01'"), "grown", 2)
    made = features.with_return(table)
    assert "Exchange" not in plan(made) and made.exceptAll(features.with_return(rows)).isEmpty() and table.count() == 240
    spark.sql("DROP TABLE grown")


def test_number_of_buckets_follows_rows_and_keys(spark):
    rows = panel(spark, 4, 60)
    assert [layout.buckets(rows, rows=n) for n in (1000, 100, 10)] == [1, 3, 4]
    assert layout.buckets(rows.limit(0)) == 1
    assert layout.kept_in_buckets(rows.limit(0), "empty").count() == 0
