"""Mixing sources to target weights on a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time 0 to 1, linear between its two ends; its
integral is the weight of the source. Targets share the token budget by weight, stop at `most` times
the size of their source, and what is over is shared again until none is above. A source that ramps
from a to b has drawn the part (a t + (b - a) t^2 / 2) of its target at time t; inverting that at the
demand before a document gives its training position, and documents are range-sorted by position.

Every document is taken the whole part of its source's ratio times; in an order drawn from a hash,
documents are taken once more until the target is met, the last of them in part. The order has two
levels, hash ranges and documents in a range, so that a source with a third of all rows is summed by
many tasks.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its
own, listed last; sources of size 0 have target 0; repeated rows are separate documents, ordered
among themselves arbitrarily but alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source and size in words."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, rank, weight and target. Filling by level: in order of
    cap per weight, the level is what a unit of weight gets once the sources before are capped; it
    rises while caps lie below it and falls after, so its maximum is the common level."""
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    listed = listed.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("ratio"), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    listed = listed.withColumn("level", left / open_weight)
    level = F.max("level").over(everything)
    return listed.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap"))).select("source", "source_size", "rank", "weight", "target")


def inverse(part: Column, lean: Column) -> Column:
    """The time at which a schedule that ramps from 1 - lean to 1 + lean has drawn `part`."""
    start = F.lit(1.0) - lean
    root = F.sqrt(F.greatest(start * start + F.lit(4.0) * lean * part, F.lit(0.0)))
    return F.when(lean == 0, part).otherwise(F.coalesce(F.try_divide(F.lit(2.0) * part, start + root), F.lit(0.0)))


def moment(demand: Column) -> Column:
    """The training time at which a source has drawn `demand` words of its target."""
    part = F.when(F.col("target") > 0, F.least(demand / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return inverse(part, F.col("lean"))


def drawn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), leans: Sequence[float] = (-0.5, 0.0, 0.5), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, begin (words of the source
    before it in the order of a pass) and lean."""
    sizes, _ = store.materialise(sized(docs, doc_id, text, source), "sizes")
    goals = targets(sizes, weights, share, most)
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = sizes.withColumn("draw", draw).withColumn("range", F.shiftright("draw", 50))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ordered = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lean = F.element_at(F.array(*(F.lit(float(x)) for x in leans)), (F.pmod(F.col("rank") - 1, F.lit(len(leans))) + 1).cast("int"))
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(ordered), F.lit(0)))
    heads = ranges.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(F.col("r.source").alias("head_source"), F.col("range").alias("head_range"), "range_start", "source_size", "target", lean.alias("lean"))
    inside = Window.partitionBy("source", "range").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(heads, F.col("source").eqNullSafe(F.col("head_source")) & (F.col("range") == F.col("head_range")))
    begin = F.col("range_start") + F.col("inner")
    goal = F.floor(F.col("target") + F.lit(1e-6))
    whole = F.when(F.col("source_size") > 0, F.expr("floor(floor(target + 1e-6) / source_size)")).otherwise(F.lit(0)).cast("long")
    extra = goal - F.col("whole") * F.col("source_size")
    joined = joined.withColumn("begin", begin).withColumn("whole", whole)
    taken = F.col("whole") * F.col("size") + F.least(F.greatest(extra - F.col("begin"), F.lit(0)), F.col("size"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "begin", "lean")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes,
    repeats counted), position (0 to 1, training time at which it is or would be first drawn) and
    positions (those of all copies that are taken, the last of them maybe in part), sorted by position.
    The options are those of drawn(): weights and leans repeat over the sources in code point order,
    null last; a lean of x ramps a schedule from (1 - x) to (1 + x) times its weight."""
    found = drawn(docs, **options)
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))).otherwise(F.array().cast("array<int>"))
    times = F.transform(copies, lambda k: moment(k * F.col("source_size") + F.col("begin")))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", moment(F.col("begin")).alias("position"), times.alias("positions")).orderBy("position", "doc_id")


def digest(mixed: DataFrame) -> DataFrame:
    """The contract columns of op8 from the operator's output, with the first and the last position."""
    last = F.round(F.try_element_at("positions", F.lit(-1)), 9)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"), last.alias("last_position"))


def training_order(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as the mix takes them, with their columns, range-sorted by the training position
    of each copy, which comes a pass of its source after the one before: whole copies, then the first
    words of a document that is taken in part. The rows that the mix does not take are left out. Rows are
    matched by identifier, source and size; of repeated rows each takes an equal share of their words,
    so a source stays at its target."""
    names = docs.columns
    mixed = drawn(docs, doc_id=doc_id, text=text, source=source, **options)
    plan = mixed.groupBy("doc_id", "source", "size").agg(F.expr("sum(taken) div count(*)").alias("mix_taken"), *(F.min(c).alias(c) for c in ("begin", "source_size", "target", "lean"))).where("mix_taken > 0")
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(F.col(c) for c in names)).alias("doc"), F.col(doc_id).alias("mix_id"), F.col(source).cast("string").alias("mix_source"), size.alias("mix_size"))
    joined = rows.join(plan, F.col("mix_id").eqNullSafe(F.col("doc_id")) & F.col("mix_source").eqNullSafe(F.col("source")) & (F.col("mix_size") == F.col("size")))
    copies = joined.withColumn("copy", F.explode(F.expr("sequence(0L, (mix_taken - 1) div size)")))
    words = F.least(F.col("size"), F.col("mix_taken") - F.col("copy") * F.col("size"))
    cut = F.when(words == F.col("size"), F.col(f"doc.{text}")).otherwise(first_words(F.col(f"doc.{text}").cast("string"), words))
    at = moment(F.col("copy") * F.col("source_size") + F.col("begin"))
    return copies.orderBy(at, "mix_id").select(*((cut if c == text else F.col(f"doc.{c}")).alias(c) for c in names))


def first_words(text: Column, n: Column) -> Column:
    """The first n words, joined by one space."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), n.cast("int")), " ")
