"""Merkle manifest of a dataset: a tree a group and one tree over the groups, by supersteps on RDDs.

Upward, each child sends its hash to its parent; a parent that has the messages of all its children
hashes them in order and sends the hash on. A tree is done when one node is left. Downward, a parent
sends each child the path above it: at each level the run of hashes that the child's line is in, and
its place there. With the path a leaf's proof is its siblings, and its root follows from any version
of its row. A message is at most eight hashes upward and eight for each level downward; the last step
down is made where the run of eight leaves is, once for the eight.

Every level is checkpointed in the folder of spark.checkpoint.dir, so that a lost executor costs the
tasks of one superstep. The driver sees the largest count of a group, whether a level has nodes, and
the root.

Edge cases: a null field is hashed as `-`, an empty one as `0:`; a null group is one of its own, first
in order; a group of one row has that leaf as its subroot; rows of the same identifier are ordered by
their leaf hashes, repeated rows are separate leaves, and a null identifier comes first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Mapping, Sequence

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .ranks import numbered

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joint(hashes: Sequence[str]) -> str:
    """The hash of a parent: of its children's hashes, as text."""
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def leaf_hash(values: Sequence[Column]) -> Column:
    """The hash of a row: its fields in order, each by its length in bytes and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


def leaves(docs: DataFrame, fields: Sequence[str], group: str, key: str, altered: Mapping[str, Column]) -> DataFrame:
    """key, unit, leaf and other (the leaf of the altered row) of each row, with its place in its group."""
    found = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("unit"), leaf_hash([F.col(c) for c in fields]).alias("leaf"), leaf_hash([altered.get(c, F.col(c)) for c in fields]).alias("other"))
    return numbered(found, "unit", ["key", "leaf", "other"])


def deal(key: tuple) -> int:
    """Which partition a node goes to."""
    return zlib.crc32(repr(key).encode())


def kept(rdd: RDD) -> RDD:
    """rdd, computed now and checkpointed."""
    rdd = rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    return rdd


def complete(record):
    """A parent whose children have all sent: ((group, place), (hash, size of its level, children))."""
    (unit, at), (size, sent) = record
    if len(sent) != min(FAN, size - FAN * at):
        raise ValueError(f"node {at} of group {unit!r} has {len(sent)} children")
    sent.sort(key=lambda m: m[0])
    return (unit, at), (joint([m[1] for m in sent]), -(-size // FAN), [m[1:] for m in sent])


def climb(nodes: RDD, most: int, parts: int) -> tuple[list[RDD], RDD]:
    """The levels of all trees and their tops. nodes: ((group, place), (hash, nodes of the group, rest)),
    where rest goes along to the first level's runs; `most` nodes are in the largest group. A level:
    ((group, place), (hash, nodes of the level, the run of children)). Tops: (group, (hash, level, rest))."""
    levels, tops, now = [], [], nodes
    while True:
        tops.append(now.filter(lambda x: x[1][1] == 1).map(lambda x, k=len(levels): (x[0][0], (x[1][0], k, None if k else x[1][2]))))
        if most <= 1:
            return levels, nodes.ctx.union(tops)
        sent = now.filter(lambda x: x[1][1] > 1).map(lambda x, k=len(levels): ((x[0][0], x[0][1] // FAN), (x[1][1], [(x[0][1] % FAN, x[1][0], None if k else x[1][2])])))
        now = kept(sent.reduceByKey(lambda a, b: (a[0], a[1] + b[1]), parts, deal).map(complete, preservesPartitioning=True))
        levels.append(now)
        most = -(-most // FAN)


def meet(level: RDD, come: RDD, parts: int) -> RDD:
    """The runs of a level with what has come down to them: ((group, place), (run, mark, path))."""
    both = level.mapValues(lambda v: (0, v[2])).union(come.partitionBy(parts, deal).mapValues(lambda v: (1, v)))
    return both.groupByKey(parts, deal).mapValues(lambda sent: (lambda run, come: (run[1], *come[1]))(*sorted(sent, key=lambda v: v[0])))


def descend(levels: list[RDD], tops: RDD, parts: int) -> RDD:
    """Sends paths down to the first level's runs: ((group, place), (run, mark, path)). tops: (group,
    (level, mark, path above)). A path is a list of (place in the run, run of hashes), from below to
    above; the mark goes along."""
    come = None
    for k in range(len(levels), 0, -1):
        here = tops.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1:]))
        met = meet(levels[k - 1], here if come is None else come.union(here), parts)
        come = met.flatMap(passed)
    return met


def passed(record):
    """What a parent sends to each child."""
    (unit, at), (run, mark, path) = record
    hashes = [m[0] for m in run]
    for i in range(len(run)):
        yield (unit, FAN * at + i), (mark, [(i, hashes), *path])


def folded(h: str, path) -> str:
    """The root that follows from a hash and the path above it."""
    for i, run in path:
        h = joint([*run[:i], h, *run[i + 1 :]])
    return h


def proofs(run, path, root: str, lone: bool = False):
    """(key, leaf, proof, root that follows from the other leaf, equal or not) for the leaves of a run;
    a lone leaf has none."""
    hashes = [r[0] for r in run]
    above = "".join(h for i, hs in path for j, h in enumerate(hs) if j != i)
    known = None
    for i, (leaf, (key, other)) in enumerate(run):
        own = path if lone else [(i, hashes), *path]
        if other != leaf:
            top = folded(other, own)
        else:
            top = known = known or folded(leaf, own)
        yield key, leaf, joint([*hashes[:i], *hashes[i + 1 :], above]), top, top == root


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", altered: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row of docs: its key, leaf, subroot (of its group), root, proof_sha256 (hash of its siblings
    up to the root), folded_root (what the row, with the fields of `altered` in place of its own, its
    proof's siblings and its place give) and verified (folded_root is the root)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(store.shared_dir(spark))
    parts = store.partitions(spark)
    rows = leaves(docs, fields, group, key, altered or {})
    sizes = rows.groupBy(F.col("unit").alias("_unit")).agg(F.count("*").alias("size"))
    most, groups = sizes.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    if not groups:
        return spark.createDataFrame([], schema_of(docs, key))
    rows = rows.join(sizes, F.col("unit").eqNullSafe(F.col("_unit"))).select("unit", "place", "leaf", "size", "key", "other")
    nodes = rows.rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3], (r[4], r[5]))))
    levels, tops = climb(nodes, most, parts)
    tops = kept(tops.coalesce(parts))
    subroots = spark.createDataFrame(tops.map(lambda x: (0, x[0], x[1][0])), "tree int, unit string, hash string")
    upper = numbered(subroots, "tree", ["unit"]).rdd.map(lambda r: ((0, r["place"]), (r["hash"], groups, r["unit"])))
    upper_levels, upper_tops = climb(upper, groups, parts)
    root, depth, unit = upper_tops.first()[1]
    if depth:
        runs = descend(upper_levels, context.parallelize([(0, (depth, None, []))], 1), parts)
        above = runs.flatMap(lambda x: [(m[1], (m[0], [(i, [n[0] for n in x[1][0]]), *x[1][2]])) for i, m in enumerate(x[1][0])])
    else:
        above = context.parallelize([(unit, (root, []))], 1)
    begun = tops.map(lambda x: (x[0], x[1][1:])).join(above, parts)
    found = begun.filter(lambda x: x[1][0][0] == 0).map(lambda x: ([(x[1][1][0], x[1][0][1])], *x[1][1], True))
    if levels:
        starts = begun.map(lambda x: (x[0], (x[1][0][0], *x[1][1])))
        found = found.union(descend(levels, starts, parts).map(lambda x: (*x[1], False)))
    rows = found.flatMap(lambda x: ((k, leaf, x[1], root, proof, top, ok) for k, leaf, proof, top, ok in proofs(x[0], x[2], root, x[3])))
    return spark.createDataFrame(rows, schema_of(docs, key), verifySchema=False)


def schema_of(docs: DataFrame, key: str) -> str:
    return f"`{key}` {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def lowered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict[str, Column]:
    """The tampering of the contract: texts of a third of the rows, by crc32 of the identifier, lose
    their capital letters A-Z. A row without an identifier keeps its text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    struck = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return {text: F.when(struck, F.translate(F.col(text), upper, lower)).otherwise(F.col(text))}
