"""Repair of conversation structure: cheapest edits towards `(s?(ua)+)?`, by a recursive DuckDB query.

Rows are hash-partitioned by conversation and by stretch of SPAN turns, so a very long conversation is
many groups. In a task rows come sorted and are gathered into batches of segments (at most SEGMENT rows
of one stretch). For a batch one DuckDB query is run; each of its recursions advances one turn of all
segments and keeps, for every grammar state at which a segment may begin and every state reached, the
least cost and its audit. Segments compose like matrices: a second stage streams the segments of each
conversation in order, carrying cost, audit and running hash of the repaired text for four states.

Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. An edit is a letter:
D delete, I insert, K keep, R rerole. Inserts are counted with the row before which they stand; more
than one there is never cheapest, as the two letters could be left out or the system row deleted. All
audits of a state after the same rows end with a row's letter and have as many of these, so none is a
prefix of another, and the least one stays the least whatever follows.

Faults: blank (nothing but space), duplicate (role and text seen earlier in the conversation), truncated
(ends with none of `.!?`); the first counts. That a row repeats an earlier turn is found by aggregation
over hashes of role and text and sent along as a mark of a few bytes; texts are not compared across tasks.

Edge cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by
role, then text; repeated rows are duplicates; a null identifier is a conversation of its own; a
conversation that has no rows left has zeros, an empty audit and the hash of nothing; a very long text
is a batch of its own; an empty table gives no rows; other columns are ignored. Rows of one turn, and
those without a turn, are one stretch and one task, which streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

SPAN, SEGMENT = 256, 512
BATCH_ROWS, BATCH_CHARS = 8192, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
ENDS = tuple(".!?")
ROLES = {"u": "user", "a": "assistant"}
#: Grammar: state after a role's initial.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Costs of the edits, and what a truncated row that stays adds.
COST, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
#: Kinds of rows: the role's initial, or none that the grammar has, and fine, truncated or to be deleted.
INITIALS, STATES = ("s", "u", "a", ""), (0, 1, 2, 3)
#: Role of the row that an edit gives, by the state that it leads to.
WROTE = {2: "user", 3: "assistant"}


def kind_of(initial: str, fault: int) -> int:
    """fault: 0 none, 1 truncated, 2 blank or duplicate."""
    return 3 * (INITIALS.index(initial) if initial in ROLES or initial == "s" else 3) + fault


def moves() -> list[tuple[int, int, int, int, str]]:
    """(state, kind of row, state after it, cost, letters), for all ways past a row."""
    out = []
    for state in STATES:
        begun = [(state, 0, "")] + [(q, COST["I"], "I") for (p, x), q in NEXT.items() if p == state and x in ROLES]
        for initial in INITIALS:
            for fault in range(3):
                for at, cost, letters in begun:
                    out.append((state, kind_of(initial, fault), at, cost + COST["D"], letters + "D"))
                    if fault < 2:
                        more = TRUNCATED * fault
                        out += [(state, kind_of(initial, fault), q, cost + more + COST["K"], letters + "K") for (p, x), q in NEXT.items() if p == at and x == initial]
                        out += [(state, kind_of(initial, fault), q, cost + more + COST["R"], letters + "R") for (p, x), q in NEXT.items() if p == at and x in ROLES]
    return out


WALK = """WITH RECURSIVE walk(seg, entry, state, pos, cost, audit) USING KEY (seg, entry, state) AS (
 SELECT seg, entry, entry, 0::BIGINT, 0::BIGINT, '' FROM (SELECT DISTINCT seg FROM turns), (VALUES (0), (1), (2), (3)) AS s(entry)
 UNION
 SELECT seg, entry, after, pos, best.cost, best.audit FROM (
  SELECT w.seg, w.entry, m.after, t.pos, min({'cost': w.cost + m.cost, 'audit': w.audit || m.letters}) AS best
  FROM walk w JOIN turns t ON t.seg = w.seg AND t.pos = w.pos + 1 JOIN moves m ON m.state = w.state AND m.kind = t.kind GROUP BY ALL))
SELECT seg, entry, state, cost, audit FROM walk JOIN (SELECT seg, max(pos) AS pos FROM turns GROUP BY seg) USING (seg, pos) ORDER BY seg, entry, state"""


class Walker:
    """A DuckDB connection that finds the cheapest edits of a batch of segments."""

    def __init__(self):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.con.execute("CREATE TABLE moves(state INT, kind INT, after INT, cost BIGINT, letters VARCHAR)")
        self.con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())

    def paths(self, segments: list[list[int]]) -> list[list[tuple[int, int, int, str]]]:
        """(entry, state, cost, audit) of each segment, given as kinds of rows."""
        out = [[] for _ in segments]
        turns = pa.table({"seg": pa.array([i for i, s in enumerate(segments) for _ in s], pa.int32()), "pos": pa.array([p for s in segments for p in range(1, len(s) + 1)], pa.int64()), "kind": pa.array([k for s in segments for k in s], pa.int32())})
        if turns.num_rows:
            self.con.register("turns", turns)
            for seg, *path in self.con.execute(WALK).fetchall():
                out[seg].append(tuple(path))
            self.con.unregister("turns")
        for i, s in enumerate(segments):
            if not s:
                out[i] = [(e, e, 0, "") for e in STATES]
        return out


class Segment:
    """Rows of one stretch, in order, and what they count."""

    def __init__(self, head: tuple):
        self.head = head  # conversation, stretch, part
        self.kinds, self.roles, self.texts = [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.least = self.most = None

    def add(self, turn, role: str, text: str, repeated: bool, new_turn: bool) -> None:
        bare = text.strip(SPACE)
        fault = 0
        if not bare:
            self.blank, fault = self.blank + 1, 2
        elif repeated:
            self.duplicate, fault = self.duplicate + 1, 2
        elif not bare.endswith(ENDS):
            self.truncated, fault = self.truncated + 1, 1
        if self.roles:
            self.illegal += (self.roles[-1][:1] + role[:1]) not in LEGAL
        if turn is not None:
            self.turns += new_turn
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.kinds.append(kind_of(role[:1], fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, paths) -> dict:
        conv, span, part = self.head
        counts = {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most")}
        return {"conv": conv, "span": span, "part": part, **counts, "roles": self.roles, "texts": self.texts, "paths": [dict(zip(("entry", "state", "cost", "audit"), p, strict=True)) for p in paths]}


# Fixed value: the pairs of neighbours that the contract calls legal.
LEGAL = ("su", "ua", "au")


def segments(rows: Iterator[tuple]) -> Iterator[Segment]:
    """Cuts sorted rows (conv, span, turn, mark, role, text, digest, gone) into segments. Marks come
    before the rows of their turn and name the digests that an earlier turn has."""
    now, group, before, marked = None, None, None, set()
    for conv, span, turn, mark, role, text, digest, gone in rows:
        if group != (conv, span):
            if now:
                yield now
            group, before, marked, now = (conv, span), None, set(), Segment((conv, span, 0))
        if before is None or before[0] != turn:
            if before:
                marked = set()
            fresh = True
        else:
            fresh = before[3]
        if mark:
            marked.add(digest)
            before = (turn, None, None, fresh)
            continue
        if gone:
            continue
        if len(now.kinds) >= SEGMENT or now.chars > BATCH_CHARS:
            yield now
            now = Segment((conv, span, now.head[2] + 1))
        now.add(turn, role, text, digest in marked or before is not None and before[:3] == (turn, role, text), fresh)
        before = (turn, role, text, False)
    if now:
        yield now


def flat_rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            piece = batch.slice(lo, 256)
            yield from zip(*(piece.column(c).to_pylist() for c in ("conv", "span", "turn", "mark", "role", "text", "digest", "gone")), strict=True)


def solved(schema: pa.Schema):
    """A map stage: segments with the cheapest paths between all states."""

    def stage(batches):
        walker, held, rows, chars = Walker(), [], 0, 0

        def out():
            paths = walker.paths([s.kinds for s in held])
            return pa.RecordBatch.from_pylist([s.row(p) for s, p in zip(held, paths, strict=True)], schema)

        for segment in segments(flat_rows(batches)):
            held.append(segment)
            rows, chars = rows + len(segment.kinds), chars + segment.chars
            if rows >= BATCH_ROWS or chars >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                yield out()
                held, rows, chars = [], 0, 0
        if held:
            yield out()

    return stage


class Line:
    """What a conversation has cost and become, up to some segment, in one state. `order` ranks its
    audit among those of the other states; the audit is a chain of pieces, last first."""

    def __init__(self, cost: int = 0, order: int = 0, audit: tuple | None = None, digest=None):
        self.cost, self.order, self.audit = cost, order, audit
        self.digest = digest or hashlib.sha256()

    def write(self, state: int, lines: list[str]) -> None:
        if lines:
            self.digest.update((("\n" if state else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))

    def letters(self) -> str:
        pieces, at = [], self.audit
        while at:
            at, piece = at
            pieces.append(piece)
        return "".join(reversed(pieces))


def repaired(state: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """The lines that an audit makes of rows, beginning in a state."""
    lines, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        x = next(x for (p, x) in NEXT if p == state and x in ROLES) if letter in "IR" else roles[i][:1]
        state = NEXT[state, x]
        if letter == "I":
            lines.append(f"{WROTE[state]}:")
            continue
        lines.append(f"{WROTE[state] if letter == 'R' else roles[i]}:{texts[i]}")
        i += 1
    return lines


class Whole:
    """A conversation as its segments pass."""

    def __init__(self, conv):
        self.conv, self.lines = conv, {0: Line()}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.last = None

    def take(self, row: dict) -> None:
        for k in self.counts:
            self.counts[k] += row[k]
        if row["least"] is not None:
            self.least = row["least"] if self.least is None else self.least
            self.most = row["most"]
        if not row["roles"]:
            return
        if self.last is not None:
            self.counts["illegal"] += (self.last + row["roles"][0][:1]) not in LEGAL
        self.last = row["roles"][-1][:1]
        best: dict[int, tuple] = {}
        for path in row["paths"]:
            if path["entry"] in self.lines:
                line = self.lines[path["entry"]]
                key = (line.cost + path["cost"], line.order, path["audit"], path["entry"])
                best[path["state"]] = min(best.get(path["state"], key), key)
        ranked = sorted(best, key=lambda state: best[state][1:3])
        made = {}
        for state, (cost, _, audit, entry) in best.items():
            old = self.lines[entry]
            made[state] = Line(cost, ranked.index(state), (old.audit, audit), old.digest.copy())
            made[state].write(entry, repaired(entry, audit, row["roles"], row["texts"]))
        self.lines = made

    def result(self) -> tuple:
        for state, letters, lines in ((1, "II", ["user:", "assistant:"]), (2, "I", ["assistant:"])):
            if state in self.lines:
                line = self.lines[state]
                line.write(state, lines)
                line.cost, line.audit = line.cost + COST["I"] * len(letters), (line.audit, letters)
        best = min(self.lines.values(), key=lambda line: (line.cost, line.order))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.counts["turns"]
        counts = self.counts
        return self.conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], best.cost, best.letters(), best.digest.hexdigest()


def composed(schema: pa.Schema):
    """A map stage over sorted segments: one row a conversation."""

    def stage(batches):
        whole, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if whole is None or whole.conv != row["conv"]:
                    if whole:
                        done.append(whole.result())
                    whole = Whole(row["conv"])
                whole.take(row)
                if len(done) >= 1000:
                    yield _rows(done, schema)
                    done = []
        if whole:
            done.append(whole.result())
        if done:
            yield _rows(done, schema)

    return stage


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repairs(talks: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """Per conversation: its identifier, gaps, the faults blank, duplicate and truncated, illegal (pairs
    of neighbours), cost, audit (the edits) and repaired_sha256 (of the repaired rows, `role:text`, by
    lines). Rows where the boolean column `gone` holds count for nothing, but their conversation is listed."""
    spark = talks.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = F.col(gone) if gone else F.lit(False)
    rows = talks.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), out.alias("gone"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumn("span", F.shiftright("turn", SPAN.bit_length() - 1)).withColumn("digest", digest)
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    light = rows.where(~F.col("gone")).select("conv", "span", "turn", "digest")
    first = light.groupBy("conv", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "first")
    again = light.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).where(at > F.col("first")).select("conv", "span", "turn", "digest").distinct()
    text_part = rows.select("conv", "span", "turn", F.lit(False).alias("mark"), "role", "text", "digest", "gone")
    marks = again.select("conv", "span", "turn", F.lit(True).alias("mark"), F.lit("").alias("role"), F.lit("").alias("text"), "digest", F.lit(False).alias("gone"))
    parts = store.partitions(spark)
    dealt = text_part.union(marks).repartition(parts, "conv", "span").sortWithinPartitions("conv", "span", "turn", F.col("mark").desc(), "role", "text")
    kind = talks.schema[conv_id].dataType
    path = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("state", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
    strings = T.ArrayType(T.StringType())
    numbers = [T.StructField(c, T.LongType()) for c in ("span", "part", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most")]
    cut = T.StructType([T.StructField("conv", kind), *numbers, T.StructField("roles", strings), T.StructField("texts", strings), T.StructField("paths", path)])
    pieces = dealt.mapInArrow(store.lean(solved(_arrow(cut))), cut)
    last = T.StructType([T.StructField(conv_id, kind), *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    ordered = pieces.repartition(parts, "conv").sortWithinPartitions("conv", "span", "part")
    return ordered.mapInArrow(store.lean(composed(_arrow(last))), last)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damaged(talks: DataFrame) -> DataFrame:
    """The damage of the contract, by crc32 of `conv_id:turn` modulo 20: 0 the row is gone (column
    `gone`), 1 empty text, 2 text without its ends, 3 the row twice, 4 the role of a user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw: Column = (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).cast("int")
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(name("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))
    rows = talks.withColumn("draw", draw).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), F.explode(times).alias("copy"))
    return rows.drop("copy")
