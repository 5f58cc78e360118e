"""Secret scans with multipart credential linking.

Strong parts are the spans of three patterns: assigned secrets, access identifiers and long hex
runs. Weak parts are named identifiers (a user or client name), mixed tokens of 20 or more
characters and endpoints; alone they mean little. A scope is a paragraph, and within it `reach`
characters about a part. Parts of a document are sorted once and joined by interval: a weak
identifier is reported when a secret meets its scope, a weak secret when an identifier does, and an
endpoint when both do. Each part looks for its nearest complements only, so no pairs are listed.

The scan is one map stage: texts are not shuffled.

Edge cases: null and empty texts have no spans; positions are code points, ends exclusive; repeated
rows are each scanned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 160
# The base patterns of the contract, in the order in which kinds are listed.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = ("passw", "secret", "token", "api")

LINKED = ("name", "mixed", "endpoint")
NAME = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII | re.IGNORECASE)
NAMES = ("user", "login", "client", "account", "access")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""", re.ASCII)
ORDER = {k: i for i, k in enumerate(BASE + LINKED)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong parts, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


class Intervals:
    """Sorted parts that answer whether one of them meets an interval."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [s[0] for s in spans]
        self.ends, far = [], 0
        for s in spans:
            far = max(far, s[1])
            self.ends.append(far)

    def meets(self, lo: int, hi: int) -> bool:
        at = bisect_left(self.starts, hi)
        return at > 0 and self.ends[at - 1] > lo


def overlaps(spans, others: Intervals):
    return [s for s in spans if not others.meets(s[0], s[1])]


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak parts whose complements share their scope."""
    low = text.lower()
    strong_ids = [s for s in base if s[2] == "access"]
    names = [(m.start(1), m.end(1), "name") for m in NAME.finditer(text)] if any(k in low for k in NAMES) else []
    if not strong_ids and not names:
        return []
    taken = Intervals(base)
    names = overlaps(names, taken)
    mixed = overlaps([(m.start(), m.end(), "mixed") for m in MIXED.finditer(text)], Intervals(base + names))
    ids, secrets = Intervals(strong_ids + names), Intervals([s for s in base if s[2] != "access"] + mixed)
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]

    def scope(span) -> tuple[int, int]:
        lo = bisect_right(breaks, span[0])
        return max(span[0] - reach, breaks[lo - 1] if lo else 0), min(span[1] + reach, breaks[lo] if lo < len(breaks) else len(text))

    found = [s for s in names if secrets.meets(*scope(s))] + [s for s in mixed if ids.meets(*scope(s))]
    if ids.starts and secrets.starts:
        ends = overlaps([(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)], Intervals(base + names + mixed))
        found += [s for s in ends if ids.meets(*scope(s)) and secrets.meets(*scope(s))]
    return found


def scan(reach: int):
    """A map stage: the spans of each text."""

    def stage(batches):
        for batch in batches:
            kinds, starts, ends = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = base + linked_spans(text, base, reach)
                spans.sort(key=lambda s: (s[0], ORDER[s[2]]))
                kinds.append([s[2] for s in spans])
                starts.append([s[0] for s in spans])
                ends.append([s[1] for s in spans])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "kinds": pa.array(kinds, pa.list_(pa.string())), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))})

    return stage


def secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of docs: doc_id and found, an array of (kind, start, end) by start."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    spans = rows.mapInArrow(scan(reach), f"doc_id {kind}, kinds array<string>, starts array<long>, ends array<long>")
    return spans.select("doc_id", F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end")).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op4 from the operator's output."""
    listed = "array_join(transform(filter(found, s -> {}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "s.kind in ('assign', 'access', 'hex')"
    return found.select("doc_id", *(F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE), F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"), F.expr(listed.format("true")).alias("spans"))
