"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the spans of four patterns: e-mail addresses, IP addresses, payment cards and telephone
numbers. The words about a seed are a lexical pattern: its two words before, or the one before and the
one after. What stands in the same slot elsewhere, a token with a digit or an @ that no seed covers, is
an instance of the pattern. Patterns and instances make a graph that is scored in rounds: a pattern's
confidence is the score of its distinct instances by their number (plus PRIOR), an instance's score is
one less the product of what its confident patterns leave open. A token in the slot of a confident
pattern becomes a span of the kind `found_<kind>`.

Texts are read once. For each pattern a text is split into what lies between matches, so lengths give
the positions; matches, tokens and 64 characters about them go into a table, and all else works on it.
Edges are distinct (pattern, instance) pairs, summed before they are dealt, so a frequent pattern is
spread over its instances. Texts are not shuffled.

Edge cases: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows
are each scanned, and count once as instances; ties of kinds go to the first listed; an empty table gives
no rows; other columns are ignored. Tokens over LONGEST characters are no identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

# The base kinds of the contract, in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
#: Their patterns, with possessive repeats and starts that give the same matches in linear time.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
TOKEN = len(BASE)
_IN = r"""\x20\x09-\x0D:="'()<>\[\],;|"""
TOKENS = rf"(?<![^{_IN}])(?=[^{_IN}0-9@]*+[0-9@])[^{_IN}]++"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CONTEXT, LONGEST = 64, 64
ROUNDS, SEEDS, CONFIDENT, PRIOR = 3, 3, 0.7, 1.0


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern is one of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    card = F.when((count >= 13) & (count <= 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == 0, True).when(kind == 1, match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind == 2, card).when(kind == 3, (count >= 9) & (count <= 15)).otherwise(False)


def pieces(text: Column, kind: int, pattern: str, hint: Column) -> Column:
    """What lies before each match, and the match; one more for what lies after the last."""
    cut = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, m: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head"), m.alias("match")),
    )
    return F.when(hint & (F.size(cut) > 1), cut).otherwise(F.array().cast("array<struct<kind:int,gap:int,tail:string,head:string,match:string>>"))


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of seeds (kind 0 to 3) and free tokens (kind 4) with spans and the words about them; one
    row without a kind for each row of docs. `row` numbers the rows of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body = F.col("text")
    at, digit = F.instr(body, "@") > 0, body.rlike("[0-9]")
    hints = (at, digit, digit, F.instr(body, "+") > 0, at | digit)
    every = [pieces(body, k, p, h) for k, (p, h) in enumerate(zip((*PATTERNS, TOKENS), hints, strict=True))]
    none = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("gap"), F.lit("").alias("tail"), F.lit("").alias("head"), F.lit(None).cast("string").alias("match")))
    cut = rows.select("row", "doc_id", F.posexplode(F.flatten(F.array(none, *every)))).select("row", "doc_id", "pos", "col.*")
    core = F.regexp_replace(F.regexp_replace("match", r"^[^0-9A-Za-z+@]+", ""), r"(?<=[0-9A-Za-z])[^0-9A-Za-z]++$", "")
    value = F.when(F.col("kind") == TOKEN, core).otherwise(F.col("match"))
    keep = F.when(F.col("kind") == TOKEN, (F.length(core) <= LONGEST) & core.rlike("[0-9@]")).otherwise(valid(F.col("kind"), F.col("match")))
    keep = F.col("match").isNotNull() & F.coalesce(keep, F.lit(False))
    size = F.coalesce(F.length("match"), F.lit(0))
    cut = cut.select("row", "doc_id", "pos", "kind", "gap", "tail", "head", size.alias("size"), keep.alias("keep"), F.when(keep, value).alias("value"), F.when(keep & (F.col("kind") == TOKEN), F.length(F.regexp_extract("match", r"^[^0-9A-Za-z+@]+", 0))).otherwise(0).alias("skip"))
    order = Window.partitionBy("row", "kind").orderBy("pos")
    before = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("gap") + F.col("skip")
    dealt = cut.repartition(store.partitions(docs.sparkSession), "row").withColumn("start", before).withColumn("after", F.lead("head").over(order))
    spans = dealt.where("keep or kind is null").withColumn("end", F.col("start") + F.length("value"))
    seeds, line = F.col("kind") < TOKEN, Window.partitionBy("row").orderBy("start", "kind")
    over = F.coalesce(F.max(F.when(seeds, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    under = F.coalesce(F.min(F.when(seeds, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing)) < F.col("end"), F.lit(False))
    free = spans.withColumn("covered", (F.col("kind") == TOKEN) & (over | under)).where("covered is null or not covered")
    tame = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"[\x20\x09-\x0D]+", " ")), " ")
    words, more = tame(F.col("tail")), tame(F.col("after"))
    word = lambda ws, i: F.nullif(F.regexp_replace(F.try_element_at(ws, F.lit(i)), "[0-9]", "0"), F.lit(""))
    found, _ = store.materialise(free.select("row", "doc_id", "kind", "start", "end", F.lower("value").alias("instance"), word(words, -2).alias("w2"), word(words, -1).alias("w1"), word(more, 1).alias("r1")), "mentions")
    return found


def slots(found: DataFrame) -> DataFrame:
    """found, with `pattern`: a row for each lexical pattern about a mention."""
    before = F.concat_ws(" ", F.when(F.col("w2").isNotNull() & F.col("w1").isNotNull(), F.concat("w2", F.lit(" "), "w1", F.lit(" _"))))
    around = F.concat_ws(" ", F.when(F.col("w1").isNotNull() & F.col("r1").isNotNull(), F.concat("w1", F.lit(" _ "), "r1")))
    return found.where("kind is not null").withColumn("pattern", F.explode(F.array_distinct(F.array(before, around)))).where("pattern <> ''")


def score(kind: int) -> str:
    return f"s_{BASE[kind]}"


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confident: float = CONFIDENT, prior: float = PRIOR) -> DataFrame:
    """pattern and its confidence for each kind (c_email and so on), at least `confident` in one of them
    and held up by instances that score `seeds` in sum."""
    spark = found.sparkSession
    known = [F.max((F.col("kind") == k).cast("double")).alias(score(k)) for k in range(TOKEN)]
    edges, held = store.materialise(slots(found).groupBy("pattern", "instance").agg(*known), "edges")
    base = edges.groupBy("instance").agg(*(F.max(score(k)).alias(score(k)) for k in range(TOKEN)))
    scores, path = store.materialise(base, "scores")
    everything = F.greatest(*(F.col(score(k)) for k in range(TOKEN)))
    links = edges.select("pattern", "instance")
    for last in [False] * (rounds - 1) + [True]:
        sums = links.join(scores, "instance").groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(score(k)).alias(score(k)) for k in range(TOKEN)))
        trust = [F.when(F.col(score(k)) >= seeds, F.round(F.col(score(k)) / (F.col("n") + F.lit(prior)), 9)).otherwise(0.0).alias(f"c_{BASE[k]}") for k in range(TOKEN)]
        trusted = sums.select("pattern", *trust).where(F.greatest(*(F.col(f"c_{b}") for b in BASE)) >= confident)
        patterns, done = store.materialise(trusted, "patterns")
        store.drop_path(spark, path)
        if last:
            store.drop_path(spark, held)
            return patterns
        open_part = [F.when(F.col(f"c_{b}") >= confident, F.log1p(-F.col(f"c_{b}"))).otherwise(0.0) for b in BASE]
        raised = links.join(patterns, "pattern").groupBy("instance").agg(*(F.round(1 - F.exp(F.sum(o)), 9).alias(f"up_{b}") for o, b in zip(open_part, BASE, strict=True)))
        seen = edges.groupBy("instance").agg(*(F.max(score(k)).alias(score(k)) for k in range(TOKEN))).withColumn("seed", everything > 0)
        new = seen.join(raised, "instance", "left").select("instance", *(F.when(F.col("seed"), F.col(f"s_{b}")).otherwise(F.coalesce(f"up_{b}", F.lit(0.0))).alias(f"s_{b}") for b in BASE))
        scores, path = store.materialise(new, "scores")
        store.drop_path(spark, done)
    return None


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of docs: doc_id and spans, an array of (kind, start, end), base kinds first in the order
    of BASE, then `found_<kind>`, each by start. The options are those of confident_patterns()."""
    found = mentions(docs, doc_id, text)
    patterns = confident_patterns(found, **options)
    best = F.greatest(*(F.col(f"c_{b}") for b in BASE))
    which = F.coalesce(*(F.when(F.col(f"c_{b}") == best, F.struct(best.alias("c"), F.lit(-k).alias("k"))) for k, b in enumerate(BASE)))
    tokens = slots(found.where(F.col("kind") == TOKEN)).join(patterns, "pattern").groupBy("row", "doc_id", "start", "end").agg(F.max(which).alias("best"))
    new = tokens.select("row", "doc_id", (TOKEN - F.col("best.k")).alias("kind"), "start", "end")
    old = found.where(F.col("kind").isNull() | (F.col("kind") < TOKEN)).select("row", "doc_id", "kind", "start", "end")
    names = F.array(*(F.lit(n) for n in (*BASE, *(f"found_{b}" for b in BASE))))
    span = F.struct("kind", "start", "end")
    listed = old.union(new).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"))
    return listed.select(F.col("doc_id").alias(doc_id), F.transform("spans", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op12 from the operator's output."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *(F.size(of(b)).cast("long").alias(f"n_{b}") for b in BASE), F.sha2(text(of(*BASE)).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
