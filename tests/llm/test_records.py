"""Conversation repair, personal data and the Merkle manifest against plain versions."""

import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import cases, plain
from panelspark.llm import dialogue, merkle, oracles, pii, queries

DIR = "/root/testdata/sf0.001"
TALKS = "conv_id long, turn long, role string, text string, pos string, best string, span string, conv string"


def talks(seed=3, count=160):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(count)]:
        for t in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([None, t, t, t, t, t + 3, -t]), rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(["a.", "b!", "c?", "d", "", " \t", None, "e. ", "é long text here.", "q\n."])))
    return rows + rows[:40]


def found_repairs(spark, rows):
    table = spark.createDataFrame([(*r, "p", "b", "s", "c") for r in rows], TALKS).repartition(3)
    return sorted((tuple(r) for r in dialogue.repairs(dialogue.damaged(table), gone="gone").collect()), key=str)


@pytest.mark.parametrize(("span", "segment"), [(256, 512), (2, 512), (4, 2)])
def test_repairs(spark, monkeypatch, span, segment):
    monkeypatch.setattr(dialogue, "SPAN", span)
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    assert found_repairs(spark, talks()) == sorted(plain.repairs(talks()), key=str)


def test_repairs_of_a_long_conversation_and_texts(spark):
    """Thousands of turns in many segments, a text over 1 MB, many rows of one turn."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["yes.", "no", f"turn {t}."])) for t in range(3000)]
    rows += [(2, 0, "user", "é" * 1_200_000 + "."), (2, 1, "assistant", "x" * 1_100_000)]
    rows += [(3, None, "user", f"{i % 50}.") for i in range(1500)]
    got = {r[0]: r for r in found_repairs(spark, rows)}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows[3000:])
    want = {r["conv_id"]: tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in con.execute(oracles.REPAIRS).df().to_dict("records")}
    assert got[2] == want[2] and got[3] == want[3]
    kinds = [k for k in (plain.damaged([r]).get(1) for r in rows[:3000])]
    assert len(got[1][7].replace("I", "")) == sum(map(len, kinds))


def test_walks_compose(spark):
    """Paths of a segment are those of its two halves, put together."""
    walker, rng = dialogue.Walker(), random.Random(2)
    whole = [rng.randrange(12) for _ in range(40)]
    one, two, both = walker.paths([whole[:17], whole[17:], whole])
    best = {}
    for entry, middle, cost, audit in one:
        for begin, state, more, rest in two:
            if begin == middle:
                key = (cost + more, audit + rest)
                best[entry, state] = min(best.get((entry, state), key), key)
    assert {(e, s): (c, a) for e, s, c, a in both} == best


def test_empty_tables(spark):
    assert found_repairs(spark, []) == []
    empty = cases.table(spark, [])
    assert pii.personal_data(empty).collect() == [] and merkle.manifest(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 60])
def test_manifest(spark, n):
    data = [(None, None, None, None, None, *"nskt0t"), *cases.rows()][:n]
    docs = cases.table(spark, data).repartition(3)
    got = [tuple(r) for r in merkle.manifest(docs, altered=merkle.lowered(docs)).collect()]
    assert sorted(got, key=str) == sorted(plain.manifest([r.asDict() for r in docs.collect()]), key=str)


def test_manifest_of_many_groups_and_long_texts(spark):
    data = [(i, "A" * 1_100_000 if i == 5 else f"Text {i}", f"l{i % 90}", "s", i, *"nskt0t") for i in range(700)]
    docs = cases.table(spark, data)
    got = [tuple(r) for r in merkle.manifest(docs, altered=merkle.lowered(docs)).collect()]
    assert sorted(got) == sorted(plain.manifest([r.asDict() for r in docs.collect()]))
    assert not all(r[-1] for r in got) and all(r[-1] for r in (tuple(r) for r in merkle.manifest(docs).collect()))


def personal_rows():
    rng = random.Random(5)
    letters = "ab1.9@-+ 0(5)\n_%2é:"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(2, "1.2.3.4.5.6.7.8 a@b.c_d@e.f x@y..z 300.1.1.1 0001.2.3.4"), (3, "4111 1111 1111 1111 and 4111-1111-1111-1112"), (3, "\U0001f600 a@b.co \U0001f600 +1 (377) 555-0271")]
    rows += [(1000 + i, f"Please call me at +1 (377) 555-02{i:02d} today") for i in range(12)] + [(1100 + i, f"my card no: {c} expires 1{i}/30") for i, c in enumerate(["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4000056655665556"])]
    rows += [(2000, "please call me at 555-0199 today."), (2001, "then we saw 555-0199 somewhere"), (2002, "My card  no: 4111-XXXX-99 expires 12/30"), (2003, "ask about 555-0199 or"), (2003, "ask about 555-0199 or")]
    return rows + [(None, None), (1, "")]


def test_personal_data(spark):
    rows = personal_rows()
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id long, text string, row int, value string").repartition(3)
    got = Counter((r["doc_id"], str([tuple(s) for s in r["spans"]])) for r in pii.personal_data(docs).collect())
    added = plain.found([t for _, t in rows])
    assert got == Counter((k, str(plain.personal(t) + more)) for (k, t), more in zip(rows, added, strict=True))
    assert {s[0] for more in added for s in more} == {"found_phone", "found_card"}


def test_personal_data_in_long_texts(spark):
    rows = [(1, "x" * 1_200_000), (2, "1 " * 20000), (3, "a@b" + ".c" * 20000), (4, "+" + "(" * 50000), (5, "a" * 600_000 + "@b.c " + "9" * 600_000), (6, "me@x.org, " * 20000)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[4] == [] and got[3] == [("email", 0, 40003)] and got[5] == [("email", 0, 600004)]
    assert got[6] == [("email", i, i + 8) for i in range(0, 200_000, 10)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab1.@-+ _%9", max_size=40))
def test_linear_patterns_match_alike(text):
    """The possessive forms find what the plain ones find; Python has both."""
    import re

    for kind, fast in zip(plain.PERSONAL, pii.PATTERNS, strict=True):
        if "\\G" not in fast:
            assert [m.span() for m in re.finditer(fast, text)] == [m.span() for m in re.finditer(plain.PERSONAL[kind], text)]


@pytest.mark.parametrize("name", ["op11_talk_repair", "op12_context_pii", "op13_merkle_manifest"])
def test_queries_of_the_given_tables(spark, name):
    got = queries.queries()[name](spark, DIR)
    con = duckdb.connect()
    if name in oracles.SQL:
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        want = con.execute(oracles.SQL[name]).df()
        assert sorted(map(str, got.toPandas()[sorted(got.columns)].values.tolist())) == sorted(map(str, want[sorted(got.columns)].values.tolist()))
    else:
        texts = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()}
        added = dict(zip(texts, plain.found(list(texts.values())), strict=True))
        assert {r["doc_id"]: r["spans"] for r in got.collect()} == {k: ",".join(f"{a}:{b}:{c}" for a, b, c in plain.personal(t) + added[k]) for k, t in texts.items()}


def test_personal_data_stays_in_the_jvm(spark):
    plan = pii.personal_data(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
