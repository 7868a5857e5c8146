"""Conditions as rows against conditions as Columns, and change sets."""

import random

import pytest

from lakequill.operators import changes, predicates, rules

ROWS = [(i, random.Random(i).choice(["a", "b", "", None, "a b"]), random.Random(i + 99).choice(["1", "20", "3.5", "x", None, " 7 "]), f"2024-0{1 + i % 9}-1{i % 10}") for i in range(60)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k bigint, name string, amount string, signed_on string").cache()


def drawn(seed):
    r = random.Random(seed)
    out = []
    for tbl in range(40):
        for grp in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 3)):
                col = r.choice(["name", "amount", "signed", "nowhere"])
                op = r.choice(["eq", "neq", "contains", "not_contains", "gt", "lt", "gte", "lte", "between", "empty", "not_empty"])
                v1, v2 = r.choice(["a", "1", "2,0", "2024-03-01", "", "junk"]), r.choice(["5", "2024-06-30", "", "50"])
                out.append((tbl, grp, col, op, v1, v2))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_rules_keep_what_columns_keep(spark, df, seed):
    made = drawn(seed)
    got = {tuple(r) for r in rules.matches(df, "k", spark.createDataFrame(made, "tbl bigint, grp bigint, col string, op string, v1 string, v2 string")).collect()}
    want = set()
    for tbl in range(40):
        groups = {}
        for t, grp, col, op, v1, v2 in made:
            if t == tbl:
                groups.setdefault(grp, []).append({"col": col, "op": op, "v1": v1, "v2": v2})
        want |= {(tbl, r["k"]) for r in df.where(predicates.any_of(df, list(groups.values()))).select("k").collect()}
    assert got == want


def test_hundreds_of_tables_are_one_plan(spark, df):
    made = [(t, 1, "name", "eq", "a", None) for t in range(300)] + [(t, 2, "amount", "gt", str(t), None) for t in range(300)]
    found = rules.matches(df, "k", spark.createDataFrame(made, "tbl bigint, grp bigint, col string, op string, v1 string, v2 string"))
    assert found.where("tbl = 299").count() == sum(r[1] == "a" for r in ROWS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 6


def test_tables_without_rows_take_all(spark, df):
    made = spark.createDataFrame([(1, 1, "name", "eq", "b", None), (2, 1, "name", "eq", "none such", None)], "tbl bigint, grp bigint, col string, op string, v1 string, v2 string")
    heads = spark.createDataFrame([(t, 1, "K") for t in (1, 2, 3)] + [(1, 2, "A mount")], "tbl bigint, col bigint, header string")
    got = {(r["tbl"], r["col"], r["place"]): r["value"] for r in rules.fill_tables(df, "k", made, heads, 3).collect()}
    own = [str(r[0]) for r in ROWS if r[1] == "b"][:3]
    assert [got[1, 1, p] for p in range(1, len(own) + 1)] == own and got[2, 1, 1] == got[3, 1, 1] == "0" and got[3, 1, 3] == "2"
    amounts = [r[2].strip() for r in ROWS if r[1] == "b" and r[2]]
    assert [got[1, 2, p] for p in range(1, min(3, len(amounts)) + 1)] == amounts[:3]


def test_changes_are_previewed_and_stale_ones_refused(spark):
    ddl = "k bigint, n int, s string"
    before = spark.createDataFrame([(1, 1, "a"), (2, 2, None), (3, 3, "c"), (4, 4, "d")], ddl)
    after = spark.createDataFrame([(1, 10, "a"), (2, 2, "new"), (3, None, "c"), (9, 1, "x")], ddl)
    seen = changes.preview(before, after, "k")
    assert sorted(map(tuple, seen.collect())) == [(1, "n", "1", "10"), (2, "s", None, "new"), (3, "n", "3", None)]
    now = spark.createDataFrame([(1, 5, "a"), (2, 2, None), (3, 3, "z")], ddl)
    once = changes.apply(now, seen, "k")
    assert sorted(map(tuple, once.collect())) == [(1, 5, "a"), (2, 2, "new"), (3, None, "z")]
    assert sorted(map(tuple, changes.apply(once, seen, "k").collect())) == sorted(map(tuple, once.collect()))
    extra = seen.union(spark.createDataFrame([(7, "n", "1", "2"), (2, "s", None, "other")], "k bigint, field string, old string, new string"))
    told = {(r["k"], r["field"], r["new"]): r["outcome"] for r in changes.outcome(now, extra, "k").collect()}
    assert told == {(1, "n", "10"): "stale", (2, "s", "new"): "stale", (2, "s", "other"): "stale", (3, "n", None): "applied", (7, "n", "2"): "missing"}
    assert {r["outcome"] for r in changes.outcome(once, seen, "k").collect()} == {"stale", "done"}
    assert changes.apply(now, seen.limit(0), "k").schema == now.schema
