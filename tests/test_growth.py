"""Steps whose work must grow no faster than their rows, and stay dealt out."""

import pandas as pd
from pyspark.sql import functions as F

from lakequill.functions import text as tx
from lakequill.operators import evaluation
from lakequill.plans import fixtures


def test_a_text_s_pairs_are_cut_once(spark):
    rows = spark.createDataFrame([("合同 金额 ab", "金额ab c"), ("x", None)], "a string, b string")
    got = rows.select(tx.jaccard(evaluation.bigrams(F.col("a")), evaluation.bigrams(F.col("b"))).alias("s"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    assert got.first()["s"] == 3 / 6


def test_cases_of_a_table_in_one_block_are_dealt_out(spark, tmp_path):
    pd.DataFrame({"c_custkey": range(45_000)}).to_parquet(tmp_path / "customer.parquet", row_group_size=1 << 20)
    cases = fixtures.spread(spark, str(tmp_path), "steps")
    per = [r["n"] for r in cases.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per) == 5 * 45_000 and max(per) <= 5 * 15_000


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_workbooks_are_made_and_read_once(spark, data_dir):
    from lakequill.plans import files

    assert _plan(files.workbook_blank_templates(spark, data_dir)).count("MapInPandas") == 2
    for query in (files.workbook_line_chunks, files.workbook_table_chunks):
        assert _plan(query(spark, data_dir)).count("MapInPandas") == 1


def test_large_tables_are_many_documents(spark, tmp_path):
    from lakequill.plans import files

    rows = pd.DataFrame({"p_partkey": range(2_500), "p_brand": "b", "p_type": "t", "p_size": 7})
    rows.to_parquet(tmp_path / "part.parquet")
    assert files._part_documents(spark, str(tmp_path)).count() == 3
    got = files.document_table_frames(spark, str(tmp_path)).toPandas().sort_values("row")
    assert list(got["row"]) == list(range(1, 2_501)) and set(got["path"]) == {"7"} and set(got["brand"]) == {"b"}


def test_a_common_value_doesn_t_lead_a_group_with_a_range(spark):
    from lakequill.operators import rules

    rows = spark.createDataFrame([(k, str(k), "urgent") for k in range(400)] + [(900, None, "urgent"), (901, "x", "urgent")], "k bigint, who string, p string")
    own = [(t, 1, c, op, v1, v2) for t in range(0, 400, 20) for c, op, v1, v2 in (("p", "eq", "urgent", ""), ("who", "between", str(t), f"{t + 3}.0"))]
    own += [(-1, 1, "who", "between", "1,0", "-5"), (-2, 1, "who", "between", "-1e20", "2"), (-3, 1, "who", "between", "x", "3"), (-4, 1, "who", "between", "0", "1e14")]
    got = rules.matches(rows, "k", spark.createDataFrame(own, "tbl bigint, grp int, col string, op string, v1 string, v2 string"))
    want = {(t, k) for t in range(0, 400, 20) for k in range(t, min(t + 4, 400))} | {(-2, 0), (-2, 1), (-2, 2)} | {(-3, k) for k in [*range(400), 900, 901]} | {(-4, k) for k in range(400)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "minby" in _plan(got).lower().replace("_", "")  # the rarest of a group's rules leads


def test_names_of_many_templates_aren_t_paired(spark):
    import random

    from lakequill.operators import tables

    random.seed(3)
    name = lambda: "".join(random.choices("ab_ B", k=random.randint(0, 5)))
    heads, fields = [*{name() for _ in range(60)}, None, "zz"], [*[name() for _ in range(40)], None]
    norm = lambda s: s.lower().translate({ord(c): None for c in " _/\\"})
    want = []
    for h in heads:
        score = lambda f: 0 if h is None or f is None else 3 if norm(h) == norm(f) else 2 if norm(h) in norm(f) else 1 if norm(f) in norm(h) else 0  # noqa: B023, E731
        best = min(((-score(f), len(f or ""), f) for f in fields if score(f)), default=(0, 0, None))
        want.append((h, best[2], -best[0]))
    got = tables.fuzzy_match(spark.createDataFrame([(h,) for h in heads], "header string"), spark.createDataFrame([(f,) for f in fields], "field string"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_column_of_all_sheets(spark, data_dir):
    from lakequill.plans import catalog

    assert catalog.extract_column(spark, data_dir).count() == 4 * 150  # sheet s1 has three filled cells, s2 one


def test_overlaps_are_computed_once_for_names_and_fields_of_the_same_characters(spark):
    from lakequill.operators import tables

    names, fields = ["ab_1", "ba_1", "ab_1", None, "é猫", "a😀"], ["aab", "aba", "1", "猫a", "aab", "😀x"]
    got = tables.overlap_pairs(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(f,) for f in fields], "field string"))
    want = [(n, f, sum(c in (n or "") for c in f) / len(f)) for n in names for f in fields]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = _plan(got)
    assert plan.index("Generate explode") < plan.index("Join Cross")  # members come after the shares


def test_terms_of_a_text_are_counted_without_a_shuffle(spark, tmp_path):
    from lakequill.stores.postings import KeywordIndex

    docs = spark.createDataFrame([(1, 7, "Red red blue 猫猫"), (2, 7, None), (3, 8, "  "), (4, 8, "blue x1")], "id long, file_id long, text string")
    rows = KeywordIndex(spark, f"file://{tmp_path}/index", id_type="bigint")._rows(docs, 4, 8)
    postings = rows.where("kind = 'posting'")
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["term"]): (r["tf"], r["dl"]) for r in postings.collect()}
    assert got[1, "red"] == (2, 4) and got[1, "blue"] == (1, 4) and got[4, "x1"] == (1, 2) and {i for i, _ in got} == {1, 4}


def test_conflicts_of_answers_read_each_text_once(spark, data_dir):
    from lakequill.operators import conflicts
    from lakequill.plans import catalog, fixtures

    for query in (catalog.conflicts_money, catalog.conflicts_company, catalog.conflicts_dates):
        plan = _plan(query(spark, data_dir))
        assert plan.count("Relation") == (3 if query is catalog.conflicts_dates else 1) and "Join" not in plan
    own = fixtures.inline(spark, "chunks")
    for kind in (conflicts.money, conflicts.dates, conflicts.ratios, conflicts.companies):
        one = kind(own.withColumn("g", F.lit(1)), ["g"]).drop("g")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, kind(own).collect()))


def test_signs_are_in_all_matches(spark):
    from lakequill.operators import conflicts

    rows = [("k", "f", t) for t in ("9 万元 3元 ¥ 7 人民币8", "人民币 5元", "¥6", "1% 2.5 %", "甲乙丙丁公司 某某贸易 某某科技", "2024年1月2日", "2024-01-02 2024/1/2", "1234 x", "", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, content string")
    for patterns in (conflicts.MONEY, conflicts.RATIO, conflicts.COMPANY, *[(f"({p})",) for _, p in conflicts.DATES]):
        plain = chunks.select(F.explode(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))).alias("value"))
        want = sorted(r["value"].strip() for r in plain.collect())
        assert want and sorted(r["value"] for r in conflicts.values(chunks, patterns, 0, "k").collect()) == want


def test_tasks_of_table_steps_are_bounded(spark):
    from lakequill.operators import extras, tables

    n = 250_000
    rows = spark.range(n)
    items = rows.selectExpr("id AS doc", "0 AS pos", "'table' AS kind", "'x' AS text")
    people = rows.selectExpr("id AS ord", "concat('n', id) AS name", "'c' AS city")
    fields = rows.selectExpr("concat('n', id) AS field")
    for got in (extras.table_descriptions(items, "doc", "pos"), tables.keep_fullest(people, "name", "ord"), tables.match_fields(fields, people.select("ord", "name"))):
        per = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(per) == n and max(per) <= 100_000
    cells = rows.selectExpr("concat('s', id) AS sheet", "1 AS row", "1 AS col", "'v' AS value")
    got = tables.header_row(cells, 1)
    assert tuple(got.first()) == ("s0", 1, 1) and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_in_conflict_are_not_sent_to_all_tasks(spark, data_dir):
    from lakequill.plans import catalog

    plan = catalog.conflict_annotate(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_names_of_all_customers_are_not_sent_to_all_tasks(spark, data_dir):
    from lakequill.operators import tables
    from lakequill.plans import catalog

    plan = catalog.fuzzy_field_match(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    heads, fields = spark.createDataFrame([(x,) for x in ("", " ", "é猫", "猫x", "b", None)], "header string"), spark.createDataFrame([(x,) for x in ("_", "猫", "猫X", "aé猫")], "field string")
    got = {r["header"]: (r["field"], r["score"]) for r in tables.fuzzy_match(heads, fields).collect()}
    assert got == {"": ("_", 3), " ": ("_", 3), "é猫": ("aé猫", 2), "猫x": ("猫X", 3), "b": ("_", 1), None: (None, 0)}
    assert tables.fuzzy_match(heads, fields.limit(0)).where("score = 0 AND field IS NULL").count() == 6
    assert tables.fuzzy_match(heads.limit(0), fields).count() == 0


def test_rules_of_all_tables_are_not_sent_to_all_tasks(spark, data_dir, monkeypatch):
    from lakequill.operators import rules
    from lakequill.plans import stored

    got = stored.fill_many_tables(spark, data_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and plan.count("BroadcastExchange") <= 3  # names of columns (twice) and the head that tables without rows take
    assert "BroadcastHashJoin" not in _plan(stored.rules_of_tables(spark, data_dir)) and "SortMergeJoin" in stored.rules_of_tables(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(k, str(k % 3)) for k in range(6)], "k bigint, who string")
    own = spark.createDataFrame([(t, 1, "who", "neq", str(t % 3), "") for t in range(5)], "tbl bigint, grp int, col string, op string, v1 string, v2 string")
    want = [(t, k) for t in range(5) for k in range(6) if k % 3 != t % 3]
    assert sorted(map(tuple, rules.matches(rows, "k", own).collect())) == want
    monkeypatch.setattr(rules, "SENT", 2)  # many such groups are dealt out
    many = rules.matches(rows, "k", own)
    assert "CartesianProduct" in many._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, many.collect())) == want
