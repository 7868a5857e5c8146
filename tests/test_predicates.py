import pytest

from lakequill.operators import instructions, predicates


def test_rules_take_the_longest_operator():
    assert predicates.parse_rules("金额大于等于1000且状态不等于取消，城市包含青") == [
        {"col": "金额", "op": "gte", "v1": "1000", "v2": ""}, {"col": "状态", "op": "neq", "v1": "取消", "v2": ""}, {"col": "城市", "op": "contains", "v1": "青", "v2": ""},
    ]


def test_date_range_with_and_without_its_suffix():
    for text in ("日期在2024-01-01到2024-02-01之间", "日期从2024-01-01至2024-02-01"):
        assert predicates.parse_rules(text) == [{"col": "日期", "op": "between", "v1": "2024-01-01", "v2": "2024-02-01"}]


def test_what_isn_t_understood_gives_up():
    assert predicates.parse_rules("请随便看看") is None


def test_missing_column_passes_or_raises(spark):
    df = spark.range(3)
    cond = [[{"col": "zz", "op": "eq", "v1": "1"}]]
    assert df.where(predicates.any_of(df, cond)).count() == 3
    with pytest.raises(KeyError):
        predicates.any_of(df, cond, "error")


def test_header_comes_before_letters(spark):
    df = spark.createDataFrame([(1, 2)], "name int, score int")
    assert predicates.resolve_column(df, "score") == "score" and predicates.resolve_column(df, "B") == "score" and predicates.resolve_column(df, "1") == "name"


def test_non_numbers_never_meet_a_numeric_condition(spark):
    df = spark.createDataFrame([("x",), ("5",), (None,)], "v string")
    assert [r[0] for r in predicates.conditional_filter(df, "v", "!=4").collect()] == ["5"]


@pytest.mark.parametrize(
    "text,kind,parameters",
    [
        ("删除第三段", "delete_paragraph", {"position": "第三段"}),
        ("把甲方替换为乙方", "replace_text", {"old": "甲方", "new": "乙方"}),
        ("筛选成绩大于90的行", "conditional_filter", {"column": "成绩", "condition": ">90"}),
        ("将B2改为100", "edit_cell", {"cell": "B2", "value": "100"}),
    ],
)
def test_instructions(text, kind, parameters):
    op = instructions.parse(text)
    assert op.kind == kind and parameters.items() <= op.parameters.items()


def test_better_reading_wins():
    a, b = instructions.Operation("x", 0.6, {"p": 1, "q": 1}), instructions.Operation("y", 0.9, {"p": 2})
    got = instructions.merge(a, b)
    assert (got.kind, got.parameters) == ("y", {"p": 2, "q": 1})
