"""Deterministic quality scores of answers: query, answer, contexts, ground truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import jaccard, once, strip

CJK = r"\x{4e00}-\x{9fa5}"
#: Fixed word lists of the scores.
REFUSALS = ["无法回答", "不知道", "没有相关", "未提及", "不清楚"]
ASKING = ["什么", "多少", "怎样", "如何", "为什么", "哪个", "哪些", "什么时候", "哪里", "谁", "几个", "怎么样", "是否", "能否"]
FEATURES = ["签订", "合同", "协议", "公司", "付款", "有效", "签订日期", "金额", "日期", "期限", "服务", "甲方", "乙方", "人民币", "万元"]


def _in(text: Column, words: Column) -> Column:
    return F.filter(words, lambda w: F.contains(text, w))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def keywords(c: Column) -> Column:
    return F.array_distinct(_all(c, f"[{CJK}a-zA-Z0-9]{{2,}}"))


def bigrams(c: Column) -> Column:
    t = F.regexp_replace(c, f"[^{CJK}a-zA-Z0-9]", "")
    return F.array_distinct(F.regexp_extract_all(t, F.lit("(?=(..))"), F.lit(1)))


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of an answer's facts, of which half the keywords occur in the context."""
    facts = F.filter(F.transform(F.split(answer, "[。！？\n]"), strip), lambda x: F.length(x) > 5)

    def supported(fact: Column) -> Column:
        return once(_all(fact, f"[{CJK}]{{2,}}|[0-9]+"), lambda words: (F.size(words) > 0) & (F.size(_in(context, words)) * 2 >= F.size(words)))

    got = once(facts, lambda x: F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.filter(x, supported)) / F.size(x)))
    return F.round(F.when((answer == "") | (context == ""), F.lit(0.0)).otherwise(got), 3)


# Fixed values of the scores: shares 0.3, 0.2 and 0.5; 0.6 and 0.05 a mark up to 0.95; 0.7, 0.2 and 0.1.


def relevancy(query: Column, answer: Column) -> Column:
    entities = F.filter(_all(answer, f"[{CJK}]{{3,20}}|[0-9]+\\.?[0-9]*[万千百亿]*|[a-zA-Z]+"), lambda x: F.length(x) >= 2)
    entity = F.least(F.size(entities) / 3, F.lit(1.0))
    score = jaccard(keywords(query), keywords(answer)) * 0.3 + jaccard(bigrams(query), bigrams(answer)) * 0.2 + entity * 0.5
    refused = F.size(_in(answer, F.array(*map(F.lit, REFUSALS)))) > 0
    return F.round(F.when((query == "") | (answer == "") | refused | (F.length(answer) < 5), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0))), 3)


def precision(query: Column, context: Column) -> Column:
    words = F.filter(_all(query, f"[{CJK}]{{2,8}}"), lambda w: ~w.isin(ASKING))
    rate = once(words, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(_in(context, x)) / F.size(x)))
    marks = F.size(_in(context, F.array(*map(F.lit, FEATURES))))
    loose = once(marks, lambda n: F.when(n > 0, F.least(0.6 + n * 0.05, F.lit(0.95))).otherwise(F.lit(0.0)))
    return F.round(F.when((query == "") | (F.length(context) < 10), F.lit(0.0)).otherwise(once(rate, lambda x: F.when(x >= 0.5, x).otherwise(loose))), 3)


def recall(answer: Column, context: Column, truth: Column) -> Column:
    """Share of the numbers and the first ten longer words of the truth that occur in the context."""
    reference = F.when(F.coalesce(truth, F.lit("")) != "", truth).otherwise(answer)
    words = F.filter(_all(reference, f"[{CJK}]{{2,4}}"), lambda w: F.length(w) >= 3)
    wanted = F.concat(_all(reference, r"[0-9]+\.?[0-9]*[万千百亿]?"), F.slice(words, 1, 10))
    got = once(wanted, lambda x: F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(_in(context, x)) / F.size(x)))
    return F.round(F.when(answer == "", F.lit(0.0)).otherwise(got), 3)


def keyword_hit(answer: Column, expected: Column, n_sources: Column, confidence: Column) -> Column:
    hit = F.size(_in(answer, expected)) / F.size(expected)
    return F.round(hit * 0.7 + F.when(n_sources > 0, 0.2).otherwise(0.0) + F.when(confidence >= 0, 0.1).otherwise(0.0), 3)
