"""Keyword and vector search, fusion, reordering and answer scores.

Statistics and postings are tables; a query touches the postings of its own terms alone. The final steps work on tens
of candidates, so they end in TakeOrderedAndProject or in one small group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut

K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, tok, tf, dl."""
    words = docs.select(doc, tx.tokens(F.lower(F.col(text))).alias("toks"))
    return words.select(doc, F.size("toks").alias("dl"), F.explode("toks").alias("tok")).groupBy(doc, "tok").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """tok, df: each document gives a word once, and words are summed before they are shuffled."""
    return docs.select(F.explode(F.array_distinct(tx.tokens(F.lower(F.col(text))))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(doc, F.size(tx.tokens(F.lower(F.col(text)))).cast("bigint").alias("dl"))


def occurrences(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, doc: str, text: str, terms: Sequence[str]) -> DataFrame:
    """doc, score of every document, 0 for those without a term that tells documents apart.

    One pass over the texts: each row counts its own occurrences of the terms, so only terms' statistics are aggregated.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    words = docs.select(doc, tx.tokens(F.lower(F.col(text))).alias("__t"))
    counts = words.select(doc, F.size("__t").alias("dl"), *[occurrences(F.col("__t"), t).alias(f"tf{k}") for k, t in enumerate(terms)])
    counted = cut(counts, "term-counts")  # some numbers a document; the texts are read once, however often scores are used
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("bigint")).alias(f"df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(F.greatest(F.lit(1.0), (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)))
        tf = F.col(f"tf{k}")
        score = score + F.when(tf > 0, idf * tf / (K1 * (1 - B + B * F.col("dl") / F.col("avgdl")) + tf)).otherwise(0.0)
    return counted.crossJoin(F.broadcast(stats)).select(doc, score.alias("score"))  # stats is one row


def vector_topk(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 16) -> DataFrame:
    """The k nearest rows by squared distance, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = tx.squared_distance(tx.doubles(F.col(vector)), q)
    return df.select(key, d.alias("distance")).orderBy("distance", key).limit(k)


def rrf(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists of (key, score); lists are short, each is ranked in one sort."""
    parts = None
    for df in lists:
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key)))
        one = df.select(key, (1.0 / (k + rank)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.sum("part").alias("hybrid_score"))


def adaptive_weights(n_tokens: Column) -> tuple[Column, Column]:
    """Vector and keyword weights: long queries trust vectors."""
    long = n_tokens > 5
    return F.when(long, 0.7).otherwise(0.4), F.when(long, 0.3).otherwise(0.6)


def linear_fusion(df: DataFrame, vector_weight: Column, keyword_weight: Column) -> DataFrame:
    """Weighted sum of both scores, each scaled to 0..1 (1 if all are equal); candidates alone come in."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in ("vector_score", "bm25_score") for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        low, high = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low))

    got = df.crossJoin(F.broadcast(ends))
    return got.withColumn("hybrid_score", vector_weight * scaled("vector_score") + keyword_weight * scaled("bm25_score")).drop(*ends.columns)


def merge_candidates(vector: DataFrame, scores: DataFrame, key: str, top: int = 24) -> DataFrame:
    """Vector hits with their distance and all keyword scores, joined with the top keyword hits."""
    best = scores.orderBy(F.col("score").desc(), F.col(key)).limit(top)
    keys = vector.select(key).union(best.select(key)).distinct()
    got = keys.join(F.broadcast(vector), key, "left").join(scores, key, "left")
    return cut(got.select(key, "distance", F.when(F.col("distance").isNull(), 0.0).otherwise(tx.distance_score(F.col("distance"))).alias("vector_score"), F.coalesce("score", F.lit(0.0)).alias("bm25_score")), "candidates")  # some tens of rows, used by each list


def content_dedup(df: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """The best-ranked row of each stripped content; blank ones all stay. Digests are shuffled, not texts."""
    text = tx.strip(F.col(content))
    own = F.when(text == "", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).otherwise(F.md5(text))
    w = Window.partitionBy("__key").orderBy(*order)
    return df.withColumn("__key", own).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__key", "__rn")


def mmr(df: DataFrame, key: str, vector: str, query: Sequence[float], balance: float = 0.7) -> DataFrame:
    """Greedy order by relevance and novelty of a few candidates (those of one search, so one group): key, place."""
    import numpy as np

    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        v = np.array([np.asarray(x, float) for x in pdf[vector]])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(norm == 0, 1, norm)
        relevance, near = v @ q, np.zeros(len(v))
        left, out = list(range(len(v))), []
        while left:
            pick = max(left, key=lambda i: (round(balance * relevance[i] - (1 - balance) * near[i], 12), -i))
            sims = v @ v[pick]
            near = sims if not out else np.maximum(near, sims)
            out.append(pick)
            left.remove(pick)
        return pd.DataFrame({key: pdf[key].iloc[out].to_numpy(), "place": np.arange(1, len(out) + 1)})

    return df.select(key, vector).groupBy(F.lit(1).alias("__g")).applyInPandas(lambda pdf: order(pdf), f"{key} {df.schema[key].dataType.simpleString()}, place bigint")


def rerank(df: DataFrame, content: str, query_tokens: Sequence[str], k: int, scorer=None, order: str | None = None) -> DataFrame:
    """The k best rows by a scorer Column; the default is the overlap of words.

    No more than k rows pass as they are, in their order and with a null score. Ties, too, are in the order of the rows, or of
    the column ``order``.
    """
    score = scorer(F.col(content)) if scorer else tx.jaccard(F.array_distinct(tx.tokens(F.lower(F.col(content)))), F.array(*map(F.lit, query_tokens)))
    few = df.agg((F.count(F.lit(1)) <= k).alias("__few"))
    rows = df.withColumn("__place", F.col(order) if order else F.monotonically_increasing_id()).crossJoin(F.broadcast(few))
    rows = rows.withColumn("rerank_score", F.when(~F.col("__few"), score)).orderBy(F.col("rerank_score").desc_nulls_last(), "__place")
    return rows.drop("__place", "__few").limit(k)


def confidence(mean: Column, top: Column) -> Column:
    """Confidence of fused scores: 0.15 to 0.95; -1 if there are none."""
    s = F.greatest(mean, top * 0.9)
    return F.when(mean.isNull(), F.lit(-1.0)).otherwise(F.round(F.greatest(F.lit(0.15), F.least(F.lit(0.95), 0.15 + F.least(F.lit(1.0), s / 0.048) * 0.8)), 2))


def stream_confidence(mean: Column) -> Column:
    return F.round(F.least(mean * 1.2, F.lit(1.0)), 2)


def relative_relevance(df: DataFrame, score: str) -> DataFrame:
    """Whole percent of relevance within a result list: 36 to 94; where all scores are equal, by the score itself, 32 to 88."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    half_up = lambda x: F.floor(x + 0.5).cast("double")
    flat = F.least(F.lit(88.0), F.greatest(F.lit(32.0), half_up(F.col("__lo") * 1600)))
    pct = F.when(F.col("__hi") - F.col("__lo") < 1e-12, flat).otherwise(half_up(36 + 58 * (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))))
    return df.crossJoin(F.broadcast(ends)).withColumn("relevance", pct).drop("__lo", "__hi")


def context_budget(df: DataFrame, group: str, order: str, text: str, most: int, least_rest: int = 50) -> DataFrame:
    """Texts of a group in order while they fit a budget, 2 characters for each joint; the first that doesn't is cut."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text) + 2).over(w), F.lit(0))
    rest = F.lit(most) - F.col("__before")
    fits = F.length(text) + 2 <= rest
    rows = df.withColumn("__before", before).withColumn("__fits", fits)
    return rows.where(F.col("__fits") | (rest > least_rest)).withColumn("part", F.when(F.col("__fits"), F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), rest.cast("int")))).drop("__before", "__fits")
