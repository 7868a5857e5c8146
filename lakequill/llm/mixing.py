"""Mixing sources to target weights by pivotal dependent rounding.

Each document starts with the fraction of copies that its source needs, ``target / source_size``. The integral part is
certain. Fractions are rounded by duels: two documents exchange mass, measured in words, until the copies of one of
them are integral; which way is drawn so that expectations stay. The words of a source therefore stay what they were
until one fraction is left, which is drawn alone.

The duels form a tree: documents are dealt into bounded groups by source and hash, each group leaves one fractional
document, and these meet in groups again until each source has one. Large documents, of which a source has 2,000 at
most by their definition, go first, from the largest size class down; what the last draw of a class misses is spread
evenly over all that is smaller. That keeps expectations and leaves an error of a small document.

Equal rows are counted first and numbered from their count, so groups are bounded whatever the share of a source, an id
or a row, and no window or task gets all rows of one.

Results for odd input: a null source is a source of its own and comes last; null texts and texts without words have size
0 and give 0 words, long texts count whole; equal rows are drawn apart; sources without words have target 0; an empty
table gives an empty result; other columns may have any name and only tell rows apart. Draws are functions of a row's
values and the seed, so reruns agree however the rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType

from .common import WORD, cut, ranked

WEIGHTS = (5, 2, 1)
CAP = 3
#: Stands for a null id, so that ids stay whole numbers on their way through pandas.
NO_ID = -(2**63)
LEAF = 1024
#: Equal rows, or copies of a row, that one task makes at once.
CHUNK = 65_536
FAN = 64
#: A document is large above both these shares of its source's target and of its source's words.
LARGE_TARGET, LARGE_SOURCE = 0.001, 0.0005


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """A row for each source: source, source_size, target.

    Weights go to the sources by code point, null last, over and over. All targets sum to all words; a target stops at
    cap times its source's words and the excess goes to the others by weight, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_null", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit("")))
    per = ranked(per, ["_null", "_key"], "_rank").drop("_null", "_key")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = cut(per.withColumn("_w", weight).drop("_rank"), "sources")
    limit = F.lit(float(cap)) * F.col("source_size")
    total = per.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = 0.0
    while True:  # each turn finds the sources that the last level lifts above their limit
        above = F.col("_w") * F.lit(level) >= limit
        r = per.agg(F.sum(F.when(above, limit)).alias("full"), F.sum(F.when(~above, F.col("_w"))).alias("w")).first()
        if not r["w"]:
            break
        higher = max(0.0, total - (r["full"] or 0.0)) / r["w"]
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return per.select("source", "source_size", F.least(limit, F.col("_w") * F.lit(level)).alias("target"))


def _draw(key: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys (splitmix64)."""
    z = key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def duels(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions p of sizes in order; the result is 0 or 1 but for one place at most, which is returned (or -1).

    The sum of p * size stays as it was, but for rounding in the last bits.
    """
    out = np.zeros(len(p))
    held, x = -1, 0.0
    for i, (y, w, draw) in enumerate(zip(p.tolist(), size.tolist(), u.tolist())):
        if y <= 0.0 or y >= 1.0:
            out[i] = float(y >= 1.0)
            continue
        if held < 0:
            held, x, v = i, y, w
            continue
        up = min((1.0 - x) * v, y * w)  # mass that can go from the new one to the held one
        down = min(x * v, (1.0 - y) * w)
        move = up if draw * (up + down) < down else -down
        nx, ny = x + move / v, y - move / w
        held_done = nx <= 1e-12 or nx >= 1.0 - 1e-12
        new_done = ny <= 1e-12 or ny >= 1.0 - 1e-12
        if held_done:
            out[held] = float(nx > 0.5)
            held, x, v = (i, ny, w) if not new_done else (-1, 0.0, 0.0)
            if new_done:
                out[i] = float(ny > 0.5)
        elif new_done:
            out[i] = float(ny > 0.5)
            x = nx
        else:  # neither is integral to the last bit: the nearer one is
            near_held, near_new = min(nx, 1 - nx), min(ny, 1 - ny)
            if near_held <= near_new:
                out[held], held, x, v = float(nx > 0.5), i, ny, w
            else:
                out[i], x = float(ny > 0.5), nx
    if held >= 0:
        out[held] = x
    return out, held


_GROUP = "source string, doc_id long, size long, key long, row long, copies double, p double, open boolean"
_LARGE = "source string, doc_id long, size long, key long, row long, copies double"


def _large(pdf: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Rounds all large documents of a source, class by class; column left has the words of its other documents."""
    pdf = pdf.sort_values(["key", "doc_id", "size"], kind="stable").reset_index(drop=True)
    size, key = pdf["size"].to_numpy(np.float64), pdf["key"].to_numpy()
    target, rest = float(pdf["target"].iloc[0]), float(pdf["left"].iloc[0]) + size.sum()
    kind, copies, spent = np.floor(np.log2(size)), np.zeros(len(pdf)), 0.0
    for c in np.unique(kind)[::-1]:
        at = np.flatnonzero(kind == c)
        p = min(cap, max(0.0, (target - spent) / rest))
        frac, held = duels(np.full(len(at), p - np.floor(p)), size[at], _draw(key[at] ^ np.arange(len(at)), 1001))
        if held >= 0:
            frac[held] = float(_draw(key[at][held : held + 1], 1002)[0] < frac[held])
        copies[at] = np.floor(p) + frac
        spent += float((copies[at] * size[at]).sum())
        rest -= float(size[at].sum())
    return pd.DataFrame({"source": pdf["source"], "doc_id": pdf["doc_id"], "size": pdf["size"], "key": key, "row": pdf["row"], "copies": copies})


def _tree(pool: DataFrame, rows: int) -> DataFrame:
    """Rounds column p (whole copies plus fraction) of pool to copies, through a tree of groups."""
    groups = max(1, -(-rows // LEAF))

    def rounded(pdf: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "size"], kind="stable")
        u = _draw(pdf["key"].to_numpy() ^ np.arange(len(pdf)), level)
        whole = pdf["copies"].to_numpy(np.float64)
        frac, held = duels(pdf["p"].to_numpy(np.float64), pdf["size"].to_numpy(np.float64), u)
        is_open = np.zeros(len(pdf), bool)
        if held >= 0:
            if last:
                frac[held] = float(_draw(pdf["key"].to_numpy()[held : held + 1], 89)[0] < frac[held])
            else:
                is_open[held] = True
        fixed = np.where(is_open, whole, whole + frac)
        return pd.DataFrame({"source": pdf["source"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "size": pdf["size"].to_numpy(), "key": pdf["key"].to_numpy(), "row": pdf["row"].to_numpy(), "copies": fixed, "p": np.where(is_open, frac, 0.0), "open": is_open})

    def leaf(level: int, last: bool):
        return lambda pdf: rounded(pdf, level, last)

    state = pool.withColumn("copies", F.floor("p").cast("double")).withColumn("p", F.col("p") - F.floor("p")).withColumn("open", F.lit(True))
    done, level = [], 0
    while True:
        last = groups == 1
        dealt = state.withColumn("_g", F.pmod(F.col("key"), F.lit(groups)))
        after = cut(dealt.groupBy("source", "_g").applyInPandas(leaf(level, last), _GROUP), "duels")
        done.append(after.where("NOT open"))
        if last:
            break
        state, groups, level = after.where("open"), -(-groups // FAN), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("source", "doc_id", "size", "key", "row", "copies")


def repeated(df: DataFrame, times: Column, nth: str) -> DataFrame:
    """Each row of df so many times, numbered from 0 in column nth; CHUNK at once, and large numbers in several tasks."""
    many = df.withColumn(nth, times)
    few = many.where(F.col(nth).between(1, CHUNK)).withColumn(nth, F.explode(F.sequence(F.lit(0), F.col(nth) - 1)))
    many = many.where(F.col(nth) > CHUNK)
    if not many.limit(1).count():
        return few
    parts = many.select("*", F.posexplode(F.sequence(F.lit(0), F.col(nth) - 1, F.lit(CHUNK).cast("long"))).alias("__part", "__low")).repartition(F.col("__low"), F.col("__part"))
    parts = parts.withColumn(nth, F.explode(F.sequence(F.col("__low"), F.least(F.col("__low") + CHUNK, F.col(nth)) - 1)))
    return few.unionByName(parts.drop("__part", "__low"))


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, source, size, row (a hash that equal rows share) and key (a hash of each row's own), a row for each of docs."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row.alias("row"))
    per = cut(own.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("m")), "sizes")
    key = F.when(F.col("nth") == 0, F.col("row")).otherwise(F.xxhash64("row", "nth"))
    return repeated(per, F.col("m"), "nth").select("doc_id", "source", "size", "row", key.alias("key"))


def _mixed(docs: DataFrame, row: Column, weights: tuple[float, ...], cap: float) -> DataFrame:
    """doc_id, source, size, row, source_size, target and copies of each row of docs."""
    sizes = _rows(docs, row)
    goal = cut(targets(sizes, weights, cap), "targets")
    own = sizes.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select("a.*", "source_size", "target")
    is_large = (F.col("size") > F.col("target") * LARGE_TARGET) & (F.col("size") > F.col("source_size") * LARGE_SOURCE)
    own = own.where("size > 0").withColumn("large", is_large)
    counts = cut(own.groupBy("source", "large").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "counts")
    left = counts.where("NOT large").select("source", F.col("words").alias("left"))
    few = own.where("large").alias("a").join(left.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "a.doc_id", "a.size", "a.key", "a.row", "a.target", F.coalesce("b.left", F.lit(0)).alias("left"))
    parts = [cut(few.groupBy("source").applyInPandas(lambda pdf: _large(pdf, cap), _LARGE), "large")]
    rows = counts.where("NOT large").agg(F.sum("n")).first()[0] or 0
    if rows:
        spent = parts[0].groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("spent"))
        rate = left.alias("l").join(goal.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).join(spent.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")), "left")
        p = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("g.target") - F.coalesce("s.spent", F.lit(0.0))) / F.col("l.left")))
        rate = cut(rate.select(F.col("g.source").alias("source"), p.alias("p")), "rates")
        pool = own.where("NOT large").alias("b").join(rate.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source"))).select("b.source", "b.doc_id", "b.size", "b.key", "b.row", "r.p")
        parts.append(_tree(pool, rows))
    out = sizes.where("size = 0").select("source", "doc_id", "size", "key", "row", F.lit(0.0).alias("copies"))
    for q in parts:
        out = out.unionByName(q)
    return out.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.doc_id", "o.source", "o.size", "o.row", "g.source_size", "g.target", F.col("o.copies").cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 0) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns a row for each row of docs: doc_id, source, size, source_size, target, copies (whole, at most cap) and
    taken = copies * size. The words taken of each source are its target but for one small document.
    """
    got = _mixed(docs, _row_hash(docs, seed), weights, cap)
    return got.select(F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 0) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay, whatever their names.

    A row is matched to its copies by id, source, size and a hash of all its columns. Rows that agree in these
    share their copies: one of them stands for all. Texts are shuffled once.
    """
    row = _row_hash(docs, seed)
    taken = cut(_mixed(docs, row, weights, cap).groupBy("doc_id", "source", "size", "row").agg(F.sum("copies").alias("times"), F.count(F.lit(1)).alias("m")).where("times > 0"), "copies")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row.alias("row"))
    o, t = own.alias("o"), taken.alias("t")
    met = o.join(t, (F.col("o.row") == F.col("t.row")) & (F.col("o.doc_id") == F.col("t.doc_id")) & (F.col("o.size") == F.col("t.size")) & F.col("o.source").eqNullSafe(F.col("t.source")))
    met = met.select("o.whole", "o.doc_id", "o.source", "o.size", "o.row", "t.times", "t.m")
    out = met.where("m = 1").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    if taken.where("m > 1").limit(1).count():
        several = met.where("m > 1").dropDuplicates(["doc_id", "source", "size", "row"])
        out = out.unionByName(repeated(several, F.col("times"), "nth"), allowMissingColumns=True)
    return out.select("whole.*")


def _row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash that rows equal in all columns share, maps as their sorted entries and variants as text."""
    return F.xxhash64(F.lit(seed), *[_hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields])


def _hashable(c: Column, kind: DataType) -> Column:
    """A column as one that can be hashed and sorted, equal for equal values."""
    name = kind.simpleString()
    if name == "variant":
        return F.to_json(c)
    if "map<" not in name and "variant" not in name:
        return c
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _hashable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _hashable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[_hashable(c.getField(f.name), f.dataType).alias(f"_{k}") for k, f in enumerate(kind.fields)]))
