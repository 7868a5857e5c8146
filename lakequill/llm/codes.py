"""Vector codes: vectors cut into parts, each part replaced by the index of its nearest entry in a codebook that is learnt.

All arithmetic is on integers, floor(SCALE * x), so results don't depend on partitioning, order or reruns. A round assigns
every part of every row to its nearest entry and replaces entries by the floor of their parts' mean. Rows stay where they
are: a round is one scan, from which each task sends a sum and a count for each entry.

The nearest entry is found in a vantage-point tree for each part position. A node holds an entry and the least and greatest
distance from it to the entries of its two children. A row's distance to the node's entry and these radii bound its distance
to a child's entries from below (triangle inequality), and the child is visited unless that bound is above the best distance
so far. Square roots and radii are rounded to the safe side and the comparison isn't strict, so a child that could hold an
equally near entry of a lower index is visited; distances themselves are compared as exact integers. A batch goes through the
tree at once, as sets of rows.

Only codebooks are on the driver and in closures (PARTS * ENTRIES vectors), and PARTS * ENTRIES * (width + 1) sums a round.

Results for odd input: rows whose vector is null or has null or non-finite components are left out; the dimension is that of
the first kept row, and rows of another one have a null code and error; a dimension that PARTS doesn't divide is filled up
with zeros, which change no distance; rows of one vec_id are rows of their own, in the order of their vectors; null ids come
last; fewer than ENTRIES rows make fewer entries; equal entries give the lower index; null labels are one label; an error or
sum that no long holds is null; an empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that go through the trees at once.
TOGETHER = 16_384
#: Components below this have squared distances that doubles hold as exact integers; others are computed with Python's integers.
SAFE = 1 << 20
#: The widest parts for which that holds.
WIDEST = 1 << 10
#: Entries of a leaf of the tree, which are compared at once.
LEAF = 4
#: Bits of the parts in which sums are added up.
LIMB = 80
#: Relative slack of rounded square roots, some times their error.
SLACK = 2.0**-48
#: Rows of a label from which its sum is broadcast; at most so many of such labels are.
LARGE_LABEL, MOST_LARGE = 10_000, 100_000

_CODE, _CODE_ARROW = arrow_schema("vec_id long, label string, code string, error long")


@dataclass(frozen=True)
class Node:
    """Entries, and for each child the least and greatest squared distance from the first of them to the child's entries.

    A node with children has one entry; a leaf has up to LEAF, in order.
    """

    entries: tuple[int, ...]
    children: tuple[tuple[int, int, Node], ...] = ()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def build(entries: np.ndarray, own: list[int] | None = None) -> Node:
    """A vantage-point tree over entries: the nearer half in one child, the others in the second."""
    own = list(range(len(entries))) if own is None else own
    if len(own) <= LEAF:
        return Node(tuple(sorted(own)))
    first, rest = own[0], own[1:]
    far = sorted((int(d), i) for d, i in zip(squared(entries[rest], entries[first]), rest))
    halves = [h for h in (far[: (len(far) + 1) // 2], far[(len(far) + 1) // 2 :]) if h]
    return Node((first,), tuple((h[0][0], h[-1][0], build(entries, [i for _, i in h])) for h in halves))


def _roots(d: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Square roots that are surely not above, and not below, the true ones."""
    root = np.sqrt(np.asarray(d, float))
    return root * (1 - SLACK), root * (1 + SLACK)


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each row of x, ties to the lower index, and the distances computed."""

    def among(node: Node, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of a node's entries."""
        d = np.stack([squared(own, entries[e]) for e in node.entries], 1)
        place = d.argmin(1)  # the first of equal ones
        return np.array(node.entries)[place], np.take_along_axis(d, place[:, None], 1)[:, 0]

    index, best = among(tree, x)
    computed = len(x) * len(tree.entries)

    def visit(node: Node, rows: np.ndarray, own: np.ndarray, d: np.ndarray) -> None:
        """Goes on from a node whose squared distances d to rows have been counted."""
        nonlocal computed
        # what doubles can't hold is compared with all entries
        low, high = (np.zeros(len(d)), np.full(len(d), np.inf)) if d.dtype == object else _roots(d)
        bounds = []
        for least, most, child in node.children:
            if d.dtype == object:
                bounds.append((low, child))
                continue
            (inner, _), (_, outer) = _roots(least), _roots(most)
            bounds.append((np.maximum(np.maximum(low - outer, inner - high), 0.0), child))
        # rows go to the child of the lower bound first, which tightens what the other one is compared with
        turns = [(bounds[0], None)]
        if len(bounds) == 2:
            second_first = bounds[1][0] < bounds[0][0]
            turns = [(bounds[1], second_first), (bounds[0], None), (bounds[1], ~second_first)]
        for (bound, child), which in turns:
            on = np.ones(len(rows), bool) if d.dtype == object else bound * bound * (1 - SLACK) <= best[rows] * (1 + SLACK)
            if which is not None:
                on &= which
            if not on.any():
                continue
            at, near = (rows, own) if on.all() else (rows[on], own[on])
            which_entry, got = among(child, near)
            computed += len(at) * len(child.entries)
            so_far = best[at]
            better = np.asarray((got < so_far) | ((got == so_far) & (which_entry < index[at])), bool)
            best[at[better]], index[at[better]] = got[better], which_entry[better]
            if child.children:
                visit(child, at, near, got)

    if tree.children:
        visit(tree, np.arange(len(x)), x, best.copy())
    return index, best, computed


class Codebooks:
    """Entries of each part, as integers, with a tree over them."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries  # part, entry, component
        self.trees = [build(np.array(e, object)) if e else None for e in entries]
        self.width = len(entries[0][0]) if entries and entries[0] else 0
        self.large = self.width > WIDEST or any(abs(v) >= SAFE for part in entries for e in part for v in e)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of rows of integers: an array of (rows, parts) each."""
        code, error = np.zeros((len(x), PARTS), int), np.zeros((len(x), PARTS), x.dtype)
        for p in range(PARTS):
            own = np.ascontiguousarray(x[:, p * self.width : (p + 1) * self.width])
            code[:, p], error[:, p], _ = nearest(self.trees[p], np.array(self.entries[p], x.dtype).reshape(-1, self.width), own)
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def kept(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(vectors: np.ndarray, dim: int, large: bool) -> np.ndarray:
    """floor(SCALE * x) of rows of floats, filled up to whole parts: integers, in doubles where those are exact."""
    y = np.floor(vectors.astype(float) * SCALE)
    wide = -(-dim // PARTS) * PARTS
    if large or (len(y) and np.abs(y).max(initial=0) >= SAFE):
        out = np.zeros((len(y), wide), object)
        out[:, :dim] = [[int(v) * SCALE if abs(v) >= 1 << 53 else int(f) for v, f in zip(*both)] for both in zip(vectors.astype(float), y)]
    else:
        out = np.zeros((len(y), wide))
        out[:, :dim] = y
    return out


def _groups(batches: Iterator[pa.RecordBatch], dim: int, large: bool):
    """Record batches put together, with a mask of rows that are kept, one of those with the dimension, and their integers."""
    held: list[pa.RecordBatch] = []

    def ready():
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = whole.column("vector").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become not-a-number
        sizes = np.where(there, np.nan_to_num(size), 0).astype(int)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = there.copy()
        keep[owner[~np.isfinite(values)]] = False
        use = keep & (sizes == dim)
        return whole, keep, use, scaled(values[use[owner]].reshape(-1, dim) if dim else np.zeros((int(use.sum()), 0)), dim, large)

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= TOGETHER:
            yield ready()
            held, rows = [], 0
    if rows:
        yield ready()


def _limbs(v: int) -> list[tuple[int, int]]:
    """An integer of any size as parts of LIMB bits that add up: place and value of those that aren't 0."""
    sign, v, out, k = (-1 if v < 0 else 1), abs(v), [], 0
    while v:
        if low := v & ((1 << LIMB) - 1):
            out.append((k, sign * low))
        v, k = v >> LIMB, k + 1
    return out


def _refine(rows: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """One round: every part to its nearest entry, then entries to the floor of their parts' mean; unused ones stay."""
    k, w = len(books.entries[0]), books.width
    out = pa.schema([("slot", pa.int32()), ("limb", pa.int32()), ("total", pa.decimal128(38, 0))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, k, w + 1), object)
        for _, _, use, x in _groups(batches, dim, books.large):
            if not use.any():
                continue
            code, _ = books.assign(x)
            for p in range(PARTS):
                own = x[:, p * w : (p + 1) * w]
                for e in range(k):
                    on = code[:, p] == e
                    total[p, e, :w] += [int(v) for v in own[on].sum(axis=0)]
                    total[p, e, w] += int(on.sum())
        parts = [(slot, limb, v) for slot, whole in enumerate(total.reshape(-1)) for limb, v in _limbs(int(whole))]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in parts], kind) for c, kind in enumerate(out.types)], schema=out)

    got = rows.mapInArrow(sums, "slot int, limb int, total decimal(38,0)").groupBy("slot", "limb").agg(F.sum("total").alias("total"))
    flat = [0] * (PARTS * k * (w + 1))
    for r in got.collect():  # PARTS * ENTRIES * (width + 1) slots, nearly always of one limb
        flat[r["slot"]] += int(r["total"]) << (LIMB * r["limb"])
    new = []
    for p in range(PARTS):
        new.append([])
        for e in range(k):
            at = (p * k + e) * (w + 1)
            n = flat[at + w]
            new[p].append([v // n for v in flat[at : at + w]] if n else books.entries[p][e])
    return Codebooks(new)


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[Codebooks, int] | None:
    """Codebooks after so many rounds over all kept rows, and the dimension; None if no row is kept."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    good = rows.where(kept(F.col("vector")))
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["vector"])
    start = good.where(F.size("vector") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    wide = -(-dim // PARTS)
    x = scaled(np.array([r["vector"] for r in start], float).reshape(len(start), dim), dim, True)
    books = Codebooks([[[int(v) for v in x[e, p * wide : (p + 1) * wide]] for e in range(len(start))] for p in range(PARTS)])
    for _ in range(rounds):
        books = _refine(rows.select("vector"), books, dim)
    return books, dim


def encode(df: DataFrame, books: Codebooks, dim: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label as text, code and error of every kept row."""
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, keep, use, x in _groups(batches, dim, books.large):
            names, errors = np.full(len(use), None, object), np.full(len(use), None, object)
            if use.any():
                code, error = books.assign(x)
                names[use] = ["".join(r) for r in digits[code].tolist()]
                errors[use] = [int(e) if e < 1 << 63 else None for e in error.astype(object).sum(axis=1)]
            part = whole.filter(pa.array(keep))
            yield arrow_batch(_CODE_ARROW, *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in (part.column("vec_id"), part.column("label"))), names[keep].tolist(), errors[keep].tolist())

    own = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector"))
    return own.mapInArrow(run, _CODE)


def compress(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of df (vec_id, embedding, label).

    Errors are summed for each label before they are shuffled. The sums of labels with many rows are broadcast, so that no
    task gets all rows of one label.
    """
    spark = df.sparkSession
    learnt = train(df, rounds=rounds)
    if learnt is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books, dim = learnt
    coded = cut(encode(df, books, dim), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")
    per = cut(coded.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("m")), "labels")
    large = cut(per.where(F.col("m") >= LARGE_LABEL).orderBy(F.col("m").desc(), "label").limit(MOST_LARGE).select("label", "label_error"), "large-labels")
    small = per.join(F.broadcast(large), per["label"].eqNullSafe(large["label"]), "left_anti").select("label", "label_error")
    columns = ["c.vec_id", "c.code", "c.error", "l.label_error"]
    same = F.col("c.label").eqNullSafe(F.col("l.label"))
    c = coded.alias("c")
    rest = c.join(F.broadcast(large.alias("l")), same, "left_anti")
    out = c.join(F.broadcast(large.alias("l")), same).select(*columns).unionByName(rest.join(small.alias("l"), same).select(*columns))
    return out.withColumn("codebooks_sha256", F.lit(books.digest()))
