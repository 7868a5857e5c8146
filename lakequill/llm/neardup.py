"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct shingles of WORDS words. Its sketch is the KEEP lowest hashes of that set. Rows with the
same words in the same order, by a cryptographic digest, are one class from the start, so groups of exact copies cost a
row each. Classes whose sets seem equal are linked once their full sets confirm it, and one of them goes on as the node of
that set. For the nodes, inverted lists of retained values give overlaps:

* A list of over LONG_LIST nodes belongs to a passage that many documents share, or to a large group of near copies.
  Documents with such values list all their other retained values as well, and only those made of such values for the
  most part (under COLD_SHARE others) stay in long lists, with their LISTED_LONG lowest ones. A pair of similar
  documents shares many values, so it meets in a short list, or both are in the long ones.
* In each list the nodes meet its pivot: that is a row for each node and list, never all pairs. The pivot is the most
  typical node, the one with the largest share of long-list values. Pairs pass if the
  sketch of their union estimates a similarity near the threshold or above, and count once the full sets confirm them.
  Nodes that are linked are one component; lists within one component are done.
* Lists whose nodes are still apart give the pairs of different components that can be links. In long lists two numbers
  for each node, the size of its set and how many of its shingles some other such node has, bound the size of a partner.
  The smaller set of a link must have nearly all of its shingles in common with others (2 * t / (1 + t) of them), the
  larger one a share of t. Documents that share a passage below that are left out before any join, whatever their number.
  What is left is joined by the first values of its sets, in an order that has the values of few sets first: two sets that
  have none of these in common can't be a link, and a value's place in a set bounds the size of a partner. As a copy that isn't
  linked to its group's pivot has over (1 - t) / (1 + t) of its values from edits, these lists are short, whatever the number of copies.
  Pairs go by value, range of size and part of the list, and are compared by signatures of one bit for each of 512 minima,
  with the same margin of DEVIATIONS.

So no link between different texts is lost but by chance: two documents at a similarity of 0.8 have no retained value
in common with a chance of 0.2 ** 16; in long lists they have at least 0.5 of those values in common, so the chance is
0.5 ** 24. What still grows with the square of a list is the number of documents that consist of common passages nearly
whole, without being linked, such as copies of an original that isn't there itself.

No task gets all rows of one value, class, component or pivot: lists, classes and labels are dealt in parts where they
are long, and the texts of a node in many pairs go to several tasks.

Results for odd input: fewer than WORDS words make one shingle; null, empty and blank texts have an empty set and
are linked with nothing; rows of equal doc_id are one document with the union of their rows' links; a row with a null id
is a document without a name, whose component_id is the lowest id it reaches (null if none) and which is kept only if it
reaches none and stands for its component; an empty table gives an empty result; texts of any length are taken whole;
other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut, discard, key_bitmap, maybe_in, portions, release, split_by_bitmap

WORDS = 5
KEEP = 64
HEAD_BYTES = 64
PORTION_BYTES = 2_000_000
LISTED = 16
LISTED_LONG = 24
LONG_LIST = 40
COLD_SHARE = 0.4
PIVOT_ROUNDS = 1
#: Pairs of one node, and rows of a list, that go to one task together; parts of a long list or large class.
HUB, PART, PARTS = 256, 2000, 16
#: Rows of a class from which its result is broadcast; at most 100,000 such classes are.
LARGE_CLASS = 10_000
#: Sketches of documents in long lists, which are compared with many.
KEEP_WIDE = 512
#: The estimate may be so many standard deviations below the threshold.
DEVIATIONS = 5.5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SKETCH, _SKETCH_ARROW = arrow_schema("doc_id long, th long, n long, fp1 long, fp2 long, d1 long, d2 long, sketch array<long>")
#: What tells classes apart.
_CLASS = ["fp1", "fp2", "n", "d1", "d2"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: a polynomial over their first bytes, a digest of the rest, and the length."""
    raw = pc.cast(words, pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    h = np.zeros(len(size), np.uint64)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for k in range(min(HEAD_BYTES, int(size.max(initial=0)))):
        at = order[: np.searchsorted(falling, -k, "left")]  # words of over k bytes
        h[at] = h[at] * np.uint64(0x100000001B3) + data[offsets[at] + k].astype(np.uint64) + np.uint64(1)
    for w in order[: np.searchsorted(falling, -HEAD_BYTES, "left")]:
        rest = hashlib.blake2b(data[offsets[w] + HEAD_BYTES : offsets[w + 1]].tobytes(), digest_size=8).digest()
        h[w] ^= np.uint64(int.from_bytes(rest, "little"))
    return _mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, rows ascending and hashes ascending within a row."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(pieces).dictionary_encode()
    code = coded.indices.to_numpy()
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[code]
    row, h = row[full], word_hashes(coded.dictionary)[code[full]]
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    size = np.minimum(n, WORDS)
    acc = np.zeros(len(h), np.uint64)
    place = np.arange(len(h)) - first[row]
    for k in range(WORDS):
        nxt = np.append(h[k:], np.zeros(min(k, len(h)), np.uint64))  # as long as h, however short that is
        use = (k < size[row]) if len(row) else np.zeros(0, bool)
        acc = np.where(use, _mix(acc * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(k + 1)), acc)
    starts = place <= (n - size)[row] if len(row) else np.zeros(0, bool)
    row, acc = row[starts], acc[starts]
    order = np.lexsort((acc, row))
    row, acc = row[order], acc[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (acc[1:] != acc[:-1])
    return row[keep], acc[keep]


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic digest of each text's lower-cased words."""
    raw = (b" ".join((x or b"").lower().split()) for x in pc.cast(texts, pa.binary()).to_pylist())  # bytes know ASCII case and white space alone
    out = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _own(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, size of the set, its 128-bit fingerprint, the digest of the words, KEEP lowest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION_BYTES):
            size = len(batch)
            row, h = shingle_hashes(batch.column("text"))
            n = np.bincount(row, minlength=size)
            first = np.cumsum(n) - n
            place = np.arange(len(row)) - first[row]
            low = h[place < KEEP].astype(np.int64)
            ends = np.append(0, np.cumsum(np.minimum(n, KEEP)))
            fp1, fp2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            some = n > 0
            if some.any():
                fp1[some] = np.add.reduceat(_mix(h + np.uint64(0x1234567)), first[some])
                fp2[some] = np.bitwise_xor.reduceat(_mix(h + np.uint64(0x7654321)), first[some])
            yield arrow_batch(_SKETCH_ARROW, batch.column("doc_id"), batch.column("th"), n, fp1.astype(np.int64), fp2.astype(np.int64), *digests(batch.column("text")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low)))

    return _own(docs).mapInArrow(run, _SKETCH)


def components(edges: DataFrame) -> DataFrame:
    """comp, the lowest id that each node of edges reaches: node, comp. Nodes without edges are left out.

    Each turn every node takes the lowest label beside it and then that label's own label, which halves long chains, and
    ends in a table. The edges of a node with many, and the nodes of a label with many, are dealt in parts.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    hubs = cut(both.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART).select(F.col("v").alias("hub")), "hubs")
    part = F.when(F.col("hub").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("u"), F.lit(PARTS))).cast("int")
    if hubs.limit(1).count():
        dealt = cut(both.join(hubs, F.col("v") == F.col("hub"), "left").select("u", "v", part.alias("part")), "edges")
        discard(both)
        both = dealt
    else:
        both = both.withColumn("part", F.lit(0))
    parts = F.array(*map(F.lit, range(PARTS)))
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        beside = label.join(hubs, F.col("node") == F.col("hub"), "left").select(F.col("node").alias("v"), "comp", F.explode(F.when(F.col("hub").isNull(), F.array(F.lit(0))).otherwise(parts)).alias("part"))
        near = both.join(beside, ["v", "part"]).groupBy("u").agg(F.min("comp").alias("m"))
        step = cut(label.join(near, F.col("node") == F.col("u")).select("node", F.least("comp", "m").alias("next"), F.col("comp").alias("old")), "steps")
        # the labels' own labels, each in all parts
        roots = step.select(F.col("next").alias("t")).distinct()
        far = step.join(roots, F.col("node") == F.col("t")).select("t", F.col("next").alias("far"), F.explode(parts).alias("part"))
        own = step.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).alias("s")
        met = own.join(far.alias("f"), (F.col("s.next") == F.col("f.t")) & (F.col("s.part") == F.col("f.part")), "left")
        after = cut(met.select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "old"), "labels")
        moved = after.where("comp != old").limit(1).count()
        discard(label, step)
        label = after.select("node", "comp")
        label._cut_path = after._cut_path
        if not moved:
            discard(both, hubs)
            return label


_LINK, _LINK_ARROW = arrow_schema("a long, b long")


def possible(p: np.ndarray, q: np.ndarray, n1: int, n2: int, threshold: float) -> bool:
    """Whether sets of n1 and n2 values with these sketches can have the threshold; exact if both sketches are whole."""
    both = np.intersect1d(p, q)
    if len(p) == n1 and len(q) == n2:
        return len(both) >= (threshold - 1e-9) * (n1 + n2 - len(both))
    k = min(len(p) if len(p) < n1 else n1 + n2, len(q) if len(q) < n2 else n1 + n2)
    union = np.union1d(p, q)[:k]
    shared = int(np.searchsorted(both, union[-1], "right"))
    return shared >= (threshold - DEVIATIONS * (threshold * (1 - threshold) / len(union)) ** 0.5) * len(union)


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose union sketch allows the threshold; nodes: node, sketch, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            xs, ys = batch.column("x"), batch.column("y")
            vx, vy = xs.flatten().to_numpy(), ys.flatten().to_numpy()
            ex, ey = np.cumsum(pc.list_value_length(xs).to_numpy()), np.cumsum(pc.list_value_length(ys).to_numpy())
            nx, ny = batch.column("nx").to_pylist(), batch.column("ny").to_pylist()
            keep = np.zeros(len(batch), bool)
            ax = ay = 0
            for k, (bx, by) in enumerate(zip(ex.tolist(), ey.tolist())):
                keep[k] = possible(vx[ax:bx].view(np.uint32), vy[ay:by].view(np.uint32), nx[k], ny[k], threshold)
                ax, ay = bx, by
            on = pa.array(keep)
            yield arrow_batch(_LINK_ARROW, batch.column("a").filter(on), batch.column("b").filter(on))

    nodes = maybe_in(nodes, F.col("node"), key_bitmap(_ids(pairs), "i"))
    met = _beside(pairs, nodes, "sketch", "n").where(F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(threshold - 1e-9))
    return met.select("a", "b", F.col("x_sketch").alias("x"), F.col("y_sketch").alias("y"), F.col("x_n").alias("nx"), F.col("y_n").alias("ny")).mapInArrow(run, _LINK)


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("i")).union(pairs.select("b"))


def _beside(pairs: DataFrame, own: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both nodes, x_ of a and y_ of b. A node a with many pairs is dealt into parts, each with its columns."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HUB).select(F.col("a").alias("hub"), F.ceil(F.col("m") / HUB).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int")
    dealt = pairs.select("a", "b").join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", part.alias("part"))
    y = own.select(F.col("node").alias("b"), *[F.col(c).alias("y_" + c) for c in columns])
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    x = own.join(hubs, F.col("node") == F.col("hub"), "left").select(F.col("node").alias("a"), each, *[F.col(c).alias("x_" + c) for c in columns])
    return dealt.join(y, "b").join(x, ["a", "part"])


def _texts(docs: DataFrame, nodes: DataFrame, again: bool) -> DataFrame:
    """node, text of nodes (node, doc_id, th); again: whether rows repeat."""
    own = maybe_in(_own(docs), F.col("th"), key_bitmap(nodes, "th")).alias("d")
    met = own.join(nodes.alias("n"), (F.col("d.th") == F.col("n.th")) & F.col("d.doc_id").eqNullSafe(F.col("n.doc_id"))).select("n.node", "d.text")
    return met.dropDuplicates(["node"]) if again else met


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets of shingles, as text, have 100 * intersection >= percent * union."""

    def shingles(text: str) -> set[bytes]:
        words = text.encode().lower().split()  # bytes know ASCII case and white space alone
        return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            release()
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = np.zeros(len(a), bool)
            for k, (i, x, y) in enumerate(zip(a, batch.column("x"), batch.column("y"))):
                if i != last:
                    last, own = i, shingles(x.as_py())
                other = shingles(y.as_py())
                both = len(own & other)
                keep[k] = 100 * both >= percent * (len(own) + len(other) - both)
            on = pa.array(keep)
            yield arrow_batch(_LINK_ARROW, batch.column("a").filter(on), batch.column("b").filter(on))

    met = _beside(pairs, texts, "text").select("a", "b", F.col("x_text").alias("x"), F.col("y_text").alias("y"))
    return met.sortWithinPartitions("a").mapInArrow(run, _LINK)


class _Search:
    """What the steps of one search share: texts, nodes and threshold."""

    def __init__(self, docs: DataFrame, threshold: float):
        self.docs, self.threshold, self.percent = docs, threshold, round(threshold * 100)
        self.rows = cut(sketches(docs).withColumn("rid", F.monotonically_increasing_id()), "sketches")
        full = self.rows.where("n > 0")
        self.again = bool(self.rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count())
        # a class is the rows of equal words, its node the lowest row of it
        self.classes = cut(full.groupBy(*_CLASS).agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m")), "classes")

    def places(self, nodes: DataFrame) -> DataFrame:
        """node, doc_id and th of nodes (node)."""
        return self.rows.select(F.col("rid").alias("node"), "doc_id", "th").join(nodes.select("node"), "node", "left_semi")

    def confirmed(self, pairs: DataFrame, percent: int) -> DataFrame:
        wanted = cut(self.places(_ids(pairs).select(F.col("i").alias("node")).distinct()), "wanted")
        texts = cut(_texts(self.docs, wanted, self.again), "near-texts")
        found = cut(_confirmed(pairs, texts, percent), "links")
        discard(wanted, texts)
        return found

    def equal_sets(self) -> tuple[DataFrame, DataFrame | None]:
        """One node of each set, and links to it from classes of other texts with that set, each confirmed."""
        heads = self.classes.groupBy("fp1", "fp2", "n").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k"))
        several = cut(heads.where("k > 1"), "several")
        links = None
        if several.limit(1).count():
            pairs = cut(self.classes.join(several, ["fp1", "fp2", "n"]).where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")), "equal-pairs")
            links = self.confirmed(pairs, 100)
            # a class that isn't confirmed is a node of its own
            other = pairs.join(links, ["a", "b"], "left_anti").select(F.col("b").alias("node"))
            heads = heads.select(F.col("head").alias("node")).unionByName(other)
        else:
            heads = heads.select(F.col("head").alias("node"))
        nodes = cut(self.rows.select(F.col("rid").alias("node"), "doc_id", "th", "n", "sketch").join(heads, "node", "left_semi"), "nodes")
        if links is not None:
            discard(pairs)
        discard(several)
        return nodes, links

    def same_ids(self) -> DataFrame | None:
        """Links between classes of one doc_id, whose rows are one document."""
        own = self.rows.where("n > 0 AND doc_id IS NOT NULL")
        split = cut(own.groupBy("doc_id").agg(F.min("d1").alias("d0"), F.max("d1").alias("d9")).where("d0 != d9").select("doc_id"), "split-ids")
        if not split.limit(1).count():
            return None
        met = own.select("doc_id", *_CLASS).join(split, "doc_id", "left_semi").join(self.classes, _CLASS).select("doc_id", "node").distinct()
        first = met.groupBy("doc_id").agg(F.min("node").alias("a"))
        return cut(met.join(first, "doc_id").where("a != node").select("a", F.col("node").alias("b")), "same-ids")

    def link(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        if not pairs.limit(1).count():
            return pairs.select("a", "b")
        close = cut(_estimated(pairs, nodes, self.threshold), "close")
        if not close.limit(1).count():
            return close
        found = self.confirmed(close, self.percent)
        discard(close)
        return found


def _unique(met: DataFrame) -> DataFrame:
    """Each pair once, the hub on its side a."""
    pair = met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") < F.col("b")).cast("int").alias("up"))
    pair = pair.groupBy("lo", "hi").agg(F.max("up").alias("up"))
    return pair.select(F.when(F.col("up") == 1, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("up") == 1, F.col("hi")).otherwise(F.col("lo")).alias("b"), "lo", "hi")


def _resolved(docs: DataFrame, threshold: float) -> DataFrame:
    """A row for each row of docs: rid, doc_id, th, n, component_id, kept."""
    bound_batches(docs.sparkSession)
    search = _Search(docs, threshold)
    nodes, edges = search.equal_sets()
    if (same := search.same_ids()) is not None:
        edges = same if edges is None else edges.unionByName(same)
    shared = _shared(nodes)
    share = shared.groupBy("node").agg(F.sum(F.col("hot").cast("int")).alias("hots"), F.array_sort(F.collect_list(F.when(F.col("hot"), F.col("value")))).alias("longs"))
    share = share.join(nodes.select("node", "n"), "node").withColumn("share", F.col("hots") / F.least("n", F.lit(KEEP)))
    share = cut(share.select("node", "n", "share", F.when(F.col("share") > 1 - COLD_SHARE, F.slice("longs", 1, LISTED_LONG)).alias("longs")), "shares")
    own, wide, often = _long_traits(search, share.where("longs IS NOT NULL").select("node"))
    traits = share.join(own, "node", "left").select("node", "n", "share", "longs", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    listed = shared.join(traits, "node").where(F.when(F.col("share") == 0, F.col("k") < LISTED).when(~F.col("hot"), F.lit(True)).otherwise(F.array_contains("longs", F.col("value"))))
    # a hash's upper half is enough to compare sketches, and never tells equal values apart
    upper = F.transform(F.coalesce("wide", "sketch"), lambda x: F.shiftright(x, 32).cast("int"))
    sketched = nodes.join(wide, "node", "left").select("node", "n", upper.alias("sketch"))
    lists = cut(listed.select("value", "node", "hot", "n", "common", "share"), "lists")
    label = seen = None
    for turn in range(PIVOT_ROUNDS + 1):
        live = lists.withColumn("comp", F.col("node")) if label is None else lists.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        order = (F.lit(1.0) - F.col("share")) if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
        spread = live.groupBy("value").agg(F.max("hot").alias("hot"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct(order.alias("o"), F.col("node").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"), F.col("common").alias("pcommon"))).alias("pivot"))
        open_lists = spread.where("c0 != c1").select("value", "hot", "pivot.p", "pivot.pc", "pivot.pn", "pivot.pcommon")
        if turn < PIVOT_ROUNDS:
            part = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
            parts = F.explode(F.when(F.col("hot"), F.array(*map(F.lit, range(PARTS)))).otherwise(F.array(F.lit(0)))).alias("part")
            may = _may_link(F.col("l.n"), F.col("r.pn"), F.col("l.common"), F.col("r.pcommon"), F.col("l.hot"), threshold)
            met = live.withColumn("part", part).alias("l").join(open_lists.select("*", parts).alias("r"), (F.col("l.value") == F.col("r.value")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.comp") != F.col("r.pc")) & may)
            met = met.select(F.col("r.p").alias("a"), F.col("l.node").alias("b"))
        else:
            left = _open_rows(search, live.join(open_lists.select("value"), "value", "left_semi"), wide, often)
            met = _rest(left, threshold)
        pairs = _unique(met)
        if seen is not None:
            pairs = pairs.join(seen.select("lo", "hi"), ["lo", "hi"], "left_anti")
        pairs = cut(pairs, "pairs")
        found = search.link(pairs, sketched)
        edges = found if edges is None else edges.unionByName(found)
        seen = pairs if seen is None else seen.unionByName(pairs)
        if turn == PIVOT_ROUNDS:
            discard(left)
        label, old = components(edges), label
        discard(old)
    # of each class its component; of each component the lowest id
    of_class = cut(search.classes.join(label, "node", "left").select(*_CLASS, "node", "low", "m", F.coalesce("comp", "node").alias("comp")), "of-class")
    lowest = of_class.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_class = cut(of_class.join(lowest, "comp").select(*_CLASS, "m", "component_id", (F.col("node") == F.col("comp")).alias("first")), "components")
    discard(nodes, shared, share, own, wide, often, lists, label, search.classes)
    return _spread_out(search.rows, of_class)


def _shared(nodes: DataFrame) -> DataFrame:
    """node, k, value, hot of retained values that several nodes have; hot: more than LONG_LIST of them.

    Values of very many nodes, of which there are 200,000 at most, are sent to all tasks, so their rows aren't shuffled.
    """
    values = nodes.select("node", F.posexplode("sketch").alias("k", "value"))
    counts = cut(values.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "value-counts")
    most = max(PART, KEEP * nodes.count() // 200_000)
    hot = (F.col("m") > LONG_LIST).alias("hot")
    big, rest = counts.where(F.col("m") > most), counts.where(F.col("m") <= most)
    if big.limit(1).count():
        small = values.join(F.broadcast(big.select("value")), "value", "left_anti")
        met = small.join(rest, "value").unionByName(values.join(F.broadcast(big), "value"))
    else:
        met = values.join(rest, "value")
    out = cut(met.select("node", "k", "value", hot), "shared-values")
    discard(counts)
    return out


def _spread_out(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """The component of each row. Large classes, of which there are 100,000 at most, are sent to all tasks."""
    large = max(LARGE_CLASS, rows.count() // 100_000)
    result = ["component_id", "first"]
    own = rows.select("rid", "doc_id", "th", *_CLASS)
    big, rest = of_class.where(F.col("m") > large).select(*_CLASS, *result), of_class.where(F.col("m") <= large).select(*_CLASS, *result)
    if big.limit(1).count():
        small = own.join(F.broadcast(big.select(*_CLASS)), _CLASS, "left_anti")
        met = small.join(rest, _CLASS, "left").unionByName(own.join(F.broadcast(big), _CLASS))
    else:
        met = own.join(rest, _CLASS, "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.when(F.col("doc_id").isNotNull(), component == F.col("doc_id")).otherwise(component.isNull() & F.coalesce("first", F.lit(True)))
    return met.select("rid", "doc_id", "th", "n", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (lowest doc_id reachable by links at threshold), kept, for each row of docs."""
    return _resolved(docs, threshold).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _may_link(n1, n2, common1, common2, hot, threshold: float):
    """Whether sets of these sizes can have the threshold. In long lists no more than the common shingles can be shared."""
    size = F.least(n1, n2) >= F.greatest(n1, n2) * F.lit(threshold - 1e-9)
    return size & (~hot | (F.least(common1, common2) >= (n1 + n2) * F.lit(threshold / (1 + threshold) - 1e-9)))


def _first_values(search: _Search, nodes: DataFrame, often: DataFrame) -> DataFrame:
    """value, node, place of the values of nodes that the first one in common with a link can be.

    Values are in one order for all sets: those of no more than LONG_LIST sets first, as far as a bitmap tells, then by hash.
    A link has at least a share t of the values of each of its sets in common, so the first of these is no further than that.
    """
    threshold, bitmap = search.threshold, key_bitmap(often, "value")
    sent = nodes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in portions(batches, PORTION_BYTES):
            row, h = shingle_hashes(batch.column("text"))
            at = h.view(np.int64) % (8 * len(bits))
            late = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            order = np.lexsort((h, late, row))
            row, h = row[order], h[order]
            n = np.bincount(row, minlength=len(batch))
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            keep = place <= n[row] * (1 - threshold) + 1e-6
            yield arrow_batch(_PLACE_ARROW, h[keep].view(np.int64), batch.column("node").take(pa.array(row[keep])), place[keep])

    return _texts(search.docs, search.places(nodes), search.again).mapInArrow(run, _PLACE)


def _open_rows(search: _Search, live: DataFrame, wide: DataFrame, often: DataFrame | None) -> DataFrame:
    """Rows of live in short lists, and for nodes in long lists one for each of their first values, hot."""
    rows = cut(live, "open-lists")
    short = rows.where("NOT hot").select("value", "node", "n", "common", "hot", "comp", F.lit(None).cast("long").alias("place"), F.lit(None).cast("array<long>").alias("bits"))
    nodes = cut(rows.where("hot").select("node", "n", "common", "comp").distinct(), "open-nodes")
    if nodes.limit(1).count():
        long = _first_values(search, nodes, often).join(nodes, "node").join(wide.select("node", "bits"), "node")
        short = short.unionByName(long.withColumn("hot", F.lit(True)))
    out = cut(short, "first-values")
    discard(rows, nodes)
    return out


def _rest(live: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components of a list that can be links, a the smaller set in long lists.

    With r = t / (1 + t), a link needs r * (n1 + n2) common shingles. A set has no more than those that others have too, and
    none before the first one that both have, so its place bounds the size of a partner: most. The larger set goes to the cells of
    size that its partners can have, the smaller one to its own. Pairs within a list's largest component aren't made.
    """
    may = _may_link(F.col("l.n"), F.col("r.n"), F.col("l.common"), F.col("r.common"), F.col("l.hot"), threshold)
    short = live.where("NOT hot").select("value", "node", "n", "common", "hot", "comp")
    pairs = short.alias("l").join(short.alias("r"), (F.col("l.value") == F.col("r.value")) & (F.col("l.comp") != F.col("r.comp")) & may & (F.col("l.node") < F.col("r.node"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    most = F.least(F.col("common"), F.col("n") - F.col("place")) / F.lit(threshold / (1 + threshold)) - F.col("n") + 1e-6
    long = live.where("hot").select("value", "node", "n", "comp", "bits", most.alias("most"))
    top = long.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("value").agg(F.max(F.struct("m", "comp")).alias("t"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rows = long.join(top.select("value", F.col("t.comp").alias("top"), F.least(F.ceil(F.col("m") / PART), F.lit(1024)).cast("int").alias("parts")), "value")
    cell = lambda size: F.floor(F.log(size) * CELLS)
    keep = ["value", "node", "n", "most", "bits", "comp", "within"]
    # within: whether the smaller set is in the largest component of the list, where the larger one then isn't
    less = rows.where("most >= n").withColumn("within", F.col("comp") == F.col("top"))
    bounds = less.groupBy("value", "within").agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.max("most").alias("reach"))
    both = F.when(F.col("comp") == F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    more = rows.withColumn("within", F.explode(both)).join(bounds, ["value", "within"]).where("n <= reach")
    lo, hi = F.greatest("least", F.col("n") * F.lit(threshold - 1e-9)), F.least("n", "most", "largest")
    more = more.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    l = less.select(*keep, cell(F.col("n")).alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).alias("l")
    r = more.select(*keep, F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")).alias("r")
    same = (F.col("l.value") == F.col("r.value")) & (F.col("l.within") == F.col("r.within")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.part") == F.col("r.part"))
    fit = (F.col("r.n") <= F.col("l.most")) & (F.col("l.n") <= F.col("r.most")) & ((F.col("l.n") < F.col("r.n")) | (F.col("l.n") == F.col("r.n")) & (F.col("l.node") < F.col("r.node")))
    differ = sum((F.bit_count(F.get(F.col("l.bits"), k).bitwiseXOR(F.get(F.col("r.bits"), k))) for k in range(SIGNATURE_LONGS)), F.lit(0))
    far = l.join(r, same & (F.col("l.comp") != F.col("r.comp")) & fit & (differ <= most_differing(threshold)))
    return pairs.unionByName(far.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))


_ALONE, _ALONE_ARROW = arrow_schema("value long, node long, wide array<long>, bits array<long>")
_PLACE, _PLACE_ARROW = arrow_schema("value long, node long, place long")
#: Cells of size by which long lists are joined, for a factor of e.
CELLS = 64
SIGNATURE_LONGS = 8
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ k << 33) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(64 * SIGNATURE_LONGS)], np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """A bit of the lowest value under each of many multipliers; bits of two sets differ with chance (1 - similarity) / 2."""
    bits = np.zeros(len(_FACTORS), bool)
    for k in range(0, len(_FACTORS), 64):
        low = _mix_low(h, _FACTORS[k : k + 64])
        bits[k : k + 64] = (low >> np.uint64(7)) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def _mix_low(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * factors[None, :]
        out = np.minimum(out, (x ^ x >> np.uint64(29)).min(axis=0))
    return out


def most_differing(threshold: float) -> int:
    p, n = (1 - threshold) / 2, 64 * SIGNATURE_LONGS
    return int(n * p + DEVIATIONS * (n * p * (1 - p)) ** 0.5) + 1


def _long_traits(search: _Search, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of nodes in long lists: how many shingles no other of them has (node, alone), wide sketches (node, wide, bits), and the values of over LONG_LIST of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION_BYTES):
            own = batch.column("node").to_numpy()
            row, h = shingle_hashes(batch.column("text"))
            none = pa.nulls(len(h), _ALONE_ARROW.field("wide").type)
            yield arrow_batch(_ALONE_ARROW, h.view(np.int64), own[row], none, none)
            n = np.bincount(row, minlength=len(own))
            low = h[np.arange(len(row)) - (np.cumsum(n) - n)[row] < KEEP_WIDE].view(np.int64)
            ends = np.append(0, np.cumsum(np.minimum(n, KEEP_WIDE)))
            cuts = np.cumsum(n)[:-1]
            bits = [signature(x).tolist() for x in np.split(h, cuts)] if len(own) else []
            yield arrow_batch(_ALONE_ARROW, pa.nulls(len(own), pa.int64()), own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low)), bits)

    if not nodes.limit(1).count():
        none = F.lit(None).cast("array<long>")
        return nodes.withColumn("alone", F.lit(0).cast("long")), nodes.withColumn("wide", none).withColumn("bits", none), None
    wanted = cut(search.places(nodes), "long-nodes")
    found = cut(_texts(search.docs, wanted, search.again).mapInArrow(run, _ALONE), "long-traits")
    counts = found.where("wide IS NULL").groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("node"))
    counts = cut(counts.where((F.col("m") == 1) | (F.col("m") > LONG_LIST)), "long-counts")
    alone = cut(counts.where("m = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "private")
    often = cut(counts.where("m > 1").select("value"), "often")
    wide = cut(found.where("wide IS NOT NULL").select("node", "wide", "bits"), "wide")
    discard(wanted, found, counts)
    return alone, wide, often


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that of the lowest id, and of its rows that of the lowest hash of text.

    Columns stay, whatever their names. Rows without id and without words all stay.
    """
    rows = cut(_resolved(docs, threshold), "resolved")
    named = rows.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("th").alias("th0"), F.max("th").alias("th9"))
    other = rows.where("kept AND doc_id IS NOT NULL").join(named.where("th0 != th9"), "doc_id").where("th != th0").select("doc_id", "th")
    gone = cut(rows.where("NOT kept").select("doc_id", "th").unionByName(other).distinct(), "near-copies")
    again = cut(rows.where("kept AND (doc_id IS NOT NULL OR n > 0)").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id", "th"), "repeated-rows")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    key = F.xxhash64("doc_id", "th")
    maybe, sure = split_by_bitmap(own, key, key_bitmap(gone.select(key.alias("key")), "key"))  # only these rows are shuffled
    same = lambda t: (F.col("o.th") == F.col(f"{t}.th")) & F.col("o.doc_id").eqNullSafe(F.col(f"{t}.doc_id"))
    left = maybe.alias("o").join(gone.withColumn("gone", F.lit(True)).alias("g"), same("g"), "left").where("gone IS NULL").select("o.*").unionByName(sure)
    if again.limit(1).count():
        twice = left.alias("o").join(again.alias("t"), same("t"), "left_semi").dropDuplicates(["doc_id", "th"])
        left = left.alias("o").join(again.alias("t"), same("t"), "left_anti").unionByName(twice)
    discard(rows)
    return left.select("whole.*")
