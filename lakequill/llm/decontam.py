"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words, STRIDE apart, so that each run of words lies in one for the most part. They are
TF-IDF vectors over the benchmark's words; all other words count in their length alone. A randomised singular value
decomposition, distributed over passages, gives the latent space: the range finder is seeded with the benchmark's own
passages beside a random sketch of the whole corpus, and Ritz values come from that sketch. (A range found from the corpus
alone at ranks 64, 128 and 256 kept a share of 0.00, 0.03 and 0.16 of the passages with an exact cosine of 0.55 or more,
since rare words aren't among its main directions; hence the seed.) Every passage of every document is projected; a bound by
Cauchy and Schwarz skips those that can't reach the threshold.

The cosine of a whole item and a window of fixed size falls with the item's length and with each word that is replaced, so
a second search covers what it can't reach: of each run of cells that holds any SPAN times as many words as the item, the
weight of the item's words in it is summed, and runs whose sum is too small for any verdict are excluded. The sum is an
upper bound, so nothing that the judge accepts in a run of that length is left out, however frequent its words are.

Candidates are judged on the words themselves: the longest common subsequence of item and passage, and whether the item's
answer occurs. A paraphrase found by weight alone must hold EVIDENCE of the item's weight in order too, since half of a
short item's words may be such as stand in every text.

The basis is fitted to all benchmark items and all cells of the corpus, of which a passage is two. A sketch adds up cells
with random signs, and weights of words scale it as they would scale each cell, so it is made where words are counted,
before weights are known, in whole numbers. Document frequencies and the search cover all passages, too. As the range holds
all items and no direction is cut, the latent cosines of items and passages are those of the TF-IDF vectors.

The benchmark comes to the driver a partition at a time and goes through in blocks of at most BLOCK_ITEMS items and
BLOCK_VALUES values (words times items), which bounds what is sent; each scan of the corpus serves SCAN_BLOCKS of them.

Results for odd input: null and empty texts have no passages and stay; items without words match nothing; items of
common words alone keep those words' weights; equal rows get equal results; an item that leaks at several places counts
once, with its best values; texts and items of any length are searched whole; empty tables give an empty result; other
columns are ignored and may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut, discard, key_bitmap, maybe_in, portions, release, row_key, split_by_bitmap

WINDOW, STRIDE = 32, 16
BLOCK_ITEMS, BLOCK_VALUES, SCAN_BLOCKS = 512, 2_000_000, 4
PORTION_BYTES = 2_000_000
JUDGED = 64
EXTRA_RANK = 32
#: A word of more than this share of cells has no weight in the cosine, unless an item would lose most of its weight.
MOST_COMMON = 0.02
LEAST_WEIGHT = 0.05
COSINE = 0.45
#: Share of an item's words in common order that is a leak by itself, and with the answer present.
COPY, PARAPHRASE, ANSWER = 0.75, 0.5, 0.6
#: Share of an item's weight in common order that a paraphrase needs which no cosine has found.
EVIDENCE = 1 / 3
#: Words of a copy or paraphrase for each of the item's.
SPAN = 1.5
SCALE, BLOCK_COLUMNS, BLOCK_CELLS = 4000, 128, 1024
_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place in the row and lower-cased word of each run of letters and digits."""
    pieces = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _SPLIT)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(pieces)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    row, flat = row[full], flat.filter(pa.array(full))
    first = np.searchsorted(row, np.arange(len(texts)))
    return row, np.arange(len(row)) - first[row], flat


@dataclass
class Item:
    item_id: int
    words: list[str]
    answer: list[str]


def items_of(benchmark: DataFrame) -> Iterator[Item]:
    """The benchmark's items by id; column answer has their answers, or else the last sentence of a text is its answer."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    split = lambda t: words_of(pa.array([t], pa.string()))[2].to_pylist()
    for r in rows.sort("item_id", "text").toLocalIterator():
        text, answer = r["text"], r["answer"]
        if answer is None and text:
            parts = [p for p in text.replace("\n", ". ").split(". ") if p.strip(" .")]
            answer = parts[-1] if len(parts) > 1 else ""
        x = Item(r["item_id"], split(text), split(answer))
        if x.words:
            yield x


def blocks_of(items: Iterable[Item]) -> Iterator[list[Item]]:
    """Runs of items within BLOCK_ITEMS and BLOCK_VALUES; a single item may go beyond."""
    held, words = [], set()
    for x in items:
        more = words | set(x.words)
        if held and (len(held) >= BLOCK_ITEMS or len(more) * (len(held) + 1) > BLOCK_VALUES):
            yield held
            held, more = [], set(x.words)
        held.append(x)
        words = more
    if held:
        yield held


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for k, w in enumerate(b):
        places.setdefault(w, []).append(k)
    best: list[int] = []
    for w in a:
        for k in reversed(places.get(w, ())):
            j = bisect.bisect_left(best, k)
            if j == len(best):
                best.append(k)
            else:
                best[j] = k
    return len(best)


def heaviest_subsequence(a: list[str], weights: np.ndarray, b: list[str]) -> float:
    """Weight of the heaviest common subsequence, each word of a with a weight."""
    code: dict[str, int] = {}
    own = np.array([code.setdefault(w, len(code)) for w in b], np.int64)
    best = np.zeros(len(b) + 1)
    for w, weight in zip(a, weights):
        if w in code:
            best[1:] = np.maximum(best[1:], np.where(own == code[w], best[:-1] + weight, 0.0))
            np.maximum.accumulate(best, out=best)
    return float(best[-1])


class Space:
    """Vocabulary, weights and latent basis of a block of items."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.vocabulary = pa.array(sorted({w for x in items for w in x.words}), pa.string())
        self.idf = self.weight = np.ones(len(self.vocabulary))
        self.other = 1.0
        self.sketch: np.ndarray | None = None  # of each word, EXTRA_RANK sums over the corpus
        self.most: np.ndarray | None = None  # of each word, its highest value in an item's unit vector
        self.basis = self.coords = None

    @classmethod
    def of_words(cls, vocabulary: pa.Array, like: "Space | None" = None) -> "Space":
        """A space without items, with the weights of another one."""
        out = cls([])
        out.vocabulary = vocabulary
        out.idf = out.weight = np.ones(len(vocabulary))
        if like is not None:
            out.idf, out.weight, out.other = like.idf, like.weight, like.other
        return out

    def weigh(self, df: np.ndarray, passages: int) -> None:
        self.weight = np.maximum(np.log((passages + 1.0) / (df + 1.0)), LEAST_WEIGHT)
        self.idf = np.where(df > max(MOST_COMMON * passages, 8), 0.0, self.weight)
        place = {w: k for k, w in enumerate(self.vocabulary.to_pylist())}
        for x in self.items:
            own = [place[w] for w in set(x.words)]
            if (self.idf[own] ** 2).sum() < 0.5 * (self.weight[own] ** 2).sum():
                self.idf[own] = self.weight[own]
        on = self.idf > 0
        self.other = float(np.median(self.idf[on])) if on.any() else 1.0
        self.most = self.vectors().max(axis=0, initial=0.0)

    def vectors(self) -> np.ndarray:
        """Unit TF-IDF vectors of the items; zero for items of common words."""
        place = {w: k for k, w in enumerate(self.vocabulary.to_pylist())}
        out = np.zeros((len(self.items), len(self.vocabulary)))
        for k, x in enumerate(self.items):
            for w in x.words:
                out[k, place[w]] = self.idf[place[w]]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)

    def terms(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the row and term (-1 beyond the vocabulary) of each word.

        Distinct pieces between white space are cut into words once; their words then take the pieces' places.
        """
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
        coded = pc.list_flatten(pieces).dictionary_encode()
        code = coded.indices.to_numpy()
        owner, _, flat = words_of(coded.dictionary)
        term = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), -1).to_numpy()
        per = np.bincount(owner, minlength=len(coded.dictionary))
        first = np.cumsum(per) - per
        if per.max(initial=0) <= 1:
            on = per[code] > 0
            row, term = row[on], term[first[code[on]]]
        else:
            n = per[code]
            ends = np.cumsum(n)
            row = np.repeat(row, n)
            term = term[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[code] - (ends - n), n)]
        size = np.bincount(row, minlength=len(texts))
        return row, np.arange(len(row)) - (np.cumsum(size) - size)[row], term

    def cells(self, texts: pa.Array, terms: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and number of each cell of STRIDE words, and its distinct terms, padded with the vocabulary's size."""
        row, pos, term = terms or self.terms(texts)
        none = len(self.vocabulary)
        first = np.flatnonzero(pos % STRIDE == 0)
        at = np.cumsum(pos % STRIDE == 0) - 1
        held = np.full((len(first), STRIDE), none, np.int32)
        held[at, pos % STRIDE] = np.where(term < 0, none, term)
        held.sort(axis=1)
        held[:, 1:][held[:, 1:] == held[:, :-1]] = none
        held.sort(axis=1)  # all padding last
        return row[first], pos[first] // STRIDE, held

    def shares(self) -> tuple[np.ndarray, ...]:
        """Of each term and item the share of the item's weight in SCALE parts, rounded up, and the count; their least sums in a leak; cells of a run.

        A copy may lack the heaviest of the words that COPY lets go, a paraphrase all but EVIDENCE.
        """
        place = {w: k for k, w in enumerate(self.vocabulary.to_pylist())}
        out = np.zeros((len(self.vocabulary) + 1, len(self.items)), np.uint16 if max(len(x.words) for x in self.items) < 50_000 else np.int32)
        counts, few = np.zeros_like(out), np.zeros(len(self.items))
        least, cells = np.zeros(len(self.items), np.int32), np.zeros(len(self.items), np.int64)
        for k, x in enumerate(self.items):
            at = np.array([place[w] for w in x.words])
            w, n = self.weight[at], len(at)
            term, count = np.unique(at, return_counts=True)
            out[term, k] = np.ceil(SCALE * self.weight[term] * count / w.sum())
            counts[term, k] = count
            few[k] = (PARAPHRASE if x.answer else COPY) * n - 1e-9
            copy = np.sort(w)[: int(np.ceil(COPY * n - 1e-9))].sum() / w.sum()
            least[k] = int(SCALE * (min(copy, EVIDENCE) if x.answer else copy))
            cells[k] = -(-int(np.ceil(SPAN * n)) // STRIDE) + 1
        return out, counts, least, few, cells

    def overlaps(self, texts: pa.Array, shares: tuple[np.ndarray, ...], terms: tuple | None = None) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, low and high (word places) of each series of runs that hold the least sum of an item."""
        row, number, held = self.cells(texts, terms)
        part, counts, least, few, size = shares
        if not len(row):
            return
        end, wide = np.searchsorted(row, row, "right"), int(size.max())
        order = np.argsort(size, kind="stable")
        dtype = part.dtype if wide * (SCALE + int(counts.sum(axis=0).max())) < 1 << 16 else np.int32  # differences hold if sums wrap
        for first in range(0, len(order), BLOCK_COLUMNS):
            block = order[first : first + BLOCK_COLUMNS]
            own, bounds = np.ascontiguousarray(part[:, block]), least[block].astype(dtype)
            cuts = np.append(np.flatnonzero(np.diff(size[block], prepend=-1)), len(block)).tolist()
            for low in range(0, len(row), BLOCK_CELLS):
                some = held[low : low + BLOCK_CELLS + wide - 1]
                total = np.zeros((len(some) + wide + 1, len(block)), dtype)
                sums = total[1 : len(some) + 1]
                for j in range(STRIDE):
                    real = some[:, j] < len(part) - 1
                    n = int(np.count_nonzero(real))
                    if n > 0.7 * len(some):
                        sums += own[some[:, j]]
                    elif n:
                        on = np.flatnonzero(real)
                        sums[on] += own[some[on, j]]
                    else:
                        break
                np.cumsum(total, axis=0, dtype=dtype, out=total)
                here = min(BLOCK_CELLS, len(row) - low)
                for x, y in zip(cuts, cuts[1:]):
                    n = int(size[block[x]])
                    item, p = np.nonzero((total[n : n + here, x:y] - total[:here, x:y] >= bounds[x:y]).T)  # a run may reach into the next text here
                    p, item = p + low, block[x + item]
                    sure = np.zeros(len(p), bool)
                    step = max(1, 1_000_000 // (n * STRIDE))
                    for k in range(0, len(p), step):  # words of several cells count once now
                        at, i = p[k : k + step, None] + np.arange(n), item[k : k + step, None]
                        terms = np.where((at < end[at[:, :1]])[:, :, None], held[np.minimum(at, len(row) - 1)], len(part) - 1).reshape(len(at), -1)
                        terms.sort(axis=1)
                        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = len(part) - 1
                        sure[k : k + step] = (part[terms, i].sum(axis=1, dtype=np.int64) >= least[i[:, 0]]) & (counts[terms, i].sum(axis=1, dtype=np.int64) >= few[i[:, 0]])
                    item, p = item[sure], p[sure]
                    if not len(p):
                        continue
                    start = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (row[p[1:]] != row[p[:-1]])))
                    last = np.append(start[1:], len(p)) - 1
                    for i, a, b in zip(item[start].tolist(), p[start].tolist(), p[last].tolist()):
                        # a series may come from the block of cells before
                        yield int(row[a]), i, max(0, int(number[a]) - (wide if a == low else 0)) * STRIDE, (int(number[b]) + n) * STRIDE

    def cosine(self, texts: pa.Array, item: int, low: int, high: int) -> float:
        """The best cosine of an item and a passage that starts in low to high of the first text."""
        _, number, start, t, v = self.passages(texts)
        best = 0.0
        for k, z in self.project(start, t, v, self.basis):
            at = number[k : k + len(z)] * STRIDE
            best = max(best, float((z @ self.coords[item])[(at > low - WINDOW) & (at < high)].max(initial=0.0)))
        return best

    def passages(self, texts: pa.Array, least: float = 0.0, terms: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and number of each passage that can have a cosine of least with an item; entry starts, terms, values.

        The cosine is at most the share of benchmark words, and the sum of each word's value and its highest in an item.
        """
        row, pos, term = terms or self.terms(texts)
        none = np.zeros(0, np.int64)
        if not len(row):
            return none, none, none, none, np.zeros(0, np.float32)
        wide = int(pos.max()) // STRIDE + 2
        code = row * np.int64(wide) + pos // STRIDE  # cells ascend
        fresh = np.append(True, code[1:] != code[:-1])
        cells, at = code[fresh], np.cumsum(fresh) - 1
        nxt = np.append(cells[1:] == cells[:-1] + 1, False)

        def joined(x: np.ndarray) -> np.ndarray:
            """Of each passage, its own cell and the next."""
            return x + np.where(nxt, np.append(x[1:], 0), 0)

        idf = self.idf
        outside = joined(np.bincount(at, term < 0, len(cells)))
        on = np.flatnonzero((term >= 0) & (idf[term] > 0))
        k, t = at[on], term[on]
        # no less than the mass of distinct words
        most = joined(np.bincount(k, idf[t] ** 2, len(cells)))
        may = (most > 0) & (most >= least * least * (most + outside * self.other**2))
        own, before = may[k], np.append(False, nxt[:-1] & may[:-1])[k]
        pair = np.unique(np.concatenate([k[own], k[before] - 1]) * np.int64(len(idf)) + np.concatenate([t[own], t[before]]))
        p, t = np.divmod(pair, len(idf))
        v = idf[t]
        mass = np.bincount(p, v * v, len(cells))
        length = np.sqrt(mass + outside * self.other**2)
        keep = (mass > 0) & (np.sqrt(mass) >= least * length)
        if least and self.most is not None:
            keep &= np.bincount(p, v * self.most[t], len(cells)) >= (least - 1e-4) * length
        sel = keep[p]
        p, t, v = p[sel], t[sel], (v / np.where(length > 0, length, 1)[p])[sel]
        own, start = np.unique(p, return_index=True)
        return cells[own] // wide, cells[own] % wide, start, t, v.astype(np.float32)

    def project(self, start: np.ndarray, t: np.ndarray, v: np.ndarray, basis: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Coordinates of passages, some thousands at a time."""
        ends = np.append(start[1:], len(t))
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(ends, start[i] + 20_000, "right")))
            a, b = start[i], ends[j - 1]
            yield i, np.add.reduceat(v[a:b, None] * basis[t[a:b]], start[i:j] - a)
            i = j


_SUMS = [f"s{k}" for k in range(EXTRA_RANK)]
_TERM, _TERM_ARROW = arrow_schema("space int, term int, n long, " + ", ".join(f"{c} long" for c in _SUMS))
_HIT, _HIT_ARROW = arrow_schema("key long, doc_id long, space int, item int, low int, high int, cosine double")
_FOUND, _FOUND_ARROW = arrow_schema("key long, doc_id long, item_id long, cosine double, lcs double, answer double")


def _signs(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of the sketch and sign of each cell, by hash of its row's key and its number."""
    code = key.astype(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    code = (code ^ code >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(40)).astype(np.int64) % EXTRA_RANK, np.where(code >> np.uint64(33) & np.uint64(1), 1.0, -1.0)


def _frequencies(own: DataFrame, spaces: list[Space]) -> list[tuple[np.ndarray, int]]:
    """For each space, in how many cells of STRIDE words each of its words occurs, and the number of cells; sets the sketch."""
    vocabularies = [x.vocabulary for x in spaces]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light = [Space.of_words(v) for v in vocabularies]
        out, cells = [np.zeros(len(v), np.int64) for v in vocabularies], 0
        sums = [np.zeros((len(v), EXTRA_RANK), np.int64) for v in vocabularies]
        for batch in portions(batches, PORTION_BYTES):
            for k, space in enumerate(light):
                row, number, held = space.cells(batch.column("text"))
                cells += len(row) if k == 0 else 0
                cell, at = np.nonzero(held < len(out[k]))
                term = held[cell, at].astype(np.int64)
                out[k] += np.bincount(term, minlength=len(out[k]))
                col, sign = _signs(batch.column("key").to_numpy()[row], number)
                place = term * EXTRA_RANK + col[cell]
                if len(place) < sums[k].size:
                    place, back = np.unique(place, return_inverse=True)
                    sums[k].reshape(-1)[place] += np.bincount(back, sign[cell]).astype(np.int64)
                else:
                    sums[k] += np.bincount(place, sign[cell], sums[k].size).astype(np.int64).reshape(sums[k].shape)
        for k, n in enumerate(out):
            on = np.flatnonzero(n)
            yield arrow_batch(_TERM_ARROW, np.full(len(on) + 1, k, np.int32), np.append(on, -1).astype(np.int32), np.append(n[on], cells), *(np.append(x, 0) for x in sums[k][on].T))

    df, cells = [np.zeros(len(v)) for v in vocabularies], 0
    for space in spaces:
        space.sketch = np.zeros((len(space.vocabulary), EXTRA_RANK))
    got = own.mapInArrow(count, _TERM).groupBy("space", "term").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)]).toArrow()  # a row for each word of the spaces
    place, term, n = (got.column(c).to_numpy() for c in ("space", "term", "n"))
    sums = np.stack([got.column(c).to_numpy() for c in _SUMS], axis=1)
    for k, space in enumerate(spaces):
        on = (place == k) & (term >= 0)
        df[k][term[on]], space.sketch[term[on]] = n[on], sums[on]
        cells = int(n[(place == k) & (term < 0)].sum())
    return [(x, cells) for x in df]


def fit(own: DataFrame, spaces: list[Space], passages: int) -> None:
    """Randomised SVD of the TF-IDF matrix of each space's items and of all passages; sets basis and item coordinates.

    Rows of a sketch are sums of weighted cells with random signs, so their products are those of all cells but for chance.
    """
    if new := [x for x in spaces if x.sketch is None]:
        _frequencies(own, new)
    for space in spaces:
        items, rows = space.vectors(), (space.sketch * space.idf[:, None]).T / np.sqrt(max(1, passages))
        seed = np.linalg.qr(np.concatenate([items.T, rows.T], axis=1))[0]
        near, far = items @ seed, rows @ seed
        values, turn = np.linalg.eigh(far.T @ far + near.T @ near)
        keep = values > 1e-9 * max(values.max(initial=0.0), 1e-30)
        space.basis = (seed @ turn[:, keep]).astype(np.float32)
        coords = items @ space.basis
        norm = np.linalg.norm(coords, axis=1, keepdims=True)
        space.coords = np.where(norm > 1e-6, coords / np.where(norm > 0, norm, 1), 0).astype(np.float32)


def candidates(own: DataFrame, spaces: list[Space]) -> DataFrame:
    """Documents and items that may leak: key, doc_id, space and item (places), low and high (word places), cosine.

    Passages at COSINE or more, and runs of words that hold enough of an item's weight (without cosine).
    """
    sent = own.sparkSession.sparkContext.broadcast([(x, x.shares()) for x in spaces])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION_BYTES):
            for place, (space, shares) in enumerate(sent.value):
                terms = space.terms(batch.column("text"))
                row, number, start, t, v = space.passages(batch.column("text"), COSINE, terms)
                best: dict[tuple[int, int], list] = {}
                for k, z in space.project(start, t, v, space.basis):
                    cos = z @ space.coords.T
                    for p, item in zip(*np.nonzero(cos >= COSINE)):
                        at, c = int(number[k + p]) * STRIDE, float(cos[p, item])
                        held = best.setdefault((int(row[k + p]), int(item)), [])
                        held.append((at, c))
                rows, docs = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
                out = [(rows[r], docs[r], place, item, low, high, None) for r, item, low, high in space.overlaps(batch.column("text"), shares, terms)]
                for (r, item), places in best.items():
                    n, places = len(space.items[item].words), sorted(places)
                    low, high, c = places[0][0], places[0][0], places[0][1]
                    for at, x in places[1:] + [(1 << 60, 0.0)]:
                        if at > high + WINDOW + 2 * n:  # too far to be of one occurrence
                            out.append((rows[r], docs[r], place, item, max(0, low - n), high + WINDOW + n, c))
                            low, c = at, x
                        high, c = at, max(c, x)
                if out:
                    yield arrow_batch(_HIT_ARROW, *([x[k] for x in out] for k in range(7)))

    return own.mapInArrow(search, _HIT)


def judge(own: DataFrame, hits: DataFrame, spaces: list[Space]) -> DataFrame:
    """Leaks among candidates, by longest common subsequence and answer, read from the documents' own words.

    A document's text goes to its judge once, with all its candidates.
    """
    bitmap = key_bitmap(hits.select("key").distinct(), "key")
    texts = maybe_in(own, F.col("key"), bitmap).dropDuplicates(["key", "doc_id"]).alias("o")
    hit = F.struct("space", "item", (-F.coalesce("cosine", F.lit(-1.0))).alias("least"), "low", "high", "cosine")
    met = hits.distinct().groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(hit)).alias("hits")).alias("h")
    met = met.join(texts, (F.col("h.key") == F.col("o.key")) & F.col("h.doc_id").eqNullSafe(F.col("o.doc_id"))).select("h.key", "h.doc_id", "h.hits", "o.text")
    sent = own.sparkSession.sparkContext.broadcast([(x, dict(zip(x.vocabulary.to_pylist(), x.weight.tolist()))) for x in spaces])

    def informed(weight: dict[str, float], words: list[str], part: list[str]) -> bool:
        own = np.array([weight[w] for w in words])
        return heaviest_subsequence(words, own, part) >= EVIDENCE * own.sum() - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            out = []
            for k in range(0, len(batch), JUDGED):  # the pattern is compiled once for so many
                some = batch.slice(k, JUDGED)
                row, _, flat = words_of(some.column("text"))
                first, last = np.searchsorted(row, np.arange(len(some))), np.searchsorted(row, np.arange(len(some)), "right")
                for j, (key, doc, hits) in enumerate(zip(*(some.column(c).to_pylist() for c in ("key", "doc_id", "hits")))):
                    done = None
                    for h in hits:
                        place, item, low, high, cosine = h["space"], h["item"], h["low"], h["high"], h["cosine"]
                        if cosine is None and done == (place, item):  # a leak by its cosine
                            continue
                        space, weight = sent.value[place]
                        x, part = space.items[item], flat[first[j] + low : min(first[j] + high, last[j])].to_pylist()
                        lcs = common_subsequence(x.words, part) / len(x.words)
                        answer = common_subsequence(x.answer, part) / len(x.answer) if x.answer else 0.0
                        if lcs >= COPY or lcs >= PARAPHRASE and answer >= ANSWER and (cosine is not None or informed(weight, x.words, part)):
                            if cosine is None:
                                cosine = space.cosine(some.column("text")[j : j + 1], item, low, high)
                            out.append((key, doc, x.item_id, cosine, lcs, answer))
                            done = place, item
            yield arrow_batch(_FOUND_ARROW, *([y[k] for y in out] for k in range(6)))

    found = met.mapInArrow(run, _FOUND)
    return found.groupBy("key", "doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks: key, doc_id, item_id, cosine, lcs, answer."""
    bound_batches(docs.sparkSession)
    own, out = keyed(docs), None
    for several in batched(blocks_of(items_of(benchmark)), SCAN_BLOCKS):
        spaces = [Space(items) for items in several]
        counted = _frequencies(own, spaces)
        cells = counted[0][1]
        if not cells:
            break
        for space, (df, _) in zip(spaces, counted):
            space.weigh(df, cells)
        fit(own, spaces, cells)
        hits = cut(candidates(own, spaces), "leak-candidates")
        found = cut(judge(own, hits, spaces), "leaks")
        discard(hits)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _FOUND)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item; columns stay, whatever their names."""
    gone = cut(leaks(docs, benchmark).select("key", "doc_id").distinct(), "leaking")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    maybe, sure = split_by_bitmap(own, F.col("key"), key_bitmap(gone, "key"))  # only these rows are shuffled
    left = maybe.alias("o").join(gone.withColumn("gone", F.lit(True)).alias("g"), (F.col("o.key") == F.col("g.key")) & F.col("o.doc_id").eqNullSafe(F.col("g.doc_id")), "left").where("gone IS NULL").select("o.*")
    return left.unionByName(sure).select("whole.*")
