"""Scoring texts by the marginal likelihood of a subword lattice.

A public vocabulary gives the pieces and their scores. Those at hand are ordered by rank, so that a probability is the
inverse of the rank; ``prior_score`` is by these as they are. Every segmentation of a word into pieces counts: a forward
recursion in log space sums them, a backward one gives expected piece counts, and a few rounds of expectation
maximisation over the corpus's word counts fit the scores that ``score`` is by. Pieces never cross white space, so the marginal
probability of a text is the product of those of its words and of the end. Bytes are pieces too, so no word is
impossible.

The word table is counted over all documents and summed in shuffles; it grows with the corpus and is never broadcast.
The HEAD_WORDS most frequent words at most go to all tasks, all others meet their documents in a join.

Results for odd input: a null text is empty and has one token, its end; equal rows are scored apart; an empty table
gives an empty result; without training rows counts are 0; words of any length are scored; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut, discard, gathered, id_remainder

ROUNDS = 2
HEAD_WORDS = 400_000
PORTION_BYTES = 8_000_000
#: Words that go through the recursions together; fewer make it slow.
WORD_BYTES = 400_000
#: Words of over so many bytes go through the recursion one by one.
LONG_WORD = 48
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces in lower case with a space for the word mark, and log probabilities after their ranks.

    A rank-ordered vocabulary has minus the rank as its score; probabilities fall as its inverse. Special pieces, and
    those that lower-cased text can't hold, are left out; each byte is a piece of the last rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        text = sp.id_to_piece(i).replace("▁", " ")
        piece = text.encode()
        if " " in text[1:] or text == "" or any("A" <= c <= "Z" for c in text):
            continue
        found[piece] = 1.0 / (3.0 - sp.get_score(i)) if sp.get_score(i) <= 0 else 1.0
    for b in range(256):
        found.setdefault(bytes([b]), 1.0 / (3.0 + sp.get_piece_size()))
    pieces = sorted(found, key=lambda p: (len(p), p))
    weight = np.array([found[p] for p in pieces])
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """Forward and backward recursions over all segmentations of many words."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        size = np.array([len(p) for p in pieces])
        self.longest = int(size.max())
        self.power = np.ones(self.longest + 1, np.uint64)
        for k in range(1, self.longest + 1):
            self.power[k] = np.uint64((int(self.power[k - 1]) * int(_BASE)) % 2**64)
        self.tables: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.longest + 1)]
        for n in range(1, self.longest + 1):
            ids = np.flatnonzero(size == n)
            if not len(ids):
                continue
            grid = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
            key = self._prefix(grid)[:, -1]
            while len(ids):  # one level of slots after another until each piece has its own
                slot = (key * _MIX) >> np.uint64(48)
                _, first = np.unique(slot, return_index=True)
                own, keys = np.full(1 << 16, -1, np.int32), np.zeros(1 << 16, np.uint64)
                own[slot[first]], keys[slot[first]] = ids[first], key[first]
                self.tables[n].append((own, keys))
                rest = np.setdiff1d(np.arange(len(ids)), first)
                ids, key = ids[rest], key[rest]

    def _prefix(self, grid: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grid), grid.shape[1] + 1), np.uint64)
        for k in range(grid.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + (grid[:, k].astype(np.uint64) + np.uint64(1))
        return out

    def _find(self, prefix: np.ndarray, i: int, n: int) -> np.ndarray:
        """Piece of bytes i to i + n of each word, or -1."""
        key = prefix[:, i + n] - prefix[:, i] * self.power[n]
        slot = ((key * _MIX) >> np.uint64(48)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        for own, keys in self.tables[n]:
            hit = keys[slot] == key
            out = np.where(hit & (own[slot] >= 0), own[slot], out)
        return out

    def _edges(self, grid: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        prefix, length = self._prefix(grid), grid.shape[1]
        return {(i, n): self._find(prefix, i, n) for i in range(length) for n in range(1, min(self.longest, length - i) + 1) if self.tables[n]}

    def _forward(self, edges: dict, rows: int, length: int, logp: np.ndarray | None = None) -> list[np.ndarray]:
        logp = np.append(self.logp if logp is None else logp, -np.inf)  # index -1: no piece
        alpha = [np.zeros(rows)]
        for j in range(1, length + 1):
            x = np.stack([alpha[j - n] + logp[edges[j - n, n]] for n in range(1, min(self.longest, j) + 1) if (j - n, n) in edges])
            top = x.max(axis=0)
            alpha.append(top + np.log(np.exp(x - top).sum(axis=0)))
        return alpha

    def log_marginal(self, grid: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
        """Log probability of each row of bytes over all segmentations, by the own scores and by others of the same pieces."""
        edges = self._edges(grid)
        return [self._forward(edges, *grid.shape, logp)[-1] for logp in (self.logp, *others)]

    def expected(self, grid: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Adds each piece's expected count to out."""
        edges, (rows, length) = self._edges(grid), grid.shape
        alpha = self._forward(edges, rows, length)
        logp = np.append(self.logp, -np.inf)
        beta: list[np.ndarray] = [np.zeros(0)] * length + [np.zeros(rows)]
        for i in range(length - 1, -1, -1):
            sizes = [n for n in range(1, min(self.longest, length - i) + 1) if (i, n) in edges]
            x = np.stack([beta[i + n] + logp[edges[i, n]] for n in sizes])
            top = x.max(axis=0)
            e = np.exp(x - top)
            total = e.sum(axis=0)
            beta[i] = top + np.log(total)
            here = np.exp(alpha[i] + beta[i] - alpha[length]) * weight / total
            for n, y in zip(sizes, e):
                ids = edges[i, n]
                on = ids >= 0
                out += np.bincount(ids[on], (y * here)[on], len(out))

    def groups(self, words: pa.Array, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, bytes) of words of equal length, each with the word mark before it."""
        raw = pc.cast(words, pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], np.arange(1, int(size.max(initial=0)) + 2))
        for n in range(1, int(size.max(initial=0)) + 1) if len(cuts) <= 4096 else np.unique(size).tolist():
            at = order[np.searchsorted(size[order], n) : np.searchsorted(size[order], n, "right")] if len(cuts) > 4096 else order[cuts[n - 1] : cuts[n]]
            step = max(1, most // (n + 1))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                grid = np.empty((len(part), n + 1), np.uint8)
                grid[:, 0] = 32
                grid[:, 1:] = data[offsets[part][:, None] + np.arange(n)]
                yield part, grid

    def long_marginal(self, word: bytes, logp: np.ndarray | None = None) -> float:
        """As log_marginal for one word of any length, in time in proportion to it."""
        return self._long_forward(word, logp)[-1]

    def _long_forward(self, word: bytes, logp: np.ndarray | None = None) -> list[float]:
        place = {p: k for k, p in enumerate(self.pieces)} if not hasattr(self, "_place") else self._place
        self._place = place
        alpha, logp = [0.0], self.logp if logp is None else logp
        for j in range(1, len(word) + 1):
            x = [alpha[j - n] + logp[k] for n in range(1, min(self.longest, j) + 1) if (k := place.get(word[j - n : j])) is not None]
            top = max(x)
            alpha.append(top + math.log(sum(math.exp(v - top) for v in x)))
        return alpha

    def long_expected(self, word: bytes, weight: float, out: np.ndarray) -> None:
        """As expected for one word of any length, in time in proportion to it."""
        alpha, length = self._long_forward(word), len(word)
        beta = [0.0] * (length + 1)
        for i in range(length - 1, -1, -1):
            at = [(k, beta[i + n] + self.logp[k]) for n in range(1, min(self.longest, length - i) + 1) if (k := self._place.get(word[i : i + n])) is not None]
            top = max(v for _, v in at)
            beta[i] = top + math.log(sum(math.exp(v - top) for _, v in at))
            for k, v in at:
                out[k] += weight * math.exp(alpha[i] + v - alpha[length])

    def learn(self, words: pa.Array, weight: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected piece counts of words of any length to out."""
        for at, grid in self.groups(words):
            if grid.shape[1] <= LONG_WORD or len(grid) >= 32 and grid.shape[1] <= 16 * LONG_WORD:
                self.expected(grid, weight[at], out)
            else:
                for g, w in zip(grid, weight[at].tolist()):
                    self.long_expected(g.tobytes(), w, out)

    def score(self, words: pa.Array, *others: np.ndarray) -> list[np.ndarray]:
        """Log probabilities of words of any length, by the own scores and by others of the same pieces."""
        out = [np.zeros(len(words)) for _ in range(1 + len(others))]
        for at, grid in self.groups(words):
            if grid.shape[1] <= LONG_WORD:
                got = self.log_marginal(grid, *others)
            else:
                got = [[self.long_marginal(g.tobytes(), logp) for g in grid] for logp in (self.logp, *others)]
            for o, x in zip(out, got):
                o[at] = x
        return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and word of each token of lower-cased texts, without ends."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(pieces)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full, min_count=0).as_py():
        return row, flat
    return row[full.to_numpy(zero_copy_only=False)], flat.filter(full)


_COUNT, _COUNT_ARROW = arrow_schema("word string, c long")
_EM, _EM_ARROW = arrow_schema("piece int, n double")
_WORD, _WORD_ARROW = arrow_schema("word string, c long, logz double, prior double")
_ROW, _ROW_ARROW = arrow_schema("rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, logz double, prior double, word string, tf long")


class Model:
    """Fitted scores and the word table: word, c (count in training rows), logz and prior (natural logs of its probability
    by the fitted scores and by those of the vocabulary)."""

    def __init__(self, lattice: Lattice, log_end: float, prior_end: float, words: DataFrame, train_tokens: int, train_types: int, end_count: int):
        self.lattice, self.log_end, self.prior_end, self.words = lattice, log_end, prior_end, words
        self.train_tokens, self.train_types, self.end_count = train_tokens, train_types, end_count


def _own(docs: DataFrame, folds: int) -> DataFrame:
    held = F.coalesce(id_remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))


def train(docs: DataFrame, vocabulary_path: str, folds: int = 10, rounds: int = ROUNDS) -> Model:
    """Counts all words, fits piece scores to those of rows whose crc32(doc_id) modulo folds isn't 0, scores all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, PORTION_BYTES):  # the more text at once, the fewer words to shuffle
            row, flat = words_of(batch.column("text"))
            coded = flat.dictionary_encode()
            in_train = ~batch.column("held").to_numpy(zero_copy_only=False)
            c = np.bincount(coded.indices.to_numpy(), in_train[row].astype(np.float64), len(coded.dictionary))
            yield arrow_batch(_COUNT_ARROW, coded.dictionary, c.astype(np.int64))

    bound_batches(docs.sparkSession)
    own = _own(docs, folds)
    words = cut(own.mapInArrow(count, _COUNT).groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = own.where("NOT held").count()
    pieces, logp = vocabulary(vocabulary_path)
    total = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    tokens, types = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    end_share = (ends + 1.0) / (tokens + 2.0)
    prior, log_share, prior_end = logp, math.log1p(-end_share), math.log(end_share)
    logp = prior + log_share
    for _ in range(rounds):
        lattice = Lattice(pieces, logp)

        def expect(batches: Iterator[pa.RecordBatch], lattice: Lattice = lattice) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(lattice.pieces))
            for batch in gathered(batches, WORD_BYTES, "word"):
                c = batch.column("c").to_numpy().astype(np.float64)
                lattice.learn(batch.column("word"), c, out)
            on = np.flatnonzero(out)
            yield arrow_batch(_EM_ARROW, on.astype(np.int32), out[on])

        got = words.where("c > 0").mapInArrow(expect, _EM).groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece
        n = np.full(len(pieces), 0.05)
        for r in got:
            n[r["piece"]] += r["n"]
        end_share = (ends + 0.5) / (ends + 0.5 + n.sum())
        logp = np.log(n / n.sum()) + math.log1p(-end_share)
    lattice = Lattice(pieces, logp)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, WORD_BYTES, "word"):
            yield arrow_batch(_WORD_ARROW, batch.column("word"), batch.column("c"), *lattice.score(batch.column("word"), prior + log_share))

    scored = cut(words.mapInArrow(score, _WORD), "word-scores")
    discard(words)
    return Model(lattice, math.log(end_share), prior_end, scored, tokens, types, ends)


def _head(words: DataFrame, most: int) -> pa.Table:
    """The most frequent words, most at most: all of the upper classes of frequency that fit."""
    kind = F.floor(F.log2(F.col("c") + 1) * 16).cast("int")
    sizes = {r["k"]: r["n"] for r in words.where("c > 0").groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64()), "logz": pa.array([], pa.float64()), "prior": pa.array([], pa.float64())})
    return words.where(kind >= least).select("word", "c", "logz", "prior").toArrow()


def score(docs: DataFrame, model: Model, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and prior_score (log10 probabilities) of each row.

    score is by the fitted scores, prior_score by those that the vocabulary has.
    """
    spark = docs.sparkSession
    head = _head(model.words, HEAD_WORDS)
    sent = spark.sparkContext.broadcast((head.column("word").combine_chunks(), head.column("c").to_numpy(), head.column("logz").to_numpy(), head.column("prior").to_numpy()))
    bottom = math.log10(model.train_tokens + 0.1 * (model.train_types + 1)) if model.train_types else math.log10(0.1)
    end_base, end_known, log_end, prior_end = math.log10(model.end_count + 0.1) - bottom, int(model.end_count > 0), model.log_end, model.prior_end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, logz, prior = sent.value
        base_of = np.log10(np.append(c, 0) + 0.1) - bottom
        logz_of, prior_of = np.append(logz, 0.0), np.append(prior, 0.0)
        rid = TaskContext.get().partitionId() << 36
        for batch in gathered(batches, PORTION_BYTES):
            n = len(batch)
            row, flat = words_of(batch.column("text"))
            coded = flat.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), len(known)).to_numpy()
            code = coded.indices.to_numpy()
            token = place[code]
            in_head = token < len(known)
            r, t = row[in_head], token[in_head]
            ids = np.arange(rid, rid + n)
            rid += n
            none = pa.nulls(n, pa.int64())
            yield arrow_batch(
                _ROW_ARROW, ids, batch.column("doc_id"), batch.column("held"), np.bincount(row, minlength=n) + 1, np.bincount(r, minlength=n) + end_known,
                np.bincount(r, base_of[t], n) + end_base, np.bincount(r, logz_of[t], n) + log_end, np.bincount(r, prior_of[t], n) + prior_end, pa.array(["\n" + str(i) for i in ids.tolist()]), none,
            )
            pair, tf = np.unique(row[~in_head] * np.int64(len(coded.dictionary) + 1) + code[~in_head], return_counts=True)
            r, w = np.divmod(pair, len(coded.dictionary) + 1)
            k = len(pair)
            yield arrow_batch(_ROW_ARROW, ids[r], pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), *[pa.nulls(k, pa.int64())] * 2, *[pa.nulls(k, pa.float64())] * 3, coded.dictionary.take(pa.array(w)), tf)

    rows = _own(docs, folds).mapInArrow(run, _ROW).alias("d")
    # a document's own row has a key that is no word, so it passes the join alone and no key is hot
    met = rows.join(model.words.alias("w"), F.col("d.word") == F.col("w.word"), "left")
    tf, c = F.col("d.tf"), F.coalesce(F.col("w.c"), F.lit(0))
    tail = F.when(tf.isNotNull(), tf * (F.log10(c + F.lit(0.1)) - F.lit(bottom)))
    got = met.groupBy("d.rid").agg(
        F.max("d.doc_id").alias("doc_id"), F.max("d.held_out").alias("held_out"), F.sum("d.n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("d.n_known", F.when(c > 0, tf), F.lit(0))).alias("n_known"), F.sum(F.coalesce("d.base", tail)).alias("base_score"), F.sum(F.coalesce("d.logz", tf * F.col("w.logz"))).alias("z"), F.sum(F.coalesce("d.prior", tf * F.col("w.prior"))).alias("z0"),
    )
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", (F.col("z") * F.lit(math.log10(math.e))).alias("score"), (F.col("z0") * F.lit(math.log10(math.e))).alias("prior_score"))


def score_all(spark: SparkSession, docs: DataFrame, vocabulary_path: str, folds: int = 10) -> DataFrame:
    return score(docs, train(docs, vocabulary_path, folds), folds)
