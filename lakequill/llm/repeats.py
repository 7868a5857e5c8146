"""Removal of repeated passages: every word under a window of SIZE words that also starts earlier goes.

Windows are found without shuffling texts or all windows:

1. Anchors. Each window has an anchor, the run of GRAM words with the lowest hash in it, which depends on the window alone.
   Neighbouring windows with the same anchor are a stretch, of SIZE + SIZE - GRAM words at most. Anchors are counted over
   all documents; a window whose anchor occurs once has no copy.
2. Confirmed stretches. Documents are read again; stretches at recurring anchors are known by a cryptographic digest of 128
   bits of their words. Equal ones are counted, and the first one in order stands for all. So a passage that stands in a
   third of all rows is one row from here on. The text around such stretches is kept once, as segments.
3. Automata. The distinct stretches are dealt into shards by anchor, so equal windows meet. A shard compiles the windows of
   its stretches into an Aho-Corasick automaton and streams the stretches through it in order, which locates every
   occurrence: one behind the first of its window is a repeat. An automaton's letters stand for BLOCK words each; a text
   goes through it once for each of the BLOCK phases. An anchor with more stretches than a shard holds is dealt into
   several ones, and what is first in each of these goes through a second turn, dealt by the window itself.
4. Marks. A stretch that isn't the first of its equals is a repeat as a whole, the first one has the repeats that its shard
   has located. Marks are joined to documents by key; a bitmap of keys tells documents without marks, which aren't moved.

The order of occurrences is by doc_id, then by start. No task gets all rows of a stretch, an anchor or a window: counts are
aggregated before they are shuffled, marks of stretches with over LARGE occurrences are broadcast (MOST_LARGE at most), and
shards are bounded by SHARD. Sent to all tasks: a bitmap of 0.5 to 16 MiB, which only saves work.

Results for odd input: null, empty and blank texts have no words and the digest of nothing; with fewer than SIZE words
nothing is removed; rows of one doc_id are one document, whose windows at the same place aren't earlier than each other, so
repeated rows keep their first windows alike; null ids come last; texts and words of any length are taken whole; an empty
table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut, discard, key_bitmap, portions, row_key, split_by_bitmap
from .neardup import _mix, word_hashes

SIZE, GRAM = 20, 8
#: Words that one letter of an automaton stands for; it has to divide SIZE, else a letter is a word.
BLOCK = 10
#: Signs for each digit of a letter.
RADIX = 64
PORTION_BYTES = 2_000_000
#: Windows of a segment of text, and stretches of a shard, about.
SEGMENT, SHARD = 512, 5000
#: Occurrences from which a stretch's marks are broadcast; at most so many of such stretches are.
LARGE, MOST_LARGE = 10_000, 100_000
#: Stands for a null id.
LAST = (1 << 63) - 1

_ANCHOR, _ANCHOR_ARROW = arrow_schema("h long, n long")
_STRETCH, _STRETCH_ARROW = arrow_schema("id long, t long, seg int, h long, d1 long, d2 long, start int, n int, text string")
_CUT, _CUT_ARROW = arrow_schema("h long, d1 long, d2 long, hot boolean, parts long, id long, start int, text string")
_FOUND, _FOUND_ARROW = arrow_schema("d1 long, d2 long, offsets array<int>, id long, start int, text string")
_OUT, _OUT_ARROW = arrow_schema("doc_id long, n_words long, n_removed long, kept_sha256 string")


def flat_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word of a batch of texts."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(pieces).dictionary_encode()
    code = coded.indices.to_numpy()
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    keep = full[code] if len(code) else np.zeros(0, bool)
    return row[keep], word_hashes(coded.dictionary)[code[keep]]


def stretches(row: np.ndarray, h: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each stretch; windows are known by the place of their first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        g = _mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)] + np.uint64(k + 1))
    low, place = g[:n].copy(), np.arange(n)
    for k in range(1, size - gram + 1):
        less = g[k : k + n] < low  # the first of equal ones stays
        low[less] = g[k : k + n][less]
        place[less] = np.flatnonzero(less) + k
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    if not len(at):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), low[at[first]].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, PORTION_BYTES):
        _, _, h = stretches(*flat_words(batch.column("text")), size, gram)
        got, n = np.unique(h, return_counts=True)
        yield arrow_batch(_ANCHOR_ARROW, got, n)


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _stretch_rows(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each stretch at an anchor that may recur, and one with text for each segment of them."""
    for batch in portions(batches, PORTION_BYTES):
        row, h = flat_words(batch.column("text"))
        start, n, anchor = stretches(row, h, size, gram)
        place = anchor % (8 * len(bitmap))
        on = (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        start, n, anchor = start[on], n[on], anchor[on]
        if not len(start):
            continue
        of, begins = row[start], np.searchsorted(row, np.arange(len(batch)))
        local = start - begins[of]
        # segments: stretches that overlap or touch, cut every SEGMENT windows
        new = np.ones(len(start), bool)
        new[1:] = (of[1:] != of[:-1]) | (local[1:] >= local[:-1] + n[:-1] + size - 1)
        long = np.cumsum(new) - 1
        block = (local - local[np.flatnonzero(new)][long]) // SEGMENT
        new[1:] |= block[1:] != block[:-1]
        seg = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        ends = local + n + size - 1
        tails = np.append(heads[1:] - 1, len(start) - 1)
        ids, ts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
        d1, d2, texts, words, known = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], [], -1
        for s, (lo, hi) in enumerate(zip(heads.tolist(), tails.tolist())):
            if of[lo] != known:
                known = of[lo]
                words = batch.column("text")[int(known)].as_py().encode("utf-8", "surrogatepass").split()
            texts.append(b" ".join(words[local[lo] : ends[hi]]).decode("utf-8", "surrogatepass"))
            for k in range(lo, hi + 1):
                d1[k], d2[k] = _digest(b" ".join(words[local[k] : ends[k]]))
        yield arrow_batch(_STRETCH_ARROW, ids[of], ts[of], local[heads][seg].astype(np.int32), anchor, d1, d2, local.astype(np.int32), n.astype(np.int32), pa.nulls(len(start), pa.string()))
        o = of[heads]
        none = pa.nulls(len(heads), pa.int64())
        few = pa.nulls(len(heads), pa.int32())
        yield arrow_batch(_STRETCH_ARROW, ids[o], ts[o], local[heads].astype(np.int32), none, none, none, few, few, pa.array(texts, pa.string()))


def _cut_out(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The text of each first stretch out of its segment."""
    for batch in batches:
        out = [[] for _ in _CUT_ARROW]
        for text, seg, own in zip(batch.column("text").to_pylist(), batch.column("seg").to_pylist(), batch.column("own").to_pylist()):
            words = text.split(" ")
            for s in own:
                at = s["start"] - seg
                for column, v in zip(out, (s["h"], s["d1"], s["d2"], s["hot"], s["parts"], s["id"], s["start"], " ".join(words[at : at + s["n"] + size - 1]))):
                    column.append(v)
        yield arrow_batch(_CUT_ARROW, *out)


def _letters(texts: list[str], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and number of each block of step words; equal blocks, and no others, have equal numbers."""
    pieces = pc.split_pattern(pa.array(texts, pa.string()), " ")
    size = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    code = pc.list_flatten(pieces).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    width = 1
    while width < step:  # numbers of pairs of blocks, until they have step words
        more = min(width, step - width)
        pairs = code[: len(code) - more] * (code.max(initial=0) + 1) + code[more:]
        code, width = np.unique(pairs, return_inverse=True)[1].astype(np.int64), width + more
    whole = text[: len(code)] == text[step - 1 :] if len(code) else np.zeros(0, bool)
    return text[: len(code)][whole], place[: len(code)][whole], code[whole]


def locate(texts: list[str], docs: np.ndarray, starts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of the texts as text and place in it, and whether it also occurs earlier, in another one or the same.

    All windows are compiled into one automaton, through which all texts are streamed. A letter is written in digits, which
    have signs of their own for each place, so an automaton's nodes have few children and no match begins within a letter.
    """
    import ahocorasick

    step = BLOCK if size % BLOCK == 0 else 1
    text, place, code = _letters(texts, step)
    none = np.zeros(0, np.int64)
    if not len(code):
        return none, none, none.astype(bool)
    order = np.lexsort((place, place % step, text))  # each phase of a text is a line
    text, place, code = text[order], place[order], code[order]
    line = np.cumsum(np.append(0, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + step)))
    digits = 1
    while RADIX**digits <= code.max():
        digits += 1
    at = np.arange(len(code)) * digits + line  # lines end with a sign that no letter has
    signs = np.full(len(code) * digits + line[-1] + 1, RADIX * digits + 1, np.uint32)
    for d in range(digits):
        signs[at + d] = code // RADIX**d % RADIX + d * RADIX + 1
    stream = signs.astype("<u4").tobytes().decode("utf-32-le")
    letters = size // step
    ends = np.flatnonzero(line[letters - 1 :] == line[: len(line) - letters + 1]) if len(line) >= letters else none
    if not len(ends):
        return none, none, none.astype(bool)
    automaton, wide = ahocorasick.Automaton(), letters * digits
    for number, k in enumerate(at[ends].tolist()):
        automaton.add_word(stream[k : k + wide], number)  # a word that is there gets the new number
    automaton.make_automaton()
    found = np.array(list(automaton.iter(stream)), np.int64).reshape(-1, 2)
    window = np.searchsorted(at, found[:, 0] - wide + 1)
    text, place, which = text[window], place[window], found[:, 1]
    doc, start = docs[text], starts[text] + place
    ranks = np.lexsort((start, doc))
    rank = np.empty(len(ranks), np.int64)
    rank[ranks] = np.cumsum(np.append(0, (doc[ranks][1:] != doc[ranks][:-1]) | (start[ranks][1:] != start[ranks][:-1])))
    earliest = np.full(len(ends), len(rank), np.int64)
    np.minimum.at(earliest, which, rank)
    return text, place, rank > earliest[which]


def _located(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, starts = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "start"))
    return locate(table.column("text").to_pylist(), ids, starts, size)


def _shard(table: pa.Table, size: int) -> pa.Table:
    """What an automaton over a shard locates; stretches of an anchor in several shards also give their first windows."""
    text, place, again = _located(table, size)
    order = np.lexsort((place, text))
    text, place, again = text[order], place[order], again[order]
    t, p = text[again], place[again]
    heads = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, int)
    offsets = pa.ListArray.from_arrays(pa.array(np.append(heads, len(t)), pa.int32()), pa.array(p, pa.int32()))
    own = t[heads]
    d1, d2, ids, starts = (table.column(c).to_numpy() for c in ("d1", "d2", "id", "start"))
    out = [arrow_batch(_FOUND_ARROW, d1[own], d2[own], offsets, pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.string()))]
    hot = table.column("hot").to_numpy(zero_copy_only=False).astype(bool)
    on = ~again & hot[text]
    t, p = text[on], place[on]
    words = {k: table.column("text")[k].as_py().split(" ") for k in np.unique(t).tolist()}
    windows = [" ".join(words[k][o : o + size]) for k, o in zip(t.tolist(), p.tolist())]
    out.append(arrow_batch(_FOUND_ARROW, d1[t], d2[t], [[o] for o in p.tolist()], ids[t], (starts[t] + p).astype(np.int32), windows))
    return pa.Table.from_batches(out)


def _second(table: pa.Table, size: int) -> pa.Table:
    """The second turn: single windows, dealt by their words."""
    text, _, again = _located(table, size)
    on = table.take(pa.array(text[again]))
    n = len(on)
    return pa.table([on.column("d1"), on.column("d2"), on.column("offsets").cast(pa.list_(pa.int32())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_FOUND_ARROW)


def _kept(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts and the digest of what is left of each text under its marks (start << 16 | windows)."""
    for batch in portions(batches, PORTION_BYTES):
        out = [[], [], []]
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks")):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            gone = 0
            n = len(words)
            if marks.is_valid and len(marks):
                m = marks.values.to_numpy(zero_copy_only=False)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, m >> 16, 1)
                np.add.at(edge, (m >> 16) + (m & 0xFFFF) + size - 1, -1)
                off = np.cumsum(edge[:-1]) > 0
                gone = int(off.sum())
                words = [words[k] for k in np.flatnonzero(~off).tolist()]
            out[0].append(n)
            out[1].append(gone)
            out[2].append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield arrow_batch(_OUT_ARROW, batch.column("doc_id"), *out)


def marks(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> tuple[DataFrame, list[DataFrame]]:
    """id, t (a hash of the text) and the marks of each document with a repeat, and the tables to discard afterwards."""
    spark = docs.sparkSession
    own = docs.select("id", "t", "text")
    counted = own.select("text").mapInArrow(lambda b: _anchors(b, size, gram), _ANCHOR)
    recurring = cut(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors")
    bitmap = key_bitmap(recurring, "h")
    discard(recurring)
    found = cut(own.mapInArrow(lambda b: _stretch_rows(b, bitmap, size, gram), _STRETCH), "stretches")
    members, segments = found.where("text IS NULL").drop("text"), found.where("text IS NOT NULL").select("id", "t", "seg", "text")
    # equal stretches, the first of each, and how many different ones an anchor has
    first = F.min(F.struct("id", "start", "t", "seg")).alias("first")
    classes = cut(members.groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("m"), F.min("h").alias("h"), F.min("n").alias("n")), "classes")
    per = cut(classes.groupBy("h").agg(F.sum("m").alias("all"), F.count(F.lit(1)).alias("k")).where("all > 1").select("h", "k"), "anchor-sizes")
    often = cut(per.where(F.col("k") > SHARD).orderBy(F.col("k").desc(), "h").limit(MOST_LARGE), "large-anchors")
    some = per.join(F.broadcast(often.select("h")), "h", "left_anti")
    live = classes.join(F.broadcast(often), "h").unionByName(classes.join(F.broadcast(often.select("h")), "h", "left_anti").join(some, "h"))
    live = live.select("h", "d1", "d2", "n", (F.col("k") > SHARD).alias("hot"), F.ceil(F.col("k") / SHARD).alias("parts"), "first.*")
    per_segment = live.groupBy("id", "t", "seg").agg(F.collect_list(F.struct("h", "d1", "d2", "hot", "parts", "id", "start", "n")).alias("own"))
    texts = segments.dropDuplicates(["id", "t", "seg"]).join(per_segment, ["id", "t", "seg"]).select("seg", "text", "own")
    runs = cut(texts.mapInArrow(lambda b: _cut_out(b, size), _CUT), "firsts")
    shards = max(1, -(-runs.count() // SHARD))
    dealt = F.when(F.col("hot"), F.xxhash64("h", F.pmod("d1", "parts"))).otherwise(F.xxhash64("h"))
    located = cut(runs.withColumn("shard", F.pmod(dealt, F.lit(shards))).groupBy("shard").applyInArrow(lambda t: _shard(t, size), _FOUND), "located")
    again = located.where("text IS NOT NULL")
    turns = max(1, -(-again.count() // SHARD))
    second = again.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(turns))).groupBy("shard").applyInArrow(lambda t: _second(t, size), _FOUND)
    parts = located.where("text IS NULL").unionByName(second).groupBy("d1", "d2").agg(F.flatten(F.collect_list("offsets")).alias("offsets"))
    judged = cut(classes.select("d1", "d2", "m", "first.id", "first.start").join(parts, ["d1", "d2"], "left").where("m > 1 OR offsets IS NOT NULL"), "judged")
    large = cut(judged.where(F.col("m") >= LARGE).orderBy(F.col("m").desc(), "d1", "d2").limit(MOST_LARGE), "large-classes")
    keys = ["d1", "d2"]
    sent = F.broadcast(large.select(*keys))
    rest = members.join(sent, keys, "left_anti").alias("a").join(judged.join(sent, keys, "left_anti").alias("b"), keys)
    hot = members.alias("a").join(F.broadcast(large.alias("b")), keys)
    whole = (F.col("a.id") != F.col("b.id")) | (F.col("a.start") != F.col("b.start"))
    at = lambda start, n: F.shiftleft(start.cast("long"), 16).bitwiseOR(n.cast("long"))
    each = F.when(whole, F.array(at(F.col("a.start"), F.col("a.n")))).otherwise(F.transform("b.offsets", lambda o: at(F.col("a.start") + o, F.lit(1))))
    rows = [x.select("a.id", "a.t", F.explode(each).alias("mark")) for x in (rest, hot)]
    got = cut(rows[0].unionByName(rows[1]).groupBy("id", "t").agg(F.collect_set("mark").alias("marks")), "marks")
    return got, [found, classes, per, often, runs, located, judged, large]


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    got, used = marks(own, size, gram)
    discard(*used)
    bitmap = key_bitmap(got.select(row_key("id", "t").alias("k")), "k")
    some, none = split_by_bitmap(own, row_key("id", "t"), bitmap)
    columns = ["doc_id", "text", "marks"]
    met = some.join(got, ["id", "t"], "left").select(*columns)
    rows = met.unionByName(none.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("marks")))
    return rows.mapInArrow(lambda b: _kept(b, size), _OUT)
