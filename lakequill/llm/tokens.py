"""Token ids of whole texts in files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending order of doc_id::

    magic "PFRB", u32 version, u32 ids a block
    blocks: u32 minimum, u8 width, u8 0, u16 exceptions, packed offsets, u16 positions, u32 high parts
    footer: u64 block starts, i64 doc ids, u8 null flags, i64 ids of each document
    u64 footer start, u64 blocks, u64 documents, u64 ids, magic "PFRE"

Each block stores ``id - minimum`` in as many bits as the chosen percentile of its offsets takes; what doesn't fit has
its high part in the exception list. The block index lets a reader seek to any id.

Results for odd input: a null or empty text is the end id alone; null ids sort first and stay null; equal ids are
ordered by the text's hash, equal rows by chance (they are alike); an empty table gives an empty result; other columns
are ignored. A file is written under a name of its own by each attempt and counts only once the manifest, which Spark
commits, lists it; so retries and lost executors leave unlisted files at worst.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut, fresh_dir, gathered, open_fs

BLOCK = 1024
PERCENTILE = 0.92
CHUNK_CHARS = 12_000_000
CACHE_UNITS = 600_000
HEAD, TAIL = b"PFRB", b"PFRE"
_FOOT = struct.Struct("<QQQQ4s")
#: Texts with runs of white space, rare white space, special tokens or letters beyond these Latin blocks are encoded whole.
_WHOLE = r"  | \n|\n |\n\n|<\||[\x00\t\r\x0b\x0c\x1c-\x1f]|[^\x00-\x7f\x{c0}-\x{24f}]"
#: How the vocabulary's pre-tokenizer parts all other texts.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class _Index(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def parts_apart(path: str) -> bool:
    """Whether a tokenizer file is of the kind that encodes a text's parts by themselves, with the parts of _PARTS."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    cut, model = t.get("pre_tokenizer") or {}, t.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and t.get("normalizer") is None
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    special = all(x["content"].startswith("<|") for x in t.get("added_tokens") or ())
    return bool(plain and special and model.get("type") == "BPE" and not any(model.get(x) for x in options))


_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One for each process and vocabulary, so that a worker's later tasks find known pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Whole-text encoding by the tokenizers library, whose model sees each distinct word once.

    A byte-level BPE model never merges across the parts that its pre-tokenizer makes, and that always parts a text
    before a lone space. So the ids of a text are those of its pieces between spaces, and theirs those of their parts.
    Texts that aren't so plain, and all texts under a tokenizer of another kind, are encoded by the library in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_parts = parts_apart(path)
        self.letters = _byte_letters()
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.parts: dict[str, list[int]] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets the pieces that came in one portion only."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > CACHE_UNITS // 2:
            self.reset()
            return
        names = list(self.index)
        first, count = self.first[keep], self.count[keep]
        ends = np.cumsum(count)
        src = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)
        self.ids, self.first, self.count = self.ids[src], ends - count, count
        self.index, self.parts = _Index(zip([names[k] for k in keep], range(len(keep)))), {}
        self.seen = np.ones(len(keep), np.int64)

    def _add(self, keys: list[str]) -> None:
        """Gives ids to new pieces. A key that starts with the mark is a text's first piece and has no space before."""
        known, tokenize, letters, flat, sizes = self.parts, self.tokenizer.model.tokenize, self.letters, [], []
        space = letters[32]
        for key in keys:
            if key.isalpha():  # one part with its space
                got = known.get(" " + key)
                if got is None:
                    got = known[" " + key] = [t.id for t in tokenize(space + (key if key.isascii() else key.encode().decode("latin-1").translate(letters)))]
                flat += got
                sizes.append(len(got))
                continue
            before = len(flat)
            for part in _PARTS.findall(key[1:] if key[:1] == "\0" else " " + key):
                got = known.get(part)
                if got is None:
                    got = known[part] = [t.id for t in tokenize(part.encode().decode("latin-1").translate(letters))]
                flat += got
            sizes.append(len(flat) - before)
        sizes = np.array(sizes, np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        self.count = np.concatenate([self.count, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(keys), np.int64)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by id 0, and the number of ids of each with its end."""
        if len(self.index) > CACHE_UNITS:
            self.shrink()
        index, known = self.index, len(self.index)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) if self.by_parts else np.ones(len(texts), bool)
        pieces = pc.split_pattern(pc.if_else(pa.array(~odd), texts, ""), " ")
        per = pc.list_value_length(pieces).to_numpy()
        stop = np.cumsum(per)
        flat = pc.list_flatten(pieces)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        place = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        unit = place[coded.indices.to_numpy()]
        begin = stop - per  # each text has a piece at least
        unit[begin] = [index["\0" + x] for x in flat.take(pa.array(begin)).to_pylist()]
        if len(index) > known:
            self._add(list(islice(index, known, None)))
        self.seen[place] += 1
        sizes = self.count[unit]
        ends = np.cumsum(sizes)
        src = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[unit] - (ends - sizes), sizes)
        ids = self.ids[src]
        upto = np.concatenate([[0], ends])
        n = upto[stop] - upto[begin]
        if not odd.any():
            return np.insert(ids, np.cumsum(n), 0), n + 1
        at_odd = np.flatnonzero(odd)
        got = dict(zip(at_odd.tolist(), (e.ids for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(at_odd)).to_pylist(), add_special_tokens=False))))
        parts, at = [], 0
        for k in range(len(n)):
            own = np.array(got[k], np.uint32) if k in got else ids[at : at + n[k]]
            at += n[k]
            n[k] = len(own)
            parts += [own, np.zeros(1, np.uint32)]
        return np.concatenate(parts), n + 1


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width into rows of BLOCK * width bits."""
    n = len(values)
    lanes = np.ascontiguousarray(values.astype(np.uint64).reshape(n * (BLOCK // 64), 64).T)
    out = np.zeros((width, n * (BLOCK // 64)), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8).reshape(n, BLOCK * width // 8)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    n = len(packed)
    if not width:
        return np.zeros((n, BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).reshape(n * (BLOCK // 64), width).T)
    out = np.empty((64, n * (BLOCK // 64)), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(n, BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a number of ids that BLOCK divides."""
    rows = ids.reshape(-1, BLOCK)
    low = rows.min(axis=1)
    offset = rows - low[:, None]
    pick = np.partition(offset, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.ceil(np.log2(pick.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        own = offset[at]
        high = own >> np.uint32(w)
        packed = pack(own & np.uint32((1 << int(w)) - 1), int(w))
        r, pos = np.nonzero(high)
        cuts = np.searchsorted(r, np.arange(len(at) + 1))
        pos16, high32 = pos.astype("<u2"), high[r, pos].astype("<u4")
        for k, b in enumerate(at):
            i, j = cuts[k], cuts[k + 1]
            out[b] = struct.pack("<IBBH", low[b], w, 0, j - i) + packed[k].tobytes() + pos16[i:j].tobytes() + high32[i:j].tobytes()
    return out


def decode_blocks(buf: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at the given places of buf."""
    raw = np.frombuffer(buf, np.uint8)
    head = raw[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width = head[:, 4].astype(np.int64)
    extra = np.ascontiguousarray(head[:, 6:8]).view("<u2").ravel().astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        own = unpack(raw[starts[at][:, None] + 8 + np.arange(size)], int(w))
        for k in np.flatnonzero(extra[at]):
            b = at[k]
            p, n = int(starts[b]) + 8 + size, int(extra[b])
            pos = np.frombuffer(buf, "<u2", n, p)
            own[k, pos] |= np.frombuffer(buf, "<u4", n, p + 2 * n) << np.uint32(w)
        out[at] = own + low[at][:, None]
    return out.ravel()


class Writer:
    """Writes one file; ids may come in any portions."""

    def __init__(self, sink):
        self.sink, self.at, self.n_ids = sink, 12, 0
        self.rest = np.zeros(0, np.uint32)
        self.starts: list[int] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        sink.write(HEAD + struct.pack("<II", 1, BLOCK))

    def _put(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids)
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.sink.write(b"".join(blocks))

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.sizes.append(sizes)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // BLOCK * BLOCK
        if full:
            self._put(ids[:full])
        self.rest = ids[full:]

    def close(self) -> int:
        if len(self.rest):
            self._put(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), np.uint32)]))
        docs = np.concatenate(self.docs)
        foot = np.array(self.starts, "<u8").tobytes() + docs.astype("<i8").tobytes() + np.concatenate(self.nulls).astype(np.uint8).tobytes() + np.concatenate(self.sizes).astype("<i8").tobytes()
        foot += _FOOT.pack(self.at, len(self.starts), len(docs), self.n_ids, TAIL)
        self.sink.write(foot)
        return self.at + len(foot)


class Reader:
    """Reads a file through its footer; ``ids(a, b)`` seeks by the block index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOT.size)
        foot, blocks, docs, self.n_ids, tail = _FOOT.unpack(source.read(_FOOT.size))
        if tail != TAIL:
            raise ValueError("not a whole token file")
        source.seek(foot)
        raw = source.read(size - _FOOT.size - foot)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks).astype(np.int64), foot)
        p = 8 * blocks
        self.doc_ids = np.frombuffer(raw, "<i8", docs, p)
        self.nulls = np.frombuffer(raw, np.uint8, docs, p + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", docs, p + 9 * docs)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // BLOCK, (b - 1) // BLOCK + 1
        self.source.seek(int(self.starts[i]))
        buf = self.source.read(int(self.starts[j] - self.starts[i]))
        return decode_blocks(buf, self.starts[i:j] - self.starts[i])[a - i * BLOCK : b - i * BLOCK]


_MANIFEST, _MANIFEST_ARROW = arrow_schema("part int, path string, docs long, ids long, bytes long")
_OUT, _OUT_ARROW = arrow_schema("doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of about CHUNK_CHARS at a time."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(ids):
            held = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, held + CHUNK_CHARS, "right")))
            yield ids.slice(begin, end - begin), texts.slice(begin, end - begin)
            begin = end


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Writes all texts into files below folder, in order of doc_id; returns the manifest, a row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = writer = sink = None
        part, n = TaskContext.get().partitionId(), 0
        for ids, texts in _chunks(gathered(batches, CHUNK_CHARS)):  # the more text at once, the fewer look-ups
            if writer is None:
                encode = encoder(tokenizer_path)
                fs, base = open_fs(folder)
                fs.create_dir(base, recursive=True)
                path = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                sink = fs.open_output_stream(f"{base}/{path}")
                writer = Writer(sink)
            got, sizes = encode(texts)
            writer.add(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), sizes, got)
            n += len(texts)
        if writer is not None:
            size = writer.close()
            sink.close()
            yield arrow_batch(_MANIFEST_ARROW, [part], [path], [n], [writer.n_ids], [size])

    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"), F.spark_partition_id().alias("_p"))
    # equal rows may go to several files, by the partition they come from
    dealt = own.repartitionByRange("doc_id", "_h", "_p").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return cut(dealt.mapInArrow(write, _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32, file."""
    spark, rows, before = manifest.sparkSession, [], 0
    for r in sorted(manifest.collect(), key=lambda x: x["part"]):  # a row for each file
        rows.append((r["path"], before))
        before += r["ids"]
    files = spark.createDataFrame(rows or [("", 0)], "path string, start long").where("path != ''").repartition(max(1, len(rows)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['path']}") as source:
                    file = Reader(source)
                    ends = np.cumsum(file.sizes)
                    begins = ends - file.sizes
                    i = 0
                    while i < len(ends):
                        j = max(i + 1, int(np.searchsorted(ends, begins[i] + 1_000_000, "right")))
                        ids = file.ids(int(begins[i]), int(ends[j - 1])).astype("<u4", copy=False)
                        view, shift = memoryview(ids.view(np.uint8)), int(begins[i])
                        crc = [zlib.crc32(view[4 * (a - shift) : 4 * (b - shift)]) for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist())]
                        yield arrow_batch(_OUT_ARROW, pa.array(file.doc_ids[i:j], pa.int64(), mask=file.nulls[i:j]), begins[i:j] + row["start"], file.sizes[i:j], crc, [row["path"]] * (j - i))
                        i = j

    return files.mapInArrow(read, _OUT)


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the token files of docs and returns what they hold, read back."""
    folder = fresh_dir(spark, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder), folder)
