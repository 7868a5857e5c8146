"""Language identification by compression.

For each language, its most frequent words are a raw-content dictionary for zstandard. A text is cut into blocks, each
block is compressed with each dictionary, and the language with the fewest bytes wins. Letters are lower-cased and all
else becomes one space first, so that junk, numbers and mark-up have no say.

The words of all labelled texts are counted, whole. A dictionary has DICT_BYTES at most, which is the size of the model and
not of what it learns from; the most frequent words come last, where they are cheapest to refer to. Words of over LONG_WORD
letters, as of writing without spaces, count by overlapping pieces. Predictions read whole texts.

A prediction is rejected where the margin between the two best languages is narrow. How many bytes are narrow is fitted:
one text in FOLDS, by hash, is left out of the dictionaries, pieces of each of PIECES bytes and the whole are classified,
and margins at which the share of wrong ones is above RISK, weighted by how frequent the languages are, are rejected. The
same number of bytes holds for texts of any length.

Results for odd input: a null text, and a text without letters, is ``und`` with score 0 and rejected; ties go to the
language with more labelled rows, then by name, and are rejected if the fit says so; a rejected text keeps its best guess;
rows repeat as they come; without labelled rows all is ``und``, with one language nothing with letters is rejected; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, cut, discard, id_remainder, release

DICT_BYTES = 200_000
#: Letters of the longest word that counts as one, and of the pieces of longer ones.
LONG_WORD, PIECE = 24, 4
LEVEL = 5
BLOCK_BYTES = 1024
#: Pieces on which the margin is fitted, in bytes; one text in FOLDS gives them.
PIECES, FOLDS = (8, 16, 32, 64, 128, 256, 512), 5
#: Share of wrong predictions from which a margin is narrow, and the widest margin that may be.
RISK, WIDEST = 0.15, 64
#: Nats a byte of difference is worth in the score.
SHARPNESS = 0.7

_OTHER = re.compile(r"[\W\d_]+")
_WORDS, _WORDS_ARROW = arrow_schema("l string, out boolean, word string, n long")
_TRIED, _TRIED_ARROW = arrow_schema("l string, right boolean, margin long, n long")
_OUT, _SCHEMA = arrow_schema("doc_id long, lang_pred string, score double, margin double, rejected boolean")


def letters(text: str | None) -> str:
    """Lower-cased words of a text, parted by single spaces; empty if it has no letters."""
    got = _OTHER.sub(" ", (text or "").lower()).strip()
    return got if any(map(str.isalpha, got)) else ""


class Model:
    """Dictionaries by language, ordered by the languages' frequency, and the margin to reject below; pickles as bytes."""

    def __init__(self, samples: dict[str, bytes], counts: dict[str, int], narrow: int = 0):
        self.samples, self.order = samples, sorted(samples, key=lambda x: (-counts[x], x))
        self.narrow = narrow
        self.compress: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"compress": None}

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes by language, in self.order."""
        import zstandard

        if self.compress is None:
            made = {}
            for lang in self.order:
                d = zstandard.ZstdCompressionDict(self.samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            self.compress = made
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(map(len, map(self.compress[lang], blocks))) for lang in self.order]

    def judged(self, data: bytes) -> tuple[str, float, int | None]:
        """Language, score and margin in bytes (None with one language) of letters."""
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        low = sizes[best]
        score = 1.0 / sum(math.exp(-SHARPNESS * min(s - low, 1000)) for s in sizes)
        return self.order[best], score, min((s - low for i, s in enumerate(sizes) if i != best), default=None)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin as a share of the bytes, rejected."""
        data = letters(text).encode("utf-8", "replace")
        if not data or not self.order:
            return "und", 0.0, 0.0, True
        lang, score, margin = self.judged(data)
        return lang, score, 1.0 if margin is None else margin / len(data), margin is not None and margin < self.narrow


def pieces(data: bytes) -> list[bytes]:
    """A text's beginnings of PIECES bytes, cut at spaces, and the whole."""
    out = {data}
    for n in PIECES:
        if n < len(data):
            end = data.find(b" ", n)
            out.add(data[: end if end > 0 else len(data)])
    return sorted(out, key=len)


def units(data: str) -> Iterator[str]:
    """Words of letters; of long ones, overlapping pieces."""
    for w in data.split():
        if len(w) <= LONG_WORD:
            yield w
        else:
            for k in range(0, len(w) - PIECE // 2, PIECE // 2):
                yield w[k : k + PIECE]


def _counted(labelled: DataFrame) -> DataFrame:
    """l, out, word, n: how often each word is in each portion of a language's texts, out of the dictionaries that the margin is fitted on or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for lang, out, text in zip(*(batch.column(c).to_pylist() for c in ("l", "out", "t"))):
                for word, n in Counter(units(letters(text))).items():
                    got[lang, out, word.encode("utf-8", "replace").decode()] += n
            yield arrow_batch(_WORDS_ARROW, *([k[i] for k in got] for i in range(3)), list(got.values()))

    return labelled.select("l", "out", "t").mapInArrow(run, _WORDS)


def _dictionaries(words: DataFrame) -> dict[str, bytes]:
    """Each language's most frequent words, DICT_BYTES of them at most."""
    w = Window.partitionBy("l").orderBy(F.col("n").desc(), "word")
    best = words.groupBy("l", "word").agg(F.sum("n").alias("n")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= DICT_BYTES // 2)  # cut before rows meet
    rows = best.withColumn("size", F.sum(F.octet_length("word") + 1).over(w)).where(F.col("size") <= DICT_BYTES).select("l", "k", "word").collect()
    own: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda x: (x["l"], -x["k"])):
        own.setdefault(r["l"], []).append(r["word"])
    return {lang: " ".join(x).encode() for lang, x in own.items()}


def narrow_margin(left_out: DataFrame, model: Model, counts: dict[str, int]) -> int:
    """The margin in bytes below which predictions on left-out texts (l, t) are wrong too often."""
    if len(model.order) < 2:
        return 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for lang, text in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist()):
                if data := letters(text).encode("utf-8", "replace"):
                    for p in pieces(data):
                        best, _, margin = model.judged(p)
                        got[lang, best == lang, min(margin, WIDEST)] += 1
            yield arrow_batch(_TRIED_ARROW, *([k[i] for k in got] for i in range(3)), list(got.values()))

    rows = left_out.select("l", "t").mapInArrow(run, _TRIED).groupBy("l", "right", "margin").agg(F.sum("n").alias("n")).collect()  # a few for each margin
    tried: Counter = Counter()
    for r in rows:
        tried[r["l"]] += r["n"]
    right, wrong = [0.0] * (WIDEST + 1), [0.0] * (WIDEST + 1)
    for r in rows:
        (right if r["right"] else wrong)[r["margin"]] += counts[r["l"]] * r["n"] / tried[r["l"]]
    narrow = 1  # a tie tells nothing, however right it was on left-out pieces
    while narrow < WIDEST and wrong[narrow] > RISK * (right[narrow] + wrong[narrow]):
        narrow += 1
    return narrow


def train(docs: DataFrame, folds: int = 5) -> Model:
    """Learns from the text and lang of all rows whose crc32(doc_id) modulo folds is not 0."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("l"))
    labelled = own.where((id_remainder(F.col("i"), folds) != 0) & F.col("l").isNotNull() & F.col("t").isNotNull())
    labelled = labelled.withColumn("out", F.pmod(F.xxhash64("i", "t"), F.lit(FOLDS)) == 0)
    per = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return Model({}, {})
    words = cut(_counted(labelled).groupBy("l", "out", "word").agg(F.sum("n").alias("n")), "words-of-languages")
    whole, kept = _dictionaries(words), Model(_dictionaries(words.where("NOT out")), per)
    discard(words)
    return Model(whole, per, narrow_margin(labelled.where("out"), kept, per))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for each row; reads doc_id and text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield arrow_batch(_SCHEMA, batch.column("doc_id"), *([x[k] for x in got] for k in range(4)))

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def keep_identified(docs: DataFrame, folds: int = 5) -> DataFrame:
    """docs without the rows that the classifier rejects; columns stay. One pass, without a join."""
    model = train(docs, folds)

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            yield batch.filter(pa.array([not model.predict(t)[3] for t in batch.column(place).cast(pa.string()).to_pylist()], pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
