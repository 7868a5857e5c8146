"""Fill-in-the-middle transformation: texts cut into units at zero-width boundaries, two cuts by hash, three pieces.

A grammar of units is a list of neighbouring classes: a unit ends where a character of the first class is followed by one
of the second. ``boundary`` makes it a regular expression of lookarounds, which matches between characters and takes none,
so that Spark's split keeps every character and the units joined give the text again. All steps are expressions over one
row: nothing is shuffled, and no Python runs.

The cuts, whether a text is transformed and in which form come from the SHA-256 of ``seed:doc_id``, so a rerun, another
partitioning or a lost executor changes nothing.

Results for odd input: a null or empty text has no unit (split would give one empty unit) and is plain, as is a text that
holds a marker; a null id is hashed as an empty one; repeated rows give equal rows; ties of both cuts give an empty
middle; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored and may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7

ANY = r"\s\S"
SPACE = r"\x20\x09-\x0D"
#: Units by the classes at their ends: each pair is (last of a unit, first of the next one).
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "lines": [(r"\n", ANY)],
    "words": [(SPACE, f"^{SPACE}")],  # a word has the white space after it
    "runs": [(SPACE, f"^{SPACE}"), (f"^{SPACE}", SPACE)],  # words and white space are units of their own
    "tokens": [(r"\p{L}\p{M}", r"^\p{L}\p{M}"), (r"^\p{L}\p{M}", r"\p{L}\p{M}"), (r"\p{N}", r"^\p{N}"), (r"^\p{N}", r"\p{N}"), (SPACE, f"^{SPACE}"), (f"^{SPACE}", SPACE)],
    "sentences": [(r".!?\x{3002}\x{FF01}\x{FF1F}", SPACE + r"\p{Lo}"), (r"\n", ANY)],
    "characters": [(ANY, ANY)],
}


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width expression that matches where units of a grammar meet."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<=[{a}])(?=[{b}])" for a, b in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "lines") -> Column:
    """The units of a text in order; none for null and empty texts."""
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), none).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def joined(pieces: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(pieces, start.cast("int") + 1, (end - start).cast("int")), "")


def transform(docs: DataFrame, grammar: str | list[tuple[str, str]] = "lines", seed: int = SEED, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n units, form, prefix, middle, suffix (null if plain) and output of each row.

    rate and spm_rate are percentages: of texts that are transformed, and of those that put the suffix first.
    """
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    own = own.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("bigint"))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    own = own.select("doc_id", "text", "units", "n", form.alias("form"), (h1 % (F.col("n") + 1)).alias("a"), (h2 % (F.col("n") + 1)).alias("b"))
    low, high, cut = F.least("a", "b"), F.greatest("a", "b"), F.col("form") != "plain"
    pieces = own.select("doc_id", "text", "n", "form", F.when(cut, joined(F.col("units"), F.lit(0), low)).alias("prefix"), F.when(cut, joined(F.col("units"), low, high)).alias("middle"), F.when(cut, joined(F.col("units"), high, F.col("n"))).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return pieces.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    A transformed text holds no marker, and no end of a piece makes one with the marker behind it, since each marker
    begins with its only ``<``. So the first of each kind is the one that was set.
    """
    s, p, m = (F.position(F.lit(x), output) for x in (SUFFIX, PREFIX, MIDDLE))
    w = len(PREFIX)

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start + w, end - start - w)

    rest = F.substring(output, m + w, F.length(output))
    psm = F.concat(F.substring(output, F.lit(w + 1), s - w - 1), rest, between(s, m))
    spm = F.concat(between(p, m), rest, F.substring(output, F.lit(w + 1), p - w - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """What was made of each row: unit count, form, characters of the pieces, digests of the output and of the text restored from it."""
    got = transform(docs, **parameters)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return got.select(
        "doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
