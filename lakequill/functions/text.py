"""Text as Column expressions: cleaning, structure, cutting, tokens and small parsers. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of a text.
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Ideographs: three blocks of the character set. Texts in them have no spaces, so their terms are pairs of signs.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
CHUNK = 800


def once(c: Column, f) -> Column:
    """f of c, where c is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+", ""), f"{BLANK}+\\z", "")


def as_text(c: Column) -> Column:
    """A cell as text: null is empty."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


# Fixed patterns of page-number lines, control characters, chapter marks and section starts, here and in the next four.


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(r"^[—\-－]?\s*\d+\s*[—\-－]?\z")


def clean(c: Column) -> Column:
    """Drops control characters, blank-line white space, hyphens at line ends, extra newlines and page-number lines."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")
    c = F.regexp_replace(c, r"\n[ \t]+(?=\n)", "\n")
    c = F.regexp_replace(c, r"([a-zA-Z])-\n([a-zA-Z])", "$1$2")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.array_join(F.filter(lines(c), lambda x: ~is_page_number(x)), "\n"))


def mark_headers(c: Column) -> Column:
    """Short lines that number a chapter, section or item become headings of level 1, 2 and 3."""

    def one(line: Column) -> Column:
        s = strip(line)
        short = F.length(s) < 50
        level1 = s.rlike(r"^第[一二三四五六七八九十百千万0-9]+[章节篇部分条]\s+")
        level2 = s.rlike(r"^([一二三四五六七八九十]+|[0-9]+)\s*、")
        level3 = s.rlike(r"^（[一二三四五六七八九十]+）|^[0-9]+\.([^0-9]|\z)")
        return F.when(short & level1, F.concat(F.lit("# "), s)).when(short & level2, F.concat(F.lit("## "), s)).when(short & level3, F.concat(F.lit("### "), s)).otherwise(line)

    return F.array_join(F.transform(lines(c), one), "\n")


def sections(c: Column) -> Column:
    """Pieces that start at headings, blank lines and image marks."""
    return F.split(c, r"(?=\n#{1,4} |\n\n|!\[IMAGE_CHUNK:.*?\]\(.*?\))")


def pack(pieces: Column, limit: int = CHUNK, page_chars: int = CHUNK) -> Column:
    """Greedy chunks of stripped pieces: array of content, header and page.

    A chunk takes pieces while they fit below the limit, each with 2 characters for the joint; a piece that doesn't fit
    starts the next one. Header and page are those known when the chunk is closed, that is, with the piece that closed it.
    """
    done_type = "array<struct<content:string,header:string,page:int>>"
    start = F.struct(F.array().cast(done_type).alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"), F.lit("").alias("header"), F.lit(0).alias("chars"))

    def closed(cur: Column, header: Column, chars: Column) -> Column:
        return F.struct(F.array_join(cur, "\n\n").alias("content"), header.alias("header"), (F.floor(chars / page_chars) + 1).cast("int").alias("page"))

    def add(acc: Column, raw: Column) -> Column:
        s = strip(raw)
        n, chars = F.length(s), acc["chars"] + F.length(raw)
        title = strip(F.regexp_extract(s, r"^#{1,6}\s+([^\n]+)", 1))
        header = F.when(title != "", title).otherwise(acc["header"])
        fits = acc["n"] + n < limit
        shut = ~fits & (F.size(acc["cur"]) > 0)
        done = F.when(shut, F.array_append(acc["done"], closed(acc["cur"], header, chars))).otherwise(acc["done"])
        cur = F.when(fits, F.array_append(acc["cur"], s)).otherwise(F.array(s))
        size = F.when(fits, acc["n"] + n + 2).otherwise(n + 2)
        full = F.struct(done.alias("done"), cur.alias("cur"), size.alias("n"), header.alias("header"), chars.alias("chars"))
        skip = F.struct(acc["done"].alias("done"), acc["cur"].alias("cur"), acc["n"].alias("n"), acc["header"].alias("header"), chars.alias("chars"))
        return F.when(s == "", skip).otherwise(full)

    def finish(acc: Column) -> Column:
        last = closed(acc["cur"], acc["header"], acc["chars"])
        return F.when(F.size(acc["cur"]) > 0, F.array_append(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(pieces, start, add, finish)


def summary(c: Column, n: int = 100) -> Column:
    """The first n characters without heading, emphasis and line marks."""
    return F.concat(F.substring(strip(F.translate(c, "#*\n", "")), 1, n), F.lit("..."))


def tokens(c: Column) -> Column:
    """Search terms: words of two letters or digits at least, and all pairs of signs in runs of ideographs."""
    runs = F.regexp_extract_all(c, F.lit(f"[{HAN}]+|[\\p{{L}}\\p{{N}}_&&[^{HAN}]]{{2,}}"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{HAN}]"), pairs(r)).otherwise(F.array(r))))
    return F.when(c.rlike(f"[{HAN}]"), mixed).otherwise(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))


def query_terms(text: str) -> list[str]:
    """The terms of a question, cut as ``tokens`` cuts texts; a question without any is one term."""
    out: list[str] = []
    for run in re.findall(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+|(?:(?![\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])\w){2,}", text.lower()):
        ideographs = not re.match(r"[^\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", run)
        out += [run[i : i + 2] for i in range(max(len(run) - 1, 1))] if ideographs else [run]
    return list(dict.fromkeys(out)) or [text]


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(x.cast("string"), F.lit("")) for x in cells]), F.lit(" |"))


def key_values(pairs: list[tuple[str, Column]]) -> Column:
    """``name: value`` joined by bars, blanks left out."""
    return F.concat_ws(" | ", *[F.when(as_text(v) != "", F.concat(F.lit(f"{k}: "), as_text(v))) for k, v in pairs])


def pdf_join(blocks: Column) -> Column:
    """Lines of a block are joined, those between two CJK characters without a space; blocks get a blank line between."""
    cjk = r"\x{4e00}-\x{9fa5}"

    def one(b: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(b, f"([{cjk}])\\n+([{cjk}])", "$1$2"), r"\n+", " "))

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x != ""), "\n\n")


def cut_at_sentence(c: Column, limit: int, window: int = 100) -> Column:
    """At most limit characters, cut after the last good end within the window, else hard with an ellipsis."""
    head = F.substring(c, 1, limit)
    tail_at = limit - window
    out = F.concat(head, F.lit("…"))
    for mark in reversed(["\n\n", "。\n", "！\n", "？\n", "；\n", "\n"]):
        back = F.length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1  # characters before the last mark
        out = F.when(F.contains(head, F.lit(mark)) & (back >= tail_at), F.substring(head, F.lit(1), (back + len(mark)).cast("int"))).otherwise(out)
    return F.when(F.length(c) <= limit, c).otherwise(out)


def keyword_places(c: Column, keyword: str) -> Column:
    """1-based places of all occurrences, overlapping ones too: the text is cut before each of them."""
    import re

    pieces = F.split(c, f"(?={re.escape(keyword)})")
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        here = (acc["at"] > 0) | F.startswith(c, F.lit(keyword))  # all pieces but the first start at an occurrence
        return F.struct(F.when(here, F.array_append(acc["found"], acc["at"] + 1)).otherwise(acc["found"]).alias("found"), (acc["at"] + F.length(piece)).alias("at"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def normal_answer(c: Column) -> Column:
    """The text after an answer mark and before a source mark, without leaked prompt lines."""
    body = F.regexp_replace(c, r"(?s)^.*?回答[:：]", "")
    body = F.regexp_replace(body, r"(?s)来源[:：].*\z", "")
    keep = F.filter(lines(body), lambda x: ~strip(x).rlike("^(问题|文档内容|要求)[:：]"))
    return strip(F.array_join(keep, "\n"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, r"[/\\]"), -1), r"\.\.", "")


def extension(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.lower(F.element_at(F.split(c, r"\."), -1))).otherwise(F.lit(""))


# small parsers


def chinese_number(c: Column) -> Column:
    """Chinese numerals below 1000, or digits; null for anything else."""
    digit = lambda x: F.when(x == "", 0).otherwise(F.instr(F.lit("一二三四五六七八九"), x) + F.when(x == "两", 2).otherwise(0))
    part = lambda k: F.regexp_extract(c, "^(?:([一二两三四五六七八九])百)?零?(?:([一二两三四五六七八九]?)(十))?([一二两三四五六七八九]?)$", k)
    ten = F.when(part(3) == "", 0).when(part(2) == "", 1).otherwise(digit(part(2)))
    value = digit(part(1)) * 100 + ten * 10 + digit(part(4))
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint")).when((c != "") & c.rlike("^[一二两三四五六七八九十百零]+$") & (value > 0), value.cast("bigint"))


def cell_row(c: Column) -> Column:
    """Row of a cell reference: A1, 第r行第c列 or r,c; 1 for anything else."""
    a1, cn, pair = F.regexp_extract(c, "^[A-Za-z]+([0-9]+)$", 1), F.regexp_extract(c, "第([0-9]+)行", 1), F.regexp_extract(c, "^([0-9]+)\\s*,\\s*([0-9]+)$", 1)
    return F.coalesce(a1.try_cast("bigint"), cn.try_cast("bigint"), pair.try_cast("bigint"), F.lit(1).cast("bigint"))


def cell_column(c: Column) -> Column:
    letters = F.upper(F.regexp_extract(c, "^([A-Za-z]+)[0-9]+$", 1))
    a1 = F.aggregate(F.split(letters, ""), F.lit(0).cast("bigint"), lambda acc, x: acc * 26 + F.ascii(x) - 64)
    cn, pair = F.regexp_extract(c, "第([0-9]+)列", 1), F.regexp_extract(c, "^([0-9]+)\\s*,\\s*([0-9]+)$", 2)
    return F.when(letters != "", a1).otherwise(F.coalesce(cn.try_cast("bigint"), pair.try_cast("bigint"), F.lit(1).cast("bigint")))


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column number of up to three letters."""
    a = lambda x: F.chr(x + 65)
    one, two = F.pmod(n - 1, F.lit(26)), F.floor((n - 1) / 26)
    second, three = F.pmod(two - 1, F.lit(26)), F.floor((two - 1) / 26)
    return F.when(n <= 26, a(one)).when(n <= 702, F.concat(a(second), a(one))).otherwise(F.concat(a(three - 1), a(second), a(one)))


def strip_unit(c: Column) -> Column:
    """A value without a parenthesis, a trailing unit and thousands commas."""
    c = F.regexp_replace(c, "[（(][^）)]*[）)]", "")
    c = F.regexp_replace(c, "(亿元|万元|千元|亿|万|元|人|例|%)\\z", "")
    return strip(F.regexp_replace(c, ",", ""))


def normal_name(c: Column) -> Column:
    return F.translate(F.lower(c), " _/\\", "")


def rgb_hex(c: Column) -> Column:
    """``rgb(r,g,b)`` or a colour's name as six hex digits; null otherwise."""
    named = F.create_map(*[F.lit(x) for pair in {"red": "FF0000", "green": "00FF00", "blue": "0000FF", "yellow": "FFFF00", "black": "000000", "white": "FFFFFF", "红色": "FF0000", "绿色": "00FF00", "蓝色": "0000FF", "黄色": "FFFF00"}.items() for x in pair])
    part = lambda k: F.lpad(F.hex(F.regexp_extract(c, r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$", k).try_cast("bigint")), 2, "0")
    return F.when(c.rlike(r"^rgb\("), F.concat(part(1), part(2), part(3))).otherwise(F.try_element_at(named, F.lower(c)))


def json_object(c: Column) -> Column:
    """The first outermost JSON object of a model's reply, without thinking and fences; null if there is none."""
    c = F.regexp_replace(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "```[a-zA-Z]*", "")
    at = F.instr(c, "{")
    chars = F.split(F.substr(c, at), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.when(a["over"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), (depth == 0).alias("over")))

    end = F.aggregate(chars, start, step)
    return F.when((at > 0) & end["over"], F.substr(c, at, end["n"]))


def highlight(c: Column, words: list[str]) -> Column:
    import re

    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    found = [re.escape(w) for w in words if len(w) > 1]
    return F.regexp_replace(safe, "(?i)(" + "|".join(found) + ")", "<mark>$1</mark>") if found else safe


# vectors


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; zero vectors stay."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def distance_score(d: Column, exponential: bool = True) -> Column:
    got = F.exp(-d) if exponential else 1.0 / (1.0 + d)
    return F.when(d.isNull() | (d < 0), F.lit(0.0)).otherwise(got)


def jaccard(a: Column, b: Column) -> Column:
    def share(x: Column) -> Column:
        both, one = F.size(F.array_intersect(x["a"], x["b"])), F.size(F.array_union(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(both / one)

    return once(F.struct(a.alias("a"), b.alias("b")), share)
