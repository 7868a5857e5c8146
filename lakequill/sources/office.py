"""Office and text files as rows, and rows as office files, with the standard library alone.

Files come through Spark's ``binaryFile`` and ``text`` sources, so any store that Spark reads will do; each file is
parsed in one task. A file that can't be read gives a row with an error and no content.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _runs(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def parse_docx(data: bytes) -> list[tuple[int, str, str, str, bool, int]]:
    """(ordinal, kind, style, text, bold, table number) of the body in order; kind is paragraph, row or image.

    Cells of a row are joined by bars. Text in a nested table belongs to its outer cell.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                n = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = n.get(f"{_W}val") if n is not None else s.get(f"{_W}styleId")
    out: list[tuple[int, str, str, str, bool, int]] = []
    tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            style = "Normal" if style is None else names.get(style.get(f"{_W}val"), style.get(f"{_W}val"))
            bold = node.find(f"{_W}r/{_W}rPr/{_W}b") is not None
            if node.find(f".//{_W}drawing") is not None:
                out.append((len(out), "image", style, "", False, 0))
            out.append((len(out), "paragraph", style, _runs(node), bold, 0))
        elif node.tag == f"{_W}tbl":
            tables += 1
            for row in node.findall(f"{_W}tr"):
                out.append((len(out), "row", "", " | ".join(_runs(c) for c in row.findall(f"{_W}tc")), False, tables))
    return out


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def parse_xlsx(data: bytes) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, str]]]:
    """Cells (sheet, row, col, value) in order, and merged ranges (sheet, range)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        cells, merged = [], []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            name, target = sheet.get("name"), links[sheet.get(f"{_R}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for c in root.iter(f"{_S}c"):
                kind, v = c.get("t", "n"), c.find(f"{_S}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else ("TRUE" if v.text == "1" else "FALSE") if kind == "b" else v.text
                cells.append((name, *_place(c.get("r")), value))
            merged += [(name, m.get("ref")) for m in root.iter(f"{_S}mergeCell")]
    return cells, merged


def parsed(files: DataFrame, schema: str, one) -> DataFrame:
    """Rows of files (path, content), each parsed in one task; the schema begins with path and ends with error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        whole: list[tuple] = []
        for pdf in parts:
            for file, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows, error = one(bytes(data)), None
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, TypeError) as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                whole += [(file, *r, None) for r in rows] or ([(file, *[None] * (len(names) - 2), error)] if error else [])
                while len(whole) >= BATCH_ROWS:  # a batch has the rows of many small files, or some of a large one
                    yield pd.DataFrame(whole[:BATCH_ROWS], columns=names, dtype=object)
                    del whole[:BATCH_ROWS]
        if whole:
            yield pd.DataFrame(whole, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


#: Rows of files that go to Spark together, and workbooks that are made together.
BATCH_ROWS, FILES = 5_000, 100
CELLS = "path string, sheet string, row bigint, col bigint, value string, error string"
TABLE_CELLS = "path string, tbl bigint, row bigint, col bigint, value string, error string"
PIECES = "path string, pos bigint, kind string, text string, error string"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, kind, style, text, bold, tbl, error of each body element."""
    return parsed(_files(spark, path, "*.docx"), "path string, ordinal bigint, kind string, style string, text string, bold boolean, tbl bigint, error string", parse_docx)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, value, error of each filled cell."""
    return parsed(_files(spark, path, "*.xlsx"), CELLS, lambda d: parse_xlsx(d)[0])


def parse_docx_tables(data: bytes) -> list[tuple[int, int, int, str]]:
    """Cells (tbl, row, col, value) of the tables of a document, all 1-based; a cell that spans columns or rows is in each.

    A column is a place of the table's grid, so rows of differing spans line up; tables within cells belong to these.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for t, table in enumerate(body.findall(f"{_W}tbl") if body is not None else (), 1):
        above: dict[int, str] = {}
        for r, row in enumerate(table.findall(f"{_W}tr"), 1):
            before = row.find(f"{_W}trPr/{_W}gridBefore")
            col = 1 + (int(before.get(f"{_W}val")) if before is not None else 0)
            now: dict[int, str] = {}
            for cell in row.findall(f"{_W}tc"):
                span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
                value = above.get(col, "") if goes_on else re.sub(r"\s*\n\s*", " ", "\n".join(_runs(p) for p in cell.findall(f"{_W}p"))).strip()
                for _ in range(int(span.get(f"{_W}val")) if span is not None else 1):
                    now[col] = value
                    out.append((t, r, col, value))
                    col += 1
            above = now
    return out


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """path, tbl, row, col, value, error of each cell of tables."""
    return parsed(_files(spark, path, "*.docx"), TABLE_CELLS, parse_docx_tables)


def _member(data: bytes, name: str) -> bytes:
    """A member of a zip file, or what is there of it: read from its own header, since the list at the end may be gone."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(name)
    except (zipfile.BadZipFile, KeyError, zlib.error, EOFError, ValueError, NotImplementedError):
        pass
    at = -1
    while (at := data.find(b"PK\x03\x04", at + 1)) >= 0:
        head = data[at : at + 30]
        if len(head) < 30:
            break
        method, size, n, extra = *struct.unpack("<H", head[8:10]), *struct.unpack("<I", head[18:22]), *struct.unpack("<HH", head[26:30])
        if data[at + 30 : at + 30 + n] != name.encode():
            continue
        body = data[at + 30 + n + extra :]
        if method == 0:
            return body[:size] if size else body
        inflate, out, step, k = zlib.decompressobj(-15), [], 1 << 16, 0
        while k < len(body) and not inflate.eof:
            before = inflate.copy() if step > 64 else None
            try:
                out.append(inflate.decompress(body[k : k + step]))
                k += step
            except zlib.error:
                if before is None:
                    break
                inflate, step = before, 64  # what precedes a fault counts: its part again, in small ones
        return b"".join(out)
    return b""


_TOKEN = re.compile(r"<(/?)w:(p|tr|tc|tbl)(?=[\s>/])[^>]*?(/?)>|<w:t(?:\s[^>]*)?>([^<]*)")


def recover_docx(data: bytes) -> list[tuple[int, str, str]]:
    """(pos, kind, text) of the paragraphs and table rows of a damaged document, as far as it can be read.

    White space is collapsed; cells of a row are joined by bars, empty ones left out. A tag that is cut off ends the text.
    """
    xml = _member(data, "word/document.xml").decode("utf-8", "ignore")
    out: list[tuple[int, str, str]] = []
    text, cells, tables = [], [], 0

    def put(kind: str, value: str) -> None:
        if value:
            out.append((len(out), kind, value))

    def flat() -> str:
        value = re.sub(r"\s+", " ", unescape("".join(text), {"&quot;": '"', "&apos;": "'"})).strip()
        text.clear()
        return value

    for m in _TOKEN.finditer(xml):
        end, name, alone, words = m.groups()
        if name is None:
            text.append(words)
        elif name == "tbl" and not alone:
            if not tables:
                put("paragraph", flat())
            tables = max(0, tables + (-1 if end else 1))
        elif tables == 0 and name == "p" and end:
            put("paragraph", flat())
        elif tables and name == "p" and end:
            text.append(" ")
        elif tables == 1 and name == "tc" and end:
            cells.append(flat())
        elif tables == 1 and name == "tr" and end:
            put("row", " | ".join(c for c in cells if c))
            cells.clear()
    last = flat()
    if tables:
        put("row", " | ".join(c for c in [*cells, last] if c))
    else:
        put("paragraph", last)
    return out


def read_damaged_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, kind, text, error of what can be read of each document, whole or not."""
    return parsed(_files(spark, path, "*.docx"), PIECES, recover_docx)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def xlsx_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook of rows of values; None leaves a cell out."""
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row, 1):
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{_letters(c)}{r}"><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0"?><worksheet xmlns="{_S[1:-1]}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return sink.getvalue()


def table_xml(rows: list[list[tuple[str, int, bool]]]) -> str:
    """A table of rows of (text, columns spanned, whether it goes on from the cell above)."""
    out = []
    for row in rows:
        cells = []
        for k, (value, span, goes_on) in enumerate(row):
            marks = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ("<w:vMerge/>" if goes_on else '<w:vMerge w:val="restart"/>' if k == 0 else "")
            cells.append(f'<w:tc><w:tcPr>{marks}</w:tcPr><w:p><w:r><w:t xml:space="preserve">{"" if goes_on else escape(value)}</w:t></w:r></w:p></w:tc>')
        out.append(f"<w:tr>{''.join(cells)}</w:tr>")
    return f"<w:tbl>{''.join(out)}</w:tbl>"


def docx_bytes(paragraphs: list[tuple[str, int]], tables: str = "") -> bytes:
    """A document of (text, heading level) paragraphs, level 0 is body text, and of tables behind them."""
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}Heading{n}{chr(34)}/></w:pPr>" if n else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t, n in paragraphs) + tables
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2, 3))
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/styles.xml", f'<?xml version="1.0"?><w:styles xmlns:w="{_W[1:-1]}">{styles}</w:styles>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return sink.getvalue()


_PAGE = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'


def merge_docx(files: list[tuple[str, bytes]]) -> bytes:
    """One document of several (name, content), in order: each on a new page below its name as a heading, tables included.

    Parts that a document refers to, such as images, come along under names of their own, and its references follow. Styles
    are those of the first document that has one of that id; section settings are those of the last one.
    """
    ET.register_namespace("w", _W[1:-1])
    ET.register_namespace("r", _R[1:-1])
    bodies, parts, relations, styles, last = [], {}, [], {}, None
    kinds: dict[str, str] = {}
    for k, (name, data) in enumerate(files):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            if "word/styles.xml" in names:
                for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    styles.setdefault(s.get(f"{_W}styleId"), ET.tostring(s, encoding="unicode"))
            for d in ET.fromstring(z.read("[Content_Types].xml")):
                if d.get("Extension"):
                    kinds.setdefault(d.get("Extension"), d.get("ContentType"))
            new = {}
            if "word/_rels/document.xml.rels" in names:
                for r in ET.fromstring(z.read("word/_rels/document.xml.rels")):
                    target = r.get("Target")
                    at = target.lstrip("/") if target.startswith("/") else f"word/{target}"
                    if r.get("TargetMode") != "External":
                        if at not in names or r.get("Type").endswith(("/styles", "/settings", "/fontTable", "/theme", "/webSettings", "/numbering")):
                            continue
                        target = f"d{k}/{at.rpartition('/')[2]}"
                        parts[f"word/{target}"] = z.read(at)
                    new[r.get("Id")] = f"rId{len(relations) + 100}"
                    mode = ' TargetMode="External"' if r.get("TargetMode") == "External" else ""
                    relations.append(f'<Relationship Id="{new[r.get("Id")]}" Type="{r.get("Type")}" Target="{escape(target)}"{mode}/>')
        if k:
            bodies.append(_PAGE)
        bodies.append(f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t xml:space="preserve">{escape(name)}</w:t></w:r></w:p>')
        for node in body if body is not None else ():
            if node.tag == f"{_W}sectPr":
                last = node
                continue
            for x in node.iter():
                for key, value in x.attrib.items():
                    if key.startswith(_R) and value in new:
                        x.set(key, new[value])
            bodies.append(ET.tostring(node, encoding="unicode"))
    tail = "" if last is None else ET.tostring(last, encoding="unicode")
    types = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in kinds.items() if e not in ("rels", "xml"))
    with zipfile.ZipFile(io.BytesIO(docx_bytes([]))) as z, io.BytesIO() as sink:
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
            head = z.read("[Content_Types].xml").decode()
            out.writestr("[Content_Types].xml", head.replace("<Override", types + "<Override", 1))
            out.writestr("_rels/.rels", z.read("_rels/.rels"))
            own = ET.fromstring(z.read("word/styles.xml"))
            for s in own.iter(f"{_W}style"):
                styles.setdefault(s.get(f"{_W}styleId"), ET.tostring(s, encoding="unicode"))
            out.writestr("word/styles.xml", f'<?xml version="1.0"?><w:styles xmlns:w="{_W[1:-1]}">{"".join(styles.values())}</w:styles>')
            kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles"
            out.writestr("word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{kind}" Target="styles.xml"/>{"".join(relations)}</Relationships>')
            for name, data in parts.items():
                out.writestr(name, data)
            out.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}" xmlns:r="{_R[1:-1]}"><w:body>{"".join(bodies)}{tail}</w:body></w:document>')
        return sink.getvalue()


def merged_docx(files: DataFrame, output: str, order: str) -> DataFrame:
    """output and content: the documents (path, content) of each output in one; an output is one file and must fit a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({output: [pdf[output].iloc[0]], "content": [merge_docx([(p.rpartition("/")[2], bytes(c)) for p, c in zip(pdf["path"], pdf["content"])])]})

    return files.groupBy(output).applyInPandas(one, f"{output} {dict(files.dtypes)[output]}, content binary")


def markdown_to_docx(text: str) -> bytes:
    """Headings of level 1 to 3 and paragraphs; table lines are left out."""
    rows = []
    for line in text.split("\n"):
        m = re.match(r"(#{1,3}) (.*)", line)
        if m:
            rows.append((m[2].strip(), len(m[1])))
        elif line.strip() and not line.startswith("|"):
            rows.append((line.strip(), 0))
    return docx_bytes(rows)


def docx_to_markdown(paragraphs: DataFrame) -> DataFrame:
    """path and text: paragraphs first, heading styles as marks, then all tables."""
    level = F.regexp_extract(F.lower("style"), r"(?:heading|标题)\s*([1-3])", 1)
    line = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "), "text")).when(F.col("kind") == "row", F.concat(F.lit("| "), "text", F.lit(" |"))).otherwise(F.col("text"))
    rows = paragraphs.where("kind IN ('paragraph', 'row') AND text != ''")
    got = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((F.col("kind") == "row").cast("int").alias("k"), "ordinal", line.alias("l")))).alias("x"))
    return got.select("path", F.array_join(F.transform("x", lambda s: s["l"]), "\n\n").alias("text"))


def as_xlsx(df: DataFrame, file: str, order: str) -> DataFrame:
    """file and content: a workbook of each group of column file; a group is one file and must fit a task."""
    columns = [c for c in df.columns if c != file]
    sheets = df.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), *columns))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                made = [xlsx_bytes({"Sheet1": [columns, *([None if r[c] != r[c] else r[c] for c in columns] for r in rows)]}) for rows in part.column("rows").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(file), pa.array(made, pa.binary())], names=[file, "content"])

    return sheets.mapInArrow(run, f"{file} {dict(df.dtypes)[file]}, content binary")
