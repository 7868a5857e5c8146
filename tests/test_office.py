"""Workbooks, tables of documents and damaged files."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lakequill.operators import workbooks
from lakequill.sources import office


def files(spark, contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def cells_of(spark, books):
    return office.parsed(files(spark, [office.xlsx_bytes(b) for b in books]), office.CELLS, lambda d: office.parse_xlsx(d)[0])


def test_chunks_of_lines_are_flushed_at_twenty_filled_rows(spark):
    rows = [["name", None, "qty"]] + [[f"n{k}", f"extra{k}" if k == 3 else None, None if k % 7 == 5 else k] if k % 10 else [None, None, None] for k in range(1, 47)] + [[None, None, 0.0]]
    got = sorted(map(tuple, workbooks.line_chunks(cells_of(spark, [{"a": rows, "b": [["only names"]], "c": [["h"], ["v"]]}])).select("sheet", "start_row", "end_row", "content").collect()))
    assert [g[:3] for g in got] == [("a", 2, 23), ("a", 24, 45), ("a", 46, 48), ("c", 2, 2)]
    assert got[0][3].startswith("## 表格区域：a（第 2 到 23 行）\nname: n1 | qty: 1\n") and "name: n3 | : extra3 | qty: 3" in got[0][3] and "\nname: n5\n" in got[0][3]


@pytest.mark.parametrize(("n", "parts"), [(1, [(0, 1)]), (75, [(0, 75)]), (76, [(0, 50), (50, 76)]), (151, [(0, 50), (50, 100), (100, 150), (150, 151)])])
def test_tables_stay_whole_to_seventy_five_rows(spark, n, parts):
    book = {"s": [["k", "v"]] + [[k, "a\nb"] for k in range(n)]}
    got = sorted(map(tuple, workbooks.table_chunks(cells_of(spark, [book])).select("start_row", "end_row", "content").collect()))
    assert [g[:2] for g in got] == parts
    lines = got[-1][2].split("\n")
    assert lines[:4] == [f"## 表格工作簿：s（第{parts[-1][0] + 1}-{n}行，共{n}行）", "", "| k | v |", "|---|---|"] and lines[-1] == f"| {n - 1}|a b |"


def test_chunks_are_numbered_over_the_sheets_of_a_file(spark):
    cells = cells_of(spark, [{"z": [["h"], ["1"]], "a": [["h"]] + [["x"]] * 25}])
    order = spark.createDataFrame([("f0", "z", 0), ("f0", "a", 1)], "path string, sheet string, at int")
    got = sorted((r["pos"], r["sheet"], r["chunk_id"]) for r in workbooks.numbered(workbooks.line_chunks(cells), order).collect())
    assert got == [(0, "z", "f0_0"), (1, "a", "f0_1"), (2, "a", "f0_2")]


def test_spans_of_tables_are_filled_in(spark):
    xml = office.table_xml([[("A", 2, False), ("B", 1, False)], [("x", 1, False), ("y", 1, False), ("z", 1, False)], [("", 1, True), ("w", 2, False)]])
    data = office.docx_bytes([("p", 0)], xml + office.table_xml([[("lonely", 1, False)]]) + office.table_xml([[("", 1, False)], [("1", 1, False)]]))
    assert office.parse_docx_tables(data)[:9] == [(1, 1, 1, "A"), (1, 1, 2, "A"), (1, 1, 3, "B"), (1, 2, 1, "x"), (1, 2, 2, "y"), (1, 2, 3, "z"), (1, 3, 1, "x"), (1, 3, 2, "w"), (1, 3, 3, "w")]
    cells = office.parsed(files(spark, [data, b"junk"]), office.TABLE_CELLS, office.parse_docx_tables)
    got = sorted((r["tbl"], r["row"], r["fields"]) for r in workbooks.frames(cells).collect())
    assert got == [(1, 1, {"A": "x", "B": "z"}), (1, 2, {"A": "x", "B": "w"})]
    assert cells.where(F.col("error").isNotNull()).count() == 1


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_every_beginning_of_a_file_gives_what_comes_before_the_cut(method):
    whole = office.docx_bytes([(f"line {k} with some & words", k % 2) for k in range(60)], office.table_xml([[("a", 1, False), ("", 1, False), ("b\tc", 1, False)]] * 3))
    sink = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as z, zipfile.ZipFile(sink, "w", method) as out:
        for n in z.namelist():
            out.writestr(n, z.read(n))
    data = sink.getvalue()
    want = [(k, "paragraph", f"line {k} with some & words") for k in range(60)] + [(60 + k, "row", "a | b c") for k in range(3)]
    assert office.recover_docx(data) == want
    full, longest = "\n".join(x[2] for x in want), 0
    for end in range(0, len(data), 97):
        got = office.recover_docx(data[:end])
        text = "\n".join(x[2] for x in got)
        cut = text.rstrip("&amp; |")
        assert full.startswith(cut), (end, text[-40:])
        longest = max(longest, len(got))
        assert got[:-1] == want[: max(0, len(got) - 1)]
    assert longest == len(want) and office.recover_docx(b"") == office.recover_docx(b"junk") == []


def with_image(text, picture):
    """A document that refers to an image."""
    data, sink = office.docx_bytes([(text, 0)]), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(sink, "w") as out:
        for n in z.namelist():
            body = z.read(n).decode()
            if n == "word/document.xml":
                body = body.replace("</w:body>", '<w:p><w:r><w:drawing><a:blip xmlns:a="urn:a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="rId7"/></w:drawing></w:r></w:p></w:body>')
            out.writestr(n, body.replace("<Override", '<Default Extension="png" ContentType="image/png"/><Override', 1) if n == "[Content_Types].xml" else body)
        out.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="http://x/image" Target="media/image1.png"/></Relationships>')
        out.writestr("word/media/image1.png", picture)
    return sink.getvalue()


def test_documents_are_merged_with_tables_and_images():
    table = office.table_xml([[("a", 1, False), ("b", 1, False)], [("1 < 2", 2, False)]])
    merged = office.merge_docx([("one.docx", with_image("first", b"P1")), ("two.docx", office.docx_bytes([("Title", 2)], table)), ("three.docx", with_image("last", b"P2"))])
    rows = office.parse_docx(merged)
    assert [(r[1], r[3]) for r in rows if r[3] or r[1] == "image"] == [("paragraph", "one.docx"), ("paragraph", "first"), ("image", ""), ("paragraph", "two.docx"), ("paragraph", "Title"), ("row", "a | b"), ("row", "1 < 2"), ("paragraph", "three.docx"), ("paragraph", "last"), ("image", "")]
    assert office.parse_docx_tables(merged) == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "1 < 2"), (1, 2, 2, "1 < 2")]
    with zipfile.ZipFile(io.BytesIO(merged)) as z:
        xml, rels = z.read("word/document.xml").decode(), z.read("word/_rels/document.xml.rels").decode()
        assert {z.read(f"word/d{k}/image1.png") for k in (0, 2)} == {b"P1", b"P2"}
        assert len(set(re.findall(r'embed="(rId\d+)"', xml))) == 2 and all(f'Id="{i}"' in rels for i in re.findall(r'embed="(rId\d+)"', xml))
        assert xml.count('w:type="page"') == 2 and 'Extension="png"' in z.read("[Content_Types].xml").decode()
