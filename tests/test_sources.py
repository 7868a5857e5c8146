from lakequill.sources import office


def test_xlsx_round_trip(spark, tmp_path):
    rows = [["国家", "人口", None], ["中国", 1400, "a & b"], ["法国", 67.5, ""]]
    (tmp_path / "a.xlsx").write_bytes(office.xlsx_bytes({"s1": rows, "s2": [["x"]]}))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = office.read_xlsx(spark, f"file://{tmp_path}").collect()
    cells = {(r["sheet"], r["row"], r["col"]): r["value"] for r in got if r["error"] is None}
    assert cells["s1", 1, 1] == "国家" and cells["s1", 2, 2] == "1400" and cells["s1", 2, 3] == "a & b" and cells["s2", 1, 1] == "x" and ("s1", 1, 3) not in cells
    assert [r["path"].endswith("bad.xlsx") for r in got if r["error"]] == [True]


def test_docx_round_trip(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(office.markdown_to_docx("# 标题\n\n正文一\n| a | b |\n## 二级\n正文 <二>"))
    rows = office.read_docx(spark, f"file://{tmp_path}")
    got = [(r["text"], r["style"]) for r in rows.orderBy("ordinal").collect()]
    assert got == [("标题", "heading 1"), ("正文一", "Normal"), ("二级", "heading 2"), ("正文 <二>", "Normal")]
    assert office.docx_to_markdown(rows).first()["text"] == "# 标题\n\n正文一\n\n## 二级\n\n正文 <二>"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("第一行\n第二行")
    assert office.read_text(spark, f"file://{tmp_path}/a.txt").first()["text"] == "第一行\n第二行"


def test_tables_as_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("f1", 2, "b"), ("f1", 1, "a"), ("f2", 1, None)], "file string, k int, v string")
    got = {r["file"]: office.parse_xlsx(bytes(r["content"]))[0] for r in office.as_xlsx(df, "file", "k").collect()}
    assert [c[3] for c in got["f1"]] == ["k", "v", "1", "a", "2", "b"] and [c[3] for c in got["f2"]] == ["k", "v", "1"]
