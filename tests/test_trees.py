"""Trees of containers: bounds carried down, what is a piece, fallbacks; office files as trees; sections."""

import zipfile

from pyspark.sql import functions as F

from papyra.sources import office as O
from papyra.sources import structure as St

SCHEMA = "doc_id string, ord int, parent int, type string, text string, path array<string>, page int, slide int, sheet string, cells string, parser string"


def nodes(spark, rows):
    return spark.createDataFrame([(d, o, p, t, x, path or [], pg, sl, sh, c, ps) for d, o, p, t, x, path, pg, sl, sh, c, ps in rows], SCHEMA)


def n(d, o, p, t, x, path=None, page=None, slide=None, sheet=None, cells=None, parser="pdf"):
    return (d, o, p, t, x, path, page, slide, sheet, cells, parser)


def test_bounds_are_carried_down_a_deep_tree(spark):
    deep = [n("a", 0, None, "document", "all"), n("a", 1, 0, "page", "first", page=1), n("a", 20, 0, "page", "second", page=2)]
    deep += [n("a", i, i - 1, "block", f"b{i}") for i in range(2, 15)] + [n("a", 21, 20, "sheet", "inner", sheet="S"), n("a", 22, 21, "block", "x", page=9)]
    got = {r.ord: (r.page, r.sheet) for r in St.placed(nodes(spark, deep)).collect()}
    assert got[0] == (None, None) and all(got[i] == (1, None) for i in range(1, 15)) and got[20] == (2, None) and got[21] == (2, "S") and got[22] == (9, "S")


def test_what_is_a_piece(spark):
    rows = [
        n("paged", 0, None, "document", "all"), n("paged", 1, 0, "page", "page one", page=1), n("paged", 2, 1, "paragraph", "page one"), n("paged", 3, 1, "table", "t1", path=["H", "I"]), n("paged", 4, 1, "caption", " \t\n "), n("paged", 5, 1, "caption", None),
        n("flow", 0, None, "document", "all", parser="docx"), n("flow", 1, 0, "heading", "Title", path=["Title"], parser="docx"), n("flow", 2, 1, "paragraph", "body", path=["Title"], parser="docx"),
        n("plain", 0, None, "document", "# Head\n\nsome text", parser="txt"), n("plain", 1, 0, "paragraph", "some text", parser="txt"),
        n("sheet", 0, None, "document", "all"), n("sheet", 1, 0, "sheet", "sheet text", sheet="S1"), n("sheet", 2, 1, "table_row", "a=1", cells="A1:B1"), n("sheet", 3, 0, "sheet", "bare", sheet="S2"),
        n("empty", 0, None, "document", None), n("slides", 0, None, "document", ""), n("slides", 1, 0, "slide", "one", slide=3),
    ]
    got = {}
    for r in St.pieces(nodes(spark, rows)).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.type, r.heading, r.text, r.page, r.slide, r.sheet))
    assert got == {
        "paged": [(0, "page", "Page 1", "page one", 1, None, None), (1, "table", "H / I", "t1", 1, None, None)],
        "flow": [(0, "heading", "Title", "Title", None, None, None), (1, "paragraph", "Title", "body", None, None, None)],
        "plain": [(0, "document", "Head", "some text", None, None, None)],
        "sheet": [(0, "table_row", "A1:B1", "a=1", None, None, "S1"), (1, "sheet", "S2", "bare", None, None, "S2")],
        "slides": [(0, "slide", "Slide 3", "one", None, 3, None)],
    }
    assert St.pieces(nodes(spark, rows).limit(0)).count() == 0


def test_long_pages_are_cut_inside_their_bounds(spark):
    words = " ".join(f"w{i}" for i in range(2000))
    rows = [n("d", 0, None, "document", "")] + [n("d", p, 0, "page", f"p{p} " + words, page=p) for p in (1, 2, 3)]
    got = St.pieces(nodes(spark, rows), size=100, limit=80).collect()
    assert len(got) > 60 and {r.page for r in got} == {1, 2, 3} and [r.idx for r in sorted(got, key=lambda r: r.idx)] == list(range(len(got)))
    for p in (1, 2, 3):
        own = [r.text for r in sorted(got, key=lambda r: r.idx) if r.page == p]
        assert "".join(own).replace(" ", "") == f"p{p}" + words.replace(" ", "") and own[0].startswith(f"p{p}")
    a = St.anchors(St.pieces(nodes(spark, rows))).first()
    assert len(a.pages) == 1 and a.slides == [] and a.sheets == [] and a.types == ["page"]


def test_office_files_become_trees(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Numbers" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>fox</t></is></c></row></sheetData></worksheet>')
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    with zipfile.ZipFile(tmp_path / "talk.pptx", "w") as z:
        for i in (1, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {a}><p:sp><a:p><a:r><a:t>said on {i}</a:t></a:r></a:p></p:sp></p:sld>")
    tree = St.of_office(O.office_files(spark, str(tmp_path)))
    got = [(r.doc_id.split("/")[-1], r.type, r.heading, r.text, r.slide, r.sheet) for r in St.pieces(tree).orderBy("doc_id", "idx").collect()]
    assert got == [
        ("book.xlsx", "table_row", "A1:A1", "name", None, "Numbers"), ("book.xlsx", "table_row", "A2:A2", "name=fox", None, "Numbers"),
        ("talk.pptx", "slide", "Slide 1", "said on 1", 1, None), ("talk.pptx", "slide", "Slide 2", "said on 2", 2, None)]


def test_rows_sections_and_concepts(spark):
    d = spark.createDataFrame([(["a", " ", None, "d"], ["h", "x", "y"])], "v array<string>, h array<string>")
    assert d.select(St.row_text(F.col("v"), F.col("h"))).first()[0] == "h=a / d"
    rows = [n("d", 0, None, "document", "whole"), n("d", 1, 0, "paragraph", "before"), n("d", 2, 0, "heading", "One"), n("d", 3, 2, "paragraph", " "), n("d", 4, 2, "paragraph", "a  b"), n("d", 5, 2, "paragraph", "c"), n("d", 6, 2, "paragraph", "d"), n("d", 7, 0, "section", "x" * 300), n("e", 0, None, "document", " only its own ")]
    got = sorted((r.doc_id, r.kind, r.ord, r.content) for r in St.derived(nodes(spark, rows)).filter("kind = 'section_summary'").collect())
    assert got == [("d", "section_summary", 2, "One a b c"), ("d", "section_summary", 7, "x" * 280 + "…")]
    assert {r.doc_id: r.text for r in St.said(nodes(spark, rows)).collect()}["e"] == "only its own"
    t = spark.createDataFrame([(1, "Straße straße ÉTOILE étoile étoile word knowledge 知识图谱 知识图谱 知识图谱 知识"), (2, "a bb ccc dddd"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.concepts for r in St.concepts(t).collect()} == {1: "étoile, 知识图谱, straße, knowledge"}
