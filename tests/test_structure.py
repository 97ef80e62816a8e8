"""Structure-aware chunks, office files and evidence crops."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import retrieval as R
from papyra.sources import chunker as C
from papyra.sources import office as O


def test_blocks_follow_headings_and_fences():
    text = "intro\nmore\n\n# A\none\n## B\ntwo\n\n```py\n# no heading\n\nx\n```\ntail\n# C\n1.2 Part\nthree\n####### seven"
    assert list(C.blocks(text)) == [
        ("intro\nmore", ""),
        ("one", "A"),
        ("two", "A > B"),
        ("```py\n# no heading\n\nx\n```\ntail", "A > B"),
        ("three\n####### seven", "C > 1.2 Part"),
    ]


def test_windows_take_the_best_break():
    text = "a" * 85 + "\n---\n" + "b" * 99
    assert list(C.windows(text, 100)) == ["a" * 85 + "\n---", "b" * 99]
    assert list(C.windows("x" * 250, 100)) == ["x" * 100, "x" * 100, "x" * 50]
    cjk = "字" * 90 + "。" + "字" * 60
    assert list(C.windows(cjk, 100)) == ["字" * 90 + "。", "字" * 60]


@pytest.mark.parametrize("seed", range(30))
def test_pieces_hold_the_whole_text(seed):
    rnd = random.Random(seed)
    words = ["word", "知识。", "- item", "\n", "\n\n", "\n```\n", "\n---\n", "x" * 90, "1. a"]
    text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 900))).strip()
    bare = lambda s: "".join(s.split())
    pieces = C.smart(text, 64)
    # headings are told by the paths, all else is in the pieces, in order
    assert bare("".join(t for t, _ in pieces)) == bare("".join(t for t, _ in C.blocks(text)) or text)
    assert all(len(t) <= C.characters(text, 64) for t, _ in pieces)
    small = C.refine(pieces, 20)
    assert bare("".join(t for t, _ in small)) == bare("".join(t for t, _ in pieces))
    assert all(C.tokens(t) <= 20 or C._halves(t) is None or len(t) < 40 for t, _ in small)


def test_odd_texts():
    assert C.smart(None) == C.smart("") == []
    assert C.smart("# only a heading") == [("# only a heading", "")]
    assert C.refine([("a b", "")], 0) == [("a b", "")]
    assert C.merge([], []) == []


def test_merge_joins_what_is_alike():
    seg = [("aa", "H"), ("bb", "H"), ("cc", "H"), ("dd", "H")]
    v = [np.array(x, float) for x in ([1, 0], [0.9, 0.1], [0, 1], [0, 1])]
    got = C.merge(seg, v)
    assert [t for t, _, _ in got] == ["aa\nbb", "cc\ndd"] and np.allclose(got[0][2], [0.95, 0.05])
    assert [t for t, _, _ in C.merge(seg, [None] * 4)] == ["aa\nbb\ncc\ndd"]
    assert [t for t, _, _ in C.merge([("a" * 60, ""), ("b" * 400, "")], [None] * 2, 64)] == ["a" * 60, "b" * 400]


def test_smart_chunks(spark):
    d = spark.createDataFrame([(1, "# T\r\n\r\n\r\nbody", "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, idx string")
    assert [tuple(r) for r in C.smart_chunks(d).collect()] == [(1, 0, "T", "body")]
    assert [tuple(r) for r in C.semantic_chunks(d).collect()] == [(1, 0, "T", "body")]
    assert C.smart_chunks(d.limit(0)).count() == 0


def test_embedded_reuses_known_vectors(spark):
    c = spark.createDataFrame([(1, 0, "old"), (1, 1, "new one"), (2, 0, "new one")], "doc_id long, idx long, text string")
    known = spark.createDataFrame([("old", "hashed-words", [5.0]), ("new one", "other", [6.0])], "text string, model string, vector array<double>").select(F.sha2("text", 256).alias("text_hash"), "model", "vector")
    got = {(r.doc_id, r.idx): r for r in C.embedded(c, known).collect()}
    assert got[1, 0].vector == [5.0] and got[1, 0].reused
    assert got[1, 1].vector == got[2, 0].vector and not got[1, 1].reused and abs(np.linalg.norm(got[1, 1].vector) - 1) < 1e-9


def container(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


W = '<w:{0} xmlns:w="w" xmlns:a="a" xmlns:p="p" xmlns:r="r">'


def test_office_files(spark, tmp_path):
    para = lambda t, pr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    doc = W.format("document") + "<w:body>" + para("Head", '<w:pStyle w:val="Heading2"/>') + para("Text") + para("Item", "<w:numPr/>")
    doc += f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "a.DOCX").write_bytes(container(**{"word/document.xml": doc}))
    book = W.format("workbook") + '<w:sheets><w:sheet name="S" sheetId="1" r:id="q"/></w:sheets></w:workbook>'
    rels = '<R xmlns="x"><R Id="q" Target="worksheets/sheet1.xml"/></R>'
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>x</v></c><c r="B2"><f>1+1</f><v>2</v></c></row><row><c r="B3"><v>3</v></c>'
    sheet = f'<s xmlns="x"><row>{cells}</row><mergeCell ref="A2:A3"/></s>'
    (tmp_path / "b.xlsx").write_bytes(container(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": '<s xmlns="x"><si><t>name</t></si></s>', "xl/worksheets/sheet1.xml": sheet}))
    shape = lambda t, kind: W.format("sld") + f'<p:sp><p:ph type="{kind}"/><a:p><a:t>{t}</a:t></a:p></p:sp></w:sld>'
    slides = {f"ppt/slides/slide{n}.xml": shape(f"S{n}", "title") for n in (10, 2)}
    slides |= {"ppt/slides/_rels/slide2.xml.rels": '<R xmlns="x"><R Target="../notesSlides/notesSlide1.xml"/></R>', "ppt/notesSlides/notesSlide1.xml": shape("note", "body")}
    (tmp_path / "c.pptx").write_bytes(container(**slides))
    (tmp_path / "d.epub").write_bytes(container(**{"b.xhtml": "<p>two</p>", "a.html": "<title>T</title><p>one</p>", "nav.xhtml": "<p>no</p>"}))
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {}
    for r in O.office_files(spark, str(tmp_path)).orderBy("name", "idx").collect():
        got.setdefault(r.name, []).append((r.kind, r.place, r.text, r.formula, r.problem))
    assert [x[:3] for x in got["a.DOCX"]] == [("heading", "", "Head"), ("paragraph", "", "Text"), ("list_item", "", "Item"), ("row", "table 1 row 1", "a | b")]
    assert [x[:4] for x in got["b.xlsx"]] == [("heading", "S!A1:B1", "name | n", ""), ("row", "S!A2:B2", "name=x | n=2", "B2=1+1"), ("row", "S!A3:B3", "name=x | n=3", "")]
    assert [x[:3] for x in got["c.pptx"]] == [("heading", "slide 2", "S2"), ("footnote", "slide 2", "note"), ("heading", "slide 10", "S10")]
    assert [x[:3] for x in got["d.epub"]] == [("page", "a.html", "one"), ("page", "b.xhtml", "two")]
    assert got["e.docx"] == [(None, None, None, None, "damaged: BadZipFile")]


def test_overlap():
    shared = "a stretch that both of the texts hold"
    assert R.without_overlap("left " + shared, shared + " right") == " right"
    assert R.without_overlap("left ab", "ab right") == "ab right" and R.without_overlap("", "x") == "x" and R.without_overlap("x", "") == ""


def test_registry_reads_all_kinds(spark, tmp_path):
    from papyra.sources import registry
    from papyra.sources.html import strip_tags

    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "x.MD").write_bytes(b"\xef\xbb\xbf# T")
    (tmp_path / "p.html").write_bytes(b"<title>P</title><h1>Head</h1><p>text")
    (tmp_path / "f.txt").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "z.bin").write_bytes(b"\x00")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (deep / "y.txt").write_bytes(b"deep")
    got = {r["name"]: (r["kind"], r["title"], r["text"], r["problem"]) for r in registry.documents(spark, "file://" + str(tmp_path)).collect()}
    assert got["x.MD"] == ("text", "x", "# T", None) and got["p.html"] == ("html", "P", "# Head\ntext", None) and got["y.txt"][2] == "deep"
    assert got["f.txt"][0] == "pdf" and got["z.bin"][3] == "unsupported: bin" and got["bad.docx"][3].startswith("damaged")
    assert "y.txt" not in {r["name"] for r in registry.documents(spark, "file://" + str(tmp_path), depth=1).collect()}
    assert {"txt", "html", "docx", "epub"} <= set(registry.supported())
    assert strip_tags("a <b <c> d> e > f") == "a  e  f"
