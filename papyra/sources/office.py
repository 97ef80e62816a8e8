"""Office files and e-books to nodes: what a file holds, in reading order, with the place each part is at."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources.html import to_text

#: Bytes that all parts of a container may unpack to; a file beyond it is reported, not read.
UNPACKED = 512 << 20


class Node(NamedTuple):
    kind: str  # heading, paragraph, list_item, caption, row, slide, footnote, page
    level: int  # of headings, else 0
    place: str  # sheet and cells, slide, table and row; else empty
    text: str
    formula: str = ""


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ElementTree.Element | None, name: str) -> str:
    """An attribute in whatever namespace."""
    return "" if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _runs(e: ElementTree.Element) -> str:
    """The text of a paragraph: its t elements, tabs and line breaks as blanks."""
    said = (x.text or "" if _local(x) == "t" else " " if _local(x) in ("tab", "br") else "" for x in e.iter())
    return " ".join("".join(said).split())


def _numbered(names: list[str], form: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(form, n)))


def docx(z: zipfile.ZipFile) -> list[Node]:
    out: list[Node] = []
    tables = 0

    def walk(parent: ElementTree.Element) -> None:
        nonlocal tables
        for e in parent:
            if _local(e) == "tbl":
                tables += 1
                for i, row in enumerate(e.findall("{*}tr"), 1):
                    cells = [" ".join(t for p in c.iter() if _local(p) == "p" and (t := _runs(p))) for c in row.findall("{*}tc")]
                    if any(cells):
                        out.append(Node("row", 0, f"table {tables} row {i}", " | ".join(cells)))
            elif _local(e) == "p":
                text = _runs(e)
                style = _attr(e.find("{*}pPr/{*}pStyle"), "val").lower()
                head = re.fullmatch(r"heading\s*([1-9])", style)
                if not text:
                    continue
                if head or style == "title":
                    out.append(Node("heading", min(6, int(head[1])) if head else 1, "", text))
                elif style == "caption":
                    out.append(Node("caption", 0, "", text))
                else:
                    out.append(Node("list_item" if e.find("{*}pPr/{*}numPr") is not None else "paragraph", 0, "", text))
            elif _local(e) in ("sdt", "sdtContent", "ins"):
                walk(e)

    walk(_xml(z, "word/document.xml").find("{*}body"))
    return out


def pptx(z: zipfile.ZipFile) -> list[Node]:
    out = []
    for n, name in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"):
        place = f"slide {n}"
        for e in _xml(z, name).iter():
            if _local(e) == "sp":
                lines = [t for p in e.iter() if _local(p) == "p" and (t := _runs(p))]
                title = any(_attr(x, "type") in ("title", "ctrTitle") for x in e.iter() if _local(x) == "ph")
                if lines:
                    out.append(Node("heading" if title else "slide", 1 if title else 0, place, " ".join(lines) if title else "\n".join(lines)))
            elif _local(e) == "tr":
                cells = [" ".join(t for p in c.iter() if _local(p) == "p" and (t := _runs(p))) for c in e.findall("{*}tc")]
                if any(cells):
                    out.append(Node("row", 0, place, " | ".join(cells)))
        rels = f"ppt/slides/_rels/slide{n}.xml.rels"
        for r in _xml(z, rels) if rels in z.namelist() else ():
            notes = "ppt/" + _attr(r, "Target").removeprefix("../")
            if "notesSlide" in notes and notes in z.namelist():
                said = [t for p in _xml(z, notes).iter() if _local(p) == "p" and (t := _runs(p))]
                if said:
                    out.append(Node("footnote", 0, place, "\n".join(said)))
    return out


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(z: zipfile.ZipFile) -> list[Node]:
    """One node a row: ``header=value | ...`` under the first row that holds anything; cells of a merged range carry its value."""
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _xml(z, "xl/workbook.xml").iter():
        if _local(sheet) != "sheet":
            continue
        link = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), "")
        target = rels.get(link, "")
        part = target.lstrip("/") if target.startswith("/") else "xl/" + target
        if part not in names:
            continue
        title, root = _attr(sheet, "name"), _xml(z, part)
        grid: dict[int, dict[int, str]] = {}
        formulas: dict[int, list[str]] = {}
        for c in root.iter():
            ref = re.fullmatch(r"([A-Z]+)(\d+)", _attr(c, "r")) if _local(c) == "c" else None
            if not ref:
                continue
            row, col = int(ref[2]), _column(ref[1])
            value = c.find("{*}v")
            text = "" if value is None else value.text or ""
            if _attr(c, "t") == "s" and text:
                text = shared[int(text)]
            elif _attr(c, "t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
            if text.strip():
                grid.setdefault(row, {})[col] = " ".join(text.split())
            formula = c.find("{*}f")
            if formula is not None and formula.text:
                formulas.setdefault(row, []).append(f"{ref[0]}={formula.text}")
        for m in root.iter():
            ends = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", _attr(m, "ref")) if _local(m) == "mergeCell" else None
            if ends and (value := grid.get(int(ends[2]), {}).get(_column(ends[1]))):
                # only rows that hold something are filled, so a merge over a whole column costs nothing
                for row in [r for r in grid if int(ends[2]) <= r <= int(ends[4])]:
                    used = max(grid[row])
                    for col in range(_column(ends[1]), min(_column(ends[3]), max(used, _column(ends[1]))) + 1):
                        grid[row].setdefault(col, value)
        head = grid[min(grid)] if grid else {}
        for row in sorted(grid):
            cells = grid[row]
            first = row == min(grid)
            said = [v if first or col not in head else f"{head[col]}={v}" for col, v in sorted(cells.items())]
            out.append(Node("heading" if first else "row", 0, f"{title}!{_letters(min(cells))}{row}:{_letters(max(cells))}{row}", " | ".join(said), "; ".join(formulas.get(row, []))))
    return out


def epub(z: zipfile.ZipFile) -> tuple[str, list[Node]]:
    """Pages in the order of their names; navigation, contents and cover are left out; the first title wins."""
    title, out = "", []
    for name in sorted(z.namelist()):
        if re.search(r"\.x?html?$", name, re.I) and not re.search("nav|toc|cover", name.rpartition("/")[2], re.I):
            t, text = to_text(z.read(name).decode("utf-8", "replace"))
            title = title or t
            if text:
                out.append(Node("page", 0, name, text))
    return title, out


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "xlsm": xlsx, "epub": epub}


def read(name: str, content: bytes) -> tuple[str, list[Node], str | None]:
    """(title, nodes, problem) of one file, told by its extension. A file that can't be read has a problem and no nodes."""
    stem, _, kind = name.rpartition(".")
    reader = READERS.get(kind.lower())
    if reader is None:
        return stem or name, [], f"unsupported: {kind.lower()}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if sum(i.file_size for i in z.infolist()) > UNPACKED:
                return stem, [], f"unpacks to more than {UNPACKED} bytes"
            found = reader(z)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, AttributeError, TypeError) as e:
        return stem, [], f"damaged: {type(e).__name__}"
    title, nodes = found if isinstance(found, tuple) else (next((n.text for n in found if n.kind == "heading" and n.level == 1), ""), found)
    return title or stem, nodes, None


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, title, problem, idx, kind, level, place, text, formula): a row for each node; a file without nodes has one row with null ``idx``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    kept = named.filter(~F.col("name").startswith("~$") & F.lower("name").rlike(r"[.](" + "|".join(READERS) + ")$"))

    @F.pandas_udf("title string, problem string, nodes array<struct<kind: string, level: int, place: string, text: string, formula: string>>")
    def parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in parts:
            found = [read(n, bytes(c)) for n, c in zip(names, contents, strict=True)]
            yield pd.DataFrame({"title": [t for t, _, _ in found], "problem": pd.Series([p for _, _, p in found], dtype=object), "nodes": [[n._asdict() for n in ns] for _, ns, _ in found]})

    done = kept.select("path", "name", parse("name", "content").alias("f"))
    nodes = done.select("path", "name", "f.title", "f.problem", F.posexplode_outer("f.nodes").alias("i", "n"))
    return nodes.select("path", "name", "title", "problem", F.col("i").cast("long").alias("idx"), "n.*")
