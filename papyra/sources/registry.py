"""One reader for all kinds of files: the extension, or what the file begins with, says which parser reads it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources import office
from papyra.sources.html import to_text
from papyra.sources.tables import _decoded

#: Extensions that are read as plain text, and as web pages.
TEXT = "txt md markdown mdx csv json log".split()
HTML = ["html", "htm"]
#: Folders under the one that is read.
DEPTH = 32


def supported() -> list[str]:
    return [*TEXT, *HTML, *office.READERS]


def parse(name: str, content: bytes) -> tuple[str, str, str, str | None]:
    """(kind, title, text, problem) of one file."""
    stem, _, ext = name.rpartition(".")
    ext, stem = ext.lower(), stem or name
    if content.startswith(b"%PDF-"):
        return "pdf", stem, "", "no parser: pdf"
    if ext in HTML:
        title, text = to_text(_decoded(content))
        return "html", title or stem, text, None
    if ext in office.READERS:
        title, nodes, problem = office.read(name, content)
        return ext, title, "\n\n".join("#" * max(n.level, 1) + " " + n.text if n.kind == "heading" else n.text for n in nodes), problem
    if ext in TEXT:
        return "text", stem, _decoded(content), None
    return ext, stem, "", f"unsupported: {ext}"


def documents(spark: SparkSession, path: str, depth: int = DEPTH) -> DataFrame:
    """(path, name, hash, kind, title, text, problem) of every file up to ``depth`` folders down; a file that can't be read has a problem and an empty text, and stops no other. Office lock files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.size(F.split(F.substring_index("path", root + "/", -1), "/")) - 1
    kept = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").filter(~F.col("name").startswith("~$") & (below <= depth))

    @F.pandas_udf("kind string, title string, text string, problem string")
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in parts:
            yield pd.DataFrame([parse(n, bytes(c)) for n, c in zip(names, contents, strict=True)], columns=["kind", "title", "text", "problem"], dtype=object)

    return kept.select("path", "name", F.sha2("content", 256).alias("hash"), read("name", "content").alias("d")).select("path", "name", "hash", "d.*")
