"""How well a text was extracted: measures, health, which of two candidates is better, status and score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a healthy text.
REPLACED, PRINTABLE, AVERAGE_LINE, FRAGMENTS, FRAGMENT = 0.05, 0.8, 5.0, 0.5, 5

#: How much a status counts.
SCORES = {"GOOD": 1.0, "WARNING": 0.7, "LOW_QUALITY": 0.3, "INCOMPLETE": 0.0}

#: Characters a page under which a text is thin, and pages and characters that mean text was lost.
THIN, LOST_PAGES, LOST_CHARS = 100.0, 100, 40


def measures(text: Column, pages: Column) -> Column:
    """A struct of a text's measures over its lines that aren't blank; all 0, but replaced 1, for a blank text."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    body = F.array_join(lines, "")
    n = F.length(body)
    sizes = F.array_sort(F.transform(lines, lambda x: F.length(x)))
    count = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    part = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    k = F.size(lines)
    return F.struct(
        n.cast("long").alias("chars"),
        F.when(n > 0, count("[^\ufffd]") / n).otherwise(1.0).alias("replaced"),
        part(count("[\ufffd\\p{C}\\p{Zl}\\p{Zp}\\p{Zs}&&[^ ]]")).alias("printable"),
        part(count(r"[^\p{IsHan}]")).alias("cjk"),
        part(count(r"[^\p{L}\p{Nd}]")).alias("alnum"),
        F.when(k > 0, n / k).otherwise(0.0).alias("average_line"),
        F.when(k > 0, F.get(sizes, F.floor(k / 2).cast("int"))).otherwise(0).cast("double").alias("median_line"),
        F.when(k > 0, F.size(F.filter(sizes, lambda s: s < FRAGMENT)) / k).otherwise(0.0).alias("fragments"),
        F.when(pages > 0, n / pages).otherwise(0.0).alias("a_page"),
    )


def healthy(m: Column) -> Column:
    return (m["chars"] > 0) & (m["replaced"] <= REPLACED) & (m["printable"] >= PRINTABLE) & (m["average_line"] >= AVERAGE_LINE) & (m["fragments"] <= FRAGMENTS)


def better(a: Column, b: Column) -> Column:
    """Whether candidate ``a`` is chosen over ``b``: health, then length, then replaced characters, then lines."""
    lines = a["median_line"] >= b["median_line"]
    both = F.when(a["chars"] > b["chars"], True).when(b["chars"] > a["chars"], False).when(F.abs(a["replaced"] - b["replaced"]) > 0.005, a["replaced"] < b["replaced"]).otherwise(lines)
    neither = F.when(a["replaced"] != b["replaced"], a["replaced"] < b["replaced"]).otherwise(lines)
    return F.when(healthy(a) != healthy(b), healthy(a)).when(healthy(a), both).otherwise(neither)


def dense_enough(m: Column, pages: Column) -> Column:
    """Whether a short recognised text holds enough to be kept."""
    return (m["chars"] > 0) & (m["cjk"] + m["alnum"] >= 0.5) & ((pages <= 0) | (m["a_page"] >= 1))


def recognised_wins(native: Column, native_healthy: Column, text: Column, pages: Column) -> Column:
    """Whether a recognised text replaces the native one: readable, and much fuller than a healthy one or a quarter of an unhealthy one."""
    m = measures(text, pages)
    readable = (F.trim(text) != "") & (healthy(m) | dense_enough(m, pages))
    n = F.length(native)
    return readable & F.when(n == 0, True).when(~native_healthy, m["chars"] >= F.floor(n / 4)).otherwise(m["chars"] > n * 2)


def status(chars: Column, healthy_: Column, pages: Column, partial: Column, method: Column) -> Column:
    """GOOD, WARNING, LOW_QUALITY or INCOMPLETE; without pages the text alone decides."""
    a_page = chars / pages
    thin = F.when((pages >= LOST_PAGES) & (a_page < LOST_CHARS), "INCOMPLETE").when(chars <= 0, "INCOMPLETE").when(~healthy_, "LOW_QUALITY").when(partial, "WARNING").when((a_page < THIN) & (method != "ocr"), "WARNING").otherwise("GOOD")
    return F.when(pages <= 0, F.when(chars <= 0, "INCOMPLETE").when(~healthy_, "LOW_QUALITY").otherwise("GOOD")).otherwise(thin)


def score(status_: Column) -> Column:
    out = F.lit(0.0)
    for name, value in SCORES.items():
        out = F.when(status_ == name, value).otherwise(out)
    return out
