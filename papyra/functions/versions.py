"""Version identities and their partial order as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(v: Column) -> Column:
    """'rel-N' for releases, 'a.b.c' for compact six-digit forms, else the dotted version without v; null if it is none."""
    low = F.lower(F.trim(v))
    rel = F.regexp_extract(low, r"^(?:release|rel)[ ._-]*([0-9]+)$", 1)
    compact = F.regexp_extract(low, r"^v([0-9]{6})$", 1)
    dotted = F.regexp_extract(low, r"^v?([0-9]+(?:[.][0-9]+){1,3})$", 1)
    suffix = F.regexp_extract(low, r"^v?([0-9]+(?:[.][0-9]+){1,3}[-+_][a-z0-9.]+)$", 1)
    part = lambda i: F.substring(compact, i, 2).cast("int").cast("string")
    return (
        F.when(rel != "", F.concat(F.lit("rel-"), rel))
        .when(compact != "", F.concat_ws(".", part(1), part(3), part(5)))
        .when(dotted != "", dotted)
        .when(suffix != "", F.replace(suffix, F.lit("_"), F.lit("-")))
        .when((F.length(low).between(1, 64)) & ~low.rlike(r"\s"), F.regexp_replace(low, "^(version|release):", ""))
    )


def known(n: Column) -> Column:
    return n.rlike(r"^([0-9]+([.][0-9]+)+|rel-[0-9]+)$")


def parts(n: Column) -> Column:
    """Four numbers, missing ones 0; null if the order is unknown."""
    nums = F.transform(F.split(F.regexp_replace(n, "^rel-", ""), "[.]"), lambda x: x.cast("long"))
    padded = F.slice(F.concat(nums, F.array_repeat(F.lit(0).cast("long"), 4)), 1, 4)
    return F.when(known(n), padded)


def compare(a: Column, b: Column) -> Column:
    """-1, 0, 1, or null where two identities can't be ordered (releases against numbers, suffixes)."""
    same = a.startswith("rel-") == b.startswith("rel-")
    return F.when(a == b, 0).when(same & known(a) & known(b), F.when(parts(a) < parts(b), -1).when(parts(a) > parts(b), 1).otherwise(0)).cast("int")
