"""Units of two states told apart: same, moved, changed, renamed, split, removed, added."""

from papyra.operators import comparing as Cm


def test_what_became_of_each_unit(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    unit = "type string, key string, content string, sources array<string>"
    before = [("fact", "same", words(0, 9), ["1", "2"]), ("fact", "moved", words(0, 9), ["1"]), ("fact", "changed", words(0, 9), ["1"]), ("fact", "old", words(100, 110), ["1"]), ("fact", "long", words(200, 240), ["1"]), ("fact", "gone", words(300, 310), []), ("topic", "t", words(100, 110), []), ("fact", "blank", None, [])]
    after = [("fact", "same", words(0, 9), ["2", "1"]), ("fact", "moved", words(0, 9), ["3"]), ("fact", "changed", words(1, 9), ["1"]), ("fact", "new", words(101, 110) + " more", ["1"]), ("fact", "first", words(200, 220), ["1"]), ("fact", "second", words(220, 240), ["1"]), ("fact", "alone", words(300, 305) + " " + words(400, 405), []), ("fact", "empty", "", [])]
    got = {(r.type, r.key): (r.status, r.other, r.share) for r in Cm.compared(spark.createDataFrame(before, unit), spark.createDataFrame(after, unit)).collect()}
    assert got == {
        ("fact", "same"): ("same", "same", None), ("fact", "moved"): ("moved", "moved", None), ("fact", "changed"): ("changed", "changed", None),
        ("fact", "old"): ("renamed", "new", round(9 / 11, 6)), ("fact", "new"): ("renamed", "old", round(9 / 11, 6)),
        ("fact", "long"): ("split", None, None), ("fact", "first"): ("part", "long", 1.0), ("fact", "second"): ("part", "long", 1.0),
        ("fact", "gone"): ("removed", None, None), ("fact", "alone"): ("added", None, None), ("topic", "t"): ("removed", None, None), ("fact", "blank"): ("removed", None, None), ("fact", "empty"): ("added", None, None)}
    none = spark.createDataFrame([], unit)
    assert Cm.compared(none, none).count() == 0


def test_a_word_that_all_units_hold_pairs_none_of_them(spark):
    rows = lambda side: [("fact", f"{side}{i}", "the " + " ".join(f"{side}{i}x{j}" for j in range(5)), []) for i in range(200)]
    unit = "type string, key string, content string, sources array<string>"
    got = Cm.compared(spark.createDataFrame(rows("a"), unit), spark.createDataFrame(rows("b"), unit))
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"removed": 200, "added": 200}
