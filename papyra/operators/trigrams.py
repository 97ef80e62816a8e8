"""Search for parts of words on a written index of words and their trigrams.

A term lies within one word, so where it occurs is told by the words that hold it. The index has the postings of whole
words, in segments that are each sorted by word, and a dictionary that has a row for each trigram of each distinct word. A
question finds the words that hold its terms by their rarest trigrams in the dictionary, then reads the postings of these
words and no others. Many questions at once go to all texts instead, in blocks: a task looks up which terms each distinct
word of its texts holds, once, and writes what each chunk holds; scores are added up from that, a few chunks kept a question.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.functions import language as L
from papyra.operators.lexical import Best, blocks_of, counted, found_schema, summed, weighed
from papyra.sources.store import fingerprint, written

#: Fixed values of the term score, and the least weight of a term that most chunks hold.
K1, B, LEAST = 1.2, 0.75, 1e-6
#: Trigrams of a term that narrow its words, trigrams and words up to which a scan is told them one by one, and terms up to which questions read postings.
RARE, NAMED, FEW = 4, 2000, 64
#: Words a task remembers the terms of.
REMEMBERED = 1 << 19
#: What parts words: ASCII signs and white space. No term holds any of them, so a term lies within a word whatever else the word holds.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"

WORD = BETWEEN.replace("[", "[^").replace("+", "{3,}")


@dataclass
class Index:
    """``postings``: word, doc_id, idx, tf, len (in trigrams), sorted by word within segments; ``grams``: gram, word, the dictionary, sorted by gram; ``counts``: gram, words; ``texts``: doc_id, idx, text, searched, sorted by document; how many chunks there are and how many trigrams they have on average."""

    postings: DataFrame
    grams: DataFrame
    counts: DataFrame
    texts: DataFrame
    chunks: int
    average: float


def grams(text: Column) -> Column:
    """All trigrams of a text in lower case, in order; none of a shorter one."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), 1)


def _size(text: Column) -> Column:
    """How many trigrams a text has."""
    return F.greatest(F.length(F.lower(text)) - 2, F.lit(0))


class Built(Index):
    """An index of written texts whose words and dictionary are written when they are first asked for, as many questions at once want the texts alone."""

    def __init__(self, texts: DataFrame, chunks: int, average: float):
        self.texts, self.chunks, self.average = texts, chunks, average

    @cached_property
    def postings(self) -> DataFrame:
        words = F.regexp_extract_all(F.lower("searched"), F.lit(WORD), 0)
        each = self.texts.select("doc_id", "idx", _size(F.col("searched")).alias("len"), F.explode(counted(words)).alias("t"))
        return written(each.select(F.col("t.term").alias("word"), "doc_id", "idx", "t.tf", "len").sortWithinPartitions("word", "doc_id", "idx"), "words")

    @cached_property
    def grams(self) -> DataFrame:
        of = self.postings.select("word").distinct().select(F.explode(F.array_distinct(grams(F.col("word")))).alias("gram"), "word")
        return written(of.sortWithinPartitions("gram", "word"), "grams")

    @cached_property
    def counts(self) -> DataFrame:
        return written(self.grams.groupBy("gram").agg(F.count("*").alias("words")).repartitionByRange("gram").sortWithinPartitions("gram"), "gram-counts")


def build(chunks: DataFrame) -> Index:
    """An index of chunks (doc_id, idx, text, and search_text where it differs from the text). Null texts have no trigrams. Texts are dealt out once; postings are counted inside each chunk and sorted inside each task, and only distinct words are shuffled."""
    searched = F.col("search_text") if "search_text" in chunks.columns else F.col("text")
    t = chunks.select("doc_id", "idx", "text", F.coalesce(searched, F.lit("")).alias("searched"))
    seen = Observation()
    dealt = t.repartitionByRange("doc_id", "idx").sortWithinPartitions("doc_id", "idx").observe(seen, F.count(F.lit(1)).alias("n"), F.avg(_size(F.col("searched"))).alias("a"))
    texts = written(dealt, "texts")
    return Built(texts, seen.get["n"], seen.get["a"] or 0.0)


_BUILT: dict[tuple[str, str], Index] = {}


def index_of(docs: DataFrame, chunks: DataFrame) -> Index:
    """The index of the chunks of a table of files, built once as long as the session lives and the files stay as they are."""
    key = (docs.sparkSession.sparkContext.applicationId, fingerprint(docs))
    if key not in _BUILT:
        _BUILT[key] = build(chunks)
    return _BUILT[key]


def _wanted(index: Index, terms: DataFrame) -> DataFrame:
    """(term, gram, needed): the ``RARE`` rarest trigrams of each term; a term with a trigram that no word has has none."""
    of = terms.select("term", F.explode(F.array_distinct(grams(F.col("term")))).alias("gram"))
    of = of.withColumn("all", F.count("*").over(Window.partitionBy("term")))
    known = of.join(index.counts, "gram").withColumn("found", F.count("*").over(Window.partitionBy("term"))).filter("found = all")
    rarest = Window.partitionBy("term").orderBy("words", "gram")
    kept = known.withColumn("n", F.row_number().over(rarest)).filter(F.col("n") <= RARE)
    return kept.select("term", "gram", F.least("all", F.lit(RARE)).alias("needed"))


def _told(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` where its column is one of the keys, told one by one if they are ``NAMED`` at most, so that only their pages are read."""
    names = [r[0] for r in keys.select(column).distinct().limit(NAMED + 1).collect()]
    if len(names) > NAMED:
        return df, False
    return df.filter(F.col(column).isin(names) if names else F.lit(False)), True


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """(term, doc_id, idx, tf, len): the chunks that hold each of the lower-case terms (term) of three characters or more, and how often."""
    wanted = _wanted(index, terms).persist()
    g, few = _told(index.grams, "gram", wanted)
    met = g.join(F.broadcast(wanted) if few else wanted, "gram").groupBy("term", "needed", "word").agg(F.count("*").alias("n")).filter("n = needed")
    # terms are letters, digits and _, so they stand for themselves in a pattern
    times = F.when(F.col("term") == F.col("word"), 1).otherwise(F.regexp_count("word", F.concat(F.lit("(?="), F.col("term"), F.lit(")"))))
    held = written(met.select("term", "word", times.cast("long").alias("times")).filter("times > 0"), "held")
    p, few = _told(index.postings, "word", held)
    each = p.join(F.broadcast(held) if few else held, "word")
    return each.groupBy("term", "doc_id", "idx", "len").agg(F.sum(F.col("tf") * F.col("times")).alias("tf")).select("term", "doc_id", "idx", "tf", "len")


class _Holders:
    """Which of some terms a word holds, and how often; told once a word by an automaton over all terms, as long as few enough words are remembered."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms, self.known, self.automaton = len(terms), {}, ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, i)
        if terms:
            self.automaton.make_automaton()

    def __call__(self, word: str) -> tuple[tuple[int, int], ...]:
        got = self.known.get(word)
        if got is None:
            times: dict[int, int] = {}
            for _, i in self.automaton.iter(word):
                times[i] = times.get(i, 0) + 1
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = tuple(sorted(times.items()))
        return got

    def batch(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of a batch of texts in lower case, sorted by row and term."""
        words = pc.split_pattern_regex(low, BETWEEN)
        row = np.repeat(np.arange(len(low)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        held = [self(w) for w in coded.dictionary.to_pylist()]
        n = np.array([len(h) for h in held], np.int64)
        pairs = np.array([p for h in held for p in h], np.int64).reshape(-1, 2)
        code = coded.indices.to_numpy(zero_copy_only=False)
        size, start = n[code], (np.cumsum(n) - n)[code]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, of = np.unique(np.repeat(row, size) * self.terms + pairs[at, 0], return_inverse=True)
        return key // self.terms, key % self.terms, np.bincount(of.ravel(), weights=pairs[at, 1], minlength=len(key))


def _list(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """An array of numbers for each of so many rows, of values sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values.astype(np.int32)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of arrays of numbers."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)


def _holding(index: Index, names: list[str], locators: list[str]) -> DataFrame:
    """(doc_id, idx, len, term, tf, stands), written: which of the terms each chunk holds as part of its words, how often, and which locators stand in its text, by their numbers; chunks without any are left out. All that is asked of the texts."""
    kind = lambda c: index.texts.schema[c].dataType.simpleString()
    none = np.zeros(0, np.int64)

    def f(batches):
        holders = _Holders(names)
        for b in batches:
            rows = b.num_rows
            row, term, tf = holders.batch(b["low"]) if names else (none, none, none)
            found = [np.flatnonzero(pc.fill_null(pc.match_substring(b["text"], x), False).to_numpy(zero_copy_only=False)) for x in locators]
            at, which = np.concatenate([none, *found]), np.repeat(np.arange(len(found)), [len(x) for x in found])
            order = np.argsort(at, kind="stable")
            any_ = np.zeros(rows, bool)
            any_[row] = any_[at] = True
            columns = {c: b[c] for c in ("doc_id", "idx", "len")} | {"term": _list(row, term, rows), "tf": _list(row, tf, rows), "stands": _list(at[order], which[order], rows)}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(any_))

    text = F.lower("text") if locators else F.lit(None).cast("string")
    own = index.texts.select("doc_id", "idx", text.alias("text"), F.lower("searched").alias("low"), _size(F.col("searched")).alias("len"))
    return written(own.mapInArrow(f, f"doc_id {kind('doc_id')}, idx {kind('idx')}, len int, term array<int>, tf array<int>, stands array<int>"), "holding")


def _of_many(index: Index, own: list, k: int, scope: DataFrame | None, schema: str) -> DataFrame:
    """(question, doc_id, idx, score): the best chunks for each of a block of questions (question, terms, locators) by one pass over all texts; how many chunks hold each term, and the scores, are told by what it writes."""
    names, locators = sorted({t for r in own for t in r["terms"]}), sorted({x for r in own for x in r["locators"]})
    shape, average = to_arrow_schema(index.texts.sparkSession.createDataFrame([], schema).schema), index.average or 1.0
    held = _holding(index, names, locators)
    n = np.zeros(len(names))
    for r in held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # a block's terms
        n[r["term"]] = r["n"]
    idf = np.log((index.chunks - n + 0.5) / (n + 0.5))
    weights = weighed(own, "terms", names, np.where(idf > 0, idf, LEAST)) if names else np.zeros((1, len(own)))
    place = {x: i for i, x in enumerate(locators)}
    asked = [(r["question"], [place[x] for x in r["locators"]], not r["terms"]) for r in own]

    def f(batches):
        best = Best(len(asked), k)
        for b in batches:
            rows, (row, term), tf = b.num_rows, _flat(b["term"]), _flat(b["tf"])[1]
            size = b["len"].to_numpy(zero_copy_only=False)[row] / average
            raw = summed(row, tf * (K1 + 1) / (tf + K1 * (1 - B + B * size)), weights, term, rows)
            score = np.round(raw / (raw + 1), 6)
            at, which = _flat(b["stands"])
            stands = np.zeros((len(locators), rows), bool)
            stands[which, at] = True
            doc, idx = b["doc_id"].to_pylist(), b["idx"].to_pylist()
            for q, (_, must, lone) in enumerate(asked):
                fine = np.ones(rows, bool) if lone else raw[:, q] > 0
                for x in must:
                    fine &= stands[x]
                at = np.flatnonzero(fine)
                best.add(q, score[at, q], at, doc, idx)
        yield best.batch([q for q, _, _ in asked], shape)

    return written((held if scope is None else held.join(scope, "doc_id", "left_semi")).mapInArrow(f, schema), "scored")


def search(index: Index, questions: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(question, doc_id, idx, score, rank): the ``k`` best chunks for each of (question, text), all questions at once.

    A chunk is found if it holds a word of three characters or more, or three characters of a longer run of a script
    without spaces, as part of any word; it is scored by all it holds (BM25 over trigrams), squashed under 1. Tokens of
    one or two characters with a digit must all stand in the text; a question of these alone finds chunks in reading
    order, with score 0. Questions with neither find nothing. How rare a term is counts over the whole index, also
    where ``scope``, (doc_id), bounds what may be found.
    """
    small = questions.limit(FEW + 1).select(F.explode(L.lexical_terms(F.col("text")))).limit(FEW + 1).count() <= FEW and questions.limit(FEW + 1).count() <= FEW
    best = Window.partitionBy("question").orderBy(F.desc("score"), F.when(F.col("score") == 0, F.col("idx")), "doc_id", "idx")
    if not small:
        out = None
        q = questions.select("question", F.array_distinct(F.transform(L.lexical_terms(F.col("text")), F.lower)).alias("terms"), F.array_distinct(F.transform(L.locator_terms(F.col("text")), F.lower)).alias("locators"))
        for own in blocks_of(q.filter((F.size("terms") > 0) | (F.size("locators") > 0)), "terms"):
            part = _of_many(index, own, k, scope, found_schema(questions, index.texts))
            out = part if out is None else out.unionByName(part)
        return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("question", "doc_id", "idx", "score", "rank")
    q = questions.select("question", L.lexical_terms(F.col("text")).alias("terms"), F.array_distinct(F.transform(L.locator_terms(F.col("text")), F.lower)).alias("locators"))
    asked = q.select("question", "locators", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    found = matches(index, asked.select("term").distinct())
    each = found.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log((F.lit(float(index.chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(LEAST))
    tf, size = F.col("tf"), F.col("len") / F.lit(index.average or 1.0)
    part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size))
    own = found if scope is None else found.join(scope, "doc_id", "left_semi")
    told = asked.join(each, "term")
    hits = own.join(told, "term").groupBy("question", "locators", "doc_id", "idx").agg(F.sum(part).alias("s"))
    hits = hits.withColumn("score", F.round(F.col("s") / (F.col("s") + 1), 6)).drop("s")
    holds = F.forall("locators", lambda x: F.contains(F.lower("text"), x))
    plain = hits.filter(F.size("locators") == 0)
    bound = hits.filter(F.size("locators") > 0).join(index.texts.select("doc_id", "idx", "text"), ["doc_id", "idx"]).filter(holds).select(plain.columns)
    # questions of locators alone read every text; the first one meets the texts' digits and pairs with a digit by an equal key
    lone = q.filter((F.size("terms") == 0) & (F.size("locators") > 0)).select("question", "locators", F.col("locators")[0].alias("key"))
    texts = index.texts if scope is None else index.texts.join(scope, "doc_id", "left_semi")
    low = F.lower("text")
    keys = F.array_union(F.regexp_extract_all(low, F.lit(r"(\p{Nd})"), 1), F.filter(F.regexp_extract_all(low, F.lit("(?s)(?=(..))"), 1), lambda x: x.rlike(r"\p{Nd}")))
    by_first = texts.select("doc_id", "idx", "text", F.explode(keys).alias("key")).join(lone, "key").filter(holds).select("question", "locators", "doc_id", "idx", F.lit(0.0).alias("score"))
    every = plain.unionByName(bound).unionByName(by_first)
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("question", "doc_id", "idx", "score", "rank")


def lane(index: Index, question: str, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, score): the ``k`` best chunks for one question."""
    spark = index.postings.sparkSession
    return search(index, spark.createDataFrame([(0, question)], "question int, text string"), k, scope).select("doc_id", "idx", "score")
