"""The semantic compiler: facts, concepts, topics and summaries with their evidence, the relations between them, and search over them.

Documents come as nodes (``papyra.sources.ir``) with a source version. All steps are joins and aggregations on keys; the
longest concept that a fact names is found by one automaton over all concept keys, in shards of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.functions import versions as V
from papyra.functions.language import identifier, outline, search_terms
from papyra.sources.ir import STRUCTURAL, TABULAR, section
from papyra.sources.store import settled, written

#: Most facts and concepts of a document, topics of a base, characters of a summary, headings in it.
FACTS, CONCEPTS, TOPICS, SUMMARY, HEADINGS = 128, 24, 64, 2400, 24
#: How sure each kind of unit and relation is.
FACT, TABLE_FACT, CONCEPT, TOPIC, SUMMARISED, SUPERSEDES = 0.68, 0.75, 0.72, 0.66, 0.70, 0.82
#: Keys of one automaton, and facts that meet one at a time.
SHARD, FACT_BLOCK = 200_000, 50_000
#: Predicates whose statements can be superseded.
PREDICATES = "supports uses requires provides 支持 使用 需要 提供".split()


#: Node types that name what a document is about.
HEADS = ("document", "heading", "section")


def told(nodes: DataFrame) -> DataFrame:
    """What the compiler takes of nodes, in one pass: those of ``HEADS``, without a document's whole text, and a row (with s: pos, text) for each statement of the others."""
    none = F.array(F.lit(None).cast("struct<pos:int,text:string>"))
    said = F.when(F.col("type").isin(*HEADS), none).when(~F.col("type").isin(*STRUCTURAL), X.statements(F.col("text")))
    return nodes.select("doc_id", "title", "version", "node_id", "ord", "type", "path", F.when(F.col("type").isin(*HEADS[1:]), F.col("text")).alias("text"), F.explode(said).alias("s"))


def stated(nodes: DataFrame, most: int | None = FACTS) -> DataFrame:
    """(doc_id, version, node_id, ord, pos, path, type, key, text, previous): the first ``most`` statements of each document in reading order, all if it is None.

    ``nodes`` has a column version (null where the source has none). ``previous`` is the key of the statement before in
    the same node.
    """
    return first_stated(told(nodes.filter(~F.col("type").isin(*STRUCTURAL))), most)


def first_stated(told_: DataFrame, most: int | None = FACTS) -> DataFrame:
    """``stated`` of the rows of ``told``; all statements if ``most`` is None."""
    s = told_.filter(~F.col("type").isin(*HEADS)).select("doc_id", "version", "node_id", "ord", "type", "path", "s.pos", "s.text")
    if most is not None:
        s = s.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "pos"))).filter(F.col("n") <= most)
    s = s.withColumn("key", X.fact_key(F.col("text"), F.col("version")))
    before = F.lag("key").over(Window.partitionBy("doc_id", "ord").orderBy("pos"))
    return s.select("doc_id", "version", "node_id", "ord", "pos", "path", "type", "key", "text", before.alias("previous"))


def facts(stated_: DataFrame) -> DataFrame:
    """One row a key: text, heading, type and version of its first statement in (doc_id, ord, pos), how sure it is, its predecessor there, and all sources."""
    first = F.min(F.struct("doc_id", "ord", "pos", "text", section(F.col("path")).alias("heading"), "type", "version", "previous"))
    g = stated_.groupBy("key").agg(first.alias("f"), F.array_sort(F.collect_set(F.struct("doc_id", "ord", "node_id"))).alias("sources"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("occurrences"))
    sure = F.when(F.col("f.type").isin(*TABULAR), TABLE_FACT).otherwise(FACT)
    return g.select("key", "f.text", "f.heading", "f.type", "f.version", sure.alias("confidence"), F.col("f.previous").alias("previous"), "documents", "occurrences", "sources")


def steps(stated_: DataFrame) -> DataFrame:
    """(key, previous): ``previous`` of ``facts``, and nothing else of them."""
    return stated_.groupBy("key").agg(F.min(F.struct("doc_id", "ord", "pos", "previous")).alias("f")).select("key", "f.previous")


def sequences(facts_: DataFrame) -> DataFrame:
    """(subject, object, confidence, statement): each fact after the one before it where it was first stated."""
    p = facts_.select(F.col("key").alias("previous"), F.col("text").alias("before"), F.col("confidence").alias("c"))
    return facts_.filter("previous is not null").join(p, "previous").select(F.col("previous").alias("subject"), F.col("key").alias("object"), F.least("confidence", "c").alias("confidence"), F.concat_ws(" → ", "before", "text").alias("statement"))


def concept_rows(nodes: DataFrame, most: int = CONCEPTS) -> DataFrame:
    """(doc_id, ord, key, title, heading): the first ``most`` titles and headings of each document that are concepts."""
    titles = nodes.filter("type = 'document'").select("doc_id", F.lit(-1).alias("ord"), F.col("title").alias("raw"), F.lit("").alias("heading"), F.lit(True).alias("whole"))
    heads = nodes.filter(F.col("type").isin("heading", "section")).select("doc_id", "ord", F.col("text").alias("raw"), section(F.col("path")).alias("heading"), F.lit(False).alias("whole"))
    c = titles.unionByName(heads).withColumn("key", X.concept_key(F.col("raw")))
    c = c.filter(F.when(F.col("whole"), X.is_concept(F.col("key"))).otherwise(X.is_heading_concept(F.col("raw"), F.col("key"))))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).filter(F.col("n") <= most)
    return c.select("doc_id", "ord", "key", F.trim("raw").alias("title"), "heading")


def concepts(rows: DataFrame) -> DataFrame:
    """One row a concept key: title of its first mention, aliases, headings and documents."""
    of = rows.groupBy("key", "doc_id").agg(F.min(F.struct("ord", "title")).alias("f")).groupBy("key").agg(F.min(F.struct("doc_id", "f")).alias("f"), F.count("*").alias("documents"))
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    names = rows.select("key", "title", "heading").distinct().groupBy("key").agg(some("title").alias("aliases"), some("heading").alias("headings"))
    return of.join(names, "key").select("key", F.col("f.f.title").alias("title"), "aliases", "headings", "documents")


def topics(nodes: DataFrame, most: int = TOPICS) -> DataFrame:
    """(key, title): the first ``most`` titles and top headings of the base, in (doc_id, ord) order, that are concepts."""
    titles = nodes.filter("type = 'document'").select("doc_id", F.lit(-1).alias("ord"), F.col("title").alias("raw"), F.lit(True).alias("whole"))
    heads = nodes.filter((F.col("type") == "heading") & (F.size("path") > 0)).select("doc_id", "ord", F.col("path")[0].alias("raw"), F.lit(False).alias("whole"))
    t = titles.unionByName(heads).withColumn("key", X.concept_key(F.col("raw")))
    t = t.filter(F.when(F.col("whole"), X.is_concept(F.col("key"))).otherwise(X.is_heading_concept(F.col("raw"), F.col("key"))))
    return t.groupBy("key").agg(F.min(F.struct("doc_id", "ord", F.trim("raw").alias("title"))).alias("f")).orderBy("f.doc_id", "f.ord", "key").limit(most).select("key", "f.title")


def topic_of(concepts_: DataFrame, topics_: DataFrame) -> DataFrame:
    """(concept, topic, score): the topic that shares most words with a concept, two more if one holds the other; ties to the smaller key. Topics are ``TOPICS`` rows at most."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    t = F.broadcast(topics_.agg(F.array_sort(F.collect_list("key")).alias("topics")))
    c, k = F.col("key"), F.col("topics")
    scored = F.transform(k, lambda t_: F.struct((F.size(F.array_intersect(words(c), words(t_))) + F.when(F.contains(c, t_) | F.contains(t_, c), 2).otherwise(0)).alias("score"), t_.alias("topic")))
    best = F.array_max(F.transform(scored, lambda s: s["score"]))
    out = concepts_.select("key").join(t, F.lit(True)).select(c.alias("concept"), F.try_element_at(F.filter(scored, lambda s: s["score"] == best), F.lit(1)).alias("b"))
    return out.filter("b.score > 0").select("concept", F.col("b.topic").alias("topic"), F.col("b.score").cast("int").alias("score"))


def _longest(keys: list[str]):
    """A function of texts: for each the longest of the keys that it holds, ties to the smaller. The automaton is built once."""
    import ahocorasick

    if not keys:
        return lambda texts: [None] * len(texts)
    a = ahocorasick.Automaton()
    for k in keys:
        a.add_word(k, k)
    a.make_automaton()
    return lambda texts: [min((k for _, k in a.iter(t)), key=lambda k: (-len(k), k), default=None) for t in texts]


def named_concept(facts_: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, concept): the longest of the (key) ``keys`` that a fact's text holds, ties to the smaller; else the first of its headings that is one; facts without either are left out.

    Up to ``SHARD`` keys are one automaton in every task. More are dealt into shards of about so many, facts into blocks,
    and each block meets each shard; the longest of the shards' finds counts.
    """
    f = facts_.select("key", "heading", X.concept_key(F.col("text")).alias("t"))
    n = keys.count()
    if n <= SHARD:
        known = sorted(r["key"] for r in keys.select("key").collect())  # at most SHARD

        @F.pandas_udf("string")
        def longest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = _longest(known)
            for s in texts:
                yield pd.Series(find(s), dtype=object)

        found = f.select("key", longest(F.col("t")).alias("concept")).filter("concept is not null")
    else:
        shards, blocks = -(-n // SHARD), max(1, -(-facts_.count() // FACT_BLOCK))
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = f.select("key", "t", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", each(shards))
        right = keys.select(F.col("key").alias("name"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", each(blocks))

        def meet(own: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
            pairs = zip(own["key"], _longest(sorted(names["name"]))(own["t"]), strict=True)
            return pd.DataFrame([(k, c) for k, c in pairs if c is not None], columns=["key", "concept"], dtype=object)

        some = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(meet, "key string, concept string")
        found = some.groupBy("key").agg(F.min(F.struct((-F.length("concept")).alias("n"), "concept")).alias("b")).select("key", "b.concept")
    found = written(found, "named")
    heads = f.join(found, "key", "left_anti").select("key", F.posexplode(F.transform(F.split("heading", " / "), X.concept_key)).alias("n", "head"))
    heads = heads.join(keys.select(F.col("key").alias("head")), "head").groupBy("key").agg(F.min_by("head", "n").alias("concept"))
    return found.unionByName(heads)


def versioned(text: Column) -> Column:
    """(version, predicate, attribute) of "version X supports ..." and the like; null of any other statement. Numbers, articles and units are no part of the attribute."""
    t = identifier(text)
    pattern = f"^(?:version|版本) ([0-9]+[.]?[0-9]*)x?([^ ]*) ({'|'.join(PREDICATES)}) (.+)$"
    number = F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2))
    rest = F.regexp_replace(F.regexp_extract(t, pattern, 4), "_[a-z]?[0-9]+", " ")
    for gone in ("the ", "a ", "an ", "[0-9.,%kmx]"):
        rest = F.regexp_replace(rest, gone, " ")
    attribute = F.trim(F.regexp_replace(rest, r"\s+", " "))
    version = V.normalize(number)
    return F.when((number != "") & number.rlike(r"^[0-9]+([.][0-9]+)?$") & version.isNotNull() & (attribute != ""), F.struct(version.alias("version"), F.regexp_extract(t, pattern, 3).alias("predicate"), attribute.alias("attribute")))


def supersession(units: DataFrame) -> DataFrame:
    """Units (key, scope, version) with status and superseded_by.

    In a scope, versions that can be ordered are compared within their family. The newest is active and all older ones
    are superseded by it. Several units of the newest version are conflicted, and then the next version counts as
    newest: if it has one unit, that one supersedes the older; if it has several, nothing is superseded. Units without
    a scope or of unknown order stay active.
    """
    n = F.col("version")
    u = units.withColumn("parts", F.when(F.col("scope").isNotNull(), V.parts(n))).withColumn("family", n.startswith("rel-"))
    w = Window.partitionBy("scope", "family")
    ordered = u.filter("parts is not null").withColumn("place", F.dense_rank().over(w.orderBy(F.desc("parts"))))
    ordered = ordered.withColumns({f"n{i}": F.sum((F.col("place") == i).cast("int")).over(w) for i in (1, 2)} | {f"k{i}": F.max(F.when(F.col("place") == i, F.col("key"))).over(w) for i in (1, 2)})
    one, two, at = F.col("n1") == 1, (F.col("n1") > 1) & (F.col("n2") == 1), F.col("place")
    status = F.when(~one & (at == 1), "conflicted").when(one & (at > 1), "superseded").when(two & (at > 2), "superseded").otherwise("active")
    by = F.when(status == "superseded", F.when(one, F.col("k1")).otherwise(F.col("k2")))
    rest = u.filter("parts is null").select(*units.columns, F.lit("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"))
    return ordered.select(*units.columns, status.alias("status"), by.alias("superseded_by")).unionByName(rest)


UNIT = ["type", "key", "title", "content", "aliases", "confidence", "status", "version", "superseded_by", "derived", "sources"]


def compile_units(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and relations of documents.

    Units: type (fact, concept, topic, summary), key, title, content, aliases, confidence, status, version,
    superseded_by, derived (keys of the units it is made from, with their type) and sources (doc_id). Relations: type
    (related_to, supersedes), subject, object (fact keys), statement, confidence.
    """
    read = compile_facts(nodes)
    return unit_rows(*read), fact_relations(*read[1:])


def scopes(facts_: DataFrame) -> DataFrame:
    """(key, scope, version, said): the facts (key, text, version) that can be superseded, with the version that they state. All others are active, so they needn't be compared."""
    v = facts_.select("key", "version", versioned(F.col("text")).alias("v")).filter("v is not null")
    return v.select("key", F.concat_ws("|", "v.predicate", "v.attribute").alias("scope"), "version", F.col("v.version").alias("said"))


def compile_facts(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written tables that units and relations are made from: headings (rows of ``told``), facts, and the status of those that can be superseded. The nodes are read once and not kept."""
    every = written(told(nodes), "told")
    f = written(facts(first_stated(every)), "facts")
    status = written(supersession(written(scopes(f).select("key", "scope", F.coalesce("version", "said").alias("version")), "scopes")), "status")
    return every.filter(F.col("type").isin(*HEADS)), f, status


def unit_rows(nodes: DataFrame, f: DataFrame, status: DataFrame) -> DataFrame:
    """The units of ``compile_units`` from the tables of ``compile_facts``."""
    rows = written(concept_rows(nodes), "concepts")
    c, t = concepts(rows), topics(nodes)
    named = written(named_concept(f, c.select("key")), "named")
    none = F.array().cast("array<string>")
    docs_of = F.array_sort(F.array_distinct(F.transform("sources", lambda x: x["doc_id"].cast("string"))))
    fact_units = f.join(status.select("key", "status", "superseded_by", F.col("version").alias("known")), "key", "left").select(
        F.lit("fact").alias("type"), "key", X.clip(F.col("text"), 96).alias("title"), F.col("text").alias("content"), none.alias("aliases"), "confidence", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("known", "version").alias("version"), "superseded_by", none.alias("derived"), docs_of.alias("sources"))
    made = named.groupBy("concept").agg(F.array_sort(F.collect_set(F.concat(F.lit("fact:"), "key"))).alias("facts"))
    bare = rows.join(named.select(F.col("concept").alias("key")).distinct(), "key", "left_anti")  # of the others the facts are told
    seen = bare.groupBy("key").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("docs"))
    said = F.concat_ws(" ", F.concat("title", F.lit(" appears in "), F.col("documents").cast("string"), F.lit(" source document(s).")), F.when(F.size("headings") > 0, F.concat(F.lit("Observed headings: "), F.array_join("headings", "; "))))
    blank = F.lit(None).cast("string")
    concept_units = c.join(seen, "key", "left").join(made.withColumnRenamed("concept", "key"), "key", "left").select(
        F.lit("concept").alias("type"), "key", "title", said.alias("content"), "aliases", F.lit(CONCEPT).alias("confidence"), F.lit("active").alias("status"), blank.alias("version"), blank.alias("superseded_by"),
        F.coalesce("facts", none).alias("derived"), F.when(F.col("facts").isNull(), F.col("docs")).otherwise(none).alias("sources"))
    under = topic_of(c, t).groupBy("topic").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    covers = F.when(F.col("c").isNull(), F.concat("title", F.lit(" has no compiled concepts yet."))).otherwise(F.concat("title", F.lit(" covers: "), F.array_join("c", ", "), F.lit(".")))
    topic_units = t.join(under.withColumnRenamed("topic", "key"), "key", "left").select(
        F.lit("topic").alias("type"), "key", "title", covers.alias("content"), F.array("title").alias("aliases"), F.lit(TOPIC).alias("confidence"), F.lit("active").alias("status"), blank.alias("version"), blank.alias("superseded_by"),
        F.coalesce(F.transform("c", lambda k: F.concat(F.lit("concept:"), k)), none).alias("derived"), none.alias("sources"))
    units = fact_units.unionByName(concept_units).unionByName(topic_units).unionByName(summaries(nodes, rows, f, named))
    return units.select(*UNIT)


def fact_relations(f: DataFrame, status: DataFrame) -> DataFrame:
    """The relations of ``compile_units`` from the tables of ``compile_facts``."""
    related = sequences(f).select(F.lit("related_to").alias("type"), "subject", "object", "statement", "confidence")
    new = f.select(F.col("key").alias("superseded_by"), F.col("text").alias("new"))
    old = status.filter("superseded_by is not null").select("key", "superseded_by").join(f.select("key", "text"), "key").join(new, "superseded_by")
    replaced = old.select(F.lit("supersedes").alias("type"), F.col("key").alias("subject"), F.col("superseded_by").alias("object"), F.concat_ws(" is superseded by ", "text", "new").alias("statement"), F.lit(SUPERSEDES).alias("confidence"))
    return related.unionByName(replaced)


def summaries(nodes: DataFrame, rows: DataFrame, facts_: DataFrame, named: DataFrame) -> DataFrame:
    """A unit for each document: its title, the concepts it is filed under, its first headings, made from its own facts that name one of them."""
    heads = nodes.filter(F.col("type").isin("heading", "section")).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "text"))), 1, HEADINGS)["text"].alias("heads"))
    own = rows.join(rows.groupBy("key").agg(F.min(F.struct("doc_id", "ord", "title")).alias("f")).select("key", F.col("f.title").alias("name")), "key").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    where = facts_.select("key", F.explode(F.array_distinct(F.transform("sources", lambda x: x["doc_id"]))).alias("doc_id"))
    from_ = where.join(named, "key").join(rows.select("doc_id", F.col("key").alias("concept")).distinct(), ["doc_id", "concept"]).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("fact:"), "key"))).alias("facts"))
    d = nodes.filter("type = 'document'").select("doc_id", "title", "version").join(heads, "doc_id", "left").join(own, "doc_id", "left").join(from_, "doc_id", "left")
    none = F.array().cast("array<string>")
    body = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\nDeterministic summary compiled from the document outline and explicit facts."),
        F.when(F.size(F.coalesce("names", none)) > 0, F.concat(F.lit("\n\nKey concepts: "), F.array_join("names", ", "), F.lit("."))).otherwise(""),
        F.lit("\n\nOutline:\n"), F.coalesce(F.concat_ws("", F.transform("heads", lambda h: F.concat(F.lit("- "), F.trim(h), F.lit("\n")))), F.lit("")))
    key = F.concat(F.lit("summary:doc:"), F.col("doc_id").cast("string"))
    doc = F.array(F.col("doc_id").cast("string"))
    return d.select(
        F.lit("summary").alias("type"), key.alias("key"), "title", X.clip(F.trim(body), SUMMARY).alias("content"), none.alias("aliases"), F.lit(SUMMARISED).alias("confidence"), F.lit("active").alias("status"), "version",
        F.lit(None).cast("string").alias("superseded_by"), F.coalesce("facts", none).alias("derived"), F.when(F.col("facts").isNull(), doc).otherwise(none).alias("sources"))


def document_outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, outline): the headings of each document, indented by their depth."""
    h = nodes.filter(F.col("type").isin("heading", "section"))
    g = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.size("path").alias("level"), F.col("text").alias("title")))).alias("h"))
    return g.select("doc_id", outline(F.col("h")).alias("outline"))


#: Kinds of units in the order in which equals are listed.
KINDS = ("fact", "concept", "topic", "summary", "knowledge_page")


def unit_score(query: str, spark) -> tuple[Column, Column]:
    """Score and coverage of a unit (title, key, content, aliases, derived) for a query.

    A term in the title counts 4, else in the key or an alias 3, and one more if the content has it; terms in the
    content alone match nothing. The sum counts by the part of terms matched; the whole query in title or key adds 5, in
    the content 2, and each unit it is made from 0.05, 8 at most.
    """
    row = spark.range(1).select(search_terms(F.lit(query)).alias("t"), identifier(F.lit(query)).alias("q")).first()  # the query alone
    terms, whole = row["t"], row["q"]
    title, key, content = identifier(F.col("title")), identifier(F.col("key")), identifier(F.col("content"))
    hits, points = F.lit(0), F.lit(0.0)
    every = F.array_join(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), identifier), "\n")
    for t in terms:
        alias = every.contains(t)
        own = F.when(title.contains(t), 4.0).when(key.contains(t) | alias, 3.0).otherwise(0.0)
        hits += (own > 0).cast("int")
        points += own + content.contains(t).cast("double")
    coverage = hits / max(len(terms), 1)
    phrase = F.when(title.contains(whole) | key.contains(whole), 5.0).when(content.contains(whole), 2.0).otherwise(0.0)
    score = F.when(hits > 0, points * coverage + phrase + F.least(F.size("derived"), F.lit(8)) * 0.05).otherwise(0.0)
    return score, coverage


def search_units(units: DataFrame, query: str, kinds: tuple[str, ...] = ("concept", "topic", "summary"), top_k: int = 10, visible: Column | None = None, boost: Column | None = None) -> DataFrame:
    """Units with score and coverage, best first: ``top_k`` (50 at most) of the kinds that match, visible ones alone; ties by coverage, kind and key."""
    score, coverage = unit_score(query, units.sparkSession)
    own = units.filter(F.col("type").isin(*kinds)).filter(F.col("status") == "active" if visible is None else visible)
    own = own.withColumns({"score": score, "coverage": coverage}).filter("score > 0")
    if boost is not None:
        own = own.withColumn("score", F.col("score") + boost).filter("score > 0")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("type"))
    return own.orderBy(F.desc("score"), F.desc("coverage"), rank, "key").limit(max(1, min(top_k, 50)))


def faults(units: DataFrame, relations: DataFrame) -> DataFrame:
    """(key, fault) of what breaks a rule: a repeated unit, no evidence, a lost source of its making or end of a relation, a sureness outside 0 to 1."""
    ids = units.select(F.concat_ws(":", "type", "key").alias("id"))
    twice = ids.groupBy("id").count().filter("count > 1").select(F.col("id").alias("key"), F.lit("repeated unit").alias("fault"))
    bare = units.filter((F.size("sources") == 0) & (F.size("derived") == 0) & (F.col("type") != "topic")).select("key", F.lit("no evidence").alias("fault"))
    odd = units.filter("confidence < 0 or confidence > 1").select("key", F.lit("confidence").alias("fault"))
    lost = units.select("key", F.explode("derived").alias("id")).join(ids.distinct(), "id", "left_anti").select("key", F.lit("lost origin").alias("fault"))
    ends = relations.select(F.explode(F.array("subject", "object")).alias("end"))
    loose = ends.join(units.filter("type = 'fact'").select(F.col("key").alias("end")), "end", "left_anti").select(F.col("end").alias("key"), F.lit("loose relation").alias("fault"))
    own = relations.filter("subject = object").select(F.col("subject").alias("key"), F.lit("relation to itself").alias("fault"))
    return twice.unionByName(bare).unionByName(odd).unionByName(lost).unionByName(loose).unionByName(own).distinct()


def merge_units(previous: DataFrame, update: DataFrame, dirty: DataFrame) -> DataFrame:
    """Units of a base after some of its documents were compiled anew.

    Sources among the (doc_id) ``dirty`` documents go from the previous units, and with them units that nothing supports
    any more, to a fixed point; summaries of dirty documents go at once. What is left is merged with the update by type
    and key: the update's title, content and status win, lists are united, and sureness is the mean by sources.
    Supersession is then told anew over all facts. What is used more than once is written once.
    """
    from papyra.operators.graph import fallen

    previous, update = settled(previous, "previous"), settled(update, "update")
    gone, none = dirty.select(F.col("doc_id").cast("string").alias("doc")).distinct(), F.array().cast("array<string>")
    id_, less = F.concat_ws(":", "type", "key"), lambda c, lost: F.array_sort(F.array_compact(F.array_except(F.coalesce(c, none), F.coalesce(lost, none))))
    own, summary = previous.withColumn("id", id_), F.col("type").eqNullSafe("summary")
    of = own.filter(summary).withColumn("doc", F.regexp_extract("key", "^summary:doc:(.*)$", 1))  # other units must not meet under one null
    ended = written(of.join(gone, "doc", "left_semi").select(F.col("id").alias("target")), "ended")  # summaries dropped at once
    lost = previous.select(id_.alias("id"), F.explode("sources").alias("doc")).join(gone, "doc", "left_semi").groupBy("id").agg(F.collect_set("doc").alias("lost"))
    old = own.filter(~summary).unionByName(of.join(gone, "doc", "left_anti").drop("doc")).join(lost, "id", "left").withColumn("sources", less("sources", "lost"))
    old = written(old.select("id", *UNIT), "old")
    bare = old.filter(F.size("sources") == 0)
    open_, ends = bare.select("id", F.explode("derived").alias("target")), F.coalesce(F.col("target").startswith("summary:"), F.lit(False))
    open_ = open_.filter(~ends).unionByName(open_.filter(ends).join(ended, "target", "left_anti"))
    drop = written(fallen(written(open_, "open"), written(bare.select("id"), "bare")), "drop")
    away = drop.select(F.col("id").alias("target")).unionByName(ended)
    unmade = old.select("id", F.explode("derived").alias("target")).join(away, "target", "left_semi").groupBy("id").agg(F.collect_set("target").alias("lost"))
    kept = old.join(drop, "id", "left_anti").join(unmade, "id", "left").withColumn("derived", less("derived", "lost"))
    new = update.select(id_.alias("id"), *(F.col(c).alias(f"new_{c}") for c in UNIT))
    m = kept.select("id", *UNIT).join(new, "id", "full")
    n, k = F.size(F.coalesce("sources", none)), F.size(F.coalesce("new_sources", none))
    mean = F.when(n + k == 0, F.col("new_confidence")).otherwise((F.col("confidence") * n + F.col("new_confidence") * k) / (n + k))
    both = lambda c: F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"new_{c}", none)))
    wins = lambda c: F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), F.col(c))
    out = m.select(
        F.coalesce("type", "new_type").alias("type"), F.coalesce("key", "new_key").alias("key"), wins("title").alias("title"), wins("content").alias("content"), both("aliases").alias("aliases"),
        F.when(F.col("confidence").isNull(), F.col("new_confidence")).when(F.col("new_confidence").isNull(), F.col("confidence")).otherwise(mean).alias("confidence"),
        F.coalesce("new_status", "status").alias("status"), F.coalesce("new_version", "version").alias("version"), both("derived").alias("derived"), both("sources").alias("sources"))
    out = written(out, "merged")
    scoped = scopes(out.filter("type = 'fact'").select("key", F.col("content").alias("text"), "version"))
    known = written(supersession(written(scoped.select("key", "scope", F.coalesce("said", "version").alias("version")), "scopes")), "status")
    known = known.select(F.lit("fact").alias("type"), "key", F.col("status").alias("s"), "superseded_by")
    status = F.when(F.col("type") == "fact", F.coalesce("s", F.lit("active"))).otherwise(F.col("status"))
    return out.join(known, ["type", "key"], "left").withColumn("status", status).select(*UNIT)


def merge_relations(previous: DataFrame, update: DataFrame, units: DataFrame) -> DataFrame:
    """Relations of a base after ``merge_units``: those of either side whose both ends are left, the earlier of equal ones; what supersedes what is told by the units."""
    f = units.filter("type = 'fact'")
    keys = f.select("key")
    both = previous.withColumn("side", F.lit(0)).unionByName(update.withColumn("side", F.lit(1))).filter("type <> 'supersedes'")
    one = both.groupBy("type", "subject", "object").agg(F.min_by(F.struct("statement", "confidence"), "side").alias("r"))
    kept = one.join(keys.withColumnRenamed("key", "subject"), "subject", "left_semi").join(keys.withColumnRenamed("key", "object"), "object", "left_semi")
    old = f.filter("superseded_by is not null").select("key", "superseded_by", "content")
    new = f.select(F.col("key").alias("superseded_by"), F.col("content").alias("new"))
    told = old.join(new, "superseded_by").select(F.lit("supersedes").alias("type"), F.col("key").alias("subject"), F.col("superseded_by").alias("object"), F.concat_ws(" is superseded by ", "content", "new").alias("statement"), F.lit(SUPERSEDES).alias("confidence"))
    return kept.select("type", "subject", "object", "r.statement", "r.confidence").unionByName(told)
