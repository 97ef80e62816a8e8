"""What keeps a library: imports, rescans, generations and their publication, sinks, operations, answer-time memory.

States are tables; a change is a new table made from the old one, written under a name of its own. What is in force is
said by a pointer, which is replaced in one step, so readers see the old state or the new one.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions.language import bound_query, clean_query, contains_identifier, keywords, safe_label, shares_keywords, strict_identifiers, topic_keywords

#: Files of one import, milliseconds a retired generation is kept, rows of a batch of chunks and of vectors.
IMPORT, GRACE_MS, CHUNK_BATCH, VECTOR_BATCH = 20, 300_000, 256, 500


# --- imports and scans --------------------------------------------------
def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, name, final): each wanted name as it is if it is free, else the first free stem_N.ext, N from 1; wanted rows of one name get different ones, by id.

    Free numbers are found by an anti join of the numbers that could be needed, which are no more than the names there are.
    """
    stem, ext = F.regexp_extract("name", r"^(.*?)([.][^.]*)?$", 1), F.coalesce(F.regexp_extract("name", r"([.][^.]*)$", 1), F.lit(""))
    w = wanted.select("id", "name", stem.alias("stem"), ext.alias("ext"), F.row_number().over(Window.partitionBy("name").orderBy("id")).alias("n"))
    known = taken.select("name").distinct()
    is_taken = known.select("name", F.lit(1).alias("was"))
    need = w.groupBy("name", "stem", "ext").agg(F.count("*").alias("k")).join(is_taken, "name", "left").withColumn("was", F.coalesce("was", F.lit(0)))
    used = known.select(F.regexp_extract("name", r"^(.*)_([0-9]+)([.][^.]*)?$", 1).alias("stem"), F.coalesce(F.regexp_extract("name", r"([.][^.]*)$", 1), F.lit("")).alias("ext")).groupBy("stem", "ext").agg(F.count("*").alias("u"))
    tries = need.join(used, ["stem", "ext"], "left").select("name", "stem", "ext", "was", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") + F.coalesce("u", F.lit(0)).cast("int"))).alias("number"))
    tries = tries.withColumn("final", F.concat("stem", F.lit("_"), F.col("number").cast("string"), "ext")).join(known.select(F.col("name").alias("final")), "final", "left_anti")
    numbered = tries.withColumn("m", F.row_number().over(Window.partitionBy("name").orderBy("number")) + 1 - F.col("was")).select("name", F.col("m").alias("n"), "final")
    first = need.filter("was = 0").select("name", F.lit(1).alias("n"), F.col("name").alias("final"))
    return w.select("id", "name", "n").join(first.unionByName(numbered), ["name", "n"]).select("id", "name", "final")


def import_plan(files: DataFrame, existing: DataFrame, on_conflict: str = "detect") -> DataFrame:
    """(id, name, final, action) of files (id, name, hash) for a base with (doc_id, name, hash): skip what is there by content, then by name conflict, rename, replace or import.

    More than ``IMPORT`` files are an error. Of files with one content the one with the smallest id is imported.
    """
    if on_conflict not in ("detect", "rename", "replace"):
        raise ValueError(f"no way {on_conflict!r} to settle conflicts")
    if files.limit(IMPORT + 1).count() > IMPORT:
        raise ValueError(f"an import takes {IMPORT} files at most")
    n = F.row_number().over(Window.partitionBy("hash").orderBy("id"))
    here = existing.select("hash").distinct().withColumn("there", F.lit(True))
    named = existing.select("name").distinct().withColumn("conflict", F.lit(True))
    p = files.withColumn("n", n).join(here, "hash", "left").join(named, "name", "left")
    action = F.when(F.coalesce("there", F.lit(False)) | (F.col("n") > 1), "skip").when(F.coalesce("conflict", F.lit(False)), {"detect": "conflict", "rename": "rename", "replace": "replace"}[on_conflict]).otherwise("import")
    p = p.withColumn("action", action)
    new = free_names(p.filter("action = 'rename'").select("id", "name"), existing.select("name").unionByName(p.filter("action = 'import'").select("name")))
    return p.join(new.select("id", "final"), "id", "left").select("id", "name", F.coalesce("final", "name").alias("final"), "action")


def rescan(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) of files (path, hash): unchanged, changed, new or missing."""
    a, b = before.select("path", F.col("hash").alias("old")), now.select("path", F.col("hash").alias("fresh"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("fresh").isNull(), "missing").when(F.col("old") == F.col("fresh"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def stale_urls(documents: DataFrame, bases: DataFrame, now_ms: int) -> DataFrame:
    """(doc_id) of web documents (doc_id, base, source_type, updated, created in ms) not fetched for their base's interval (base, interval_ms; 0 is never)."""
    d = documents.filter("source_type = 'url'").join(bases.filter("interval_ms > 0"), "base")
    return d.filter(F.coalesce(F.nullif("updated", F.lit(0)), "created") + F.col("interval_ms") <= now_ms).select("doc_id")


def by_path(documents: DataFrame) -> DataFrame:
    """(path, doc_id): the document of each source path, the earliest of several."""
    return documents.groupBy("path").agg(F.min(F.struct("created", "doc_id")).alias("d")).select("path", "d.doc_id")


def indexing(documents: DataFrame, most: int = 200) -> DataFrame:
    """Documents that are being indexed or wait for it and aren't being deleted, those that waited longest first, ties by id; 200 at most."""
    open_ = F.col("status").isin("pending", "processing") & (F.coalesce("lifecycle", F.lit("active")) == "active")
    return documents.filter(open_).orderBy("updated", "doc_id").limit(min(most, 200) if most > 0 else 200)


# --- generations --------------------------------------------------------
def next_generation(generations: DataFrame) -> int:
    return (generations.agg(F.max("generation")).first()[0] or 0) + 1


def publish(states: DataFrame, generation: int, now_ms: int) -> DataFrame:
    """Generations (generation, state, changed) after one that was building is published: it is active, the one before it retired. Another state is an error, as a newer one may have won."""
    own = states.filter(F.col("generation") == generation).select("state").first()
    if own is None or own["state"] != "building":
        raise ValueError(f"generation {generation} isn't building")
    if states.filter((F.col("state") == "active") & (F.col("generation") > generation)).count():
        raise ValueError(f"a generation after {generation} is active")
    new = F.when(F.col("generation") == generation, "active").when(F.col("state") == "active", "retired").otherwise(F.col("state"))
    return states.select("generation", new.alias("state"), F.when(new != F.col("state"), F.lit(now_ms)).otherwise(F.col("changed")).alias("changed"))


def publish_all(states: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Generations (base, generation, state, changed) after each base's request (base, generation) was decided, as ``publish`` does for one: a row a generation, with ``outcome`` for the one asked for.

    ``outcome`` is published, not building (another state, or no such generation: that row is added without a state) or
    overtaken (a later one is active); of two requests of one base the later generation counts.
    """
    want = asked.groupBy("base").agg(F.max("generation").alias("want"))
    newest = states.filter("state = 'active'").groupBy("base").agg(F.max("generation").alias("in_force"))
    own = want.join(newest, "base", "left").join(states.select("base", F.col("generation").alias("want"), F.col("state").alias("own")), ["base", "want"], "left")
    outcome = F.when(F.coalesce("own", F.lit("")) != "building", "not building").when(F.col("in_force") > F.col("want"), "overtaken").otherwise("published")
    own = own.select("base", "want", outcome.alias("outcome"), (F.col("own").isNull()).alias("lost"))
    wins = (F.col("outcome") == "published") & F.col("want").isNotNull()
    new = F.when(wins & (F.col("generation") == F.col("want")), "active").when(wins & (F.col("state") == "active"), "retired").otherwise(F.col("state"))
    met = states.join(own.drop("lost"), "base", "left")
    changed = F.when(new != F.col("state"), F.lit(now_ms).cast("long")).otherwise(F.col("changed").cast("long"))
    told = F.when(F.col("generation") == F.col("want"), F.col("outcome"))
    rows = met.select("base", "generation", new.alias("state"), changed.alias("changed"), told.alias("outcome"))
    none = own.filter("lost").select("base", F.col("want").cast(states.schema["generation"].dataType).alias("generation"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("changed"), "outcome")
    return rows.unionByName(none)


def expired(states: DataFrame, now_ms: int, grace_ms: int = GRACE_MS) -> DataFrame:
    """Generations that may be removed: retired longer than the grace."""
    return states.filter((F.col("state") == "retired") & (F.col("changed") < now_ms - grace_ms))


def pinned(chunks: DataFrame, states: DataFrame, generation: int) -> DataFrame:
    """The chunks of one generation; one that is gone is an error, not an empty result."""
    if not states.filter(F.col("generation") == generation).count():
        raise KeyError(f"GENERATION_EXPIRED: {generation}")
    return chunks.filter(F.col("generation") == generation)


def save_chunks(chunks: DataFrame, path: str, generation: int) -> None:
    """Write a generation's chunks beside those of others; a second run replaces the same folder."""
    chunks.write.mode("overwrite").parquet(f"{path}/generation={generation:020d}")


def save_raw(files: DataFrame, path: str) -> DataFrame:
    """Store (doc_id, version, content) that isn't stored yet; what is stored is never changed. Returns (doc_id, version, sha256, bytes) of all, by which a read can be checked."""
    spark = files.sparkSession
    new = files.select("doc_id", "version", "content", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))
    try:
        old = spark.read.parquet(path)
        new = new.join(old.select("doc_id", "version"), ["doc_id", "version"], "left_anti")
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.dropDuplicates(["doc_id", "version"]).write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("content")


def merge_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (chunk, model, embedding) by chunk and model, new ones in place of old: the same run twice gives the same table. Widths must agree within a model."""
    out = stored.join(new.select("chunk", "model"), ["chunk", "model"], "left_anti").unionByName(new.dropDuplicates(["chunk", "model"]))
    wide = out.groupBy("model").agg(F.countDistinct(F.size("embedding")).alias("n")).filter("n > 1").select("model").first()
    if wide:
        raise ValueError(f"vectors of {wide['model']} differ in width")
    return out


def carried(old: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, model, embedding) for new chunks (chunk, hash) whose text some vector (hash, model, embedding) of the library was made of; one for a hash and model, so copies aren't paired."""
    one = old.groupBy("hash", "model").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    return chunks.join(one, "hash").select("chunk", "model", "embedding")


# --- operations ---------------------------------------------------------
#: What state may follow what.
NEXT = {
    "queued": ("running", "cancelled"),
    "running": ("succeeded", "failed", "cancelling", "interrupted"),
    "cancelling": ("cancelled", "interrupted"),
    "interrupted": ("queued", "cancelled", "failed"),
    "failed": ("queued",),
    "succeeded": (),
    "cancelled": (),
}


def replay(events: DataFrame) -> DataFrame:
    """(op, state, revision, faults): operations after their events (op, seq, state), in order; a step that may not follow is a fault and changes nothing.

    An operation's events are one bounded list.
    """

    def step(acc, e):
        ok = reduce(lambda c, kv: c | ((acc["state"] == kv[0]) & e["state"].isin(*kv[1])), [(s, n) for s, n in NEXT.items() if n], acc["state"].isNull() & (e["state"] == "queued"))
        return F.struct(F.when(ok, e["state"]).otherwise(acc["state"]).alias("state"), (acc["revision"] + ok.cast("int")).alias("revision"), (acc["faults"] + (~ok).cast("int")).alias("faults"))

    g = events.groupBy("op").agg(F.array_sort(F.collect_list(F.struct("seq", "state"))).alias("e"))
    zero = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("revision"), F.lit(0).alias("faults"))
    return g.select("op", F.aggregate("e", zero, step).alias("r")).select("op", "r.state", "r.revision", "r.faults")


def recovered(operations: DataFrame, registered: list[str], attempts: int = 3) -> DataFrame:
    """Operations (op, type, state, cancel, retryable, attempt) after a crash: those under way are interrupted; with a wish to cancel they are cancelled, else queued again if they can be and were tried less than ``attempts`` times."""
    under_way = F.col("state").isin("running", "cancelling")
    again = F.col("type").isin(registered) & F.col("retryable") & (F.col("attempt") < attempts)
    state = F.when(~under_way, F.col("state")).when(F.col("cancel") | (F.col("state") == "cancelling"), "cancelled").when(again, "queued").otherwise("interrupted")
    return operations.withColumn("state", state)


def claim(operations: DataFrame, now_ms: int, limits: dict[str, int], most: int = 32) -> DataFrame:
    """Queued operations (op, class, base, priority, requested, state) to be run now: of the first ``most`` by priority, raised by one for each second waited, as many of a class as its limit leaves, one of a base at a time."""
    aged = F.col("priority") + F.floor((F.lit(now_ms) - F.col("requested")) / 1000)
    busy = operations.filter("state = 'running'")
    first = operations.filter("state = 'queued'").withColumn("aged", aged).orderBy(F.desc("aged"), "requested", "op").limit(most)
    order = [F.desc("aged"), F.col("requested"), F.col("op")]
    first = first.join(busy.select("base").distinct(), "base", "left_anti")
    first = first.withColumn("b", F.row_number().over(Window.partitionBy("base").orderBy(*order))).filter("b = 1")
    used = busy.groupBy("class").agg(F.count("*").alias("used"))
    most_of = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<string,int>")
    room = F.coalesce(F.try_element_at(most_of, F.col("class")), F.lit(1)) - F.coalesce("used", F.lit(0))
    return first.join(used, "class", "left").withColumn("c", F.row_number().over(Window.partitionBy("class").orderBy(*order))).filter(F.col("c") <= room).select("op", "class", "base", "aged")


def metrics(operations: DataFrame) -> DataFrame:
    """(type, state, error_code): how many, and milliseconds waited and run in all; times that end before they begin count 0."""
    wait = F.when(F.col("started") > F.col("requested"), F.col("started") - F.col("requested")).otherwise(0)
    run = F.when((F.col("started") > 0) & (F.col("finished") > F.col("started")), F.col("finished") - F.col("started")).otherwise(0)
    return operations.groupBy("type", "state", F.coalesce("error_code", F.lit("")).alias("error_code")).agg(F.count("*").alias("n"), F.sum(wait).cast("long").alias("waited"), F.sum(run).cast("long").alias("ran"))


# --- the queue of changed documents ------------------------------------
def pending(changes: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc_id, at, kind): the last change of each document that no marker (doc_id, at) has resolved since; a restart sees the same."""
    last = changes.groupBy("doc_id").agg(F.max(F.struct("at", "kind")).alias("c")).select("doc_id", "c.at", "c.kind")
    done = resolved.groupBy("doc_id").agg(F.max("at").alias("done"))
    return last.join(done, "doc_id", "left").filter(F.col("done").isNull() | (F.col("done") < F.col("at"))).drop("done")


# --- answers in a conversation -----------------------------------------
#: Least score, part of the best score a hit needs, lead and strength of a best hit that stands alone, hits of a base, tokens of a hit and in all.
FLOOR, GROUP, LEAD, STRONG, SEATS, HIT_TOKENS, ALL_TOKENS = 0.12, 0.6, 1.2, 2.0, 3, 180, 640


def gate(hits: DataFrame, seats: int = SEATS) -> DataFrame:
    """Hits (turn, base, doc_id, score, text, question, tokens) that are shown: the best of a turn needs ``FLOOR``, others ``GROUP`` of it; their texts share a keyword with the question and hold its identifiers; ``seats`` of a base; as long as tokens last."""
    k, ids = keywords(F.col("question")), strict_identifiers(F.col("question"))
    fits = shares_keywords(F.col("text"), k) & F.forall(ids, lambda i: contains_identifier(F.col("text"), i))
    turn = Window.partitionBy("turn")
    h = hits.withColumn("best", F.max("score").over(turn)).filter((F.col("best") >= FLOOR) & (F.col("score") >= GROUP * F.col("best"))).filter(fits)
    h = h.withColumn("seat", F.row_number().over(Window.partitionBy("turn", "base").orderBy(F.desc("score"), "doc_id"))).filter(F.col("seat") <= seats)
    cost = F.least("tokens", F.lit(HIT_TOKENS))
    order = Window.partitionBy("turn").orderBy(F.desc("score"), "doc_id")
    h = h.withColumn("used", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    h = h.filter(F.coalesce("used", F.lit(0)) < ALL_TOKENS).withColumn("place", F.row_number().over(order))
    second = F.max(F.when(F.col("place") == 2, F.col("score"))).over(turn)
    clear = (F.col("best") >= FLOOR * STRONG) | F.col("second").isNull() | (F.col("best") >= F.col("second") * LEAD)
    return h.withColumn("second", second).filter(clear).select("turn", "base", "doc_id", "score")


#: Signs that a turn follows on what was said before; characters of a short one.
FOLLOW_UP = "那 这个 那个 它 上述 前面 后面 接着 然后 继续 呢 that this it those these above previous next continue then".split()
SHORT, QUERY_CHARS = 40, 200


def follow_up(text: Column, history: Column) -> Column:
    """What a turn asks: main (the turn, cleaned) and enhanced (with the turns of ``history``, the last first), null if the turn stands for itself: it is long, or points at nothing and has two keywords."""
    main = clean_query(text, QUERY_CHARS)
    points = F.lower(text).rlike("|".join(FOLLOW_UP))
    needs = (F.length(F.trim(text)) <= SHORT) & (points | (F.size(topic_keywords(main)) < 2))
    more = F.filter(F.transform(history, lambda h: clean_query(h, QUERY_CHARS)), lambda h: (h != "") & (h != main))
    enhanced = F.when(needs & (F.size(more) > 0), bound_query(F.concat_ws(" ", main, F.array_join(more, " ")), QUERY_CHARS))
    return F.struct(main.alias("main"), enhanced.alias("enhanced"))


def remembered(shown: DataFrame, turns: int = 2, most: int = 50, interval_s: int = 300) -> DataFrame:
    """Of hits (session, turn, at, topic, doc_id, score) that could be shown, those that are: none that the session has seen among its last ``most``, and one alone if it was shown something less than ``interval_s`` ago on the same topic.

    A session's turns are walked in order; a session is one bounded group.
    """
    schema = shown.schema

    def f(g: pd.DataFrame) -> pd.DataFrame:
        seen: list = []
        last, topic, keep = None, None, []
        for _, own in sorted(g.groupby("turn"), key=lambda x: x[0]):
            at = own["at"].iloc[0]
            few = last is not None and (at - last).total_seconds() < interval_s and own["topic"].iloc[0] == topic
            own = own[~own["doc_id"].isin(seen)].sort_values(["score", "doc_id"], ascending=[False, True])
            own = own.head(1) if few else own
            if len(own):
                keep.append(own)
                seen = [*seen, *own["doc_id"]][-most:]
                last, topic = at, own["topic"].iloc[0]
        return pd.concat(keep) if keep else g.head(0)

    return shown.groupBy("session").applyInPandas(f, schema)


def label(base: Column, doc: Column, chunk: Column, idx: Column, title: Column) -> Column:
    """What names a piece of evidence that is put into an answer's context."""
    return F.concat(F.lit("[source: "), safe_label(base), F.lit("; docId="), safe_label(doc.cast("string")), F.lit("; chunkId="), safe_label(chunk.cast("string")), F.lit("; chunkIndex="), idx.cast("string"), F.lit("; title="), safe_label(title), F.lit("]"))


def page(rows: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows in descending order of the columns after a cursor, and one more if there are any: it tells that there is a next page."""
    key = F.struct(*order)
    if after is not None:
        key_at = F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)))
        rows = rows.filter(key < key_at)
    return rows.orderBy(*(F.desc(c) for c in order)).limit(size + 1)


def pointer(spark: SparkSession, path: str, value: str | None = None) -> str | None:
    """Read what is in force, or replace it in one step by a rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if value is None:
        fs = at.getFileSystem(conf)
        return spark.read.text(path).first()[0] if fs.exists(at) else None
    fresh = jvm.org.apache.hadoop.fs.Path(path + ".new")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf)
    out = at.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(value.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = option
    context.rename(fresh, at, array)
    return value

