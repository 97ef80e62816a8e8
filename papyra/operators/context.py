"""A question's context: orientation, facts, relations and exact evidence with citations, under one token budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from papyra.functions import questions as Q
from papyra.functions import versions as V
from papyra.operators import semantic as S

#: Budget by default, least and most; parts of it a section may take; most facts and relations; characters of a line.
BUDGET, SHARES = (4096, 64, 32768), {"orientation": 4, "temporal": 20, "concepts": 10, "relations": 20, "facts": 8}
FACTS, RELATIONS, SUMMARY_LINE, FACT_LINE = 12, 8, 480, 320
HEADS = {"orientation": "## Knowledge orientation", "temporal": "## Temporal selection", "concepts": "## Relevant concepts", "relations": "## Relevant relations", "facts": "## Critical facts"}


def same_version(version: Column, wanted: list[str]) -> Column:
    """Whether a version is one of those wanted, whatever its case and zeros."""
    out = F.lit(False)
    for w in wanted:
        out |= F.coalesce((F.lower(version) == w.lower()) | (V.compare(V.normalize(version), V.normalize(F.lit(w))) == 0), F.lit(False))
    return out


def visible(t: Q.Temporal, status: Column | None = None, version: Column | None = None) -> Column:
    """Which units a question sees: those in force, unless it asks for certain versions, for what changed or for a range."""
    s, v = F.col("status") if status is None else status, F.col("version") if version is None else version
    there, live = s != "deleted", s.isin("active", "conflicted")
    known = F.coalesce(v, F.lit("")) != ""
    if t.intent in ("current", "validity"):
        return live
    if t.intent in ("explicit_version", "historical"):
        return F.when(known & F.lit(bool(t.versions)), there & same_version(v, t.versions)).otherwise(s == "active")
    if t.intent in ("evolution", "compare_versions"):
        if not t.versions:
            return there & (live | (s == "superseded"))
        return there & F.when(known, same_version(v, t.versions)).otherwise(live)
    if t.intent == "range_history":
        if t.span is not None and t.span.kind == "version":
            return there & F.when(known, in_span(v, t.span)).otherwise(live | (s == "superseded"))
        return there & (live | (s == "superseded"))
    return s == "active"


def in_span(version: Column, span: Q.Range) -> Column:
    """Whether a version lies in a range of versions of its family; unknown order is no."""
    out, n = F.lit(True), V.normalize(version)
    for end, inside, sign in ((span.start, span.start_in, 1), (span.end, span.end_in, -1)):
        if end is not None:
            c = V.compare(n, V.normalize(F.lit(end))) * sign
            out &= F.coalesce((c >= 0) if inside else (c > 0), F.lit(False))
    return out


def boost(t: Q.Temporal, current: str | None = None) -> Column:
    """What a unit's version adds to its score."""
    v = F.col("version")
    known = F.coalesce(v, F.lit("")) != ""
    if t.intent in ("current", "validity"):
        hit = F.when(same_version(v, [current]), 6.0).otherwise(-2.0) if current else F.lit(0.5)
        return F.when(known, hit).otherwise(-0.25)
    if t.intent in ("explicit_version", "historical"):
        return F.when(known & same_version(v, t.versions), 8.0).when(~known, -0.5).otherwise(0.0)
    if t.intent in ("evolution", "compare_versions"):
        return F.when(known & same_version(v, t.versions), 3.5).otherwise(0.0)
    return F.lit(0.0)


def current_version(units: DataFrame) -> str | None:
    """The newest version of the units if all versions can be ordered, else none."""
    v = units.filter("coalesce(version, '') <> ''").select("version").distinct().withColumn("p", V.parts(V.normalize(F.col("version")))).withColumn("rel", V.normalize(F.col("version")).startswith("rel-"))
    r = v.agg(F.max_by("version", "p").alias("v"), F.count("*").alias("n"), F.count("p").alias("known"), F.countDistinct("rel").alias("families")).first()
    return r["v"] if r["n"] and r["n"] == r["known"] and r["families"] == 1 else None


@dataclass
class Package:
    question: str
    intent: str
    temporal: str
    version: str | None
    budget: int
    sections: dict[str, list[str]] = field(default_factory=dict)
    evidence: list[dict] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)
    text: str = ""
    tokens: int = 0


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence (doc_id, chunk, title, heading, text, score, version) once a document and chunk, or text where it has no chunk; best first is by score, document, chunk."""
    key = F.coalesce(F.col("chunk").cast("string"), F.left(F.sha2("text", 256), F.lit(32)))
    kept = evidence.filter("doc_id is not null and trim(coalesce(text, '')) <> ''")
    g = kept.groupBy("doc_id", key.alias("key")).agg(F.max_by(F.struct(*evidence.columns), "score").alias("e"))
    return g.select("e.*")


def temporal_evidence(evidence: DataFrame, t: Q.Temporal, current: str | None) -> DataFrame:
    """Evidence of the versions asked for counts 8 more; if there is any, the rest counts 0.7, or goes where one version was asked for.

    A question about a certain version that no evidence is of gets none, rather than that of another version.
    """
    wanted = [current] if current and t.intent in ("current", "validity") else t.versions
    if t.intent == "none" or not wanted:
        return evidence
    known = F.coalesce("version", F.lit("")) != ""
    marked = evidence.withColumn("hit", known & same_version(F.col("version"), wanted))
    some = marked.filter("hit").limit(1).count() > 0
    narrow = t.intent in ("current", "validity", "explicit_version", "historical")
    if not some:
        return evidence.limit(0) if t.intent in ("explicit_version", "historical") else evidence
    kept = marked.filter(F.col("hit") | ~known) if narrow else marked
    return kept.withColumn("score", F.when(F.col("hit"), F.col("score") + 8).otherwise(F.col("score") * 0.7)).drop("hit")


def _clip(text: str, n: int) -> str:
    t = " ".join((text or "").split())
    return t if len(t) <= n else t[:n].rstrip() + "…"


def adjacent(relations: DataFrame, near: DataFrame, most: int) -> list[Row]:
    """The first ``most`` relations, by type and ends, that begin or end at one of the (key) ``near``. There may be as many of these as facts, so they are joined, and without the statements."""
    of, ends = ("type", "subject", "object"), relations.select("type", "subject", "object")
    at = [ends.join(near.withColumnRenamed("key", c), c, "left_semi").select(*of) for c in of[1:]]
    first = at[0].unionByName(at[1]).orderBy(*of).limit(2 * most).distinct()  # one of both ends is there twice
    return relations.join(F.broadcast(first), list(of), "left_semi").orderBy(*of).limit(most).collect()


def _lines(units: DataFrame, relations: DataFrame, plan: Q.Plan, question: str, current: str | None) -> dict[str, list[str]]:
    seen = {"visible": visible(plan.temporal), "boost": boost(plan.temporal, current) if plan.temporal.intent != "none" else None}
    pointers = (F.size("derived") + F.size("sources")).alias("pointers")  # a unit may be made from as many as there are facts: they stay where they are
    top = S.search_units(units, question, top_k=plan.orientation, **seen).select("type", "key", "title", "content", "confidence", pointers).collect()  # 50 rows at most
    hits = S.search_units(units, question, ("fact",), plan.facts, **seen).select("key", "content").collect()
    once = lambda xs: list(dict.fromkeys(xs))
    facts = [_clip(r["content"], FACT_LINE) for r in hits]
    stated: list[str] = []
    if plan.intent == "multi_hop":
        keys = lambda xs: units.sparkSession.createDataFrame([(x,) for x in xs], "key string")  # noqa: E731  some dozens
        made = units.filter(F.concat_ws(":", "type", "key").isin([f"{r['type']}:{r['key']}" for r in top])).select(F.explode("derived").alias("id")).filter(F.col("id").startswith("fact:"))
        near, ends = made.select(F.expr("substring(id, 6)").alias("key")).unionByName(keys(r["key"] for r in hits)), []
        for _ in range(2):
            step = adjacent(relations, near, RELATIONS * 4)
            stated += [_clip(r["statement"], FACT_LINE) for r in step]
            ends = once([r[c] for r in step for c in ("subject", "object")])
            if not ends:
                break
            near = F.broadcast(keys(ends))
        facts += [_clip(r["content"], FACT_LINE) for r in units.filter((F.col("type") == "fact") & (F.col("status") == "active") & F.col("key").isin(ends)).orderBy("key").limit(FACTS).select("content").collect()] if ends else []
    about = []
    if plan.temporal.intent != "none":
        about = [f"intent: {plan.temporal.intent}", f"version: {current or ', '.join(plan.temporal.versions) or 'unknown'}"]
    return {
        "orientation": once(f"{r['title']}: {_clip(r['content'], SUMMARY_LINE)}" for r in top if r["type"] in ("summary", "topic")),
        "temporal": about,
        "concepts": once(f"{r['title']} (confidence {r['confidence']:.2f}, {r['pointers']} evidence pointers)" for r in top if r["type"] == "concept"),
        "relations": once(stated)[:RELATIONS],
        "facts": once(facts)[:FACTS],
    }


def compile_context(units: DataFrame, relations: DataFrame, evidence: DataFrame, question: str, budget: int | None = None, temporal: Q.Temporal | None = None) -> Package:
    """What is known about a question, as text of ``budget`` tokens at most.

    Sections come in a fixed order, each within its share; lines are taken as long as they fit and what exact evidence
    needs is left. Evidence follows, best first, the last piece cut to what is left; citations close if there is room.
    What is collected is bounded by the counts of the plan.
    """
    default, least, most = BUDGET
    budget = default if not budget or budget <= 0 else min(max(budget, least), most)
    plan = Q.route(question)
    if temporal is not None:
        plan.temporal = temporal
    t = plan.temporal
    current = current_version(units) if t.intent in ("current", "validity") else None
    p = Package(question.strip(), plan.intent, t.intent, current or (t.versions[0] if t.versions else None), budget)
    reserve = 32 if t.intent == "range_history" else min(max(budget * 3 // 4, 48), 256)
    head = f"# Knowledge Context\nQuery: {Q.clipped(p.question, budget // 4)}\n"
    left, out = budget - Q.tokens(head), [head]
    for name, lines in _lines(units, relations, plan, question, current).items():
        used, kept = Q.tokens(HEADS[name]) + 2, []
        for line in lines:
            cost = Q.tokens("- " + line)
            if used + cost > budget // SHARES[name] or left - cost - used <= reserve:
                break
            kept.append(line)
            used += cost
        if kept:
            left -= used
            p.sections[name] = kept
            out.append("\n".join([HEADS[name], *("- " + line for line in kept), ""]))
    out.append("\n## Exact evidence\n")
    left -= Q.tokens(out[-1])
    rows = temporal_evidence(distinct_evidence(evidence), t, current).orderBy(F.desc("score"), "doc_id", "chunk").limit(max(1, budget // 12)).collect()
    for n, r in enumerate(rows, 1):
        title = r["title"] or str(r["doc_id"])
        heading = (r["heading"] or "").strip()
        label = f"[{n}] {title}" + (f" / {heading}" if heading and heading.lower() != title.lower() else "") + "\n"
        room = left - 12 - Q.tokens(label)
        body = r["text"].strip()
        if Q.tokens(body) > room:
            if room < 12:
                break
            body = Q.clipped(body, room)
        out.append(f"{label}{body}\n")
        left -= Q.tokens(label) + Q.tokens(body)
        p.evidence.append(r.asDict())
        p.citations.append(f"[{n}] {title}#{r['chunk']}")
    if p.citations and left > budget // 4:
        out.append("\n## Citations\n" + "\n".join(p.citations) + "\n")
    p.text = "".join(out)
    if Q.tokens(p.text) > budget:
        p.text = Q.clipped(p.text, budget)
    p.tokens = Q.tokens(p.text)
    return p
