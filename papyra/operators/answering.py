"""One call from a question to what answers it: passages, units of knowledge, or both in one package, under a version policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import questions as Q
from papyra.operators import context as C
from papyra.operators import search as Se
from papyra.operators import semantic as S

MODES = ("evidence", "semantic", "hybrid", "auto")


@dataclass
class Policy:
    """Which versions count: current, all, as_of a version, or a range; without a kind, what the question says."""

    kind: str | None = None
    as_of: str | None = None
    start: str | None = None
    end: str | None = None

    def temporal(self, question: str) -> Q.Temporal:
        if self.kind is None:
            if self.as_of or self.start or self.end:
                raise ValueError("a version bound needs a policy")
            return Q.route(question).temporal
        return Q.policy(self.kind, self.as_of, self.start, self.end)


@dataclass
class Answer:
    """``hits``: passages with windows and citations; ``units``: what is known, best first; ``package``: both as one text. Parts that the mode doesn't ask for are empty."""

    question: str
    mode: str
    intent: str
    temporal: str
    hits: list[dict] = field(default_factory=list)
    units: list[dict] = field(default_factory=list)
    package: C.Package | None = None
    degraded: list[str] = field(default_factory=list)


def resolved(mode: str | None, passages: bool, knowledge: bool) -> str:
    """The mode that is used: one that isn't known is auto, and auto is as much as there is."""
    mode = mode if mode in MODES else "auto"
    if mode == "auto":
        return "hybrid" if passages and knowledge else "evidence" if passages else "semantic"
    return mode


def ask(
    question: str,
    lib: Se.Library | None = None,
    knowledge: tuple[DataFrame, DataFrame] | None = None,
    vector: list[float] | None = None,
    mode: str | None = None,
    policy: Policy | None = None,
    options: Se.Options | None = None,
    versions: DataFrame | None = None,
    budget: int | None = None,
) -> Answer:
    """What a library and its compiled units and relations answer to a question.

    The question is routed once, for how many units and which versions it wants; the policy, if any, goes before what it
    says of versions. ``evidence`` searches passages, ``semantic`` units, ``hybrid`` both and puts them into one package
    of ``budget`` tokens. ``versions``, (doc_id, version), says of which version a document is. What a mode asks for
    but there isn't is told in ``degraded``. All that is collected is bounded by the options and the plan.
    """
    if not question.strip():
        return Answer(question, resolved(mode, lib is not None, knowledge is not None), "fact", "none")
    plan = Q.route(question)
    plan.temporal = (policy or Policy()).temporal(question)
    out = Answer(question.strip(), resolved(mode, lib is not None, knowledge is not None), plan.intent, plan.temporal.intent)
    evidence = None
    if out.mode != "semantic":
        if lib is None:
            out.degraded.append("no passages")
        else:
            o = options or Se.Options()
            hits = Se.with_evidence(lib, Se.search(lib, question, vector, o), question, o.radius, o.budget)
            out.hits = [r.asDict() for r in hits.orderBy("rank").collect()]
            out.degraded += sorted({h["degraded"] for h in out.hits if h["degraded"]})
            evidence = hits
    if out.mode != "evidence":
        if knowledge is None:
            out.degraded.append("no compiled knowledge")
        else:
            units, relations = knowledge
            current = C.current_version(units) if plan.temporal.intent in ("current", "validity") else None
            boost = C.boost(plan.temporal, current) if plan.temporal.intent != "none" else None
            kinds = ("fact", "concept", "topic", "summary")
            out.units = [r.asDict(True) for r in S.search_units(units, question, kinds, plan.orientation + plan.facts, C.visible(plan.temporal), boost).collect()]
            if out.mode == "hybrid" and evidence is not None:
                out.package = C.compile_context(units, relations, _pieces(evidence, versions, lib), question, budget, plan.temporal)
    return out


def _pieces(hits: DataFrame, versions: DataFrame | None, lib: Se.Library) -> DataFrame:
    """Hits as evidence of a package: the window is the text, the chunk's heading its heading."""
    heads = lib.chunks.select("doc_id", "idx", "heading")
    e = hits.join(heads, ["doc_id", "idx"], "left").select("doc_id", F.col("idx").alias("chunk"), "title", "heading", F.col("evidence").alias("text"), F.col("score").cast("double").alias("score"))
    if versions is None:
        return e.withColumn("version", F.lit(None).cast("string"))
    return e.join(versions.select("doc_id", "version"), "doc_id", "left")
