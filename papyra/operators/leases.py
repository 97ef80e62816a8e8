"""Operations that workers hold by leases: what a log of actions makes of them, and what may start beside what runs.

A worker that claims an operation holds it as long as it says so again before its lease ends. After that anyone may take
it over; what the former holder still reports is refused. The log is folded in order, an operation's actions passing by
as a stream, so one with any number of them needs no memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times an operation is tried, operations looked at for admission.
ATTEMPTS, LOOKED_AT = 3, 32
ACTIONS = ("submit", "claim", "heartbeat", "complete", "fail", "cancel", "retry")


@dataclass
class Held:
    """An operation as it stands; ``until`` is the second at which its lease ends."""

    state: str | None = None
    worker: str | None = None
    until: int | None = None
    attempt: int = 0


def step(o: Held, action: str, worker: str | None, at: int, lease_s: int, attempts: int = ATTEMPTS) -> tuple[Held, str]:
    """The operation after an action, and what came of it: ok, takeover, again (queued after a failure), cancelled, exhausted, busy, lost (not the holder any more), exists or refused."""
    open_ = o.state in ("running", "cancelling")
    stale = open_ and at > o.until
    mine = open_ and not stale and worker == o.worker
    free = Held(None, None, None, o.attempt)
    if action == "submit":
        return (Held("queued"), "ok") if o.state is None else (o, "exists")
    if action == "claim":
        if o.state == "queued" or (stale and o.state == "running" and o.attempt < attempts):
            return Held("running", worker, at + lease_s, o.attempt + 1), "ok" if o.state == "queued" else "takeover"
        if stale:
            free.state = "cancelled" if o.state == "cancelling" else "failed"
            return free, "cancelled" if o.state == "cancelling" else "exhausted"
        return o, "busy" if open_ else "refused"
    if action in ("heartbeat", "complete", "fail"):
        if not mine:
            return o, "lost" if open_ else "refused"
        if action == "heartbeat":
            return Held(o.state, worker, at + lease_s, o.attempt), "ok"
        if o.state == "cancelling":
            return Held("cancelled", attempt=o.attempt), "cancelled"
        if action == "complete":
            return Held("succeeded", attempt=o.attempt), "ok"
        again = o.attempt < attempts
        return Held("queued" if again else "failed", attempt=o.attempt), "again" if again else "ok"
    if action == "cancel" and o.state in ("queued", "running"):
        return (Held("cancelled", attempt=o.attempt) if o.state == "queued" else Held("cancelling", o.worker, o.until, o.attempt)), "ok"
    if action == "retry" and o.state in ("failed", "cancelled"):
        return Held("queued"), "ok"
    return o, "refused"


def replayed(log: DataFrame, lease_s: int, attempts: int = ATTEMPTS) -> DataFrame:
    """(op, seq, action, worker, at, outcome, state, holder, until, attempt): each action of a log (op, seq, at in seconds, action, worker) with what came of it and how the operation stands after it.

    Actions count in order of seq; unknown or null ones are refused. A null worker is one that nobody else is.
    """
    kind = log.schema["op"].dataType.simpleString()

    def fold(batches):
        op, held = object(), Held()
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.op != op:
                    op, held = r.op, Held()
                worker = None if pd.isna(r.worker) else r.worker
                held, outcome = step(held, r.action, worker, int(r.at), lease_s, attempts)
                rows.append((r.op, r.seq, r.action, worker, r.at, outcome, held.state, held.worker, held.until, held.attempt))
            out = pd.DataFrame(rows, columns=["op", "seq", "action", "worker", "at", "outcome", "state", "holder", "until", "attempt"])
            yield out.astype({"until": "Int64"})

    own = log.select("op", F.col("seq").cast("long").alias("seq"), "action", "worker", F.col("at").cast("long").alias("at")).filter("op is not null")
    ordered = own.repartition("op").sortWithinPartitions("op", "seq")
    return ordered.mapInPandas(fold, f"op {kind}, seq long, action string, worker string, at long, outcome string, state string, holder string, until long, attempt int")


def tail(events: DataFrame, op, after: int = -1, most: int = 100) -> DataFrame:
    """An operation's events (op, seq, ...) behind a cursor, in order: ``most``, 500 at most; the last one's seq is the next cursor."""
    return events.filter((F.col("op") == op) & (F.col("seq") > after)).orderBy("seq").limit(min(most, 500) if most > 0 else 100)


def admitted(operations: DataFrame, now_s: int, slots: dict[str, int], budget: dict[str, int], looked_at: int = LOOKED_AT) -> DataFrame:
    """(op, place): queued operations that may start now beside those that run, in the order in which they are admitted.

    ``operations``: op, class, base, state, priority, requested (seconds) and a column for each resource of ``budget``.
    The first ``looked_at`` by priority, one higher for each second waited, are gone through; one is admitted if its
    class has a slot, nothing of its base runs, and all its resources fit into what is left. One that doesn't fit lets
    others pass. A class without slots has one, a null base is nobody's.
    """
    names = sorted(budget)
    aged = F.col("priority") + F.lit(now_s) - F.col("requested")
    need = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names]
    first = operations.filter("state = 'queued'").withColumn("aged", aged).orderBy(F.desc("aged"), "requested", "op").limit(looked_at)
    busy = operations.filter("state in ('running', 'cancelling')")
    used = {r["class"]: r["n"] for r in busy.groupBy("class").agg(F.count("*").alias("n")).collect()}
    spent = busy.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.lit(0).alias("_")).first()
    left = {c: budget[c] - int(spent[c]) for c in names}
    rows = first.select("op", "class", "base", *need, "aged", "requested").join(busy.select("base").distinct().withColumn("held", F.lit(True)), "base", "left").orderBy(F.desc("aged"), "requested", "op").collect()  # looked_at rows
    out, bases = [], set()
    for r in rows:
        free = used.get(r["class"], 0) < slots.get(r["class"], 1)
        alone = r["base"] is None or not (r["held"] or r["base"] in bases)
        if free and alone and all(r[c] <= left[c] for c in names):
            used[r["class"]] = used.get(r["class"], 0) + 1
            bases.add(r["base"])
            left = {c: left[c] - r[c] for c in names}
            out.append((r["op"], len(out) + 1))
    return operations.sparkSession.createDataFrame(out, f"op {operations.schema['op'].dataType.simpleString()}, place int")
