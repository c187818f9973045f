"""Incremental capture of changes against the last recorded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.running import running


def capture(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Changes from (key, oid, kind, size, mtime, mode): A, D, M, T.

    Another hash or kind is M; where both lack a hash, size and time decide; another mode
    alone is T. Nothing changed gives no rows, and so no revision.
    """
    fields = ("oid", "kind", "size", "mtime", "mode")
    r = recorded.select("key", F.struct(*fields).alias("r"))
    c = current.select("key", F.struct(*fields).alias("c"))
    hashless = F.col("r.oid").isNull() & F.col("c.oid").isNull()
    differs = ~F.col("r.kind").eqNullSafe(F.col("c.kind")) | F.when(hashless, ~F.col("r.size").eqNullSafe(F.col("c.size")) | ~F.col("r.mtime").eqNullSafe(F.col("c.mtime"))).otherwise(~F.col("r.oid").eqNullSafe(F.col("c.oid")))
    status = F.when(F.col("r").isNull(), "A").when(F.col("c").isNull(), "D").when(differs, "M").when(~F.col("r.mode").eqNullSafe(F.col("c.mode")), "T")
    return r.join(c, "key", "full_outer").select("key", status.alias("status"), (F.col("c").isNotNull() & F.col("c.oid").isNull()).alias("incomplete")).filter("status IS NOT NULL")


def numbered(changes: DataFrame, by: str, order: str = "key") -> DataFrame:
    """A dense ``seq`` from 0 within each revision."""
    return running(changes, [by], [order], seq=F.lit(1)).withColumn("seq", (F.col("seq") - 1).cast("long"))


def reconcile(recorded: DataFrame, changes: DataFrame) -> DataFrame:
    """Recorded keys that are no longer part of the diff, and so are back at the baseline."""
    return recorded.join(changes.select("key"), "key", "left_anti")


def candidates_only(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows that an event journal names; the rest need no comparison."""
    return rows.join(candidates.select("key").distinct(), "key", "left_semi")


def journal_verdict(cursor: int | None, oldest: int | None, newest: int | None, dropped: bool = False, timed_out: bool = False) -> str:
    """Whether events after ``cursor`` can be replayed: ok, or why all must be scanned instead: must-scan (no cursor or journal), wrapped (ahead of the journal), stale (behind its retention), dropped (events were lost), timeout."""
    if cursor is None or oldest is None or newest is None:
        return "must-scan"
    if cursor > newest:
        return "wrapped"
    if cursor + 1 < oldest:
        return "stale"
    return "dropped" if dropped else "timeout" if timed_out else "ok"


def replayed(rows: DataFrame, candidates: DataFrame, verdict: str) -> DataFrame:
    """The rows to compare: those that events name if the journal is ok, else all of them."""
    return candidates_only(rows, candidates) if verdict == "ok" else rows


def events_after(events: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    return events.filter(F.col(order) > cursor)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Incoming rows replace stored ones of the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Stored rows win; of several incoming rows with a new key any one is added."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def add_counts(counters: DataFrame, events: DataFrame, key: str = "key") -> DataFrame:
    """Counters (key, n) raised by the number of events of each key."""
    return counters.select(key, "n").unionByName(events.groupBy(key).agg(F.count("*").alias("n"))).groupBy(key).agg(F.sum("n").alias("n"))
