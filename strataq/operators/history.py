"""Ancestry of revisions, in a number of joins that is logarithmic in its depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import checkpointed


class CycleError(ValueError):
    """A revision is its own ancestor."""


def ancestry(revisions: DataFrame, tips: DataFrame, most_doublings: int = 40) -> DataFrame:
    """``(tip, revision_id, depth)`` for each tip and all its ancestors, itself at depth 0.

    ``revisions`` has (revision_id, parent_id). Jumps of 1, 2, 4, ... parents are joined in
    turn, so a chain of a million revisions takes twenty rounds.
    """
    jump = checkpointed(revisions.filter("parent_id IS NOT NULL").select(F.col("revision_id").alias("a"), F.col("parent_id").alias("b")).distinct())
    many, jumps = jump.count(), []
    bound = many
    for k in range(most_doublings):
        if jump.isEmpty():
            break
        if 1 << k > bound:
            raise CycleError("the ancestry has a cycle")
        jumps.append(jump)
        jump = checkpointed(jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")))
    out = tips.select(F.col("revision_id").alias("tip"), "revision_id", F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):
        # Each row stays and, where the jump exists, is joined by the row at its end; the input is read once.
        both = F.array(F.struct("revision_id", "depth"), F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("revision_id"), (F.col("depth") + (1 << k)).alias("depth"))))
        out = out.join(jumps[k], F.col("revision_id") == F.col("a"), "left").select("tip", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("tip", "x.revision_id", "x.depth")
    return out


def history_page(chain: DataFrame, after=None, limit: int = 64) -> DataFrame:
    """Newest first; the cursor is a revision on the chain, excluded, and an unknown one is refused."""
    if after is not None:
        at = chain.filter(F.col("revision_id") == after).agg(F.min("depth").alias("d")).first()["d"]
        if at is None:
            raise ValueError(f"{after} is not on the chain")
        chain = chain.filter(F.col("depth") > at)
    return chain.orderBy("depth").limit(limit)


def is_ancestor(chain: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (tip, candidate) with ``is_ancestor``."""
    known = chain.select("tip", F.col("revision_id").alias("candidate"), F.lit(True).alias("_k")).distinct()
    return pairs.join(known, ["tip", "candidate"], "left").withColumn("is_ancestor", F.coalesce("_k", F.lit(False))).drop("_k")


def sequence_audit(revisions: DataFrame) -> DataFrame:
    """Revisions whose captured sequence is not larger than their parent's."""
    parent = revisions.select(F.col("revision_id").alias("parent_id"), F.col("seq").alias("parent_seq"))
    return revisions.join(parent, "parent_id").filter("seq <= parent_seq").select("revision_id", "parent_id", "seq", "parent_seq")
