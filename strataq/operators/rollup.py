"""Roll-ups over states, pools, trash and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.running import running


def by_state(rows: DataFrame, state: str, amount: Column) -> DataFrame:
    return rows.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))


def pivot_states(rows: DataFrame, by: str, state: str, states: list[str]) -> DataFrame:
    """One column of counts for each named state, 0 where there is none."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def pool_status(rows: DataFrame, by: str, state: Column, created: Column) -> DataFrame:
    """Ready, building and stale entries with the first and last time of creation."""
    return rows.groupBy(by).agg(F.count_if(state == "ready").alias("ready"), F.count_if(state == "building").alias("building"), F.count_if(state == "stale").alias("stale"), F.min(created).alias("oldest"), F.max(created).alias("newest"))


def next_ids(rows: DataFrame, by: str, key: str) -> DataFrame:
    """The id that comes after the largest one of each group, 1 where there is none."""
    return rows.groupBy(by).agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def tagged_union(**tables: DataFrame) -> DataFrame:
    """All rows of tables with equal columns, with the name of their table as ``kind``."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def retention_due(rows: DataFrame, trashed_at: Column, now: Column, retention: Column) -> DataFrame:
    """Trash whose retention is over at ``now``, the boundary included."""
    return rows.filter(trashed_at <= now - retention)


def trash_classes(trash: DataFrame, known: DataFrame, now: int, retention: int) -> DataFrame:
    """(key, trashed_at, state) as orphan (unknown key), deleting, due or waiting."""
    j = trash.join(known.select("key", F.lit(True).alias("_k")), "key", "left")
    kind = F.when(F.col("_k").isNull(), "orphan").when(F.col("state") == "deleting", "deleting").when(F.col("trashed_at") <= now - retention, "due").otherwise("waiting")
    return j.select("key", kind.alias("class"))


def hardlink_groups(names: DataFrame, by: list[str], name: str, links: str) -> DataFrame:
    """Names of each file in order; a group with fewer names than links has some outside."""
    return names.groupBy(*by).agg(F.sort_array(F.collect_list(name)).alias("names"), F.count("*").alias("n"), F.max(links).alias("links")).withColumn("external", F.col("n") < F.col("links"))


def guarded_percentiles(samples: DataFrame, by: list[str], value: str, least: int = 1000) -> DataFrame:
    """Nearest-rank median and 95th percentile; the latter is withheld below ``least`` samples. Ranks are running counts of the distinct values."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = running(counts, by, [value], _r=F.col("_c"))
    totals = samples.groupBy(*by).agg(F.count(value).alias("n"))
    named = ranked.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(by)), value, "_r")
    j = totals.join(named, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by)], "left")
    nearest = lambda q: F.min(F.when(F.col("_r") >= F.col("n") * q, F.col(value)))
    return j.groupBy(*by, "n").agg(nearest(0.5).alias("p50"), nearest(0.95).alias("p95")).withColumn("p95", F.when(F.col("n") >= least, F.col("p95"))).select(*by, "n", "p50", "p95")


def coverage(cases: DataFrame) -> DataFrame:
    """For each family its cases and layers, from (family, case_id, layer)."""
    return cases.groupBy("family").agg(F.sort_array(F.collect_set("case_id")).alias("cases"), F.sort_array(F.collect_set("layer")).alias("layers"))
