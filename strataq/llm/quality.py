"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. The ledger keeps what was measured and one bit for each rule
that failed, so a new policy is a different mask over stored bits and needs no second pass
over the texts; ablations are bitwise aggregates of the ledger.

Defined results: a null text counts as an empty one; an empty text has no words and fails
``few_words``; an empty table gives an empty ledger; repeated rows are judged one by one;
only ``doc_id`` and ``text`` are read, so further columns can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import SPACES

#: Rules by bit. Ratios are compared as integers, so that every engine decides alike.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclaiming", "4 * n_exclaim > n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]

#: A policy is the set of bits that reject a document; every policy holds the base.
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | BITS["symbols"] | BITS["repeated_lines"],
    "v3": (1 << len(RULES)) - 1,
}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def _only(marks: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(marks, pattern, "")).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Words that windows of ``width`` words cover, given their sorted starts."""
    steps = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(width), F.get(starts, i + 1) - p), F.lit(width)).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id`` and the measurements, one row per row of ``docs``; ``carry`` adds the whole row as ``row``."""
    keep = ["doc_id", "row"] if carry else ["doc_id"]
    if carry:
        docs = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        *keep,
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        lines.alias("lines"),
        F.regexp_replace(text, r"[^A-Z!#*$%&|<>]+", "").alias("marks"),
    )
    two = one.select(
        *keep,
        _only(F.col("marks"), r"[A-Z!]+").alias("n_symbols"),
        _only(F.col("marks"), r"[^A-Z]+").alias("n_upper"),
        _only(F.col("marks"), r"[^!]+").alias("n_exclaim"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Equal windows are found by the 64-bit hash of their five word hashes, within one text only.
    after = lambda i, k: F.get(F.col("hashes"), i + k)
    windows = F.slice(F.transform("hashes", lambda x, i: F.xxhash64(x, *(after(i, k) for k in range(1, 5)))), F.lit(1), F.greatest(F.size("hashes") - 4, F.lit(0)))
    three = two.withColumn("windows", windows).drop("hashes")
    # Only texts with a repeated window pay for the sort that carries positions.
    placed = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    four = three.withColumn("placed", placed).drop("windows")
    same = lambda x, i: F.coalesce(F.get(F.col("placed"), i)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("placed", lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1)), lambda x: x["p"]))
    five = four.withColumn("starts", starts)
    return five.select(*keep, *MEASURES[:4], F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("starts"), 5)).alias("n_repeat_words"), *MEASURES[5:])


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Measurements and ``failed_bits``: bit i is set where rule i of ``RULES`` fails."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    # A filter on the bits must not be pushed below the measurements: it would compute them again for each element.
    # An expression that is not deterministic holds it above; test_quality_filter_stays_above checks the plan.
    once = F.when(F.monotonically_increasing_id() >= 0, bits)
    return measured(docs, carry).withColumn("failed_bits", once.cast("int"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """``kept`` under a policy, from the stored bits alone."""
    return rows.withColumn("policy", F.lit(version)).withColumn("base_failed", F.col("failed_bits").bitwiseAND(BASE) != 0).withColumn("kept", F.col("failed_bits").bitwiseAND(POLICIES[version]) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents rejected, those that the rule fails, and those that only it rejects."""
    counts = []
    for version, mask in POLICIES.items():
        hit = F.col("failed_bits").bitwiseAND(mask)
        for name, bit in BITS.items():
            if mask & bit:
                counts.append(F.struct(F.lit(version).alias("policy"), F.lit(name).alias("rule"), F.count_if(hit != 0).alias("rejected"), F.count_if(hit.bitwiseAND(bit) != 0).alias("failing"), F.count_if(hit == bit).alias("only_this_rule")))
    return rows.agg(F.array(*counts).alias("x"), F.bit_or("failed_bits").alias("any_bits")).select(F.inline("x"))


def filtered(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns."""
    return apply_policy(ledger(docs, carry=True), version).filter("kept").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the ``op9_quality_rules`` query."""
    return apply_policy(ledger(docs)).select("doc_id", *MEASURES[:5], "base_failed", "kept", "failed_bits")


_W = r"[^\x20\x09-\x0D]"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM d),
b AS (SELECT *, len(w) AS n_words, [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] AS g FROM a),
o AS (SELECT rid, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS p FROM (SELECT row_number() OVER () AS rid, * FROM b)),
r AS (SELECT rid, p FROM o QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
s AS (SELECT rid, sum(least(5, coalesce(lead_p - p, 5))) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS lead_p FROM r) GROUP BY rid),
m AS (SELECT doc_id, n_words::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        (length(text) - length(regexp_replace(text, '!', '', 'g')))::BIGINT AS n_exclaim
      FROM (SELECT row_number() OVER () AS rid, * FROM b) b LEFT JOIN s USING (rid)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))})::INTEGER AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {BASE}) <> 0 AS base_failed, (failed_bits & {POLICIES[CURRENT]}) = 0 AS kept, failed_bits FROM f
"""

_HIT = lambda mask: f"(failed_bits & {mask})"
ABLATIONS_SQL = f"WITH q AS ({SQL.strip()}) " + " UNION ALL ".join(
    f"SELECT '{version}' AS policy, '{name}' AS rule, count(*) FILTER ({_HIT(mask)} <> 0) AS rejected, count(*) FILTER ({_HIT(bit)} <> 0) AS failing, count(*) FILTER ({_HIT(mask)} = {bit}) AS only_this_rule FROM q"
    for version, mask in POLICIES.items()
    for name, bit in BITS.items()
    if mask & bit
)
