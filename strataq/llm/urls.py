"""Temporal URL filter lists, in DataFrame functions only.

A list is a ledger of dated events that add or remove an entry. The events of one entry
become half-open validity intervals, and each capture is compared with the entries that were
active when it was fetched: an equality join on the keys a URL can match, with the interval
as a further condition. Captures of one host may be a third of all, so captures that have a listed
key in common are counted first: a key with more than ``PART_ROWS`` of them is dealt over as
many parts as it needs, and only its entries are repeated for each part.

Kinds of entries: ``host`` (exactly this host), ``domain`` (this host and all below it) and
``path`` (host and leading path segments). Events of one entry at one time: a removal wins.

Defined results: a null or unreadable URL, or a null time, matches nothing; an empty list
blocks nothing; repeated captures and repeated events are allowed; an empty table gives an
empty result; captures keep all their columns, except that ``host``, ``blocked``, ``n_active``,
``entry`` and ``active_since`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures of one key that are joined together, about. Keys with more are broadcast: one row for each ``PART_ROWS``
#: captured keys at most, which is 100,000 rows for 10^10 of them.
PART_ROWS = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
ADDED = ("host", "blocked", "n_active", "entry", "active_since")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """``kind``, ``entry``, ``valid_from``, ``valid_to`` (null: still active) from events (kind, entry, action, at)."""
    one = events.filter("entry IS NOT NULL AND at IS NOT NULL").groupBy("kind", "entry", "at").agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("kind", "entry").orderBy("at")
    changes = one.withColumn("was", F.lag("gone").over(w)).filter(F.coalesce(F.col("was"), F.lit(True)) != F.col("gone"))
    return changes.withColumn("valid_to", F.lead("at").over(w)).filter("NOT gone").select("kind", "entry", F.col("at").alias("valid_from"), "valid_to")


def keys_of(url: Column, host: Column) -> Column:
    """Every (kind, entry) that could match a URL."""
    labels = F.split(host, r"\.")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("entry")))
    segments = F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: F.struct(F.lit("path").alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i), "/")).alias("entry"))))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("entry")))
    return F.when(host.isNotNull(), F.concat(exact, below, F.coalesce(paths, F.array().cast("array<struct<kind:string,entry:string>>"))))


def as_of(captures: DataFrame, events: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Captures (url, fetched_at, ...) with the entries active at ``fetched_at``.

    ``entry`` is the longest active one (ties: the smallest by kind, then by text) and
    ``active_since`` the start of its interval.
    """
    captures = captures.drop(*ADDED).withColumn("host", host_of(F.col("url")))
    distinct = captures.select("url", "host", "fetched_at").filter("host IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    active = intervals(events)
    keyed = distinct.select("url", "fetched_at", F.inline(keys_of(F.col("url"), F.col("host"))))
    # Counted by key before the shuffle; only listed keys matter.
    counts = keyed.groupBy("kind", "entry").agg(F.count("*").alias("n")).filter(F.col("n") > part_rows)
    hot = F.broadcast(counts.join(active.select("kind", "entry").distinct(), ["kind", "entry"], "left_semi").select("kind", "entry", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")))
    salted = keyed.join(hot, ["kind", "entry"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("url", "fetched_at"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    repeated = active.join(hot, ["kind", "entry"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    hit = salted.join(repeated, ["kind", "entry", "salt"]).filter("valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)")
    best = F.min(F.struct((-F.char_length("entry")).alias("n"), F.col("kind"), F.col("entry"), F.col("valid_from")))
    found = hit.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), best.alias("best"))
    found = found.select("url", "fetched_at", "n_active", F.concat_ws(":", "best.kind", "best.entry").alias("entry"), F.col("best.valid_from").alias("active_since"))
    return captures.join(found, ["url", "fetched_at"], "left").withColumn("blocked", F.col("n_active").isNotNull()).withColumn("n_active", F.coalesce("n_active", F.lit(0).cast("long")))


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` have no time: each is taken as fetched on a day that follows from its id."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def events_of(pages: DataFrame) -> DataFrame:
    """A list made from the hosts of ``pages``: what is listed, and when, follows from the host's MD5."""
    site = F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", "")
    sites = pages.select(site.alias("site")).filter("site IS NOT NULL").distinct()
    h = F.conv(F.substring(F.md5("site"), 1, 6), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    listed = sites.withColumn("h", h).withColumn("day", F.date_add(start, (F.col("h") % 365).cast("int")))
    event = lambda kind, entry, action, at: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"), F.lit(action).alias("action"), at.alias("at"))
    s, d = F.col("site"), F.col("day")
    made = F.when(F.col("h") % 10 == 0, F.array(event("domain", s, "add", d), event("domain", s, "remove", F.date_add(d, 120)), event("domain", s, "add", F.date_add(d, 300))))
    made = made.when(F.col("h") % 10 == 1, F.array(event("host", F.concat(F.lit("www."), s), "add", d))).when(F.col("h") % 10 == 2, F.array(event("path", F.concat(s, F.lit("/en")), "add", d), event("path", F.concat(s, F.lit("/en")), "remove", F.date_add(d, 200))))
    made = made.when(F.col("h") % 10 == 3, F.array(event("domain", s, "add", d), event("path", F.concat(s, F.lit("/de")), "add", start)))
    return listed.filter(made.isNotNull()).select(F.inline(made))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the ``op10_url_filters`` query."""
    return as_of(captures_of(pages), events_of(pages)).select("page_id", "url", "host", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "n_active", "entry", F.col("active_since").cast("string").alias("active_since"))


SQL = rf"""
WITH c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 7919) % 730 AS INTEGER) AS DATE) AS fetched_at,
    nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
    list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS seg FROM pages),
s AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS site FROM c WHERE host IS NOT NULL),
h AS (SELECT site, CAST('0x' || substr(md5(site), 1, 6) AS INTEGER) AS h FROM s),
l AS (SELECT site, h % 10 AS r, CAST(DATE '2024-01-01' + h % 365 AS DATE) AS d FROM h),
v AS (SELECT 'domain' AS kind, site AS entry, d AS f, CAST(d + 120 AS DATE) AS t FROM l WHERE r = 0
  UNION ALL SELECT 'domain', site, CAST(d + 300 AS DATE), NULL FROM l WHERE r = 0
  UNION ALL SELECT 'host', 'www.' || site, d, NULL FROM l WHERE r = 1
  UNION ALL SELECT 'path', site || '/en', d, CAST(d + 200 AS DATE) FROM l WHERE r = 2
  UNION ALL SELECT 'domain', site, d, NULL FROM l WHERE r = 3
  UNION ALL SELECT 'path', site || '/de', DATE '2024-01-01', NULL FROM l WHERE r = 3),
m AS (SELECT c.page_id, c.url, c.fetched_at, v.kind, v.entry, v.f FROM c JOIN v ON v.f <= c.fetched_at AND (v.t IS NULL OR c.fetched_at < v.t)
  AND ((v.kind = 'host' AND v.entry = c.host) OR (v.kind = 'domain' AND (v.entry = c.host OR ends_with(c.host, '.' || v.entry)))
    OR (v.kind = 'path' AND starts_with(c.host || '/' || array_to_string(c.seg, '/') || '/', v.entry || '/')))),
b AS (SELECT page_id, url, fetched_at, count(*) OVER w AS n, kind || ':' || entry AS entry, f, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(entry) DESC, kind, entry, f) AS k FROM m WINDOW w AS (PARTITION BY page_id, url, fetched_at))
SELECT c.page_id, c.url, c.host, CAST(c.fetched_at AS VARCHAR) AS fetched_at, b.n IS NOT NULL AS blocked, coalesce(b.n, 0)::BIGINT AS n_active, b.entry, CAST(b.f AS VARCHAR) AS active_since
FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.url = c.url AND b.k = 1
"""
