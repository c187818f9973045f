"""Pages, vectors, conversations and URL lists."""

import math
import os
import random
import re
import time
from collections import Counter
from datetime import date
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import html, neighbours, segmenting, urls

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<!-- open", ""), ("<div><script>x</div>", ""),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p><b>Long enough text &amp; more<br>of it<p>Second &lt;one&gt; &#233;</article><footer>f</footer>", "T\n\nLong enough text & more of it\n\nSecond <one> é"),
        ("<body><header><h1>Site</h1></header><div id=content><p>Some <i>text</i> in a <a href=x>link</a> and more of it.</p><ul><li>one<li>two</ul></div><aside>side</aside><div class='comments'><p>I like this very much indeed, thank you.</p></div><form><p>sign</p></form>", "Some text in a link and more of it.\n\none\n\ntwo"),
        ("<article><p>Kept text that is long.</p><div class=\"cookie-notice\">cookies</div><p style='display:none'>hidden</p><textarea><p>x</textarea></article>", "Kept text that is long."),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
    ],
)
def test_extract(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("wrapper", ['div class="content-sidebar-wrap"', 'div class="layout has-sidebar"', 'div id="page" class="no-comments"', 'section class="related-work"', 'div class="page has-header"'])
@pytest.mark.parametrize("holder", ["main", "article", "div"])
def test_extract_from_named_wrappers(wrapper, holder):
    """A word such as sidebar in a wrapper's class does not lose the article; a sidebar in the wrapper still goes."""
    body = "<p>The first paragraph of the text, which is long enough to be seen.</p><p>The second one follows it and is about as long.</p>"
    page = f"<body><div class=sidebar><p>Short side note.</p></div><{wrapper}><{holder}>{body}</{holder}><div class=related><a href=x>More</a></div></{wrapper.split()[0]}></body>"
    assert html.extract(page) == "The first paragraph of the text, which is long enough to be seen.\n\nThe second one follows it and is about as long."


def test_extract_short_article_beside_a_long_advert():
    assert html.extract(f"<div class=ad>{'Buy this now. ' * 20}</div><article><p>Short.</p></article>") == "Short."


def test_extract_deep_and_long_pages():
    assert html.extract("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    body = "".join(f"<p>Paragraph number {i} with some words.</p>" for i in range(5000))
    assert html.extract(f"<article>{body}</article>").count("\n\n") == 4999
    assert html.extract("<a href='" * 3000) is not None


def test_main_text_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>é</p>", "y"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html.digest(rows).collect()) == [("1", "", 0), ("1", "", 0), ("None", "é", 1)]
    assert html.digest(rows.limit(0)).count() == 0


def test_extract_from_a_page_wide_form():
    body = "<p>The first paragraph of the text, which is long enough to be seen.</p><p>The second one follows it and is about as long.</p>"
    assert html.extract(f"<body><form id=aspnetForm><div class=menu><a href=/>Home</a></div>{body}<form class=search><label>Find</label> Go</form></form></body>").startswith("The first paragraph")
    assert html.extract(f"<body><div>{body}</div><form><p>Your name and your mail, please.</p></form></body>") == "The first paragraph of the text, which is long enough to be seen.\n\nThe second one follows it and is about as long."


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<a href='" * 60_000, "<a " * 200_000, "<a " * 200_000 + "\">", "</b>" * 200_000, "<p><b>" * 60_000, "<ul><li>" * 40_000 + "</b>" * 40_000, "<!--" * 200_000, "<script>" * 100_000, "<div>" + "<span>" * 60_000 + "</p>" * 60_000, "<li>" + "<ul>" + "<span>" * 30_000 + "<li></li>" * 30_000, "<div class=ad>" * 30_000 + "x", "<div " + "a" * 600_000 + ">x", "<div " + "a=b " * 200_000 + ">x</div>", "&" * 600_000, "<" * 600_000], ids=range(16))
def test_extract_takes_linear_time(page):
    start = time.process_time()
    html.extract(page)
    assert time.process_time() - start < 3


@needs_data
def test_extract_equals_the_article_of_every_page():
    """The given pages mark their article, so cutting it out by its tags is the plain way."""
    blocks = re.compile(r"</?(?:article|p|h[1-6]|ul|ol|li|div|section|blockquote|pre|table|tr|td|hr)\b[^>]*>")
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    for (page,) in rows:
        inner = re.search(r"<article>(.*?)</article>", page, re.S)
        if not inner or "<div" in inner[1] or "<aside" in inner[1] or "<form" in inner[1] or "<nav" in inner[1]:
            continue
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in blocks.split(re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner[1], flags=re.S))]
        assert html.extract(page) == "\n\n".join(x for x in parts if x)


def test_densities_against_the_definition():
    """Random trees: counts and densities of every node, from the tree itself."""
    rng = random.Random(3)

    def grow(depth):
        """A node: tag, parts (texts and nodes)."""
        parts = [x for _ in range(rng.randrange(1, 4)) for x in ([("".join(rng.choices("abc ", k=rng.randrange(1, 30))))] if depth > 3 or rng.random() < 0.5 else [("a", ["link text"[: rng.randrange(1, 9)]])] if rng.random() < 0.3 else [grow(depth + 1)])]
        parts = [x for i, x in enumerate(parts) if not i or not (isinstance(x, str) and isinstance(parts[i - 1], str))]
        return rng.choice(["div", "section", "h2"]) if depth else "div", parts

    def written(node):
        return f"<{node[0]}>" + "".join(x if isinstance(x, str) else written(x) for x in node[1]) + f"</{node[0]}>"

    def counts(node, out):
        c = t = lc = lt = 0
        place = len(out)
        if node[0] != "a":
            out.append(None)
        for x in node[1]:
            if isinstance(x, str):
                c += len(" ".join(x.split()))
            elif x[0] == "a":
                size = len(" ".join(x[1][0].split()))
                c, lc, t, lt = c + size, lc + size, t + 1, lt + 1
            else:
                a, b, d, e = counts(x, out)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        out[place] = (c, t, lc, lt)
        return out[place]

    for _ in range(200):
        node, out = grow(0), []
        total = counts(node, out)
        tree = html.parse(written(node))
        found = list(zip(tree.chars, tree.tags, tree.link_chars, tree.link_tags, strict=True))
        assert found[1:] == out and found[0] == (total[0], total[1] + 1, total[2], total[3])
        ratio = total[2] / max(1, total[0])
        for (c, tags, lc, lt), d in zip(out, html.densities(tree)[1:], strict=True):
            tags, lc, lt = max(tags, 1), max(lc, 1), max(lt, 1)
            want = c / tags * math.log(max(c / lc * tags / lt, 1.0) + 1e-9, math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)) if c else 0
            assert abs(d - want) < 1e-6 * max(1, abs(want))


# ---------------------------------------------------------------- nearest neighbours


def brute(ids, vectors, k):
    out = set()
    for i, q in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            s = (vectors * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out |= {(int(i), rank, int(ids[j])) for rank, j in enumerate(order, 1)}
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_VECTORS", 150)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 10)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    vectors = (centres[rng.integers(0, 12, 2000)] + 0.3 * rng.normal(size=(2000, 64))).astype(np.float32)
    vectors[100:140] = vectors[0]  # ties
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank string")
    got = neighbours.digest(rows).toPandas()
    want = brute(np.arange(2000), vectors.astype(float), 20)
    found = set(zip(got["query_id"], got["rank"], got["vec_id"], strict=True))
    assert len({(q, v) for q, _, v in found} & {(q, v) for q, _, v in want}) >= 0.9 * len(want) and len(got) == len(want)
    assert {x for x in found if x[0] == 0} == {x for x in want if x[0] == 0}
    s = [(vectors[q].astype(float) * vectors[v].astype(float)).sum() for q, v in zip(got["query_id"], got["vec_id"], strict=True)]
    assert np.allclose(got["score"], s, rtol=1e-12)


def test_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (40, [2.0, 0.0]), (40, [3.0, 0.0])]
    rows = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.digest(rows).collect())
    # Two rows share the id 40: each is a query without itself, and the other one is its candidate.
    assert got == sorted([(0, 1, 40), (0, 2, 40), (0, 3, 1), (0, 4, 1), (0, 5, 20), (20, 1, 1), (20, 2, 1), (20, 3, 0), (20, 4, 40), (20, 5, 40), *[(40, 1, 40), (40, 2, 0), (40, 3, 1), (40, 4, 1), (40, 5, 20)] * 2])
    assert neighbours.digest(rows.limit(0)).count() == 0


def test_chi_square_and_tree():
    assert abs(neighbours.chi_square(7.344, 8) - 0.5) < 1e-3 and abs(neighbours.chi_square(15.507, 8) - 0.95) < 1e-3
    assert abs(neighbours.quantile(0.95, 8) - 15.507) < 1e-3
    points = np.random.default_rng(1).normal(size=(1000, 8))
    tree = neighbours.KdTree(points)
    leaves = np.split(tree.order, np.cumsum(tree.sizes)[:-1])
    assert sorted(tree.order.tolist()) == list(range(1000)) and max(tree.sizes) <= neighbours.LEAF
    q = points[3] + 0.1
    for leaf, bound in zip(leaves, tree.distances(q), strict=True):
        assert bound <= ((points[leaf] - q) ** 2).sum(1).min() + 1e-9


@pytest.mark.parametrize("outlier", [False, True])
def test_the_stopping_test_spares_most_vectors(outlier):
    """Of 50,000 clustered vectors, few are verified, few parts are asked, and nearly all neighbours are found; a very long vector changes nothing."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 64))
    vectors = centres[rng.integers(0, 400, 50_000)] + 0.25 * rng.normal(size=(50_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if outlier:
        vectors[17] *= 10
    norm2 = (vectors * vectors).sum(1)
    band = np.ceil(np.log2(norm2) - 0.5).astype(int)
    bands = {b: ((band == b).sum(), norm2[band == b].max()) for b in np.unique(band).tolist()}
    router = neighbours.Router(bands, {b: neighbours.lifted(vectors[band == b][::5], r) for b, (_, r) in bands.items()})
    leaf = np.empty(len(vectors), np.int64)
    for b in bands:
        leaf[band == b] = router.leaf_of(b, neighbours.lifted(vectors[band == b], bands[b][1]))
    rows = [np.flatnonzero(leaf == i) for i in range(len(router.band))]
    router.counts = np.array([len(x) for x in rows])
    hits = verified = asked = 0
    queries = range(0, 50_000, 500)
    for i in queries:
        q = vectors[i]
        p = q @ neighbours.projection(64)[:-1]
        home, found, kth = router.home(p, 21), [], -np.inf
        for x in [home, *(y for y in router.within(p, q @ q, kth).tolist() if y != home)]:
            if x != home and x not in router.within(p, q @ q, kth):
                continue
            _, v, s, n = neighbours.search(vectors[rows[x]], q[None], router.r2[x], np.array([kth]), 21)
            found = sorted([*found, *zip(-s, rows[x][v], strict=True)])[:21]
            kth, verified, asked = -found[20][0] if len(found) > 20 else -np.inf, verified + n, asked + 1
        want = np.argsort(-(vectors @ q))[:21]
        hits += len({j for _, j in found} & set(want.tolist())) / 21
    assert hits / len(queries) >= 0.9
    assert verified / len(queries) < 0.1 * 50_000 and asked / len(queries) < 0.7 * len(rows) + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = neighbours.valid(rows).orderBy("vec_id").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    got = neighbours.digest(rows).toPandas()
    hits = n = 0
    for q, part in got.groupby("query_id"):
        s = vectors @ vectors[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -np.inf
        hits += len(set(part["vec_id"]) & set(ids[np.argsort(-s)[:20]].tolist()))
        n += 20
    assert n == 20 * (ids % 20 == 0).sum() and hits / n >= 0.9


# ---------------------------------------------------------------- segmentation


def test_samples_follow_the_lattice():
    pytest.importorskip("public_tokenizers")
    v = segmenting.vocabulary(None, 0.5)
    text, paths = "the cat", [((), 0.0)]
    for word in segmenting.words(text):
        edges = v.options(word)

        def ways(i, edges=edges, word=word):
            if i == len(word):
                yield (), 0.0
            else:
                for size, unit, weight in edges[i]:
                    first = v.unit_first.data[unit]
                    ids = tuple(v.ids.data[first : first + v.unit_many.data[unit]].tolist())
                    for p, w in ways(i + size):
                        yield ids + p, weight + w

        paths = [(a + p, b + w) for a, b in paths for p, w in ways(0)]
    total = sum(math.exp(w) for _, w in paths)
    first, estimate, n = Counter(), Counter(), 4000
    for seed in range(n):
        drawn = segmenting.sample(v, text, 4, seed * 7919 + 1)
        assert len({tuple(i) for i, _, _ in drawn}) == 4
        first[tuple(drawn[0][0])] += 1 / n
        for ids, log_probability, inclusion in drawn:
            estimate[tuple(ids)] += math.exp(log_probability) / inclusion / n
    for path, weight in paths:
        p = math.exp(weight) / total
        assert abs(first[path] - p) < 0.04 and abs(estimate[path] - p) < 0.04
    assert abs(sum(estimate.values()) - 1) < 0.02


def test_lattices_made_together_equal_those_made_alone():
    pytest.importorskip("public_tokenizers")
    together, alone = segmenting.vocabulary(None, 0.5), segmenting.Vocabulary(segmenting.vocabulary(None, 0.5).processor, 0.5)
    new = ["▁the", "▁tion", "▁été", "▁a", "▁", "▁▁", "▁日本x", "▁" + "ab" * 50, "▁x\u0001y", "▁Hello,", "▁\U0001f600", "▁ndner"]
    together.forget()
    together.learn(new)
    for w in new:
        alone.root(w)
        for i in range(len(w)):
            a, b = together.roots[w] + i, alone.roots[w] + i
            x, y = (slice(v.first.data[n], v.first.data[n] + v.many.data[n]) for v, n in ((together, a), (alone, b)))
            assert together.many.data[a] == alone.many.data[b]
            assert np.allclose(together.log.data[x], alone.log.data[y], atol=1e-9) and np.allclose(np.exp(together.rest.data[x]), np.exp(alone.rest.data[y]), atol=1e-9)
            ends = lambda v, part, root: [n - v.roots[w] if n >= 0 else None for n in v.next.data[part].tolist()]
            assert ends(together, x, a) == ends(alone, y, b)
            assert [together.ids.data[together.unit_first.data[u] : together.unit_first.data[u] + together.unit_many.data[u]].tolist() for u in together.unit.data[x]] == [alone.ids.data[alone.unit_first.data[u] : alone.unit_first.data[u] + alone.unit_many.data[u]].tolist() for u in alone.unit.data[y]]
    together.forget()


def test_segmentation_rows(spark):
    pytest.importorskip("public_tokenizers")
    texts = [None, "", "a", "Hello wörld  two", "日本 \U0001f600 x\n", "word " * 3000]
    rows = spark.createDataFrame([(i, 0, t, "x") for i, t in enumerate(texts)] + [(3, 0, texts[3], "x")], "conv_id long, turn int, text string, sample string")
    out = segmenting.decode(segmenting.encode(rows, ("conv_id", "turn"))).collect()
    for r in out:
        assert r["decoded"] == (texts[r["conv_id"]] or "") and 0 <= r["inclusion"] <= 1
    by = Counter(r["conv_id"] for r in out)
    assert by[0] == by[1] == 1 and by[3] == 8 and by[5] == 4
    twice = [r["ids"] for r in out if r["conv_id"] == 3 and r["sample"] == 1]
    assert twice[0] == twice[1]
    again = segmenting.digest(rows.repartition(2)).collect()
    assert sorted((r["conv_id"], r["sample"], r["ids_crc32"]) for r in again) == sorted((r["conv_id"], r["sample"], r["ids_crc32"]) for r in segmenting.digest(rows).collect())
    assert segmenting.digest(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- URL lists


@needs_data
def test_url_lists_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got, want = urls.digest(spark.read.parquet(f"{SF}/pages.parquet")).toPandas(), c.sql(urls.SQL).df()
    columns = sorted(got.columns)
    key = lambda d: sorted(repr([None if x != x else x for x in r]) for r in d[columns].astype(object).values.tolist())
    assert columns == sorted(want.columns) and key(got) == key(want)


def test_url_intervals(spark):
    d = lambda n: date(2024, 1, n)
    events = [("domain", "b.org", "add", d(5)), ("domain", "b.org", "add", d(7)), ("domain", "b.org", "remove", d(10)), ("domain", "b.org", "add", d(10)), ("domain", "b.org", "add", d(20)), ("host", "x.b.org", "add", d(1)), ("path", "c.org/p", "add", d(1)), ("domain", None, "add", d(1)), ("host", "c.org", "remove", d(1))]
    e = spark.createDataFrame(events, "kind string, entry string, action string, at date")
    assert sorted((r["entry"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in urls.intervals(e).collect()) == [("b.org", 5, 10), ("b.org", 20, None), ("c.org/p", 1, None), ("x.b.org", 1, None)]
    asked = [(1, "http://X.b.org:80/q", d(4)), (2, "http://x.b.org/q", d(5)), (3, "https://u@b.org", d(10)), (4, "http://b.org", d(20)), (5, "http://c.org/p/q?x", d(2)), (6, "http://c.org/pq", d(2)), (7, None, d(2)), (8, "nonsense", d(2)), (9, "http://b.org", None), (4, "http://b.org", d(20)), (10, "http://ab.org/", d(6))]
    captures = spark.createDataFrame([(*r, "x") for r in asked], "page_id long, url string, fetched_at date, entry string")
    got = sorted((r["page_id"], r["n_active"], r["entry"]) for r in urls.as_of(captures, e).collect())
    assert got == [(1, 1, "host:x.b.org"), (2, 2, "host:x.b.org"), (3, 0, None), (4, 1, "domain:b.org"), (4, 1, "domain:b.org"), (5, 1, "path:c.org/p"), (6, 0, None), (7, 0, None), (8, 0, None), (9, 0, None), (10, 0, None)]
    assert urls.as_of(captures, e.limit(0)).filter("blocked").count() == 0 and urls.as_of(captures.limit(0), e).count() == 0
    assert urls.as_of(captures.withColumn("x", F.lit(1)), e).filter("x = 1").count() == 11


def test_hot_keys_are_dealt_over_parts(spark):
    """A host with most captures gives the same result in parts as in one."""
    rows = [(i, "http://hot.org/a" if i % 3 else f"http://h{i % 7}.org/p/{i}", date(2024, 1, 1 + i % 28)) for i in range(900)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at date")
    events = spark.createDataFrame([("domain", "hot.org", "add", date(2024, 1, 5)), ("host", "h1.org", "add", date(2024, 1, 1)), ("path", "h2.org/p", "add", date(2024, 1, 3))], "kind string, entry string, action string, at date")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(urls.as_of(captures, events, part_rows=3)) == key(urls.as_of(captures, events))
    long = spark.createDataFrame([(1, "http://a.org/" + "x/" * 3000, date(2024, 2, 1))], "page_id long, url string, fetched_at date")
    assert urls.as_of(long, events).count() == 1
