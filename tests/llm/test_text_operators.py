"""Operators on ``documents``: against SQL, brute force, and odd input."""

import bisect
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import components, jaccard, langid, mixing, packing, quality, substrings, windows

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, one long text, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(None, "a text without an id of its own here", None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \t\n", "en", None, 3), (4, "one", "en", "s", 3), (5, long, "en", "s", 1), (5, long, "en", "s", 1), (6, long, "de", "s", 1), (7, "ÀÉ  x y\x1cz ### 12", "fr", "s", 9), (8, "123 456 !!", "en", "s", 1)]
    extra = ", block int, row string, words string, length string, score string, lang_pred string, kept string, n_words string, rank string, member string"
    return spark.createDataFrame([(*r, 1, *["x"] * 9) for r in rows], DOC + extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def sql_rows(sql):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c.sql(sql).df()


def same(frame, want):
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    key = lambda d: sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in d[columns].astype(object).values.tolist())
    assert key(frame) == key(want)


@needs_data
@pytest.mark.parametrize("module", [quality, substrings, jaccard])
def test_against_sql(spark, module):
    same(module.digest(spark.read.parquet(f"{SF}/documents.parquet")).toPandas(), sql_rows(module.SQL))


# ---------------------------------------------------------------- quality rules


def test_quality_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in quality.digest(odd).collect()}
    assert quality.digest(odd).count() == 10 and quality.digest(empty).count() == 0
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[7]["n_words"] == 4 and got[7]["n_symbols"] == 3 and got[5]["n_repeat_words"] == 30_000
    kept = quality.filtered(odd, "v1")
    assert kept.columns == odd.columns and kept.count() == 0


def test_quality_repeats_and_ablations(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 60))) + rng.choice(["", "\nx\nx\nx", " ###", " A B C!"]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.ledger(docs).cache()
    for r in rows.collect():
        w = words(texts[r["doc_id"]])
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert r["n_repeat_words"] == len(hit) and r["n_words"] == len(w)
    masks = [r["failed_bits"] for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        policy, bit = quality.POLICIES[r["policy"]], quality.BITS[r["rule"]]
        assert r["rejected"] == sum(bool(m & policy) for m in masks)
        assert r["failing"] == sum(bool(m & bit) for m in masks)
        assert r["only_this_rule"] == sum(m & policy == bit for m in masks)


@needs_data
def test_quality_filter_stays_above(spark, capsys):
    """The measurements are computed once, below the filter on the bits, and not again inside of it."""
    quality.filtered(spark.read.parquet(f"{SF}/documents.parquet")).explain("simple")
    plan = capsys.readouterr().out
    lines = [x for x in plan.splitlines() if "Filter" in x]
    assert lines and all("regexp_replace" not in x and "transform" not in x for x in lines)


@needs_data
def test_ablations_against_sql(spark):
    same(quality.ablations(quality.ledger(spark.read.parquet(f"{SF}/documents.parquet"))).toPandas(), sql_rows(quality.ABLATIONS_SQL))


# ---------------------------------------------------------------- language identification


def test_network_against_loops():
    """Probabilities of a window by the definition: every filter at every place, the maximum, the last layer."""
    rng = np.random.default_rng(8)
    windows_ = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    net = langid.train(windows_, np.array([0, 1, 2]), ["a", "b", "c"], epochs=1)
    got = net.probabilities(windows_)
    for w, p in zip(windows_, got, strict=True):
        pooled = []
        for f in range(net.filters.shape[1]):
            width = langid.WIDTHS[f // langid.FILTERS]
            places = [sum(float(net.embedding[w[i + k], d]) * float(net.filters[k * langid.DIM + d, f]) for k in range(width) for d in range(langid.DIM)) for i in range(langid.WINDOW - max(langid.WIDTHS) + 1)]
            pooled.append(max(max(places) + float(net.bias[f]), 0.0))
        z = np.array(pooled) @ net.output + net.offset
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(p, want, atol=1e-4)
        assert not net.filters[width * langid.DIM :, f].any()


# ---------------------------------------------------------------- packing


def plain_best_fit(lengths, capacity):
    """Best fit decreasing, one document after the other."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - x)
    return len(rooms)


def lengths_of(kind, n, capacity, rng):
    small, third = max(2, capacity // 25), max(2, capacity // 3)
    made = {"even": rng.integers(1, capacity + 1, n), "small": rng.integers(1, small, n), "thirds": rng.integers(third - third // 8, third + third // 6 + 1, n), "two kinds": np.concatenate([rng.integers(1, small, n // 2), rng.integers(capacity // 2 - 1, 2 * capacity // 3, n - n // 2)]), "one": np.full(n, 3)}
    return np.clip(made[kind], 1, capacity)


@pytest.mark.parametrize(("kind", "n", "capacity"), [("even", 3000, 2048), ("small", 5000, 2048), ("thirds", 2000, 2048), ("two kinds", 3000, 2000), ("one", 900, 64), ("even", 40, 10)])
def test_rounds_equal_plain_best_fit(spark, kind, n, capacity):
    """Gapless sequences within the capacity, as many as plain best fit needs, and no document lost."""
    lengths = lengths_of(kind, n, capacity, np.random.default_rng(n))
    rows = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(lengths)], "doc_id long, piece int, length long")
    got = packing.pack(rows, capacity).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(zip(got["doc_id"], got["length"], strict=True)) == sorted(enumerate(lengths.tolist()))
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= capacity
    assert got["sequence_id"].nunique() == plain_best_fit(lengths.tolist(), capacity)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 60), st.lists(st.integers(1, 60), max_size=100), st.lists(st.tuples(st.integers(1, 60), st.integers(1, 5)), max_size=20))
def test_sweep_is_best_fit(capacity, lengths, gaps):
    """A range's sweep places what plain best fit places into the same gaps, and loses no room."""
    counts, start, runs, rooms = Counter(lengths), 0, [], []
    for room, n in gaps:
        runs.append((room, start, n, 0))
        rooms += [room] * n
        start += n
    placed, over, left = packing.sweep([(x, 0, n) for x, n in counts.items()], runs)
    rooms.sort()
    missed = Counter()
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        if at == len(rooms):
            missed[x] += 1
        else:
            bisect.insort(rooms, rooms.pop(at) - x)
    assert Counter({x: n for x, _, n in over}) == missed
    assert sum((last - first) * x for x, first, last, *_ in placed) + sum(r * n for r, _, n, _ in left) == sum(r * n for r, n in gaps)
    assert sorted(r for r, _, n, _ in left for _ in range(n)) == [r for r in rooms if r]


def test_packing_odd(spark, odd, empty):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.digest(odd).toPandas()
    want = Counter()
    for r in odd.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for i, at in enumerate(range(0, len(ids), 4 * 2048)):
            part = ids[at : at + 4 * 2048]
            want[r["doc_id"], i, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    order = got.sort_values(["sequence_id", "offset"])
    assert (order["offset"] == order.groupby("sequence_id")["length"].cumsum() - order["length"]).all()
    assert order.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packing.digest(empty).count() == 0
    assert packing.pieces(odd, with_ids=True).filter("octet_length(ids) <> 4 * length").count() == 0


def test_plain_words_equal_the_tokenizer():
    pytest.importorskip("public_tokenizers")
    w = packing._words(None)
    for x in ["Hello,", "l'été", "don't", "<|endoftext|>", "a1b22", "ÀÖß÷×", "x" * 70, "%%%&amp;", "İstanbul", "ſ", "été.", "Ñandú,", "Straße", "ÀB", "a.b", ".", ",", "x.,", "ª.", "don't.", "×.", "é", "日本", "»«", "µ²½"]:
        assert w[x.encode()] == np.array(w.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


# ---------------------------------------------------------------- substring dedup


def test_cover_meets_every_shift():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def removed(docs, width):
    first = {}
    for i, w in docs:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 64, 120, 49)]
    base = fresh(150)
    docs = []
    for i in range(70):
        w = fresh(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + fresh(rng.randrange(0, 20))
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = fresh(1)[0]
        docs.append((1000 - 7 * i, rng.choice([" ", "  ", "\n"]).join(w)))
    return docs + docs[:3]


@pytest.mark.parametrize("n", [1, 10, 40, 160])
def test_exchange_has_no_cell_for_each_pair(spark, n):
    """Each bucket hears every block and answers each; the packs grow with the root of the number of blocks, not with the number."""
    blocks = spark.range(n).selectExpr("cast(id as int) AS block")

    def first(key, table):
        return windows.cell_table((k, key[0].as_py(), f"{key[0].as_py()}>{k}".encode()) for k in range(n))

    def merge(table):
        k = table["bucket"][0].as_py()
        assert sorted(d.as_py() for d in table["data"]) == sorted(f"{b}>{k}".encode() for b in range(n))
        return windows.cell_table((k, b, f"{k}<{b}".encode()) for b in table["block"].to_pylist())

    answers = windows.exchange(blocks.groupBy("block").applyInArrow, first, merge, n).toArrow()
    root = int(np.ceil(np.sqrt(n)))
    assert answers.num_rows <= n * (n // root + 1)
    for b in range(0, n, 7):
        mine = windows.received(answers.filter(pc.equal(answers["block"], b)))
        assert sorted(mine) == [(k, f"{k}<{b}".encode()) for k in range(n)]


def test_substrings_against_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr("strataq.llm.windows.blocks_for", lambda b, n, size=0: 5)
    got = substrings.dedup(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == removed([(i, words(t)) for i, t in copies], 50)
    for r in got:  # the cut text holds exactly the kept words
        assert hashlib.sha256(b" ".join(words(r["kept_text"]))).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or r["kept_text"] == r["text"]


def test_substrings_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in substrings.dedup(odd).collect()}
    assert got[5]["n_removed"] == 0 and got[6]["n_removed"] == 30_000 and got[6]["kept_text"].strip() == "" and got[None]["n_removed"] == 0
    assert substrings.dedup(odd).count() == 10 and substrings.dedup(empty).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_tasks_of_rounds(spark):
    """Few links need no rounds and few lengths no task for each shuffle partition, even where nothing joins small ones."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}

    def tasks(group, run):
        spark.sparkContext.setJobGroup(group, group)
        try:
            run()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))

    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
        assert tasks("links", lambda: components.components(edges).collect()) < 200
        lengths = spark.createDataFrame([(n, 1 + n % 3) for n in range(1, 2049, 7)], "length long, count long")
        assert tasks("lengths", lambda: packing.best_fit(lengths).collect()) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("links", [7, 100, 10**6])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(components, "TASK_LINKS", links)  # many small parts, a few, and one
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def classes(docs):
    sets = {}
    for i, text in docs:
        w = words(text, lower=True)
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    label = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_tasks_of_the_join(spark, monkeypatch):
    """Ids of sets are few beside the texts: no task for each shuffle partition and each time that they are looked up."""
    monkeypatch.setattr(jaccard, "CHUNK", 6)
    chain, docs = [f"c{i}" for i in range(60)], []
    for i in range(40):
        chain = [*chain[:i], f"d{i}", *chain[i + 1 :]]
        docs.append((i, " ".join(chain)))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("join", "join")
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: label for i, (_, label) in classes(docs).items()}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("join") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))
    assert tasks < 1200


def test_shuffles_of_the_join(spark, monkeypatch):
    """Shingles are shuffled once to find candidates' and once to verify them, also where a component is large, and not again for each lookup."""
    monkeypatch.setattr(jaccard, "CHUNK", 6)
    docs = []
    for family, copies_ in enumerate([12, *[2] * 60]):
        text = [f"f{family}w{p}" for p in range(400)]
        docs += [" ".join([*text[: 30 * c + 9], f"new{family}n{c}", *text[30 * c + 10 :]]) for c in range(copies_)]
    docs = list(enumerate(docs))

    def written(group, run):
        spark.sparkContext.setJobGroup(group, group)
        try:
            out = run()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
        context.listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
        return out, sum(context.statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)

    sets = jaccard.stored(jaccard.shingle_sets(spark.createDataFrame(docs, "doc_id long, text string")), "test-sets")
    names = jaccard.checkpointed(jaccard.named(sets))
    _, once = written("once", lambda: sets.select("s1", "tokens").repartition(4, "s1").write.format("noop").mode("overwrite").save())
    found, all_ = written("links", lambda: components.components(jaccard.links(sets, names)).collect())
    label = {r["node"]: r["component"] for r in found}
    assert {i: label[i] for i, _ in docs} == {i: c for i, (_, c) in classes(docs).items()}
    assert once > 100_000 and all_ < 2 * once, (all_, once)


@pytest.mark.parametrize("chunk", [512, 6])
def test_jaccard_against_brute_force(spark, copies, monkeypatch, chunk):
    monkeypatch.setattr("strataq.llm.windows.blocks_for", lambda b, n, size=0: 4)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)  # 6: components are verified in several tasks
    rng = random.Random(4)
    chain = [f"c{i}" for i in range(60)]
    docs = copies[:-3]
    for i in range(25):
        chain = list(chain)
        chain[rng.randrange(60)] = f"d{i}"
        docs = [*docs, (5000 + i, " ".join(chain).upper() if i % 2 else " ".join(chain))]
    docs = [*docs, (6000, "a b c"), (6001, "A B  C"), (6002, "a b"), (6003, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes(docs)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80))).astype(np.uint64) for _ in range(23)]
    got = jaccard.intersections(sets[:9], sets[9:], columns=16)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[9:]] for a in sets[:9]]).all()


def test_jaccard_odd(spark, odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.digest(odd).collect()), key=repr)
    by = {g[0]: g for g in got}
    assert len(got) == 10 and by[6][2] == 5 and by[1] == (1, 0, 1) and by[None][2] is None and by[4] == (4, 1, 4)
    assert jaccard.digest(empty).count() == 0


# ---------------------------------------------------------------- language ID


@needs_data
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got["held_out"]]
    assert len(out) > 100 and (out["lang"] == out["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in langid.digest(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == got[8]["lang_pred"] == "und" and got[8]["score"] == 0
    assert got[5]["lang_pred"] in ("en", "de", "fr") and langid.digest(empty).count() == 0
    assert langid.predict(odd.filter("doc_id = 4"), None).first()["lang_pred"] == "und"


def test_every_language_is_learned(spark):
    rows = [(i, f"some words {i % 210}", f"l{i % 210:03d}") for i in range(420)]
    net = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(net.languages) == 210


# ---------------------------------------------------------------- LM scoring


def test_mixing_is_a_distribution():
    """Whatever the tables hold, the chances of all next symbols add up to one."""
    rng = np.random.default_rng(3)
    tables = mixing.Tables()
    tables.two[:] = rng.integers(-60, 60, tables.two.shape)
    tables.four, tables.row = rng.integers(-60, 60, (64, 32)).astype(np.int8), rng.integers(0, 64, 1 << 20).astype(np.int32)
    tables.seen[:] = rng.integers(0, 3, len(tables.seen))
    totals, slots = rng.integers(0, 400, (1 << 12, 32)), rng.normal(size=1 << mixing.SLOT_BITS).astype(np.float32)
    before = mixing.symbols("some lengthy words are here again")[:-1]

    def cost(tail):
        s = mixing.Symbols([np.concatenate([before, tail]).astype(np.uint8)])
        at, code = s.words()
        logit, state = np.zeros((len(s.sym), 8), np.int8), np.zeros(len(s.sym), np.int32)
        for i, c in zip(at, code, strict=True):
            if s.rank[i] >= mixing.REACH:
                row = mixing.small(mixing.decisions((c & ~np.uint64(31)) + np.arange(32, dtype=np.uint64), totals[int(c >> np.uint64(5)) % len(totals)]))[:, int(c) & 31]
                logit[i, :5], state[i] = np.rint(mixing._LOGS[row[:5]] - mixing._LOGS[row[5:]]), 2
        mixer = mixing.Mixer(tables)
        mixer.slots = slots.copy()
        return mixer._group(s, s.first[:1], s.sizes, np.zeros(1, bool), logit.view(np.uint64).ravel(), state)[0]

    costs = np.array([cost([symbol]) for symbol in range(32)])
    assert abs(sum(2.0 ** -(costs - cost([]))) - 1) < 1e-3


def test_symbols_are_reversible():
    for text in ("Hello, wörld. 12", "", "日本\n x"):
        s = mixing.symbols(text).tolist()
        back, i, code = bytearray(), 0, {int(mixing._CODE[b]): b for b in range(256) if mixing._CODE[b] != mixing.ESCAPE}
        while s[i] != mixing.END:
            if s[i] == mixing.ESCAPE:
                back.append(s[i + 1] << 4 | s[i + 2])
                i += 3
            else:
                back.append(code[s[i]])
                i += 1
        assert bytes(back).split() == words(text, lower=True)


def test_scores_against_brute_force(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100 + i, f"the cat number {i} sat on the mat {i * 37 % 11}", "en") for i in range(80)], "doc_id long, text string, lang string"))
    rows = docs.collect()
    trains = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter()
    for r in rows:
        if trains(r["doc_id"]):
            counts.update([*words(r["text"], True), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = [*words(r["text"], True), None]
        want.append((r["doc_id"], r["doc_id"] is not None and not trains(r["doc_id"]), len(t), sum(x in counts for x in t), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)))
    first = mixing.digest(docs).toPandas()
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in first.itertuples()]
    key = lambda rows: sorted(repr([float(x) if isinstance(x, (float, np.floating)) else x if x is None else int(x) for x in r]) for r in rows)
    assert key(got) == key(want)
    assert (first["score"] < 0).all() and np.isfinite(first["score"]).all()
    again = mixing.digest(docs.repartition(3)).toPandas()
    assert np.allclose(sorted(first["score"]), sorted(again["score"]), rtol=1e-6)
    assert mixing.digest(empty).count() == 0


def test_scores_are_those_of_the_plain_model(spark, odd, monkeypatch):
    """The query scores outside Python, and as ``Words`` and ``Mixer`` say: odd texts, equal ones, and some of several lanes, over several blocks."""
    monkeypatch.setattr(mixing, "TEXT_BYTES", 1 << 16)
    rng = np.random.default_rng(7)
    made = ["".join(rng.choice(list("abcdeeeeiot   .,XÉ7\t"), 1 + i % 97 * (150 if i % 10 == 0 else 5))) for i in range(150)]
    rows = [*((1000 + i, f"{t} lengthier words{i % 7} lengthily {t[:300]}") for i, t in enumerate(made)), (None, None), (1, "again again again again" * 70), (2, "again again again again" * 70), (3, None), (3, "")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = mixing.digest(docs)
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    blocks, n = windows.by_block(docs, "doc_id", "text", block_bytes=mixing.TEXT_BYTES)
    assert n > 3
    found = {}
    for r in blocks.collect():
        found.setdefault(r["block"], []).append((r["doc_id"], r["text"]))
    none_last = lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode())
    found = {b: sorted(rows, key=none_last) for b, rows in found.items()}
    texts = {b: (mixing.Symbols([mixing.symbols(t) for _, t in rows]), np.array([mixing._trains(i) for i, _ in rows])) for b, rows in found.items()}
    sent = [cell for b, t in texts.items() for cell in mixing.send(b, n, *mixing.counted(*t))]
    answers = {}
    for bucket in {c[0] for c in sent}:
        out = mixing._code_totals(mixing.cell_table([c for c in sent if c[0] == bucket]))
        for k, b, d in zip(*(out[c].to_pylist() for c in ("bucket", "block", "data")), strict=True):
            answers.setdefault(b, {})[k] = d
    counts = Counter()
    for t in texts.values():
        for code, k in zip(*(x.tolist() for x in mixing.short_counts(*t)), strict=True):
            counts[code] += k
    tables = mixing.Tables()
    for nearest in range(32):
        mine = sorted(c for c in counts if c >> 5 & 31 == nearest)
        tables.put(nearest, mixing.tables_part(np.array([c >> 10 << 5 | c & 31 for c in mine], np.int64), np.array([counts[c] for c in mine], np.int64)))
    want = []
    for b, (s, learned) in texts.items():
        words_ = mixing.Words(s, learned, n, answers[b])
        costs = mixing.Mixer(tables).costs(s, learned, *words_.predict())
        want += [(repr(i), len((t or "").encode()), int(k), -c * np.log10(2)) for (i, t), k, c in zip(found[b], words_.base()[0], costs, strict=True)]
    got = [(repr(r["doc_id"]), r["n_bytes"], r["n_tokens"] - 1, r["score"]) for r in got.collect()]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(want)], rtol=1e-5)


def test_words_so_far_of_a_large_corpus_stay_apart():
    """The exchanged totals equal brute-force counts by exact context, with far more contexts than 2^18; a text's own are left out."""
    rng = np.random.default_rng(5)
    blocks = 3
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8)
    texts = [letters[rng.integers(0, 31, 400_000)].tobytes().decode() for _ in range(blocks)]
    made = [mixing.Symbols([mixing.symbols(t)]) for t in texts]
    learned = [np.array([b != 1]) for b in range(blocks)]
    sent = [cell for b, s in enumerate(made) for cell in mixing.send(b, blocks, *mixing.counted(s, learned[b]))]
    answers = {}
    for bucket in {c[0] for c in sent}:
        out = mixing._code_totals(mixing.cell_table([c for c in sent if c[0] == bucket]))
        answers.update({(b, k): d for k, b, d in zip(*(out[c].to_pylist() for c in ("bucket", "block", "data")), strict=True)})
    seen = [Counter(), Counter(), Counter()]
    prefixes = []
    for b, s in enumerate(made):
        prefix, mine = (), []
        for x in s.sym.tolist():
            mine.append(prefix)
            if len(prefix) >= mixing.REACH:
                seen[b].update((prefix, x >> k, k) for k in range(6))
            prefix = () if x == mixing.SPACE else (*prefix, x)
        prefixes.append(mine)
    assert sum(len({p for p, _, k in c if k == 5}) for c in seen) > 1 << 18
    for b in (0, 1):
        others = [c for i, c in enumerate(seen) if i != b and i != 1]
        words = mixing.Words(made[b], learned[b], blocks, {k: d for (x, k), d in answers.items() if x == b})
        logit, state = words.predict()
        logit = logit.view(np.int8).reshape(-1, 8)[:, :5]
        for i in rng.integers(0, len(made[b].sym), 3000):
            prefix, x = prefixes[b][i], int(made[b].sym[i])
            if len(prefix) < mixing.REACH:
                assert state[i] == 0
                continue
            n = [sum(c[prefix, x >> k, k] for c in others) for k in (5, 4, 3, 2, 1, 0)]
            assert state[i] == 1 + (n[0] > 0) + (n[0] > 3)
            same, other = np.array(n[1:], np.float32), np.array(n[:-1], np.float32) - np.array(n[1:], np.float32)
            want = np.clip(mixing.UNIT * np.log((same + mixing.PRIOR) / (other + mixing.PRIOR)), -127, 127)
            assert np.abs(logit[i] - want).max() < (1 if n[0] < 100 else 4)


@needs_data
def test_held_out_scores_pass_the_base(spark):
    """On a thousand documents the mean of the held-out scores is above that of the base, which does not even spell unknown words."""
    got = mixing.digest(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).filter("held_out").toPandas()
    assert got["score"].mean() > got["base_score"].mean()
