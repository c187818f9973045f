"""Each stage of the pipeline against a plain version, on the smallest tables."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
words = lambda t, lower=False: WORD.findall((t or "").encode().lower() if lower else (t or "").encode())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.digest(docs).filter("kept").collect()}
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    whole, good, lang, near, cut, packed = seen
    assert set(good["doc_id"]) == kept and len(good) < len(whole)
    assert set(lang["doc_id"]) <= set(good["doc_id"]) and len(lang) > 0.95 * len(good)

    sets = {}
    for i, t in zip(lang["doc_id"], lang["text"], strict=True):
        w = words(t, True)
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert sorted(near["doc_id"]) == sorted(i for i in ids if label[i] == i)

    first = {}
    texts = {i: words(t) for i, t in zip(near["doc_id"], near["text"], strict=True)}
    for i, w in texts.items():
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(first.get(tuple(w[p : p + 50]), i), i)
    want = {}
    for i, w in texts.items():
        gone = {j for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for j in range(p, p + 50)}
        rest = [x for j, x in enumerate(w) if j not in gone]
        if rest or not gone:
            want[i] = rest
    assert {i: words(t) for i, t in zip(cut["doc_id"], cut["text"], strict=True)} == want

    assert set(packed["doc_id"]) == set(cut["doc_id"])
    order = packed.sort_values(["sequence_id", "offset"])
    assert (order["offset"] == order.groupby("sequence_id")["length"].cumsum() - order["length"]).all()
    assert packed["sequence_id"].nunique() <= 1.02 * packed["length"].sum() / 2048 + 1


def test_odd_documents(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text + " more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert Counter(docs.toPandas()["doc_id"].fillna(-1)).keys() == {-1, 3}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_clashing_columns_and_unlearned_languages(spark, monkeypatch):
    """Columns that are named like those which operators add come through all stages; a text in no learned language goes."""
    monkeypatch.setattr("strataq.llm.windows.BLOCK_BYTES", 4_000)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["block", "n_words", "n_removed", "kept_text", "kept_sha256", "score", "held_out", "lang_pred", "row", "component_id", "length"]
    strange = spark.createDataFrame([(10**9, "zxqj wvkq qzzx jxwv kqxz vwxj qxzk zzkq xwvj qjkz " * 30, None, "s", 1500)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = source.unionByName(strange)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        assert docs.columns == [*source.columns, *names]
        rows = docs.collect()
        assert rows and all(r[n] == f"{i}:{r['doc_id']}" for r in rows for i, n in enumerate(names)), name
        if name == "language_id":
            assert 10**9 not in {r["doc_id"] for r in rows}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(rows)


def test_empty_and_odd_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "one two", "en", "s", 7, 3), (2, "one two", "en", "s", 7, 3)], schema)
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == rows.columns
            stage(spark, rows, SF).collect()
        corpus_pipeline.best_fit_packing(spark, rows, SF).collect()
