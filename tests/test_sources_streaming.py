import pytest
from pyspark.sql import functions as F

from strataq.operators import intervals
from strataq.sources import readers
from strataq.sources.repository import Repository, StaleError
from strataq.streaming import leases

CHANGE = "key string, op string, oid string"


def content(df):
    return {r["key"]: r["oid"] for r in df.collect()}


def test_repository(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"))
    change = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    repo.transact(change(("a", "put", "1"), ("b", "put", "1")))
    repo.snapshot("r1")
    repo.transact(change(("a", "delete", None), ("b", "put", "2")))
    assert content(repo.read()) == {"b": "2"} and content(repo.read(revision="r1")) == {"a": "1", "b": "1"}
    with pytest.raises(StaleError):
        repo.transact(change(("c", "put", "1")), expected=1)
    for bad in (change(("x", "delete", None)), change(("c", "put", "1"), ("c", "put", "2")), change(("c", "put", None))):
        with pytest.raises(ValueError):
            repo.transact(bad)
    repo.fork("r1", "side")
    repo.transact(change(("c", "put", "3")), world="side")
    assert content(repo.read("side")) == {"a": "1", "b": "1", "c": "3"} and repo.worlds() == ["main", "side"]
    repo.restore("r1", "before-restore")
    assert content(repo.read()) == {"a": "1", "b": "1"} and content(repo.read(revision="before-restore")) == {"b": "2"}
    repo.compact("side")
    assert content(repo.read("side")) == {"a": "1", "b": "1", "c": "3"} and len(repo.manifest("side")) == 1
    assert repo.collect_garbage() > 0 and repo.collect_garbage() == 0
    repo.drop_world("side")
    repo.forget_revision("before-restore")
    assert repo.worlds() == ["main"] and repo.revisions() == ["r1"] and content(repo.read()) == {"a": "1", "b": "1"}
    with pytest.raises(ValueError):
        repo.drop_world("main")


def test_readers(spark, tmp_path):
    (tmp_path / "tree/skip").mkdir(parents=True)
    (tmp_path / "tree/a.bin").write_bytes(b"abc")
    (tmp_path / "tree/skip/b.bin").write_bytes(b"x")
    found = readers.tree(spark, str(tmp_path / "tree"), prune=["skip"]).collect()
    assert [(r["size"], r["path"].endswith("a.bin")) for r in found] == [(3, True)]
    put = lambda k, v: b"\x01" + len(k).to_bytes(4, "little") + k + len(v).to_bytes(4, "little") + v
    (tmp_path / "batch").write_bytes((2).to_bytes(4, "little") + put(b"k", b"v") + b"\x02" + (1).to_bytes(4, "little") + b"z")
    got = [(r["ordinal"], r["op"], r["key"], r["value"] and bytes(r["value"])) for r in readers.batches(spark, str(tmp_path / "batch")).collect()]
    assert got == [(0, "put", "k", b"v"), (1, "delete", "z", None)]
    (tmp_path / "m.txt").write_text("ab\t3\tx/y\nnonsense\ncd\tq\tz\n")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.txt")).collect()] == [("ab", 3, "x/y")]
    (tmp_path / "s.json").write_text('{"workload": "w", "side": "a", "sample": 1, "elapsed_ns": 5}\n')
    assert readers.samples(spark, str(tmp_path / "s.json")).first()["elapsed_ns"] == 5


def test_streamed_leases_equal_batch(spark, tmp_path):
    hour = 3_600_000_000
    rows = [(u, (u * 7 + i * i * 11 + i * 50) % 200 * hour // 10) for u in (1, 2) for i in range(12)]
    frame = spark.createDataFrame(sorted(set(rows), key=lambda r: r[1]), "user_id long, at long").select("user_id", F.timestamp_micros("at").alias("ts"))
    last = spark.createDataFrame([(9, 10_000 * hour)], "user_id long, at long").select("user_id", F.timestamp_micros("at").alias("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in/one"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = leases.lease_sessions(stream, hour).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        last.coalesce(1).write.parquet(str(tmp_path / "in/two"))
        query.processAllAvailable()
        query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT user_id, started, last_seen, n FROM sessions WHERE user_id <> 9").collect())
    finally:
        query.stop()
    batch = intervals.leases(frame.select("user_id", F.unix_micros("ts").alias("at")).withColumn("tie", F.lit(0)), "user_id", "at", "tie", hour)
    assert got == sorted(tuple(r) for r in batch.select("user_id", "started", "last_seen", "n").collect())


def test_repository_limits_and_points(spark, tmp_path, monkeypatch):
    from strataq.sources import repository

    monkeypatch.setattr(repository, "POINT_COMMITS", 3)
    repo = repository.Repository(spark, str(tmp_path / "repo"))
    rows = lambda *x: spark.createDataFrame(list(x), "key string, op string, oid string")
    repo.init("volume")
    for i in range(7):
        repo.transact(rows((f"k{i}", "put", "1")))
    assert repo.volume_name() == "volume" and repo.state().sequence == 8
    names = sorted(p.name for p in (tmp_path / "repo" / "log").glob("point-*.json"))
    assert names == [f"point-{n:020d}.json" for n in (3, 6)]
    for old in (tmp_path / "repo" / "log").glob("0*.json"):  # a reader needs none of the commits before a point
        if int(old.stem) <= 6:
            old.unlink()
    assert repo.read().count() == 7
    for bad in (rows(), rows(*((f"n{i}", "put", "1") for i in range(4097)))):
        with pytest.raises(ValueError):
            repo.transact(bad)
    repo.snapshot("r1")
    repo.fork("r1", "side")
    token = repo.discard_plan("side")
    repo.transact(rows(("z", "put", "1")))
    with pytest.raises(repository.StaleError):
        repo.drop_world("side", token)
    repo.drop_world("side", repo.discard_plan("side"))
    assert not repo.needs_compaction()


def test_journal_and_samples(spark, tmp_path):
    from strataq.operators import views
    from strataq.sources import journal

    j = journal.Journal(spark, str(tmp_path / "journal"))
    assert j.sequence() == 0 and j.replay().count() == 0
    j.put("a", "1")
    j.transact([("a", "delete", None), ("b", "put", "2")])
    (tmp_path / "journal" / f"{3:020d}.prepare").write_text("{\"sequence\": 3, ")  # a writer that ended before its commit
    assert j.replay().count() == 3
    j.transact([("c", "put", "3")])
    assert sorted((r["key"], r["oid"]) for r in views.newest_wins(j.replay()).collect()) == [("b", "2"), ("c", "3")]
    for bad in ([], [("x", "put", "1")] * 2, [("x", "put", None)], [(str(i), "put", "1") for i in range(65)], [("x", "put", "y" * (1 << 20))]):
        with pytest.raises(ValueError):
            j.transact(bad)
    (tmp_path / "journal" / f"{2:020d}.commit").write_text("other\n")
    with pytest.raises(Exception):  # noqa: B017, PT011  (the file system may notice it first)
        j.replay()
    samples = spark.createDataFrame([("w", float(i)) for i in range(1200)] + [("v", 1.0)], "workload string, ms double")
    got = {r["workload"]: (r["n"], r["p50"], r["p95"]) for r in journal.write_samples(samples, str(tmp_path / "out"), ["workload"], "ms").collect()}
    assert got == {"w": (1200, 599.0, 1139.0), "v": (1, 1.0, None)}
    assert spark.read.json(str(tmp_path / "out" / "samples")).count() == 1201


def test_handles_open_and_close(spark):
    from strataq.operators import handles

    first = spark.createDataFrame([], "handle string, inode_id string, owner string, append boolean, position long")
    both = handles.opened(first, spark.createDataFrame([("h1", "i", "o", False), ("h2", "i", "o", True)], "handle string, inode_id string, owner string, append boolean"))
    assert handles.closed(both, both.filter("handle = 'h1'")).count() == 1
