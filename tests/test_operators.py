import random

import pytest
from pyspark.sql import functions as F

from strataq.functions import scalars
from strataq.operators import audit, capture, content, diff, graph, handles, history, intervals, merge, mutations, pages, rollup, views

REV = "key string, oid string, meta string"


def collect(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def versions(spark, seed=17, n=60):
    rng = random.Random(seed)
    base = {f"k{i:03d}": (f"o{rng.randrange(5)}", "m") for i in range(n)}
    other = {k: (f"o{rng.randrange(5)}", v[1]) if rng.random() < 0.3 else v for k, v in base.items() if rng.random() > 0.2}
    other |= {f"n{i}": ("o9", "m") for i in range(5)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], REV)
    return base, other, frame(base), frame(other)


def test_diff_matches_model_and_pages_concatenate(spark):
    base, other, b, a = versions(spark)
    changes = diff.revision_diff(b, a).cache()
    want = {k: "removed" if k not in other else "added" if k not in base else "modified" for k in base | other if base.get(k) != other.get(k)}
    assert dict(collect(changes, "key", "change")) == want
    for size in (1, 7, 64):
        seen, after = [], None
        while True:
            page = diff.diff_page(changes, after, size).collect()
            seen += [r["key"] for r in page]
            if not page or page[0]["eof"]:
                break
            after = page[0]["next_after"]
            if size == 1 and len(seen) > 5:
                break
        assert seen == sorted(want)[: len(seen)]
        assert size == 1 or len(seen) == len(want)
    mirrored = diff.revision_diff(a, b)
    flip = {"added": "removed", "removed": "added", "modified": "modified"}
    assert dict(collect(mirrored, "key", "change")) == {k: flip[v] for k, v in want.items()}
    assert diff.revision_diff(b, b).count() == 0
    assert diff.diff_if_changed(b, a, "m", "m").count() == 0
    with pytest.raises(ValueError):
        diff.diff_page(changes, None, 65)


def test_diff_of_nulls_and_empty(spark):
    none = spark.createDataFrame([], REV)
    one = spark.createDataFrame([("a", None, None), ("a-", "x", "m"), ("a/b", "x", "m"), ("é", "x", None)], REV)
    assert diff.revision_diff(none, none).count() == 0
    assert [r["key"] for r in diff.diff_page(diff.revision_diff(none, one)).collect()] == ["a", "a-", "a/b", "é"]
    assert diff.revision_diff(one, one).count() == 0


def inode(path, kind="file", oid="x", size=1, **other):
    row = dict(path=path, inode_id=path, kind=kind, mode=0o644, flags=0, links=1, size=size, modified_ns=1, changed_ns=1, accessed_ns=1, birth_ns=1, has_xattrs=False, xattrs=None, content=oid if kind in ("file", "symlink") else None)
    return row | other


def test_namespace_diff_rules(spark):
    schema = "path string, inode_id string, kind string, mode int, flags int, links long, size long, modified_ns long, changed_ns long, accessed_ns long, birth_ns long, has_xattrs boolean, xattrs string, content string"
    before = [inode("/a"), inode("/a-"), inode("/d", "dir"), inode("/l", "symlink"), inode("/p", "fifo"), inode("/same"), inode("/x", "dir"), inode("/old", inode_id="7")]
    after = [inode("/a", oid="y"), inode("/a-", modified_ns=5), inode("/d", "file"), inode("/l", "symlink", oid="z"), inode("/p", "fifo"), inode("/same"), inode("/q", "fifo"), inode("/new", inode_id="7")]
    make = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r["path"]: (r["change"], r["metadata_changed"], r["content_changed"]) for r in diff.namespace_diff(make(before), make(after)).collect()}
    assert got == {
        "/a": ("modified", False, True), "/a-": ("modified", True, False), "/d": ("modified", True, True), "/l": ("modified", False, True),
        "/q": ("added", True, True), "/x": ("removed", True, False), "/old": ("removed", True, True), "/new": ("added", True, True),
    }


def test_merge_cases(spark):
    frame = lambda d: spark.createDataFrame([(k, v, "m") for k, v in d.items()], REV)
    base, source, target = {"k": "1", "a": "1", "b": "1", "c": "1", "d": "1"}, {"k": "1", "a": "2", "b": "1", "c": "2", "new": "s"}, {"k": "1", "a": "1", "b": "2", "c": "3", "d": "1", "new": "t"}
    got = {r["key"]: (r["action"], r["oid"]) for r in merge.merge_rows(frame(base), frame(source), frame(target)).collect()}
    assert got == {"k": ("keep", "1"), "a": ("take", "2"), "b": ("keep", "2"), "c": ("conflict", None), "d": ("take", None), "new": ("conflict", None)}
    assert merge.shortcut("b", "b", "t") == "unchanged" and merge.shortcut("b", "s", "b") == "fast-forward" and merge.shortcut("b", "s", "t") is None
    many = spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit("conflict").alias("action"))
    found = merge.conflicts(many).collect()
    assert len(found) == 32 and found[0]["conflicts_limited"]
    d = "inode_id string, mode int, flags int, modified_ns long, changed_ns long"
    side = lambda m, c: spark.createDataFrame([("i", 1, 0, m, c)], d)
    assert collect(merge.directory_merge(side(1, 1), side(5, 2), side(3, 9)), "modified_ns", "changed_ns") == [(5, 9)]


def test_views(spark):
    runs = spark.createDataFrame([(0, "a", "delete", None), (1, "a", "put", "1"), (1, "b", "put", "2"), (2, "b", "put", "3"), (0, "c", "put", "4")], "run_no int, key string, op string, oid string")
    assert collect(views.newest_wins(runs), "key", "oid") == [("b", "2"), ("c", "4")]
    assert [r["key"] for r in views.compact(runs, 1).collect()] == ["b", "c"]
    assert views.newest_wins(runs.limit(0)).count() == 0
    assert collect(views.range_erase(runs, "b", "c"), "key") == [("a",), ("a",), ("c",)]
    assert collect(views.at_version(runs.withColumn("version", F.lit("v")), "w"), "key") == []


def test_ancestry_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(37)], "revision_id int, parent_id int, seq int")
    got = history.ancestry(chain, spark.createDataFrame([(36,), (3,)], "revision_id int"))
    assert collect(got, "tip", "revision_id", "depth") == sorted([(36, 36 - d, d) for d in range(37)] + [(3, 3 - d, d) for d in range(4)])
    assert [r["revision_id"] for r in history.history_page(got.filter("tip = 36"), 10, 3).collect()] == [9, 8, 7]
    assert history.sequence_audit(chain).count() == 0
    with pytest.raises(history.CycleError):
        history.ancestry(spark.createDataFrame([(1, 2), (2, 1)], "revision_id int, parent_id int"), spark.createDataFrame([(1,)], "revision_id int"))


def test_content(spark):
    data = bytes(random.Random(1729).randrange(3) * 85 for _ in range(900))
    parts = [(1, i, bytearray(data[i * 256 : i * 256 + 256]), len(data)) for i in (0, 1, 3)]
    chunks = spark.createDataFrame(parts, "inode_id int, idx int, data binary, size long")
    want = data[:512] + bytes(256) + data[768:]
    for offset, count in ((0, 900), (500, 300), (890, 50), (2000, 5)):
        got = content.read_range(chunks, offset, count, 256).collect()[0]["data"]
        assert bytes(got) == want[offset : offset + count]
    assert [tuple(r) for r in content.regions(chunks).orderBy("first_idx").select("first_idx", "last_idx", "next_data", "next_hole").collect()] == [(0, 1, 3, 2), (3, 3, None, 4)]
    objects = spark.createDataFrame([("bad", 1, bytearray(b"x"))], "oid string, size long, payload binary")
    assert content.verify_objects(objects).count() == 1
    assert bytes(objects.select(content.trim_zeros(F.lit(b"a\x00b\x00\x00")).alias("t")).first()["t"]) == b"a\x00b"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    live = graph.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    assert collect(live, "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert collect(graph.sweep(spark.createDataFrame([("a",), ("y",)], "node string"), live), "node") == [("y",)]
    entries = spark.createDataFrame([("root", "d", "1"), ("1", "f", "2"), ("1", "g", "2")], "parent_id string, name string, child_id string")
    paths = graph.tree_paths(entries, "root")
    assert collect(paths, "path") == [("/",), ("/d",), ("/d/f",), ("/d/g",)]
    assert collect(graph.one_path(paths), "inode_id", "path") == [("1", "/d"), ("2", "/d/f"), ("root", "/")]
    assert graph.multiply_linked(entries, spark.createDataFrame([("1",)], "inode_id string")).count() == 0
    # A link is followed before the dots behind it: /l is /x/y, so /l/../e is /x/e and not /e.
    entries = spark.createDataFrame([("root", "x", "x"), ("x", "y", "y"), ("x", "e", "xe"), ("root", "e", "e"), ("root", "l", "l"), ("root", "loop", "loop"), ("x", "far", "far"), ("root", "long", "long")], "parent_id string, name string, child_id string")
    inodes = spark.createDataFrame([("root", "dir"), ("x", "dir"), ("y", "dir"), ("xe", "file"), ("e", "file"), ("l", "symlink"), ("loop", "symlink"), ("far", "symlink"), ("long", "symlink")], "inode_id string, kind string")
    links = spark.createDataFrame([("l", "/x/y"), ("loop", "loop"), ("far", "../l/../far/"), ("long", "./" * 33_000)], "inode_id string, target string")
    asked = spark.createDataFrame([(1, "/l/../e"), (2, "/loop"), (3, "/e/"), (4, "x"), (5, "/../../x/./e"), (6, "/x/none"), (7, "/"), (8, "/x/far"), (9, "/long")], "query int, path string")
    got = {r["query"]: r["inode_id"] or r["error"] for r in graph.resolve(asked, entries, inodes, links, "root").collect()}
    assert got == {1: "xe", 2: "ELOOP", 3: "ENOTDIR", 4: "EINVAL", 5: "xe", 6: "ENOENT", 7: "root", 8: "ELOOP", 9: "ENAMETOOLONG"}
    assert graph.resolve(asked.filter("query = 2"), entries, inodes, links, "root", follow_final=False).first()["inode_id"] == "loop"
    ring = spark.createDataFrame([("root", "a", "1"), ("2", "b", "3"), ("3", "c", "2")], "parent_id string, name string, child_id string")
    assert collect(graph.cycles(ring, "root"), "name") == [("b",), ("c",)]


def test_reach_has_no_depth_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "DEPTH_LIMIT", 5)  # a limit of trees only
    monkeypatch.setattr(graph, "COLLAPSE", 7)
    chain = spark.range(30).selectExpr("cast(id as string) AS src", "cast(id + 1 as string) AS dst")
    found = graph.reachable(chain, spark.createDataFrame([("0",)], "node string"))
    assert found.count() == 31 and found.agg(F.max("depth")).first()[0] == 30
    with pytest.raises(RuntimeError):
        graph.reachable(chain, spark.createDataFrame([("0",)], "node string"), most_rounds=3)


def test_audits(spark):
    inodes = spark.createDataFrame([("root", "dir", 3), ("1", "dir", 2), ("2", "file", 2)], "inode_id string, kind string, links long")
    entries = spark.createDataFrame([("root", "d", "1"), ("1", "f", "2"), ("9", "z", "8")], "parent_id string, name string, child_id string")
    assert collect(audit.namespace_violations(inodes, entries), "inode_id", "problem") == [("2", "links"), ("8", "dangling entry"), ("9", "parent is no directory")]
    x = spark.createDataFrame([("1", str(i), bytearray(b"v")) for i in range(129)], "inode_id string, name string, value binary")
    assert collect(audit.xattr_limits(x), "inode_id", "names") == [("1", 129)]
    stored = spark.createDataFrame([("objects", 2)], "name string, n long")
    assert audit.stored_counts(spark.createDataFrame([("objects",), ("objects",)], "name string"), stored).count() == 0


def test_capture(spark):
    s = "key string, oid string, kind string, size long, mtime long, mode int"
    old = spark.createDataFrame([("a", "1", "file", 1, 1, 1), ("b", None, "file", 1, 1, 1), ("c", "1", "file", 1, 1, 1), ("d", "1", "file", 1, 1, 1)], s)
    new = spark.createDataFrame([("a", "2", "file", 1, 1, 1), ("b", None, "file", 1, 2, 1), ("c", "1", "file", 1, 9, 2), ("e", None, "file", 1, 1, 1)], s)
    assert collect(capture.capture(old, new), "key", "status", "incomplete") == [("a", "M", False), ("b", "M", True), ("c", "T", False), ("d", "D", False), ("e", "A", True)]
    assert capture.capture(old, old).count() == 0
    assert [capture.journal_verdict(*x) for x in ((None, 1, 2), (5, 1, 9), (3, 9, 20), (30, 1, 9))] == ["must-scan", "ok", "stale", "wrapped"]


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(1, i, (a := rng.randrange(500)), a + rng.randrange(1, 40), "exclusive" if i % 3 == 0 else "shared") for i in range(60)]
    locks = spark.createDataFrame(rows, "inode_id int, handle int, start long, end long, mode string")
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[2] < y[3] and y[2] < x[3] and "exclusive" in (x[4], y[4]))
    assert collect(intervals.conflicts(locks), "a", "b") == want
    covered = {t for r in rows for t in range(r[2], r[3])}
    merged = collect(intervals.coalesce(locks, ["inode_id"]), "start", "end")
    assert {t for a, b in merged for t in range(a, b)} == covered and all(x[1] < y[0] for x, y in zip(merged, merged[1:], strict=False))
    one = spark.createDataFrame([(1, 0, 10, "s"), (1, 20, 30, "s")], "inode_id int, start long, end long, mode string")
    new = spark.createDataFrame([(1, 5, 25, "x")], "inode_id int, start long, end long, mode string")
    assert collect(intervals.replace_range(one, new, ["inode_id"]), "start", "end", "mode") == [(0, 5, "s"), (5, 25, "x"), (25, 30, "s")]
    e = spark.createDataFrame([(1, 0, 1), (1, 9, 2), (1, 19, 3)], "u int, at long, tie int")
    assert collect(intervals.leases(e, "u", "at", "tie", 10), "started", "last_seen", "n") == [(0, 9, 2), (19, 19, 1)]


def test_pages_and_rollups(spark):
    rows = spark.createDataFrame([("a",), ("a-",), ("a/x",), ("b",)], "key string")
    assert [r["key"] for r in pages.prefix_scan(rows, "a").collect()] == ["a", "a-", "a/x"]
    assert [r["key"] for r in pages.keyset_page(rows, "a", "a-", 1).collect()] == ["a/x"]
    with pytest.raises(ValueError):
        pages.keyset_page(rows, limit=0)
    values = spark.createDataFrame([("g", i) for i in range(1, 1001)] + [("h", i) for i in range(1, 10)], "k string, v int")
    assert collect(rollup.guarded_percentiles(values, ["k"], "v"), "k", "p50", "p95") == [("g", 500, 950), ("h", 5, None)]
    trash = spark.createDataFrame([("a", 5, "x"), ("b", 15, "x"), ("c", 5, "deleting"), ("z", 5, "x")], "key string, trashed_at long, state string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert collect(rollup.trash_classes(trash, known, 20, 15), "key", "class") == [("a", "due"), ("b", "waiting"), ("c", "deleting"), ("z", "orphan")]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.crc32c(F.lit(b"123456789")).alias("crc"), scalars.little_endian(F.lit(b"\x01\x02\xff"), 2).cast("int").alias("le"), scalars.to_little_endian(F.lit(513), 4).alias("bytes"),
        scalars.path_parts(F.lit("/a//b/")).alias("parts"), scalars.octal(F.lit("0755")).alias("octal"), scalars.strict_int(F.lit("12x")).alias("bad"), scalars.strict_int(F.lit("12")).alias("good"),
        scalars.json_quoted(F.lit('a"\\\n')).alias("json"), scalars.valid_name(F.lit("..")).alias("dots"), scalars.valid_label(F.lit("a\tb")).alias("label"), scalars.path_join(F.lit("/"), F.lit("x")).alias("join"), scalars.is_inode_id(F.lit("ab" * 16)).alias("id"), scalars.minute_text(F.lit(0)).alias("minute"),
        scalars.valid_utf8(F.lit(b"\xc0\x80")).alias("utf8"), scalars.valid_mode(F.lit(0o2000)).alias("mode"),
    ).first()
    assert row["crc"] == 0xE3069283 and row["le"] == 513 and bytes(row["bytes"]) == b"\x01\x02\x00\x00"
    assert row["parts"] == ["a", "b", "."] and row["octal"] == 493 and row["bad"] is None and row["good"] == 12
    assert row["json"] == '"a\\"\\\\\\u000a"' and not row["dots"] and not row["label"] and row["join"] == "/x" and row["id"] and row["minute"] == "1970-01-01 00:00"
    assert not row["utf8"] and not row["mode"]
    assert scalars.prefix_end("ab") == b"ac" and scalars.prefix_end("") is None


def test_minutes_of_far_years(spark):
    seconds = [0, 253402300799, 253402300800, 900000000000, -62167219200, -62167219201, -70000000000]
    rows = spark.createDataFrame([(s,) for s in seconds], "s long").select("s", scalars.minute_text(F.col("s")).alias("minute")).collect()
    want = ["1970-01-01 00:00", "9999-12-31 23:59", "10000-01-01 00:00", "30489-11-11 16:00", "0000-01-01 00:00", "-1-12-31 23:59", "-249-10-15 19:33"]
    assert {r["s"]: r["minute"] for r in rows} == dict(zip(seconds, want, strict=True))


def test_mutations(spark):
    now = 100
    empty = mutations.Tree(*(spark.createDataFrame([], s) for s in (mutations.INODE, mutations.ENTRY, mutations.CHUNK, mutations.XATTR)))
    root = spark.createDataFrame([("root", "dir", 0o755, 0, 2, 0, 1, 1, 1, 1, False)], mutations.INODE)
    t = mutations.Tree(root, empty.entries, empty.chunks, empty.xattrs)
    new = lambda *rows: spark.createDataFrame(list(rows), "parent_id string, name string, inode_id string")
    t = mutations.create(t, new(("root", "d", "1")), "dir", 0o755, now)
    t = mutations.create(t, new(("1", "f", "2"), ("1", "g", "3")), "file", 0o644, now)
    with pytest.raises(FileExistsError):
        mutations.create(t, new(("1", "f", "9")), "file", 0o644, now)
    t = mutations.write(t, spark.createDataFrame([("2", 0, "oid", 5)], mutations.CHUNK), spark.createDataFrame([("2", 5)], "inode_id string, size long"), now + 1)
    t = mutations.link(t, new(("root", "h", "2")), now)
    t = mutations.clone(t, spark.createDataFrame([("2", "4", "root", "copy")], "inode_id string, new_id string, parent_id string, name string"), now)
    t = mutations.set_xattrs(t, spark.createDataFrame([("2", "user.a", bytearray(b"1"))], mutations.XATTR), now)
    move = lambda *r: spark.createDataFrame([r], "parent_id string, name string, to_parent string, to_name string")
    t = mutations.rename(t, move("1", "g", "root", "g2"), now)
    t = mutations.exchange(t, move("root", "g2", "root", "copy"), now)
    assert collect(t.entries, "parent_id", "name", "child_id") == [("1", "f", "2"), ("root", "copy", "3"), ("root", "d", "1"), ("root", "g2", "4"), ("root", "h", "2")]
    assert dict(collect(t.inodes, "inode_id", "links")) == {"root": 3, "1": 2, "2": 2, "3": 1, "4": 1}
    assert audit.link_counts(t.inodes, t.entries).count() == 0
    assert collect(t.chunks, "inode_id", "oid") == [("2", "oid"), ("4", "oid")]
    t = mutations.unlink(t, spark.createDataFrame([("root", "h"), ("1", "f")], "parent_id string, name string"), now)
    assert collect(t.chunks, "inode_id") == [("4",)] and t.xattrs.count() == 0
    with pytest.raises(OSError):
        mutations.unlink(mutations.create(t, new(("1", "k", "8")), "file", 0o644, now), spark.createDataFrame([("root", "d")], "parent_id string, name string"), now)
    t = mutations.punch(t, spark.createDataFrame([("4", 0, 0)], "inode_id string, first long, last long"), now)
    assert t.chunks.count() == 0
    t = mutations.set_attributes(t, spark.createDataFrame([("4", 0o600)], "inode_id string, mode int"), now)
    assert collect(t.inodes.filter("inode_id = '4'"), "mode") == [(0o600,)]


def test_handles(spark):
    owned = spark.createDataFrame([(1, "a", "i"), (2, "b", "j")], "handle int, session string, inode_id string")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "handle int, session string")
    assert collect(handles.foreign(asked, owned), "handle") == [(2,), (3,)]
    assert collect(handles.kept_open(spark.createDataFrame([("i",), ("z",)], "inode_id string"), owned), "inode_id") == [("i",)]
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("m"))
    got = m.select(handles.map_put(F.col("m"), "a", F.lit("9")).alias("put"), handles.map_remove(F.col("m"), "b").alias("gone"), handles.xattr_value(F.col("m"), "c").alias("none")).first()
    assert dict(got["put"]) == {"a": "9", "b": "2"} and dict(got["gone"]) == {"a": "1"} and got["none"] is None


def test_reachable_has_no_depth_limit(spark, monkeypatch):
    """300 rounds end when the frontier is empty; frames are stood in for, as only the rounds count here."""

    class Frame:
        rounds = 0

        def __getattr__(self, name):
            return lambda *a, **k: self

        def isEmpty(self):
            Frame.rounds += 1
            return Frame.rounds > 300

    monkeypatch.setattr(graph, "checkpointed", lambda df: df)
    graph.reachable(Frame(), Frame())
    assert Frame.rounds == 301
    with pytest.raises(RuntimeError):
        Frame.rounds = 0
        graph.reachable(Frame(), Frame(), 5)


def tree_of(spark, entries, kinds):
    e = spark.createDataFrame(entries, mutations.ENTRY)
    i = spark.createDataFrame([(k, v, 0, 0, 0, 0, 0, 0, 0, 0, False) for k, v in kinds.items()], mutations.INODE)
    return mutations.relink(mutations.Tree(i, e, spark.createDataFrame([], mutations.CHUNK), spark.createDataFrame([], mutations.XATTR)), 0)


MOVE = "parent_id string, name string, to_parent string, to_name string"


def test_moves_are_guarded(spark):
    tree = tree_of(spark, [("root", "a", "a"), ("a", "b", "b"), ("b", "c", "c"), ("root", "f", "f"), ("root", "g", "f"), ("root", "h", "h")], {"root": "dir", "a": "dir", "b": "dir", "c": "dir", "f": "file", "h": "file"})
    move = lambda *rows: spark.createDataFrame(list(rows), MOVE)
    names = lambda t: collect(t.entries, "parent_id", "name", "child_id")
    for bad, error in [(("root", "a", "c", "x"), OSError), (("root", "a", "a", "x"), OSError), (("root", "none", "root", "x"), FileNotFoundError), (("root", "a", "root", "f"), OSError), (("root", "f", "root", "a"), OSError)]:
        with pytest.raises(error):
            mutations.rename(tree, move(bad), 5)
    for same in (("root", "a", "root", "a"), ("root", "f", "root", "g")):
        assert names(mutations.rename(tree, move(same), 5)) == names(tree)
    assert ("root", "f", "h") in names(mutations.rename(tree, move(("root", "h", "root", "f")), 5))
    with pytest.raises(FileExistsError):
        mutations.rename(tree, move(("root", "h", "root", "f")), 5, exclusive=True)
    for bad in (("root", "a", "b", "c"), ("b", "c", "root", "a")):
        with pytest.raises(OSError):
            mutations.exchange(tree, move(bad), 5)
    with pytest.raises(FileNotFoundError):
        mutations.exchange(tree, move(("root", "a", "root", "none")), 5)
    assert ("root", "h", "c") in names(mutations.exchange(tree, move(("b", "c", "root", "h")), 5))
    with pytest.raises(ValueError):
        mutations.set_attributes(tree, spark.createDataFrame([("f", 3)], "inode_id string, size long"), 5)
    saved = mutations.save(tree, spark.createDataFrame([("root", "h", "f")], "parent_id string, name string, inode_id string"), 5)
    assert ("root", "h", "f") in names(saved) and saved.inodes.filter("inode_id = 'h'").isEmpty()


def test_small_rules(spark):
    sizes = "key int, size long, mtime long, oid string, mode string"
    a, b = spark.createDataFrame([(1, None, 1, "x", "m"), (2, None, 1, "x", "m")], sizes), spark.createDataFrame([(1, 5, 1, "x", "m"), (2, None, 1, "x", "m")], sizes)
    assert collect(diff.status_diff(a, b), "key", "status") == [(1, "M")]
    with pytest.raises(ValueError):
        history.history_page(spark.createDataFrame([(1, 0)], "revision_id int, depth long"), 7)
    with pytest.raises(ValueError):
        content.read_range(spark.createDataFrame([], "inode_id string, idx long, data binary, size long"), 0, (256 << 10) + 1, 8)
    crc = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,), (bytearray(b"a" * 70),)], "d binary").select(scalars.crc32c(F.col("d")).alias("c"))
    assert [r["c"] for r in crc.collect()][:3] == [0xE3069283, 0, None]
    r = spark.createDataFrame([("i", s, s + 1, "shared") for s in range(0, 258, 2)], "inode_id string, start long, end long, mode string")
    with pytest.raises(Exception, match="lock ranges"):
        intervals.set_locks(r, r.limit(1), ["inode_id"]).collect()
    from strataq.operators import capture

    assert [capture.journal_verdict(*x) for x in [(None, 1, 2), (9, 1, 2), (1, 5, 9), (4, 5, 9), (4, 5, 9, True), (4, 5, 9, False, True)]] == ["must-scan", "wrapped", "stale", "ok", "dropped", "timeout"]
