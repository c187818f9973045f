"""Content-addressed objects, chunks, sparse files and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOCATION_UNIT = 512
#: Bytes of one read or write at most.
MOST_BYTES = 256 << 10


def object_id(payload: Column) -> Column:
    return F.sha2(payload, 256)


def dedup(rows: DataFrame, payload: str, row_id: str) -> DataFrame:
    """One row per distinct content: its id, size, number of references, and first reference."""
    return rows.select(object_id(F.col(payload).cast("binary")).alias("oid"), F.octet_length(payload).alias("size"), row_id).groupBy("oid").agg(F.first("size").cast("long").alias("size"), F.count("*").alias("refs"), F.min(row_id).alias("first_ref"))


def new_objects(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct objects of ``incoming`` that the store lacks."""
    return incoming.dropDuplicates(["oid"]).join(stored.select("oid"), "oid", "left_anti")


def reference_counts(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Every object with its number of references, 0 included."""
    counts = references.groupBy("oid").agg(F.count("*").alias("refs"))
    return objects.join(counts, "oid", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))


def chunk_map(rows: DataFrame, row_id: str, payload: str, chunk: int) -> DataFrame:
    """(inode_id, idx, oid, len) for each chunk of ``chunk`` bytes; the payload is cut where it is, and only ids and sizes leave the row."""
    data = F.col(payload).cast("binary")
    size = F.octet_length(data)
    part = lambda i: F.substring(data, i * chunk + 1, F.lit(chunk))
    each = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")), lambda i: F.struct(i.cast("long").alias("idx"), object_id(part(i)).alias("oid"), F.octet_length(part(i)).cast("long").alias("len")))
    return rows.filter(size > 0).select(F.col(row_id).alias("inode_id"), F.inline(each))


def allocated(size: Column) -> Column:
    """Bytes rounded up to whole allocation units."""
    return F.ceil(size / ALLOCATION_UNIT).cast("long") * ALLOCATION_UNIT


def allocated_bytes(rows: DataFrame, by: str, size: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(size.cast("long")).alias("bytes"), F.sum(allocated(size)).alias("allocated"))


def verify_objects(objects: DataFrame) -> DataFrame:
    """Objects whose stored id or size is not that of their payload."""
    return objects.filter((object_id(F.col("payload")) != F.col("oid")) | (F.octet_length("payload") != F.col("size")))


def chunk_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunk positions that differ; a missing row is a hole."""
    b = before.select("inode_id", "idx", F.col("oid").alias("before_oid"))
    a = after.select("inode_id", "idx", F.col("oid").alias("after_oid"))
    return b.join(a, ["inode_id", "idx"], "full_outer").filter(~F.col("before_oid").eqNullSafe(F.col("after_oid")))


def read_range(chunks: DataFrame, offset: int, count: int, chunk: int) -> DataFrame:
    """For each inode (inode_id, idx, data, size) the bytes of a range of at most 256 KiB, holes as zeros, cut at the size; only the chunks of the range are read."""
    if not 0 <= count <= MOST_BYTES:
        raise ValueError(f"a range has at most {MOST_BYTES} bytes")
    first, last = offset // chunk, (offset + max(count, 1) - 1) // chunk
    sizes = chunks.groupBy("inode_id").agg(F.max("size").alias("size"))
    part = chunks.filter(F.col("idx").between(first, last)).select("inode_id", F.struct("idx", "data").alias("x"))
    have = part.groupBy("inode_id").agg(F.map_from_entries(F.collect_list("x")).alias("have"))
    filled = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.hex(F.coalesce(F.try_element_at("have", i.cast(chunks.schema["idx"].dataType)), F.lit(b"").cast("binary"))))
    joined = sizes.join(have, "inode_id", "left").select("inode_id", "size", F.array_join(F.transform(filled, lambda h: F.rpad(h, 2 * chunk, "0")), "").alias("hex"))
    n = F.greatest(F.least(F.lit(count), F.col("size") - offset), F.lit(0)).cast("int")
    return joined.select("inode_id", F.unhex(F.col("hex").substr(F.lit(2 * (offset - first * chunk) + 1), n * 2)).alias("data"))


def read_whole(chunks: DataFrame, chunk: int) -> DataFrame:
    """All bytes of each inode (inode_id, idx, data, size), holes as zeros."""
    have = chunks.filter("idx IS NOT NULL").groupBy("inode_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("long"), "data"))).alias("have"))
    rows = chunks.groupBy("inode_id").agg(F.max("size").cast("long").alias("size")).join(have, "inode_id", "left")
    last = F.ceil(F.col("size") / chunk).cast("long") - 1
    parts = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.rpad(F.hex(F.coalesce(F.try_element_at("have", i), F.lit(b"").cast("binary"))), 2 * chunk, "0")))
    return rows.select("inode_id", F.unhex(F.coalesce(F.array_join(parts, ""), F.lit("")).substr(F.lit(1), (F.col("size") * 2).cast("int"))).alias("data"))


def write_at(chunks: DataFrame, writes: DataFrame, chunk: int) -> DataFrame:
    """``chunks`` (inode_id, idx, data) after one write (inode_id, offset, data) for each inode; what lies between the end and the offset reads as zeros."""
    size = F.octet_length("data")
    index = F.sequence(F.floor(F.col("offset") / chunk).cast("long"), F.floor((F.col("offset") + size - 1) / chunk).cast("long"))
    each = writes.filter(size > 0).select("inode_id", "offset", F.col("data").alias("_new"), F.explode(index).alias("idx"))
    begin, end = F.greatest(F.col("offset") - F.col("idx") * chunk, F.lit(0)), F.least(F.col("offset") + F.octet_length("_new") - F.col("idx") * chunk, F.lit(chunk))
    part = F.substring(F.col("_new"), (F.col("idx") * chunk + begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
    parts = each.select("inode_id", "idx", begin.cast("int").alias("_b"), end.cast("int").alias("_e"), part.alias("_p"))
    j = chunks.join(parts, ["inode_id", "idx"], "full_outer")
    old = F.coalesce(F.hex("data"), F.lit(""))
    laid = F.unhex(F.concat(F.rpad(F.substring(old, F.lit(1), F.col("_b") * 2), F.col("_b") * 2, F.lit("0")), F.hex("_p"), F.substring(old, F.col("_e") * 2 + 1, F.greatest(F.length(old) - F.col("_e") * 2, F.lit(0)))))
    return _stored(j.select("inode_id", "idx", F.when(F.col("_p").isNull(), F.col("data")).otherwise(laid).alias("data")))


def truncate(chunks: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """``chunks`` cut at the new sizes (inode_id, size): chunks beyond go, the last one is cut; a larger size adds nothing but zeros to read."""
    j = chunks.join(sizes.select("inode_id", F.col("size").alias("_s")), "inode_id", "left")
    room = F.col("_s") - F.col("idx") * chunk
    kept = j.filter(F.col("_s").isNull() | (room > 0))
    cut = F.when(room < F.octet_length("data"), F.substring(F.col("data"), F.lit(1), room.cast("int"))).otherwise(F.col("data"))
    return _stored(kept.select("inode_id", "idx", cut.alias("data")))


def punch(chunks: DataFrame, holes: DataFrame, chunk: int) -> DataFrame:
    """``chunks`` with a range (inode_id, offset, length) of each inode turned into zeros: whole chunks go, the edges are overwritten."""
    j = chunks.join(holes.select("inode_id", F.col("offset").alias("_o"), F.col("length").alias("_l")), "inode_id", "left")
    size = F.octet_length("data")
    begin = F.greatest(F.col("_o") - F.col("idx") * chunk, F.lit(0))
    end = F.least(F.col("_o") + F.col("_l") - F.col("idx") * chunk, size)
    some = F.col("_o").isNotNull() & (begin < end)
    h, b, e = F.hex("data"), (begin * 2).cast("int"), (end * 2).cast("int")
    zeroed = F.unhex(F.concat(F.substring(h, F.lit(1), b), F.repeat(F.lit("0"), e - b), F.substring(h, e + 1, F.length(h) - e)))
    whole = some & (begin == 0) & (end == size)
    return _stored(j.filter(~F.coalesce(whole, F.lit(False))).select("inode_id", "idx", F.when(some, zeroed).otherwise(F.col("data")).alias("data")))


def _stored(chunks: DataFrame) -> DataFrame:
    """Chunks as they are kept: without zero bytes at the end, and not at all if nothing is left."""
    return chunks.withColumn("data", trim_zeros(F.col("data"))).filter(F.octet_length("data") > 0)


def fetch(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Objects by id (oid), their bytes checked: ``valid`` is false where they are not what the id says, null where the object is absent."""
    found = wanted.select("oid").distinct().join(objects, "oid", "left")
    return found.select("oid", "payload", F.when(F.col("payload").isNotNull(), object_id(F.col("payload")) == F.col("oid")).alias("valid"))


def object_sizes(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored sizes by id; the payload column is not read."""
    return wanted.select("oid").join(objects.select("oid", "size"), "oid", "left")


def seek_region(chunks: DataFrame, sizes: DataFrame, asked: DataFrame, chunk: int) -> DataFrame:
    """For (query, inode_id, offset): the next offset with data and the next in a hole; null beyond the end, where the file's end counts as a hole."""
    runs = regions(chunks).select("inode_id", (F.col("first_idx") * chunk).alias("_b"), ((F.col("last_idx") + 1) * chunk).alias("_e"))
    j = asked.join(sizes, "inode_id").filter("offset < size").join(runs, "inode_id", "left")
    data = F.min(F.when((F.col("_e") > F.col("offset")) & (F.greatest("_b", "offset") < F.col("size")), F.greatest("_b", "offset")))
    inside = F.max(F.when((F.col("_b") <= F.col("offset")) & (F.col("offset") < F.col("_e")), F.least("_e", "size")))
    found = j.groupBy("query", "inode_id", "offset").agg(data.alias("next_data"), F.coalesce(inside, F.first("offset")).alias("next_hole"))
    return asked.join(found, ["query", "inode_id", "offset"], "left")


def trim_zeros(data: Column) -> Column:
    """Bytes without trailing zero bytes."""
    return F.unhex(F.regexp_replace(F.hex(data), "(00)+$", ""))


def regions(chunks: DataFrame, inode: str = "inode_id", idx: str = "idx") -> DataFrame:
    """Runs of consecutive chunks of each inode: first and last index, and the start of the hole after each."""
    w = Window.partitionBy(inode).orderBy(idx)
    rows = chunks.select(inode, idx).distinct().withColumn("_run", F.col(idx) - F.row_number().over(w))
    return rows.groupBy(inode, "_run").agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx")).drop("_run").withColumn("next_data", F.lead("first_idx").over(Window.partitionBy(inode).orderBy("first_idx"))).withColumn("next_hole", F.col("last_idx") + 1)
