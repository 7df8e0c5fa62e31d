"""Exact deduplication by an extendible-hash index, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A to Z.  The key of
a text is the 64-bit xxHash of its normal form.

1. *Records.*  Rows are grouped by key and by the bytes of the normal form, so
   copies meet in the map tasks' partial aggregates and one row for each
   distinct text is shuffled.  A record holds key, SHA-256, number of rows and
   largest id, not the text; records are a table in the shared folder.
2. *Directory.*  A bucket is a prefix of the key, so a range of keys.  The
   directory starts with as many bits as would fill buckets evenly; buckets
   with more than ``capacity`` records are split by the next bit until none is
   overfull (a bucket that holds one key alone can't be).  Each round of
   splits doubles the directory: 2**depth pointers, several of which lead to
   the same bucket.  Only how many buckets are overfull reaches the driver.
3. *Index.*  Owner tasks take ranges of buckets, chain the records that share
   a key, and write the buckets as files in the shared folder.
4. *Look-up.*  Every document goes through the directory to its bucket and
   joins on the key.  A chain of one record is the text itself, since step 1
   has compared the bytes of all rows of this key.  Documents whose key has a
   longer chain are compared with its texts byte by byte.

Keys with more than one ``HOT``-th of all rows, at most ``HOT`` of them, are
dealt out by the documents' ids over several tasks; their index rows are
repeated there.

Defined cases: a null text counts as empty; of equal texts the row with the
largest id stays, a null id below all others; of rows that are alike in id and
text one stays; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import fresh, stored
from postlens.session import cut_lineage

#: Records in a bucket at least, and buckets for which the directory is laid out at most: more records make larger buckets.
CAPACITY = 1000
BUCKETS = 2**16
#: Bits of the directory beyond which overfull buckets are not split any more, only longer.
DEEPEST = 24
#: Pointers of a directory that is broadcast (24 bytes each).
POINTERS = 2**18
#: Keys with more than this part of all rows are spread over tasks.
HOT = 1000


def normal(text: Column) -> Column:
    """The text with A to Z in lower case; null is empty.  (For texts in ASCII ``lower`` is the same and faster.)"""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Id, normal form and key of each document; ``bits`` below 64 blanks the rest of the key (to test collisions)."""
    rows = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    key = F.xxhash64("norm")
    return rows.withColumn("key", key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits))


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each distinct text: key, normal form, largest id and number of rows."""
    return rows.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(records: DataFrame, capacity: int | None = None) -> tuple[DataFrame, int]:
    """Pointers ``slot -> bucket, depth`` for every slot of the directory in use, and the directory's depth.

    A bucket is named by the least slot of the deepest directory there can be, so buckets are in the order of their keys."""
    total = records.count()
    capacity = capacity or max(CAPACITY, math.ceil(total / BUCKETS))
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, total) / capacity))))
    found, left = None, records.select("key")
    while True:
        fill = left.groupBy(prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), (F.min("key") < F.max("key")).alias("splits"))
        full = (F.col("n") > capacity) & F.col("splits") & F.lit(depth < DEEPEST)
        fill = cut_lineage(fill.select("prefix", full.alias("full")))
        done = fill.where(~F.col("full")).select("prefix", F.lit(depth).alias("depth"))
        found = done if found is None else found.unionByName(done)
        over = fill.where("full").select(F.col("prefix").alias("over"))
        if over.isEmpty():
            break
        # at most total / capacity buckets are overfull, so at most BUCKETS of them
        left = left.join(F.broadcast(over), prefix(depth) == F.col("over"), "left_semi")
        depth += 1
    spread = F.expr(f"shiftleft(1L, {depth} - depth)")
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    pointers = found.select(F.expr(f"shiftleft(prefix, {DEEPEST} - depth)").alias("bucket"), "depth",
                            F.explode(F.sequence(first, first + spread - 1)).alias("slot"))
    return cut_lineage(pointers), depth


def located(rows: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket of their key."""
    to = pointers.select("slot", "bucket")
    return rows.join(F.broadcast(to) if 2**depth <= POINTERS else to, prefix(depth) == F.col("slot")).drop("slot")


def index(records: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """The buckets: records in the order of their keys, each with its place in the chain of its key, the chain's
    length and the rows of the key."""
    owned = located(records, pointers, depth).repartitionByRange("bucket")
    of = Window.partitionBy("bucket", "key")
    return stored(owned.select("*", F.row_number().over(of.orderBy("text_sha256", "keep_id")).alias("chain"),
                               F.count(F.lit(1)).over(of).alias("chained"), F.sum("group_size").over(of).alias("key_rows")), "dedup-index")


def groups(docs: DataFrame, capacity: int | None = None, bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every document."""
    rows = keyed(docs, bits)
    records = stored(grouped(rows).select("key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"),
                     "dedup-records")
    pointers, depth = directory(records, capacity)
    held = index(records, pointers, depth)
    columns = ["doc_id", "copies", "keep_id", "group_size", "text_sha256"]

    share = (held.agg(F.sum("group_size")).first()[0] or 0) // HOT + 1
    single = held.where("chained = 1").withColumn("turns", F.ceil(F.col("key_rows") / share).cast("int"))
    hot = single.where("turns > 1").select(F.col("key").alias("hot_key"), F.col("turns").alias("hot_turns"))
    asked = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    # each of these keys has over a HOT-th of the rows
    asked = asked.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    asked = asked.withColumn("turn", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("hot_turns")), F.lit(0)).cast("int"))
    single = single.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    out = located(asked, pointers, depth).join(single, ["bucket", "key", "turn"]).select(*columns)

    chained = held.where("chained > 1")
    if not chained.isEmpty():  # documents whose key is that of several texts, by their bytes
        rows = rows.join(chained.select("key").distinct(), "key", "left_semi")
        texts = grouped(rows).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        rows = rows.groupBy("doc_id", "key", "norm").agg(F.count(F.lit(1)).alias("copies"))
        out = out.unionByName(rows.join(texts, ["key", "norm"]).select(*columns))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.  Rows are told apart by id and SHA-256 here; of rows alike in
    both, which may differ in other columns, any one stays."""
    sha, keep = fresh(docs, "sha"), fresh(docs, "keep")
    stay = groups(docs).where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha + "_"))
    rows = docs.withColumn(sha, F.sha2(normal(F.col("text")).cast("binary"), 256))
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(sha + "_")), "left_semi")
    return rows.dropDuplicates(["doc_id", sha]).drop(sha)


#: The same by SQL, over a view ``documents``.
SQL = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as x from documents)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
  row_number() over (partition by x order by doc_id desc nulls last) = 1 as kept, sha256(x) as text_sha256 from t
"""
