"""Jaccard self-join of documents on word n-grams by chosen paths.

A document is the set of its runs of ``N`` words; two documents are linked if
their sets' Jaccard similarity is at least ``SIMILARITY``.  Documents with
equal sets are one node from the start, so exact copies cost one row each.

Candidates come from chosen paths.  In a run, a node starts at the root and, at
each step, is passed on once for each of its tokens whose hash at this place in
the tree falls below ``SPREAD / (SIMILARITY * size)``.  Similar sets share most
tokens and use the same hash, so a pair at the threshold has ``SPREAD`` chosen
tokens in common on average: its paths go on together at any depth with the
survival probability of that branching process.  Runs are repeated until the
chance to lose a pair in all of them is below 1 - ``RECALL``.  Unlike pairs
share few tokens and die out step by step.

Buckets begin two steps below the root.  Small ones are compared by brute
force.  Larger ones are split by a further step, unless their parts together
hold more pairs than they do; these, and what is left at ``DEPTH``, are compared
whole, in pairs of blocks of bounded size, so no bucket is capped or skipped.
Buckets with the same members are compared once.  The brute force intersects
whole sets, of 32-bit hashes there (a pair's count is off by one with a
probability below the product of its sizes over 2**32), and a pair that meets in several buckets
counts only in the first of them.  Within a bucket, links become counts and one
edge from each node to the least node of its connected part; pairs never
become rows.  Classes are the connected parts of all edges, found by
alternating large-star and small-star steps.

Tables that are read several times are checkpointed in the shared folder;
nothing of the documents reaches the driver but counts.

Defined cases: a null or blank text has no token and no link, each a class of
its own; a text of fewer than ``N`` words is one token; rows are counted as
they come, so a repeated row is a copy; a null id has class of the others in
its class, or null; very long texts have all their tokens; an empty table gives
no row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import fresh, stored, tidy, words
from postlens.session import cut_lineage

N, SIMILARITY, RECALL, SPREAD = 5, 0.8, 0.9999, 2.0
#: Steps at most; nodes of a bucket that is compared without further steps; nodes and tokens of a block.
DEPTH, SMALL, BLOCK, BLOCK_TOKENS = 6, 2048, 1024, 2_000_000
#: A token of at most so many nodes of a bucket is counted by its pairs, others by matrix products.
RARE = 12
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(recall: float = RECALL, spread: float = SPREAD) -> int:
    """Repetitions after which a pair at the threshold is found with probability ``recall``."""
    alive = 1.0
    for _ in range(200):
        alive = 1 - math.exp(-spread * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def tokens(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's word n-grams."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own := words(text)), np.uint64, len(own))
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        size = max(1, len(h) - N + 1)
        total = np.zeros(size, np.uint64)
        for k in range(min(N, len(h))):
            total = total * PRIME + h[k:k + size]
        return np.unique(_mixed(total + np.uint64(min(N, len(h)))))


def shortened(own: np.ndarray) -> bytes:
    """The sorted upper halves of the hashes, as they are kept for steps and comparisons."""
    return np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes()


def step(places: np.ndarray, own: np.ndarray, spread: float = SPREAD) -> list[np.ndarray]:
    """For each place in the tree, the places that a set is passed on to."""
    limit = np.uint64(min(1.0, spread / (SIMILARITY * len(own))) * (2**64 - 2**12))
    out = []
    with np.errstate(over="ignore"):
        for place in places:
            h = _mixed(own ^ _mixed(place + PRIME))
            out.append(_mixed(own[h <= limit] * PRIME + place))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@tidy
def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, set digest, size and the buckets two steps below the roots of all runs."""
    roots = np.arange(1, runs() + 1, dtype=np.uint64)
    for batch in batches:
        digests, sizes, paths = [], [], []
        for text in batch.column("text").to_pylist():
            own = tokens(text)
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            sizes.append(len(own))
            if not len(own):
                paths.append(None)
                continue
            first = np.concatenate(step(roots, own))
            second = np.concatenate([*step(first, own), np.zeros(0, np.uint64)])
            paths.append(_signed(np.unique(second)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("doc_id"), batch.column("own"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(paths, pa.list_(pa.int64()))],
            names=["key", "doc_id", "own", "node", "size", "paths"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets, in place of their texts, of rows whose text still has the wanted digest."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):  # few sets are held at a time
            part = batch.slice(lo, 500)
            keep, found = [], []
            for i, (text, node) in enumerate(zip(part.column("text").to_pylist(), part.column("node").to_pylist(), strict=True)):
                own = tokens(text)
                if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == node:
                    keep.append(i)
                    found.append(shortened(own))
            rest = [n for n in part.schema.names if n != "text"]
            kept = part.select(rest).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.binary())], names=[*rest, "tokens"])


@tidy
def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of buckets that a node goes on to."""
    for batch in batches:
        parents, parts, shorts, sizes = [], [], [], []
        for short, raw, buckets in zip(*(batch.column(c).to_pylist() for c in ("short", "tokens", "buckets")), strict=True):
            own = np.frombuffer(raw, np.uint32).astype(np.uint64)
            places = np.array(buckets, np.int64)
            for parent, more in zip(buckets, step(places.view(np.uint64), own), strict=True):
                more = _signed(np.unique(more)).tolist()
                parents += [parent] * len(more)
                parts += more
                shorts += [short] * len(more)
                sizes += [len(own)] * len(more)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in ((parents, pa.int64()), (parts, pa.int64()), (shorts, pa.int64()), (sizes, pa.int32()))],
                                         names=["parent", "bucket", "short", "size"])


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, buckets: list[np.ndarray], bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of ``left`` with ``right`` that reach the similarity: both ends, and whether this bucket is the first
    one where they meet.  If ``left`` is ``right``, each pair comes once."""
    same = left is right
    use = left if same else np.concatenate([left, right])
    n_left, n_right = len(left), len(right)
    sizes = np.array([len(own) for own in sets])
    _, ids, times = np.unique(np.concatenate([sets[i] for i in use]), return_inverse=True, return_counts=True)
    order = np.argsort(ids, kind="stable")
    row = np.repeat(np.arange(len(use)), sizes[use])[order]  # the nodes of each token, in order
    start = np.cumsum(times) - times
    common = np.zeros(n_left * n_right, np.float32)
    for n in range(2, RARE + 1):
        at = start[times == n]
        for i in range(n) if len(at) else ():
            for j in range(i + 1, n):
                x, y = row[at + i], row[at + j] - (0 if same else n_left)
                if not same:
                    ok = (x < n_left) & (y >= 0)
                    x, y = x[ok], y[ok]
                np.add.at(common, x * n_right + y, 1)
    common = common.reshape(n_left, n_right)
    often = np.flatnonzero(times > RARE)
    for lo in range(0, len(often), 4096):
        some = often[lo:lo + 4096]
        m = np.zeros((len(use), len(some)), np.float32)
        col = np.repeat(np.arange(len(some)), times[some])
        m[row[np.repeat(start[some] - np.cumsum(times[some]) + times[some], times[some]) + np.arange(len(col))], col] = 1
        common += m @ m.T if same else m[:n_left] @ m[n_left:].T
    total = sizes[left][:, None] + sizes[right][None, :]
    hit = common >= SIMILARITY * (total - common) - 1e-6 * total
    if same:
        hit &= np.triu(np.ones(hit.shape, bool), 1)
    i, j = np.nonzero(hit)
    x, y = left[i], right[j]
    # earlier buckets that both are in
    before = {b: k for k, b in enumerate(sorted({int(b) for r in np.unique(np.r_[x, y]) for b in buckets[r] if b < bucket}))}
    first = np.ones(len(x), bool)
    if before:
        member = np.zeros((len(sets), len(before)), bool)
        for r in np.unique(np.r_[x, y]):
            member[r, [before[int(b)] for b in buckets[r] if b < bucket]] = True
        for lo in range(0, len(x), 4096):
            first[lo:lo + 4096] = ~(member[x[lo:lo + 4096]] & member[y[lo:lo + 4096]]).any(1)
    return x, y, first


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index that each index is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@tidy
def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket or pair of blocks; rows of one stand together."""
    out: list[list] = [[], [], []]

    def emit() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())],
                                          names=["node", "least", "links"])
        for c in out:
            c.clear()
        return done

    def work(group: list[tuple]) -> None:
        bucket, one, two = group[0][:3]
        rows = {r[4]: r for r in group}  # a node may come from rows that share its key
        rows = sorted(rows.values(), key=lambda r: r[4])
        sets = [np.frombuffer(r[6], np.uint32) for r in rows]
        block = np.array([r[3] for r in rows])
        left = np.flatnonzero(block == one)
        right = left if one == two else np.flatnonzero(block == two)
        if not len(left) or not len(right):
            return
        x, y, first = compare(sets, left, right, [r[7] for r in rows], bucket)
        if not len(x):
            return
        copies = np.array([r[5] for r in rows], np.int64)
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, x[first], copies[y[first]])
        np.add.at(links, y[first], copies[x[first]])
        label = _least(len(rows), x, y)
        for i in np.unique(np.r_[x, y]).tolist():
            out[0].append(rows[i][4])
            out[1].append(rows[label[i]][4])
            out[2].append(int(links[i]))

    group: list[tuple] = []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "one", "two", "block", "node", "copies", "tokens", "buckets")]
        for r in zip(*cols, strict=True):
            if group and group[0][:3] != r[:3]:
                work(group)
                group = []
            group.append(r)
        if len(out[0]) > 1000:
            yield emit()
    if group:
        work(group)
    if out[0]:
        yield emit()


def _sums(members: DataFrame, *more: str) -> DataFrame:
    return members.groupBy("bucket", *more).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("short")).alias("who"),
                                                F.sum(F.col("size").cast("long")).alias("n_tokens"))


def _distinct(sums: DataFrame) -> DataFrame:
    """One bucket of those with the same members."""
    return sums.groupBy("n", "who").agg(F.min("bucket").alias("bucket"), F.first("n_tokens").alias("n_tokens")).select("bucket", "n", "n_tokens")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of all documents, ``(key, doc_id, own, node)`` with ``own`` the hash of the text, and the linked nodes' rows ``(node, least, links)``: an edge
    to a node of the same class, and links of other sets, to be added up."""
    # the key of a row is its id, or a hash of its text where that is null
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).cast("long").alias("key"), F.xxhash64("text").alias("own"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    nodes = cut_lineage(rows.mapInArrow(_begin, f"key long, doc_id {kind}, own long, node binary, size int, paths array<long>"))
    sets = nodes.where("node is not null").groupBy("node").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"))
    sets = sets.withColumn("short", F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long"))
    members = sets.select("short", "size", F.explode("paths").alias("bucket"))
    # most buckets have one node; they go before anything else is added up
    company = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("_bucket"))
    live = cut_lineage(members.join(company, F.col("bucket") == F.col("_bucket")).drop("_bucket"))
    sums = _sums(live)
    small = _distinct(sums.where(F.col("n") <= SMALL))
    large = sums.where(F.col("n") > SMALL).select("bucket", "n", "n_tokens")
    buckets = small.withColumn("open", F.lit(False)).union(large.withColumn("open", F.lit(True)))
    live = cut_lineage(live.join(buckets, "bucket").select("bucket", "n", "n_tokens", "open", "short"))
    texts = rows.select("key", "text").withColumnRenamed("key", "_key")
    known = sets.select(F.col("short").alias("_short"), "node", "key", "copies")

    def with_tokens(of: DataFrame, more: str) -> DataFrame:
        """Rows of ``short`` and more, with the nodes' digest, copies and tokens."""
        wanted = of.join(known, F.col("short") == F.col("_short")).drop("_short")
        kinds = f"short long, {more}, node binary, copies long, tokens binary"
        return texts.join(wanted, F.col("key") == F.col("_key")).drop("key", "_key").select(*of.columns, "node", "copies", "text").mapInArrow(_sets, kinds)

    final = [live.where(~F.col("open")).select("bucket", "n", "n_tokens", "short")]
    now = live.where("open").select("bucket", "n", "n_tokens", "short")
    open_sets = None
    for _ in range(3, DEPTH + 1):
        if now.isEmpty():
            break
        if open_sets is None:
            open_sets = cut_lineage(with_tokens(now.groupBy("short").agg(F.first("n").alias("n")), "n long").select("short", "tokens"))
        of = now.groupBy("short").agg(F.collect_list("bucket").alias("buckets"))
        parts = open_sets.join(of, "short").select("short", "tokens", "buckets").mapInArrow(_split, "parent long, bucket long, short long, size int")
        parts = cut_lineage(parts)
        sums = _sums(parts, "parent").where("n > 1")
        held = now.select("bucket", "n").distinct().join(
            sums.groupBy(F.col("parent").alias("bucket")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")), "bucket", "left")
        # buckets whose parts hold as many pairs as they do are compared whole
        dense = held.where(F.col("pairs") >= F.col("n") * (F.col("n") - 1)).select(F.col("bucket").alias("_dense"))
        final.append(cut_lineage(now.join(dense, F.col("bucket") == F.col("_dense"), "left_semi")))
        sums = sums.join(dense, F.col("parent") == F.col("_dense"), "left_anti")
        small = _distinct(sums.where(F.col("n") <= SMALL))
        large = sums.where(F.col("n") > SMALL).select("bucket", "n", "n_tokens")
        buckets = small.withColumn("open", F.lit(False)).union(large.withColumn("open", F.lit(True)))
        below = cut_lineage(parts.select("bucket", "short").join(buckets, "bucket").select("bucket", "n", "n_tokens", "open", "short"))
        final.append(below.where(~F.col("open")).drop("open"))
        now = below.where("open").drop("open")
    final.append(now)
    every = final[0]
    for more in final[1:]:
        every = every.union(more)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_tokens") / BLOCK_TOKENS)).cast("int")
    of = every.groupBy("short").agg(F.collect_set(F.struct("bucket", blocks.alias("blocks"))).alias("found"))
    of = of.select("short", "found")
    kind = "found array<struct<bucket:bigint,blocks:int>>"
    rows = with_tokens(of, kind).select("node", "copies", "tokens", F.transform("found", lambda x: x["bucket"]).alias("buckets"), F.explode("found").alias("f"))
    block = F.pmod(F.xxhash64("node", "f.bucket"), F.col("f.blocks")).cast("int")
    rows = rows.select("node", "copies", "tokens", "buckets", "f.bucket", F.col("f.blocks").alias("blocks"), block.alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    rows = rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    pairs = rows.select("bucket", "one", "two", "block", "node", "copies", "tokens", "buckets")
    return nodes.select("key", "doc_id", "own", "node"), cut_lineage(pairs.mapInArrow(_brute, "node binary, least binary, links long"))


def keyed(rows: DataFrame, of: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the values of ``of``, which has one row for each ``key`` and the number ``n`` of ``rows`` with it.
    Both are stored tables.  Keys with more than a thousandth of all rows, at most 1000 of them, are sent to the tasks;
    the other rows are joined."""
    values = [c for c in of.columns if c not in (key, "n")]
    own = of.select(F.col(key).alias("_key"), "n", F.struct(*values).alias("_of"))
    often = F.col("n") > max(100, total // 1000)
    held = rows.join(F.broadcast(own.where(often).drop("n")), F.col(key) == F.col("_key"), "left").drop("_key")
    rest = held.where(F.col("_of").isNull()).drop("_of").join(own.where(~often).drop("n"), F.col(key) == F.col("_key")).drop("_key")
    return held.where(F.col("_of").isNotNull()).unionByName(rest).select(*rows.columns, "_of.*")


def connected(edges: DataFrame) -> DataFrame:
    """The least node of each node's connected part, from edges ``(a, b)``: rows ``(a, b)`` with b the least."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        # large star: a node's larger neighbours go to its least one
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m")), "edges-low")
        total = low.agg(F.sum("n")).first()[0] or 0
        large = stored(keyed(both, low, "a", total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges-large")
        # small star: a node and its smaller neighbours go to the least of these
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "edges-low")
        small = keyed(large, low, "a", total).select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges
        before = now


def _labelled(docs: DataFrame) -> DataFrame:
    """``key, doc_id, own, node, part, class_id, n_links`` and ``first``: the least key of its class's rows without an id."""
    nodes, found = links(docs)
    others = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("others"))
    parts = connected(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    copies = nodes.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min("key").alias("first"))
    sets = copies.join(parts, F.col("node") == F.col("a"), "left").withColumn("part", F.coalesce("b", "node"))
    sets = sets.join(others, F.col("node") == F.col("_node"), "left")
    sets = cut_lineage(sets.select("node", "part", "low", F.col("first").alias("key"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "copies"))
    lows = cut_lineage(sets.groupBy("part").agg(F.min("low").alias("class_id"), F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    total = sets.agg(F.count(F.lit(1)), F.sum("copies")).first()
    sets = cut_lineage(keyed(sets.drop("low", "key"), lows, "part", total[0]).withColumnRenamed("copies", "n"))
    # rows without a word are classes of their own
    known = keyed(nodes.where("node is not null"), sets, "node", total[1] or 0)
    alone = nodes.where("node is null").select("key", "doc_id", "own", "node", F.lit(None).cast("binary").alias("part"), F.col("doc_id").alias("class_id"),
                                               F.lit(0).cast("long").alias("n_links"), F.col("key").alias("first"))
    return known.select(*alone.columns).unionByName(alone)


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of each document: the least id of its class, and the number of other documents
    whose similarity to it reaches the threshold."""
    return _labelled(docs).select("doc_id", "class_id", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: one with its least id, or, if none of its rows has an id, one with the
    least hash of its text.  Rows without a word are classes of their own, but repeated rows of one id stay once.  Rows
    that share an id are told apart by their texts: of those in one class the one with the least hash stays, and of
    equal texts the one with the least hash of its columns."""
    of = _labelled(docs.select("doc_id", "text"))
    keep, key, own, null = fresh(docs, "kept_key"), fresh(docs, "row_key"), fresh(docs, "row_own"), fresh(docs, "row_null")
    firsts = of.where("class_id = doc_id or (class_id is null and doc_id is null and key = first)") \
        .groupBy(F.col("key").alias(keep), F.col("doc_id").isNull().alias("_null"), "part").agg(F.min("own").alias("_own")).drop("part").distinct()
    out = docs.withColumn(key, F.coalesce("doc_id", F.xxhash64("text")).cast("long")) \
        .withColumn(own, F.xxhash64("text")).withColumn(null, F.col("doc_id").isNull())
    out = out.join(firsts, (F.col(key) == F.col(keep)) & (F.col(null) == F.col("_null")) & (F.col(own) == F.col("_own")), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    return out.groupBy(key, own, null).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias(keep)).select(f"{keep}.*")
