"""Records that differ only in formatting, collapsed and counted.

Recursive radix partitioning on canonical bytes: oversized buckets are split by further bytes until each fits, then each
bucket is counted in a trie with terminal counters. Copies are counted in tries on the map side first, so that a record
with a third of all rows reaches the buckets as one entry per partition.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.plans.context import cut, cut_counted, forget
from sparkforest.plans.groups import map_rows

BUCKET_ROWS = 200_000
TRIE_KEYS = 200_000
#: Bytes by which an oversized bucket is split further in a round.
RADIX_BYTES = 2
OUT_ROWS = 10_000
HOT_PARTS = 10_000
HOT_LEAST = 100_000
SEP = "\x1f"
COUNTED = "key binary, n_copies bigint, keep_id bigint"


class CountingTrie:
    """A byte trie with terminal counters. Nodes hold suffixes in a small table and burst into children by the next byte when it fills."""

    __slots__ = ("table", "children", "end")
    BURST = 2_048

    def __init__(self) -> None:
        self.table: dict[bytes, list[int]] | None = {}
        self.children: dict[int, CountingTrie] = {}
        self.end: list[int] | None = None

    def add(self, key: bytes, n: int, keep: int) -> bool:
        """Counts n copies of key of which the smallest id is keep; True if the key is new."""
        node, at = self, 0
        while node.table is None:
            if at == len(key):
                if node.end is None:
                    node.end = [n, keep]
                    return True
                node.end[0] += n
                node.end[1] = min(node.end[1], keep)
                return False
            b = key[at]
            child = node.children.get(b)
            if child is None:
                child = node.children[b] = CountingTrie()
            node, at = child, at + 1
        suffix = key[at:]
        hit = node.table.get(suffix)
        if hit is not None:
            hit[0] += n
            hit[1] = min(hit[1], keep)
            return False
        node.table[suffix] = [n, keep]
        if len(node.table) > self.BURST:
            node._burst()
        return True

    def _burst(self) -> None:
        table, self.table = self.table, None
        for suffix, (n, keep) in table.items():
            self.add(suffix, n, keep)

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """Every key with its counter, in byte order."""
        todo: list[tuple[bytes, CountingTrie]] = [(prefix, self)]
        while todo:
            at, node = todo.pop()
            if node.table is not None:
                for suffix in sorted(node.table):
                    yield (at + suffix, *node.table[suffix])
                continue
            if node.end is not None:
                yield (at, *node.end)
            todo.extend((at + bytes((b,)), node.children[b]) for b in sorted(node.children, reverse=True))


def _emptied(trie: CountingTrie, least: int) -> Iterator[pa.RecordBatch]:
    """The records of a trie with at least so many copies, in byte order."""
    keys: list[bytes] = []
    copies: list[int] = []
    keep: list[int] = []
    for k, n, i in trie.items():
        if n < least:
            continue
        keys.append(k)
        copies.append(n)
        keep.append(i)
        if len(keys) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), pa.array(keep, pa.int64())], names=["key", "n_copies", "keep_id"])
            keys, copies, keep = [], [], []
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), pa.array(keep, pa.int64())], names=["key", "n_copies", "keep_id"])


def _pre_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows (key, row_id) of a partition in tries of bounded size."""
    trie, size = CountingTrie(), 0
    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            size += trie.add(k, 1, i)
        if size >= TRIE_KEYS:
            yield from _emptied(trie, 1)
            trie, size = CountingTrie(), 0
    yield from _emptied(trie, 1)


def _bucket_count(least: int):
    """Counts buckets out of entries (bucket, key, n_copies, keep_id) in the order of bucket and key: a trie each, emptied
    between two keys when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, last, bucket = CountingTrie(), 0, None, None
        for b in batches:
            for at, k, n, i in zip(*(b.column(c).to_pylist() for c in range(4))):
                if at != bucket or size >= TRIE_KEYS and k != last:
                    yield from _emptied(trie, least)
                    trie, size, bucket = CountingTrie(), 0, at
                size += trie.add(k, n, i)
                last = k
        yield from _emptied(trie, least)

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _merged(parts: list[tuple[bytes, int]], limit: int) -> list[bytes]:
    """The first keys of neighbouring parts put together as long as they fit: two successive ones never fit into one."""
    starts: list[bytes] = []
    held = limit + 1
    for first, n in sorted(parts):
        if held + n > limit:
            starts.append(first)
            held = 0
        held += n
    return starts


def radix_starts(counted: DataFrame, limit: int, entries: int | None = None) -> list[bytes]:
    """The first keys of the buckets, ascending: no bucket has more than ``limit`` entries unless all its keys are equal, and
    two neighbours have more than ``limit`` together, so there are at most 2 entries/limit and one.

    Each round splits the oversized buckets by RADIX_BYTES more than their keys have in common. It reads the entries of
    these buckets only, which the round before has written apart. Small neighbouring parts are put together where they are
    counted, so that what reaches the driver is in proportion to entries/limit.
    """
    whole = counted.agg(F.count("*"), F.min("key"), F.max("key")).first() if entries is None or entries > limit else None
    if whole is None or whole[0] <= limit or whole[1] == whole[2]:
        return [b""]
    done: list[tuple[bytes, int]] = []
    # Oversized buckets: first key -> (key after the last, depth of the next split).
    open_: dict[bytes, tuple[bytes | None, int]] = {b"": (None, common_prefix(bytes(whole[1]), bytes(whole[2])) + RADIX_BYTES)}
    rows, first_round = counted.select("key"), True
    while open_:
        edges = sorted(open_)
        ends, depths = [open_[e][0] for e in edges], [open_[e][1] for e in edges]

        def split(batches: Iterator[pa.RecordBatch], edges=edges, ends=ends, depths=depths) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, where, prefix = [], [], []
                for k in b.column(0).to_pylist():
                    i = bisect_right(edges, k) - 1
                    if i >= 0 and (ends[i] is None or k < ends[i]):
                        keys.append(k)
                        where.append(i)
                        prefix.append(k[: depths[i]])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(where, pa.int32()), pa.array(prefix, pa.binary())], names=["key", "bucket", "prefix"])

        before, rows = rows, cut(rows.select("key").mapInArrow(split, "key binary, bucket int, prefix binary"))
        if not first_round:
            forget(before)
        first_round = False
        parts = rows.groupBy("bucket", "prefix").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        # Parts of more than half the limit stay alone; the others are put together by halves of the limit between two such.
        before_it = Window.partitionBy("bucket").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        large = F.col("n") > limit / 2
        bigs, slot = F.coalesce(F.count_if(large).over(before_it), F.lit(0)), F.floor(F.coalesce(F.sum(F.when(large, 0).otherwise(F.col("n"))).over(before_it), F.lit(0)) / (limit / 2))
        grouped = parts.select("bucket", "prefix", "n", "low", "high", bigs.alias("bigs"), F.when(large, F.lit(-1)).otherwise(slot).alias("slot"))
        found = grouped.groupBy("bucket", "bigs", "slot").agg(F.min("prefix").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r["bucket"], []).append((bytes(r["first"]), r["n"], bytes(r["low"]), bytes(r["high"])))
        grown: dict[bytes, tuple[bytes | None, int]] = {}
        for i, own in by.items():
            own.sort()
            # The first part keeps the bucket's own start, so that the buckets cover every key.
            firsts = [edges[i], *(p for p, *_ in own[1:])]
            nexts = [*firsts[1:], ends[i]]
            for first, after, (_, n, low, high) in zip(firsts, nexts, own):
                if n > limit and low != high:
                    grown[first] = (after, common_prefix(low, high) + RADIX_BYTES)
                else:
                    done.append((first, n))
        open_ = grown
    forget(rows)
    return _merged(done, limit)


def count_records(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, least: int = 1) -> DataFrame:
    """(key, n_copies, keep_id): one row per record of ``rows(key binary, row_id bigint)`` with at least ``least`` copies;
    keep_id is the smallest row_id. An empty table gives no record. Rows with a null key are left out.
    """
    partial, n = cut_counted(rows.select("key", "row_id").where(F.col("key").isNotNull()).mapInArrow(_pre_count, COUNTED))
    starts = rows.sparkSession.sparkContext.broadcast(radix_starts(partial, bucket_rows, n["rows"]))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = starts.value
        for b in batches:
            at = pa.array([bisect_right(of, k) - 1 for k in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([at, *b.columns], names=["bucket", "key", "n_copies", "keep_id"])

    shuffled = partial.mapInArrow(bucketed, "bucket int, " + COUNTED).repartition("bucket").sortWithinPartitions("bucket", "key")
    return shuffled.mapInArrow(_bucket_count(least), COUNTED)


def bare_text(column: str) -> F.Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"[^\p{L}\p{Nd}]+", ""))


def edge_operations(batches: DataFrame) -> DataFrame:
    """(row_id, key): canonical bytes of batch, operation and the two endpoints in either order.

    A null batch or operation is a value of its own. Rows in which an endpoint is null or has no letter or digit have no
    key. The canonical texts are columns of their own first, so that each is computed once a row.
    """
    bare = batches.select("row_id", "batch_id", "op", bare_text("node1").alias("a"), bare_text("node2").alias("b"))
    batch = F.coalesce(F.col("batch_id").cast("string"), F.lit("null"))
    op = F.coalesce(F.concat(F.lit("="), F.col("op")), F.lit("null"))
    key = F.concat(batch, F.lit(SEP), F.least("a", "b"), F.lit(SEP), F.greatest("a", "b"), F.lit(SEP), op)
    return bare.select("row_id", F.when((F.col("a") != "") & (F.col("b") != ""), key).cast("binary").alias("key"))


def edge_records(batches: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, batch_id, op, node_a, node_b, n_copies): one row per operation on an edge, endpoints in canonical form."""
    part = lambda i: F.split(F.col("key").cast("string"), SEP, 4)[i]
    return count_records(edge_operations(batches), bucket_rows).select(
        "keep_id",
        F.when(part(0) != "null", part(0).cast("bigint")).alias("batch_id"),
        F.when(part(3) != "null", F.substring(part(3), 2, 2**31 - 1)).alias("op"),
        part(1).alias("node_a"),
        part(2).alias("node_b"),
        "n_copies",
    )


def edge_copies(batches: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, row_id): every further copy of a record beside the row that is kept.

    Records with at least one part in HOT_PARTS of the rows, of which there are at most HOT_PARTS, are broadcast; the rows
    of the others meet their record in an ordinary shuffle, in which no key is hot any more.
    """
    rows = cut(edge_operations(batches).where(F.col("key").isNotNull()))
    records = cut(count_records(rows, bucket_rows, least=2))
    size, most = records.agg(F.coalesce(F.sum("n_copies"), F.lit(0)), F.coalesce(F.max("n_copies"), F.lit(0))).first()
    least = max(HOT_LEAST, size // HOT_PARTS + 1)
    cold = records.where(F.col("n_copies") < least).select("key", "keep_id")
    if most < least:
        pairs = rows.join(cold, "key")
    else:
        hot = F.broadcast(records.where(F.col("n_copies") >= least).select("key", "keep_id"))
        pairs = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key"))
    return pairs.where("row_id <> keep_id").select("keep_id", "row_id")
