"""Items of varying length into containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of lengths, which the capacity bounds, reaches the driver. There, patterns of few items that fill a
container are fitted to the histogram by non-negative least squares, the repeat counts are rounded, and what the fit
leaves over is packed by best fit, all on counts. The result is a short table of index ranges; every executor applies
it to the ranks of its own items, so no item is ever collected.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.llm.tokens import TOKENIZER, token_sizes
from sparkforest.plans.context import cut

GRID = 512
LEVEL_STEP = 4
NNLS_ROUNDS = 300
SALT_ROWS = 50_000
MAX_PACKS = 1_000
ASSIGNED = "pack_name string, container_id bigint, doc_id bigint, piece_no bigint, piece_tokens bigint"


def full_patterns(grid: int) -> np.ndarray:
    """All multisets of one to three lengths 1..grid that add up to grid, as rows padded with 0."""
    a = np.arange(1, grid + 1)
    two = np.stack([a, grid - a], 1)
    two = two[(two[:, 0] >= two[:, 1]) & (two[:, 1] >= 1)]
    x, y = np.meshgrid(a, a, indexing="ij")
    z = grid - x - y
    ok = (x >= y) & (y >= z) & (z >= 1)
    three = np.stack([x[ok], y[ok], z[ok]], 1)
    return np.concatenate([[[grid, 0, 0]], np.pad(two, ((0, 0), (0, 1))), three]).astype(np.int64)


def nnls_patterns(patterns: np.ndarray, supply: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |A x - supply|, column j of A counting the lengths in pattern j; accelerated projected gradient.

    A has at most three entries a column, so A x and A' r are one bincount and one gather.
    """
    size = len(supply)
    flat = patterns.ravel()
    used = (flat > 0).astype(float)
    width = patterns.shape[1]

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, width) * used, minlength=size)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return (r[flat] * used).reshape(-1, width).sum(1)

    v = np.ones(len(patterns))
    for _ in range(12):  # the largest singular value, for the step
        w = back(forward(v))
        step = np.linalg.norm(w) / max(np.linalg.norm(v), 1e-12)
        v = w / max(np.linalg.norm(w), 1e-12)
    step = 1.0 / max(step * 1.05, 1e-12)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        grad = back(forward(y) - supply)
        new = np.maximum(0.0, y - step * grad)
        if np.dot(grad, new - x) > 0:  # momentum points uphill: start it anew
            t, y = 1.0, new
        else:
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y = new + (t - 1) / after * (new - x)
            t = after
        x = new
    return x


@dataclass
class Plan:
    """Item index (ascending length) -> bin by ``items`` (first, bin of the first), bin -> container by ``bins`` (first, container of the first, divisor)."""

    item_first: np.ndarray
    item_bin: np.ndarray
    bin_first: np.ndarray
    bin_container: np.ndarray
    bin_div: np.ndarray
    n_containers: int

    def containers(self, index: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.item_first, index, side="right") - 1
        bins = self.item_bin[at] + (index - self.item_first[at])
        at = np.searchsorted(self.bin_first, bins, side="right") - 1
        return self.bin_container[at] + (bins - self.bin_first[at]) // self.bin_div[at]


@dataclass
class _Packer:
    """Packs blocks of equal items. ``supply[length]`` holds (first index, count, is_bin) of items of that length not yet placed."""

    capacity: int
    supply: dict[int, deque] = field(default_factory=dict)
    items: list[tuple[int, int, int]] = field(default_factory=list)  # first item, count, first bin
    moved: list[tuple[int, int, int]] = field(default_factory=list)  # first unit bin, count, first top-level bin
    next_bin: int = 0
    next_container: int = 0
    free: dict[int, deque] = field(default_factory=dict)  # free tokens -> (first bin, count) of open top-level bins

    def put(self, length: int, first: int, n: int, unit: bool) -> None:
        if n:
            self.supply.setdefault(length, deque()).append((first, n, unit))

    def place(self, first: int, n: int, unit: bool, into: int) -> None:
        """n items from ``first`` on go to the bins from ``into`` on, one each."""
        if unit:
            self.moved.append((first, n, into))
        else:
            self.items.append((first, n, into))

    def take(self, lengths: list[deque], want: int) -> list[tuple[int, int, bool, int]]:
        out = []
        for length, q in lengths:
            while q and want:
                first, n, unit = q.popleft()
                m = min(n, want)
                if n > m:
                    q.appendleft((first + m, n - m, unit))
                out.append((first, m, unit, length))
                want -= m
        return out

    def level(self, size: int) -> list[tuple[int, int, int]]:
        """Fills bins of ``size`` with patterns; gives back (first bin, count, tokens used) of those filled."""
        q = -(-size // GRID)
        grid = size // q
        classes: dict[int, list] = {}
        for length in sorted(self.supply, reverse=True):
            if self.supply[length] and length <= size and (g := -(-length // q)) <= grid:
                classes.setdefault(g, []).append((length, self.supply[length]))
        have = np.zeros(grid + 1)
        for g, qs in classes.items():
            have[g] = sum(n for _, d in qs for _, n, _ in d)
        if not have.any():
            return []
        patterns = full_patterns(grid)
        ok = (have[patterns] > 0) | (patterns == 0)
        patterns = patterns[ok.all(1)]
        if not len(patterns):
            return []
        x = nnls_patterns(patterns, have)
        left = have.astype(np.int64)
        left[0] = 2**60
        filled = []
        whole = np.floor(x + 1e-9).astype(np.int64)
        by_count = np.argsort(-x, kind="stable")
        by_rest = np.argsort(-(x - whole), kind="stable")
        for order, want in ((by_count, whole), (by_rest, np.ones(len(x), dtype=np.int64))):
            for j in order[: int((x > 1e-6).sum())] if want is whole else order:
                if want is not whole and x[j] - whole[j] < 0.2:
                    break
                kinds, times = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
                n = int(min(want[j], (left[kinds] // times).min()))
                if n <= 0:
                    continue
                left[kinds] -= times * n
                filled += self.fill([classes[int(g)] for g, m in zip(kinds, times) for _ in range(m)], n)
        return filled

    def fill(self, slots: list[list], n: int) -> list[tuple[int, int, int]]:
        """n new bins with one item for each slot; runs of bins with the same lengths come out apart."""
        base, self.next_bin = self.next_bin, self.next_bin + n
        used = [(0, n, 0)]  # start within the n bins, count, tokens
        for qs in slots:
            at, parts = 0, []
            for first, m, unit, length in self.take(qs, n):
                self.place(first, m, unit, base + at)
                parts.append((at, m, length))
                at += m
            merged, i = [], 0
            for start, m, tokens in used:
                while m:
                    while parts[i][0] + parts[i][1] <= start:
                        i += 1
                    k = min(m, parts[i][0] + parts[i][1] - start)
                    merged.append((start, k, tokens + parts[i][2]))
                    start, m = start + k, m - k
                i = 0
            used = merged
        return [(base + s, m, t) for s, m, t in used]

    def rest(self) -> None:
        """Best fit, longest first, on blocks of equal items and bins of equal free space."""
        from bisect import bisect_left, insort

        keys = sorted(k for k, d in self.free.items() if d)
        for length in sorted(self.supply, reverse=True):
            d = self.supply[length]
            while d:
                first, n, unit = d.popleft()
                at = bisect_left(keys, length)
                if at == len(keys):
                    per = self.capacity // length
                    fresh = -(-n // per)
                    self.free.setdefault(self.capacity, deque()).append((self.next_bin, fresh))
                    self.next_bin += fresh
                    insort(keys, self.capacity)
                space = keys[at]
                bins = self.free[space]
                b, k = bins.popleft()
                m = min(n, k)
                self.place(first, m, unit, b)
                if k > m:
                    bins.appendleft((b + m, k - m))
                if not bins:
                    keys.pop(at)
                if n > m:
                    d.appendleft((first + m, n - m, unit))
                if space - length:
                    left = self.free.setdefault(space - length, deque())
                    if not left:
                        insort(keys, space - length)
                    left.append((b, m))
                else:
                    self.free.setdefault(0, deque()).append((b, m))

    def run(self, counts: np.ndarray) -> Plan:
        first = 0
        for length in range(1, len(counts)):
            self.put(length, first, int(counts[length]), False)
            first += int(counts[length])
        size, div = self.capacity, 1
        grouped: list[tuple[int, int, int]] = []  # first unit bin, containers, divisor
        while True:
            filled = self.level(size)
            if div == 1:
                for b, n, tokens in filled:
                    self.free.setdefault(self.capacity - tokens, deque()).append((b, n))
            else:
                for b, n, _ in filled:
                    whole = n // div
                    if whole:
                        grouped.append((b, whole, div))
                    self.put(size, b + whole * div, n - whole * div, True)
            if size <= GRID:
                break
            size, div = size // LEVEL_STEP, div * LEVEL_STEP
        self.rest()
        tops = sorted((b, n) for d in self.free.values() for b, n in d)
        table = []
        for b, n in tops:
            table.append((b, self.next_container, 1))
            self.next_container += n
        starts = np.array([b for b, _, _ in table], dtype=np.int64)
        for b, whole, k in grouped:
            table.append((b, self.next_container, k))
            self.next_container += whole
        for u, n, into in self.moved:
            # Units lie in one container run each or in several: follow the runs of the top-level bins.
            while n:
                i = int(np.searchsorted(starts, into, side="right")) - 1
                m = min(n, tops[i][0] + tops[i][1] - into)
                table.append((u, table[i][1] + into - tops[i][0], 1))
                u, into, n = u + m, into + m, n - m
        table.sort()
        self.items.sort()
        as_array = lambda rows, i: np.array([r[i] for r in rows], dtype=np.int64)
        return Plan(as_array(self.items, 0), as_array(self.items, 2), as_array(table, 0), as_array(table, 1), as_array(table, 2), self.next_container)


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """counts[n]: items of n tokens, 1 <= n <= capacity. Items are indexed by ascending length."""
    return _Packer(capacity).run(np.asarray(counts, dtype=np.int64))


def pack_documents(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """Every piece of ``sizes(doc_id, n_tokens)`` with its container, for every row of ``packs(pack_name, capacity_tokens)``.

    A document is one piece unless it exceeds the capacity; then it is cut into full pieces and a rest, numbered from 0. A
    document without tokens (null or empty text) has one piece of 0 tokens and no container (null). Containers are numbered
    from 0 without gaps within a pack. Packs without a positive capacity are left out; more than MAX_PACKS raise.
    """
    packing = [(r["pack_name"], r["capacity_tokens"]) for r in packs.select("pack_name", "capacity_tokens").where("capacity_tokens > 0").orderBy("pack_name").limit(MAX_PACKS + 1).collect()]
    if len(packing) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs")
    spark = sizes.sparkSession
    sized = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    rows = sized.count()
    salts = max(1, -(-rows // SALT_ROWS))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")

    # Pieces by pack, length and salt: at most (salts x distinct lengths) rows, whatever the documents hold.
    each = sized.withColumn("salt", salt).groupBy("salt", "n_tokens").agg(F.count("*").alias("n"))
    per_pack = []
    for i, (_, c) in enumerate(packing):
        t = F.col("n_tokens")
        pieces = F.array(F.struct((t % c).alias("len"), F.lit(1).cast("bigint").alias("k")), F.struct(F.lit(c).cast("bigint").alias("len"), F.floor(t / c).cast("bigint").alias("k")))
        per_pack.append(each.select(F.lit(i).alias("pack"), "salt", "n", F.explode(pieces).alias("p")).select("pack", "salt", F.col("p.len").alias("len"), (F.col("n") * F.col("p.k")).alias("n")).where("len > 0 and n > 0"))
    if not packing:
        return spark.createDataFrame([], ASSIGNED)
    by_salt = per_pack[0]
    for p in per_pack[1:]:
        by_salt = by_salt.unionByName(p)
    by_salt = cut(by_salt.groupBy("pack", "salt", "len").agg(F.sum("n").alias("n")))

    plans: list[Plan] = []
    starts: list[np.ndarray] = []
    histogram = by_salt.groupBy("pack", "len").agg(F.sum("n").alias("n")).toPandas()  # at most the sum of the capacities
    for i, (_, c) in enumerate(packing):
        own = histogram[histogram["pack"] == i]
        counts = np.zeros(c + 1, dtype=np.int64)
        counts[own["len"].to_numpy(dtype=np.int64)] = own["n"].to_numpy(dtype=np.int64)
        plans.append(plan_packing(counts, c))
        starts.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))

    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("pack", "len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_salt.select("salt", "pack", "len", F.coalesce(before, F.lit(0)).alias("a"))
    none = F.lit(None).cast("bigint")
    both = offsets.select("salt", F.col("pack").cast("int").alias("pack"), F.col("len").alias("x"), "a").unionByName(sized.select(salt.alias("salt"), F.lit(-1).alias("pack"), F.col("doc_id").alias("x"), F.col("n_tokens").alias("a"))).withColumn("x", F.coalesce("x", none))
    shared = spark.sparkContext.broadcast((packing, plans, starts))  # index ranges: bounded by the capacities
    names = [p for p, _ in packing]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        s, p = table.column("salt").to_numpy(), table.column("pack").to_numpy()
        a = table.column("a").to_numpy()
        xs = table.column("x")
        x = xs.fill_null(-1).to_numpy()
        packs_, plans_, starts_ = shared.value
        for one in np.unique(s):
            at = (s == one) & (p < 0)
            docs, tokens = xs.filter(pa.array(at)).combine_chunks(), a[at]
            docs = docs if isinstance(docs, pa.Array) else docs.chunk(0)
            for i, (_, c) in enumerate(packs_):
                full, rest = tokens // c, tokens % c
                pieces = np.maximum(1, full + (rest > 0))
                doc = np.repeat(np.arange(len(tokens)), pieces)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.where(no < full[doc], c, rest[doc])
                offset = np.zeros(c + 1, dtype=np.int64)
                own = (s == one) & (p == i)
                offset[x[own]] = a[own]
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                rank = np.empty(len(size), dtype=np.int64)
                rank[order] = np.arange(len(size)) - np.searchsorted(ranked, ranked, side="left")
                real = size > 0
                where = np.full(len(size), -1, dtype=np.int64)
                if real.any():
                    where[real] = plans_[i].containers(starts_[i][size[real]] + offset[size[real]] + rank[real])
                for k in range(0, len(doc), 50_000):
                    e = slice(k, k + 50_000)
                    n = len(doc[e])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i]] * n, pa.string()), pa.array(where[e], pa.int64(), mask=~real[e]), docs.take(pa.array(doc[e])), pa.array(no[e], pa.int64()), pa.array(size[e], pa.int64())],
                        names=["pack_name", "container_id", "doc_id", "piece_no", "piece_tokens"],
                    )

    return both.repartition(min(salts, 100_000), "salt").mapInArrow(assign, ASSIGNED)


def pack_report(assigned: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, pieces, tokens, containers, least_containers, overfull, fill): least_containers is ceil(tokens/capacity)."""
    per = assigned.where("container_id is not null").groupBy("pack_name", "container_id").agg(F.sum("piece_tokens").alias("t"), F.count("*").alias("k"))
    whole = packs.select("pack_name", "capacity_tokens").join(per.join(F.broadcast(packs.select("pack_name", F.col("capacity_tokens").alias("c"))), "pack_name").groupBy("pack_name").agg(F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.count("*").alias("containers"), F.count_if(F.col("t") > F.col("c")).alias("overfull")), "pack_name")
    return whole.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def packed(documents: DataFrame, packs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack_documents(token_sizes(documents, tokenizer=tokenizer), packs)
