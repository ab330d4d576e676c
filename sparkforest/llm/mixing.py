"""Mixing sources to target shares of the tokens by Sainte-Laguë apportionment of equal-token blocks.

A mix is as large as the caps allow while every target is met. Its blocks go to the sources by highest quotients
share/(2k+1), a source at its cap (its tokens times max_repeats) drops out; a source's blocks are apportioned to its
shards in the same way. A shard's records, in a seeded order, form blocks of whole records, and blocks are drawn in
another seeded order up to the quota; what a source then lacks is filled with the records that come closest.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.llm.tokens import TOKENIZER, token_sizes
from sparkforest.plans.context import cut

BLOCKS = 100_000
SHARD_ROWS = 200_000
#: Records added, at most, to each source of a mix after its blocks; what they leave missing stays missing and shows in the shares.
FILLS = 12
MAX_TARGETS = 10_000
SELECTED = "mix_name string, source string, doc_id bigint, n_tokens bigint, repeats bigint"
SHARES = "mix_name string, source string, target_share double, max_repeats int, block_tokens bigint, quota_blocks bigint, available_tokens bigint, capped boolean"


def apportion(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Sainte-Laguë with caps: the seats that handing out one by one to the highest weight/(2k+1) gives, ties to the earlier.

    All but a few seats are given at once: with a divisor d every party has min(cap, floor(weight*d + 1/2)) seats, and the
    largest d that gives no more than ``seats`` leaves less than one for each party to be handed out one by one.
    """
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in live))
    given = lambda d: {i: min(caps[i], math.floor(weights[i] * d + 0.5)) for i in live}
    low, high = 0.0, 1.0
    while live and sum(given(high).values()) < seats:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        if sum(given(mid).values()) <= seats:
            low = mid
        else:
            high = mid
    got = [0] * len(weights)
    # A hair lower, so that no party at a tie has been served before the queue decides.
    for i, n in given(low * (1 - 1e-12)).items():
        got[i] = n
    rest = seats - sum(got)
    queue = [(-weights[i] / (2 * got[i] + 1), i) for i in live if got[i] < caps[i]]
    heapq.heapify(queue)
    while rest > 0 and queue:
        _, i = heapq.heappop(queue)
        got[i] += 1
        rest -= 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def mix_size(shares: list[float], tokens: list[int], repeats: list[int]) -> int:
    """The most tokens of which every source that has any can give its share; shares count among these sources only."""
    own = [(w, t * r) for w, t, r in zip(shares, tokens, repeats) if w > 0 and t * r > 0]
    return math.floor(min((t * sum(w for w, _ in own) / w for w, t in own), default=0))


def quotas(targets: list[dict], available: dict[str, int], blocks: int = BLOCKS, total_tokens: int | None = None) -> list[dict]:
    """One entry per target with its blocks; all mixes count in blocks of the same size, the smallest mix's over ``blocks``.

    The size of a mix is ``total_tokens``, by default the largest at which the caps leave every target in reach. Where
    caps leave a given size out of reach the mix is as large as they allow.
    """
    mixes = {}
    for mix in sorted({t["mix_name"] for t in targets}):
        own = [t for t in targets if t["mix_name"] == mix]
        tokens, most = [available.get(t["source"], 0) for t in own], [max(0, t["max_repeats"] or 0) for t in own]
        shares = [max(0.0, t["target_share"] or 0.0) for t in own]
        mixes[mix] = own, tokens, most, shares, mix_size(shares, tokens, most) if total_tokens is None else total_tokens
    block = max(1, min((size for *_, size in mixes.values() if size), default=1) // blocks)
    out = []
    for mix, (own, tokens, most, shares, size) in mixes.items():
        caps = [a * m // block for a, m in zip(tokens, most)]
        got = apportion(shares, caps, size // block)
        for t, a, c, g in zip(own, tokens, caps, got):
            out.append({"mix_name": mix, "source": t["source"], "target_share": t["target_share"], "max_repeats": t["max_repeats"], "block_tokens": block, "quota_blocks": g, "available_tokens": a, "capped": g >= c})
    return out


def _filled(base: DataFrame, gaps: list[tuple]) -> DataFrame | None:
    """(mix_name, source, doc_id, more): records that bring each source of a mix nearer to its quota.

    ``gaps`` has (mix_name, source, tokens missing). Every round adds to each source the one record, used less often than it
    may be, whose size is nearest to what is missing, if that helps; only one row a target reaches the driver.
    """
    spark = base.sparkSession
    left = {(m, s): g for m, s, g in gaps if g > 0}
    extra: dict[tuple, int] = {}
    for _ in range(FILLS):
        if not left:
            break
        want = F.broadcast(spark.createDataFrame([(m, s, g) for (m, s), g in left.items()], "mix_name string, source string, gap bigint"))
        free = base.join(want, ["mix_name", "source"]).where("repeats < most and n_tokens < 2 * gap")
        if extra:
            used = F.broadcast(spark.createDataFrame([(*k, n) for k, n in extra.items()], "mix_name string, source string, doc_id bigint, more bigint"))
            free = free.join(used, ["mix_name", "source", "doc_id"], "left").where("repeats + coalesce(more, 0) < most")
        nearest = free.groupBy("mix_name", "source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("n_tokens")).alias("off"), "draw", "doc_id", "n_tokens")).alias("r"))
        found = {(r["mix_name"], r["source"]): r["r"] for r in nearest.collect()}
        for k in list(left):
            if k not in found:
                del left[k]
                continue
            extra[(*k, found[k]["doc_id"])] = extra.get((*k, found[k]["doc_id"]), 0) + 1
            left[k] -= found[k]["n_tokens"]
            if left[k] <= 0:
                del left[k]
    return spark.createDataFrame([(*k, n) for k, n in extra.items()], "mix_name string, source string, doc_id bigint, more bigint") if extra else None


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = 0, blocks: int = BLOCKS, total_tokens: int | None = None, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: mix_name, source, doc_id, n_tokens, repeats - each record used in a mix with the times it is used, never more
    than max_repeats. shares: one row per target with quota, cap, selected_tokens and reached_share of the mix.
    ``sizes(doc_id, source, n_tokens)``, doc_id unique; records without source or tokens are in no mix. A source that is no
    target, or a target without records, gives nothing and is reported with 0. Equal target rows of a mix are an error.
    """
    spark = sizes.sparkSession
    wanted = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").where("mix_name is not null and source is not null").orderBy("mix_name", "source").limit(MAX_TARGETS + 1).collect()]
    if len(wanted) > MAX_TARGETS or len({(t["mix_name"], t["source"]) for t in wanted}) < len(wanted):
        raise ValueError("too many targets, or a source twice in a mix")
    named = F.broadcast(spark.createDataFrame([(s,) for s in sorted({t["source"] for t in wanted})], "source string"))
    sized = cut(sizes.select("source", "doc_id", "n_tokens").where("n_tokens > 0").join(named, "source", "left_semi"))
    per = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # a row per target at most
    planned = quotas(wanted, {s: r["t"] for s, r in per.items()}, blocks, total_tokens)
    block = planned[0]["block_tokens"] if planned else 1

    # Shards of a source: a seeded hash spreads its records over as many as keep each near shard_rows.
    shard_count = F.broadcast(spark.createDataFrame(sorted((s, -(-r["n"] // shard_rows)) for s, r in per.items()), "source string, shards bigint"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    sharded = sized.join(shard_count, "source").select("source", F.pmod(F.xxhash64(F.lit(~seed), "doc_id"), F.col("shards")).alias("shard"), "doc_id", "n_tokens", draw.alias("draw"))
    held: dict[str, list] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).orderBy("source", "shard").collect():  # a row for every shard_rows records
        held.setdefault(r["source"], []).append((r["shard"], r["t"]))
    rows = []
    for q in planned:
        shards = held.get(q["source"], [])
        caps = [t * (q["max_repeats"] or 0) // block + 1 for _, t in shards]
        for (shard, t), g in zip(shards, apportion([float(t) for _, t in shards], caps, q["quota_blocks"])):
            quota = min(g * block, t * (q["max_repeats"] or 0))
            rows.append((q["mix_name"], q["source"], shard, quota // t, quota % t, q["max_repeats"] or 0))
    quota = F.broadcast(spark.createDataFrame(rows, "mix_name string, source string, shard bigint, whole bigint, part bigint, most bigint"))

    # The records that begin in the same stretch of block tokens of the seeded order are a block; the windows share a shuffle.
    shard = Window.partitionBy("source", "shard")
    before = F.coalesce(F.sum("n_tokens").over(shard.orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cutted = sharded.withColumn("block", F.floor(before / block))
    lot = F.xxhash64(F.lit(seed + 1), "source", "shard", "block")
    up_to = cutted.withColumn("up_to", F.sum("n_tokens").over(shard.orderBy(lot, "block", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    drawn = up_to.withColumn("block_end", F.max("up_to").over(Window.partitionBy("source", "shard", "block")))
    times = F.col("whole") + (F.col("block_end") <= F.col("part")).cast("bigint")
    base = cut(drawn.join(quota, ["source", "shard"]).select("mix_name", "source", "doc_id", "n_tokens", "draw", F.least(times, "most").alias("repeats"), "most"))
    taken = {(r["mix_name"], r["source"]): r["t"] for r in base.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}
    more = _filled(base, [(q["mix_name"], q["source"], q["quota_blocks"] * block - taken.get((q["mix_name"], q["source"]), 0)) for q in planned])
    own = base if more is None else base.join(F.broadcast(more), ["mix_name", "source", "doc_id"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("more", F.lit(0)))
    selection = own.where("repeats > 0").select("mix_name", "source", "doc_id", "n_tokens", "repeats")
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("selected_tokens"), F.count("*").alias("records"))
    plan = spark.createDataFrame([tuple(q.values()) for q in planned], SHARES)
    filled = plan.join(F.broadcast(got), ["mix_name", "source"], "left").na.fill(0, ["selected_tokens", "records"])
    share = F.coalesce(F.try_divide("selected_tokens", F.sum("selected_tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0))
    return selection, filled.withColumn("reached_share", share)


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    return mix_sources(token_sizes(documents.where("source is not null"), "source", tokenizer=tokenizer), targets, seed)
