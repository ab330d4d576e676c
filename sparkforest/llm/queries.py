"""Registered queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.llm import copies, garbled, mixing, packing, quantiles
from sparkforest.plans.context import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.edge_copies(table(spark, d, "edges_to_delete"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.edge_records(table(spark, d, "edges_to_delete"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.run_percentiles(table(spark, d, "output_data"))


def p4_day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.day_sketches(table(spark, d, "output_data"))


def p4_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.bounds_hold(table(spark, d, "output_data"))


def p4_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups that no sketch had to compact, whose percentiles are exact."""
    found = quantiles.run_percentiles(table(spark, d, "output_data")).where("n_values <= 50")
    return found.select("filename", "batch_size", "n_values", "p50", "p90", "p95", "p99")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p6_pack(spark, d), table(spark, d, "pack_sizes"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: the pages that lie in containers, and the containers that hold more than they can."""
    packs = table(spark, d, "pack_sizes").select("pack_name", "capacity_tokens")
    items = p6_pack(spark, d).where("piece_tokens > 0")
    full = items.groupBy("pack_name", "container_id").agg(F.sum("piece_tokens").alias("t")).join(F.broadcast(packs), "pack_name")
    over = full.groupBy("pack_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    return packs.join(items.groupBy("pack_name").agg(F.countDistinct("doc_id").alias("n_docs")), "pack_name").join(over, "pack_name")


def p7_select(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether no record is used more often than it may be, and whether the share is met within 0.01."""
    picked, shares = mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    most = picked.groupBy("mix_name", "source").agg(F.max("repeats").alias("most"))
    within = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats")
    met = (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.01).alias("met")
    return shares.join(F.broadcast(most), ["mix_name", "source"], "left").select("mix_name", "source", "target_share", "max_repeats", within, met)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore_garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p4_percentiles, p4_day_sketches, p4_bounds_hold, p4_exact_groups, p6_pack, p6_report, p6_kept, p7_select, p7_shares, p7_kept, p8_found, p8_restored)}

_CANON = r"""canon as (select row_id, batch_id, op, lower(regexp_replace(node1, '[^\p{L}\p{Nd}]', '', 'g')) a, lower(regexp_replace(node2, '[^\p{L}\p{Nd}]', '', 'g')) b from edges_to_delete),
  records as (select batch_id, op, least(a, b) node_a, greatest(a, b) node_b, min(row_id) keep_id, count(*) n_copies from canon where a <> '' and b <> '' group by 1, 2, 3, 4)"""

ORACLE = {
    "p2_found": f"with {_CANON} select r.keep_id, c.row_id from canon c join records r on r.batch_id is not distinct from c.batch_id and r.op is not distinct from c.op and r.node_a = least(c.a, c.b) and r.node_b = greatest(c.a, c.b) where c.a <> '' and c.b <> '' and c.row_id <> r.keep_id",
    "p4_exact_groups": "select filename, batch_size, count(*) n_values, quantile_disc(total_time, 0.5) p50, quantile_disc(total_time, 0.9) p90, quantile_disc(total_time, 0.95) p95, quantile_disc(total_time, 0.99) p99 from (select filename, batch_size, total_time from output_data qualify row_number() over (partition by coalesce(run_id, -row_id - 1) order by loaded_at desc, row_id desc) = 1) where total_time is not null and not isnan(total_time) and total_time <> 0 group by 1, 2 having count(*) <= 50",
    "p6_kept": "select pack_name, capacity_tokens, (select count(*) from documents where text <> '') n_docs, 0::bigint n_overfull from pack_sizes",
    "p7_kept": "select mix_name, source, target_share, max_repeats, true within_repeats, true met from mix_targets",
    "p4_bounds_hold": "select filename, batch_size, count(*) n_values, true holds from (select filename, batch_size, total_time from output_data qualify row_number() over (partition by coalesce(run_id, -row_id - 1) order by loaded_at desc, row_id desc) = 1) where total_time is not null and not isnan(total_time) and total_time <> 0 group by 1, 2",
    "p2_records": f"with {_CANON} select * from records",
}
