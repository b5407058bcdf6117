"""Shards with the corpus's mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the rank as
a fraction of the source's rows, (rank - 1/2) / rows, spreads each source evenly
over 0 to 1. All rows in the order of that fraction are cut into shards of equal
counts, so each shard holds every source in proportion, up to a row.

No rank is taken in one task: counts of hash ranges (of a source) and of
fraction ranges (of all) give each range its first rank, and only rows of one
range are numbered together. A source with most of the rows is spread over all
its hash ranges. Built-in functions only.

Edge cases: a null source is a source of its own; rows alike in everything are
interchangeable; an empty table gives no rows; other columns are kept, but for
earlier ones named shard or slot, which the new ones replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Hash ranges of a source and fraction ranges of all, as a power of two. 4096 keep a range below 10 million rows up to 40 billion.
RANGE_BITS = 12


def interleave(rows: DataFrame, shards: int, stratum: str | Column = "source", keys: tuple[str, ...] = ("doc_id",), seed: int = 7, range_bits: int = RANGE_BITS) -> DataFrame:
    """`rows` with shard (0 to shards - 1) and slot (from 0 in each shard); counts of shards differ by one at most."""
    bits, n_ranges = range_bits, 1 << range_bits
    stratum = F.col(stratum) if isinstance(stratum, str) else stratum
    named = rows.select(F.struct(*[F.col(c) for c in rows.columns if c.lower() not in ("shard", "slot") or c in keys]).alias("_row"), F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("-")).alias("_stratum"), F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]).alias("_hash"))
    named = named.withColumn("_range", F.shiftright("_hash", 64 - bits))
    counts = named.groupBy("_stratum", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_stratum").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("_stratum", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(W.partitionBy("_stratum")).alias("_of"))
    rank = F.row_number().over(W.partitionBy("_stratum", "_range").orderBy("_hash", *[F.col(f"_row.{k}") for k in keys]))
    ranked = named.withColumn("_rank", rank).join(firsts, ["_stratum", "_range"])
    ranked = ranked.select("_row", "_stratum", ((2 * (F.col("_first") + F.col("_rank")) - 1) / (2 * F.col("_of"))).alias("_at"))
    ranked = ranked.withColumn("_range", F.least(F.floor(F.col("_at") * n_ranges), F.lit(n_ranges - 1)).cast("int"))
    counts = ranked.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over n_ranges rows
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(whole).alias("_of"))
    place = F.row_number().over(W.partitionBy("_range").orderBy("_at", "_stratum"))
    placed = ranked.withColumn("_place", place).join(firsts, "_range")
    placed = placed.withColumn("_place", F.col("_first") + F.col("_place") - 1).withColumn("_shard", F.expr(f"(_place * {shards}L) div _of"))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, F.col("_shard").cast("int").alias("shard"), (F.col("_place") - F.expr(f"(_shard * _of + {shards - 1}L) div {shards}L")).alias("slot"))
