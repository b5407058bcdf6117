"""Places of rows in their groups, without a task that sees a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ._scratch import Scratch

#: Rows of a range partition.
PARTITION = 1 << 20


def placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str, strip: int) -> tuple[DataFrame, DataFrame]:
    """rows with part, strip (of at most `strip` rows), place (from 0 in its group `g`) and total; and (g, part, offset, total).

    Rows are sorted into range partitions by g and `order`, nulls first, so that a hot group is cut over several. Each row
    gets its place among its group's rows in the partition; the groups' counts in the partitions before are added.
    """
    spark = rows.sparkSession
    n = rows.select(F.count("*").alias("n")).first()["n"]
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64 + 1), -(-n // PARTITION))
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]

    def numbered(batches):
        part, seen, last, place = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            g = b["g"].dictionary_encode()
            codes, names = g.indices.to_numpy(), g.dictionary.to_pylist()
            out = np.zeros(len(codes), np.int64)
            cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
            for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(codes)], strict=False):
                place = place if names[codes[a]] == last else 0
                last = names[codes[a]]
                out[a:e] = np.arange(place, place + e - a)
                place += e - a
            strips = (np.arange(seen, seen + len(codes)) // strip).astype(np.int32)
            seen += len(codes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(strips), pa.array(out)], [*b.schema.names, "part", "strip", "local"])

    schema = f"{ddl(rows)}, part int, strip int, local bigint"
    local = scratch.keep(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(numbered, schema), f"{name}_local")
    group = W.partitionBy("g")
    counts = local.groupBy("g", "part").agg(F.count("*").alias("n"))
    offsets = scratch.keep(counts.select("g", "part", (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("offset"), F.sum("n").over(group).alias("total")), f"{name}_offsets")
    return local.join(offsets, ["g", "part"]).select(*rows.columns, "part", "strip", (F.col("local") + F.col("offset")).alias("place"), "total"), offsets


def ddl(rows: DataFrame) -> str:
    return rows._jdf.schema().toDDL()
