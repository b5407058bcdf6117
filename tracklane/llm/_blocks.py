"""Exchange of many small keyed entries between tasks as packed blocks.

Fingerprints of a whole corpus are too many for one JVM row each. A task packs
all entries for one bucket of keys into one row of binary columns; Spark
shuffles these rows and a task reads all blocks of its bucket. Two groupings
alternate: by `home`, a hash of the row, where the texts lie, and by `bucket`, a
hash of the key, where equal keys meet. Entries name a document by its home and
its place there, in the order of row hashes, which any rerun repeats.

A task first settles what it can among its own documents and sends one entry
for keys that it holds more than once, so a key that a third of all documents
hold costs its bucket one entry for each home, not for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

PER_PARTITION = 2
#: Text that one home holds on average, at most.
HOME_BYTES = 64 << 20


def count_of(documents: DataFrame, text_col: str = "text", per_partition: int = PER_PARTITION) -> int:
    """Groups to deal to: by the measured bytes of all texts, at least so many for each shuffle partition."""
    size = documents.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    return max(per_partition * max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-int(size) // HOME_BYTES))


def homed(documents: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, rid (of the row's id and text), home, and carried columns under names of our own. Null ids are kept."""
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    extra = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rid.alias("rid"), *extra).withColumn("home", F.pmod(F.col("rid"), F.lit(groups)).cast("int"))


def carried(ddl: str, rows: DataFrame, names: list[str]) -> StructType:
    """The schema `ddl` with the columns `names` of rows behind it."""
    out = StructType.fromDDL(ddl)
    for n in names:
        out = out.add(n, rows.schema[n].dataType)
    return out


def ordered(table: pa.Table) -> pa.Table:
    """The group's documents in the order by which entries name them."""
    return table.take(pa.array(np.argsort(table["rid"].to_numpy(), kind="stable")))


def ids_of(table: pa.Table) -> np.ndarray:
    """doc_id, a null as the largest number."""
    return table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()


def schema(to: str, fields: dict[str, type]) -> str:
    other = "home" if to == "bucket" else "bucket"
    return f"{to} int, {other} int, kind int, " + ", ".join(f"{k} binary" for k in fields)


def _coded(v: np.ndarray, name: str) -> bytes:
    """Bytes by significance, documents as differences: what Spark's block compression can shorten."""
    if name == "doc" and len(v):
        v = np.r_[v[:1], v[1:] - v[:-1]]
    return np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _decoded(raw: bytes, name: str, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(v, dtype=kind) if name == "doc" else v


def pack(to: str, target: np.ndarray, other, fields: dict[str, np.ndarray], kind: int = 0) -> pa.Table:
    """One row for each target among the entries; `other` is one number or one for each entry's target row."""
    order = np.argsort(target, kind="stable")
    t = target[order]
    cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(t)][: len(cuts)]
    cols = {to: pa.array(t[cuts], pa.int32()), ("home" if to == "bucket" else "bucket"): pa.array(np.full(len(cuts), other), pa.int32()), "kind": pa.array(np.full(len(cuts), kind), pa.int32())}
    for k, v in fields.items():
        v = v[order]
        cols[k] = pa.array([_coded(v[a:b], k) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.table(cols)


def empty(to: str, fields: dict[str, type]) -> pa.Table:
    return pack(to, np.zeros(0, np.int32), 0, {k: np.zeros(0, v) for k, v in fields.items()})


def unpack(table: pa.Table, fields: dict[str, type], other: str | None = None) -> dict[str, np.ndarray]:
    """The entries of all rows; `other` adds that column, repeated for each entry."""
    out = {k: np.concatenate([np.zeros(0, v), *(_decoded(x, k, v) for x in table[k].to_pylist())]) for k, v in fields.items()}
    if other:
        k, v = next(iter(fields.items()))
        sizes = np.array([len(x) for x in table[k].to_pylist()], np.int64) // np.dtype(v).itemsize
        out[other] = np.repeat(table[other].to_numpy().astype(np.int32), sizes)
    return out


def runs(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each run of equal sorted keys (and of equal further parts of keys)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = keys[1:] != keys[:-1]
    for m in more:
        new |= m[1:] != m[:-1]
    first = np.flatnonzero(np.r_[True, new])
    return first, np.diff(np.r_[first, len(keys)])


def bucket_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
