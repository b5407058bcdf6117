"""Declarative graphs of DataFrame steps: checked on the driver, composed lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


@dataclass
class Node:
    """A step from named DataFrames to one; `outputs` are the columns that it may add, None for any."""

    name: str
    step: Callable[..., DataFrame]
    depends: list[str] = field(default_factory=list)
    outputs: set[str] | None = None
    enabled: bool = True
    joins: bool = False


class Graph:
    def __init__(self, nodes: list[Node]):
        self.nodes = {n.name: n for n in nodes}
        if len(self.nodes) != len(nodes):
            raise ValueError("two nodes share a name")
        for n in nodes:
            if unknown := set(n.depends) - self.nodes.keys():
                raise ValueError(f"{n.name} depends on unknown {sorted(unknown)}")
            if len(n.depends) > 1 and not n.joins:
                raise ValueError(f"{n.name} has several inputs and is no join")
        self.order = self._sorted()
        self._check_paths()

    def _sorted(self) -> list[str]:
        left, order = {n: set(v.depends) for n, v in self.nodes.items()}, []
        while left:
            ready = [n for n, d in left.items() if not d]
            if not ready:
                raise ValueError(f"a cycle among {sorted(left)}")
            order += ready
            left = {n: d - set(ready) for n, d in left.items() if n not in ready}
        return order

    def _check_paths(self) -> None:
        """No node inherits from one ancestor by two paths, but through a join; the ancestor named is the lowest such one."""
        counts: dict[str, dict[str, int]] = {}
        for n in self.order:
            node = self.nodes[n]
            counts[n] = {}
            if node.joins:  # what lies behind a join is not inherited through it
                continue
            for d in node.depends:
                for a, k in {d: 1, **counts[d]}.items():
                    counts[n][a] = min(2, counts[n].get(a, 0) + k)
            twice = [a for a, k in counts[n].items() if k > 1]
            if twice:
                lowest = max(twice, key=self.order.index)
                raise ValueError(f"{n} inherits {lowest} twice: " + " and ".join(" > ".join(p) for p in self.two_paths(lowest, n)))

    def two_paths(self, source: str, target: str) -> list[list[str]]:
        """Up to two paths from one node to another, the first in the order of names."""
        after: dict[str, list[str]] = {n: sorted(m for m, v in self.nodes.items() if n in v.depends) for n in self.nodes}
        found: list[list[str]] = []
        stack = [[source]]
        while stack and len(found) < 2:
            path = stack.pop()
            if path[-1] == target:
                found.append(path)
            else:
                stack += [[*path, n] for n in reversed(after[path[-1]])]
        return found

    def degree(self, name: str) -> int:
        """Length of the longest path to the node."""
        return max((self.degree(d) + 1 for d in self.nodes[name].depends), default=0)

    def run(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Every node's DataFrame, its columns checked each time; nothing is computed yet."""
        made: dict[str, DataFrame] = {}
        for name in self.order:
            node = self.nodes[name]
            inputs = [made[d] for d in node.depends] or [sources[name]]
            if not node.enabled:
                made[name] = inputs[0]
                continue
            out = node.step(*inputs)
            before = set().union(*(i.columns for i in inputs))
            if node.outputs is not None and (extra := set(out.columns) - before - node.outputs):
                raise ValueError(f"{name} returns undeclared {sorted(extra)}")
            made[name] = out
        return made

    def dot(self, paths: list[list[str]] = ()) -> str:
        """DOT text: joins as diamonds, disabled nodes dashed, edges of the given paths in red."""
        red = {e for p in paths for e in zip(p, p[1:])}
        look = lambda v: ", ".join(x for x, on in (("shape=diamond", v.joins), ("style=dashed", not v.enabled)) if on)
        lines = [f'  "{n}"' + (f" [{look(v)}]" if look(v) else "") + ";" for n, v in self.nodes.items()]
        edges = [f'  "{d}" -> "{n}"' + (" [color=red, penwidth=3]" if (d, n) in red else "") + ";" for n, v in self.nodes.items() for d in v.depends]
        return "digraph {\n" + "\n".join(lines + edges) + "\n}"


def barrier(*inputs: DataFrame, on: tuple[str, ...] = ("frame",), once: bool = False) -> DataFrame:
    """Inner join of branches that share nothing but the keys. With `once`, a branch that brings the same keys twice makes the run fail."""
    seen: set[str] = set()
    for i in inputs:
        if missing := set(on) - set(i.columns):
            raise ValueError(f"an input lacks {sorted(missing)}")
        if both := seen & (set(i.columns) - set(on)):
            raise ValueError(f"several inputs have {sorted(both)}")
        seen |= set(i.columns) - set(on)
    if once:
        fail = F.raise_error(F.concat(F.lit("a branch brings the same keys twice: "), F.to_json(F.struct(*on))))
        inputs = [i.withColumn("_times", F.count("*").over(W.partitionBy(*on))).filter(F.when(F.col("_times") > 1, fail.cast("boolean")).otherwise(True)).drop("_times") for i in inputs]
    return reduce(lambda a, b: a.join(b, list(on)), inputs)


def checksums(made: dict[str, DataFrame]) -> DataFrame:
    """node, rows, hash of every node's rows, whatever their order: two runs agree if these do."""
    one = lambda n, d: d.select(F.xxhash64(*sorted(d.columns)).alias("h")).agg(F.lit(n).alias("node"), F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in made.items()])


def audit(made: dict[str, DataFrame], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, node, rows, hash of each node's rows of each key: fingerprints to hold against those of another run."""
    one = lambda n, d: d.groupBy(*keys).agg(F.lit(n).alias("node"), F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)")).cast("string").alias("hash"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in made.items()])


def unequal(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, node of fingerprints that only one of two audits holds."""
    by = [*keys, "node", "rows", "hash"]
    return a.join(b, by, "left_anti").select(*keys, "node").unionByName(b.join(a, by, "left_anti").select(*keys, "node")).distinct()


def write_audit(rows: DataFrame, path: str) -> None:
    """One JSON record a line."""
    rows.write.mode("overwrite").json(path)


def read_audit(spark: SparkSession, path: str, keys: str = "frame bigint") -> DataFrame:
    """Records of write_audit; malformed lines are skipped."""
    return spark.read.schema(f"{keys}, node string, rows bigint, hash string").option("mode", "DROPMALFORMED").json(path)


def same_under_stress(spark: SparkSession, build: Callable[[], dict[str, DataFrame]], partitions: tuple[int, ...] = (1, 13)) -> bool:
    """Whether a graph's rows are the same however its shuffles are dealt."""
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen.add(tuple(sorted(map(tuple, checksums(build()).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return len(seen) == 1
