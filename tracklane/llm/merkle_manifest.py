"""A Merkle manifest of a dataset: a leaf for each row, a subroot for each group, one root, and a proof for each row.

Leaves are sorted by group and order into range partitions. The counts of each
group in each partition, summed up, say where in its group a partition's first leaf
stands, so that every leaf has its coordinates: group, level 0, place. A strip of a
partition's leaves (at most `STRIP`) builds what complete runs of `ARITY` it holds, level by
level; nodes of runs that reach over its edges (no more than four a level) are
shuffled by coordinate, and blocks of `LEVELS` levels of a group's tree finish them,
round by round. The way back gives each of these nodes the steps to the root,
and strips put their own before them. The groups' subroots are the leaves of one
more tree, built likewise.

A proof is an array of steps from the leaf to the root, each with the digests that
stand left and right of the node in its run; `folded` computes the root from a leaf and
its proof. Digests are lowercase hexadecimal SHA-256 of their children's, as text.

Edge cases: nulls in a leaf's columns are `-`; null groups and null orders come
first; a group of one row has its leaf as subroot, and so has a dataset of one group its
subroot as root; rows alike in group and order stand in the order of their leaves, repeated rows
beside each other, each with its own proof; columns not named take no part, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._places import ddl, placed
from ._scratch import Scratch

ARITY = 3
#: Levels that one round finishes: a block has at most ARITY**LEVELS nodes.
LEVELS = 7
#: Leaves of a strip.
STRIP = 1 << 14
STEPS = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_NODE = "g string, level int, place bigint, total bigint, digest string"


def leaf(*columns: Column | str) -> Column:
    """SHA-256 of the columns one after another: `-` for null, else the UTF-8 byte count, `:` and the text."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _size(total: int, level: int) -> int:
    """Nodes of a level in a tree of `total` leaves."""
    for _ in range(level):
        total = -(-total // ARITY)
    return total


def _climbed(digests: list[str], lo: int, total: int):
    """For each level of a strip's part of a tree: (level, first place, digests, first and last child with a parent here)."""
    level = 0
    while True:
        m, hi = _size(total, level), lo + len(digests)
        first, last = -(-lo // ARITY), (-(-m // ARITY) if hi == m else hi // ARITY)
        up = m > 1 and last > first
        yield level, lo, digests, ARITY * first if up else hi, min(ARITY * last, m) if up else hi
        if not up:
            return
        rest = digests[ARITY * first - lo :]
        digests, lo, level = [_parent(rest[ARITY * k : ARITY * k + ARITY]) for k in range(last - first)], first, level + 1


def _parts(strip: pa.Table):
    """(group, total, place of the first leaf, leaf digests, rows) of each group in a strip."""
    groups, place = strip["g"].to_pylist(), strip["place"].to_numpy()
    order = sorted(range(len(groups)), key=lambda i: (groups[i], place[i]))
    digests, totals = strip["digest"].to_pylist(), strip["total"].to_numpy()
    k = 0
    while k < len(order):
        j = k
        while j < len(order) and groups[order[j]] == groups[order[k]]:
            j += 1
        rows = order[k:j]
        yield groups[rows[0]], int(totals[rows[0]]), int(place[rows[0]]), [digests[i] for i in rows], rows
        k = j


_EDGE = f"{_NODE}, part int, strip int"


def _edges(strip: pa.Table) -> pa.Table:
    """Nodes whose run reaches over the strip's edges, or that top their tree."""
    part, number = strip["part"][0].as_py(), strip["strip"][0].as_py()
    out = []
    for g, total, lo, digests, _ in _parts(strip):
        for level, at, nodes, first, last in _climbed(digests, lo, total):
            out += [(g, level, at + k, total, d) for k, d in enumerate(nodes) if not first <= at + k < last]
    cols = list(zip(*out, strict=True))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] + [pa.array([part] * len(out), pa.int32()), pa.array([number] * len(out), pa.int32())]
    return pa.table(made, names=["g", "level", "place", "total", "digest", "part", "strip"])


def _built(block: pa.Table, top: int):
    """All levels of a block up to `top` or the tree's own: {level: {place: digest}}."""
    levels: dict[int, dict[int, str]] = {}
    for level, place, digest in zip(block["level"].to_pylist(), block["place"].to_pylist(), block["digest"].to_pylist(), strict=True):
        levels.setdefault(level, {})[place] = digest
    total, k = block["total"][0].as_py(), min(levels)
    while k < top and _size(total, k) > 1:
        nodes, m = levels.get(k, {}), _size(total, k)
        above = levels.setdefault(k + 1, {})
        for p in {i // ARITY for i in nodes}:
            above[p] = _parent([nodes[i] for i in range(ARITY * p, min(ARITY * p + ARITY, m))])
        k += 1
    return levels, k, total


def _finished(block: pa.Table) -> pa.Table:
    """The node in which a block's nodes meet."""
    top = block["top"][0].as_py()
    levels, k, total = _built(block, top)
    ((place, digest),) = levels[k].items()
    names = {"g": block["g"][0].as_py(), "level": k, "place": place, "total": total, "digest": digest, "from_top": top, "from_block": block["block"][0].as_py()}
    kinds = {"g": pa.string(), "level": pa.int32(), "place": pa.int64(), "total": pa.int64(), "digest": pa.string(), "from_top": pa.int32(), "from_block": pa.int64()}
    return pa.table({c: pa.array([v], kinds[c]) for c, v in names.items()})


def _step(run: list[str], k: int) -> tuple[str, str]:
    return "".join(run[:k]), "".join(run[k + 1 :])


def _led(block: pa.Table, above: pa.Table) -> pa.Table:
    """The steps to the root of each of a block's nodes; `above` has those of the node in which they meet."""
    rest = [(s["left"], s["right"]) for s in above["steps"][0].as_py()] if len(above) else []
    levels, k, total = _built(block, block["top"][0].as_py())
    known = {(k, p): rest for p in levels[k]}
    for level in range(k - 1, min(levels) - 1, -1):
        m = _size(total, level)
        for p in levels.get(level, {}):
            lo = p - p % ARITY
            run = [levels[level][i] for i in range(lo, min(lo + ARITY, m))]
            known[level, p] = [_step(run, p - lo), *known[level + 1, p // ARITY]]
    steps = [[{"left": a, "right": b} for a, b in known[level, p]] for level, p in zip(block["level"].to_pylist(), block["place"].to_pylist(), strict=True)]
    return block.drop_columns(["top", "block", "digest", "total"]).append_column("steps", pa.array(steps, pa.list_(_STEP)))


class Forest:
    """The trees of all groups: `placed` leaves with their coordinates, the rounds' nodes, and `roots`, a row (g, digest) for each group."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str):
        """leaves: g (no nulls), order, digest, and columns to carry."""
        self.scratch, self.name, self.levels = scratch, name, LEVELS
        self.placed, offsets = placed(leaves, ["order", "digest"], scratch, name, STRIP)
        nodes = self.placed.select("g", "digest", "part", "strip", "place", "total").groupBy("part", "strip").applyInArrow(_edges, _EDGE)
        total, height = offsets.agg(F.max("total").alias("t")).first()["t"] or 1, 0
        while _size(total, height) > 1:
            height += 1
        self.rounds = []
        for k in range(max(1, -(-height // self.levels))):
            top = F.greatest(F.lit(self.levels * (k + 1)), F.col("level")).cast("int")
            width = F.element_at(F.array(*[F.lit(ARITY**d) for d in range(self.levels * (k + 1) + 1)]), F.col("top") - F.col("level") + 1)
            kept = scratch.keep(nodes.withColumn("top", top).withColumn("_width", width.cast("bigint")).withColumn("block", F.expr("place div _width")).drop("_width"), f"{name}_nodes{k}")
            self.rounds.append(kept)
            nodes = kept.groupBy("g", "top", "block").applyInArrow(_finished, f"{_NODE}, from_top int, from_block bigint")
        self.roots = scratch.keep(nodes, f"{name}_roots")

    def steps(self, above: DataFrame) -> DataFrame:
        """part, strip, g, level, place, steps of the nodes at strips' edges; `above`: g and the steps from its root on."""
        known = self.roots.join(above, "g").select("g", F.col("from_top").alias("top"), F.col("from_block").alias("block"), "steps")
        for k in range(len(self.rounds) - 1, -1, -1):
            block = self.rounds[k]
            schema = f"{ddl(block.drop('top', 'block', 'digest', 'total'))}, steps {STEPS}"
            led = block.groupBy("g", "top", "block").cogroup(known.groupBy("g", "top", "block")).applyInArrow(_led, schema)
            known = led.select("g", F.col("from_top").alias("top"), F.col("from_block").alias("block"), "steps") if k else led
        return self.scratch.keep(known, f"{self.name}_steps")

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves' columns, their group's root as `top`, what else `above` has of their group, and their proof."""
        edges = self.steps(above)
        tops = self.roots.select("g", F.col("digest").alias("top")).join(above.drop("steps"), "g")
        strips = self.placed.join(tops, "g")
        carried = [c for c in strips.columns if c not in ("part", "strip", "place", "total")]
        schema = f"{ddl(strips.select(*carried))}, proof {STEPS}"

        def proven(strip: pa.Table, edges: pa.Table) -> pa.Table:
            known = {(g, level, p): [(s["left"], s["right"]) for s in steps] for g, level, p, steps in zip(*(edges[c].to_pylist() for c in ("g", "level", "place", "steps")), strict=True)}
            left: list[str] = []
            right: list[str] = []
            path_of: list[list[int]] = [[] for _ in range(len(strip))]
            for g, total, lo, digests, rows in _parts(strip):
                tree = list(_climbed(digests, lo, total))
                paths: dict[int, list[int]] = {}
                for level, at, nodes, first, last in reversed(tree):
                    now = {}
                    for k in range(len(nodes)):
                        p = at + k
                        if first <= p < last:  # its run is whole here
                            a = p - p % ARITY
                            l, r = _step(nodes[a - at : min(a + ARITY, last) - at], p - a)
                            own, rest = [(l, r)], paths[p // ARITY]
                        else:
                            own, rest = known[g, level, p], []
                        now[p] = [*range(len(left), len(left) + len(own)), *rest]
                        left += [s[0] for s in own]
                        right += [s[1] for s in own]
                    paths = now
                for k, row in enumerate(rows):
                    path_of[row] = paths[lo + k]
            steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_STEP))
            cuts = pa.array(np.cumsum([0, *map(len, path_of)]), pa.int32())
            proof = pa.ListArray.from_arrays(cuts, steps.take(pa.array([k for p in path_of for k in p], pa.int64())))
            return strip.select(carried).append_column("proof", proof)

        return strips.groupBy("part", "strip").cogroup(edges.groupBy("part", "strip")).applyInArrow(proven, schema)


def manifest(rows: DataFrame, digest: Column, group: Column, order: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """The columns `carry`, leaf, subroot, root and proof of each row; trees of groups, whose subroots are ordered by the group's text."""
    scratch = Scratch(rows.sparkSession, "manifest")
    carry = carry or {}
    named = [c.alias(f"c{k}") for k, c in enumerate(carry.values())]
    leaves = rows.select(F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("")).alias("g"), order.alias("order"), digest.alias("digest"), *named)
    forest = Forest(leaves, scratch, "rows")
    crown = Forest(forest.roots.select(F.lit("").alias("g"), F.col("g").alias("order"), "digest"), scratch, "groups")
    start = crown.roots.select("g", F.expr(f"cast(array() as {STEPS})").alias("steps"))
    subroots = scratch.keep(crown.proofs(start).select(F.col("order").alias("g"), F.col("top").alias("root"), F.col("proof").alias("steps")), "subroots")
    return forest.proofs(subroots).select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(carry)], F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "proof")
