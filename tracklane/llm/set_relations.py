"""Exact Jaccard self-join of word shingles with set-relation skipping.

Sets of shingles are compared through an inverted index of their prefixes: in
one order of all shingles, rare before frequent, two sets of similarity 0.8 must
share one of the first fifth of each. Index lists keep each set's size and the
shingle's position in it. A list is parted into size blocks, each in the order of
positions, and those into skip blocks of `SKIP` entries whose sizes and least
position bound what any of their sets can share with a probe; blocks ruled out
are skipped whole. Two relations between sets save the rest of the work:

* texts alike are one set: only the first row of equal texts is compared. Large
  lists are not paired off: each set is compared with the heads of its size block
  and with its neighbour. Heads are the sets that hold the list's shingle first,
  so have the fewest rare ones: of many near copies those nearest to all others;
* a set's answers follow from those of a similar set that has answered. Sets
  already in one component need no comparison, and for B and C compared with the
  same A, |B and C| <= min(|A and B|, |A and C|) + min(|B - A|, |C - A|), so only
  pairs of different components that this bound leaves open are compared.

Every link between different components is found, so components are exact; links
within a component are not all listed. Of a candidate pair the first set's marks,
two bits a shingle, go where the second lies: they bound what both can share from
above. Only pairs that this bound leaves possible are verified on whole sets.

Lists of shingles that the counts below call frequent are dealt to several tasks,
and the heads of their parts are compared in a further tier, part by part again
where there are many. Open pairs of a list are dealt by pairs of its blocks.
Shingles are counted in `2**SKETCH_BITS` counters over all texts (fixed size, 4
MB when broadcast), of which what a usual counter holds by chance is taken off;
any order is exact, this one keeps common passages out of prefixes.

Edge cases: texts of fewer words than a shingle have one shingle, of all their
words; texts without words, null ones too, have none and link with nothing; a
null id never names a component unless all its members' ids are null; repeated
rows each get a result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B, _graph, _text as X

SKETCH_BITS = 22
#: Classes of counts for each doubling.
FINE = 8
_PARTS = 64
#: Lists up to this size are paired off at once.
SHORT = 8
#: Sets of a size block with which all others of a large list are compared.
HEADS = 3
#: Entries of a list that one bound lets pass or skips.
SKIP = 64
#: Binary logarithm of the entries from which on a list is dealt to several tasks.
HOT_LOG = 12
#: Entries of a list in one side of a task of open pairs.
OPEN_BLOCK = 256
#: Values of a row's hash by which the texts of later comparisons are told from those that stay behind.
SLOTS = 1 << 20
#: Sizes of a class differ by less than this factor, which is more than similar sets differ.
CLASS = 1.3
_ENTRY = {"key": np.uint64, "node": np.int64, "n": np.uint32, "pos": np.uint32, "hot": np.uint8}
_ASK = {"doc": np.uint32, "home2": np.uint32, "doc2": np.uint32}
_LONG = {"lkey": np.uint64, "lnode": np.int64, "ln": np.uint32, "lpos": np.uint32}
_FIELDS = [*_ASK, *_LONG, *_ENTRY]
_MIXED = "home int, bucket int, kind int, " + ", ".join(f"{k} binary" for k in _FIELDS)
_SENT = "home int, kind int, src bigint, n bigint, words binary, targets binary, " + ", ".join(f"{k} binary" for k in _LONG)
_OUT = "kind int, a bigint, b bigint, na bigint, nb bigint, overlap bigint"
DOCUMENT, PAIR, LISTED, HEAD, RULED = 0, 1, 2, 3, 4


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles."""
    data, off = X.buffers(texts)
    _, _, doc, h = X.words(data, off, lower=True)
    first = X.starts_of(doc, len(off) - 1)
    g = X.grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(X.mix(X.grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def frequency_classes(documents: DataFrame, size: int, text_col: str = "text") -> bytes:
    """`FINE` times the logarithm of the count over the median one, for each counter."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in X.slices(batches, 4 * X.STEP):
            _, _, _, h = X.words(*X.buffers(part["text"]), lower=True)
            np.add(total, np.bincount((X.grams(h, size) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS), out=total, casting="unsafe")
        parts = np.minimum(total, 65535).astype("<u2").reshape(_PARTS, -1)
        keep = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in keep], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), "<u2").astype(np.uint64) for c in table["counts"].to_pylist())
        over = total - np.minimum(total, np.uint64(np.median(total)))
        return pa.table({"part": table["part"][:1], "counts": pa.array([np.minimum(np.floor(FINE * np.log2(over + np.uint64(1))), 255).astype(np.uint8).tobytes()], pa.binary())})

    rows = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((_PARTS, (1 << SKETCH_BITS) // _PARTS), np.uint8)
    for r in rows:  # at most _PARTS rows of fixed size
        out[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return out.tobytes()


def _fill(table: pa.Table) -> pa.Table:
    for n in _FIELDS:
        if n not in table.column_names:
            table = table.append_column(n, pa.array([b""] * len(table), pa.binary()))
    return table.select(["home", "bucket", "kind", *_FIELDS])


def _possible(ni, pi, nj, pj):
    """Sizes and positions (of a shared shingle) leave a similarity of 0.8 possible; ni <= nj."""
    ni, pi, nj, pj = (np.asarray(x).astype(np.int64) for x in (ni, pi, nj, pj))
    return (5 * ni >= 4 * nj) & (9 * (1 + np.minimum(ni - 1 - pi, nj - 1 - pj)) >= 4 * (ni + nj))


def _passing(n: np.ndarray, pos: np.ndarray, head: int) -> np.ndarray:
    """Entries (in the order of positions) that may be similar to the entry `head`: skip blocks first, then their entries."""
    starts = np.arange(0, len(n), SKIP)
    low, high, least = np.minimum.reduceat(n, starts).astype(np.int64), np.maximum.reduceat(n, starts).astype(np.int64), pos[starts].astype(np.int64)
    nh, ph = int(n[head]), int(pos[head])
    blocks = np.flatnonzero((9 * (1 + np.minimum(nh - 1 - ph, high - 1 - least)) >= 4 * (nh + low)) & (4 * low <= 5 * nh) & (5 * high >= 4 * nh))
    at = (blocks[:, None] * SKIP + np.arange(SKIP)).ravel()
    at = at[(at < len(n)) & (at != head)]
    swap = n[at] > nh
    return at[_possible(np.where(swap, nh, n[at]), np.where(swap, ph, pos[at]), np.where(swap, n[at], nh), np.where(swap, pos[at], ph))]


def _list_pairs(key, n, pos):
    """(first, second) indexes to compare, and which are heads, of entries sorted by key and size."""
    start, count = B.runs(key)
    end = np.repeat(start + count, count)
    short = np.repeat(count <= SHORT, count)
    at = np.arange(len(key))
    first, second, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, SHORT):
        i = at[: max(0, len(at) - k)]
        i = i[(i + k < end[i]) & (short[i] | (k == 1))]
        i = i[_possible(n[i], pos[i], n[i + k], pos[i + k])]
        first.append(i)
        second.append(i + k)
    for a, c in zip(start[count > SHORT].tolist(), count[count > SHORT].tolist(), strict=True):
        low = a
        while low < a + c:  # a size block: as far as the least size allows
            stop = max(low + 1, a + int(np.searchsorted(n[a : a + c], int(n[low]) * 5 // 4, "right")))
            block = low + np.argsort(pos[low:stop], kind="stable")
            for head in range(min(HEADS, len(block))):
                fits = block[_passing(n[block], pos[block], head)]
                first.append(np.full(len(fits), block[head]))
                second.append(fits)
            heads.append(block[:HEADS])
            low = stop
    return np.concatenate(first), np.concatenate(second), np.concatenate(heads), ~short


def similar_components(documents: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links of similarity 0.8 or more), rid (a hash of id and text), stays (in one row's id and text of each component)."""
    groups = B.count_of(documents, text_col)
    spark = documents.sparkSession
    counted = frequency_classes(documents, size, text_col)
    classes, hottest = spark.sparkContext.broadcast(counted), max(counted) // FINE
    homed = B.homed(documents, groups, id_col, text_col)
    keyed = homed.select("doc_id", "rid", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    # of equal texts the row that is compared: any one; least id for the component's name
    named = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    reps = _graph.checkpoint(keyed.groupBy("digest").agg(F.min("rid").alias("first"), F.min(named).alias("name"), F.count("*").alias("n")).withColumn("home", F.pmod("first", F.lit(groups)).cast("int")))
    here = reps.select("home", "first")

    def prefixes(table: pa.Table, firsts: pa.Table) -> pa.Table:
        cols = {k: [] for k in _ENTRY}
        if len(table) and len(firsts):
            home = table["home"][0].as_py()
            table = B.ordered(table)
            rows = np.searchsorted(table["rid"].to_numpy(), np.sort(firsts["first"].to_numpy()))
            known = np.frombuffer(classes.value, np.uint8)
            for i, s in zip(rows.tolist(), shingle_sets(table["text"].take(pa.array(rows)), size), strict=True):
                n = len(s)
                if not n:
                    continue
                order = known[s & np.uint64((1 << SKETCH_BITS) - 1)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                p = n - (4 * n + 4) // 5 + 1
                top = s[np.argsort(order, kind="stable")[:p]]
                cols["key"].append(top)
                cols["node"].append(np.full(p, home << 32 | i, np.int64))
                cols["n"].append(np.full(p, n, np.uint32))
                cols["pos"].append(np.arange(p, dtype=np.uint32))
                cols["hot"].append(known[top & np.uint64((1 << SKETCH_BITS) - 1)] // FINE)
        if not cols["key"]:
            return B.empty("bucket", _ENTRY)
        e = {k: np.concatenate(v) for k, v in cols.items()}
        return B.pack("bucket", parts_of(e["key"], e["node"], e["hot"]), home, e)

    def parts_of(key, node, hot) -> np.ndarray:
        """The task of each entry: one for a list, or by its set as well where the list is frequent."""
        parts = np.uint64(1) << np.maximum(hot.astype(np.int64) + 1 - HOT_LOG, 0).astype(np.uint64)
        return B.bucket_of(X.mix(key + X.mix(node.astype(np.uint64)) % parts), groups)

    def candidates(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        e = B.unpack(table, _ENTRY)
        order = np.lexsort((e["node"], e["n"], e["key"]))
        start, count = B.runs(e["key"][order])
        order = order[np.repeat(count > 1, count) | (e["hot"][order] >= HOT_LOG)]
        key, node, n, pos, hot = (e[k][order] for k in _ENTRY)
        i, j, heads, big = _list_pairs(key, n, pos)
        pair = np.stack([node[i], node[j]], 1)
        pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
        alone = np.repeat(B.runs(key)[1], B.runs(key)[1]) <= SHORT
        up = np.union1d(heads, np.flatnonzero(alone))  # what stands for a part of a frequent list
        up = up[hot[up] >= HOT_LOG]
        out = [_fill(_asked(pair[:, 0], pair[:, 1], bucket))]
        big |= hot >= HOT_LOG
        listed = {"lkey": key[big], "lnode": node[big], "ln": n[big], "lpos": pos[big]}
        out.append(_fill(B.pack("home", (node[big] >> 32).astype(np.int32), bucket, listed, kind=LISTED)))
        if len(up):
            less = np.maximum(hot[up].astype(np.int64) - HOT_LOG + 4, 0).astype(np.uint8)  # some heads of each part are left
            e = {"key": key[up], "node": node[up], "n": n[up], "pos": pos[up], "hot": less}
            out.append(_fill(B.pack("bucket", parts_of(e["key"], e["node"], less), bucket, e, kind=HEAD)))
        return pa.concat_tables(out)

    def sets_of(table: pa.Table, rows: np.ndarray) -> dict[int, np.ndarray]:
        rows = np.unique(rows.astype(np.int64))
        return dict(zip(rows.tolist(), shingle_sets(B.ordered(table)["text"].take(pa.array(rows)), size), strict=True)) if len(rows) else {}

    def mark(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table) or not len(asked):
            return _sent()
        kinds = asked["kind"].to_numpy()
        q = B.unpack(asked.filter(pa.array(kinds == 0)), _ASK)
        return pa.concat_tables([_passed(asked.filter(pa.array(kinds == LISTED))), _addressed(table["home"][0].as_py(), sets_of(table, q["doc"]), q["doc"], q["home2"], q["doc2"], _marks)])

    def sift(table: pa.Table, marked: pa.Table) -> pa.Table:
        if not len(table) or not len(marked):
            return _sent()
        home = table["home"][0].as_py()
        kinds = marked["kind"].to_numpy()
        pairs = marked.filter(pa.array(kinds == PAIR))
        sets = sets_of(table, np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(t, np.uint32) for t in pairs["targets"].to_pylist())]))
        src, doc, most, possible = [], [], [], []
        for a, n, marks, targets in zip(pairs["src"].to_pylist(), pairs["n"].to_pylist(), pairs["words"].to_pylist(), pairs["targets"].to_pylist(), strict=True):
            for t in np.frombuffer(targets, np.uint32).tolist():
                m = _most(marks, n, sets[t])
                src.append(a)
                doc.append(t)
                most.append(m)
                possible.append(9 * m >= 4 * (n + len(sets[t])))
        src, doc, most, possible = np.array(src, np.int64), np.array(doc, np.int64), np.array(most, np.int64), np.array(possible, bool)
        ruled = {"lkey": src[~possible].astype(np.uint64), "lnode": home << 32 | doc[~possible], "ln": most[~possible].astype(np.uint32), "lpos": np.zeros(int((~possible).sum()), np.uint32)}
        out = [_passed(marked.filter(pa.array(kinds == LISTED))), _passed(B.pack("home", np.full(len(ruled["lkey"]), home), 0, ruled, kind=RULED))]
        out.append(_addressed(home, sets, doc[possible], src[possible] >> 32, src[possible] & 0xFFFFFFFF, np.ndarray.tobytes))
        return pa.concat_tables(out)

    def verify(table: pa.Table, sent: pa.Table) -> pa.Table:
        out = {k: [] for k in ("kind", "a", "b", "na", "nb", "overlap")}

        def add(kind, a, b, na=0, nb=0, overlap=0):
            for k, v in (("kind", kind), ("a", a), ("b", b), ("na", na), ("nb", nb), ("overlap", overlap)):
                out[k].append(np.broadcast_to(np.asarray(v, np.int64), len(a)))

        if len(table) and len(sent):
            home = table["home"][0].as_py()
            table = B.ordered(table)
            kinds = sent["kind"].to_numpy()
            pairs = sent.filter(pa.array(kinds == PAIR))
            firsts = np.sort(sent.filter(pa.array(kinds == DOCUMENT))["src"].to_numpy())
            rows = np.searchsorted(table["rid"].to_numpy(), firsts)
            sets = sets_of(table, np.concatenate([rows, *(np.frombuffer(t, np.uint32) for t in pairs["targets"].to_pylist())]))
            add(DOCUMENT, firsts, home << 32 | rows, np.array([len(sets[p]) for p in rows.tolist()], np.int64))
            for src, n, raw, targets in zip(pairs["src"].to_pylist(), pairs["n"].to_pylist(), pairs["words"].to_pylist(), pairs["targets"].to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint64)
                for t in np.frombuffer(targets, np.uint32).tolist():
                    y = sets[t]
                    found = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                    add(PAIR, [home << 32 | t], [src], len(y), n, int(found.sum()))
            e = B.unpack(sent.filter(pa.array(kinds == RULED)), _LONG)
            add(RULED, e["lkey"].astype(np.int64), e["lnode"], overlap=e["ln"])
            e = B.unpack(sent.filter(pa.array(kinds == LISTED)), _LONG)
            add(LISTED, e["lnode"], e["lkey"].astype(np.int64), e["ln"], e["lpos"])
        cols = {k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in out.items()}
        return pa.table({"kind": pa.array(cols.pop("kind"), pa.int32())} | {k: pa.array(v) for k, v in cols.items()})

    def compared(asked: DataFrame, firsts: DataFrame | None, rows: DataFrame) -> DataFrame:
        marked = rows.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(mark, _SENT)
        sent = rows.groupBy("home").cogroup(marked.groupBy("home")).applyInArrow(sift, _SENT)
        if firsts is not None:
            blank = [F.lit(b"").alias(k) for k in ("words", "targets", *_LONG)]
            sent = sent.unionByName(firsts.select("home", F.lit(DOCUMENT).alias("kind"), F.col("first").alias("src"), F.lit(0).cast("long").alias("n"), *blank))
        return rows.groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(verify, _OUT)

    tier = homed.groupBy("home").cogroup(here.groupBy("home")).applyInArrow(prefixes, B.schema("bucket", _ENTRY))
    asked, hot = None, hottest
    while True:
        found = tier.groupBy("bucket").applyInArrow(candidates, _MIXED)
        new = found.filter(F.col("kind") != HEAD)
        new = new if asked is None else new.filter(F.col("kind") == 0)  # listed once, in the first tier
        asked = new if asked is None else asked.unionByName(new)
        if hot < HOT_LOG:
            break
        tier = found.filter(F.col("kind") == HEAD).select("bucket", "home", "kind", *_ENTRY)
        hot = hot - HOT_LOG + 4
    found = _graph.checkpoint(compared(asked, here, homed))
    # what pairs share at most and at least: the same where they were verified
    pairs = found.filter(F.col("kind").isin(PAIR, RULED)).withColumn("least", F.when(F.col("kind") == PAIR, F.col("overlap")).otherwise(0))
    linked = lambda p: p.filter((F.col("kind") == PAIR) & F.expr("9 * overlap >= 4 * (na + nb)")).select("a", "b")
    groups_of = _graph.components(linked(pairs))
    more = _open_pairs(found.filter(F.col("kind") == LISTED), pairs, groups_of)
    if more is not None:
        # texts that are compared again travel again; of the others their places, by which entries name the rest
        slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))
        again = more.select(F.explode(F.array("a", "b")).alias("b")).distinct().join(found.filter(F.col("kind") == DOCUMENT).select(F.col("a").alias("first"), "b"), "b")
        again = F.broadcast(again.select(slot("first").alias("slot"), F.lit(True).alias("again")).distinct())
        rows = homed.withColumn("slot", slot("rid")).join(again, "slot", "left").select("doc_id", F.when(F.col("again"), F.col("text")).alias("text"), "rid", "home")
        later = compared(more.withColumn("home", F.shiftright("a", 32).cast("int")).groupBy("home").applyInArrow(lambda t: _fill(_asked(t["a"].to_numpy(), t["b"].to_numpy(), 0)), _MIXED), None, rows)
        groups_of = _graph.extended(groups_of, _graph.checkpoint(linked(later)))
    docs = found.filter(F.col("kind") == DOCUMENT).select(F.col("a").alias("first"), F.when(F.col("na") > 0, F.col("b")).alias("node"), F.col("na").alias("n_shingles"))
    docs = docs.join(groups_of, "node", "left").select("first", "n_shingles", F.coalesce("component", "node").alias("component"))
    texts = reps.join(docs, "first").select("digest", "name", "n", "n_shingles", "component")
    sizes = texts.filter("component is not null").groupBy("component").agg(F.min("name").alias("least"), F.count("*").alias("m"))
    texts = _graph.checkpoint(_graph.spread_join(texts, sizes.drop("m"), "component", _graph.hot_values(sizes, "component", "m"), "digest"))
    rows = keyed.select("doc_id", "rid", "digest")
    rows = _graph.spread_join(rows, texts.select("digest", "n_shingles", "least"), "digest", _graph.hot_values(texts, "digest"), "rid")
    least = F.coalesce("least", F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    return rows.select("doc_id", "n_shingles", least["doc_id"].alias("component_id"), "rid", (F.col("rid") == least["rid"]).alias("stays"))


def _asked(a: np.ndarray, b: np.ndarray, bucket: int) -> pa.Table:
    ask = {"doc": (a & 0xFFFFFFFF).astype(np.uint32), "home2": (b >> 32).astype(np.uint32), "doc2": (b & 0xFFFFFFFF).astype(np.uint32)}
    return B.pack("home", (a >> 32).astype(np.int32), bucket, ask)


def _sent(home=(), src=(), n=(), words=(), targets=()) -> pa.Table:
    """Rows that bring something of a set to a home where its partners lie."""
    blank = pa.array([b""] * len(home), pa.binary())
    cols = {"home": pa.array(home, pa.int32()), "kind": pa.array([PAIR] * len(home), pa.int32()), "src": pa.array(src, pa.int64()), "n": pa.array(n, pa.int64()), "words": pa.array(words, pa.binary()), "targets": pa.array(targets, pa.binary())}
    return pa.table(cols | {k: blank for k in _LONG})


def _passed(rows: pa.Table) -> pa.Table:
    """Rows of packed entries for the next task of their home."""
    zero, blank = pa.array(np.zeros(len(rows), np.int64)), pa.array([b""] * len(rows), pa.binary())
    return pa.table({"home": rows["home"], "kind": rows["kind"], "src": zero, "n": zero, "words": blank, "targets": blank} | {k: rows[k] for k in _LONG})


def _addressed(home: int, sets: dict[int, np.ndarray], doc, home2, doc2, code) -> pa.Table:
    """What `code` makes of the set of each `doc` of a home, once for each home where partners of it lie."""
    trip = np.unique(np.stack([np.asarray(x).astype(np.int64) for x in (doc, home2, doc2)], 1), axis=0)
    start, count = B.runs(trip[:, 0], trip[:, 1])
    docs = trip[start, 0].tolist()
    coded = {d: code(sets[d]) for d in set(docs)}
    targets = [trip[a : a + c, 2].astype(np.uint32).tobytes() for a, c in zip(start.tolist(), count.tolist(), strict=True)]
    return _sent(trip[start, 1], home << 32 | trip[start, 0], [len(sets[d]) for d in docs], [coded[d] for d in docs], targets)


def _marks(s: np.ndarray) -> bytes:
    """Two bits for each shingle of a set, in which each sets one."""
    flags = np.zeros(8 * -(-2 * len(s) // 8), bool)
    flags[(s % np.uint64(len(flags))).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _most(marks: bytes, n: int, other: np.ndarray) -> int:
    """What a set of n shingles with these marks and another set share at most."""
    flags = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
    at = (other % np.uint64(len(flags))).astype(np.int64)
    met = np.zeros(len(flags), bool)
    met[at] = True
    return min(int(flags[at].sum()), n - int((flags & ~met).sum()))


def _open_pairs(listed: DataFrame, pairs: DataFrame, groups_of: DataFrame) -> DataFrame | None:
    """(a, b) of large lists that neither components nor the bound by a common compared set settle."""
    entries = listed.select(F.col("a").alias("node"), F.col("b").alias("key"), F.col("na").alias("n"), F.col("nb").alias("pos"))
    entries = entries.join(groups_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    entries = _graph.checkpoint(entries)
    sizes = entries.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    hot = _graph.hot_values(sizes, "key", "m")
    mixed = sizes.filter("lo <> hi").select("key", F.ceil(F.col("m") / OPEN_BLOCK).cast("int").alias("blocks"))
    entries = _graph.spread_join(entries, mixed, "key", hot, "node", "inner")
    times = pairs.groupBy("a").agg(F.count("*").alias("m"))
    best = _graph.spread_join(pairs, times, "a", _graph.hot_values(times, "a", "m"), "b", "inner").groupBy(F.col("b").alias("node")).agg(F.max(F.struct("m", "a", "overlap", "least")).alias("m")).select("node", F.col("m.a").alias("head"), F.col("m.overlap").alias("shared"), F.col("m.least").alias("least"))
    entries = entries.drop("blocks").join(best, "node", "left").na.fill({"head": -1, "shared": 0, "least": 0})
    # classes of sizes: similar sets are of one class or of neighbours; an entry goes where its size and position leave a partner possible
    entries = entries.withColumn("class", F.floor(F.log("n") / F.log(F.lit(CLASS))).cast("int"))
    other = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    smallest = F.greatest(F.lit(CLASS) ** F.col("with") * 0.999, 0.8 * F.col("n"))
    entries = entries.withColumn("with", other).filter((9 * (F.col("n") - F.col("pos")) >= 4 * (F.col("n") + smallest)) & (F.lit(CLASS) ** (F.col("with") + 1) * 1.001 >= 0.8 * F.col("n")))
    entries = _graph.checkpoint(entries.withColumn("list", F.xxhash64("key", F.least("class", "with"), F.greatest("class", "with"))))
    lists = entries.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    hot = _graph.hot_values(lists, "list", "m")
    mixed = lists.filter("lo <> hi").select("list", F.ceil(F.col("m") / OPEN_BLOCK).cast("int").alias("blocks"))
    entries = _graph.spread_join(entries, mixed, "list", hot, "node", "inner")
    entries = _graph.checkpoint(entries.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    if entries.isEmpty():
        return None
    # block pairs of what is left of a list: each entry meets every block, once
    met = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})

    def open_(table: pa.Table) -> pa.Table:
        t = {k: table[k].to_numpy() for k in ("node", "n", "pos", "component", "head", "shared", "least", "side", "class", "with")}
        order = np.lexsort((t["node"], t["n"]))
        t = {k: v[order] for k, v in t.items()}
        across = table["lo"][0].as_py() != table["hi"][0].as_py()
        ends = np.searchsorted(t["n"], t["n"] * 5 // 4, "right")
        count = np.maximum(ends - np.arange(len(order)) - 1, 0)
        i = np.repeat(np.arange(len(order)), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        kept = (t["component"][i] != t["component"][j]) & (t["with"][i] == t["class"][j])
        if across:
            kept &= t["side"][i] != t["side"][j]
        i, j = i[kept], j[kept]
        n, shared, least = ((t[k][i], t[k][j]) for k in ("n", "shared", "least"))
        kept = _possible(n[0], t["pos"][i], n[1], t["pos"][j])
        most = np.minimum(*shared) + np.minimum(n[0] - least[0], n[1] - least[1])
        kept &= (t["head"][i] != t["head"][j]) | (t["head"][i] < 0) | (9 * most >= 4 * (n[0] + n[1]))
        i, j = i[kept], j[kept]
        return pa.table({"a": t["node"][i], "b": t["node"][j]})

    pairs_left = met.groupBy("list", "lo", "hi").applyInArrow(open_, "a bigint, b bigint").distinct()
    done = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    more = _graph.checkpoint(pairs_left.join(done, ["a", "b"], "left_anti"))
    return None if more.isEmpty() else more
