"""How each source's vocabulary departs from its language's other sources, by rounds of a tournament.

A group is a language's source. Its vector, the counts of the terms that enough of
the language's documents hold, is cut into slices by a hash of the term, and a
language's groups take `SEATS` seats in each slice; so a seat holds a bounded part
of a few groups, however large a source or a vocabulary is. Seats are
partitioned once and stay where they are. In every round of a round-robin
tournament (one seat fixed, the others turning about it) each seat meets one peer,
whose compressed vectors are sent to it, and both directions of all pairs between
the two are evaluated. The partial sums of slices and rounds are added at the end.
While seats are made, a heap for each group keeps the best terms of a slice, and
only those are ranked together.

Arithmetic is whole-numbered: a term's share p is 1 + floor(10^9 * (count + 1) / (N + V)),
by long division, so that no product leaves 64 bits; a divergence is
floor((p - q)^2 / q).

Edge cases: null text, lang and source count as ''; a group without terms takes
part with equal shares; a language without kept terms has pair values of 0; a
language of one source has no pairs; repeated rows are documents of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import _blocks as B, _text as X
from ._scratch import Scratch

SEATS = 8
#: Terms of a slice times groups of a seat, at most on average.
SEAT_CELLS = 500_000
SCALE = 10**9
#: Rows of counts, and their bytes, that a task adds up at a time.
_FLUSH = 500_000
_FLUSH_BYTES = 32 << 20
#: Terms are runs of ASCII letters and of anything beyond ASCII.
_GAP = np.ones(256, bool)
_GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def shares(count, total: int, kinds: int):
    """1 + floor(SCALE * (count + 1) / (total + kinds)), three decimal digits at a time."""
    rest, whole = np.asarray(count, np.int64) + 1, total + kinds
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def divergence(p, q):
    return (p - q) * (p - q) // q


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Every lower-cased term, in order, and its text."""
    parts, docs = [], []
    for lo, hi in X._pieces(data, off, _GAP):
        piece = data[lo:hi]
        inner = ~_GAP[piece]
        first = np.zeros(hi - lo, bool)
        i, j = np.searchsorted(off, (lo, hi))
        first[off[i:j] - lo] = True
        begins, ends = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1] | first[1:]
        ends[:-1] &= ~inner[1:] | first[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        cuts = np.zeros(len(s) + 1, np.int32)
        np.cumsum(e - s, out=cuts[1:])
        parts.append(pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(X.LOWERED[piece[inner]]))]))
        docs.append(np.searchsorted(off, s + lo, "right") - 1)
    if not parts:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    return pa.concat_arrays(parts), np.concatenate(docs)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


class _Counted(NamedTuple):
    """Counts by group and term: a key is the group's place times the number of terms, plus the term's place."""

    lang: pa.Array
    source: pa.Array
    terms: pa.Array
    keys: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    @property
    def bytes(self) -> int:
        return sum(c.nbytes for c in self)


def _groups(lang: pa.Array, source: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The distinct pairs, and each row's place among them."""
    a, b = lang.dictionary_encode(), source.dictionary_encode()
    keys = a.indices.to_numpy().astype(np.int64) * max(len(b.dictionary), 1) + b.indices.to_numpy()
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return lang.take(pa.array(first)), source.take(pa.array(first)), place


def _added(keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first, _ = B.runs(keys)
    return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def _summed(held: list[_Counted]) -> _Counted:
    if len(held) == 1:
        return held[0]
    lang, source, place = _groups(*(pa.concat_arrays([h[k] for h in held]) for k in (0, 1)))
    code = pa.concat_arrays([h.terms for h in held]).dictionary_encode()
    to, terms = code.indices.to_numpy(), code.dictionary
    keys, g, t = [], 0, 0
    for h in held:
        at, what = np.divmod(h.keys, len(h.terms))
        keys.append(place[g + at] * len(terms) + to[t + what])
        g, t = g + len(h.lang), t + len(h.terms)
    return _Counted(lang, source, terms, *_added(np.concatenate(keys), np.concatenate([h.n for h in held]), np.concatenate([h.docs for h in held])))


def _counts(part: pa.RecordBatch) -> _Counted:
    """Occurrences and documents of each group's terms, and none of the empty term, which stands for the group."""
    lang, source, place = _groups(*(pc.cast(part[c], pa.string()) for c in ("lang", "source")))
    terms, doc = _terms(*X.buffers(part["text"]))
    code = terms.dictionary_encode()
    terms = pa.concat_arrays([pa.array([b""], pa.binary()), code.dictionary])
    pairs, times = np.unique(doc * len(terms) + code.indices.to_numpy() + 1, return_counts=True)
    at, what = np.divmod(pairs, len(terms))
    none = np.zeros(len(lang), np.int64)
    keys = np.concatenate([np.arange(len(lang)) * len(terms), place[at] * len(terms) + what])
    return _Counted(lang, source, terms, *_added(keys, np.concatenate([none, times]), np.concatenate([none, np.ones(len(at), np.int64)])))


def _sent(counted: _Counted):
    terms = pc.cast(counted.terms, pa.string())
    for i in range(0, len(counted.keys), 20_000):
        at, what = np.divmod(counted.keys[i : i + 20_000], len(terms))
        at = pa.array(at)
        yield pa.record_batch([counted.lang.take(at), counted.source.take(at), terms.take(pa.array(what)), pa.array(counted.n[i : i + 20_000]), pa.array(counted.docs[i : i + 20_000])], schema=_COUNTED)


def _tally(batches):
    """Sums by group and term. What a task holds meanwhile are numbers, and each term once, up to a number of rows and bytes."""
    held, size, room = [], 0, 0
    for part in X.slices(batches, 2 * X.STEP):
        held.append(_counts(part))
        size, room = size + len(held[-1].keys), room + held[-1].bytes
        if size >= _FLUSH or room >= _FLUSH_BYTES:
            held = [_summed(held)]
            size, room = len(held[0].keys), held[0].bytes
            if size >= _FLUSH // 2 or room >= _FLUSH_BYTES // 2:
                yield from _sent(held[0])
                held, size, room = [], 0, 0
    if held:
        yield from _sent(_summed(held))


def _pack(at: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted places, as differences, and counts."""
    raw = B._coded(at.astype(np.uint32), "doc") + B._coded(count.astype(np.uint64), "")
    return len(at).to_bytes(8, "little") + zlib.compress(raw, 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(data[:8], "little"), zlib.decompress(data[8:])
    return B._decoded(raw[: 4 * n], "doc", np.uint32), B._decoded(raw[4 * n :], "", np.uint64).astype(np.int64)


_SEATED = "lang string, slice int, seat int, source string, total bigint, kinds bigint, size bigint, data binary, item string, value bigint"


def _seated(top: int):
    """Packs a seat's groups and keeps the `top` terms of each, by their divergence from the language."""

    def run(entries: pa.Table, groups: pa.Table) -> pa.Table:
        order = entries["source"].combine_chunks().dictionary_encode() if len(entries) else pa.array([], pa.string()).dictionary_encode()
        place = {v: k for k, v in enumerate(order.dictionary.to_pylist())}
        codes = order.indices.to_numpy(zero_copy_only=False)
        at, n, all_n = (entries[c].to_numpy() for c in ("at", "n", "total"))
        out = []
        for g in groups.to_pylist():
            mine = np.flatnonzero(codes == place[g["source"]]) if g["source"] in place else np.zeros(0, np.int64)
            mine = mine[np.argsort(at[mine], kind="stable")]
            same = {k: g[k] for k in ("lang", "slice", "seat", "source", "total", "kinds", "size")}
            out.append(same | {"data": _pack(at[mine], n[mine])})
            if not len(mine):
                continue
            p, q = shares(n[mine], g["total"], g["kinds"]), shares(all_n[mine], g["lang_total"], g["kinds"])
            value = divergence(p, q)
            over = np.flatnonzero(p > q)
            best = heapq.nsmallest(top, zip((-value[over]).tolist(), at[mine[over]].tolist(), over.tolist(), strict=True))
            names = entries["term"].take(pa.array(mine[[k for _, _, k in best]])).to_pylist() if best else []
            out += [same | {"item": t, "value": -v} for (v, _, _), t in zip(best, names, strict=True)]
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        return pa.Table.from_pylist(out, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SEATED.split(", ")]))

    return run


def _shares_of(seat: pa.Table) -> list[tuple[str, np.ndarray]]:
    out = []
    for g in seat.to_pylist():
        if not g["size"]:
            out.append((g["source"], np.ones(0, np.int64)))
            continue
        p = np.full(g["size"], shares(0, g["total"], g["kinds"]))
        at, n = _unpack(g["data"])
        p[at] = shares(n, g["total"], g["kinds"])
        out.append((g["source"], p))
    return out


_MET = "lang string, source string, item string, value bigint"


def _meeting(own: pa.Table, peers: pa.Table) -> pa.Table:
    """Both directions of every pair between a seat's groups and a visitor's; without a visitor, of the pairs inside the seat."""
    a = _shares_of(own)
    pairs = [(x, y) for x in a for y in _shares_of(peers)] if len(peers) else [(x, y) for k, x in enumerate(a) for y in a[k + 1 :]]
    if not len(own):
        pairs = []
    rows = [(s, t, int(divergence(p, q).sum())) for x, y in pairs for (s, p), (t, q) in ((x, y), (y, x))]
    s, t, v = zip(*rows, strict=True) if rows else ((), (), ())
    lang = own["lang"][0].as_py() if len(own) else ""
    return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array(s, pa.string()), "item": pa.array(t, pa.string()), "value": pa.array(v, pa.int64())})


def host_of(seats: int, round_: int) -> list[tuple[int, int]]:
    """(host, guest) of each meeting of a round: the last seat stays, the others turn."""
    turn = seats - 1
    pairs = [(seats - 1, round_)] + [((round_ + k) % turn, (round_ - k) % turn) for k in range(1, seats // 2)]
    return [(min(p), max(p)) for p in pairs]


def audit(documents: DataFrame, least_docs: int = 3, top: int = 200, seats: int = SEATS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows of a group's divergence from each other source of its language, `term` rows of its `top` terms over the language."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "divergence")
    read = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counted = read.mapInArrow(_tally, "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")
    known = counted.withColumns({"total": F.sum("n").over(same), "in_docs": F.sum("docs").over(same), "one": F.min("source").over(same) == F.col("source")})
    entries = scratch.keep(known.filter((F.col("in_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "total", (F.col("one") & (F.col("term") != "")).alias("one")), "entries")
    by_lang = W.partitionBy("lang")
    groups = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("one").cast("long")).alias("firsts"))
    groups = groups.select("lang", "source", "total", F.sum("firsts").over(by_lang).alias("kinds"), F.sum("total").over(by_lang).alias("lang_total"), F.count("*").over(by_lang).alias("sources"), F.row_number().over(by_lang.orderBy("source")).alias("number"))
    groups = scratch.keep(groups, "groups")
    most = groups.agg(F.max("sources").alias("sources"), F.max(F.col("kinds") * F.ceil(F.col("sources") / seats)).alias("cells")).first()
    seats = max(2, min(seats, -(-(most["sources"] or 0) // 2) * 2))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-parts // 16), -(-(most["cells"] or 0) // SEAT_CELLS))
    cut = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)).cast("int")
    seat = F.pmod(F.col("number"), F.lit(seats)).cast("int")
    sizes = entries.filter("one").groupBy("lang", cut("term").alias("slice")).agg(F.count("*").alias("size"))
    every = groups.select("lang", "source", "total", "kinds", "lang_total", seat.alias("seat"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).join(sizes, ["lang", "slice"], "left").fillna(0, ["size"])
    ordered = W.partitionBy("lang", "slice").orderBy("term")
    seat_of = groups.select("lang", "source", seat.alias("seat"))
    placed = entries.filter("term <> ''").join(seat_of, ["lang", "source"]).withColumn("slice", cut("term")).select("lang", "slice", "seat", "source", "term", "n", "total", (F.dense_rank().over(ordered) - 1).alias("at"))
    keys = ("lang", "slice", "seat")
    seated = scratch.keep(placed.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(_seated(top), _SEATED), "seated")
    scratch.drop("entries")
    residents = seated.filter("data is not null").drop("item", "value")
    met = None
    for r in range(-1, seats - 1):
        meetings = host_of(seats, r) if r >= 0 else [(k, k) for k in range(seats)]
        host = _among(F.col("seat"), {h: h for h, _ in meetings})
        own = residents.filter(host.isNotNull())
        guests = residents.filter(F.lit(r >= 0)).withColumn("seat", _among(F.col("seat"), {g: h for h, g in meetings})).filter("seat is not null")
        one = scratch.keep(own.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(_meeting, _MET).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), f"round{r + 1}")
        met = one if met is None else met.unionByName(one)
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).cast("int").alias("rank"))
    pairs = ranked(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
    return pairs.unionByName(ranked(seated.filter("item is not null").select("lang", "source", "item", "value"), "term").filter(F.col("rank") <= top))


def _among(c: Column, to: dict[int, int]) -> Column:
    """The number that c stands for; null for others."""
    out = F.lit(None).cast("int")
    for k, v in to.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out
