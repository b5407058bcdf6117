"""Exact substring dedup over bytes: anchored hashing in place of most of prefix doubling.

Every byte covered by a `length`-byte string that also starts elsewhere, in any
document, is removed. Distributed prefix doubling would sort all positions by (rank
here, rank at an offset) in rounds of growing offsets; each round shuffles every open
position's rank and address both ways, which README shows not to fit. Here a rank is a fingerprint
of a string, made by doubling inside a task, and three shuffles of fewer positions follow:

1. Ranks of `length / 2` bytes. Only the positions that hold the least
   fingerprint of a `length`-byte window's half-length strings are sent:
   equal windows choose equal positions, so any repeated window has a ranked
   position in common with its copy, and about one position in fifty is ranked.
2. With each goes the rank of its surroundings, half a length before and a whole length behind.
   Where this whole surrounding repeats, all windows of the position
   repeat, and it is settled. Unique first ranks are dropped.
3. What remains, the edges of repeats, is ranked at every byte: the pair of
   half-length ranks at p and p + length / 2 is the rank of the whole length;
   ranks held twice are repeats.

Fingerprints have 64 bits, or 96 where a removal rests on them. Spark shuffles positions
by rank, tasks sort those of one bucket.

Edge cases: null text is empty; texts shorter than `length` keep everything;
repeats within one document count, overlapping ones too; repeated rows repeat
each other; other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B, _text as X

_RUN = {"key": np.uint32, "ctx": np.uint64, "doc": np.uint32, "lo": np.uint32, "n": np.uint8, "flag": np.uint8}
_STATE = {"doc": np.uint32, "lo": np.uint32, "n": np.uint8, "flag": np.uint8}
_WINDOW = {"key": np.uint64, "more": np.uint32, "doc": np.uint32, "lo": np.uint32, "n": np.uint8, "flag": np.uint8}
_SPAN = {"doc": np.uint32, "lo": np.uint32, "n": np.uint8}
_MARK, _DONE, _OPEN = np.uint8(128), np.uint8(1), np.uint8(2)
#: Windows further apart are hashed apart.
_NEAR = 1024
#: Low bits of a rank that give way to the position in a stretch, which breaks ties alike in all stretches.
_PLACE = np.uint64((1 << 24) - 1)
SPANS = "array<struct<start:bigint,end:bigint>>"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _stretches(off: np.ndarray, length: int):
    """(first document, document behind the last, first and last + 1 byte at which windows start): about STEP bytes each, also within one long text."""
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + X.STEP, "right")) - 1))
        lo = int(off[i])
        while j == i + 1 and off[j] - lo > 2 * X.STEP:
            back = yield i, j, lo, lo + X.STEP
            lo = back or lo + X.STEP
        yield i, j, lo, int(off[j])
        i = j


def _ranked(data: np.ndarray, off: np.ndarray, length: int):
    """Runs of windows that choose one position: (rank, rank of the surroundings, document, first window, windows - 1)."""
    half, parts = length // 2, []
    stretches, back = _stretches(off, length), None
    while True:
        try:
            i, j, lo, hi = stretches.send(back)
        except StopIteration:
            break
        back = None
        low, high = max(int(off[i]), lo - half), min(int(off[j]), hi + 2 * length)
        rank = X.window_hash(data[low:high], half)
        if high - low < length:
            continue
        chosen = (_least(rank & ~_PLACE | np.arange(len(rank), dtype=np.uint64), length - half + 1) & _PLACE).astype(np.int64)
        bounds = np.clip(off[i : j + 1] - low, 0, high - low)
        lasts = bounds[1:] - length
        opens = np.zeros(len(chosen) + 1, np.int64)
        fits = lasts >= bounds[:-1]
        np.add.at(opens, bounds[:-1][fits], 1)
        np.add.at(opens, lasts[fits] + 1, -1)
        p = np.flatnonzero(np.cumsum(opens[:-1]) > 0)
        p = p[(p >= lo - low) & (p < hi - low)]
        if not len(p):
            continue
        a = chosen[p]
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        last = np.r_[cut[1:], len(p)] - 1
        if hi < off[j]:  # the text goes on: its last run may too, and is taken up again
            back = low + int(p[cut[-1]])
            cut, last = cut[:-1], last[:-1]
        a, first, n = a[cut], p[cut], p[last] - p[cut]
        d = np.searchsorted(bounds, first, "right") - 1
        left, right = np.maximum(bounds[d], a - half), np.minimum(bounds[d + 1], a + length)
        ctx = X.combine(X.combine(X.combine(rank[left], rank[a]), rank[right - half]), ((a - left) << 32 | right - left).astype(np.uint64))
        parts.append((rank[a], ctx, (d + i).astype(np.uint32), (first + low - off[d + i]).astype(np.uint32), n.astype(np.uint8)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _whole(data: np.ndarray, off: np.ndarray, length: int, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (96 bits) of the given windows, sorted by document and start: of each, the pair of its halves' ranks."""
    half, at = length // 2, off[doc] + lo
    key, more = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32)
    ends = off[np.asarray(doc, np.int64) + 1] if len(at) else at
    first = np.flatnonzero(np.r_[True, (np.diff(at) > _NEAR) | (np.diff(doc) != 0)]) if len(at) else at
    for a, b in zip(first.tolist(), np.r_[first[1:], len(at)].tolist(), strict=True) if len(at) else ():
        for i in range(a, b, X.STEP):  # of one text, near each other
            j, begin = min(b, i + X.STEP), int(at[i])
            piece, p = data[begin : min(int(at[j - 1]) + length, int(ends[i]))], at[i:j] - begin
            h = X.window_hash(piece, half)
            key[i:j] = X.combine(h[p], h[p + half])
            h = X.window_hash(piece, half, 1)
            more[i:j] = X.combine(h[p], h[p + half]).astype(np.uint32)
    return key, more


def remove_repeated_bytes(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs [start, end), maximal and in order), kept (remaining bytes), then the carried columns."""
    if length % 2 or not 2 <= length <= 400:
        raise ValueError("the length must be even, from 2 to 400")
    groups = B.count_of(documents, text_col)
    homed = B.homed(documents, groups, id_col, text_col, carry)
    by_home = lambda: homed.groupBy("home")
    carry_names = [f"_carry_{i}" for i in range(len(carry))]

    def first_ranks(table: pa.Table) -> pa.Table:
        home = table["home"][0].as_py()
        rank, ctx, doc, lo, n = _ranked(*X.buffers(B.ordered(table)["text"]), length)
        order = np.lexsort((ctx, rank))
        r, c = rank[order], ctx[order]
        same = np.zeros(len(r), bool)
        start, size = B.runs(r)
        many = np.repeat(size > 1, size)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        s2 = np.flatnonzero(new)
        n2 = np.diff(np.r_[s2, len(r)])
        same = np.repeat(n2 > 1, n2)
        flag = np.where(many, np.where(same, _DONE, 0) | np.where(new, _OPEN, 0), 0).astype(np.uint8)
        cols = {"key": rank[order].astype(np.uint32), "ctx": c, "doc": doc[order], "lo": lo[order], "n": n[order], "flag": flag}
        bucket = B.bucket_of(r, groups)
        # keys held more than once here: settled here, and one mark to others
        mark = np.zeros(len(r), bool)
        mark[start[size > 1]] = True
        sent = ~many | mark
        out = {k: v[sent] for k, v in cols.items()}
        out["flag"] = np.where(mark[sent], _MARK, 0).astype(np.uint8)
        back = np.argsort(out["doc"], kind="stable")
        here = np.flatnonzero(many)
        here = here[np.argsort(cols["doc"][here], kind="stable")]
        own = {k: v[here] for k, v in cols.items()}
        own["key"], own["ctx"] = np.zeros(len(here), np.uint32), np.zeros(len(here), np.uint64)
        return pa.concat_tables([B.pack("bucket", bucket[sent][back], home, {k: v[back] for k, v in out.items()}), B.pack("bucket", np.full(len(here), home % groups, np.int32), home, own, kind=1)])

    def rerank(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        kinds = table["kind"].to_numpy()
        e = B.unpack(table.filter(pa.array(kinds == 0)), _RUN, "home")
        marked = e["flag"] == _MARK
        order = np.lexsort((e["ctx"], marked, e["key"]))
        k, c, m = e["key"][order], e["ctx"][order], marked[order]
        start, size = B.runs(k)
        shared = np.repeat(size > 1, size) & ~m
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])
        s2 = np.flatnonzero(new)
        n2 = np.diff(np.r_[s2, len(k)])
        whole = np.repeat(n2 == np.repeat(size, size)[s2], n2) if len(k) else new  # nothing else has this rank
        same = np.repeat(n2 > 1, n2)
        flag = np.zeros(len(order), np.uint8)
        flag[order] = np.where(shared, np.where(same, _DONE, 0) | np.where(new & ~whole, _OPEN, 0), 0)
        found = flag > 0
        e["flag"] = flag
        p = B.unpack(table.filter(pa.array(kinds == 1)), _RUN, "home")
        return pa.concat_tables([B.pack("home", x["home"][q], bucket, {f: x[f][q] for f in _STATE}) for x, q in ((e, found), (p, np.ones(len(p["doc"]), bool)))])

    def whole_ranks(table: pa.Table, states: pa.Table) -> pa.Table:
        if not len(table) or not len(states):
            return B.empty("bucket", _WINDOW)
        home = table["home"][0].as_py()
        s = B.unpack(states, _STATE)
        order = np.lexsort((s["lo"], s["doc"]))
        s = {k: v[order] for k, v in s.items()}
        done = (s["flag"] & _DONE) > 0
        settled = [{k: s[k][done] for k in _SPAN}]
        to = (s["flag"] & _OPEN) > 0
        data, off = X.buffers(B.ordered(table)["text"])
        doc, lo, n = s["doc"][to], s["lo"][to].astype(np.int64), s["n"][to].astype(np.int64) + 1
        at = np.repeat(np.cumsum(n) - n, n)
        wdoc = np.repeat(doc, n)
        wlo = np.repeat(lo, n) + np.arange(len(wdoc)) - at
        key, more = _whole(data, off, length, wdoc, wlo)
        wlo = wlo.astype(np.uint32)
        order = np.lexsort((more, key))
        start, size = B.runs(key[order], more[order])
        local = np.zeros(len(key), bool)
        local[order] = np.repeat(size > 1, size)
        mark = order[start[size > 1]]
        settled.append({"doc": wdoc[local], "lo": wlo[local], "n": np.zeros(int(local.sum()), np.uint8)})
        one = np.sort(np.r_[np.flatnonzero(~local), mark])
        sent = {"key": key[one], "more": more[one], "doc": wdoc[one], "lo": wlo[one], "n": np.zeros(len(one), np.uint8), "flag": np.where(local[one], _MARK, 0).astype(np.uint8)}
        own = {k: np.concatenate([x[k] for x in settled]) for k in _SPAN}
        m = len(own["doc"])
        own |= {"key": np.zeros(m, np.uint64), "more": np.zeros(m, np.uint32), "flag": np.zeros(m, np.uint8)}
        return pa.concat_tables([B.pack("bucket", B.bucket_of(sent["key"], groups), home, sent), B.pack("bucket", np.full(m, home % groups, np.int32), home, {k: own[k] for k in _WINDOW}, kind=1)])

    def held_twice(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        kinds = table["kind"].to_numpy()
        e = B.unpack(table.filter(pa.array(kinds == 0)), _WINDOW, "home")
        order = np.lexsort((e["more"], e["key"]))
        start, size = B.runs(e["key"][order], e["more"][order])
        found = np.zeros(len(order), bool)
        found[order] = np.repeat(size > 1, size)
        found &= e["flag"] != _MARK
        p = B.unpack(table.filter(pa.array(kinds == 1)), _WINDOW, "home")
        return pa.concat_tables([B.pack("home", x["home"][q], bucket, {f: x[f][q] for f in _SPAN}) for x, q in ((e, found), (p, np.ones(len(p["doc"]), bool)))])

    def kept(table: pa.Table, spots: pa.Table) -> pa.Table:
        table = B.ordered(table)
        data, off = X.buffers(table["text"])
        s = B.unpack(spots, _SPAN)
        begin = off[s["doc"]] + s["lo"]
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + s["n"] + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        first = np.zeros(len(data), bool)
        first[off[:-1][off[:-1] < len(data)]] = True
        starts = gone.copy()
        starts[1:] &= ~gone[:-1] | first[1:]
        ends = gone.copy()
        ends[:-1] &= ~gone[1:] | first[1:]
        a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        cut = np.searchsorted(a, off)
        raw, n_removed, spans, left = data.tobytes(), [], [], []
        for i in range(len(table)):
            x, y = off[i], off[i + 1]
            found = list(zip((a[cut[i] : cut[i + 1]]).tolist(), (b[cut[i] : cut[i + 1]]).tolist(), strict=True))
            n_removed.append(sum(q - p for p, q in found))
            spans.append([{"start": p - x, "end": q - x} for p, q in found])
            edges = [x, *(v for pair in found for v in pair), y]
            left.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = {"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(left, pa.binary())}
        return pa.table(made | {c: table[c] for c in carry_names})

    first = by_home().applyInArrow(first_ranks, B.schema("bucket", _RUN))
    second = first.groupBy("bucket").applyInArrow(rerank, B.schema("home", _STATE))
    third = by_home().cogroup(second.groupBy("home")).applyInArrow(whole_ranks, B.schema("bucket", _WINDOW))
    fourth = third.groupBy("bucket").applyInArrow(held_twice, B.schema("home", _SPAN))
    out = by_home().cogroup(fourth.groupBy("home")).applyInArrow(kept, B.carried(f"doc_id bigint, n_bytes bigint, n_removed bigint, spans {SPANS}, kept binary", homed, carry_names))
    return out.withColumnsRenamed(dict(zip(carry_names, carry, strict=True)))
