"""Substring dedup over words with difference-cover anchors.

A word is removed when a window of `window` words covers it whose word sequence
also starts in a document with a smaller id. Only word positions whose index
modulo the period lies in a difference cover are hashed at first, over
`window - period + 1` words: wherever two documents share a whole window, some
offset below the period puts both on a cover position, so they share that
shorter anchor. Anchors found in two documents are then extended: the full
windows around them are hashed (96 bits) and the smallest document id of each
decides.

Edge cases: a null text has no words; a document shorter than a window loses
nothing; rows of one id are judged as one document and never remove from each
other; a null id counts as the largest; other columns are ignored or carried.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B, _text as X

_ANCHOR = {"key": np.uint32, "doc": np.uint32, "pos": np.uint32}
_SPOT = {"doc": np.uint32, "pos": np.uint32}
_WINDOW = {"key": np.uint64, "more": np.uint32, "id": np.int64, "doc": np.uint32, "pos": np.uint32}
_MARK = np.uint32(0xFFFFFFFF)


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    return (0,)


def _words(table: pa.Table):
    _, _, doc, h = X.words(*X.buffers(table["text"]))
    return doc, h, X.starts_of(doc, len(table))


def remove_repeated_windows(documents: DataFrame, window: int = 13, period: int = 7, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), then the carried columns."""
    if not 1 <= period <= window:
        raise ValueError("the period must be from 1 to the window")
    groups, cover, size = B.count_of(documents, text_col), np.array(difference_cover(period)), window - period + 1
    homed = B.homed(documents, groups, id_col, text_col, carry)
    by_home = lambda: homed.groupBy("home")

    def anchors(table: pa.Table) -> pa.Table:
        home = table["home"][0].as_py()
        table = B.ordered(table)
        doc, h, first = _words(table)
        key = X.grams(h, size)
        at = np.arange(len(key))
        pos = at - first[doc[: len(key)]]
        keep = (at + size <= first[doc[: len(key)] + 1]) & np.isin(pos % period, cover)
        key, doc, pos = key[keep], doc[: len(keep)][keep].astype(np.uint32), pos[keep].astype(np.uint32)
        order = np.argsort(key, kind="stable")
        start, n = B.runs(key[order])
        shared = doc[order[start]] != doc[order[start + n - 1]]
        local = np.zeros(len(key), bool)
        local[order] = np.repeat(shared, n)
        one = np.r_[np.flatnonzero(~local), order[start[shared]]]
        sent = {"key": key[one].astype(np.uint32), "doc": np.where(local[one], _MARK, doc[one]), "pos": pos[one]}
        here = {"key": np.zeros(int(local.sum()), np.uint32), "doc": doc[local], "pos": pos[local]}
        return pa.concat_tables([B.pack("bucket", B.bucket_of(key[one], groups), home, sent), B.pack("bucket", np.full(len(here["doc"]), home % groups, np.int32), home, here, kind=1)])

    def shared_anchors(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        kinds = table["kind"].to_numpy()
        passed = table.filter(pa.array(kinds == 1))
        e = B.unpack(table.filter(pa.array(kinds == 0)), _ANCHOR, "home")
        order = np.argsort(e["key"], kind="stable")
        owner = (e["home"].astype(np.uint64) << np.uint64(32) | e["doc"])[order]
        start, n = B.runs(e["key"][order])
        found = np.zeros(len(order), bool)
        if len(start):
            found[order] = np.repeat(np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start), n)
        found &= e["doc"] != _MARK
        p = B.unpack(passed, _ANCHOR, "home")
        return pa.concat_tables([B.pack("home", x["home"][k], bucket, {f: x[f][k] for f in _SPOT}) for x, k in ((e, found), (p, np.ones(len(p["doc"]), bool)))])

    def windows(table: pa.Table, spots: pa.Table) -> pa.Table:
        if not len(table) or not len(spots):
            return B.empty("bucket", _WINDOW)
        home = table["home"][0].as_py()
        table = B.ordered(table)
        doc, h, first = _words(table)
        s = B.unpack(spots, _SPOT)
        mark = np.zeros(len(h) + 1, np.int64)
        mark[first[s["doc"]] + s["pos"]] = 1
        sums = np.r_[0, np.cumsum(mark)]
        key, more = X.grams(h, window), X.grams(h, window, 1).astype(np.uint32)
        at = np.arange(len(key))
        at = at[(sums[np.minimum(at + period, len(mark))] > sums[at]) & (at + window <= first[doc[: len(key)] + 1])]
        key, more, doc = key[at], more[at], doc[at].astype(np.uint32)
        pos, ids = (at - first[doc]).astype(np.uint32), B.ids_of(table)[doc]
        order = np.lexsort((more, key))
        start, n = B.runs(key[order], more[order])
        least = np.zeros(len(key), np.int64)
        if len(start):
            least[order] = np.repeat(np.minimum.reduceat(ids[order], start), n)
        out = []
        for k, kind in ((ids == least, 0), (ids > least, 1)):
            target = B.bucket_of(key[k], groups) if kind == 0 else np.full(int(k.sum()), home % groups, np.int32)
            known = {"key": key[k], "more": more[k], "id": ids[k]}
            out.append(B.pack("bucket", target, home, (known if kind == 0 else {f: np.zeros_like(v) for f, v in known.items()}) | {"doc": doc[k], "pos": pos[k]}, kind))
        return pa.concat_tables(out)

    def later_windows(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        kinds = table["kind"].to_numpy()
        e = B.unpack(table.filter(pa.array(kinds == 0)), _WINDOW, "home")
        order = np.lexsort((e["more"], e["key"]))
        start, n = B.runs(e["key"][order], e["more"][order])
        found = np.zeros(len(order), bool)
        if len(start):
            ids = e["id"][order]
            found[order] = ids > np.repeat(np.minimum.reduceat(ids, start), n)
        p = B.unpack(table.filter(pa.array(kinds == 1)), _WINDOW, "home")
        return pa.concat_tables([B.pack("home", x["home"][k], bucket, {f: x[f][k] for f in _SPOT}) for x, k in ((e, found), (p, np.ones(len(p["doc"]), bool)))])

    def kept(table: pa.Table, spots: pa.Table) -> pa.Table:
        table = B.ordered(table)
        data, off = X.buffers(table["text"])
        s = B.unpack(spots, _SPOT)
        order = np.argsort(s["doc"], kind="stable")
        docs, pos = s["doc"][order], s["pos"][order].astype(np.int64)
        cut = np.searchsorted(docs, np.arange(len(table) + 1))
        raw, n_words, n_removed, texts = data.tobytes(), [], [], []
        for i in range(len(table)):
            found = raw[off[i] : off[i + 1]].split()
            gone = 0
            if cut[i] < cut[i + 1]:
                p = pos[cut[i] : cut[i + 1]]
                cover = np.cumsum(np.bincount(p, minlength=len(found) + 1) - np.bincount(p + window, minlength=len(found) + 1))[: len(found)] > 0
                gone = int(cover.sum())
                n_words.append(len(found))
                found = [w for w, c in zip(found, cover.tolist(), strict=True) if not c]
            else:
                n_words.append(len(found))
            n_removed.append(gone)
            texts.append(b" ".join(found))
        made = {"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.table(made | {c: table[c] for c in carry_names})

    carry_names = [f"_carry_{i}" for i in range(len(carry))]
    first = by_home().applyInArrow(anchors, B.schema("bucket", _ANCHOR))
    second = first.groupBy("bucket").applyInArrow(shared_anchors, B.schema("home", _SPOT))
    third = by_home().cogroup(second.groupBy("home")).applyInArrow(windows, B.schema("bucket", _WINDOW))
    fourth = third.groupBy("bucket").applyInArrow(later_windows, B.schema("home", _SPOT))
    out = by_home().cogroup(fourth.groupBy("home")).applyInArrow(kept, B.carried("doc_id bigint, n_words bigint, n_removed bigint, kept_text string", homed, carry_names))
    return out.withColumnsRenamed(dict(zip(carry_names, carry, strict=True)))
