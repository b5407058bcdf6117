"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end for each text; every word is itself,
whatever their number. Restaurants: one for each context (the word before, or the
end at a text's start), which serves words, and their common parent, which serves
one customer for each table below it, over a uniform base of all known words and
one unknown.

Gibbs sweeps reseat all customers: every dish's customers sit down again one
after another, given the other dishes' tables and the parent's predictions of
the sweep before (many at once for frequent dishes), which gives the parent its
customers, who are reseated likewise. The table counts of the kept sweeps are
stored (a dish of one customer has one), and a token's probability is the mean of their
predictions: after any context these sum to 1 over all words and the unknown.

A chunk is some megabytes of text. It is read once: its words' fingerprints are sent to the
words' buckets, which number words by frequency and answer with numbers; from then
on only numbers travel. A chunk sends each distinct pair of words once to the pair's
bucket, with how often it occurs in training texts (or not at all), and keeps each document's
places in its list of pairs. A bucket counts, seats, and at the end answers every
chunk with one array of logarithms in the order of its pairs, which the chunk sums
by document. A context stands in one bucket unless it has more customers than half an
average bucket: then its pairs are dealt by both words, and its number of tables is
summed where its word lies and told to all its parts.

Every stage is written as Parquet under the checkpoint folder and dropped when no later one
reads it. Seeds, numbers and orders follow from the counts, not from tasks.

Edge cases: null and empty texts are one end; words unseen in training have the
unknown word's probability, contexts unseen the parent's; without training texts
every probability is that of the unknown word; repeated rows each get a result; a
null id counts as its empty text; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import _blocks as B, _text as X
from ._scratch import Scratch

#: Bytes of text in a chunk.
CHUNK = 4 << 20
_END = np.uint64(0xA24BAED4963EE407)
_U = np.uint64
_ROW = "key bigint, kind int, sweep int, data binary"
CHUNKS, WORDS, IDS, PAIRS, TOKENS, MERGED, AT, ASK, AGAIN, REPEATED, STATE, TABLES, MASS, ANSWER, ROOT, LOGS, TOTAL = range(17)


def _coded(v: np.ndarray) -> tuple:
    """An array of whole numbers from 0 on, in the fewest bytes, ascending ones as differences; or of floats."""
    if v.dtype.kind == "f":
        return v.dtype.str, False, False, B._coded(v, "")
    v = v.astype(np.uint64)
    up = len(v) > 1 and bool((v[1:] >= v[:-1]).all())
    if up:
        v = np.r_[v[:1], v[1:] - v[:-1]]
    v = v.astype(np.min_scalar_type(int(v.max())) if len(v) else np.uint8)
    return v.dtype.str, True, up, zlib.compress(B._coded(v, ""), 1)


def _put(**arrays: np.ndarray) -> bytes:
    return pickle.dumps({k: _coded(np.asarray(v)) for k, v in arrays.items()})


def _get(raw: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, packed, up, data) in pickle.loads(raw).items():
        v = B._decoded(zlib.decompress(data) if packed else data, "", np.dtype(kind))
        out[k] = v if not packed else np.cumsum(v, dtype=np.uint64) if up else v.astype(np.uint64)
    return out


def _falling(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers that ascend within runs of these sizes, as differences."""
    d = w.astype(np.uint64)
    d[1:] -= w[:-1].astype(np.uint64)
    first = np.cumsum(sizes, dtype=np.int64) - np.asarray(sizes, np.int64)
    first = first[np.asarray(sizes) > 0]
    d[first] = w[first]
    return d


def _rising(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sizes = np.asarray(sizes, np.int64)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return d
    c, first = np.cumsum(d, dtype=np.uint64), np.cumsum(sizes) - sizes
    return c - np.repeat(c[first] - d[first], sizes)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"key": pa.array(b, pa.int64()), "kind": pa.array(k, pa.int32()), "sweep": pa.array([0] * len(b), pa.int32()), "data": pa.array(d, pa.binary())})


def _batches(rows: list):
    yield from _table(rows).combine_chunks().to_batches()


def _by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        out.setdefault(k, []).append(d)
    return out


def _of(rows: dict[int, list[bytes]], kind: int) -> list[dict[str, np.ndarray]]:
    return [_get(d) for d in rows.get(kind, [])]


def _key(table: pa.Table) -> int:
    return table["key"][0].as_py()


def _one(v: int) -> np.ndarray:
    return np.array([v], np.uint64)


def _dealt(target: np.ndarray, kind: int, sender: int, **fields: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One row for each target with its entries, in their order, and who sends them."""
    order = np.argsort(target, kind="stable")
    first, size = B.runs(target[order])
    return [(int(target[order[a]]), kind, _put(**{k: v[order[a : a + n]] for k, v in fields.items()}, sender=_one(sender))) for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def _answered(target: np.ndarray, rows: list[dict], *names: str) -> list[np.ndarray]:
    """What the targets answered to entries that were dealt so."""
    order = np.argsort(target, kind="stable")
    out = [np.zeros(len(target), np.uint64) for _ in names]
    starts = np.searchsorted(target[order], np.array([int(r["sender"][0]) for r in rows], np.int64)) if rows else []
    for r, a in zip(rows, starts, strict=True):
        for o, k in zip(out, names, strict=True):
            o[order[a : a + len(r[k])]] = r[k]
    return out


def _bucket(numbers: np.ndarray, groups: int) -> np.ndarray:
    """Where a word of a number above 0 lies; its place there is the rest of its number."""
    return ((numbers - _U(1)) % _U(groups)).astype(np.int64)


def _place(numbers: np.ndarray, groups: int) -> np.ndarray:
    return (numbers - _U(1)) // _U(groups)


def _tokens(texts):
    """(fingerprint of every token, first token of each text)."""
    data, off = X.buffers(texts)
    _, _, doc, h = X.words(data, off, lower=True)
    n = len(off) - 1
    ends = X.starts_of(doc, n)[1:]
    return np.insert(h, ends, _END), np.r_[0, ends + np.arange(1, n + 1)]


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))


def seat(c: np.ndarray, fresh: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers; `fresh` is (strength + discount * tables of the restaurant) * the parent's prediction.

    Customers sit down one by one up to the 64th of a dish, then a sixteenth of those seated at a time.
    """
    t = np.ones(len(c), np.int64)
    at, step = 1, 1
    active = np.flatnonzero(c > 1)
    while len(active):
        m = np.minimum(step, c[active] - at)
        new = fresh[active] / (at + (m - 1) / 2 - d * t[active] + fresh[active])
        t[active] += rng.binomial(m, np.clip(new, 0, 1))
        at += step
        step = 1 if at < 64 else at // 16
        active = active[c[active] > at]
    return t


class Totals:
    """What is known of the whole: tokens, words, discounts, strengths, and of each kept sweep the parent's customers and tables."""

    def __init__(self, tokens: int, words: int, strength: float):
        self.tokens, self.words, self.strength = tokens, words, strength
        self.d, self.root_d, self.sweeps = 0.5, 0.5, []

    def parent(self, c: np.ndarray, t: np.ndarray, sweep: int) -> np.ndarray:
        """The parent's predictions of words with c customers at t tables."""
        customers, tables = self.sweeps[sweep]
        return (c - self.root_d * t + (self.strength + self.root_d * tables) / (self.words + 1)) / (self.strength + customers)


def _sum(rows: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Sums of the total rows' arrays, added up by part first, so that the driver gets one row for each of few parts."""

    def add(table: pa.Table) -> pa.Table:
        parts = [_get(d) for d in table["data"].to_pylist()]
        return pa.table({"data": pa.array([_put(**{k: np.sum([p[k] for p in parts], axis=0) for k in sizes})], pa.binary())})

    parts = rows.filter(F.col("kind") == TOTAL).select("data", F.pmod(F.hash("data"), F.lit(64)).alias("p")).groupBy("p").applyInArrow(add, "data binary").collect()
    loaded = [_get(r["data"]) for r in parts]
    return {k: sum((p[k].astype(np.int64) for p in loaded), np.zeros(n, np.int64)) for k, n in sizes.items()}


class Model:
    """A fitted model and the numbered texts it was fitted among: tables of rows (key, kind, sweep, data), and the totals."""

    def __init__(self, scratch: Scratch, groups: int, totals: Totals, named: DataFrame, paired: DataFrame, merged: DataFrame, kept: list[tuple[DataFrame, DataFrame]]):
        self.scratch, self.groups, self.totals, self.named, self.paired, self.merged, self.kept = scratch, groups, totals, named, paired, merged, kept

    def words(self) -> DataFrame:
        """number, word (its fingerprint), n."""
        groups = self.groups

        def show(batches):
            for b in batches:
                for key, raw in zip(b["key"].to_pylist(), b["data"].to_pylist(), strict=True):
                    x = _get(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x["w"])) * groups + key + 1), pa.array(x["w"].view(np.int64)), pa.array(x["n"].astype(np.int64))], ["number", "word", "n"])

        return self.named.filter(F.col("kind") == WORDS).mapInArrow(show, "number bigint, word bigint, n bigint")

    def seatings(self) -> DataFrame:
        """sweep, v, w, n, tables of every context's dishes, words by number."""

        def run(table: pa.Table) -> pa.Table:
            p = _get(table.filter(pc.equal(table["kind"], MERGED))["data"][0].as_py())
            v, w, n, _ = _pairs(p)
            own, cols = n > 0, []
            for s, raw in zip(table["sweep"].to_pylist(), table["data"].to_pylist(), strict=True):
                x = _get(raw)
                if "t" in x:
                    t = np.ones(len(n), np.uint64)
                    t[n > 1] = x["t"]
                    cols.append((np.full(int(own.sum()), s), v[own], w[own], n[own], t[own]))
            cols = [np.concatenate(c) for c in zip(*cols, strict=True)]
            return pa.table(dict(zip(("sweep", "v", "w", "n", "tables"), (pa.array(c.astype(np.int64)) for c in cols), strict=True)))

        out = self.merged.filter(F.col("kind") == MERGED)
        for k, (state, _) in enumerate(self.kept):
            out = out.unionByName(state.filter(F.col("kind") == STATE).withColumn("sweep", F.lit(k)))
        return out.groupBy("key").applyInArrow(run, "sweep bigint, v bigint, w bigint, n bigint, tables bigint")

    def parents(self) -> DataFrame:
        """sweep, w, customers, tables of the parent's dishes, words by number."""
        groups, out = self.groups, None

        def show(batches):
            for b in batches:
                for key, s, raw in zip(*(b[c].to_pylist() for c in ("key", "sweep", "data")), strict=True):
                    x = _get(raw)
                    cols = np.full(len(x["c"]), s), np.arange(len(x["c"])) * groups + key + 1, x["c"], x["t"]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["sweep", "w", "customers", "tables"])

        for k, (_, above) in enumerate(self.kept):
            one = above.filter(F.col("kind") == ROOT).withColumn("sweep", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out.mapInArrow(show, "sweep bigint, w bigint, customers bigint, tables bigint")


def _pairs(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count, context's index) of every pair of a packed list."""
    at = np.repeat(np.arange(len(p["v"])), p["len"].astype(np.int64))
    return p["v"][at], _rising(p["w"], p["len"]), p["n"].astype(np.int64), at


def _pack_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    first, size = B.runs(v)
    return {"v": v[first], "len": size, "w": _falling(w, size), "n": n, "hot": hot[first]}


def _read(batches):
    """Chunks: distinct words, tokens as places among them, and the documents."""
    part, k = TaskContext.get().partitionId(), 0
    for rows in X.slices(batches, CHUNK):
        w, first = _tokens(rows["text"])
        words, tok = np.unique(w, return_inverse=True)
        sizes, ids = np.diff(first), rows["doc_id"]
        held = rows["held"].to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(tok[~np.repeat(held, sizes)], minlength=len(words))
        data = _put(words=words, tok=tok, n=n, sizes=sizes, held=held, ids=ids.fill_null(0).to_numpy().view(np.uint64), null=ids.is_null().to_numpy(zero_copy_only=False))
        yield from _batches([((part << 32) + k, CHUNKS, data)])
        k += 1


def fit(rows: DataFrame, groups: int, burn_in: int = 1, samples: int = 2, strength: float = 1.0, seed: int = 17) -> Model:
    """A model of the texts of (doc_id, text, held) that are not held; those held are numbered and paired with it."""
    scratch = Scratch(rows.sparkSession, "pitman-yor")
    keep = lambda df, name: scratch.keep(df, name, "kind")
    kind = lambda df, *k: df.filter(F.col("kind").isin(*k))

    def offer(batches):
        for b in batches:
            for key, raw in zip(b["key"].to_pylist(), b["data"].to_pylist(), strict=True):
                x = _get(raw)
                yield from _batches(_dealt((x["words"] % _U(groups)).astype(np.int64), WORDS, key, w=x["words"], n=x["n"]))

    def number(table: pa.Table) -> pa.Table:
        """Numbers a bucket's words by frequency; words of held texts alone are 0."""
        parts, bucket = [_get(d) for d in table["data"].to_pylist()], _key(table)
        words, back = np.unique(np.concatenate([p["w"] for p in parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([p["n"] for p in parts]), len(words)).astype(np.uint64)
        known = np.flatnonzero(n)
        known = known[np.lexsort((words[known], -n[known].astype(np.int64)))]
        rank = np.zeros(len(words), np.uint64)
        rank[known] = np.arange(1, len(known) + 1)
        out = [(bucket, WORDS, _put(w=words[known], n=n[known])), (0, TOTAL, _put(sums=np.array([n.sum(), len(known)])))]
        lo = 0
        for p in parts:
            at = back[lo : lo + len(p["w"])]
            out.append((int(p["sender"][0]), IDS, _put(r=rank[at], n=n[at], sender=_one(bucket))))
            lo += len(at)
        return _table(out)

    chunks = keep(rows.select("doc_id", "text", "held").mapInArrow(_read, _ROW), "chunks")
    named = keep(chunks.mapInArrow(offer, _ROW).groupBy("key").applyInArrow(number, _ROW), "named")
    tokens, kinds = (int(v) for v in _sum(named, {"sums": 2})["sums"])
    totals = Totals(tokens, kinds, strength)
    norm = np.log10(tokens + 0.5 * (kinds + 1))

    def pair(table: pa.Table) -> pa.Table:
        """A chunk's distinct pairs to their buckets, and each document's places among them."""
        r, chunk = _by_kind(table), _key(table)
        x = _get(r[CHUNKS][0])
        at = (x["words"] % _U(groups)).astype(np.int64)
        rank, n = _answered(at, _of(r, IDS), "r", "n")
        numbers = np.where(rank > 0, (rank - np.minimum(rank, _U(1))) * _U(groups) + at.astype(np.uint64) + _U(1), _U(0))
        u, code = np.unique(numbers, return_inverse=True)
        count = np.zeros(len(u), np.int64)
        count[code] = n
        w, sizes = code[x["tok"].astype(np.int64)], x["sizes"].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        v = np.r_[0, w[:-1]]
        v[first] = code[np.searchsorted(x["words"], _END)]
        pairs, back = np.unique(v * len(u) + w, return_inverse=True)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        held = x["held"] > 0
        times = np.bincount(back[~held[doc]], minlength=len(pairs))
        pv, pw = pairs // len(u), pairs % len(u)
        hot = count[pv] * 2 * groups > tokens
        bucket = (np.where(hot, X.combine(u[pv], u[pw]), X.mix(u[pv])) % _U(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mine = np.sort(doc * len(pairs) + place[back]) - doc * len(pairs)
        often = np.log10(count + 0.5) - norm
        out = [(chunk, TOKENS, _put(at=_falling(mine, sizes), sizes=sizes, ids=x["ids"], null=x["null"], held=x["held"], known=np.bincount(doc, count[w] > 0, len(sizes)), base=np.bincount(doc, often[w], len(sizes))))]
        starts, size = B.runs(bucket[order])
        for a, m in zip(starts.tolist(), size.tolist(), strict=True):
            o = order[a : a + m]
            out.append((int(bucket[o[0]]), PAIRS, _put(**_pack_pairs(u[pv[o]], u[pw[o]], times[o], hot[o]), sender=_one(chunk))))
        return _table(out)

    paired = keep(chunks.unionByName(kind(named, IDS)).groupBy("key").applyInArrow(pair, _ROW), "paired")
    scratch.drop("chunks", f"named/kind={IDS}")

    def told(bucket: int, what: int, **lists: dict[str, np.ndarray]) -> list:
        """One row for each bucket in which words of the lists lie: the words' places there (`_r`) and what else a list says of its `words`."""
        out: dict[int, dict[str, np.ndarray]] = {}
        for name, fields in lists.items():
            numbers = fields["words"]
            real = np.flatnonzero(numbers > 0)
            target = _bucket(numbers[real], groups)
            order = np.argsort(target, kind="stable")
            at, target = real[order], target[order]
            first, size = B.runs(target)
            for a, n in zip(first.tolist(), size.tolist(), strict=True):
                mine = at[a : a + n]
                out.setdefault(int(target[a]), {}).update({f"{name}_r": _place(numbers[mine], groups)} | {f"{name}_{k}": v[mine] for k, v in fields.items() if k != "words"})
        none = {f"{name}_{k}": np.zeros(0, np.uint64) for name, fields in lists.items() for k in ("r", *fields) if k != "words"}
        return [(b, what, _put(**none | fields, sender=_one(bucket))) for b, fields in out.items()]

    def merge(table: pa.Table) -> pa.Table:
        """A bucket's pairs, where each chunk's stand among them, and what sweeps and parents need of them."""
        parts, bucket = [_get(d) for d in table["data"].to_pylist()], _key(table)
        lists = [_pairs(p) for p in parts]
        v, w, n = (np.concatenate([x[k] for x in lists]) for k in range(3))
        hot = np.concatenate([p["hot"][x[3]] for p, x in zip(parts, lists, strict=True)])
        order = np.lexsort((w, v))
        first, size = B.runs(v[order], w[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(first)), size)
        n = np.add.reduceat(n[order], first)
        v, w, hot = (a[order[first]] for a in (v, w, hot))
        packed = _pack_pairs(v, w, n, hot)
        out, lo = [(bucket, MERGED, _put(**packed))], 0
        for p, x in zip(parts, lists, strict=True):
            out.append((bucket, AT, _put(at=back[lo : lo + len(x[0])], sender=p["sender"])))
            lo += len(x[0])
        words, at = np.unique(w, return_inverse=True)
        sum_by = lambda a, k: np.bincount(a, k, len(words))
        out += told(bucket, ASK, word={"words": words, "c": sum_by(at, n > 0), "once": sum_by(at, n == 1)})
        contexts, ctx = packed["v"], np.repeat(np.arange(len(packed["v"])), packed["len"])
        dishes, single = (np.bincount(ctx, k, len(contexts)) for k in (n > 0, n == 1))
        is_hot = packed["hot"] > 0
        out += told(bucket, AGAIN, word={"words": np.unique(w[n > 1])}, hot={"words": contexts[is_hot], "t": dishes[is_hot]})
        many = n > 1
        again = _pack_pairs(v[many], w[many], n[many], hot[many])
        out.append((bucket, REPEATED, _put(**again, single=single[np.searchsorted(contexts, again["v"])], hot_v=contexts[is_hot], hot_single=single[is_hot])))
        out.append((bucket, STATE, _put(t=np.ones(int(many.sum()), np.uint64))))
        out.append((0, TOTAL, _put(sums=np.array([(n == 1).sum(), (n == 2).sum()]))))
        return _table(out)

    merged = keep(kind(paired, PAIRS).groupBy("key").applyInArrow(merge, _ROW), "merged")
    scratch.drop(f"paired/kind={PAIRS}")
    totals.d = _discount(*_sum(merged, {"sums": 2})["sums"])

    def parents(inputs: DataFrame, sweep: int, name: str) -> DataFrame:
        held = inputs.sparkSession.sparkContext.broadcast(totals)  # a few numbers

        def seat_parents(table: pa.Table) -> pa.Table:
            m, r, bucket = held.value, _by_kind(table), _key(table)
            again = _of(r, AGAIN)
            tables = {int(y["sender"][0]): y for y in (_of(r, TABLES) if sweep else again)}
            if sweep:
                ((n, once),) = ((x["n"], x["once"]) for x in _of(r, ROOT))
                c = once.astype(np.int64)
                for p in again:
                    c[p["word_r"].astype(np.int64)] += tables[int(p["sender"][0])]["word_t"].astype(np.int64)
                t = seat(c, np.full(len(c), (m.strength + m.root_d * m.sweeps[-1][1]) / (m.words + 1)), m.root_d, np.random.default_rng((seed + sweep, bucket, 1)))
            else:
                n = _get(r[WORDS][0])["n"] if WORDS in r else np.zeros(0, np.uint64)
                c, once = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for p in _of(r, ASK):
                    at = p["word_r"].astype(np.int64)
                    c[at] += p["word_c"].astype(np.int64)
                    once[at] += p["word_once"].astype(np.int64)
                t = np.ones(len(c), np.int64)
            out = [(bucket, ROOT, _put(n=n, once=once, c=c, t=t)), (0, TOTAL, _put(sums=np.array([c.sum(), t.sum(), (c == 1).sum(), (c == 2).sum()])))]
            total = np.zeros(len(n), np.int64)
            for p in again:
                total[p["hot_r"].astype(np.int64)] += tables[int(p["sender"][0])]["hot_t"].astype(np.int64)
            for p in again:
                at, hot = p["word_r"].astype(np.int64), p["hot_r"].astype(np.int64)
                out.append((int(p["sender"][0]), MASS, _put(c=c[at], t=t[at], hot_t=total[hot], hot_n=n[hot], sender=_one(bucket))))
            return _table(out)

        return keep(inputs.groupBy("key").applyInArrow(seat_parents, _ROW), name)

    def sweep_of(state: DataFrame, above: DataFrame, number: int) -> DataFrame:
        held = state.sparkSession.sparkContext.broadcast(totals)

        def reseat(table: pa.Table) -> pa.Table:
            r, bucket, m = _by_kind(table), _key(table), held.value
            p, mass = _get(r[REPEATED][0]), _of(r, MASS)
            _, w, n, ctx = _pairs(p)
            before = p["single"] + np.bincount(ctx, _get(r[STATE][0])["t"], len(p["v"]))
            tables = _answered(_bucket(p["hot_v"], groups), mass, "hot_t")[0]
            before = np.where(p["hot"] > 0, _found(p["hot_v"], tables, p["v"], before), before)
            words, back = np.unique(w, return_inverse=True)
            parent = m.parent(*(a.astype(np.float64) for a in _answered(_bucket(words, groups), mass, "c", "t")), -1)[back]
            t = seat(n, (m.strength + m.d * before[ctx]) * parent, m.d, np.random.default_rng((seed + number, bucket)))
            own = p["hot_single"] + _found(p["v"], np.bincount(ctx, t, len(p["v"])), p["hot_v"], np.zeros(len(p["hot_v"])))
            return _table([(bucket, STATE, _put(t=t)), *told(bucket, TABLES, word={"words": words, "t": np.bincount(back, t, len(words))}, hot={"words": p["hot_v"], "t": own})])

        return keep(kind(merged, REPEATED).unionByName(kind(state, STATE)).unionByName(kind(above, MASS)).groupBy("key").applyInArrow(reseat, _ROW), f"sweep{number}")

    state = merged
    above = root = parents(kind(named, WORDS).unionByName(kind(merged, ASK, AGAIN)), 0, "above0")
    s = _sum(above, {"sums": 4})["sums"]
    totals.root_d = _discount(s[2], s[3])
    totals.sweeps.append((int(s[0]), int(s[1])))
    kept, kept_totals = [], []
    for k in range(1, burn_in + samples + 1 if tokens else 1):
        last = k - 1
        state = sweep_of(state, above, k)
        above = parents(kind(root, ROOT).unionByName(kind(merged, AGAIN)).unionByName(kind(state, TABLES)), k, f"above{k}")
        s = _sum(above, {"sums": 4})["sums"]
        totals.sweeps.append((int(s[0]), int(s[1])))
        if 0 < last <= burn_in:
            scratch.drop(f"sweep{last}", f"above{last}")
        if k > burn_in:
            kept.append((state, above))
            kept_totals.append(totals.sweeps[-1])
    totals.sweeps = kept_totals or totals.sweeps[-1:]
    return Model(scratch, groups, totals, named, paired, merged, kept or [(state, above)])


def _found(known: np.ndarray, values: np.ndarray, keys: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The values of keys in sorted known ones."""
    if not len(known):
        return otherwise
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], otherwise)


def perplexity_scores(documents: DataFrame, held_out: Column, burn_in: int = 1, samples: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; `held_out` is a condition on doc_id."""
    groups = B.count_of(documents, text_col, 1)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    return scores(fit(rows, groups, burn_in, samples, seed=seed))


def scores(model: Model) -> DataFrame:
    """The columns of perplexity_scores for the texts that the model was fitted among."""
    groups, totals = model.groups, model.totals
    whole = model.merged.sparkSession.sparkContext.broadcast(totals)
    n_kept, total = len(model.kept), totals.tokens
    kind = lambda df, *k: df.filter(F.col("kind").isin(*k))

    def split(table: pa.Table, *kinds: int) -> dict[tuple[int, int], list[dict]]:
        out: dict[tuple[int, int], list[dict]] = {}
        for k, s, d in zip(*(table[c].to_pylist() for c in ("kind", "sweep", "data")), strict=True):
            if k in kinds:
                out.setdefault((k, s), []).append(_get(d))
        return out

    def answer(table: pa.Table) -> pa.Table:
        """To each bucket its words' customers and tables at the parents, in each kept sweep."""
        r, bucket, out = split(table, ROOT, ASK), _key(table), []
        for p in r.get((ASK, 0), []):
            at = p["word_r"].astype(np.int64)
            held = {f"{k}{s}": r[ROOT, s][0][k][at] for s in range(n_kept) for k in "ct"}
            out.append((int(p["sender"][0]), ANSWER, _put(**held, sender=_one(bucket))))
        return _table(out)

    def score(table: pa.Table) -> pa.Table:
        """The logarithm of every pair's mean prediction, to each chunk in the order of its pairs."""
        r, bucket, m = split(table, MERGED, AT, STATE, MASS, ANSWER), _key(table), whole.value
        p = r[MERGED, 0][0]
        _, w, n, ctx = _pairs(p)
        contexts, many, is_hot = p["v"], n > 1, p["hot"] > 0
        words, back = np.unique(w, return_inverse=True)
        real = words > 0
        mean = np.zeros(len(n))
        for s in range(n_kept):
            t = (n > 0).astype(np.int64)
            t[many] = r[STATE, s][0]["t"]
            customers, tables = np.bincount(ctx, n, len(contexts)), np.bincount(ctx, t, len(contexts))
            if is_hot.any():
                all_t, all_n = _answered(_bucket(contexts[is_hot], groups), r.get((MASS, s), []), "hot_t", "hot_n")
                customers[is_hot], tables[is_hot] = all_n, all_t
            c, above = np.zeros(len(words)), np.zeros(len(words))
            c[real], above[real] = _answered(_bucket(words[real], groups), r.get((ANSWER, 0), []), f"c{s}", f"t{s}")
            seated = (m.strength + customers)[ctx]
            mean += ((n - m.d * t) + (m.strength + m.d * tables)[ctx] * m.parent(c, above, s)[back]) / seated / n_kept
        logs = np.log10(mean)
        return _table([(int(x["sender"][0]), LOGS, _put(log=logs[x["at"].astype(np.int64)], sender=_one(bucket))) for x in r[AT, 0]])

    def result(table: pa.Table) -> pa.Table:
        r = _by_kind(table)
        x = _get(r[TOKENS][0])
        logs = np.concatenate([y["log"] for y in sorted(_of(r, LOGS), key=lambda y: int(y["sender"][0]))])
        sizes = x["sizes"].astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        score_ = np.bincount(doc, logs[_rising(x["at"], sizes).astype(np.int64)], len(sizes))
        return pa.table({
            "doc_id": pa.array(x["ids"].view(np.int64), mask=x["null"] > 0), "held_out": pa.array(x["held"] > 0), "n_tokens": pa.array(sizes), "n_known": pa.array(x["known"].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(sizes), total), pa.int64()), "base_score": pa.array(x["base"]), "score": pa.array(score_), "perplexity": pa.array(10 ** (-score_ / sizes)),
        })

    asked, mixed = kind(model.merged, ASK), kind(model.merged, MERGED, AT)
    for s, (state, above) in enumerate(model.kept):
        at = lambda df, s=s: df.withColumn("sweep", F.lit(s))
        asked = asked.unionByName(at(kind(above, ROOT)))
        mixed = mixed.unionByName(at(kind(state, STATE))).unionByName(at(kind(above, MASS)))
    mixed = mixed.unionByName(asked.groupBy("key").applyInArrow(answer, _ROW))
    logs = mixed.groupBy("key").applyInArrow(score, _ROW)
    return kind(model.paired, TOKENS).unionByName(logs).groupBy("key").applyInArrow(result, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
