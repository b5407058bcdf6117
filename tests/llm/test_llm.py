"""Each operator against a brute-force version on small tables with awkward rows."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.llm import _text as X, best_fit_packing as packing, difference_cover, factorisation_machine as fm, pitman_yor, positional_index, prefix_doubling, prefix_forest, redirect_rules, set_relations, stratified_shards

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACED, PLAIN = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 150)))) for i in range(60)]
    for k in range(40):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + k, " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    rows += [(200 + k, f"{word()} {word()}\t{passage} {' '.join(word() for _ in range(k))}") for k in range(15)]
    rows += [(300, None), (301, ""), (302, "A b C"), (303, "a B  c"), (304, " \n"), (305, "z" * 1000), (306, "ab " * 400), (None, "a nameless row " * 30), (307, rows[3][1]), (307, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 301 else None, len(t or ""), 1, 2, 3) for i, t in _rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, home int, rid long, shard int").cache()


def _grouped(rows, key="doc_id"):
    return collections.Counter((r[key], *(tuple(v) if isinstance(v, list) else bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if k != key)) for r in rows)


def test_difference_cover(docs):
    W = 13
    words = [(i, (t or "").encode().split()) for i, t in _rows()]
    first = {}
    for i, w in words:
        for p in range(len(w) - W + 1):
            k = tuple(w[p : p + W])
            first[k] = min(first.get(k, float("inf")), float("inf") if i is None else i)
    want = collections.Counter()
    for i, w in words:
        gone = {q for p in range(len(w) - W + 1) if first[tuple(w[p : p + W])] < (float("inf") if i is None else i) for q in range(p, p + W)}
        want[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = difference_cover.remove_repeated_windows(docs)
    assert _grouped(got.collect()) == want
    assert difference_cover.remove_repeated_windows(docs, carry=("source", "text")).columns[-2:] == ["source", "text"]
    assert difference_cover.remove_repeated_windows(docs.limit(0)).count() == 0
    for v in range(1, 14):
        c = difference_cover.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_prefix_doubling(docs):
    for L in (200, 20):
        texts = [(i, (t or "").encode()) for i, t in _rows()]
        seen = collections.Counter(b[p : p + L] for _, b in texts for p in range(len(b) - L + 1))
        want = collections.Counter()
        for i, b in texts:
            cover = bytearray(len(b))
            for p in range(len(b) - L + 1):
                if seen[b[p : p + L]] > 1:
                    cover[p : p + L] = b"\1" * L
            runs = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
            want[i, len(b), sum(cover), tuple(runs), bytes(x for x, c in zip(b, cover) if not c)] += 1
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in prefix_doubling.remove_repeated_bytes(docs, L).collect())
        assert got == want
    assert prefix_doubling.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_set_relations(docs):
    sets = []
    for i, t in _rows():
        w = SPACED.findall((t or "").encode().translate(LOW))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    want = collections.Counter((i, len(s), least.get(top(k), i) if s else i) for k, (i, s) in enumerate(sets))
    assert _grouped(set_relations.similar_components(docs).drop("rid", "stays").collect()) == want
    assert set_relations.similar_components(docs.limit(0)).count() == 0


def test_positional_index(spark, docs):
    texts = dict(enumerate(t for _, t in _rows()))
    items = [(1, " ".join((texts[100 - 40 + 5] or "").split()[10:40])), (2, "A b C"), (3, None), (4, ""), (5, "zz qq")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").encode().translate(LOW))
        for k in range(max(1, len(w) - 12)) if w else ():
            wins[tuple(w[k : k + 13])].add(str(i))
    want = collections.Counter()
    for i, t in _rows():
        w, hit, found = PLAIN.findall((t or "").encode().translate(LOW)), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if k + n <= len(w) and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        want[i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for more in ({}, {"block": 3, "term_bytes": 200, "few": 0}):
        assert _grouped(positional_index.contamination(docs, bench, **more).drop("rid").collect()) == want
    assert positional_index.contamination(docs.limit(0), bench).count() == 0
    assert positional_index.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    near = positional_index.matches(spark.createDataFrame([(1, "qq and zz")], "doc_id long, text string"), bench, slop=2).filter("start is not null")
    assert [r["items"] for r in near.collect()] == [["5"]]
    words = positional_index.windows(bench, 13).select(F.explode("window").alias("term")).distinct()
    index = positional_index.build_index(docs, words)
    assert _grouped(positional_index.contamination(docs, bench, index=index).drop("rid").collect()) == want
    posted = collections.Counter((r["term"], r["pos"]) for r in index.filter("term <> ''").collect())
    terms = {r["term"] for r in words.collect()}
    assert posted == collections.Counter((w.decode(), p) for _, t in _rows() for p, w in enumerate(PLAIN.findall((t or "").encode().translate(LOW))) if w.decode() in terms)
    far = positional_index.matches(spark.createDataFrame([(1, "zz m n o p r s t qq"), (2, "qq x zz"), (3, "zz zz")], "doc_id long, text string"), bench, slop=1).filter("start is not null")
    assert far.count() == 1


def test_stratified_shards(docs):
    got = stratified_shards.interleave(docs.select("doc_id", "source"), 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == docs.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    by = got.fillna({"source": "-"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert ((by.max(axis=1) - by.min(axis=1)) <= 2).all()
    assert stratified_shards.interleave(docs.limit(0).select("doc_id", "source"), 7).count() == 0


def test_best_fit_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, text in _rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 64)):
            want[i, p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())] += 1
    for size in (20_000, 40):
        got = packing.pack(docs, 64, group_size=size).toPandas()
        assert collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
        got = got.sort_values(["sequence_id", "offset"])
        assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) * 1.1 + 2
    assert packing.pack(docs.limit(0)).count() == 0
    odd = "a\x1cb  don't it's' 12,3 <|endoftext|>x Σ İ ﬁ _a_ ½² naïve!!"
    assert packing.WordIds(packing.default_tokenizer()).of(odd) == np.array(t.encode(odd, add_special_tokens=False).ids, "<u4").tobytes()


def test_swaps_empty_a_bin():
    lengths = [6, 4, 4, 3, 3]
    bins = packing.swap_search([[0, 3], [1, 2], [4]], lengths, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]


def test_prefix_forest(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((900, 16))
    m[400:500] = m[0] + 0.01 * rng.standard_normal((100, 16))
    m[500:520] = m[1]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (2200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = prefix_forest.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    norm = np.linalg.norm(m, axis=1)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = np.einsum("ij,j->i", m, m[q]) / (norm * norm[q])
        s[q] = -9
        top = np.lexsort((np.arange(900), -s))[:5]
        hit += len(set(top) & set(g.vec_id))
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and np.allclose(g.score, s[g.vec_id])
    assert len(got) == 90 and hit >= 0.9 * 90
    assert prefix_forest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_redirect_rules(spark):
    pages = [(1, "http://a.com/en/1", '<link rel="canonical" href="http://b.io/x">'), (2, "http://b.io/x", None), (3, "http://c.io/", '<meta http-equiv="refresh" content="0; url=http://b.io/x">'), (4, None, None), (5, "nope", "x"), (6, "http://EXAMPLE.com/en/7?x", '<link href="http://z.io/" rel=canonical>'), (7, "http://z.io/", ""), (8, "http://q.com/en/", '<link href="http://z.io/" rel=canonical>'), (9, "x://www.de.net/de/8", None)]
    got = {r["page_id"]: tuple(r)[1:5] for r in redirect_rules.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.com", "/en/1", "com/en/", "block"), 2: ("b.io", "/x", None, "block"), 3: ("c.io", "/", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("example.com", "/en/7", "example.com/en/7", "allow"), 7: ("z.io", "/", None, "allow"), 8: ("q.com", "/en/", "com/en/", "block"), 9: ("www.de.net", "/de/8", "net/de/", "allow"),
    }


def test_factorisation_machine(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, ("WORSE!! " * 30 if i % 3 == 0 else " ".join("abcde"[: k + 1] for k in rng.integers(0, 5, 40))), None, 1 if i % 3 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, quality int")
    m = fm.train(df, df.select("doc_id", "quality"), F.col("doc_id") % 5 != 0)
    s = {r["doc_id"]: r["score"] for r in fm.score(df, m).collect()}
    assert np.mean([(s[i] >= 0.5) == (i % 3 > 0) for i in range(0, 400, 5)]) > 0.98
    words, first, bins = fm.features(df.limit(5).toArrow()["text"], np.full(5, np.nan))
    for i in range(5):  # the pairwise sum itself
        x = collections.defaultdict(list)
        parts = [(f, 1.0) for f in bins[i]] + [(f, 1 / max(1, first[i + 1] - first[i])) for f in words[first[i] : first[i + 1]]]
        v = np.array([m.factors[f] * a for f, a in parts])
        pair = sum(v[a] @ v[b] for a in range(len(v)) for b in range(a))
        assert abs(m.raw(words, first, bins)[i] - (m.bias + sum(m.linear[f] * a for f, a in parts) + pair)) < 1e-8
    assert len(fm.score(docs, m, carry=("source",)).collect()) == docs.count() and fm.score(docs.limit(0), m).count() == 0
    none = fm.train(df, df.limit(0).select("doc_id", "quality"), F.lit(True))
    assert {r["score"] for r in fm.score(docs, none).collect()} == {0.5}


def test_pitman_yor(docs, monkeypatch):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    got = pitman_yor.perplexity_scores(docs, held).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    texts = [(i, [*SPACED.findall((t or "").encode().translate(LOW)), 0]) for i, t in _rows()]
    c = collections.Counter(w for i, ws in texts if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in texts)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in pitman_yor.perplexity_scores(docs, held).collect()}
    assert all(abs(again[r["doc_id"], r["n_tokens"]] - r["score"]) < 1e-9 for r in got)
    # the model's own seatings, by the formulas, with few and many hot contexts and chunks
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    h = lambda w: int(pitman_yor._END) if w == 0 else int(X.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[3][0])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for groups, chunk in ((5, pitman_yor.CHUNK), (60, 500)):
        monkeypatch.setattr(pitman_yor, "CHUNK", chunk)
        model = pitman_yor.fit(rows, groups)
        m, kept = model.totals, len(model.kept)
        numbers = {r["word"]: r["number"] for r in model.words().collect()}
        assert len(set(numbers.values())) == len(numbers) == m.words == len(c)
        assert {r["number"]: r["n"] for r in model.words().collect()} == {numbers[signed(h(w))]: k for w, k in c.items()}
        seats = [collections.defaultdict(dict) for _ in range(kept)]
        for r in model.seatings().collect():
            seats[r["sweep"]][r["v"]][r["w"]] = (r["n"], r["tables"])
        roots = [{} for _ in range(kept)]
        for r in model.parents().collect():
            roots[r["sweep"]][r["w"]] = (r["customers"], r["tables"])
        for k in range(kept):
            below = collections.Counter()
            for dishes in seats[k].values():
                for w, (n, t) in dishes.items():
                    assert 1 <= t <= n
                    below[w] += t
            assert {w: x for w, (x, _) in roots[k].items()} == below and len(roots[k]) == m.words

        def probability(v, w):
            total = 0.0
            for k in range(kept):
                customers, tables = m.sweeps[k]
                c0, t0 = roots[k].get(w, (0, 0))
                parent = (c0 - m.root_d * t0 + (m.strength + m.root_d * tables) / (m.words + 1)) / (m.strength + customers)
                dishes = seats[k].get(v, {})
                x, t = dishes.get(w, (0, 0))
                total += (x - m.d * t + (m.strength + m.d * sum(y for _, y in dishes.values())) * parent) / (m.strength + sum(y for y, _ in dishes.values()))
            return total / kept

        for v in [*list(seats[0])[:20], 0]:
            assert abs(sum(probability(v, w) for w in roots[0]) + probability(v, 0) - 1) < 1e-9
        want = collections.Counter()
        for i, ws in texts:
            ids = [numbers.get(signed(h(w)), 0) for w in ws]
            want[i, round(sum(np.log10(probability(v, w)) for v, w in zip([numbers[signed(h(0))], *ids], ids)), 6)] += 1
        assert collections.Counter((r["doc_id"], round(r["score"], 6)) for r in pitman_yor.scores(model).collect()) == want
    untaught = pitman_yor.perplexity_scores(docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in untaught} == {0} and {r["n_known"] for r in untaught} == {0} and len(untaught) == len(texts)
    assert pitman_yor.perplexity_scores(docs.limit(0), held).count() == 0
