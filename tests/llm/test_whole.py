"""Cases in which an operator once did less than its whole job."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklane.llm import _text as X, best_fit_packing, difference_cover, factorisation_machine as fm, prefix_doubling, prefix_forest, redirect_rules, set_relations, stratified_shards


def _thue_morse(n: int, first: str = "a", second: str = "b") -> str:
    return "".join((first, second)[bin(i).count("1") % 2] for i in range(n))


def test_structured_words(spark):
    """Words and their complements, which polynomials modulo a power of two do not tell apart."""
    sizes = (4, 8, 64, 128, 512, 1024, 4096)
    both = [(_thue_morse(n), _thue_morse(n, "b", "a")) for n in sizes]
    h = X.words(*X.buffers(pa.array([" ".join(w) for w in both])))[3]
    assert len(np.unique(h)) == len(h)
    rows = []
    for k, (x, y) in enumerate(both):
        tail = " ".join(f"w{k}x{i}" for i in range(12))
        rows += [(2 * k, f"{x} {tail}"), (2 * k + 1, f"{y} {tail}"), (100 + 2 * k, " ".join([x] + [f"u{k}y{i}" for i in range(4)])), (101 + 2 * k, " ".join([y] + [f"u{k}y{i}" for i in range(4)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_removed"] for r in difference_cover.remove_repeated_windows(df).collect()} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in set_relations.similar_components(df.filter("doc_id >= 100")).collect())
    data = np.frombuffer((_thue_morse(4096) + _thue_morse(4096, "b", "a")).encode(), np.uint8)
    for size in (5, 8, 12, 100, 200):
        seen = collections.defaultdict(set)
        for p, v in enumerate(X.window_hash(data, size).tolist()):
            seen[v].add(data[p : p + size].tobytes())
        assert max(map(len, seen.values())) == 1 and len(seen) == len({b for v in seen.values() for b in v})


def test_long_texts(spark, monkeypatch):
    """Texts far longer than a step, worked through in pieces."""
    monkeypatch.setattr(X, "STEP", 5000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    long = [" ".join(word() for _ in range(n)) for n in (9000, 30, 4000)] + ["z" * 30_000, "", "q" * 4999 + " " + "r" * 5001]
    long.append(long[0][7000:31_000] + long[2] + long[0][:900])
    texts = [t.encode() for t in long]
    data, off = X.buffers(pa.array(long))
    start, end, doc, h = X.words(data, off)
    want = [(i, m) for i, t in enumerate(texts) for m in t.split()]
    assert [(int(d), data[a:b].tobytes()) for a, b, d in zip(start, end, doc)] == want
    assert (X.words(*X.buffers(pa.array([m.decode() for _, m in want])))[3] == h).all()
    L = 200
    rank, ctx, d, lo, n = prefix_doubling._ranked(data, off, L)
    cover = collections.Counter((i, p + k) for i, p, m in zip(d.tolist(), lo.tolist(), n.tolist()) for k in range(m + 1))
    assert cover == {(i, p): 1 for i, t in enumerate(texts) for p in range(len(t) - L + 1)}
    wd = np.repeat(d, n.astype(int) + 1).astype(np.int64)
    wl = np.concatenate([np.arange(a, a + m + 1) for a, m in zip(lo.astype(int), n.astype(int))])
    key, more = prefix_doubling._whole(data, off, L, wd, wl)
    strings = [texts[a][b : b + L] for a, b in zip(wd, wl)]
    assert len(set(strings)) == len(set(key.tolist())) == len(set(zip(strings, key.tolist(), more.tolist())))
    groups = collections.defaultdict(set)
    for r, c, i, p, m in zip(rank.tolist(), ctx.tolist(), d.tolist(), lo.tolist(), n.tolist()):
        groups[r, c].add(texts[i][p : p + m + L])
    assert max(map(len, groups.values())) == 1


def test_long_texts_end_to_end(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(400_000))  # some 2.6 MB
    rows = [(1, long), (2, long[1_000_000:1_400_000] + " end"), (3, "short"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["n_removed"] for r in prefix_doubling.remove_repeated_bytes(df).collect()}
    assert cut == {1: 400_000, 2: 400_000, 3: 0, 4: 0}
    words = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in difference_cover.remove_repeated_windows(df).collect()}
    n = len(rows[1][1].split())
    assert words[1] == (400_000, 0) and words[2][0] == n and n - 4 <= words[2][1] < n
    assert {r["doc_id"]: r["component_id"] for r in set_relations.similar_components(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    m = fm.Machine(0.1, np.zeros(fm.SIZE), np.ones((fm.SIZE, 2)) * 0.1)
    assert all(0 <= r["score"] <= 1 for r in fm.score(df, m).collect())


def test_many_copies_and_dissimilar_sets_of_one_list(spark, monkeypatch):
    monkeypatch.setattr(set_relations, "HOT_LOG", 6)
    monkeypatch.setattr(set_relations, "OPEN_BLOCK", 100)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(5000)]  # copies
    rows += [(10_000 + i, " ".join(base[:i % 50] + [f"n{i}"] + base[i % 50 + 1:])) for i in range(300)]  # near copies
    common = "c1 c2 c3 c4 c5"
    for i in range(700):  # texts that share one shingle of two each
        own = [f"d{i}x{k}" for k in range(rng.randint(1, 2) if i % 3 else 0)]
        rows.append((20_000 + i, " ".join([common, *own])))
    rows += [(30_000 + i, None if i % 2 else "c1 c2") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), []).append(i)
    kinds = list(sets)
    index = collections.defaultdict(list)
    for k, s in enumerate(kinds):
        for g in s:
            index[g].append(k)
    up = list(range(len(kinds)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(kinds):
        for o, c in collections.Counter(o for g in s for o in index[g]).items():
            if o != k and 100 * c >= 80 * (len(s) + len(kinds[o]) - c):
                up[top(k)] = top(o)
    least = {}
    for k, s in enumerate(kinds):
        least[top(k)] = min([least.get(top(k), 10**9), *sets[s]])
    want = {i: (len(s), least[top(k)] if s else i) for k, s in enumerate(kinds) for i in sets[s]}
    got = set_relations.similar_components(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert sum(r["stays"] for r in got) == len({c for _, c in want.values()})


def test_vectors_of_any_size(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [2.0, 1.0]), (3, [-1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.5]), (100, [5e-324, 0.0]), (100, [5e-324, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, row string, d double")
    got = collections.defaultdict(list)
    for r in prefix_forest.nearest(df, F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert got[0] == [(1, 1.0), (100, round(2 / 5**0.5, 9))] and got[50] == [(51, round(15.5 / (14 * 17.25) ** 0.5, 9))]
    assert len(got[100]) == 4 and (1, round(2 / 5**0.5, 9)) in got[100]  # two rows of one id, each a query


def test_shards_of_tied_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 9, 8)] * 40 + [(None, None, None, None, None)] * 9, "doc_id long, source string, _row string, shard int, SLOT int")
    got = stratified_shards.interleave(df, 4).collect()
    assert list(got[0].asDict()) == ["doc_id", "source", "_row", "shard", "slot"]
    sizes = collections.Counter(r["shard"] for r in got)
    assert sum(sizes.values()) == 49 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_no_machine_local_folder_on_a_cluster():
    from tracklane.llm import _graph

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        _graph.checkpoint_dir(Session)


def test_relative_links_stay_on_their_hosts(spark):
    link = lambda h: f'<link rel="canonical" href="{h}">'
    pages = [
        (1, "http://a.com/en/1", link("/")), (2, "http://b.io/x", link("/")), (3, "http://b.io", None), (4, "http://d.io/p?p=2", link("?p=1")), (5, "http://e.com/en/q", link("?p=1")),
        (6, "http://a.com/", None),  # alias of 1, which a rule blocks
        (7, "http://F.io/s/t/u", '<link href=../v rel=canonical><link rel=canonical href="//example.com/en/7?a=1&amp;b=&#x32;#top">'), (8, "http://f.io/s/v", None),
        (9, "http://g.io/1", '<meta http-equiv=refresh content="0; url=2"><meta http-equiv=refresh content="1; url=/en/3">'), (10, "http://g.io/en/3", None), (11, "http://g.io/2", link("http://x.com/en/")),
        (12, "nope", link("/")), (13, "http://h.io/", '<base href="http://a.com/en/">' + link("1")), (14, "http://i.io/", link("mailto:x@a.com")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in redirect_rules.judge(df).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "block", 12: "allow", 13: "block", 14: "allow"}
    edges = {(r["a"], r["b"]) for r in redirect_rules.page_edges(df).collect()}
    assert ("http://f.io/s/t/u", "http://example.com/en/7?a=1&b=2") in edges and ("http://f.io/s/t/u", "http://f.io/s/v") in edges and ("http://d.io/p?p=2", "http://d.io/p?p=1") in edges
    assert not any("mailto" in b or not b.startswith("http://") for _, b in edges)
    moved = spark.createDataFrame([("http://j.io/a", "b"), ("http://k.com/en/a", "../b")], "from_url string, to_url string")
    more = spark.createDataFrame([(1, "http://j.io/b", None), (2, "http://k.com/b", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in redirect_rules.judge(more, redirects=moved).collect()} == {1: "allow", 2: "block"}
    one = spark.range(1).select(*(redirect_rules.resolve(F.lit(h), F.lit("http://a/b/c/d;p?q")).alias(f"c{i}") for i, h in enumerate(("g", "./g/.", "..", "../..", "../../../g", "g?y/./x", "", "?y", "//G", "#s")))).first()
    assert list(one) == ["http://a/b/c/g", "http://a/b/c/g/", "http://a/b/", "http://a/", "http://a/g", "http://a/b/c/g?y/./x", "http://a/b/c/d;p?q", "http://a/b/c/d;p?y", "http://g/", "http://a/b/c/d;p?q"]


def test_swaps_reach_past_the_fullest_bins():
    lengths = [97] * 64 + [60, 40, 40, 30, 30]
    lone = [[i] for i in range(64)]  # no piece fits their gap of 3 and none can come back
    bins = best_fit_packing.swap_search([*lone, [64, 67], [65, 66], [68]], lengths, 100)
    assert len(bins) == 66 and sorted(i for b in bins for i in b) == list(range(69))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 100


def test_no_exchange_is_left():
    rng = random.Random(3)
    for k in range(40):
        lengths = sorted((rng.randint(1, 60) for _ in range(80)), reverse=True)
        bins = best_fit_packing.swap_search(best_fit_packing.best_fit(lengths, 100) if k % 2 else [[i] for i in range(80)], lengths, 100, near=2)
        assert sorted(i for b in bins for i in b) == list(range(80))
        fill = [sum(lengths[i] for i in b) for b in bins]
        assert max(fill) <= 100
        if len(bins) > -(-sum(lengths) // 100):
            pairs = [(a, b) for a in range(len(bins)) for b in range(len(bins)) if a != b and fill[a] < fill[b] < 100]
            assert not any(best_fit_packing._exchange(bins[a], bins[b], 100 - fill[b], lengths) for a, b in pairs)


def test_other_tokenizers_go_the_long_way():
    from tokenizers import Tokenizer

    other = best_fit_packing.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    ids, whole = best_fit_packing.WordIds(other), Tokenizer.from_file(other)
    assert not ids.by_words and best_fit_packing.WordIds(best_fit_packing.default_tokenizer()).by_words
    for t in ("Hello  World it's 12", "", "x\n\ny"):
        assert ids.of(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pages_with_clashing_names_repeats_and_none(spark):
    link = '<link rel=canonical href="http://k.com/en/1">'
    rows = [(1, "http://a.io/", link, 1, "x", "y", "z")] * 3 + [(2, None, link, 1, "x", "y", "z"), (None, "http://a.io/", None, 1, "x", "y", "z"), (3, "http://a.io/", None, 1, "x", "y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _node int, host string, rule string, alias_verdict string")
    got = collections.Counter(tuple(r)[:5] for r in redirect_rules.judge(df).collect())
    page = lambda i: (i, "a.io", "/", None, "block")
    assert got == {page(1): 3, page(None): 1, page(3): 1, (2, "", "", None, "allow"): 1}
    assert redirect_rules.judge(df.limit(0)).count() == 0


def test_query_columns_of_scores_and_shards(spark, tmp_path):
    import zlib

    from tracklane.llm import queries

    rows = [(i, None if i == 3 else "" if i == 4 else f"text é {i % 7}", "en", None if i % 5 else "s", i) for i in range(80)] + [(None, "x", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 2), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for r in queries.quality(spark, str(tmp_path)).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    got = queries.shards(spark, str(tmp_path)).collect()
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]), "rows", None)
    sizes = collections.Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    # the assignment itself: fractional ranks within each source, in the order of the seeded hash
    hashed = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i, zlib.crc32(texts[i])) for i in texts], "doc_id long, c long").select("doc_id", F.xxhash64(F.lit(7), "doc_id", "c").alias("h")).collect()}
    by = collections.defaultdict(list)
    for i, _, _, s, _ in rows:
        by["=" + s if s else "-"].append(i)
    ranked = sorted(((2 * k + 1) / (2 * len(ids)), s, i) for s, ids in by.items() for k, i in enumerate(sorted(ids, key=hashed.get)))
    place = {i: k for k, (_, _, i) in enumerate(ranked)}
    assert {r["doc_id"]: r["shard"] for r in got} == {i: k * 24 // len(rows) for i, k in place.items()}


def _shuffled(spark) -> int:
    """Bytes of all shuffles so far."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty(30_000)
    none = gateway.jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_travel_only_where_they_may_be_similar(spark):
    """Passages make many candidates of texts that are far from similar; a few are."""
    rng = random.Random(11)
    passages = [[f"p{k}x{rng.randrange(10**6)}" for _ in range(60)] for k in range(240)]
    dealt = list(range(240)) * 6
    rng.shuffle(dealt)
    rows = []
    for i in range(240):
        own = [f"o{i}x{rng.randrange(10**6)}" for _ in range(5)]
        rows.append((i, " ".join(own + [w for k in dealt[6 * i : 6 * i + 6] for w in passages[k]])))
    rows += [(1000 + i, rows[i][1] + f" end{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = _shuffled(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["doc_id"]: r["component_id"] for r in set_relations.similar_components(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: i % 1000 for i, _ in rows}
    assert _shuffled(spark) - before < 7 * sum(len(t) for _, t in rows)


def test_marks_bound_what_sets_share(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 3000):
        a = np.unique(X.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        for share in (0, 0.1, 0.5, 0.9, 1):
            b = np.union1d(a[: int(share * len(a))], X.mix(rng.integers(0, 2**63, n).astype(np.uint64)))[:n]
            most = set_relations._most(set_relations._marks(a), len(a), b)
            assert len(np.intersect1d(a, b)) <= most <= len(a)
        assert set_relations._most(set_relations._marks(a), len(a), a) == len(a)
    assert most < 3000 or share == 1


def test_full_counters_still_tell_passages(spark, monkeypatch):
    """Counters that hold many shingles each: a passage of 80 texts counts as more frequent than what is in one text only."""
    monkeypatch.setattr(set_relations, "SKETCH_BITS", 8)
    rng = random.Random(5)
    passage = " ".join(f"c{i}" for i in range(5))
    rows = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(800)) for _ in range(100)] + [passage] * 80
    known = np.frombuffer(set_relations.frequency_classes(spark.createDataFrame([(t,) for t in rows], "text string"), 5), np.uint8)
    at = int(set_relations.shingle_sets(pa.array([passage]), 5)[0][0] & np.uint64(255))
    assert known[at] > np.quantile(known, 0.98)
