"""The pipeline's stages and its whole run against plain Python, on tables with awkward rows."""

import collections
import random
import re

import pytest

import corpus_pipeline as cp
from tracklane.llm import factorisation_machine as fm

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, rid long, score double, n_removed string, n_words int, kept_text string, _document int, shard int"


def _tables(folder, spark, empty: bool):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 6)))
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    item = " ".join(passage[:30])
    texts = [(i, " ".join(word() for _ in range(rng.randint(30, 90)))) for i in range(60)]
    texts += [(100 + k, " ".join(base[:k] + [word()] + base[k + 1 :])) for k in range(25)]
    texts += [(200 + k, " ".join([word() for _ in range(20 + k)] + passage + [word() for _ in range(9)])) for k in range(6)]
    texts += [(300 + k, "BUY NOW!!! " * 40 + word()) for k in range(30)]
    texts += [(400, texts[3][1]), (401, texts[3][1].upper()), (402, None), (403, ""), (404, " \n"), (405, "one two"), (406, "one two"), (None, texts[5][1]), (None, None), (407, "word " * 30_000), (408, texts[7][1]), (408, texts[7][1]), (7, texts[7][1])]
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), 1, 2.0, "x", 4, "k", 5, 6) for i, t in texts]
    docs = spark.createDataFrame(rows[: 0 if empty else None], COLUMNS)
    labels = [(i, 0 if 300 <= (i or 0) < 400 else 1, 0) for i in range(60)] + [(300 + k, 0, 0) for k in range(30)]
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def _after_join(rows):
    """One row of each group; the least id, a null last."""
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().translate(LOW).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    best, kept = {}, []
    for k, r in enumerate(rows):
        name = ("w", top(k)) if sets[k] else ("e", r["doc_id"], r["text"])
        if name not in best or (r["doc_id"] is None, r["doc_id"] or 0) < (best[name]["doc_id"] is None, best[name]["doc_id"] or 0):
            best[name] = r
    for r in best.values():
        kept.append((r["doc_id"], r["text"], r["n_chars"]))
    return collections.Counter(kept)


def _after_substrings(rows):
    words = [((float("inf") if r["doc_id"] is None else r["doc_id"]), (r["text"] or "").encode().split()) for r in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - 12):
            first[tuple(w[p : p + 13])] = min(first.get(tuple(w[p : p + 13]), i), i)
    out = []
    for r, (i, w) in zip(rows, words):
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r["text"]
        out.append((r["doc_id"], text, len(text) if gone else r["n_chars"]))
    return collections.Counter(out)


def _after_decontamination(rows, item):
    w = PLAIN.findall(item.encode().translate(LOW))
    wins = {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    out = []
    for r in rows:
        w = PLAIN.findall((r["text"] or "").encode().translate(LOW))
        hit = {q for k in range(len(w) - 12) if tuple(w[k : k + 13]) in wins for q in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((r["doc_id"], r["text"], r["n_chars"]))
    return collections.Counter(out)


def _key(rows):
    return collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    item = _tables(str(tmp_path), spark, empty)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    machine = fm.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~cp._fold(0))
    scores = fm.score(docs, machine, carry=("text", "n_chars")).collect()
    wants = [lambda rows: _key([r for r in scores if r["score"] >= cp.GOOD]), _after_join, _after_substrings, lambda rows: _after_decontamination(rows, item)]
    for k, ((name, stage), want) in enumerate(zip(cp.STAGES, wants)):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        after = docs.collect()
        assert _key(after) == want(before), name
        assert all((r["rid"], r["score"], r["n_removed"], r["n_words"], r["kept_text"], r["_document"], r["shard"]) == (1, 2.0, "x", 4, "k", 5, 6) for r in after)
        if not empty:
            assert k == 0 or 0 < len(after) and (k == 2 or len(after) < len(before)), name
    packed = cp.run(spark, str(tmp_path)).toPandas()
    assert collections.Counter(packed[packed.piece == 0].doc_id.dropna()) == collections.Counter(float(r["doc_id"]) for r in docs.collect() if r["doc_id"] is not None)
    if not empty:
        assert packed.groupby("sequence_id").length.sum().max() <= 2048
        assert {r["doc_id"] for r in docs.collect()} >= {0, 1, 402, 403, 407}
        assert not {r["doc_id"] for r in docs.collect()} & {408}


def test_on_the_driver_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = cp.run(spark, sf).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and got.doc_id.nunique() > 50
