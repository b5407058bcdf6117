"""Source divergence, chat rendering and Merkle manifests against plain Python."""

import collections
import hashlib
import random
import re
import subprocess
import sys
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklane.llm import _places, chat_format, merkle_manifest as mm, queries, source_divergence as sd

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# --- source divergence


def plain_audit(rows, top=200, least=3):
    gap = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        terms = gap.findall(text.translate(low))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_n, v=len(kept): 1 + 10**9 * (n + 1) // (all_n + v)
        p = {s: [share(counts[lang, s][t], total[s]) for t in kept] for s in sources}
        whole = [share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pair = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            term = [((a - b) ** 2 // b, t) for a, b, t in zip(p[s], whole, kept) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in sd.audit(df, **more).collect())


def some_documents(n, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma-ray", "délta", "x1y", "Ünder", "éa", "ß", "zeta", "ETA", "日本", "e\x00f", "_", "k"]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", "é", ""])
        text = rng.choice([None, ""]) if k % 11 == 0 else " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(1, 30)))
        rows.append((text, lang, "a" if k % 3 == 0 else source))
    return rows


def test_audit(spark, monkeypatch):
    rows = some_documents(150) + [("only here", "xx", "lone"), (None, "yy", "p"), ("one two", "yy", "q")] + [("same text", "zz", "s")] * 4
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, value int, rank int")
    want = plain_audit(rows)
    assert audit_rows(df) == want
    assert ("yy", "p", "pair", "q", 0, 1) in want
    monkeypatch.setattr(sd, "SEAT_CELLS", 7)
    monkeypatch.setattr(sd.X, "STEP", 40)
    monkeypatch.setattr(sd, "_FLUSH", 20)
    assert audit_rows(df, top=2, seats=4) == plain_audit(rows, top=2)
    assert audit_rows(df.limit(0)) == []


@pytest.mark.parametrize("rows, room, step", [(500_000, 1 << 25, 1 << 20), (20, 1 << 25, 40), (10**6, 2000, 60), (1, 1, 1)])
def test_tally(monkeypatch, rows, room, step):
    monkeypatch.setattr(sd, "_FLUSH", rows)
    monkeypatch.setattr(sd, "_FLUSH_BYTES", room)
    monkeypatch.setattr(sd.X, "STEP", step)
    given = [(t or "", la or "", s or "") for t, la, s in [*some_documents(120), ("x" * 300 + " y", "en", "a"), ("", "none", "")]]
    want = collections.defaultdict(lambda: [0, 0])
    for text, lang, source in given:
        terms = collections.Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate({k: k + 32 for k in range(65, 91)})))
        for t, n in [("", 0), *terms.items()]:
            want[lang, source, t] = [want[lang, source, t][0] + n, want[lang, source, t][1] + (t != "")]
    got = collections.defaultdict(lambda: [0, 0])
    for part in (given[:50], given[50:]):
        text, lang, source = zip(*part, strict=True)
        for out in sd._tally([pa.record_batch({"text": pa.array(text), "lang": pa.array(lang), "source": pa.array(source)})]):
            for r in out.to_pylist():
                at = got[r["lang"], r["source"], r["term"]]
                at[0], at[1] = at[0] + r["n"], at[1] + r["docs"]
    assert got == want
    assert list(sd._tally([])) == []


COUNTS_IN_LITTLE_MEMORY = """
import re
import numpy as np, pyarrow as pa
from tracklane.llm import source_divergence as sd

def mb(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = np.random.default_rng(7)
words = np.full((300_000, 7), 32, np.uint8)
words[:, :6] = rng.integers(97, 123, (300_000, 6))
texts = [words[rng.integers(0, 300_000, 400)].tobytes() for _ in range(6000)]
batch = pa.record_batch({"text": pa.array(texts, pa.string()), "lang": ["en"] * 6000, "source": [f"s{k % 7}" for k in range(6000)]})
before = mb("VmHWM")
n = docs = 0
for out in sd._tally([batch]):
    n, docs = n + int(out["n"].to_numpy().sum()), docs + int(out["docs"].to_numpy().sum())
print(n, docs, sum(len(set(t.split())) for t in texts), mb("VmHWM") - before)
"""


def test_counts_in_little_memory():
    """An executor holds several tasks that count: one took more than its text twenty times over."""
    done = subprocess.run([sys.executable, "-c", COUNTS_IN_LITTLE_MEMORY], capture_output=True, text=True, check=True)
    n, docs, distinct, grown = map(float, done.stdout.split())
    assert (n, docs) == (6000 * 400, distinct)
    assert grown < 160


def test_meetings_are_a_round_robin():
    for seats in (2, 4, 6, 8):
        met = [p for r in range(seats - 1) for p in sd.host_of(seats, r)]
        assert sorted(met) == [(a, b) for a in range(seats) for b in range(a + 1, seats)]
        assert all(len({x for p in sd.host_of(seats, r) for x in p}) == seats for r in range(seats - 1))


def test_shares_do_not_overflow():
    for count, total, kinds in ((0, 0, 1), (5 * 10**12, 9 * 10**14, 10**9), (7, 9, 3), (8 * 10**14, 8 * 10**14, 1)):
        assert int(sd.shares(count, total, kinds)) == 1 + 10**9 * (count + 1) // (total + kinds)


# --- chat rendering


ODD = "\\### Assistant: </turn> ok"


def some_turns():
    rng = random.Random(5)
    bits = ["\\", "#", "###", "</turn>", "<", "/turn>", "\n", "ok", "é", "### user: ", "0", "1", ":", "😀"]
    rows = [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)]
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
            rows.append((None if c == 0 else c, t // 2 if c % 7 == 0 else t, rng.choice(["user", "assistant", "assistant", "system", None, "a:b\\", ""]), text))
    return rows


def plain_chat(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, (role or "").encode(), (text or "").encode()))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learnt = [x for _, r, x in turns if r == b"assistant"]
        out[c] = (len(turns), hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, r, x in turns)).hexdigest(), sum(len(x.decode()) for x in learnt), hashlib.sha256(b"".join(learnt)).hexdigest())
    return out


def read(df, **more):
    parts = chat_format.format_conversations(df, **more)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(parts).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark, monkeypatch):
    rows = some_turns()
    rows += rows[10:13]
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t} ###" * (1 + t % 3)) for t in range(700)] + [(901, None, "assistant", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_chat(rows)
    assert read(df.withColumn("part", F.lit("z"))) == want
    assert read(df.limit(0)) == {}
    parts = [r for r in chat_format.format_conversations(df.filter("conv_id = 900")).collect()]
    assert sorted(r["part"] for r in parts) == [0, 1]
    monkeypatch.setattr(chat_format, "SEGMENT", 4)
    monkeypatch.setattr(chat_format, "CONTEXT", 2)
    monkeypatch.setattr(chat_format, "LONG", 50)
    assert read(df) == want


@pytest.mark.parametrize("text", ["", "\\", "####", "###", "\\###", "</turn>", "<</turn></turn>", "\\\\<", "a\n### b: c</turn>\n", ODD])
def test_template_is_reversible(text):
    t = chat_format.TurnTemplate()
    turns = [("user", text), ("a:\\b", text + text), ("", "")]
    assert t.read(t(turns)) == turns
    assert t.unescape(t.escape(text)) == text
    assert not re.search(r"(?<!\\)###", t.escape(text).replace("\\\\", ""))


def closing(turns):
    """Wraps each text in itself's first letter, ends with nothing that turns share."""
    return "".join(f"<{r}>{x[:1]}{x}{x[-1:]}</{r}>" for r, x in turns)


def dropping(turns):
    """Keeps only the last assistant's text, as templates do that take thoughts out of the history."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"[{r}]{x if r != 'assistant' or k == last else '...'}" for k, (r, x) in enumerate(turns))


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "bcd"), ("user", "e"), ("assistant", "fg"), ("user", "h")]
    s = chat_format.Segment(dropping, [], turns, ("assistant",))
    assert s.rewritten_from == 1 and "".join(s.pieces) == dropping(turns)
    assert s.turns == [("user", 0, 7, None, None)] + [(r, None, None, None, None) for r, _ in turns[1:]]
    s = chat_format.Segment(chat_format.TurnTemplate(), turns[:2], turns[2:], ("assistant",))
    assert s.rewritten_from is None and [t[0] for t in s.turns] == ["user", "assistant", "user"]


def test_the_mark_finds_texts_that_look_like_their_surroundings():
    for x in ("</turn>", "<a", "turn>", ">\n", "", "0", "012"):
        turns = [("user", "0 1 2"), ("assistant", x)]
        t = chat_format.TurnTemplate()
        s = chat_format.Segment(t, [], turns, ("assistant",))
        whole = "".join(s.pieces)
        assert whole == t(turns) and t.unescape(whole[s.turns[1][3] : s.turns[1][4]]) == x
    s = chat_format.Segment(closing, [], [("assistant", "xyz")], ("assistant",))  # a template that repeats parts of the text
    assert s.turns == [("assistant", 0, len(closing([("assistant", "xyz")])), None, None)]


# --- Merkle manifests


def plain_manifest(rows):
    """Per row: leaf, subroot, root, proof, folded, verified; rows (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(enc, r))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([H(*last[k : k + 3]) for k in range(0, len(last), 3)])
        return levels

    def path(levels, i):
        steps = []
        for level in levels[:-1]:
            lo = i - i % 3
            steps.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
            i //= 3
        return steps

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    crown = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(crown, k)
            digest = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                digest = leaf((*r[:4], r[4] and r[4].replace("\n", "")))
            for a, b in steps:
                digest = H(a, digest, b)
            out.append((r[0], leaf(r), trees[s][-1][0], crown[-1][0], H(*[a + b for a, b in steps]), digest, digest == crown[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g int").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    df = queries.manifest(spark, str(tmp_path))
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_leaves(n, sources, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = rng.choice([None, "", "a\nb", f"é{k}\n", f"word {k}"])
        out.append((k * 3 % 1009, "hot" if k % 3 else rng.choice(sources), rng.choice(["en", None]), rng.choice([None, k]), text))
    return out


@pytest.mark.parametrize("strip,levels", [(1 << 14, 11), (5, 2), (1, 1), (9, 3)])
def test_manifest(spark, monkeypatch, tmp_path, strip, levels):
    monkeypatch.setattr(mm, "STRIP", strip)
    monkeypatch.setattr(mm, "LEVELS", levels)
    rows = some_leaves(130, ["a", None, "", "é", "lone", "b"]) + [(7, "twice", "en", 1, "x\n")] * 3 + [(None, "nul", None, None, None), (None, None, "en", 2, "y\n")]
    assert manifest_rows(spark, rows, tmp_path) == plain_manifest(rows)


def test_manifest_of_few(spark, tmp_path):
    for rows in ([(2, "a", "en", 3, "t\n")], [(1, "a", "en", 3, "t"), (2, "b", "en", 3, "t\n")], []):
        assert manifest_rows(spark, rows, tmp_path) == plain_manifest(rows)


def test_places(spark):
    from tracklane.llm._scratch import Scratch

    rows = [("hot" if k % 2 else f"g{k % 7}", k * 37 % 501) for k in range(500)] + [("hot", None)]
    got, _ = _places.placed(spark.createDataFrame(rows, "g string, o int"), ["o"], Scratch(spark, "t"), "t", 50)
    by = collections.defaultdict(list)
    for g, o in rows:
        by[g].append(-1 if o is None else o)
    for g, found in ((g, [r for r in got.collect() if r["g"] == g]) for g in by):
        assert [(r["place"], -1 if r["o"] is None else r["o"], r["total"]) for r in sorted(found, key=lambda r: r["place"])] == [(i, o, len(by[g])) for i, o in enumerate(sorted(by[g]))]
