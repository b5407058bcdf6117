"""Benchmark decontamination with a stored positional index, in built-in functions only.

`build_index` stores postings (term, document, position) of all terms that occur
in test items, as a Parquet table in the shared folder; it can be kept and used
again. Of every test window (`size` words of an item) the `LISTS` terms with the
fewest postings are its anchors. Their posting lists, each position less the
term's offset in the window, are intersected: where all lists name one document
and start, the window may begin. Frequent terms' lists are intersected only where a window has no rarer ones. An
exact check of the whole window against the document's words follows, for
candidates only. For proximity, the two rarest terms' lists are intersected
within the window's length and the slop, and the check asks for all words there.

Windows are told apart by a 64-bit hash; their item ids are joined to matches last. Test terms are broadcast in parts of `TERM_BYTES`, windows' anchors in blocks of
`BLOCK` windows; both are measured, and one large item is split like many small
ones. Postings are written where the text is read, without a shuffle.

Edge cases: a null or empty text has no words; an item without words has no
window; equal rows give equal results; null ids are kept; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._graph import checkpoint, checkpoint_dir

#: All ASCII but digits and lower-case letters parts words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest terms of a window whose lists are intersected.
LISTS = 3
#: Windows whose anchors and terms' counts are broadcast at a time: some 60 bytes for each of LISTS, at most 13 terms of some 40.
BLOCK = 50_000
#: Bytes of test terms broadcast at a time.
TERM_BYTES = 16 << 20
#: Hashes of candidate documents that are broadcast to the texts (8 bytes each); more are joined.
FEW = 500_000


def words(text: Column) -> Column:
    """Words with A-Z lowered; lower() does just that to ASCII texts and is faster."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATOR), "")


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window: words, items: ids as strings) of all distinct windows; a shorter item is one window."""
    found = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return found.select("item", "w", at.alias("i")).groupBy(F.expr(f"slice(w, i, {size})").alias("window")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def build_index(documents: DataFrame, terms: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", term_bytes: int = TERM_BYTES) -> DataFrame:
    """The stored postings (term, rid, doc_id, pos) of the given distinct terms; the empty term stands once behind each row's words, so its position is their number.

    rid is a hash of id and text. doc_id is null but for the empty term. With too many terms to broadcast, a part of them
    is posted at a time, each reading the texts.
    """
    path = path or f"{checkpoint_dir(documents.sparkSession)}/postings-{uuid.uuid4()}"
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(size) // term_bytes))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), words(F.col(text_col)).alias("w"))
    posted = rows.select("doc_id", "rid", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
    for k in range(parts):
        wanted = terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else terms
        if k == 0:
            wanted = wanted.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
        found = posted.join(F.broadcast(wanted), "term").select("term", "rid", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"), "pos")
        found.write.mode("append").parquet(path)
    return documents.sparkSession.read.parquet(path)


def anchors(counts: DataFrame, wins: DataFrame, lists: int) -> DataFrame:
    """(wid, need, term, offset, length): the rarest terms of each window, all of whose terms have postings (`counts`: term, n); a term's first offset."""
    parts = wins.select("wid", F.size("window").alias("length"), F.posexplode("window").alias("offset", "term")).groupBy("wid", "length", "term").agg(F.min("offset").alias("offset"))
    mine = parts.select("term").distinct()  # at most the terms of a block of windows
    counts = counts.join(F.broadcast(mine), "term", "left_semi")
    by = W.partitionBy("wid")
    parts = parts.join(F.broadcast(counts), "term", "left").withColumn("_least", F.min(F.coalesce("n", F.lit(0))).over(by)).filter("_least > 0")
    parts = parts.withColumn("_k", F.row_number().over(by.orderBy("n", "offset"))).filter(F.col("_k") <= lists)
    return parts.withColumn("need", F.count("*").over(by)).select("wid", "need", "term", "offset", "length", F.col("_k").alias("k"))


def _candidates(index: DataFrame, chosen: DataFrame, slop: int | None) -> DataFrame:
    """(wid, rid, start) where the offset-adjusted lists of a window's anchors meet."""
    hits = index.filter("term <> ''").join(F.broadcast(chosen), "term").select("wid", "need", "rid", "k", "length", (F.col("pos") - F.col("offset")).alias("start"), "pos")
    if slop is None:
        return hits.filter("start >= 0").groupBy("wid", "rid", "start").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need").select("wid", "rid", "start")
    second = hits.filter("k = 2").select("wid", "rid", F.col("pos").alias("_pos"))
    near = hits.filter("k = 1 and need > 1").join(second, ["wid", "rid"]).filter(F.abs(F.col("pos") - F.col("_pos")) < F.col("length") + 2 * slop)
    return hits.filter("k = 1 and need = 1").select("wid", "rid", "start").unionByName(near.select("wid", "rid", "start").distinct())


def matches(documents: DataFrame, items: DataFrame, size: int = 13, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None, block: int = BLOCK, few: int = FEW, **building) -> DataFrame:
    """(doc_id, rid, n_words, start, length, items): one row for each match, and one without start for each document row.

    Without slop, matches are exact phrases. With it, all the window's words
    stand, in any order, within its length plus slop around its anchor's place.
    `index` is one built before over the same documents, for all terms of the items.
    """
    rows, hits, wins = _located(documents, items, size, slop, id_col, text_col, item_id, item_text, index, block, few, **building)
    none = [F.lit(None).cast("int").alias(c) for c in ("start", "length")]
    hits = hits.join(wins.select("wid", "items"), "wid").select(F.lit(None).cast("long").alias("doc_id"), "rid", F.lit(None).cast("int").alias("n_words"), "start", "length", "items")
    return rows.select("doc_id", "rid", "n_words", *none, F.array().cast("array<string>").alias("items")).unionByName(hits)


def _located(documents: DataFrame, items: DataFrame, size: int, slop: int | None, id_col: str, text_col: str, item_id: str, item_text: str, index: DataFrame | None, block: int, few: int, **building) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The document rows (doc_id, rid, n_words), the matches (rid, wid, start, length), and the windows (wid, window, items)."""
    wins = checkpoint(windows(items, size, item_id, item_text).withColumn("wid", F.xxhash64("window")))
    if index is None:
        index = build_index(documents, wins.select(F.explode("window").alias("term")).distinct(), None, id_col, text_col, **building)
    blocks = max(1, -(-wins.count() // block))
    lists = LISTS if slop is None else 2
    parts = [wins.filter(F.pmod("wid", F.lit(blocks)) == k) if blocks > 1 else wins for k in range(blocks)]
    counts = checkpoint(index.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n")))
    found = checkpoint(reduce(DataFrame.unionByName, [_candidates(index, anchors(counts, part, lists), slop) for part in parts]))
    # the exact check: a document's candidates with their windows, beside its words
    asked = found.join(wins.select("wid", "window"), "wid").groupBy("rid").agg(F.collect_list(F.struct("start", "window", "wid")).alias("c"))
    texts = documents.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    rids = found.select("rid").distinct()
    texts = texts.join(F.broadcast(rids) if rids.count() <= few else rids, "rid", "left_semi")
    beside = texts.join(asked, "rid").select("rid", words(F.col("text")).alias("w"), "c").select("rid", "w", F.explode("c").alias("c"))
    start, window = F.col("c.start"), F.col("c.window")
    if slop is None:
        here = F.slice("w", start + 1, F.size(window)) == window
    else:
        near = F.slice("w", F.greatest(start - slop, F.lit(0)) + 1, F.size(window) + 2 * slop)
        here = F.forall(window, lambda x: F.array_contains(near, x))
    hits = beside.filter(here).select("rid", F.col("c.wid").alias("wid"), start.alias("start"), F.size(window).alias("length"))
    return index.filter("term = ''").select("doc_id", "rid", F.col("pos").alias("n_words")), hits, wins


def contamination(documents: DataFrame, items: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None, block: int = BLOCK, few: int = FEW, **building) -> DataFrame:
    """doc_id, rid, n_words, n_hit (words inside matches), items (ids as strings, sorted), contaminated (a twentieth of the words are hit).

    Matches carry their window's hash; the windows' items are joined last, once for each document and window.
    """
    rows, hits, wins = _located(documents, items, size, None, id_col, text_col, item_id, item_text, index, block, few, **building)
    per = rows.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.count("*").alias("_rows"))
    at = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_at"), F.collect_set("wid").alias("_wids"))
    at = checkpoint(at)
    held = at.select("rid", F.explode("_wids").alias("wid")).join(wins.select("wid", "items"), "wid").groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per = per.join(at.drop("_wids").join(held, "rid"), "rid", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    per = per.select("rid", "doc_id", "n_words", "_rows", none("_at", "array<struct<start:int,length:int>>"), none("items", "array<string>"))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
            (acc["n"] + F.greatest(x["start"] + x["length"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    per = per.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return per.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).select("doc_id", "rid", "n_words", "n_hit", "items", "contaminated")
