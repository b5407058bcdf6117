"""The queries opN_<name> and their SQL: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import best_fit_packing, chat_format, difference_cover, factorisation_machine, merkle_manifest, pitman_yor, positional_index, prefix_doubling, prefix_forest, redirect_rules, set_relations, source_divergence, stratified_shards

#: A document is predicted good from this score on.
GOOD = 0.3


def _fold(n: int) -> Column:
    """Whether crc32 of the id's text, modulo 5, is n; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == n, F.lit(False))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents")
    machine = factorisation_machine.train(documents, _read(spark, sf_dir, "labels"), ~_fold(0))
    scored = factorisation_machine.score(documents, machine)
    return scored.select("doc_id", _fold(0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def jaccard(spark, sf_dir):
    return set_relations.similar_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def neighbours(spark, sf_dir):
    return prefix_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def suffix_dedup(spark, sf_dir):
    found = prefix_doubling.remove_repeated_bytes(_read(spark, sf_dir, "documents"), 200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def lm_scores(spark, sf_dir):
    return pitman_yor.perplexity_scores(_read(spark, sf_dir, "documents"), _fold(1))


def decontamination(spark, sf_dir):
    found = positional_index.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 13)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def substring_dedup(spark, sf_dir):
    found = difference_cover.remove_repeated_windows(_read(spark, sf_dir, "documents"), 13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def url_filter(spark, sf_dir):
    return redirect_rules.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def shards(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = stratified_shards.interleave(rows, 24, "source", ("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def packing(spark, sf_dir):
    return best_fit_packing.pack(_read(spark, sf_dir, "documents"), 2048)


def divergence(spark, sf_dir):
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


#: Said by both turns of conversation -7: an escape, a header and a turn's end inside a text.
_ODD = r"\### Assistant: </turn> ok"


def chat(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ODD).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(more)))


def manifest(spark, sf_dir):
    fields = ("doc_id", "source", "lang", "n_chars")
    digest = merkle_manifest.leaf(*fields, "text")
    changed = merkle_manifest.leaf(*fields, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, changed)
    found = merkle_manifest.manifest(_read(spark, sf_dir, "documents"), digest, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "tampered": tampered})
    steps = F.concat_ws("", F.transform("proof", lambda s: F.concat(s["left"], s["right"])))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(steps, 256).alias("proof_sha256"), merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_factorisation_machine": quality,
    "op2_set_relation_jaccard": jaccard,
    "op3_prefix_forest": neighbours,
    "op4_prefix_doubling": suffix_dedup,
    "op5_pitman_yor": lm_scores,
    "op6_positional_index": decontamination,
    "op7_difference_cover": substring_dedup,
    "op8_redirect_rules": url_filter,
    "op9_stratified_shards": shards,
    "op10_best_fit_packing": packing,
    "op11_source_divergence": divergence,
    "op12_chat_rendering": chat,
    "op13_merkle_manifest": manifest,
    "pipeline": pipeline,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL = {
    "op2_set_relation_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)""",
    "op4_prefix_doubling": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 199)) AS p, h FROM d WHERE length(h) >= 400),
f AS (SELECT k, p, md5_number(substring(h, CAST(2 * p + 1 AS BIGINT), 400)) AS m FROM w),
s AS (SELECT k, p FROM f QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT *, max(p + 200) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
i AS (SELECT *, sum(CASE WHEN p <= e THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY p) AS i FROM g),
r AS (SELECT k, i, min(p) AS a, max(p + 200) AS b FROM i GROUP BY 1, 2),
b AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS c FROM r),
t AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM b GROUP BY 1),
x AS (SELECT k, string_agg(substring(d.h, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY a) AS kept FROM b JOIN d USING (k) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(CAST(n_removed AS BIGINT), 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substring(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN x USING (k)""",
    "op6_positional_index": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, w[k:k + 12] AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS k FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(s) AS z FROM q),
o AS (SELECT doc_id, z, w[k:k + z - 1] AS s, k FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d, z WHERE len(w) >= z)),
m AS (SELECT doc_id, z, k, item FROM o JOIN q USING (s)),
h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(k, k + z)) AS k FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_difference_cover": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
o AS (SELECT doc_id, w[k:k + 12] AS s, k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM o GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM o JOIN f USING (s) WHERE f.first < o.doc_id),
g AS (SELECT doc_id, list(k) AS k FROM c GROUP BY 1),
r AS (SELECT doc_id, w, coalesce(len(k), 0) AS gone, CASE WHEN k IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(k, i)) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w) AS n_words, gone AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM r""",
    "op8_redirect_rules": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(v, h, t) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, max_by(h || t, length(h || t)) AS rule, max_by(v, length(h || t)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY 1)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY 1) USING (lang)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (g.n + g.v)::HUGEINT AS BIGINT) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST(1000000000 * (t.n + 1)::HUGEINT // (a.n + a.v)::HUGEINT AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) t JOIN (SELECT lang, sum(n) AS n, max(v) AS v FROM g GROUP BY 1) a USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM o QUALIFY part = 'pair' OR rank <= 200""",
    "op12_chat_rendering": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(k)),
f AS (SELECT *, 14 + length(role) + length(text) + len(regexp_extract_all(role, '[\\:]')) + len(regexp_extract_all(text, '\\|</turn>')) + CASE WHEN contains(text, '###') THEN len(list_filter(range(1, length(text)), lambda i: substr(text, i, 3) = '###')) ELSE 0 END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, encode(role), encode(text))) AS turns_sha256, coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, encode(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM f GROUP BY 1""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE e AS (SELECT doc_id, source, list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(x) AS BIGINT)] || repeat([CAST(-1 AS BIGINT)], 8) for x in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc,
  CAST(octet_length(encode(CAST(doc_id AS VARCHAR))) AS VARCHAR) || ':' || doc_id || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS h,
  text, replace(text, chr(10), '') AS flat FROM documents),
l AS (SELECT *, sha256(h || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(h || coalesce(octet_length(encode(flat)) || ':' || flat, '-')) END AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM e),
t AS (SELECT source, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL SELECT source, level + 1, i, h, count(*) OVER (PARTITION BY source) FROM (SELECT source, level, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM t WHERE n > 1 GROUP BY source, level, i // 3)),
r AS (SELECT source, h AS subroot, level AS top, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM r UNION ALL SELECT level + 1, i, h, count(*) OVER () FROM (SELECT level, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM u WHERE n > 1 GROUP BY level, i // 3)),
s AS (SELECT a.source, level, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i) AS lo, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS hi FROM t a JOIN t b USING (level) WHERE a.source IS NOT DISTINCT FROM b.source AND a.i // 3 = b.i // 3 AND a.n > 1 GROUP BY 1, 2, 3),
w AS (SELECT level, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i) AS lo, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS hi FROM u a JOIN u b USING (level) WHERE a.i // 3 = b.i // 3 AND a.n > 1 GROUP BY 1, 2),
f AS (SELECT doc_id, leaf, subroot, 0 AS level, top, l.i, r.i AS j, l.source, coalesce(other, leaf) AS h, '' AS proof FROM l JOIN r ON l.source IS NOT DISTINCT FROM r.source
  UNION ALL SELECT doc_id, leaf, subroot, f.level + 1, top, CASE WHEN f.level < top THEN f.i // 3 ELSE 0 END, CASE WHEN f.level < top THEN j ELSE j // 3 END, f.source, sha256(coalesce(s.lo, w.lo, '') || f.h || coalesce(s.hi, w.hi, '')), proof || coalesce(s.lo, w.lo, '') || coalesce(s.hi, w.hi, '')
  FROM f LEFT JOIN s ON f.level < top AND s.source IS NOT DISTINCT FROM f.source AND s.level = f.level AND s.i = f.i LEFT JOIN w ON f.level >= top AND w.level = f.level - top AND w.i = f.j WHERE f.level < top + (SELECT max(level) FROM u)),
z AS (SELECT h AS root, level FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f, z WHERE f.level = top + z.level""",
}
