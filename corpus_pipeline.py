"""A corpus pipeline of five stages, each one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
it is written as Parquet and read again. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracklane.llm import best_fit_packing, difference_cover, factorisation_machine, positional_index, set_relations
from tracklane.llm._graph import checkpoint
from tracklane.llm._scratch import Scratch
from tracklane.llm.queries import GOOD, _fold


def _free(name: str, docs: DataFrame) -> str:
    """`name`, or the first with further underscores that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _bundled(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with all their columns in one more, so that no name of an operator's result meets one of theirs."""
    name = _free("_document", docs)
    return docs.withColumn(name, F.struct(*_columns(docs))), name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts good stay."""
    machine = factorisation_machine.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_fold(0))
    rows, name = _bundled(docs)
    return factorisation_machine.score(rows, machine, carry=(name,)).filter(F.col("score") >= GOOD).select(f"{name}.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id stays; of rows alike in id and text one; documents without words stay."""
    staying = checkpoint(set_relations.similar_components(docs).filter("stays").groupBy("rid").agg(F.count("*").alias("n")))
    name = _free("_rid", docs)
    rows = docs.withColumn(name, F.xxhash64("doc_id", "text")).join(staying.select(F.col("rid").alias(name)), name, "left_semi")
    again = staying.filter("n > 1").select(F.col("rid").alias(name))
    if not again.isEmpty():
        rows = rows.join(again, name, "left_anti").unionByName(rows.join(again, name, "left_semi").dropDuplicates([name]))
    return rows.select(*_columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows that an earlier document has go; other texts stay as they are."""
    rows, name = _bundled(docs)
    kept = difference_cover.remove_repeated_windows(rows, carry=(name,))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    old = lambda c: F.col(f"{name}.`{c}`")
    return kept.select(*[F.when(F.col("n_removed") == 0, old(c)).otherwise(changed[c]).alias(c) if c in changed else old(c).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more stand in benchmark windows go."""
    name = _free("_rid", docs)
    hit = positional_index.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select(F.col("rid").alias(name)).distinct()
    return docs.withColumn(name, F.xxhash64("doc_id", "text")).join(hit, name, "left_anti").select(*_columns(docs))


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return best_fit_packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing_stage),
]

#: The classifier and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
