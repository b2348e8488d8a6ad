"""A training corpus from documents, in five stages; each stage's rows are stored before the next reads them.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents, further
ones and their values among them, whatever their names.

Defined cases: a null or empty text is rejected by the quality rules (no words);
a row with a null id is a document of its own; of repeated rows, and of near
duplicates, one row stays, chosen by id and text, so that ties are settled alike
in every run; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.llm.common import crc_bucket, documents, fresh_name, stored, table
from stormframe.llm.near_dedup import LINK_80, near_groups
from stormframe.llm.packing import pack_documents
from stormframe.llm.quality_model import THRESHOLD, fit_quality, score_quality
from stormframe.llm.quality_rules import keep_documents
from stormframe.llm.suffix_dedup import remove_repeats


def _beside(docs: DataFrame, results: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage keeps, with the columns of docs as they were: those named like its results stand aside meanwhile."""
    aside = {c: fresh_name(docs, f"own_{c}_") for c in docs.columns if c.lower() in results}
    names = [aside.get(c, c) for c in docs.columns]
    return stage(docs.withColumnsRenamed(aside)).select(names).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets pass."""
    return keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels of this stage's rows, does not reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 5) != 0)
    return _beside(docs, ("quality_score",), lambda d: score_quality(d, model).filter(F.col("quality_score") >= THRESHOLD))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from a similarity of 0.8 on."""
    return _beside(docs, ("n_shingles", "component_id", "kept"), lambda d: near_groups(d, by=LINK_80).filter("kept"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the stretches of 200 bytes or more that repeat."""
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each part of each document with its sequence and offset."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
