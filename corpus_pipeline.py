"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing and sharding, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared checkpoint folder and reads it again as the next one's documents. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from folioflow.session import reachable

    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the severity model does not call toxic; it is fitted on their labels."""
    from folioflow.llm import ordinal

    return ordinal.without_toxic(docs, ordinal.fit(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more, the least doc_id."""
    from folioflow.llm import lshforest

    return lshforest.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    from folioflow.llm import spacedseed

    return spacedseed.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    from folioflow.llm import cube

    return cube.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document taken."""
    from folioflow.llm import kdtree

    return kdtree.shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None  # model scores, links on estimates and chance are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, stored; the tables of the stages before are deleted."""
    from folioflow.llm._store import scratch, stored

    docs = _table(spark, sf_dir, "documents")
    with scratch(spark):
        for k, (name, stage) in enumerate(STAGES):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=k == len(STAGES) - 1)
    return docs
