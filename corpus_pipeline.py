"""The corpus pipeline: five stages over ``documents``, each one operator of ``gridload.llm``.

1. toxicity: documents that the Kneser-Ney models predict toxic go;
2. near_duplicates: one document of each near-duplicate group stays (five-word shingles, similarity 0.8);
3. decontamination: documents that hold a benchmark window go;
4. mixing: sources are cut or repeated to their targets (a repeated document is repeated rows, the document at a
   source's cut ends after its last taken word);
5. sharding: every remaining row gets a shard within the byte limit.

A stage's output is written as Parquet to the shared scratch folder and reread as the next one's input. Toxicity and
contamination are functions of the text, so their verdicts are joined back by text hash, which also covers
repeated rows and null ids. Null and empty texts pass the first three stages; the mix has no words to take from them. Columns ``shard`` and
``shard_bytes`` of the input give way to the last stage's. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm import decontaminate, minhash, mixing, sharding, toxicity
from gridload.llm.common import stage, table
from gridload.session import ship_package

#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` whose text hash isn't in ``rejected`` (column th)."""
    gone = stage(rejected.select("th").distinct(), "rejected")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th"))
    return rows.join(gone, "th", "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return _without(docs, toxicity.score(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = decontaminate.find_contamination(named, table(spark, sf_dir, "benchmark"), keep=("th",))
    return _without(docs, found.where(F.size("spans") > 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    dealt = sharding.shard(docs, max_bytes=SHARD_BYTES)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "shard_bytes")]
    return dealt.select(*own, "shard", "shard_bytes")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", deal_shards)]

#: SQL can't express the language models; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
