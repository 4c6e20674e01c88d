"""A corpus pipeline of the text operators: quality, near-duplicates, decontamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Null, empty and repeated rows
are as the operators have them: texts that are null stay null until personal data is redacted, which makes them empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, pii, quality, simhash
from tidemark.llm.common import among, cut, remove, shared_folder, table, without
from tidemark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the model learns from the labels of those at hand."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=("text", "lang", "source", "n_chars")).where(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def by_row(docs: DataFrame) -> DataFrame:
    """Adds row, a hash of doc_id and text: an id alone may be null, or that of several texts."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id (null last), and of its repeated rows one."""
    rows = by_row(docs.select(COLUMNS))
    found = cut(simhash.near_duplicates(rows, id_col="row").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("copies")))
    # Most components are one row, which stays without a join.
    several = cut(among(found, found.where("row != component").select("component"), "component"))
    ids = among(rows, several.select("row"), "row").select("row", "doc_id").distinct()
    members = cut(several.join(ids, "row"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    heads = cut(members.groupBy("component").agg(least).select("component", F.col("least.row").alias("head")))
    heads = heads.withColumn("h", F.xxhash64("component"))
    gone = members.withColumn("h", F.xxhash64("component")).join(heads, ["component", "h"]).where("row != head").select("row")
    kept = without(rows, gone, "row")
    again = cut(found.where("copies > 1").select("row"))
    if again.isEmpty():
        return kept.select(COLUMNS)
    one = among(kept, again, "row").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return without(kept, again, "row").select(COLUMNS).unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents none of whose words is in a benchmark window."""
    rows = by_row(docs.select(COLUMNS))
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return without(rows, found.where("n_hit > 0").select(F.col("doc_id").alias("row")), "row").select(COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows."""
    found = pii.find(docs, keep=("lang", "source"))
    return found.withColumn("text", pii.redacted()).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, packed as little-endian unsigned 32-bit integers, and the text decoded from them."""
    return bpe.encode(docs, vocabulary(), decoded=True).select("doc_id", "n_tokens", "ids", "text")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("pii", redacted),
    ("bpe", tokens),
]

#: Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again, in the cluster's shared folder.

    A stage's rows are deleted once the next one has written its own; the last one's stay, since the result reads them.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/stage-{k - 1}")
    return docs
