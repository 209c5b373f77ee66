"""A pipeline from raw documents to packed training sequences.  Each stage calls one operator.

Stages, in order: toxicity (documents scored 0.5 or more go), n-gram Jaccard join (one document of each
group of near duplicates stays), benchmark decontamination (documents that hold an item go), secret scans
(secrets are replaced by a mark; all documents stay), packing.

A row is a document: rows with equal ids are told apart by their texts where they differ, and equal rows
are near duplicates of each other.  Null texts count as empty and pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from quadframe.llm.common import cut, read_table, shared_dir
from quadframe.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _mark() -> Column:
    """128 bits that tell rows of different ids or texts apart, null ones too."""
    each = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("null")) for c in (F.col("doc_id").cast("string"), F.col("text"))]
    return F.unhex(F.md5(F.concat_ws(",", *each).cast("binary")))


#: Marks of 16 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_MARKS = 500_000


def _listed(marks: DataFrame) -> tuple[DataFrame, int]:
    """Different marks, kept in the shared folder and counted, so that few of them spare a shuffle of texts."""
    kept = cut(marks.select("mark").distinct())
    n = kept.count()
    return (F.broadcast(kept) if n <= BROADCAST_MARKS else kept), n


def _without(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents whose mark isn't listed."""
    return docs.withColumn("mark", _mark()).join(_listed(marks)[0], "mark", "left_anti").select(*COLUMNS)


def _once(docs: DataFrame) -> DataFrame:
    """The documents, rows of one id and text once; only rows that repeat are shuffled."""
    marked = docs.withColumn("mark", _mark())
    repeated, n = _listed(marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if not n:
        return marked
    return marked.join(repeated, "mark", "left_anti").unionByName(marked.join(repeated, "mark", "left_semi").dropDuplicates(["mark"]))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id, null being the largest, of each group linked by 80 % of their
    five-word shingles."""
    once = _once(docs)
    keyed = once.select(F.struct(F.when(F.col("doc_id").isNull(), F.lit(1)).alias("unknown"), "doc_id", "mark").alias("row"), "text")
    groups = jaccard_join.link_components(keyed, jaccard_join.Similarity(words=5, percent=80), key="row")
    return _without(once, groups.where("doc_id.mark <> component_id.mark").select("doc_id.mark"))


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    marked = docs.select(_mark().alias("doc_id"), "text")
    return _without(docs, decontaminate.contaminated(marked, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("mark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secret part of each finding; every document stays."""
    findings, _ = secret_scan.scan_unseen(docs)
    marked = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(findings.select("blob", F.lit(True).alias("found")).distinct(), "blob", "left")
    text = F.when(F.col("found"), secret_scan.redact(F.col("text"))).otherwise(F.col("text"))
    changed = marked.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers

    return packing.pack(packing.tokenize_and_cut(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", leaked), ("secret scans", secrets), ("packing", packed)]

#: The classifier of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents, each stage's result written and read again."""
    ship(spark)
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
