"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A ledger folder has two parts, each with one subfolder for each batch: ``changes``, one signed row for each
document that a batch inserts or takes back, and ``totals``, their sums by group.  An insert counts tokens; a
delete takes back what is recorded under a document's id, without its text; a revision is both.  So
totals are sums and never recounted.  A batch counts once its totals are complete.  One that was cut short
is overwritten when it comes again; one that is complete is not run again.

Defined results: a null or empty text has no tokens but counts as a document; a null source or language
is a group of its own; repeated rows count each, and a delete takes back all rows of its id; rows without an id
can be inserted alone; ids that nothing is recorded under are deleted without effect; groups of which nothing is
left vanish; an empty table gives an empty result; more columns are neither read nor in the way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import for_python, path_exists, read_spread, release, shared_dir, text_or_empty
from quadframe.llm.words import text_batches, tokenizer

GROUP = ("source", "lang", "tokenizer")
TOTALS = ("documents", "tokens", "chars")
SUMS = "source string, lang string, tokenizer string, documents long, tokens long, chars long"
CHANGES = f"doc_id string, {SUMS}"


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        for batch in batches:
            texts, n = batch.column(3).to_pylist(), []
            for part in text_batches(texts):
                n += encode(texts[part])[1].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "source", "lang", "tokens", "chars"])
        release()

    return run


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """A change for each inserted document."""
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", text_or_empty().alias("text"))
    each = for_python(source).mapInArrow(_count(path), "doc_id string, source string, lang string, tokens long, chars long")
    return each.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("documents"), "tokens", "chars")


def taken_back(recorded: DataFrame, ids: DataFrame) -> DataFrame:
    """Changes that take back what is recorded under some ids, by id and group."""
    own = recorded.join(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sums = own.groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS)).where("documents <> 0")
    return sums.select("doc_id", *GROUP, *((-F.col(c)).alias(c) for c in TOTALS))


def combine(rows: DataFrame) -> DataFrame:
    """Totals of additive rows; groups of which nothing is left vanish."""
    return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS)).where(" or ".join(f"{c} <> 0" for c in TOTALS))


class TokenLedger:
    """Changes and totals in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, batch string")
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")

    def changes(self) -> DataFrame:
        """Changes of complete batches."""
        complete = self._read("totals", SUMS).select("batch").distinct()
        return self._read("changes", CHANGES).join(F.broadcast(complete), "batch", "left_semi").drop("batch")

    def commit(self, batch: str, path: str, version: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Adds a batch; False if it was complete already.

        ``inserted`` and ``revised`` are documents ``(doc_id, text, source, lang)``; of ``deleted`` only the ids are read.
        """
        if path_exists(self.spark, f"{self.path}/totals/batch={batch}/_SUCCESS"):
            return False
        recorded = self.changes().where(F.col("tokenizer") == version)
        parts = [counted(docs, path, version) for docs in (inserted, revised) if docs is not None]
        parts += [taken_back(recorded, docs) for docs in (deleted, revised) if docs is not None]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        sums = self.spark.read.schema(CHANGES).parquet(f"{self.path}/changes/batch={batch}").groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS))
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        return combine(self._read("totals", SUMS))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, by a fresh ledger: a first batch inserts them all; a second one brings those over the
    median id again, as a later crawl does, and revises them; it is delivered twice and counts once."""
    import public_tokenizers

    ledger = TokenLedger(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    docs, path = read_spread(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    ledger.commit("first crawl", path, "byte_bpe_50k", inserted=docs)
    for _ in range(2):
        ledger.commit("second crawl", path, "byte_bpe_50k", revised=docs.where(F.col("doc_id") > F.lit(middle)))
    return ledger.totals()
