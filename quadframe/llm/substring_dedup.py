"""Removal of repeated passages: every word that a window of 20 words covers, if the window's words also
start earlier in the corpus.

Rows whose id others have too, null ones among them, are ranked by their texts in ranges; the rest have
rank 0.  Documents are dealt into batches by their id and rank, so no id lands in one task.  A batch
hashes every window (Rabin-Karp) and sends each distinct hash once, with the first document that has it,
packed by buckets of the hash space.  A bucket
counts which hashes several batches hold and tells each batch but the first owner's.  Batches then hash
their windows again, mark those that start earlier in the batch or in another, and merge them into
maximal intervals.  A passage that all documents share costs a bucket one entry for each batch.

Windows are compared by 64-bit hashes: two different windows among n meet with probability n * n / 2 ** 65.

Defined results: a null or empty text has no words; a null id counts as larger than all; rows with one id
are ordered by text (nulls first), so the later of two equal rows loses its windows; texts under 20 words
lose nothing; an empty table gives an empty result; more columns are neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import bucket_of, cut, partitions, read_table, text_or_empty
from quadframe.llm.hashing import bucket_by_hash, packed_runs, run_hashes, runs_of_documents, word_hashes

WINDOW = 20
#: Bytes of text in a batch, and hashes in a bucket, on average.
BATCH_BYTES = 6_000_000
BUCKET_HASHES = 2_000_000
NULL_ID = np.iinfo(np.int64).max
#: Parts into which rows of one id are dealt where repeated ids are told from others.
SALTS = 16


class _Batch:
    """The documents of a batch in their order, their words, and the hashes of their windows."""

    def __init__(self, table: pa.Table, window: int):
        known = (NULL_ID if i is None else i for i in table["doc_id"].to_pylist())
        rows = sorted(zip(known, table["rank"].to_pylist(), (t.encode() for t in table["text"].to_pylist()), strict=True))
        self.ids, self.ranks = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        cut = [t.split() for *_, t in rows]
        self.lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        self.words = [w for ws in cut for w in ws]
        self.at, self.document = runs_of_documents(self.lengths, window)
        self.hashes = run_hashes(word_hashes(self.words), window)[self.at]
        order = np.argsort(self.hashes, kind="stable")
        same = np.concatenate([[False], np.diff(self.hashes[order]) == 0]) if len(order) else np.zeros(0, bool)
        self.again = np.zeros(len(order), bool)  # starts earlier in the batch
        self.again[order[same]] = True


def _send(window: int, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        b = _Batch(table, window)
        first = ~b.again
        hashes, owner = b.hashes[first], b.document[first]
        bucket = bucket_by_hash(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        hashes, owner, bucket = hashes[order], owner[order], bucket[order]
        begins, run_bucket, run_owner = packed_runs(bucket, owner)
        counts = np.diff(np.append(begins, len(hashes))).astype("<u4")
        owners, ranks = b.ids[run_owner].astype("<i8"), b.ranks[run_owner].astype("<i8")
        found, run_at = np.unique(run_bucket, return_index=True)
        run_at = np.append(run_at, len(begins))
        hash_at = np.append(begins, len(hashes))[run_at]
        cut = lambda x, at: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        return pa.table({"bucket": pa.array(found, pa.int64()), "batch": pa.array(np.full(len(found), table["batch"][0].as_py()), pa.int32()), "hashes": cut(hashes.astype("<u8"), hash_at), "owners": cut(owners, run_at), "ranks": cut(ranks, run_at), "counts": cut(counts, run_at)})

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: for each batch, the hashes that a smaller document of another batch has."""
    raw = {n: [np.frombuffer(x.as_py(), kind) for x in table[n]] for n, kind in (("hashes", "<u8"), ("owners", "<i8"), ("ranks", "<i8"), ("counts", "<u4"))}
    sizes = np.fromiter(map(len, raw["hashes"]), np.int64, table.num_rows)
    hashes = np.concatenate(raw["hashes"])
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.concatenate([[True], np.diff(hashes) != 0])
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1)[group]
    order, hashes = order[shared], hashes[shared]
    if not len(order):
        return pa.table({"batch": pa.array([], pa.int32()), "again": pa.array([], pa.binary())})
    owners, ranks = (np.repeat(np.concatenate(raw[n]), np.concatenate(raw["counts"]))[order] for n in ("owners", "ranks"))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(hashes) != 0]))
    least = lambda x: np.repeat(np.minimum.reduceat(x, begins), np.diff(np.append(begins, len(hashes))))
    later = owners > least(owners)
    later |= ranks > least(np.where(later, np.iinfo(np.int64).max, ranks))
    row = np.repeat(np.arange(table.num_rows), sizes)[order][later]
    by_row = np.argsort(row, kind="stable")
    row, hashes = row[by_row], hashes[later][by_row]
    rows, at = np.unique(row, return_index=True)
    at = np.append(at, len(row))
    return pa.table({"batch": table["batch"].take(pa.array(rows)).combine_chunks(), "again": pa.array([hashes[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})


def _remove(window: int) -> Callable:
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "removed": pa.array([], _INTERVALS), "kept": pa.array([], pa.string())})
        b = _Batch(docs, window)
        again = b.again
        if replies.num_rows:
            told = np.sort(np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in replies["again"]]))
            place = np.minimum(np.searchsorted(told, b.hashes), len(told) - 1)
            again = again | (told[place] == b.hashes)
        total = len(b.words)
        edge = np.zeros(total + 1, np.int32)
        np.add.at(edge, b.at[again], 1)
        np.subtract.at(edge, b.at[again] + window, 1)
        covered = np.cumsum(edge[:total]) > 0
        ends = np.cumsum(b.lengths)
        begins = ends - b.lengths
        hit = np.add.reduceat(np.append(covered, False).astype(np.int64), begins) if total else np.zeros(len(ends), np.int64)
        hit[b.lengths == 0] = 0
        kept, removed = [], []
        for i, j, n in zip(begins.tolist(), ends.tolist(), hit.tolist(), strict=True):
            if not n:
                kept.append(b" ".join(b.words[i:j]).decode())
                removed.append([])
                continue
            step = np.flatnonzero(np.diff(np.concatenate([[False], covered[i:j], [False]]).astype(np.int8)))
            spans = step.reshape(-1, 2).tolist()
            removed.append([{"start": s, "end": e} for s, e in spans])
            left, at = [], i
            for s, e in spans:
                left += b.words[at : i + s]
                at = i + e
            kept.append(b" ".join(left + b.words[at:j]).decode())
        ids = pa.array(b.ids, pa.int64(), mask=b.ids == NULL_ID)
        return pa.table({"doc_id": ids, "n_words": pa.array(b.lengths, pa.int64()), "removed": pa.array(removed, _INTERVALS), "kept": pa.array(kept, pa.string())})

    return run


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text)`` with ``rank``, which orders those of one id by their texts; 0 if it has one row.

    A null id counts as the largest number.  Ranks are numbers of sorted ranges, kept in the shared folder
    so that they stay the same; where no id repeats, nothing is sorted or kept.
    """
    place = F.coalesce("doc_id", F.lit(int(NULL_ID)))
    repeated = cut(rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place"))
    if repeated.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("long"))
    keys = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("place", place).withColumn("salt", bucket_of(SALTS, "text"))
    parts = SALTS * partitions(rows.sparkSession)
    tied = salted.join(keys, ["place", "salt"], "left_semi").repartitionByRange(parts, "place", "text", F.rand(1)).sortWithinPartitions("place", "text")
    tied = cut(tied.select("doc_id", "text", F.monotonically_increasing_id().alias("rank")))
    return salted.join(keys, ["place", "salt"], "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("rank")).unionByName(tied)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", batch_bytes: int = BATCH_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """``(doc_id, n_words, removed, kept)``: maximal intervals of words removed (end exclusive), and the
    kept words joined by one space.  The numbers of batches and buckets follow the bytes of text."""
    n = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(2 * n, -(-size // batch_bytes))
    buckets = max(n, -(-size // (5 * bucket_hashes)))
    ranked = _ranked(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")))
    dealt = ranked.withColumn("batch", bucket_of(batches, "doc_id", "rank"))
    sent = dealt.groupBy("batch").applyInArrow(_send(window, buckets), "bucket long, batch int, hashes binary, owners binary, ranks binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(_meet, "batch int, again binary")
    return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_remove(window), "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, how many repeat an earlier window, and the SHA-256 of what is kept."""
    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20),
dup as (select doc_id, i from (select doc_id, i, row_number() over (partition by array_to_string(ws[i:i + 19], ' ') order by doc_id, i) as r from win) where r > 1),
cov as (select distinct doc_id, unnest(range(i, i + 20)) as p from dup),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join cov using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""
