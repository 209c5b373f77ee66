"""Token ids in files, coded by Simple-8b.

A word of 64 bits starts with a selector of 4 bits that says how many ids of how many bits it packs.
Selector 0 is an escape: one id of up to 64 bits stands in the next word.  Ids are coded in blocks of a
fixed number, and a block's offset says at which word it begins, so blocks are coded and decoded side by
side with array operations and can be read alone.

A row of the Parquet files is a segment of whole documents: their ids (keys), numbers of ids, the blocks'
offsets and the words.  Spark's writer commits files, so a lost executor's or repeated task's files
never count.

Defined results: a null or empty text has the end id alone; rows with equal keys stand next to each other
in order of their texts; null keys come first; an empty table gives an empty result; more columns are
neither read nor in the way.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadframe.llm.common import for_python, partitions, read_table, shared_dir
from quadframe.llm.words import text_batches, tokenizer

END_ID = 0
BLOCK = 1024

# How many values of how many bits selectors 2 to 15 pack into 60 bits.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
#: The selector that is just wide enough for each value up to 17 bits, which ids of most vocabularies have.
NARROWEST = np.searchsorted(1 << BITS[2:], np.arange(1 << 17), side="right").astype(np.int8) + np.int8(2)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block of ``BLOCK`` ids begins."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    # the selector of each value that is just wide enough; 16 if none is
    if padded.max() < len(NARROWEST):
        narrowest = NARROWEST[grid.astype(np.int64)]
    else:
        narrowest = np.full(grid.shape, 2, np.int8)
        for s in range(2, len(COUNTS)):
            wide = grid >= np.uint64(1 << int(BITS[s]))
            if not wide.any():
                break
            narrowest += wide
    # a selector that fits the values from a place on lets all with fewer values fit too: count those that don't
    best = np.full((blocks, BLOCK), 2, np.int8)
    widest, reach = narrowest, 1  # of the next ``reach`` values
    for s in range(len(COUNTS) - 1, 1, -1):
        while reach < COUNTS[s]:
            more = min(reach, int(COUNTS[s]) - reach)
            widest = np.maximum(widest[:, : widest.shape[1] - more], widest[:, more:])
            reach += more
        best += widest[:, :BLOCK] > s
    best[best == len(COUNTS)] = ESCAPE
    best = best.ravel()
    steps = COUNTS[best]
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    at = np.arange(blocks) * BLOCK
    begun = np.zeros(blocks * BLOCK, bool)
    while len(at):
        begun[at] = True
        at = at + steps[at]
        live = at < ends
        at, ends = at[live], ends[live]
    place = np.flatnonzero(begun)
    row, col = np.divmod(place, BLOCK)
    chosen = best[place]
    size = np.where(chosen == ESCAPE, 2, 1)
    end = np.cumsum(size)
    begin = end - size
    words = np.zeros(int(end[-1]), np.uint64)
    for s in range(2, len(COUNTS)):
        k = np.flatnonzero(chosen == s)
        if len(k):
            lanes = np.arange(COUNTS[s])
            packed = grid[row[k][:, None], col[k][:, None] + lanes] << (lanes * int(BITS[s])).astype(np.uint64)
            words[begin[k]] = np.bitwise_or.reduce(packed, axis=1) | np.uint64(s << 60)
    k = np.flatnonzero(chosen == ESCAPE)
    words[begin[k] + 1] = grid[row[k], col[k]]
    return words, begin[np.searchsorted(row, np.arange(blocks))].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids again; blocks are decoded side by side."""
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    if (selectors == ESCAPE).any():
        # a raw word may look like an escape itself: follow the words in runs of escapes
        k = 0
        for k in np.flatnonzero(selectors == ESCAPE).tolist():
            if not raw[k]:
                raw[k + 1] = True
    real = np.flatnonzero(~raw)
    counts = COUNTS[selectors[real]]
    block = np.searchsorted(offsets, real, side="right") - 1
    ends = np.cumsum(counts)
    first = (ends - counts)[np.searchsorted(real, offsets)]
    place = ends - counts - first[block] + block * BLOCK
    out = np.zeros(len(offsets) * BLOCK + 60, np.uint64)
    for s in np.unique(selectors[real]).tolist():
        k = np.flatnonzero(selectors[real] == s)
        if s == ESCAPE:
            out[place[k]] = words[real[k] + 1]
            continue
        lanes = np.arange(COUNTS[s])
        got = (words[real[k]][:, None] >> (lanes * int(BITS[s])).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        # values behind a block's end are zeros that fill its last word
        to = place[k][:, None] + lanes
        inside = to < (block[k][:, None] + 1) * BLOCK
        out[to[inside]] = got[inside]
    return out[:n]


def _segments(path: str, end_id: int, keys: pa.DataType, segment_chars: int) -> Callable:
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("doc_ids", pa.list_(keys)), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("offsets", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        encode_texts = tokenizer(path).encode_batch
        for batch in batches:
            key, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for some in text_batches(texts, segment_chars):
                flat, counts = encode_texts(texts[some])
                counts = counts + 1
                ends = np.cumsum(counts)
                ids = np.full(int(ends[-1]), end_id, np.uint64)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = flat
                words, offsets = encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([segment], pa.int64()), pa.array([key[some].to_pylist()], pa.list_(keys)), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([offsets.astype("<u4").tobytes()], pa.binary()), pa.array([words.astype("<u8").tobytes()], pa.binary())],
                    schema=schema,
                )
                segment += 1

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id", segment_chars: int = 4_000_000) -> None:
    """Writes the ids of all documents in ascending order of ``key`` to the folder ``out``."""
    import pyspark.sql.pandas.types as types

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType
    ranged = source.repartitionByRange(2 * partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    segments = for_python(ranged).mapInArrow(_segments(tokenizer_path, end_id, types.to_arrow_type(kind), segment_chars), f"part int, segment long, doc_ids array<{kind.simpleString()}>, counts array<long>, n_ids long, offsets binary, words binary")
    segments.write.mode("overwrite").option("compression", "zstd").parquet(out)


def _documents(keys: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", keys), ("part", pa.int32()), ("segment", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, doc_ids, counts, n, offsets, words in zip(*(batch.column(i) for i in range(7)), strict=True):
                ids = decode(np.frombuffer(words.as_py(), "<u8"), np.frombuffer(offsets.as_py(), "<u4"), n.as_py()).astype("<u4")
                sizes = counts.values.to_numpy()
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                same = np.full(len(sizes), 1)
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(same * part.as_py(), pa.int32()), pa.array(same * segment.as_py(), pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return run


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: ``(doc_id, start, n_tokens, ids_crc32)``."""
    import pyspark.sql.pandas.types as types

    files = spark.read.parquet(out)
    kind = files.schema["doc_ids"].dataType.elementType
    sums = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each file
    begins = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_begin"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    segments = sums.select("part", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("segment_begin")).join(begins, "part")
    docs = files.select("part", "segment", "doc_ids", "counts", "n_ids", "offsets", "words").mapInArrow(_documents(types.to_arrow_type(kind)), f"doc_id {kind.simpleString()}, part int, segment long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(segments, ["part", "segment"]).select("doc_id", (F.col("part_begin") + F.col("segment_begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to files and reads them back."""
    import public_tokenizers

    out = f"{shared_dir(spark)}/simple8b-{uuid.uuid4().hex}"
    write_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_documents(spark, out)
