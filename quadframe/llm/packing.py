"""Packing tokenized documents into sequences of a fixed length: shortest pack first over the histogram.

A document's ids are cut at multiples of the sequence length, so each leaves full pieces and one rest.
Only the histogram of piece lengths goes to the driver, one number for each length up to the sequence
length.  There, lengths are placed longest first; a pattern of lengths stands for many equal packs, and
the shortest packs with room take the next length.  Patterns return to the pieces by their rank among
pieces of equal length.

Defined results: a null or empty text has the end id alone; repeated rows are packed once for each row;
an empty table gives an empty result; more columns are neither read nor in the way.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import cut, for_python, read_spread, release
from quadframe.llm.ranks import number_within
from quadframe.llm.words import text_batches, tokenizer

SEQUENCE = 2048
END_ID = 1


class Pattern(NamedTuple):
    """Equal packs: their number, and runs of (length, pieces of it) in the order of placing."""

    packs: int
    runs: tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place each piece of the histogram once.

    The open packs of one fill are kept together.  For each length, longest first, the shortest packs
    take as many pieces as fit; if there are fewer pieces than room, the group of packs is split.  At most
    two groups are added for a length, so there are at most about two patterns for each.
    """
    open_packs: list[tuple[int, int, int, tuple]] = []  # fill, tie, packs, runs
    closed: list[Pattern] = []
    ties = 0

    def put(fill: int, packs: int, runs: tuple) -> None:
        nonlocal ties
        if not packs:
            return
        if fill == capacity:
            closed.append(Pattern(packs, runs))
        else:
            heapq.heappush(open_packs, (fill, ties, packs, runs))
            ties += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and open_packs[0][0] + length <= capacity:
            fill, _, packs, runs = heapq.heappop(open_packs)
            # spread one by one over the packs of this fill, as shortest first does, while enough are left
            if left >= packs:
                room = (capacity - fill) // length
                most = open_packs[0][0] - fill if open_packs else capacity
                each = max(1, min(room, left // packs, most // length))
                put(fill + each * length, packs, (*runs, (length, each)))
                left -= each * packs
            else:
                put(fill + length, left, (*runs, (length, 1)))
                put(fill, packs - left, runs)
                left = 0
        if left:
            each = capacity // length
            put(each * length, left // each, ((length, each),))
            if left % each:
                put(left % each * length, 1, ((length, left % each),))
    return closed + [Pattern(packs, runs) for _, _, packs, runs in open_packs]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end of ranks, pieces in a pack, first sequence, offset of the first)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for packs, runs in patterns:
        offset = 0
        for length, each in runs:
            begin = used.get(length, 0)
            used[length] = begin + packs * each
            rows.append((length, begin, used[length], each, sequence, offset))
            offset += length * each
        sequence += packs
    return rows


def _pieces(path: str, end_id: int, sequence: int, key_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", key_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for part in text_batches(texts):
                flat, counts = encode(texts[part])
                ends = np.cumsum(counts)
                rows: list[list] = [[], [], [], [], []]
                for i, (begin, end) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                    ids = np.append(flat[begin:end], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), sequence):
                        piece = ids[start : start + sequence]
                        for column, value in zip(rows, (i + part.start, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0], pa.int64())), *(pa.array(r, pa.int64()) for r in rows[1:])], schema=schema)
        release()

    return run


def tokenize_and_cut(docs: DataFrame, path: str, end_id: int = END_ID, sequence: int = SEQUENCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: full pieces and one rest for each document."""
    import pyspark.sql.pandas.types as types

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType
    return for_python(source).mapInArrow(_pieces(path, end_id, sequence, types.to_arrow_type(kind)), f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    The histogram has at most ``sequence`` rows.  A pattern's lengths sum to at most ``sequence``, so it
    has at most about sqrt(2 * sequence) distinct ones; with about two patterns for each length that
    bounds the table of slots, whatever the number of documents, and it can be broadcast.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, sequence))
    assert len(table) <= 4 * sequence * int((2 * sequence) ** 0.5 + 2)
    ranges = spark.createDataFrame(table, "length long, first long, last long, each long, first_sequence long, first_offset long")
    ranked = number_within(pieces, ["length"], ["doc_id", "start"], ["doc_id", "start", "ids_crc32"], "rank")
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    at = F.col("rank") - F.col("first")
    return (
        ranked.alias("p")
        .join(F.broadcast(ranges).alias("r"), inside)
        .select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("first_offset") + at % F.col("each") * F.col("p.length")).alias("offset"))
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers

    docs = read_spread(spark, sf_dir, "documents")
    return pack(tokenize_and_cut(docs, public_tokenizers.path("word_bpe_49k.json")))
