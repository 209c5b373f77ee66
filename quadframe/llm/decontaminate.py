"""Benchmark decontamination: document windows that nearly equal a benchmark item.

Texts are lower-cased, ASCII punctuation counts as space, and a window of as many words as the item is
compared with it by its shingles of five words, weighted by how often each occurs (sum of minima over sum
of maxima).  Windows and items get weighted SimHash fingerprints of 64 bits.  The index cuts fingerprints
into 8 blocks: of two within radius 23, one block differs in at most 2 bits, so looking up each block's
neighbours finds every item within the radius.  Candidates are then compared exactly.

A window can only reach the threshold if that share of its shingles occurs in the benchmark, so only
such windows are fingerprinted.  If no shingle repeats, windows at the threshold differ by 9.7 bits of 64 on
average; a larger difference than 23 has a probability under 1e-5 there and less above.  A repeated shingle
weighs by its square there, so pairs in which the window or the item repeats one are all compared exactly,
unless the shingles they share are too few.

The benchmark goes to the executors in blocks of a checked size; each block is one pass over the documents.

Defined results: null or empty texts and items match nothing; texts shorter than an item are compared
whole; items under five words are compared as one shingle; equal items and repeated rows are each
reported, also if their ids are null; with an empty table there are no rows; more columns are neither read nor in the way.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import bucket_of, for_python, read_spread, read_table, release
from quadframe.llm.hashing import mix, run_hashes, runs_of_documents, word_hashes
from quadframe.llm.words import text_batches

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
#: Characters of text that are split into words at a time.
SLICE = 1_000_000
#: Bytes of benchmark text that one pass sends to each executor.
BLOCK_BYTES = 16_000_000
#: Items of such a block at most, on average.
BLOCK_ITEMS = 50_000
#: Items of one length that are compared without looking up their blocks.
FEW = 64
#: Windows times items that are marked at a time.
CELLS = 1_000_000

_SPACES = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
_ONES = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def split_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPACES).split()


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of a shingle's own hash."""
    bits = np.unpackbits(mix(shingles + np.uint64(0x5851F42D4C957F2D)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def to_blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as 8 bytes each, from sums of signs."""
    return np.packbits(sums > 0, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two lists of shingles."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(i, minlength=len(keys)) for i in (at[: len(a)], at[len(a) :]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def soonest_repeat(shingles: np.ndarray) -> np.ndarray:
    """For each place: the first place by which a shingle that stands there or later has come again; past the end if none
    has.  A window repeats a shingle if that place lies in it."""
    order = np.argsort(shingles, kind="stable")
    again = np.full(len(shingles), len(shingles))
    same = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    again[order[same]] = order[same + 1]
    return np.minimum.accumulate(again[::-1])[::-1]


class Index:
    """Items of a block, by their number of words."""

    def __init__(self, items: list[tuple[object, str]], shingle: int, threshold: float, radius: int):
        self.shingle, self.threshold, self.radius = shingle, threshold, radius
        by_length: dict[int, list[tuple[object, np.ndarray]]] = {}
        for key, text in items:
            words = split_words(text or "")
            if words:
                by_length.setdefault(len(words), []).append((key, run_hashes(word_hashes(words), min(shingle, len(words)))))
        self.lengths = sorted(by_length)
        self.items = by_length
        #: For each value of a block, the values that differ in few enough bits.
        value = np.arange(256)
        self.neighbours = np.stack([np.flatnonzero(_ONES[value ^ v] <= radius // BLOCKS) for v in value])
        #: For each length: the items' fingerprints, and for each block the items in order of its value and where each
        #: value's items begin.
        self.near = {}
        for m, group in by_length.items():
            prints = to_blocks(np.stack([signs(s).sum(axis=0) for _, s in group]))
            lists = [(np.argsort(p, kind="stable").astype(np.int32), np.searchsorted(np.sort(p), np.arange(257))) for p in prints.T]
            self.near[m] = prints, lists
        #: For each length: the items' shingles in order and their items, and which items repeat a shingle.
        self.holders = {}
        for m, group in by_length.items():
            own = [np.unique(s) for _, s in group]
            item = np.repeat(np.arange(len(group)), [len(u) for u in own])
            order = np.argsort(keys := np.concatenate(own), kind="stable")
            self.holders[m] = keys[order], item[order], np.array([len(u) < len(s) for u, (_, s) in zip(own, group, strict=True)])
        #: For each shingle size: the items' shingles, and a bitmap of their upper bits for a quick look.
        self.known = {}
        for n in {min(shingle, m) for m in self.lengths}:
            known = np.unique(np.concatenate([s for m in self.lengths if min(shingle, m) == n for _, s in by_length[m]]))
            seen = np.zeros(1 << 22, bool)
            seen[(known >> np.uint64(42)).astype(np.int64)] = True
            self.known[n] = known, seen

    def hits(self, shingles: np.ndarray, n: int) -> np.ndarray:
        known, seen = self.known[n]
        hit = seen[(shingles >> np.uint64(42)).astype(np.int64)]
        some = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(known, shingles[some]), len(known) - 1)
        hit[some] = known[place] == shingles[some]
        return hit

    def within(self, prints: np.ndarray, m: int) -> Iterator[tuple[int, int]]:
        """Windows and items of m words whose fingerprints lie within the radius: each block's neighbours are looked up in
        its list.  Windows are taken in slices, so the marks of candidates stay small however many items there are.  A few
        items are compared without their lists, which finds the same."""
        of_items, lists = self.near[m]
        if len(of_items) <= FEW:
            apart = np.bitwise_count(prints.view("<u8") ^ of_items.view("<u8").ravel())
            yield from zip(*(x.tolist() for x in np.nonzero(apart <= self.radius)), strict=True)
            return
        step = max(1, CELLS // len(of_items))
        for k in range(0, len(prints), step):
            some = prints[k : k + step]
            candidate = np.zeros((len(some), len(of_items)), bool)
            for b, (order, starts) in enumerate(lists):
                values = self.neighbours[some[:, b]].ravel()
                begin = starts[values]
                n = starts[values + 1] - begin
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)
                candidate[np.repeat(np.arange(len(values)) // self.neighbours.shape[1], n), order[at]] = True
            for w in np.flatnonzero(candidate.any(axis=1)).tolist():
                i = np.flatnonzero(candidate[w])
                near = _ONES[some[w] ^ of_items[i]].sum(axis=1) <= self.radius
                yield from ((w + k, x) for x in i[near].tolist())

    def sharing(self, window: np.ndarray, m: int, least: float) -> list[int]:
        """Items of m words that may have so many shingles in common with a window; all, or those that
        repeat a shingle if the window repeats none."""
        keys, item, repeats = self.holders[m]
        own, count = np.unique(window, return_counts=True)
        if len(own) == len(window) and not repeats.any():
            return []
        first, end = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
        n = end - first
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        most = np.bincount(item[at], weights=np.repeat(count, n), minlength=len(repeats))
        return np.flatnonzero((most >= least - 1e-9) & (repeats | (len(own) < len(window)))).tolist()

    def search(self, shingles: np.ndarray, hit: np.ndarray, words: int, n: int) -> dict[int, tuple[float, int, int]]:
        """For one document: the best (similarity, first word, words) of each item found, by (m, place)."""
        found: dict = {}
        before = np.concatenate([[0], np.cumsum(hit)])
        sums = None
        for m in self.lengths:
            if min(self.shingle, m) != n:
                continue
            width = min(m, words) - n + 1
            count = before[width:] - before[:-width]
            begin = np.flatnonzero(count >= self.threshold * (m - n + 1) - 1e-9)
            if not len(begin):
                continue
            if sums is None:
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(shingles), axis=0, dtype=np.int32)])
                soonest = soonest_repeat(shingles)
            prints = to_blocks(sums[begin + width] - sums[begin])
            pairs = set(self.within(prints, m))
            repeating = np.arange(len(begin)) if self.holders[m][2].any() else np.flatnonzero(soonest[begin] < begin + width)
            for w, at in zip(repeating.tolist(), begin[repeating].tolist(), strict=True):
                pairs.update((w, i) for i in self.sharing(shingles[at : at + width], m, self.threshold * (m - n + 1)))
            for w, i in sorted(pairs):
                at = int(begin[w])
                alike = similarity(shingles[at : at + width], self.items[m][i][1])
                if alike >= self.threshold and alike > found.get((m, i), (0.0,))[0]:
                    found[m, i] = alike, at, width + n - 1
        return found


def _scan(index: Index, doc_type: pa.DataType, item_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", doc_type), ("item_id", item_type), ("similarity", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in text_batches(texts, SLICE):
                cut = [split_words(t) for t in texts[part]]
                lengths = np.fromiter(map(len, cut), np.int64, len(cut))
                hashes = word_hashes([w for ws in cut for w in ws])
                rows: list[list] = [[], [], [], [], []]
                for n in sorted(index.known):
                    at, document = runs_of_documents(lengths, n)
                    shingles = run_hashes(hashes, n)[at]
                    hit = index.hits(shingles, n)
                    ends = np.searchsorted(document, np.arange(len(cut)), side="right")
                    for d in np.unique(document[hit]).tolist():
                        i, j = ends[d - 1] if d else 0, ends[d]
                        for (m, k), (alike, start, words) in index.search(shingles[i:j], hit[i:j], int(lengths[d]), n).items():
                            for column, value in zip(rows, (d + part.start, index.items[m][k][0], alike, start, words), strict=True):
                                column.append(value)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], item_type), pa.array(rows[2]), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], schema=schema)
        release()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, similarity, start, n_words)``: the best window for each document and item."""
    import pyspark.sql.pandas.types as types

    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    size, n = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = max(1, -(-2 * (size or 0) // block_bytes), -(-n // BLOCK_ITEMS))
    source = docs.select("doc_id", "text")
    doc_kind, item_kind = source.schema["doc_id"].dataType, items.schema["item_id"].dataType
    found = None
    for b in range(blocks):
        own = items.where(bucket_of(blocks, "item_id", "text") == b).sort("item_id", "text").collect()
        index = Index([tuple(r) for r in own], shingle, threshold, radius)
        if index.known:
            part = for_python(source).mapInArrow(_scan(index, types.to_arrow_type(doc_kind), types.to_arrow_type(item_kind)), f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, similarity double, start long, n_words long")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, similarity double, start long, n_words long")
    return found


#: For items of five words or more, as the tables have them.
OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+') as ws from documents),
b as (select item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+') as ws from benchmark),
bg as (select item_id, m, g, count(*) as c from (select item_id, len(ws) as m, array_to_string(ws[i:i + 4], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 3)) as i from b where len(ws) >= 5)) group by all),
dg as (select doc_id, n, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, len(ws) as n, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
hits as (select doc_id, item_id, n, m, i, g, c from dg join bg using (g)),
starts as (select distinct doc_id, item_id, n, m, unnest(range(greatest(1, i - m + 5), least(i, greatest(1, n - m + 1)) + 1)) as s from hits),
common as (select doc_id, item_id, n, m, s, g, least(count(*), any_value(c)) as c from starts join hits using (doc_id, item_id, n, m) where i between s and s + least(m, n) - 5 group by all),
alike as (select doc_id, item_id, s, least(m, n) as n_words, sum(c) / (least(m, n) - 4 + m - 4 - sum(c)) as similarity from common group by doc_id, item_id, n, m, s),
best as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, s) as r from alike)
select doc_id, item_id, similarity, cast(s - 1 as bigint) as start, cast(n_words as bigint) as n_words from best where r = 1 and similarity >= 0.8
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return contaminated(read_spread(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
