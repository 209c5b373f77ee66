"""Sharding into parts of nearly equal bytes by Karmarkar-Karp differencing.

Rows with equal texts form an indivisible group.  Groups are dealt into cells by a hash; each cell
differences its groups into as many parts as there are shards, and the cells' parts, few numbers each,
are differenced against each other in rounds until one partition is left.

Defined results: a null text has no bytes (size 1) and forms a group with empty texts; repeated rows and
ties go to one shard; an empty table gives an empty result; more columns are neither read nor in the way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import bucket_of, cut, read_table, text_or_empty
from quadframe.llm.ranks import number_within

#: Groups that a cell has on average, and cells that a round joins into one.
CELL_GROUPS = 16_384
FAN_IN = 1_024


def difference(partitions: Iterable[tuple[int, ...]], parts: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Karmarkar-Karp for any number of parts.

    Each item is a partial partition, a tuple of at most ``parts`` sums (one for a plain number).  Takes
    the two with the largest spread and adds the largest sum of one to the smallest of the other, and so
    on, until one is left.  Gives its sums and, for each part, the (item, place in item) that it holds.
    """
    heap: list = []
    for i, sums in enumerate(partitions):
        full = sorted(((s, (i, j)) for j, s in enumerate(sums)), key=lambda x: -x[0])
        full += [(0, None)] * (parts - len(full))
        heap.append((-(full[0][0] - full[-1][0]), i, full))
    heapq.heapify(heap)
    ties = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        both = [(x + y, p if q is None else q if p is None else (p, q, None)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        both.sort(key=lambda x: -x[0])
        heapq.heapreplace(heap, (-(both[0][0] - both[-1][0]), ties, both))
        ties += 1
    held: list[list[tuple[int, int]]] = [[] for _ in range(parts)]
    sums = [0] * parts
    if heap:
        for k, (total, tree) in enumerate(heap[0][2]):
            sums[k], todo = total, [tree]
            while todo:
                node = todo.pop()
                if node is None:
                    continue
                if len(node) == 3:
                    todo += node[:2]
                else:
                    held[k].append(node)
    return sums, held


def _cell(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "text_key"], ascending=[False, True], kind="stable")
        _, held = difference(((int(b),) for b in pdf["bytes"]), parts)
        part = np.zeros(len(pdf), np.int32)
        for k, items in enumerate(held):
            part[[i for i, _ in items]] = k
        return pdf.assign(part=part)[["text_key", "bytes", "cell", "part"]]

    return run


def _round(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "part"])
        cells, at = np.unique(pdf["cell"].to_numpy(), return_index=True)
        sums = np.zeros((len(cells), parts), np.int64)
        sums[np.searchsorted(cells, pdf["cell"]), pdf["part"]] = pdf["bytes"]
        totals, held = difference((tuple(map(int, s)) for s in sums), parts)
        rows = [(int(cells[i]), j, k) for k, items in enumerate(held) for i, j in items]
        out = pd.DataFrame(rows, columns=["cell", "part", "next_part"]).merge(pdf, on=["cell", "part"], how="inner")
        return out[["cell", "part", "next_cell", "next_part", "bytes"]]

    return run


def _parts_of_groups(groups: DataFrame, parts: int, n_groups: int, cell_groups: int, fan_in: int) -> DataFrame:
    """``(text_key, shard)`` for groups ``(text_key, bytes)``."""
    cells = max(1, -(-n_groups // cell_groups))
    dealt = groups.withColumn("cell", bucket_of(cells, F.col("text_key"), F.lit(8)).cast("long"))
    labelled = cut(dealt.groupBy("cell").applyInPandas(_cell(parts), "text_key binary, bytes long, cell long, part int"))
    sums = labelled.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes"))
    to = labelled.select("text_key", "cell", "part")
    while True:
        cells = -(-cells // fan_in)
        merged = sums.withColumn("next_cell", F.floor(F.col("cell") / fan_in))
        step = cut(merged.groupBy("next_cell").applyInPandas(_round(parts), "cell long, part int, next_cell long, next_part int, bytes long"))
        to = to.join(step.drop("bytes"), ["cell", "part"]).select("text_key", F.col("next_cell").alias("cell"), F.col("next_part").alias("part"))
        if cells == 1:
            return to.select("text_key", F.col("part").alias("shard"))
        sums = step.groupBy(F.col("next_cell").alias("cell"), F.col("next_part").alias("part")).agg(F.sum("bytes").alias("bytes"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", cell_groups: int = CELL_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` for every row; sizes are UTF-8 bytes plus one."""
    content = text_or_empty(text)
    rows = docs.select(F.col(key), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.unhex(F.md5(content.cast("binary"))).alias("text_key"))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    at = _parts_of_groups(groups, shards, docs.count(), cell_groups, fan_in)
    placed = cut(rows.join(at, "text_key").drop("text_key"))
    return number_within(placed, ["shard"], [key, "text_crc32"], [key, "text_crc32", "size"], "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``bytes``."""
    placed = shard_by_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
