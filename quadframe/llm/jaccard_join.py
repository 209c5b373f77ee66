"""Similarity join of documents on their word shingles, exact for a Jaccard threshold.

1. Counting.  Documents are dealt into batches by their id and text.  A batch sends each distinct shingle, as 32
   bits inside a bucket of the hash space, with the number of its documents.  Buckets add the counts and
   tell the batches which shingles two or more documents have, and how many.  A document needs a share of
   such shingles to have any partner; most have not and are done.  (Shingles that meet in 32 bits only
   look more frequent.)
2. Classes.  Documents with equal sets are one class, and shingles are counted again by classes, so what
   copies share with each other alone doesn't count.
3. Candidates.  Shingles are ordered rarest first.  Let d be how many shingles a set can lack in a
   partner.  If the first d + 1 shingles of a set are all rare, each is indexed alone.  Otherwise the
   prefix is extended until a pair must share k = d + d' + 2 shingles of both prefixes, d' being the
   largest d of a possible partner.  If one of these is rare, it is indexed alone.  If all are frequent,
   then of the k - 1 pairs of neighbours among them at most d + d' are broken by a shingle that only one
   side has, so both sets have the same two shingles next to each other: combinations of two neighbouring
   frequent shingles are indexed.  Either way every linked pair meets.
4. Verification.  In a few rounds, each class is compared with one other that it meets, the one with the
   fewest unshared shingles; links make components.  Then all pairs of an entry that aren't in one
   component yet are compared, unless their unshared shingles rule a link out, so no link between
   components is lost, while a group of near copies costs a comparison or two for each member.  An entry
   carries the few signatures before it in its class's order; where two entries have one of these in
   common, the pair has met there already and isn't made again.  Before whole sets are sent, odd
   sketches are compared: 512 bits, each the parity of the shingles that hash to it.  Every bit that
   differs is a shingle of one side alone, so a pair with too many of them is no link for sure.

Hot keys: a signature's entries and a set's documents are dealt over as many salts as there are shuffle
partitions, and what is known of the key goes to those of its salts that occur.  The leftover pairs of a
signature are a grid of cells with about ``CELL`` entries on each side: an entry goes to one row or column
of it, so copies are fewer than the pairs by that factor.

Defined results: a null or empty text has an empty set and links with nothing; repeated rows link with
each other if their set isn't empty; null ids are rows like others, and a component of such rows alone
has a null id; an empty table gives an empty result; more columns are neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import bucket_of, cut, for_python, partitions, read_table, text_or_empty
from quadframe.llm.components import connected_components, merged
from quadframe.llm.hashing import bucket_by_hash, mix, run_hashes, runs_of_documents, word_hashes

BATCH_BYTES = 4_000_000
BUCKET_HASHES = 2_000_000
#: Shingles in at most so many documents are rare: they are indexed alone.
RARE = 16
#: Signatures before its own that an entry of the index carries.
BEFORE = 8
#: Rounds in which each class is compared with one other, before all that are left.
ROUNDS = 2
#: Entries of one signature on each side of a cell of leftover pairs, in the mean.
CELL = 1000
#: Longs of an odd sketch.
ODD_LONGS = 8


@dataclass(frozen=True)
class Similarity:
    """Sets of distinct shingles of so many words; linked from ``percent`` of their union in common."""

    words: int = 5
    percent: int = 80

    def needs(self, n: int) -> int:
        """How many of n shingles a partner has at least."""
        return -(-self.percent * n // 100)

    def lacks(self, n: int) -> int:
        return n - self.needs(n)

    def extra(self, n: int) -> int:
        """k: shared shingles that make a shared pair of neighbours sure."""
        return self.lacks(n) + self.lacks(100 * n // self.percent) + 2


def level(counts: np.ndarray) -> np.ndarray:
    """Quarters of octaves of the number of documents; 0 for one document."""
    return np.minimum(255, np.ceil(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


RARE_LEVEL = int(level(np.array([RARE]))[0])


class _Batch:
    """The sets of a batch: pairs (document, hash) without repeats, sorted by hash, then document."""

    def __init__(self, rows: pa.Table, words: int):
        if "text" in rows.column_names:
            h, document = self._of_texts(rows["text"].to_pylist(), words)
        else:
            sets = [np.frombuffer(x.as_py(), "<u8") for x in rows["tokens"]]
            h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            document = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.lexsort((document, h))
        h, document = h[order], document[order]
        keep = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(document) != 0)]) if len(h) else np.zeros(0, bool)
        self.hash, self.document = h[keep], document[keep]
        new = np.concatenate([[True], np.diff(self.hash) != 0]) if len(self.hash) else np.zeros(0, bool)
        self.begins = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.distinct = self.hash[self.begins]
        self.documents_with = np.diff(np.append(self.begins, len(self.hash)))

    @staticmethod
    def _of_texts(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        cut_ = [t.encode().lower().split() for t in texts]
        lengths = np.fromiter(map(len, cut_), np.int64, len(cut_))
        hashes = word_hashes([w for ws in cut_ for w in ws])
        at, document = runs_of_documents(lengths, words)
        parts, documents = [run_hashes(hashes, words)[at]], [document]
        for n in range(1, words):  # texts with fewer words: all of them as one
            short = np.flatnonzero(lengths == n)
            if len(short):
                begin = (np.cumsum(lengths) - lengths)[short]
                parts.append(mix(run_hashes(hashes, n)[begin] + np.uint64(n)))
                documents.append(short)
        return np.concatenate(parts), np.concatenate(documents)


def _codes(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return bucket_by_hash(hashes, buckets), mix(hashes).astype(np.uint32)


def _send(words: int, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        b = _Batch(table, words)
        bucket, code = _codes(b.distinct, buckets)  # hashes ascend, so buckets do
        found, at = np.unique(bucket, return_index=True)
        ends = np.append(at[1:], len(bucket))[: len(at)].tolist()
        codes, many, counts = [], [], []
        for i, j in zip(at.tolist(), ends, strict=True):
            n, c = b.documents_with[i:j], code[i:j]
            codes.append(np.sort(c[n == 1]).astype("<u4").tobytes())
            many.append(c[n > 1].astype("<u4").tobytes())
            counts.append(n[n > 1].astype("<u4").tobytes())
        batch = table["batch"][0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array(found, pa.int64()), "batch": pa.array(np.full(len(found), batch), pa.int32()), "codes": pa.array(codes, pa.binary()), "many": pa.array(many, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: for each batch, its codes that two documents or more have, and their levels."""
    get = lambda n: [np.frombuffer(x.as_py(), "<u4") for x in table[n]]
    once, many, counts = get("codes"), get("many"), get("counts")
    codes = np.concatenate([*once, *many])
    weight = np.concatenate([np.ones(sum(map(len, once)), np.int64), *counts])
    row = np.concatenate([np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (once, many)])
    order = np.argsort(codes)
    codes, weight, row = codes[order], weight[order], row[order]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(codes) != 0])) if len(codes) else np.zeros(0, np.int64)
    total = np.repeat(np.add.reduceat(weight, begins), np.diff(np.append(begins, len(codes)))) if len(codes) else weight
    shared = total > 1
    codes, levels, row = codes[shared], level(total[shared]), row[shared]
    order = np.argsort(row, kind="stable")
    codes, levels, row = codes[order], levels[order], row[order]
    rows, at = np.unique(row, return_index=True)
    ends = np.append(at[1:], len(row))[: len(at)].tolist()
    cut_ = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)], pa.binary())
    return pa.table({"batch": table["batch"].combine_chunks().take(pa.array(rows, pa.int64())), "bucket": table["bucket"].combine_chunks().take(pa.array(rows, pa.int64())), "codes": cut_(codes.astype("<u4")), "levels": cut_(levels)})


def _sets(like: Similarity, buckets: int) -> Callable:
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Batch(docs, like.words)
        bucket, code = _codes(b.distinct, buckets)
        mine = (bucket.astype(np.uint64) << np.uint64(32)) | code
        levels = np.zeros(len(mine), np.uint8)
        if replies.num_rows and len(mine):
            told = np.concatenate([np.frombuffer(c.as_py(), "<u4").astype(np.uint64) | (np.uint64(k.as_py()) << np.uint64(32)) for k, c in zip(replies["bucket"], replies["codes"], strict=True)])
            told_level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in replies["levels"]])
            order = np.argsort(told)
            place = order[np.minimum(np.searchsorted(told, mine, sorter=order), len(told) - 1)]
            levels = np.where(told[place] == mine, told_level[place], 0).astype(np.uint8)
        level_of = levels[b.group]
        order = np.argsort(b.document, kind="stable")  # hashes ascend inside each document
        hashes, level_of = b.hash[order], level_of[order]
        sizes = np.bincount(b.document, minlength=docs.num_rows)
        shared = np.bincount(b.document, weights=levels[b.group] > 0, minlength=docs.num_rows).astype(np.int64)
        ends = np.cumsum(sizes)
        keys: list = [None] * docs.num_rows
        tokens: list = [None] * docs.num_rows
        rare: list = [None] * docs.num_rows
        seen = set()
        for i in np.flatnonzero((sizes > 0) & (100 * shared >= like.percent * sizes)).tolist():
            h, v = hashes[ends[i] - sizes[i] : ends[i]], level_of[ends[i] - sizes[i] : ends[i]]
            keys[i] = key = xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63
            if key not in seen:
                seen.add(key)
                by = np.lexsort((h, v))
                tokens[i] = h[by].astype("<u8").tobytes()
                rare[i] = v[by].tobytes()
        return pa.table({"id": docs["id"], "batch": docs["batch"], "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.int64()), "unshared": pa.array(sizes - shared, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "levels": pa.array(rare, pa.binary())})

    return run


def _signatures(like: Similarity) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rows = batch.column("node").to_numpy(), []
            for tokens, levels in zip(batch.column("tokens"), batch.column("levels"), strict=True):
                h, v = np.frombuffer(tokens.as_py(), "<u8"), np.frombuffer(levels.as_py(), np.uint8)
                n = len(h)
                d = like.lacks(n)
                if v[d] <= RARE_LEVEL:
                    rows.append(h[: d + 1][v[: d + 1] > 0])
                    continue
                h, v = h[: d + like.extra(n)], v[: d + like.extra(n)]
                often = h[v > RARE_LEVEL]
                rows.append(np.concatenate([h[(v > 0) & (v <= RARE_LEVEL)], mix(often[:-1] * np.uint64(3) + mix(often[1:]))]))
            rows = [np.unique(r.astype(np.int64)) for r in rows]
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            at = np.repeat(np.arange(len(rows)), n)
            signature = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            earlier = np.minimum(np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), BEFORE)
            ends = np.cumsum(earlier)
            inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - earlier, earlier)
            before = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(signature[np.repeat(np.arange(len(at)) - earlier, earlier) + inner]))
            yield pa.RecordBatch.from_arrays([pa.array(signature), pa.array(nodes[at]), batch.column("n").take(pa.array(at)), batch.column("unshared").take(pa.array(at)), before], names=["signature", "node", "n", "unshared", "before"])

    return run


def _compare(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, b_set = [], None, None
            for i, (key, x, y) in enumerate(zip(batch.column("b").to_pylist(), batch.column("a_tokens"), batch.column("b_tokens"), strict=True)):
                if key != last:
                    last, b_set = key, np.sort(np.frombuffer(y.as_py(), "<u8"))
                a_set = np.frombuffer(x.as_py(), "<u8")
                place = np.minimum(np.searchsorted(b_set, a_set), len(b_set) - 1)
                common = int((b_set[place] == a_set).sum())
                if 100 * common >= percent * (len(a_set) + len(b_set) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each of 64 * ODD_LONGS places, as longs."""
    places = 64 * ODD_LONGS
    odd = np.bincount((mix(hashes) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [odd_sketch(np.frombuffer(x.as_py(), "<u8")) for x in batch.column("tokens")]
        odd = np.array(made, np.int64).reshape(-1, ODD_LONGS)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), *(pa.array(odd[:, k]) for k in range(ODD_LONGS))], names=["node", "n", *(f"odd{k}" for k in range(ODD_LONGS))])


def _linked(pairs: DataFrame, classes: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes that are linked, by comparing their whole sets where their sketches allow a link."""
    named = lambda s: sketches.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in sketches.columns[1:]))
    differ = sum((F.bit_count(F.col(f"a_odd{k}").bitwiseXOR(F.col(f"b_odd{k}"))) for k in range(ODD_LONGS)), F.lit(0))
    near = pairs.join(named("a"), "a").join(named("b"), "b").where((100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select("a", "b")
    tokens = lambda s: classes.select(F.col("node").alias(s), F.col("tokens").alias(f"{s}_tokens"))
    both = near.join(tokens("a"), "a").join(tokens("b"), "b").select("a", "b", "a_tokens", "b_tokens")
    return cut(both.mapInArrow(_compare(percent), "a long, b long"))


def _counted(rows: DataFrame, like: Similarity, buckets: int) -> DataFrame:
    """Sets of rows ``(id, text or tokens, batch)`` with how often their shingles occur: ``(id, batch, n_shingles,
    set_key, unshared, tokens, levels)``.  ``set_key`` is null if too few shingles occur in another row;
    shingles stand in one row of a batch for each key."""
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.groupBy("batch").applyInArrow(_send(like.words, buckets), "bucket long, batch int, codes binary, many binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(_count, "batch int, bucket long, codes binary, levels binary")
    return cut(rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_sets(like, buckets), f"id {kind}, batch int, n_shingles long, set_key long, unshared long, tokens binary, levels binary"))


def _possible(like: Similarity, n: Column, u: Column, m: Column, v: Column) -> Column:
    """Whether sets of n and m shingles, u and v of them in no other set, can be linked."""
    most = F.least(n - u, m - v)
    return 100 * most >= like.percent * (n + m - most)


def _links(index: DataFrame, met: DataFrame, classes: DataFrame, like: Similarity, rounds: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Links that connect all components, and the components of linked nodes.  ``met``: the salts of each signature."""
    spark = index.sparkSession
    sketches = cut(classes.select("node", "n", "tokens").mapInArrow(_sketches, "node long, n long, " + ", ".join(f"odd{k} long" for k in range(ODD_LONGS))))
    links, found = None, spark.createDataFrame([], "node long, component long")
    for last in [*[False] * rounds, True]:
        placed = index.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = F.min(F.struct("unshared", "node", "n", "component")).alias("first")
        if not last:
            salted = placed.groupBy("signature", "salt").agg(first, F.min("component").alias("least"), F.max("component").alias("most"))
            entries = salted.groupBy("signature").agg(F.min("first").alias("first"), F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
            other = (F.col("component") != F.col("first.component")) & _possible(like, F.col("n"), F.col("unshared"), F.col("first.n"), F.col("first.unshared"))
            pairs = placed.join(entries.join(met, "signature"), ["signature", "salt"]).where(other).groupBy(F.col("node").alias("a")).agg(F.min("first").alias("first")).select("a", F.col("first.node").alias("b"))
        else:
            members = placed.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("members"))
            largest = F.max(F.struct("members", "component"))
            main = members.groupBy("signature").agg(F.count(F.lit(1)).alias("components"), F.sum("members").alias("entries"), largest.alias("main")).where("components > 1")
            sides = [F.ceil((F.col("entries") - F.col("main.members")) / cell).cast("int").alias("rows"), F.ceil(F.col("entries") / cell).cast("int").alias("columns")]
            main = main.select("signature", F.col("main.component").alias("main"), *sides)
            open_ = cut(placed.join(main.join(met, "signature"), ["signature", "salt"]).drop("salt"))
            own, every = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int"), lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
            x = open_.where("component <> main").withColumns({"row": own("rows"), "column": every("columns")}).alias("x")
            y = open_.withColumns({"column": own("columns"), "row": every("rows")}).alias("y")
            cells = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.column") == F.col("y.column"))
            apart = cells & (F.col("x.component") != F.col("y.component")) & _possible(like, F.col("x.n"), F.col("x.unshared"), F.col("y.n"), F.col("y.unshared")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & ~F.arrays_overlap("x.before", "y.before")
            pairs = x.join(y, apart).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        new = _linked(pairs, classes, sketches, like.percent)
        if new.isEmpty():
            if last:
                break
            continue
        found = connected_components(new) if links is None else merged(found, new)
        links = new if links is None else links.union(new)
    return links, found


def link_components(docs: DataFrame, like: Similarity = Similarity(), text: str = "text", key: str = "doc_id", batch_bytes: int = BATCH_BYTES, bucket_hashes: int = BUCKET_HASHES, rounds: int = ROUNDS, cell: int = CELL) -> DataFrame:
    """``(doc_id, n_shingles, set_key, component_id)`` for every row.

    ``component_id`` is the smallest id that links reach.  ``set_key`` names the set, null where a
    document can't have a partner.
    """
    n = partitions(for_python(docs).sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches, buckets = max(2 * n, -(-size // batch_bytes)), max(n, -(-size // (5 * bucket_hashes)))
    sets = _counted(docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"), bucket_of(batches, F.col(key), F.col(text)).alias("batch")), like, buckets)
    alone = sets.where(F.col("set_key").isNull()).select(F.col("id").alias("doc_id"), "n_shingles", "set_key", F.col("id").alias("component_id"))
    shared = sets.where(F.col("set_key").isNotNull()).select(F.col("id").alias("doc_id"), "n_shingles", "set_key", "tokens", "batch", bucket_of(n, "id").alias("salt"))
    # equal sets are one class; what they alone have in common no longer counts as shared
    told = shared.where(F.col("tokens").isNotNull())  # one row of a set in each batch that has it
    chosen = told.groupBy("set_key", (F.col("batch") % n).alias("part")).agg(F.min("batch").alias("batch")).groupBy("set_key").agg(F.min("batch").alias("batch"))
    once = told.join(chosen, ["set_key", "batch"], "left_semi").select(F.col("set_key").alias("id"), "tokens")
    classes = _counted(once.withColumn("batch", bucket_of(batches, F.col("id"))), like, buckets).where(F.col("set_key").isNotNull()).select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "unshared", "tokens", "levels")
    index = classes.mapInArrow(_signatures(like), "signature long, node long, n long, unshared long, before array<long>").withColumn("salt", bucket_of(n, "node"))
    counts = cut(index.groupBy("signature", "salt").agg(F.count(F.lit(1)).alias("entries")))
    many = counts.groupBy("signature").agg(F.sum("entries").alias("entries")).where("entries > 1")
    met = cut(counts.join(many, "signature", "left_semi").select("signature", "salt"))
    _, found = _links(cut(index.join(met, ["signature", "salt"])), met, classes, like, rounds, cell)

    parts = shared.groupBy("set_key", "salt").agg(F.min("doc_id").alias("least"))
    named = parts.groupBy(F.col("set_key").alias("node")).agg(F.min("least").alias("least")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select(F.col("node").alias("set_key"), "component_id")
    salted = parts.select("set_key", "salt").join(ids, "set_key")
    return alone.unionByName(shared.join(salted, ["set_key", "salt"]).select("doc_id", "n_shingles", "set_key", "component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of three-word shingles, and its component at 90 %."""
    return link_components(read_table(spark, sf_dir, "documents"), Similarity(words=3, percent=90)).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
t as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as k from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
n as (select w.doc_id, count(k) as n from w left join t using (doc_id) group by 1),
often as (select doc_id, k from t where k in (select k from t group by k having count(*) > 1)),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from often a join often b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from n union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select n.doc_id, cast(n as bigint) as n_shingles, min(reach.b) as component_id from n join reach on n.doc_id = reach.a group by 1, 2
"""
