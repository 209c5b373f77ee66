"""SpotSigs: document fingerprints from chains of content words behind common words.

An anchor is a common word of the four languages; its signature is the anchor with the next content words
behind it, all common words between them skipped.  The fingerprint is the set of a document's signatures.
Fingerprints are compared by Jaccard; pairs are searched by partitions of the set's size and by the rarest
signatures, and sizes alone rule out most.  Everything here is DataFrame operations.

Defined results: a null text counts as empty; a text without anchors has one signature, its words as a
whole, so equal texts have equal fingerprints and an empty text has the fingerprint of no words; repeated
rows and ties of ids are ordered by their texts; an empty table gives an empty result; more columns are
neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadframe.llm.common import partitions, read_table

# Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is that it was for on are as with be by this at or from "
    "le la les de des du et un une est que qui dans pour par sur pas plus avec en au "
    "der die das und den von zu mit sich auf für nicht ein eine als auch dem ist "
    "el los las del y se por con una su para como más pero sus lo al"
).split()
CHAIN = 3

#: Set before common words; texts can't hold it, for it counts as space.
_MARK = "\x01"


def _any_of(words: set[str]) -> str:
    """A pattern for any of the words that branches letter by letter."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    branches = "|".join(h + _any_of(rest) for h, rest in sorted(heads.items()))
    return "" if not branches else f"(?:{branches})?" if "" in words else f"(?:{branches})" if len(heads) > 1 else branches


_ANCHOR = f"(?<= )(?={_any_of(set(ANCHORS))} )"
_SKIP = f"(?:{_MARK}[^ ]+ )*+"
#: At a common word, without moving on: it, then the next content words and the common ones between.
_SIGNATURE = f"(?=({_MARK}[^ ]+ {_SKIP}" + f"[^ ]+ {_SKIP}" * (CHAIN - 1) + "[^ ]+) )"


def add_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the set of a text's signatures, 32-bit numbers in ascending order.

    Each step is a column of its own, so that none is computed twice.
    """
    # the words in lower case, with one space before, between and behind them
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), rf"[\s\p{{Punct}}{_MARK}]+", " ")), F.lit(" "))
    chains = F.regexp_extract_all("__line", F.lit(_SIGNATURE), F.lit(1))
    # common words after the anchor are dropped from the chain
    clean = F.transform("__chains", lambda c: F.crc32(F.regexp_replace(c, f" {_MARK}[^ ]+", "").cast("binary")))
    found = df.withColumn("__line", F.regexp_replace(line, _ANCHOR, _MARK)).withColumn("__chains", chains)
    whole = F.array(F.crc32(F.col("__line").cast("binary")))
    return found.withColumn(name, F.when(F.size("__chains") > 0, F.array_sort(F.array_distinct(clean))).otherwise(whole)).drop("__line", "__chains")


def fingerprint(signature_set: Column) -> Column:
    """A set of signatures as text: 8 hex digits each."""
    return F.array_join(F.transform(signature_set, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets; both hold one signature at least."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def similar_pairs(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Pairs ``(a, b, likeness)`` of class representatives with a likeness of ``threshold`` or more, for rows
    ``(key, signatures)``; rows with equal sets are one class, named by its smallest key.

    Sets are dealt into partitions by the logarithm of their size, as wide as the threshold allows, so a
    pair's sizes lie in the same or neighbouring partitions.  Sets meet in the first signatures, rarest
    first, of which any two similar sets share one.
    """
    classes = prints.groupBy("signatures").agg(F.min(key).alias("id")).where(F.col("id").isNotNull())
    flat = classes.select("id", "signatures", F.explode("signatures").alias("s"))
    often = flat.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = flat.select("id", "s").join(often, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    size = F.size("r")
    heads = ranked.select("id", size.alias("size"), F.explode(F.slice("r", F.lit(1), (size - F.ceil(F.lit(threshold) * size) + 1).cast("int"))).alias("h")).where("h.n > 1")
    part = F.floor(F.log(F.col("size")) / F.log(F.lit(1 / threshold)) + 1e-9)
    left = heads.select("id", "size", F.col("h.s").alias("s"), part.alias("part")).alias("x")
    right = heads.select("id", "size", F.col("h.s").alias("s"), F.explode(F.array(part - 1, part, part + 1)).alias("part")).alias("y")
    fits = (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size"))
    pairs = left.join(right, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sets = lambda s: classes.select(F.col("id").alias(s), F.col("signatures").alias(f"{s}_set"))
    return pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", likeness(F.col("a_set"), F.col("b_set")).alias("likeness")).where(F.col("likeness") >= threshold)


def _range_number(key: Column, cuts: list) -> Column:
    """How many of the descending cuts are not below the key, found in two steps."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    full = F.size(F.filter(F.array(*(F.lit(b[-1]) for b in blocks)), lambda c: c >= key))
    own = F.get(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), full)
    return full * width + F.when(full < len(blocks), F.size(F.filter(own, lambda c: c >= key))).otherwise(len(cuts) - len(blocks) * width)


def with_next(rows: DataFrame, key: str, columns: list[str], derive: Callable[[DataFrame], DataFrame] | None = None, derived: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``next_<column>``: what the next row in descending order of the key has there; the first row
    follows the last.  Null keys come last.  ``derive`` adds the columns ``derived`` from others after the rows have been
    dealt, so they aren't shuffled; they get their ``next_`` as well.

    Rows are dealt into ranges of the key; the first row of each range also stands, as a ghost, at the end
    of the range before it, so no task sees more than its range.  One row of numbers for each range, a
    small multiple of the partitions, comes to the driver.
    """
    spark = rows.sparkSession
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    dealt = rows.withColumn("__range", F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(_range_number(F.col(key), cuts)))
    firsts = sorted(dealt.groupBy("__range").agg(F.max(key).alias("k")).collect())
    if not firsts:
        rows = derive(rows) if derive else rows
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in (*columns, *derived)))
    before = spark.createDataFrame([(r["__range"], firsts[i - 1]["__range"]) for i, r in enumerate(firsts)], "__range int, __to int")
    whole = F.struct(F.col(key).isNotNull().alias("known"), F.col(key), *columns)
    first = dealt.where(F.col(key).isin([r["k"] for r in firsts if r["k"] is not None]) | F.col(key).isNull()).groupBy("__range").agg(F.max(whole).alias("row"))
    ghosts = first.join(F.broadcast(before), "__range").select(F.col("__to").alias("__range"), "row.*", F.lit(True).alias("__ghost")).drop("known")
    both = dealt.withColumn("__ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    if derive:
        both = derive(both.repartition("__range"))
    inside = W.partitionBy("__range").orderBy("__ghost", whole.desc())
    return both.select("*", *(F.lead(c).over(inside).alias(f"next_{c}") for c in (*columns, *derived))).where("not __ghost").drop("__range", "__ghost")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half replaced by as many first characters of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(next_text, F.lit(1), half))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how much they and the next one's agree."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], lambda dealt: add_signatures(dealt, "text", "s"), ("s",))
    rows = add_signatures(rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))), "edited", "e")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )
