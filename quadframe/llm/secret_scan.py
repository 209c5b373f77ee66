"""Secret scans over all versions of all files: an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content.  A ledger remembers which pairs of
blob and rule version have been scanned, so a run scans each new content once, however many paths or
versions hold it, and joins the findings back to all of them.  Everything here is DataFrame operations.

Defined results: a null text counts as empty; an empty text has no findings; equal texts under several
paths or repeated rows get the same findings, once for each row; an empty table gives an empty result;
columns other than the key and the text are neither read nor in the way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadframe.llm.common import bucket_of, path_exists, read_table, shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of a Java pattern whose given group has so many characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The patterns of the contract.  A run of hex digits of 24 or more, and AKIA with 16 or more
# behind it, match at the same places as the open-ended patterns with short matches dropped: a short
# match can't hide a long one there.  For assignments it can, so these are filtered after matching.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULE_VERSION = "base-1"

#: Parts into which the rows of one content are dealt when findings return to paths.
SALTS = 16


def _match_row(k: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["before"].alias("before"), x["chars"].alias("chars"), x["value"].alias("value"))


def _raw_matches(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All matches: kind's number, place in the order of matches, characters before it since the last
    match, its own characters, and those of its value."""
    kinds = []
    for k, rule in enumerate(rules):
        zipped = F.arrays_zip(
            F.transform(F.split(text, rule.pattern, -1), F.length).alias("before"),
            F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length).alias("chars"),
            F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("value"),
        )
        rows = F.transform(
            F.filter(zipped, lambda x: x["chars"].isNotNull()),
            _match_row(k),
        )
        kinds.append(F.when(text.rlike(rule.pattern), rows).otherwise(F.array().cast("array<struct<k:int,i:int,before:int,chars:int,value:int>>")))
    return F.concat(*kinds)


def blobs_of(versions: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct content once: ``blob`` (its SHA-256) and ``content``."""
    content = text_or_empty(text)
    return versions.select(F.sha2(content, 256).alias("blob"), content.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings ``(blob, rule_version, k, kind, start, end)``: code points, end exclusive."""
    so_far = W.partitionBy("blob", "k").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    least, kind = (F.element_at(F.array(*map(F.lit, x)), F.col("k") + 1) for x in ([r.least for r in rules], [r.kind for r in rules]))
    return (
        blobs.select("blob", F.inline(_raw_matches(F.col("content"), rules)))
        .withColumn("end", F.sum(F.col("before") + F.col("chars")).over(so_far))
        .where(F.col("value") >= least)
        .select("blob", F.lit(rule_version).alias("rule_version"), "k", kind.alias("kind"), (F.col("end") - F.col("chars")).alias("start"), "end")
    )


def scan_unseen(versions: DataFrame, scanned: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings in contents that ``scanned`` (blob, rule_version) doesn't list, and the pairs now scanned."""
    blobs = blobs_of(versions, text)
    if scanned is not None:
        blobs = blobs.join(scanned.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return scan_blobs(blobs, rules, rule_version), blobs.select("blob", F.lit(rule_version).alias("rule_version"))


def join_back(versions: DataFrame, findings: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``versions`` with its blob and ``found``, all findings in order of start, then kind.

    Rows of one content are dealt into parts, each joined to a copy of that content's findings, so a
    content that a third of all paths share doesn't land in one task.
    """
    found = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "k", "kind", "end"))).alias("found"))
    dealt = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = versions.withColumn("blob", F.sha2(text_or_empty(text), 256)).withColumn("__salt", bucket_of(SALTS, F.col(key)))
    return rows.join(dealt, ["blob", "__salt"], "left").drop("__salt")


def spans(found: Column) -> Column:
    """kind:start:end of all findings, joined by commas."""
    return F.array_join(F.transform(F.coalesce(found, F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint>>")), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with the secret part of every finding replaced by a mark of its kind."""
    for rule in rules:
        if rule.group == 0:
            text = F.when(text.rlike(rule.pattern), F.regexp_replace(text, rule.pattern, f"[{rule.kind}]")).otherwise(text)
            continue
        zipped = F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("before"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
        )
        # the value ends the match
        kept = lambda x: F.when(F.length(x["value"]) >= rule.least, F.concat(F.substring(x["match"], F.lit(1), F.length(x["match"]) - F.length(x["value"])), F.lit(f"[{rule.kind}]"))).otherwise(x["match"])
        text = F.when(text.rlike(rule.pattern), F.array_join(F.transform(zipped, lambda x: F.concat(x["before"], F.coalesce(kept(x), F.lit("")))), "")).otherwise(text)
    return text


class BlobLedger:
    """A ledger in a folder of Parquet files, one subfolder for each batch.

    ``commit`` writes findings before the pairs scanned, each by one overwriting job, so a batch that
    was cut short or comes again leaves the same state as one that ran once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, but: str | None = None) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema + ", batch string")
        rows = self.spark.read.schema(schema + ", batch string").parquet(f"{self.path}/{name}")
        return rows.where(F.col("batch") != but) if but is not None else rows

    def scanned(self, but: str | None = None) -> DataFrame:
        return self._read("scanned", "blob string, rule_version string", but)

    def findings(self) -> DataFrame:
        """Findings of batches whose scan is complete."""
        rows = self._read("findings", "blob string, rule_version string, k int, kind string, start bigint, end bigint")
        done = self.scanned().select("batch").distinct()
        return rows.join(done, "batch", "left_semi")

    def commit(self, batch: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text") -> None:
        """Scans what no other batch has scanned."""
        found, pairs = scan_unseen(versions, self.scanned(but=batch), rules, rule_version, text)
        found.write.mode("overwrite").parquet(f"{self.path}/findings/batch={batch}")
        pairs.write.mode("overwrite").parquet(f"{self.path}/scanned/batch={batch}")

    def report(self, versions: DataFrame, rule_version: str = RULE_VERSION, text: str = "text", key: str = "doc_id") -> DataFrame:
        return join_back(versions, self.findings().where(F.col("rule_version") == rule_version).drop("batch"), text, key)


def commit_history(ledger: BlobLedger, docs: DataFrame) -> None:
    """Commits the documents as they came, in two batches: those up to the median id, then the others, rows without
    an id among them.  A content of the first batch isn't scanned again in the second."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    older = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    ledger.commit("1", docs.where(older))
    ledger.commit("2", docs.where(~older))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts by kind, all spans and their SHA-256, by a fresh ledger in the shared folder."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    commit_history(ledger, docs)
    joined = ledger.report(docs).select("doc_id", "found")
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0))
    n = lambda kind: F.when(F.col("found").isNull(), F.lit(0)).otherwise(count(kind)).cast("long").alias(f"n_{kind}")
    return joined.select("doc_id", *(n(r.kind) for r in RULES), F.sha2(spans(F.col("found")), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))


_ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?"


def _sql_kind(k: int, kind: str, pattern: str, value: str, least: int) -> str:
    """SQL for the spans of one kind: the pieces between matches give where each match starts."""
    return f"""
    select doc_id, {k} as k, '{kind}' as kind, e - length(m) as s, e from (
      select doc_id, m, sum(length(p) + length(m)) over (partition by doc_id order by i) as e from (
        select doc_id, unnest(ps[1:len(ms)]) as p, unnest(ms) as m, generate_subscripts(ms, 1) as i from (
          select doc_id, regexp_split_to_array(t, '{pattern}') as ps, regexp_extract_all(t, '{pattern}') as ms from d)))
    where length({value}) >= {least}"""


OP1_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({' union all '.join((
    _sql_kind(0, "assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"regexp_replace(m, '^{_ASSIGN}', '')", 6),
    _sql_kind(1, "access", "AKIA[A-Z0-9]+", "m", 20),
    _sql_kind(2, "hex", "[0-9a-f]+", "m", 24)))}),
g as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as c, count(*) filter (k = 2) as h,
  string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k) as spans from f group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""
