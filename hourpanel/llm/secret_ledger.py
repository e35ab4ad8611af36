"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text.  The
ledger holds which (blob, rule version) pairs have been scanned, and the spans
found.  A run scans only pairs that the ledger lacks, one text for each blob
whatever the number of its paths, and joins the findings back to all paths.

Spans count code points, the end exclusive.  A rule's matches are leftmost and
don't overlap; a match whose secret is too short is dropped after it has
consumed its characters.

Defined cases: a null text counts as empty; a path may be null or have many
versions (each row is judged by its own text); rows that repeat are each
returned; an empty table gives an empty result; only the named columns are
read, whatever the others are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, let, shared_path, store, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int
    secret_group: int = 0
    min_length: int = 1


# The base patterns.  For access and hex the least length stands in the pattern: their characters after
# the prefix are taken greedily, so a run that is too short matches nowhere in itself either way.
BASE_RULES = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 1),
    Rule("hex", r"[0-9a-f]{24,}", 1),
)
# Public formats of further credentials, the second rule version.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 2),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 2),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 2),
)
ALL_RULES = BASE_RULES + ADDED_RULES

SCANNED = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("version", T.IntegerType())])
FOUND = T.StructType([*SCANNED.fields, T.StructField("kind", T.StringType()), T.StructField("rank", T.IntegerType()),
                      T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class Ledger:
    """The scanned pairs and the findings, two Parquet tables that runs append to.

    Findings are written before the pairs that they come from, so a run that
    breaks off is scanned again; readers drop findings that were written twice.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "secret-ledger")
        for part, schema in (("found", FOUND), ("scanned", SCANNED)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{part}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(FOUND).parquet(f"{self.path}/found").distinct()


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _unseen(addresses: DataFrame, ledger: Ledger, versions: list[int]) -> DataFrame:
    """(blob, path, versions) of the blobs with unscanned versions; path is one that holds the blob."""
    blobs = addresses.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = blobs.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])))
    left = pairs.join(ledger.scanned().distinct(), ["blob", "version"], "left_anti")
    return store(left.groupBy("blob").agg(F.min("path").alias("path"), F.collect_set("version").alias("versions")), "unseen")


def _matches(r: Rule, rank: int) -> Column:
    """The rule's matches, each with the length of the piece before it; null without a match."""
    matches = F.regexp_extract_all(F.col("text"), F.lit(r.pattern), F.lit(0))
    pieces = F.split(F.col("text"), r.pattern, -1)

    def entry(m):
        each = F.zip_with(m, F.slice(pieces, 1, F.size(m)), lambda x, p: F.struct(
            F.length(p).alias("gap"), F.length(x).alias("long"),
            (F.length(F.regexp_extract(x, r.pattern, r.secret_group)) >= r.min_length).alias("good")))
        return F.when(F.size(m) > 0, F.struct(F.lit(r.version).alias("version"), F.lit(r.kind).alias("kind"),
                                              F.lit(rank).alias("rank"), each.alias("each")))

    return F.when(F.array_contains("versions", r.version), let(matches, entry))


def find_spans(texts: DataFrame, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """(blob, version, kind, rank, start, end) in ``texts`` (blob, text, versions).

    A text is matched once by each rule; where it has matches, it is also split
    by the rule, and the running sum of the lengths of pieces and matches gives
    the places.
    """
    found = [_matches(r, rank) for rank, r in enumerate(rules)]
    per_rule = texts.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    rows = per_rule.select("blob", "f.version", "f.kind", "f.rank", F.posexplode("f.each").alias("i", "e"))
    rows = rows.dropDuplicates(["blob", "rank", "i"])  # a row that repeats brings its matches again
    so_far = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum((F.col("e.gap") + F.col("e.long")).cast("long")).over(so_far))
    return placed.where("e.good").select("blob", "version", "kind", "rank",
                                         (F.col("end") - F.col("e.long")).alias("start"), "end")


def scan_unseen(docs: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
                rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs``; return the stored (path, blob) addresses."""
    text = text_or_empty(docs, text_col)
    versions = docs.select(docs[path_col].alias("path"), address(text).alias("blob"), text.alias("text"))
    addresses = store(versions.select("path", "blob"), "addresses")
    unseen = _unseen(addresses, ledger, sorted({r.version for r in rules}))
    todo = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"), "versions")
    # by blob and path: the many paths of one blob don't meet in one partition, and one of them brings the text
    texts = versions.join(todo, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")))
    found = find_spans(texts.select("blob", "text", "versions"), rules)
    found.write.mode("append").parquet(f"{ledger.path}/found")
    unseen.select("blob", F.explode("versions").alias("version")).write.mode("append").parquet(f"{ledger.path}/scanned")
    return addresses


def _spans_by_blob(ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """blob -> its spans as an array ordered by start, then kind as listed; stored, so that its size is known."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    mine = ledger.findings().where(F.array_contains(kinds, F.col("kind")))
    return store(mine.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans")),
                 "spans")


def findings_by_path(docs: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
                     rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """One row for each row of ``docs``: the path and ``spans``, an array (start, rank, end, kind)."""
    addresses = scan_unseen(docs, ledger, path_col, text_col, rules)
    spans = _spans_by_blob(ledger, rules).withColumnRenamed("blob", "b")
    none = F.array().cast(spans.schema["spans"].dataType)
    return (addresses.join(spans, F.col("blob") == F.col("b"), "left")
            .select(F.col("path").alias(path_col), F.coalesce("spans", none).alias("spans")))


def redact(docs: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
           rules: tuple[Rule, ...] = ALL_RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch that spans cover, alone or overlapping, replaced by ``mark``."""
    scan_unseen(docs, ledger, path_col, text_col, rules)
    b, s = fresh(docs, "blob", "spans")
    spans = _spans_by_blob(ledger, rules).select(F.col("blob").alias(b), F.col("spans").alias(s))
    text = text_or_empty(docs, text_col)
    met = docs.join(spans, address(text) == spans[b], "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):  # ``at``: code points used so far
        gap = F.when(x["start"] > acc["at"], F.concat(
            text.substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)))
        first = F.when((x["start"] == 0) & (acc["at"] == 0), F.lit(mark))
        joined = F.when((x["start"] == acc["at"]) & (acc["at"] > 0), F.lit(""))
        return F.struct(F.concat(acc["out"], F.coalesce(gap, first, joined, F.lit(""))).alias("out"),
                        F.greatest(acc["at"], x["end"]).alias("at"))

    clean = F.aggregate(s, start, step, lambda acc: F.concat(
        acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col(s).isNull(), docs[text_col]).otherwise(clean)
    return met.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
