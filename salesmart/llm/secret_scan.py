"""Secrets in texts, found once for each content and rule version.

A ledger names contents by their SHA-256. It keeps, for each content, the rules it was scanned with
and what they found. A scan takes any number of versions of any paths, leaves out what the ledger
already has, scans each other content once, however many paths hold it, appends to the ledger, and
joins the findings back to all paths. Only SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.steps import column

SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("end", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("scanned", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regular expression, matched from the left without overlaps.

    A match counts if its ``group`` has ``least`` characters or more. A changed rule needs a new
    ``version``, so that contents are scanned with it again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base; hex and access keys are matched at their full length at once, which
#: gives the same matches, since one that is too short ends where its characters do.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    # The body runs to the next END line, with headers and escaped newlines. A possessive group is
    # matched in a loop, so its length does not matter.
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----END [A-Z ]*PRIVATE KEY-----))*+-----END [A-Z ]*PRIVATE KEY-----",
        version=2,
    ),
    # A longer scheme is matched from its last characters on; user and password have any length.
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:[^\s:/@]++@", version=2),
)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches in code points, the end exclusive.

    The pieces between matches and the matches alternate, so a match starts where the pieces and
    matches before it end.
    """
    empty = F.array().cast(T.ArrayType(SPAN))
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p).cast("long")).alias("gap"),
        F.transform(matches, lambda m: F.length(m).cast("long")).alias("size"),
        F.transform(groups, lambda g: F.length(g)).alias("part"),
    )

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        end = start + item["size"]
        found = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        more = F.when(item["part"] >= rule.least, F.concat(state["found"], F.array(found)))
        return F.struct(
            F.coalesce(end, start).alias("at"), F.coalesce(more, state["found"]).alias("found")
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))
    found = F.aggregate(lengths, first, step, lambda state: state["found"])
    # Most texts have no match at all; one search tells.
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger, empty where none was written yet."""
    if path is not None:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return spark.read.schema(LEDGER).parquet(path)
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER))


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule], text: str) -> DataFrame:
    """``(blob, text, seen)``: one row for each content that lacks a rule in the ledger.

    Contents are made distinct in the map tasks first, so one that a third of the rows share is
    sent once by each task.
    """
    blobs = versions.select(blob_of(column(text)).alias("blob"), F.coalesce(column(text), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen")
    )
    wanted = F.array(*(F.lit(r.key) for r in rules))
    known = blobs.join(seen, "blob", "left").withColumn(
        "seen", F.coalesce("seen", F.array().cast("array<string>"))
    )
    return known.where(F.size(F.array_except(wanted, F.col("seen"))) > 0)


def blob_of(text: Column) -> Column:
    """The address of a content; null is the empty content."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of the ledger for ``(blob, text, seen)``: each rule that was not applied yet is."""
    nothing = F.array().cast(T.ArrayType(SPAN))
    found, scanned = [], []
    for rank, rule in enumerate(rules):
        new = ~F.array_contains("seen", rule.key)
        found.append(F.when(new, spans(F.col("text"), rule, rank)).otherwise(nothing))
        scanned.append(F.when(new, F.lit(rule.key)))
    return blobs.select(
        "blob",
        F.array_compact(F.array(*scanned)).alias("scanned"),
        F.array_sort(F.concat(*found)).alias("spans"),
    )


def scan(
    versions: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    *,
    text: str = "text",
) -> DataFrame:
    """``versions`` with ``blob`` and ``spans``, sorted by start and then by the order of the rules.

    ``versions`` has a row for each version of each path. ``ledger`` is a folder in shared storage;
    what was scanned is appended there, so a further call scans only what is new: new contents, and
    known ones with a new rule or rule version. Findings of rules and versions that are not asked
    for are left out. A run that was lost half way leaves the ledger as it was; one that appended
    twice changes nothing, since spans are made distinct.

    A null text is the empty content, and has no spans. Repeated rows stay, other columns pass
    through, columns called as the new ones are replaced. An empty table stays empty.
    """
    spark = versions.sparkSession
    scan_blobs(unseen(versions, read_ledger(spark, ledger), rules, text), rules).write.mode("append").parquet(ledger)
    return findings(versions, read_ledger(spark, ledger), rules, text=text)


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule], *, text: str = "text") -> DataFrame:
    """Join what the ledger has for ``rules`` to all rows of ``versions``."""
    out = [c for c in versions.columns if c.lower() not in ("blob", "spans")]
    kinds = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    # Spans of another version of a rule are not those of this one.
    current = F.array(*(F.lit(r.key) for r in rules))
    rows = ledger.withColumn("mine", F.array_intersect("scanned", current)).where(F.size("mine") > 0)
    mine = F.transform("mine", lambda k: F.substring_index(k, "@", 1))
    kept = F.filter("spans", lambda s: F.array_contains(mine, s["kind"]))
    ranked = F.transform(
        kept,
        lambda s: F.struct(s["start"].alias("start"), kinds[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    found = (
        rows.where(F.size("spans") > 0)
        .select("blob", F.explode(ranked).alias("span"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )
    named = versions.select(*map(column, out), blob_of(column(text)).alias("blob"))
    return named.join(found, "blob", "left").select(
        *map(column, out),
        "blob",
        F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans"),
    )


def redacted(text: Column, spans_: Column, mask: str = "*") -> Column:
    """``text`` with the characters of all spans masked; lengths and positions stay."""

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        end = F.greatest(span["end"], state["at"])
        clear = F.substring(text, (state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))
        return F.struct(
            end.alias("at"),
            F.concat(state["done"], clear, F.repeat(F.lit(mask), (end - start).cast("int"))).alias("done"),
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    masked = F.aggregate(
        spans_,
        first,
        step,
        lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans_) > 0, masked).otherwise(text)
