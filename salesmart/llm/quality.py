"""Quality rules whose thresholds follow the documents of the same language and source.

Each document gets a few ratios, in whole thousandths. A sketch of a group of documents is the number
of documents for each ratio value: sketches of two groups merge by adding, whatever the order, their
size is bounded by the 1,001 to 4,001 values, and their quantiles are exact at that resolution. The
sketch of a language is the merged one of its sources.

The limit of a group starts at its median and walks up its quantiles, as long as the next one is no farther away than the
spread so far suggests. So it ends at the tail of the bulk, below a cluster of junk that lies apart from it, however
many quantiles that fills. The limit is drawn towards that of the language, and this towards that of
all documents, the more the fewer documents a group has; and a source cannot allow itself much more than its language.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.batches import with_columns
from salesmart.llm.steps import column, settled, small

#: Fixed value: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Ratio:
    """``over`` and ``under`` are measures; the ratio is 1000 * over / under, at most ``most``.

    Values above the limit (with ``low``, below) fail. A next quantile may lie ``step`` beyond the former in any case, and the
    limit lies that much beyond the tail's reach. Of what is counted, ``spare`` is allowed beyond the limit, so that a short
    document does not fail for one or two.
    """

    name: str
    over: str
    under: str
    most: int
    step: int
    spare: int
    low: bool = False

    @property
    def sign(self) -> int:
        return -1 if self.low else 1


RATIOS = (
    Ratio("symbols", "n_symbols", "n_words", 4000, 50, 10),
    Ratio("dup_lines", "n_dup_lines", "n_lines", 1000, 100, 3),
    Ratio("repeats", "n_repeat_words", "n_words", 1000, 50, 30),
    Ratio("upper", "n_upper", "n_letters", 1000, 50, 20),
    Ratio("long_words", "word_chars", "n_words", 40000, 1000, 60),
    Ratio("short_words", "word_chars", "n_words", 40000, 1000, 60, low=True),
)
#: Quantiles in percent, from the median on.
WALK = (50, 67, 80, 90, 95, 98)
#: How far the tail and the limit may go, in spreads of the bulk.
REACH = 2
#: Documents that the limit of the larger group counts for in that of a smaller one.
PRIOR = 50
#: Added before a division, so that it is one of positive numbers.
_SHIFT = 1_000_000


def measure(text: str | None) -> tuple[int, ...]:
    """Values of MEASURES for a whole text; null and empty texts have 0 in all."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [x for x in text.split("\n") if x.strip(_WHITE.decode())]
    return (
        n,
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        sum(map(str.isupper, text)),
        sum(map(str.isalpha, text)),
    )


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, until = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            total += at + 3 - max(until, at)
            until = at + 3
    return total


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a long column for each of MEASURES; columns called so are replaced."""

    def setup():
        def compute(texts: pa.Array) -> list[pa.Array]:
            found = [measure(t) for t in texts.to_pylist()]
            return [pa.array(list(column), pa.int64()) for column in zip(*found, strict=True)]

        return compute

    added = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return with_columns(docs, text, added, setup)


def ratio_value(ratio: Ratio) -> Column:
    """Whole thousandths, negative for a lower limit; null for a document without what the ratio is taken of."""
    under = F.col(ratio.under)
    scaled = (F.col(ratio.over) * 1000 / under).cast("long") if ratio.most <= 4000 else _tenths(ratio)
    return F.when(under > 0, F.least(scaled, F.lit(ratio.most)) * ratio.sign)


def _tenths(ratio: Ratio) -> Column:
    """Lengths of words, in steps of a tenth of a character."""
    return (F.col(ratio.over) * 10 / F.col(ratio.under)).cast("long") * 100


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Documents for each (language, source, ratio, value): counted in the map tasks first.

    Documents that already fail the fixed rule are left out, so that a source full of junk does not
    make junk its norm.
    """
    values = F.array(*(F.struct(F.lit(r.name).alias("ratio"), ratio_value(r).alias("value")) for r in RATIOS))
    return (
        measured.where(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(values).alias("v"))
        .select("lang", "source", "v.ratio", "v.value")
        .where(F.col("value").isNotNull())
        .groupBy("lang", "source", "ratio", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))


def _of_ratio(value) -> Column:
    """What a ratio has, by the column ``ratio``."""
    return F.create_map(*(F.lit(x) for r in RATIOS for x in (r.name, value(r))))[F.col("ratio")]


def limits(sketch: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, ratio, n, own)``: documents and the limit of each group by its own sketch.

    A quantile is the least value that at least that share of the documents does not exceed. A group
    is at most 4,001 rows here, whatever its number of documents.
    """
    group = Window.partitionBy(*keys, "ratio")
    running = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(group))
    quantiles = [
        F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("value"))).alias(f"q{p}") for p in WALK
    ]
    found = ranked.groupBy(*keys, "ratio").agg(F.max("all").alias("n"), *quantiles)
    first, step = F.col(f"q{WALK[0]}"), _of_ratio(lambda r: r.step)
    found = found.withColumn("tail", first)
    for p in WALK[1:]:
        tail, following = F.col("tail"), F.col(f"q{p}")
        near = following - tail <= step + REACH * (tail - first)
        found = found.withColumn("tail", F.when(near, following).otherwise(tail))
    return found.select(*keys, "ratio", "n", (F.col("tail") + REACH * (F.col("tail") - first) + step).alias("own"))


def _drawn(n: Column, own: Column, larger: Column) -> Column:
    """The limit of a group of ``n`` documents, drawn towards that of the larger group."""
    total = n * (own + _SHIFT) + PRIOR * (larger + _SHIFT)
    return F.call_function("div", total, n + PRIOR) - _SHIFT


def _by_group(drawn: DataFrame, *keys: str) -> DataFrame:
    """One row for each group, with a map from the ratio to its limit."""
    entry = F.struct("ratio", "most")
    return drawn.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("fence"))


def judge(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """``docs`` with MEASURES, ``base_failed``, ``failed`` (names of the ratios out of range), ``kept``.

    A document is kept if it passes the fixed rule (50 words or more, at most half of them in repeated
    windows of three words) and no ratio is out of range. Null languages and sources are groups of
    their own; a group without documents that pass the fixed rule has the limits of its language, or those of all documents.
    Null and empty texts fail the fixed rule. Repeated rows count each. Other columns pass
    through; columns called as the new ones are replaced. An empty table stays empty.

    The sketches of all groups are small against the documents, but grow with the number of sources,
    so they are broadcast only after counting; beyond that the planner joins them, and adaptive
    execution splits a hot source. A hot source is counted in the map tasks.
    """
    measured = measures(docs, text)
    sketch = settled(sketches(measured, lang, source), "sketch")
    # A row for each ratio, so at most len(RATIOS) on the driver.
    overall = {r["ratio"]: r["own"] for r in limits(merged(sketch)).collect()}
    every = F.lit(None).cast("long")
    for ratio, most in overall.items():
        every = F.when(F.col("ratio") == ratio, F.lit(most).cast("long")).otherwise(every)
    spoken = limits(merged(sketch, "lang"), "lang").select("lang", "ratio", _drawn(F.col("n"), F.col("own"), every).alias("most"))
    near = F.col("most") + _of_ratio(lambda r: r.step) + F.call_function("div", F.abs("most"), F.lit(2).cast("long"))
    spoken = settled(spoken.withColumn("near", near), "languages")
    drawn = _drawn(F.col("s.n"), F.col("s.own"), F.col("l.most"))
    own = (
        limits(sketch, "lang", "source").alias("s")
        .join(spoken.alias("l"), F.expr("s.lang <=> l.lang AND s.ratio = l.ratio"))
        .select("s.lang", "s.source", "s.ratio", drawn.alias("drawn"), "l.near")
        .select("lang", "source", "ratio", F.least("drawn", "near").alias("most"))
    )
    by_source = settled(_by_group(own, "lang", "source"), "sources").select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("fence").alias("__own")
    )
    by_lang = _by_group(spoken, "lang").select(F.col("lang").alias("__spoken"), F.col("fence").alias("__of_lang"))

    def limit_of(ratio: str) -> Column:
        return F.coalesce(F.col("__own")[ratio], F.col("__of_lang")[ratio], F.lit(overall.get(ratio)).cast("long"))

    out = [c for c in measured.columns if c not in ("base_failed", "failed", "kept")]
    joined = measured.join(
        small(by_source),
        column(lang).eqNullSafe(F.col("__lang")) & column(source).eqNullSafe(F.col("__source")),
        "left",
    ).join(small(by_lang), column(lang).eqNullSafe(F.col("__spoken")), "left")
    outside = [
        F.when(
            (F.col(r.under) > 0)
            & (F.col(r.over) * 1000 * r.sign > limit_of(r.name) * F.col(r.under) + 1000 * r.spare),
            F.lit(r.name),
        )
        for r in RATIOS
    ]
    return joined.select(
        *(F.col("`" + c.replace("`", "``") + "`") for c in out),
        base_failed().alias("base_failed"),
        F.array_compact(F.array(*outside)).alias("failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
