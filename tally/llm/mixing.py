"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output divided by its
share of the input, both in text volume (code points + 1 a document). Each
document's number of copies is a Poisson number with that mean: a uniform
number hashed from seed and doc_id is inverted through the cumulative
distribution. Every document is then repeated by its count (none, one or
more) and all copies are shuffled globally by a hash. A document with more
than ``BLOCKS`` copies (one of a tiny source) leaves its task as that many rows,
each shuffled like a copy and repeated where it arrives, so no task makes all
copies of a document.

Rates come from one count per source (combined before the shuffle) and are
written as a table: Spark broadcasts it only when its files are under the
broadcast threshold, and otherwise joins by sort and merge, where a source
with a third of all rows is split. A rate above ``PART_RATE`` is inverted as a
sum of equal Poisson parts, so tables stay short and exact.

Cases: a null source is a source of its own; sources with weight 0 (as is
``other`` unless given) get no copies; without weights all sources get the same
share; ``other`` is the weight of sources that ``weights`` does not name; null and empty texts count as volume 1; repeated rows get the same
count, each repeated; a null doc_id hashes like any value. Extra columns stay.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, fresh

SEED = 5
PART_RATE = 16.0   # largest mean that one inversion covers
BLOCKS = 1000      # rows that one document is before the shuffle
TERMS = 96         # terms of a part's cumulative distribution: beyond, 1 - cdf < 2**-53


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, growth: float = 1.0,
                 other: float = 0.0) -> DataFrame:
    """source, rate: mean copies of each document so that a source's share of
    the output volume is its share of ``weights``; the output volume is
    ``growth`` times the input's."""
    volume = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + F.lit(1)
    sizes = docs.groupBy("source").agg(F.sum(volume).alias("volume"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, weight double")
        weighted = (sizes.join(given, sizes["source"].cast("string").eqNullSafe(given["s"]), "left")
                    .select("source", "volume", F.coalesce("weight", F.lit(float(other))).alias("weight")))
    volume, weight = weighted.agg(F.sum("volume"), F.sum("weight")).first()
    return weighted.select(
        "source", F.when(F.col("weight") > 0, F.lit(float(growth)) * F.col("weight") / F.lit(weight or 0.0)
                         * F.lit(volume or 0) / F.col("volume")).otherwise(F.lit(0.0)).alias("rate"))


def _with_cdf(rates: DataFrame) -> DataFrame:
    """Adds the number of parts and one part's cumulative distribution."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART_RATE))).cast("int")
    term = "struct(cast(0 AS INT) AS k, exp(-mean) AS p, array(exp(-mean)) AS cdf)"
    step = ("struct(s.k + 1 AS k, s.p * mean / (s.k + 1) AS p, "
            "concat(s.cdf, array(element_at(s.cdf, -1) + s.p * mean / (s.k + 1))) AS cdf)")
    return (rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
            .withColumn("cdf", F.expr(f"aggregate(sequence(1, {TERMS}), {term}, (s, i) -> {step}, s -> s.cdf)"))
            .drop("mean"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, growth: float = 1.0,
                seed: int = SEED, keep_extra: bool = True, other: float = 0.0) -> DataFrame:
    """``docs`` replicated and shuffled; with ``keep_extra`` also the columns
    copy (from 0), copies and rate."""
    staging = Staging(docs.sparkSession, "mixing")
    rates = staging.write(_with_cdf(source_rates(docs, weights, growth, other)), "rates")
    copy, copies, rate = (fresh(docs, n) for n in ("copy", "copies", "rate"))
    source, parts, cdf, order, block = (fresh(docs, n) for n in ("source__", "parts__", "cdf__", "order__", "block__"))
    table = rates.select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("parts").alias(parts),
                         F.col("cdf").alias(cdf))
    joined = docs.join(table, docs["source"].eqNullSafe(table[source])).filter(F.col(rate) > 0)
    # The first 52 bits of an MD5 number each (document, part).
    uniform = (f"cast(conv(substr(md5(concat('{seed}:', coalesce(cast(doc_id AS STRING), ''), ':', part)), 1, 13), 16, 10) "
               f"AS DOUBLE) / {2.0 ** 52!r}D")
    count = (f"aggregate(transform(sequence(1, `{parts}`), part -> {uniform}), 0, "
             f"(n, u) -> n + size(filter(`{cdf}`, c -> c <= u)))")
    counted = joined.withColumn(copies, F.expr(count))
    blocks = counted.withColumn(block, F.explode(F.expr(
        f"if(`{copies}` > 0, sequence(0, least(`{copies}`, {BLOCKS}) - 1), array())"))).drop(source, parts, cdf)
    # A number of partitions is given, since by their bytes before the copies are made they would be merged.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.withColumn(order, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(block))).repartition(partitions, order)
    repeated = spread.withColumn(copy, F.explode(F.expr(f"sequence(`{block}`, `{copies}` - 1, {BLOCKS})")))
    shuffled = (repeated.withColumn(order, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(copy)))
                .sortWithinPartitions(order).drop(order, block))
    return shuffled.select(*docs.columns, copy, copies, rate) if keep_extra else shuffled.select(*docs.columns)
