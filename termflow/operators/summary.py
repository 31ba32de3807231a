"""Knowledge summary: bands of levels and of frequency ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.operators import vocabulary as V
from termflow.operators.frequency import pair_frequency

#: Least and greatest rank of each band, and its label.
BANDS = [(1, 1_500, "<1.5k"), (1_501, 3_000, "<3k"), (3_001, 5_000, "<5k"), (5_001, 10_000, "<10k"), (10_001, 20_000, "<20k")]


def band_of(rank: Column) -> Column:
    """Label of a rank's band; null beyond the last."""
    out = F.lit(None).cast("string")
    for low, high, label in BANDS:
        out = F.when(rank.between(low, high), label).otherwise(out)
    return out


def level_summary(jlpt: DataFrame, vocab: DataFrame, confidences: DataFrame | None = None, known: int = V.KNOWN_INTERVAL) -> DataFrame:
    """band, coverage, comprehension, total of each level; an entry that isn't known counts 0."""
    term = F.when(F.coalesce("kanji", F.lit("")) == "", F.col("kana")).otherwise(F.col("kanji"))
    forms = jlpt.select("level", F.monotonically_increasing_id().alias("form_id"), term.alias("word"), F.col("kana").alias("reading"), "pos")
    found = V.best_match(forms, vocab, confidences).filter(F.col("score") >= V.KNOWN).select("form_id", V.comprehension(F.coalesce("interval", F.lit(1.0)), known).alias("c"))
    df = forms.join(found, "form_id", "left")
    return df.groupBy(F.col("level").alias("band")).agg(F.avg(F.col("c").isNotNull().cast("double")).alias("coverage"), F.avg(F.coalesce("c", F.lit(0.0))).alias("comprehension"), F.count("*").alias("total"))


def rank_bands(ranks: DataFrame, max_rank: Column | int, known: int = V.KNOWN_INTERVAL) -> DataFrame:
    """band, coverage, comprehension, total from known words (rank, interval): sums over a band's width, which ends at the largest dictionary's size; bands beyond it are dropped.

    A word without an interval adds nothing to comprehension here.
    """
    spark = ranks.sparkSession
    dim = spark.createDataFrame(BANDS, "low long, high long, band string").withColumn("high", F.least("high", F.lit(max_rank)))
    dim = dim.filter("high >= low").withColumn("total", F.col("high") - F.col("low") + 1)
    sums = ranks.groupBy(band_of(F.col("rank")).alias("_band")).agg(F.count("*").alias("n"), F.sum(V.comprehension(F.col("interval"), known)).alias("c"))
    df = dim.join(sums, F.col("band") == F.col("_band"), "left")
    share = lambda x: F.least(F.coalesce(F.col(x) / F.col("total"), F.lit(0.0)), F.lit(1.0))
    return df.select("band", share("n").alias("coverage"), share("c").alias("comprehension"), "total")


def frequency_summary(vocab: DataFrame, entries: DataFrame, known: int = V.KNOWN_INTERVAL) -> DataFrame:
    """`rank_bands` of a vocabulary (term, reading, interval) under the enabled entries."""
    v = vocab.withColumn("pair_id", F.monotonically_increasing_id())
    ranks = v.join(pair_frequency(v.select("pair_id", F.col("term").alias("word"), "reading"), entries), "pair_id").select(F.col("frequency").alias("rank"), "interval")
    sizes = entries.groupBy("dict").agg(F.countDistinct("term").alias("n")).agg(F.max("n")).first()[0]
    return rank_bands(ranks, sizes or 0, known)
