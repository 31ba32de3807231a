"""Frequency dictionaries: lookups, means and weights.

The long table `freq` has (dict, term, reading, value, kana_marker, entry_ord): reading null is a simple
entry, kana_marker says the entry ranks the kana spelling, entry_ord is the order inside the dictionary.
`dict_state` has (dict, weight, enabled). Words come as (word_id, word, reading, is_kana).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.functions import text as T

#: A map's value for "no data"; the harmonic column has null instead.
NO_DATA = 4294967295
#: Least weight that counts.
LEAST_WEIGHT = 0.1


def ordered_sum(value: Column) -> Column:
    """Aggregate: sum of positive doubles, null without any. They are added in ascending order, as a mean of exactly
    a half would else be rounded by the order in which the rows come. A group's values are held at a time."""
    return F.nullif(F.aggregate(F.array_sort(F.collect_list(value)), F.lit(0.0), lambda total, x: total + x), F.lit(0.0))


def harmonic(value: Column) -> Column:
    """Aggregate: rounded harmonic mean of the positive values, null without any."""
    good = F.when(value > 0, value)
    return F.round(F.count(good) / ordered_sum(F.lit(1.0) / good)).cast("long")


def weighted_harmonic(value: Column, weight: Column) -> Column:
    """Aggregate: rounded weighted harmonic mean over positive values and weights, NO_DATA without any."""
    good = (value > 0) & (weight > 0)
    w = F.when(good, weight.cast("double"))
    return F.coalesce(F.round(ordered_sum(w) / ordered_sum(w / F.when(good, value))).cast("long"), F.lit(NO_DATA))


def enabled(freq: DataFrame, dict_state: DataFrame) -> DataFrame:
    """Entries of enabled dictionaries with a weight, which is LEAST_WEIGHT at least; an unlisted dictionary counts as enabled with weight 1."""
    state = dict_state.select(F.col("dict").alias("_dict"), "weight", "enabled")
    df = freq.join(state, F.col("dict") == F.col("_dict"), "left").drop("_dict")
    df = df.filter(F.coalesce("enabled", F.lit(True)) & (F.coalesce("weight", F.lit(1.0)) > 0))
    return df.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(LEAST_WEIGHT))).drop("enabled")


def apply_weights(dict_state: DataFrame, settings: DataFrame) -> DataFrame:
    """dict_state under new settings (dict, weight, enabled); what isn't set stays."""
    new = settings.select(F.col("dict").alias("_dict"), F.col("weight").alias("_w"), F.col("enabled").alias("_e"))
    df = dict_state.join(new, F.col("dict") == F.col("_dict"), "left")
    return df.select("dict", F.greatest(F.coalesce("_w", "weight"), F.lit(LEAST_WEIGHT)).alias("weight"), F.coalesce("_e", "enabled").alias("enabled"))


def lookup(words: DataFrame, freq: DataFrame) -> DataFrame:
    """word_id, dict, value: each dictionary's entry for a word, by priority.

    A kana word takes the first marked entry of its reading; else, like any other word, the least value
    among unmarked entries of its reading, else the first simple entry. A kana word prefers the simple
    entry to unmarked ones. One aggregate per (word, dictionary), so no window sorts the entries.
    """
    df = words.join(freq.withColumnRenamed("reading", "_entry_reading"), F.col("word") == F.col("term"))
    same = F.col("_entry_reading") == F.col("reading")
    simple = F.col("_entry_reading").isNull()
    marked, plain = same & F.col("kana_marker") & F.col("is_kana"), same & ~F.col("kana_marker")
    rank = F.when(marked, 0).when(simple, F.when(F.col("is_kana"), 1).otherwise(3)).when(plain, 2)
    within = F.when(plain & ~marked, F.col("value")).otherwise(F.col("entry_ord"))
    df = df.withColumns({"_rank": rank, "_within": within}).filter("_rank IS NOT NULL")
    return df.groupBy("word_id", "dict").agg(F.min_by("value", F.struct("_rank", "_within", "entry_ord")).alias("value"))


def lookup_folded(words: DataFrame, freq: DataFrame) -> DataFrame:
    """`lookup`; words that no dictionary has are looked up again with katakana folded."""
    found = lookup(words, freq)
    missing = words.join(found.select("word_id").distinct(), "word_id", "left_anti")
    folded = missing.withColumn("_folded", T.fold_katakana(F.col("word"))).filter("_folded <> word").withColumn("word", F.col("_folded")).drop("_folded")
    return found.unionByName(lookup(folded, freq))


def frequency_maps(words: DataFrame, freq: DataFrame, dict_state: DataFrame) -> DataFrame:
    """word_id, frequencies (dict -> value over all loaded dictionaries), harmonic (weighted, over the enabled ones; null without data)."""
    found = lookup_folded(words, freq)
    maps = found.groupBy("word_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dict", "value")))).alias("frequencies"))
    state = enabled(found.withColumnRenamed("word_id", "_word"), dict_state)
    means = state.groupBy(F.col("_word").alias("word_id")).agg(weighted_harmonic(F.col("value"), F.col("weight")).alias("harmonic"))
    out = words.select("word_id").join(maps, "word_id", "left").join(means, "word_id", "left")
    return out.withColumn("harmonic", F.nullif("harmonic", F.lit(NO_DATA)))


def exact_pair(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pair_id, frequency of (pair_id, word, reading) over the enabled entries; rows without a frequency are left out.

    Per dictionary the least value of the entries of that reading; their harmonic mean. If there is none:
    nothing if any dictionary has another reading, else the harmonic mean of the first simple entries.
    A kana word sees only marked readings, any other word only unmarked ones.
    """
    df = pairs.join(entries.withColumnRenamed("reading", "_reading"), F.col("word") == F.col("term"))
    seen = F.col("_reading").isNotNull() & (F.col("kana_marker") == T.is_kana(F.col("word")))
    same = F.col("_reading") == F.col("reading")
    per_dict = df.groupBy("pair_id", "dict").agg(
        F.min(F.when(seen & same, F.col("value"))).alias("exact"),
        F.coalesce(F.bool_or(seen & ~same), F.lit(False)).alias("other"),
        F.min_by("value", F.when(F.col("_reading").isNull(), F.col("entry_ord"))).alias("simple"),
    )
    out = per_dict.groupBy("pair_id").agg(harmonic(F.col("exact")).alias("e"), F.count("exact").alias("n"), F.bool_or("other").alias("other"), harmonic(F.col("simple")).alias("s"))
    return out.select("pair_id", F.when(F.col("n") > 0, F.col("e")).when(~F.col("other"), F.col("s")).alias("frequency")).filter("frequency IS NOT NULL")


def pair_frequency(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """`exact_pair`; a pair without a frequency is tried again with its word's katakana folded."""
    found = exact_pair(pairs, entries)
    rest = pairs.join(found.select("pair_id"), "pair_id", "left_anti")
    folded = rest.withColumn("_f", T.fold_katakana(F.col("word"))).filter("_f <> word").select("pair_id", F.col("_f").alias("word"), "reading")
    return found.unionByName(exact_pair(folded, entries))


def choose_lemma(candidates: DataFrame, entries: DataFrame, prefer: bool = True) -> DataFrame:
    """word_id, lemma, lemma_reading: the best deinflection candidate of each word.

    `candidates` has (word_id, cand_ord, form, reading, surface, pos, own): own marks the analyser's lemma.
    Candidates without a frequency drop out; of a verb only those that end like one (or are the surface)
    stay, if any does; the analyser's lemma wins if it is left (`prefer`), else the least frequency, then order.
    """
    c = candidates.withColumn("pair_id", F.concat_ws("\x1f", "form", "reading"))
    pairs = c.select("pair_id", F.col("form").alias("word"), "reading").distinct()
    c = c.join(pair_frequency(pairs, entries), "pair_id")
    ending = F.col("form").rlike("[うくぐすつぬぶむる]$") | F.col("form").endswith("ない") | (F.col("form") == F.col("surface"))
    verbish = F.when(F.col("pos") == "Verb", ending).otherwise(True)
    order = F.struct((~verbish).alias("a"), (~(F.col("own") & F.lit(prefer))).alias("b"), F.col("frequency").alias("c"), F.col("cand_ord").alias("d"))
    return c.groupBy("word_id").agg(F.min_by(F.struct("form", "reading"), order).alias("x")).select("word_id", F.col("x.form").alias("lemma"), F.col("x.reading").alias("lemma_reading"))
