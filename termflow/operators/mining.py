"""Mined sentences, notes and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.functions import naming as N
from termflow.functions import text as T


def record_mined(mined: DataFrame, new: DataFrame) -> DataFrame:
    """Mined sentences (note_id, sentence) with new ones; a note that is there stays as it is."""
    fresh = new.dropDuplicates(["note_id"]).join(mined.select("note_id"), "note_id", "left_anti")
    return mined.select("note_id", "sentence").unionByName(fresh.select("note_id", T.sentence_key(F.col("sentence")).alias("sentence")))


def prune_mined(mined: DataFrame, notes: DataFrame | None) -> DataFrame:
    """Mined sentences whose note still exists; all of them when the notes can't be had."""
    return mined if notes is None else mined.join(notes.select("note_id").distinct(), "note_id", "left_semi")


def mined_sentences(mined: DataFrame, harvested: DataFrame) -> DataFrame:
    """Distinct sentences of both."""
    return mined.select("sentence").union(harvested.select("sentence")).distinct()


def with_mined(terms: DataFrame, added: DataFrame) -> DataFrame:
    """`terms` with mined: lemma or surface is among the added terms."""
    words = added.select(F.col("term").alias("_t")).distinct()
    df = terms.join(words, F.col("lemma") == F.col("_t"), "left").withColumnRenamed("_t", "_l")
    df = df.join(words, F.col("surface") == F.col("_t"), "left")
    return df.withColumn("mined", F.col("_l").isNotNull() | F.col("_t").isNotNull()).drop("_l", "_t")


def harvest(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """note_id, term, reading, sentence of notes (note_id, model, fields map) under field mappings (model, term_field, reading_field, sentence_field).

    A blank reading of a kana term is the term; a reading keeps only its kana, long vowels folded.
    """
    m = mapping.withColumnRenamed("model", "_model")
    get = lambda f: F.element_at("fields", F.col(f))
    df = notes.join(m, F.col("model") == F.col("_model"))
    term, raw = T.trim(get("term_field")), T.trim(F.coalesce(get("reading_field"), F.lit("")))
    reading = F.when((raw == "") & T.is_kana(term), term).otherwise(T.fold_long_vowels(T.keep_kana(raw)))
    return df.select("note_id", term.alias("term"), reading.alias("reading"), T.sentence_key(get("sentence_field")).alias("sentence")).filter("term <> ''")


def with_intervals(vocab: DataFrame, cards: DataFrame) -> DataFrame:
    """`vocab` (card_id, ...) with interval in days: cards' (card_id, interval) are days, negative ones seconds."""
    days = F.when(F.col("interval") < 0, -F.col("interval") / 86400.0).otherwise(F.col("interval").cast("double"))
    return vocab.drop("interval").join(cards.select("card_id", days.alias("interval")).dropDuplicates(["card_id"]), "card_id", "left")


def conflict_groups(items: DataFrame, key: Column | None = None) -> DataFrame:
    """key, n, first_item, last_item: sentence keys that two or more batch items (item_id, sentence) share; a blank key is no conflict. The members are `conflict_items`: no list of them is gathered."""
    k = T.sentence_key(F.col("sentence")) if key is None else key
    return items.select(k.alias("key"), "item_id").filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item")).filter("n >= 2")


def conflict_items(items: DataFrame, key: Column | None = None) -> DataFrame:
    """key, item_id: one row for each batch item whose sentence key another one shares."""
    k = T.sentence_key(F.col("sentence")) if key is None else key
    return items.select(k.alias("key"), "item_id").join(conflict_groups(items, key).select("key"), "key", "left_semi")


def keepers(items: DataFrame) -> DataFrame:
    """item_id that keeps each shared sentence: an explicit pick, else the earliest timestamp (missing last)."""
    order = F.struct((~F.coalesce("picked", F.lit(False))).alias("a"), F.col("ts").isNull().alias("b"), "ts", "item_id")
    return items.select(T.sentence_key(F.col("sentence")).alias("key"), "item_id", order.alias("o")).filter("key <> ''").groupBy("key").agg(F.min_by("item_id", "o").alias("item_id"))


def batch_result(results: DataFrame) -> DataFrame:
    """One row of counters over results (status)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return results.agg(n("created"), n("duplicate"), n("media_missing"), n("failed"))


def assemble(notes: DataFrame, formats: DataFrame) -> DataFrame:
    """model, fields of cards to create: each format's templates (map) filled from a note's values (map); blank fields are dropped."""
    both = notes.join(formats.select(F.col("model").alias("_m"), "deck", "templates"), F.col("model") == F.col("_m"))
    filled = F.transform_values("templates", lambda _, t: N.fill(t, F.col("values")))
    return both.select("note_id", "model", "deck", F.map_filter(filled, lambda _, v: T.trim(v) != "").alias("fields"))


# What a field's name says that it is no sentence itself, and words for a sentence's surroundings.
NOT_A_SENTENCE = ["audio", "furigana", "meaning", "reading", "translation", "english", "picture", "image", "screenshot", "hint", "card", "kana", "notes"]
SURROUNDINGS = ["context", "例文"]
LEAST_SENTENCE, LONG_SENTENCE = 8, 14


def first_field(names: Column, fits: Callable[[Column], Column]) -> Column:
    """The first of the names for which a condition holds; null without one."""
    return F.get(F.filter(names, fits), F.lit(0))


def guess_sentence_field(names: Column, sample: Column) -> Column:
    """The field that holds a note's sentence, from the fields' names (array) and a sample note (map): by an exact name, then the shortest name with "sentence" that isn't about something else, then surroundings, then content that reads like a Japanese sentence."""
    plain = lambda n: F.regexp_replace(F.lower(n), "[ _-]", "")
    about = lambda n: F.exists(F.array(*map(F.lit, NOT_A_SENTENCE)), lambda x: F.contains(plain(n), x))
    named = F.filter(names, lambda n: F.contains(plain(n), F.lit("sentence")) & ~about(n))
    shortest = F.array_min(F.transform(named, lambda n, i: F.struct(F.length(n).alias("size"), i.alias("at"), n.alias("name"))))["name"]
    around = first_field(names, lambda n: F.exists(F.array(*map(F.lit, SURROUNDINGS)), lambda x: F.contains(plain(n), x)) & ~about(n))
    return F.coalesce(first_field(names, lambda n: plain(n) == "sentence"), shortest, around, first_field(names, lambda n: F.coalesce(reads_like_sentence(F.element_at(sample, n)), F.lit(False))))


def reads_like_sentence(value: Column) -> Column:
    """Eight characters or more with a Japanese one, and a sentence end or fourteen."""
    bare = T.trim(F.regexp_replace(F.regexp_replace(value, "<[^>]*(?:>|$)", ""), "&nbsp;", " "))
    return (F.length(bare) >= LEAST_SENTENCE) & bare.rlike(T.JAPANESE) & (bare.rlike("[。！？]") | (F.length(bare) >= LONG_SENTENCE))


def guess_term_fields(names: Column, sample: Column) -> Column:
    """struct(term, reading): the first Japanese field with a kanji (else the first Japanese one), and the first kana field after it (else the first one)."""
    value = lambda n: F.coalesce(T.trim(F.element_at(sample, n)), F.lit(""))
    japanese = lambda n: value(n).rlike(f"(?U)^(?:{T.JAPANESE}|\\s)+$")
    term = F.coalesce(first_field(names, lambda n: japanese(n) & T.has_kanji(value(n))), first_field(names, japanese))
    kana = F.filter(names, lambda n: value(n).rlike(r"(?U)^[ぁ-ゖゝゞァ-ヺー・ヽヾ\s]+$"))
    after = first_field(kana, lambda n: F.array_position(names, n) > F.coalesce(F.array_position(names, term), F.lit(0)))
    return F.struct(term.alias("term"), F.coalesce(after, F.get(kana, F.lit(0))).alias("reading"))


def recently_added(notes: DataFrame, mapping: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """note_id, term, sentence of notes (note_id, model, fields, added) that were added within the last days; a blank term or sentence is null, notes with neither are left out."""
    m = mapping.withColumnRenamed("model", "_model")
    get = lambda f: F.element_at("fields", F.col(f))
    recent = notes.filter(F.col("added") >= now - F.expr(f"INTERVAL {days} DAYS")).join(m, F.col("model") == F.col("_model"))
    bare = T.trim(F.regexp_replace(F.regexp_replace(get("term_field"), "<[^>]*(?:>|$)", ""), "&nbsp;", " "))
    some = lambda c: F.when(c != "", c)
    return recent.select("note_id", some(bare).alias("term"), some(T.sentence_key(get("sentence_field"))).alias("sentence")).filter("term IS NOT NULL OR sentence IS NOT NULL")


def existing(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries (path, ...) whose file is in a listing."""
    return entries.join(listing.select("path").distinct(), "path", "left_semi")
