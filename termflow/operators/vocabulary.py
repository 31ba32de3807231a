"""Known words: levels, ignore lists, fuzzy matching with a vocabulary, and comprehension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.functions import text as T

# Fixed values.
CONTENT_POS = ["Noun", "ProperNoun", "CompoundNoun", "Verb", "SuruVerb", "Adjective", "AdjectivalNoun", "Adverb"]
EXACT, HIGH, MEDIUM, LOW, UNGRADED, KNOWN = 1.0, 0.85, 0.70, 0.55, 0.9, 0.60
LEVELS = ["N5", "N4", "N3", "N2", "N1"]
KNOWN_INTERVAL = 30


def comprehension(days: Column, known: int | Column = KNOWN_INTERVAL) -> Column:
    """0 for null, else ln(days + 1) over ln(known + 1), 1 at most."""
    known = F.lit(known) if isinstance(known, int) else known
    d = days.cast("double")
    return F.when(d.isNull(), 0.0).when((d + 1) / (known + 1) >= 1, 1.0).otherwise(F.ln(d + 1) / F.ln(known + F.lit(1.0)))


def knowledge(share: Column) -> Column:
    """0 unknown, 1 new, 2 young, 3 mature, from a term's comprehension (null: unknown)."""
    return F.when(share.isNull(), 0).when(share < 0.34, 1).when(share < 1, 2).otherwise(3)


def split_ignored(terms: DataFrame, ignore: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`terms` with status: ignored (lemma in the enabled ignore terms), known (lemma in `known`) or unknown. Both lists are deduplicated, so no row multiplies."""
    listed = ignore.filter(F.coalesce("enabled", F.lit(True))).select(F.col("term").alias("_ignored")).distinct()
    df = terms.join(listed, F.col("lemma") == F.col("_ignored"), "left")
    status = F.when(F.col("_ignored").isNotNull(), "ignored")
    if known is not None:
        df = df.join(known.select(F.col("lemma").alias("_known")).distinct(), F.col("lemma") == F.col("_known"), "left")
        status = status.when(F.col("_known").isNotNull(), "known")
    return df.withColumn("status", status.otherwise("unknown")).drop("_ignored", "_known")


def level_table(jlpt: DataFrame) -> DataFrame:
    """(form, kana, level_ord): every entry under its kanji and its kana; of duplicates the easier level."""
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int") - 1
    rows = jlpt.select("kanji", T.comparison_key(F.col("kana")).alias("kana"), F.col("kana").alias("own"), order.alias("level_ord")).filter("level_ord >= 0")
    rows = rows.select(F.col("own").alias("form"), "kana", "level_ord").unionByName(rows.filter("kanji IS NOT NULL AND kanji <> ''").select(F.col("kanji").alias("form"), "kana", "level_ord"))
    return rows.groupBy("form", "kana").agg(F.min("level_ord").alias("level_ord"))


def with_level(terms: DataFrame, jlpt: DataFrame) -> DataFrame:
    """`terms` (lemma, lemma_reading) with level (null if not listed)."""
    t = level_table(jlpt).withColumnsRenamed({"form": "_form", "kana": "_kana"})
    df = terms.join(t, (F.col("lemma") == F.col("_form")) & (T.comparison_key(F.col("lemma_reading")) == F.col("_kana")), "left")
    return df.withColumn("level", F.get(F.array(*map(F.lit, LEVELS)), F.col("level_ord"))).drop("_form", "_kana", "level_ord")


def okurigana_variants(a: Column, b: Column) -> Column:
    """Whether two non-kana words differ only where one side has kanji and the other kana."""
    letters = lambda x: F.split(x, "(?<!^)(?!$)")
    common = lambda x, y, most: F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= most) & (F.get(x, i - 1) == F.get(y, i - 1)), i).otherwise(n))
    x, y = letters(a), letters(b)
    head = common(x, y, F.least(F.size(x), F.size(y)))
    tail = common(F.reverse(x), F.reverse(y), F.least(F.size(x), F.size(y)) - head)
    middle = lambda t: F.substring(t, head + 1, F.length(t) - head - tail)
    pair = lambda p, q: T.has_kanji(p) & (q != "") & T.is_kana(q)
    m, n = middle(a), middle(b)
    return ~T.is_kana(a) & ~T.is_kana(b) & (pair(m, n) | pair(n, m))


def pair_confidence(entries: DataFrame) -> DataFrame:
    """word, readings (map reading -> confidence): how likely a reading is for a word, from mean ranks over all dictionaries, scaled between 0.9 and 0.1."""
    mean = entries.filter("reading IS NOT NULL").filter(F.col("kana_marker") == T.is_kana(F.col("term"))).groupBy("term", "reading").agg(F.avg("value").alias("v"))
    span = mean.groupBy("term").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.collect_list(F.struct("reading", "v")).alias("rows"))
    grade = lambda r: F.when(F.col("hi") > F.col("lo"), 1 - (0.1 + 0.8 * (r["v"] - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0.9)
    return span.select(F.col("term").alias("word"), F.map_from_entries(F.transform("rows", lambda r: F.struct(r["reading"].alias("k"), grade(r).alias("v")))).alias("readings"))


def inclusivity(word: Column, reading: Column, card: Column, card_reading: Column, pos: Column, readings: Column | None = None) -> Column:
    """Score of a word against a known card, 0 to 1, the first rule that applies.

    `readings` maps the kanji side's readings to confidences, null without data.
    """
    same_reading = T.comparison_key(reading) == T.comparison_key(card_reading)
    same_word = word == card
    kana, card_kana = T.is_kana(word), T.is_kana(card)
    pair = same_reading & (kana != card_kana)
    graded = F.lit(UNGRADED) if readings is None else F.when(readings.isNull() | (F.size(readings) == 0), UNGRADED).otherwise(F.coalesce(F.element_at(readings, T.comparison_key(reading)), F.lit(0.0)))
    return (
        F.when((same_word | (kana & card_kana)) & same_reading, EXACT)
        .when(~pos.isin(CONTENT_POS), 0.0)
        .when(same_word, HIGH)
        .when(pair & (graded > 0), HIGH * graded)
        .when((T.comparison_key(word) == T.comparison_key(card)) & same_reading, MEDIUM)
        .when(same_reading & okurigana_variants(word, card), HIGH)
        .when(~kana & ~card_kana & same_reading, LOW)
        .otherwise(0.0)
    )


def _keys(word: str, reading: str) -> Column:
    """The four keys of a word, numbered in the order they are tried."""
    return F.posexplode(F.array(F.col(reading), F.col(word), T.comparison_key(F.col(reading)), T.comparison_key(F.col(word)))).alias("key_rank", "key")


def best_match(forms: DataFrame, vocab: DataFrame, confidences: DataFrame | None = None) -> DataFrame:
    """form_id, score, vocab_idx, interval: each form's best card among those that share a key.

    `forms` has (form_id, word, reading, pos), `vocab` (vocab_idx, term, reading, interval). A score depends
    on word, reading, part of speech and the card's spelling alone, so distinct forms meet distinct cards (each
    its first entry) and the result is joined back; candidates are reduced to their earliest key before they
    are scored. Ties go to key order, then vocabulary order. Forms without a positive score are left out.
    """
    asked = forms.select("word", "reading", "pos").distinct()
    left = asked.select("word", "reading", "pos", _keys("word", "reading"))
    cards = vocab.groupBy(F.col("term").alias("card"), F.col("reading").alias("card_reading")).agg(F.min("vocab_idx").alias("vocab_idx"), F.min_by("interval", "vocab_idx").alias("interval"))
    right = cards.select("card", "card_reading", "vocab_idx", "interval", F.explode(F.array_distinct(F.array("card_reading", "card", T.comparison_key(F.col("card_reading")), T.comparison_key(F.col("card"))))).alias("key"))
    both = left.join(right, "key").groupBy("word", "reading", "pos", "vocab_idx", "card", "card_reading", "interval").agg(F.min("key_rank").alias("key_rank"))
    readings = None
    if confidences is not None:
        both = both.withColumn("_kanji", F.when(T.is_kana(F.col("word")), F.col("card")).otherwise(F.col("word")))
        both = both.join(confidences.select(F.col("word").alias("_kanji"), "readings"), "_kanji", "left")
        readings = F.col("readings")
    score = inclusivity(F.col("word"), F.col("reading"), F.col("card"), F.col("card_reading"), F.col("pos"), readings)
    both = both.withColumn("score", score).filter("score > 0")
    best = F.min_by(F.struct("score", "vocab_idx", "interval"), F.struct(-F.col("score"), "key_rank", "vocab_idx")).alias("b")
    found = both.groupBy(F.col("word").alias("_w"), F.col("reading").alias("_r"), F.col("pos").alias("_p")).agg(best)
    same = F.col("word").eqNullSafe(F.col("_w")) & F.col("reading").eqNullSafe(F.col("_r")) & F.col("pos").eqNullSafe(F.col("_p"))
    return forms.select("form_id", "word", "reading", "pos").join(found, same).select("form_id", "b.score", "b.vocab_idx", "b.interval")


def match_terms(terms: DataFrame, vocab: DataFrame, confidences: DataFrame | None = None, known: int = KNOWN_INTERVAL) -> DataFrame:
    """`terms` (term_id, surface, surface_reading, lemma, lemma_reading, pos) with score, comprehension and known.

    Surface and lemma are matched in one join; the surface counts if it scores strictly higher. An
    unmatched form, or a card without an interval, counts as an interval of one day.
    """
    form = lambda k, w, r: F.struct(F.lit(k).alias("kind"), F.col(w).alias("word"), F.col(r).alias("reading"))
    forms = terms.select("term_id", "pos", F.explode(F.array(form(0, "lemma", "lemma_reading"), form(1, "surface", "surface_reading"))).alias("f"))
    forms = forms.select("term_id", F.struct("term_id", "f.kind").alias("form_id"), "f.word", "f.reading", "pos")
    found = best_match(forms, vocab, confidences)
    one = found.select(F.col("form_id.term_id").alias("_id"), F.struct("score", (-F.col("form_id.kind")).alias("lemma_first"), F.coalesce("interval", F.lit(1.0)).alias("days")).alias("s"))
    one = one.groupBy("_id").agg(F.max("s").alias("s"))
    df = terms.join(one, F.col("term_id") == F.col("_id"), "left")
    score = F.coalesce("s.score", F.lit(0.0))
    return df.withColumns({"score": score, "comprehension": comprehension(F.coalesce("s.days", F.lit(1.0)), known), "known": score >= KNOWN}).drop("_id", "s")


def sentence_comprehension(sentences: DataFrame, occurrences: DataFrame) -> DataFrame:
    """`sentences` (sentence_id) with comprehension: mean over their distinct terms (sentence_id, term_id, comprehension), 0 without any."""
    one = occurrences.dropDuplicates(["sentence_id", "term_id"]).groupBy("sentence_id").agg(F.avg("comprehension").alias("comprehension"))
    return sentences.join(one, "sentence_id", "left").fillna(0.0, ["comprehension"])


def file_comprehension(sentences: DataFrame) -> DataFrame:
    """One row per source: mean over all its sentences, empty ones too."""
    return sentences.groupBy("source_id").agg(F.avg("comprehension").alias("comprehension"), F.count("*").alias("n_sentences"))
