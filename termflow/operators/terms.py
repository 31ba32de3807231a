"""Terms in their sentences: occurrences, phrases, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.functions import text as T
from termflow.operators.frequency import pair_frequency
from termflow.sources.staging import staged

# Fixed values.
NO_ENDPOINT = ["Postposition", "Copula", "Symbol"]
NOUNS = ["Noun", "CompoundNoun", "ProperNoun"]
CONJUGABLE = ["Verb", "SuruVerb", "Adjective", "AdjectivalNoun"]
SCORE_MOST, RATIO_LEAST, OVERRIDE_RATIO, FREQUENT = 10.0, 120.0, 40.0, 10_000
LEAST_LENGTH, LEAST_KANJI_LENGTH = 4, 3
UNKNOWN = 4294967295
VOICED = {"か": "が", "き": "ぎ", "く": "ぐ", "け": "げ", "こ": "ご", "さ": "ざ", "し": "じ", "す": "ず", "せ": "ぜ", "そ": "ぞ", "た": "だ", "ち": "ぢ", "つ": "づ", "て": "で", "と": "ど", "は": "ばぱ", "ひ": "びぴ", "ふ": "ぶぷ", "へ": "べぺ", "ほ": "ぼぽ"}


def occurrences(terms: DataFrame) -> DataFrame:
    """lemma, reading, ord, start: the distinct places of terms, a row each (a frequent word's places don't fit one row)."""
    return terms.select("lemma", "reading", "ord", "start").distinct()


def occurrence_counts(places: DataFrame) -> DataFrame:
    """lemma, reading, n_refs, first_ref: how many places a term has, and the first."""
    return places.groupBy("lemma", "reading").agg(F.count("*").alias("n_refs"), F.min(F.struct("ord", "start")).alias("first_ref"))


def first_of_key(terms: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row per key, the first in an order: an aggregate with map-side combine, not a sort."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = terms.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*terms.columns).alias("_row"), F.struct(*order).alias("_order"))
    return rows.groupBy(*names).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def unique_terms(terms: DataFrame) -> DataFrame:
    """Terms (lemma, lemma_reading, ...) without those of the same lemma and reading key, the first by lemma and reading."""
    return first_of_key(terms, [F.col("lemma"), T.comparison_key(F.col("lemma_reading"))], ["lemma", "lemma_reading", "ord"])


def rendaku(reading: Column, offsets: Column) -> Column:
    """Candidate readings of a compound: as it is, then with one inner component's first kana voiced at a time."""
    table = F.create_map(*[F.lit(x) for k, v in VOICED.items() for x in (k, v)])
    at = lambda o: F.split(F.coalesce(F.element_at(table, F.substring(reading, o + 1, F.lit(1))), F.lit("")), "(?<!^)(?!$)")
    voiced = F.transform(offsets, lambda o: F.transform(F.filter(at(o), lambda v: v != ""), lambda v: F.concat(F.substring(reading, F.lit(1), o), v, F.substring(reading, o + 2, F.length(reading)))))
    return F.concat(F.array(reading), F.flatten(voiced))


def sentence_words(words: DataFrame) -> DataFrame:
    """sentence_id, w: the words (sentence_id, pos_in_sentence, word struct) of each sentence in order."""
    rows = words.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("pos_in_sentence", "word"))).alias("w"))  # bounded by a sentence
    return rows.select("sentence_id", F.transform("w", lambda x: x["word"]).alias("w"))


def ngrams(rows: DataFrame, longest: int) -> DataFrame:
    """sentence_id, start, size, form, c_form of all runs of two words or more in `sentence_words` that begin and end with content and whose words but the last have fewer than `longest` characters; c_form, with the last word in citation form, is null where that is no other.

    Forms are cut from the sentence by the words' places in it. A term of `longest` characters can't be
    longer than such a run.
    """
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["full"])).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(x["full"]))).alias("all"))
    rows = rows.withColumns({"_at": F.aggregate("w", start, step, lambda s: s["all"]), "_text": F.array_join(F.transform("w", lambda x: x["full"]), "")})
    at = lambda k: F.get("_at", k)
    content = lambda k: ~F.get("w", k)["pos"].isin(NO_ENDPOINT)
    cut = lambda a, b: F.substring("_text", at(a) + 1, at(b) - at(a))

    def runs(s: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest + 1), F.size("w") - s))
        good = F.filter(sizes, lambda n: (n > 1) & (at(s + n - 1) - at(s) < longest) & content(s) & content(s + n - 1))

        def run(n: Column) -> Column:
            last = F.get("w", s + n - 1)
            cites = last["pos"].isin(CONJUGABLE) & (last["lemma"] != "") & (last["lemma"] != last["full"])
            return F.struct(s.alias("start"), n.alias("size"), cut(s, s + n).alias("form"), F.when(cites, F.concat(cut(s, s + n - 1), last["lemma"])).alias("c_form"))

        return F.transform(good, run)

    return rows.select("sentence_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), runs))).alias("r")).select("sentence_id", "r.*")


def in_dictionary(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """sentence_id, start, size of the runs of which some dictionary has a form, as it is written or with katakana folded."""
    long = lambda c: T.fold_long_vowels(F.col(c))
    forms = F.array_distinct(F.array_compact(F.array(long("form"), T.fold_katakana(long("form")), long("c_form"), T.fold_katakana(long("c_form")))))
    listed = entries.select(F.col("term").alias("_f")).distinct()
    return runs.select("sentence_id", "start", "size", F.explode(forms).alias("_f")).join(listed, "_f", "left_semi").select("sentence_id", "start", "size").distinct()


def long_enough(length: Column, kanji_noun: Column) -> Column:
    """Whether a phrase has the least length of its kind."""
    return length >= F.when(kanji_noun, LEAST_KANJI_LENGTH).otherwise(LEAST_LENGTH)


def phrase_gates(frequency: Column, parts: Column, length: Column, kanji_noun: Column) -> Column:
    """Whether a run of words with this joint frequency is a phrase; parts' `freq` are their own (UNKNOWN without).

    Long enough, and either an all-kanji noun compound, or rarer together than apart: the frequency to the
    power of the number of parts over the product of theirs is small, or the largest ratio is great.
    """
    k = F.size(parts)
    product = F.aggregate(parts, F.lit(1.0), lambda a, p: a * p["freq"])
    ratio = F.array_max(F.transform(parts, lambda p: frequency / p["freq"].cast("double")))
    unknown = F.exists(parts, lambda p: p["freq"] == UNKNOWN)
    enough = long_enough(length, kanji_noun)
    common = ~kanji_noun & ~unknown & (frequency > FREQUENT) & (ratio < OVERRIDE_RATIO)
    return enough & ~common & (kanji_noun | (F.pow(frequency.cast("double"), k) / product <= SCORE_MOST) | (ratio >= RATIO_LEAST))


def promote_phrases(words: DataFrame, entries: DataFrame, corpus: bool = False) -> DataFrame:
    """sentence_id, start, size, form, reading, lemma, lemma_reading, frequency, pos, suppresses: the longest accepted phrase at each place.

    `words` has (sentence_id, pos_in_sentence, word struct<full:string, reading:string, lemma:string,
    lemma_reading:string, pos:string, freq:bigint>). Each run is looked up with its reading and the voiced
    variants of it, then with its last word in citation form. Runs are of base words only; they are as long
    as the dictionaries' longest term allows. For `corpus` counts a dictionary's word is enough: no voiced
    variants are tried and only the length is judged.
    """
    longest = entries.agg(F.max(F.length("term"))).first()[0] or 0
    rows = staged(sentence_words(words))
    g = staged(in_dictionary(ngrams(rows, longest), entries)).join(rows, "sentence_id").select("sentence_id", "start", "size", F.slice("w", F.col("start") + 1, F.col("size")).alias("parts"))
    part = lambda i: F.element_at("parts", i)
    joined = lambda field, parts="parts": F.array_join(F.transform(parts, lambda p: p[field]), "")
    offsets = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p["reading"])))
    citation = F.concat(F.slice("parts", F.lit(1), F.size("parts") - 1), F.array(F.struct(part(-1)["lemma"].alias("full"), part(-1)["lemma_reading"].alias("reading"), part(-1)["lemma"].alias("lemma"), part(-1)["lemma_reading"].alias("lemma_reading"), part(-1)["pos"].alias("pos"), part(-1)["freq"].alias("freq"))))
    cites = part(-1)["pos"].isin(CONJUGABLE) & (part(-1)["lemma"] != "") & (part(-1)["lemma"] != part(-1)["full"])
    g = g.withColumns({"form": joined("full"), "plain": joined("reading"), "offsets": offsets, "citation": F.when(cites, citation)})
    g = g.withColumn("c_form", joined("full", F.col("citation"))).withColumn("c_plain", joined("reading", F.col("citation")))
    g = staged(g)
    row = lambda k, form, reading: F.transform(reading, lambda r, i: F.struct(F.lit(k).alias("kind"), i.alias("nth"), form.alias("form"), r.alias("reading")))
    readings = lambda plain: F.array(plain) if corpus else rendaku(F.col(plain), F.col("offsets"))
    tries = F.concat(row(0, F.col("form"), readings("plain")), F.coalesce(F.when(F.col("citation").isNotNull(), row(1, F.col("c_form"), readings("c_plain"))), F.array().cast("array<struct<kind:int,nth:int,form:string,reading:string>>")))
    t = g.select("sentence_id", "start", "size", F.explode(tries).alias("t")).select("sentence_id", "start", "size", "t.*")
    t = t.withColumns({"word": T.fold_long_vowels(F.col("form")), "key": T.fold_long_vowels(F.col("reading"))}).withColumn("pair_id", F.concat_ws("\x1f", "word", "key"))
    found = staged(pair_frequency(staged(t.select("pair_id", "word", F.col("key").alias("reading")).distinct()), entries))
    best = t.join(found, "pair_id").groupBy("sentence_id", "start", "size").agg(F.min_by(F.struct("kind", "form", "reading", "frequency"), F.struct("kind", "nth")).alias("b"))
    df = g.join(best, ["sentence_id", "start", "size"])
    lemma = F.when(F.col("b.kind") == 0, F.col("form")).otherwise(F.col("b.form"))
    nouns = F.forall("parts", lambda p: p["pos"].isin(NOUNS))
    kanji = nouns & T.all_kanji(lemma)
    df = df.filter(long_enough(F.length(lemma), kanji) if corpus else phrase_gates(F.col("b.frequency"), F.col("parts"), F.length(lemma), kanji))
    content = F.forall("parts", lambda p: ~p["pos"].isin(NO_ENDPOINT))
    df = df.select(
        "sentence_id", "start", "size", "form", F.when(F.col("b.kind") == 0, F.col("b.reading")).otherwise(F.col("plain")).alias("reading"), lemma.alias("lemma"), F.col("b.reading").alias("lemma_reading"),
        F.col("b.frequency").alias("frequency"), F.when(nouns, "NounExpression").otherwise("Expression").alias("pos"), content.alias("suppresses"),
    )
    return df.groupBy("sentence_id", "start").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("sentence_id", "start")]), "size").alias("x")).select("sentence_id", "start", "x.*")


def drop_suppressed(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """`words` (sentence_id, pos_in_sentence, ...) without those inside a phrase of content words."""
    inside = phrases.filter("suppresses").select("sentence_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos_in_sentence")).distinct()
    return words.join(inside, ["sentence_id", "pos_in_sentence"], "left_anti")


def span_knowledge(segments: DataFrame, spans: DataFrame, key: str = "sentence_id") -> DataFrame:
    """`segments` (key, seg_id, seg_start, seg_end) with the least knowledge of the term spans (key, start, end, knowledge) that overlap them; null where none does."""
    s = spans.select(F.col(key).alias("_key"), "start", "end", "knowledge")
    df = segments.join(s, (F.col(key) == F.col("_key")) & (F.col("start") < F.col("seg_end")) & (F.col("end") > F.col("seg_start")), "left")
    return df.groupBy(*segments.columns).agg(F.min("knowledge").alias("knowledge"))


def display_text(occurrences: DataFrame, segments: DataFrame, key: str = "sentence_id") -> DataFrame:
    """`occurrences` (occ_id, key, start, end) with text: the segments (key, seg_start, seg_end, surface) that overlap the span, joined in order; empty without any."""
    s = segments.select(F.col(key).alias("_key"), "seg_start", "seg_end", F.col("surface").alias("_s"))
    df = occurrences.join(s, (F.col(key) == F.col("_key")) & (F.col("seg_start") < F.col("end")) & (F.col("seg_end") > F.col("start")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("seg_start", "_s"))))  # bounded by a sentence
    return df.groupBy(*occurrences.columns).agg(F.array_join(F.transform(parts, lambda p: p["_s"]), "").alias("text"))


def covering_term(segments: DataFrame, spans: DataFrame, key: str = "sentence_id") -> DataFrame:
    """`segments` with the first term (least term_ord) whose span overlaps them."""
    s = spans.select(F.col(key).alias("_key"), "start", "end", "term_id", "term_ord")
    df = segments.join(s, (F.col(key) == F.col("_key")) & (F.col("start") < F.col("seg_end")) & (F.col("end") > F.col("seg_start")), "left")
    return df.groupBy(*segments.columns).agg(F.min_by("term_id", "term_ord").alias("term_id"))
