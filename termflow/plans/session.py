"""The engine's facade: the application's commands as methods over DataFrames.

Between its steps tables are staged, so a plan holds one step and a later refresh starts from the terms.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.functions import text as T
from termflow.operators import controls, corpus, frequency, mining, segmentation, summary, terms, vocabulary
from termflow.sources import appdata, sinks, subtitles
from termflow.sources.staging import staged

EMPTY_FREQ = "dict string, term string, reading string, value bigint, display string, kana_marker boolean, entry_ord bigint"


class Engine:
    """Dictionaries, vocabulary, ignore list and settings, and what can be asked of them."""

    def __init__(self, spark: SparkSession, config: appdata.EngineConfig | None = None, tokenizer: segmentation.Tokenizer | None = None, freq: DataFrame | None = None, vocab: DataFrame | None = None, ignore: DataFrame | None = None, jlpt: DataFrame | None = None):
        self.spark, self.config = spark, config or appdata.EngineConfig()
        self.tokenizer = tokenizer or segmentation.RegexTokenizer()
        self.freq = staged(freq if freq is not None else spark.createDataFrame([], EMPTY_FREQ))
        self.vocab, self.jlpt = vocab, jlpt
        self.ignore = ignore if ignore is not None else spark.createDataFrame([(t, "manual", True) for t in appdata.DEFAULT_IGNORED], appdata.IGNORE)

    @property
    def dict_state(self) -> DataFrame:
        rows = [(d, float(w), d not in self.config.disabled) for d, w in self.config.weights.items()] + [(d, 1.0, False) for d in self.config.disabled if d not in self.config.weights]
        return self.spark.createDataFrame(rows, "dict string, weight double, enabled boolean")

    @property
    def entries(self) -> DataFrame:
        """Entries of the enabled dictionaries."""
        return frequency.enabled(self.freq, self.dict_state)

    def filters(self) -> list[tuple[str, str]]:
        return T.compile_filters(self.spark, self.config.filter_presets, self.config.text_filters)

    def sentences(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Sentences of files, and what was skipped."""
        return subtitles.read_sentences(self.spark, path, self.filters())

    def segmented(self, sentences: DataFrame) -> DataFrame:
        """Words of sentences (sentence_id, text), one row each; without an enabled dictionary nothing is repaired or taken apart."""
        entries = self.entries
        return staged(segmentation.term_rows(segmentation.segment(sentences, self.tokenizer, None if entries.isEmpty() else entries)))

    def sentence_terms(self, sentences: DataFrame) -> DataFrame:
        """Words and phrases of sentences (sentence_id, text) with lemma and frequency, one row for each place; words inside a phrase of content words are left out."""
        words = self.segmented(sentences).withColumn("word_id", F.struct("sentence_id", "ord"))
        lemma = frequency.choose_lemma(segmentation.lemma_candidates(words), self.entries).withColumnsRenamed({"lemma": "_l", "lemma_reading": "_lr"})
        words = words.join(lemma, "word_id", "left").withColumns({"lemma": F.coalesce("_l", "lemma"), "lemma_reading": F.coalesce("_lr", "lemma_reading")}).drop("_l", "_lr")
        one = words.select(F.col("lemma").alias("word"), F.col("lemma_reading").alias("reading")).distinct().withColumn("word_id", F.concat_ws("\x1f", "word", "reading")).withColumn("is_kana", T.is_kana(F.col("word")))
        maps = frequency.frequency_maps(staged(one), self.freq, self.dict_state).withColumnRenamed("word_id", "_key")
        words = staged(words.join(maps, F.concat_ws("\x1f", "lemma", "lemma_reading") == F.col("_key"), "left").drop("_key"))
        part = F.struct(F.col("full_segment").alias("full"), F.col("full_reading").alias("reading"), "lemma", "lemma_reading", "pos", F.coalesce("harmonic", F.lit(frequency.NO_DATA)).alias("freq"))
        phrases = staged(terms.promote_phrases(words.select("sentence_id", F.col("ord").alias("pos_in_sentence"), part.alias("word")), self.entries))
        kept = terms.drop_suppressed(words.withColumn("pos_in_sentence", F.col("ord")), phrases).drop("pos_in_sentence")
        starts = words.select("sentence_id", F.col("ord").alias("_o"), F.col("start").alias("_start"))
        extra = phrases.join(starts, (phrases["sentence_id"] == starts["sentence_id"]) & (F.col("_o") == phrases["start"])).select(
            phrases["sentence_id"], F.col("_o").alias("ord"), F.col("form").alias("surface"), F.col("reading").alias("surface_reading"), "lemma", "lemma_reading",
            F.col("form").alias("full_segment"), F.col("reading").alias("full_reading"), "pos", F.col("_start").alias("start"), F.col("_start").alias("ref_start"), F.col("frequency").alias("harmonic"),
        )
        return staged(kept.select(*extra.columns).unionByName(extra))

    def base_terms(self, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Unique terms of sentences (sentence_id, text), with frequencies, level, phrases and their number of places; and the places (term_id, sentence_id, start)."""
        every = self.sentence_terms(sentences)
        places = staged(terms.occurrences(every.select("lemma", F.col("lemma_reading").alias("reading"), F.col("sentence_id").alias("ord"), F.col("ref_start").alias("start"))))
        counts = terms.occurrence_counts(places).withColumnsRenamed({"lemma": "_l", "reading": "_r"})
        unique = terms.unique_terms(every).join(counts, (F.col("lemma") == F.col("_l")) & (F.col("lemma_reading") == F.col("_r")), "left").drop("_l", "_r")
        unique = unique.withColumn("term_id", F.concat_ws("\x1f", "lemma", "lemma_reading"))
        places = places.select(F.concat_ws("\x1f", "lemma", "reading").alias("term_id"), F.col("ord").alias("sentence_id"), "start")
        return (vocabulary.with_level(unique, self.jlpt) if self.jlpt is not None else unique.withColumn("level", F.lit(None).cast("string"))), places

    def partition(self, base: DataFrame) -> DataFrame:
        """`base_terms` with status (ignored, known, unknown), score and comprehension. Ignored terms count as known fully; without a vocabulary nothing is known and comprehension is 0."""
        split = vocabulary.split_ignored(base, self.ignore)
        if self.vocab is None:
            scored = split.withColumns({"score": F.lit(0.0), "comprehension": F.lit(0.0), "known": F.lit(False)})
        else:
            scored = vocabulary.match_terms(split, self.vocab, vocabulary.pair_confidence(self.freq), self.config.known_interval)
        ignored = F.col("status") == "ignored"
        status = F.when(ignored, "ignored").when(F.col("known"), "known").otherwise("unknown")
        return scored.withColumns({"status": status, "comprehension": F.when(ignored, 1.0).otherwise(F.col("comprehension"))})

    def process(self, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Terms with status, and sentences (sentence_id, ...) with comprehension."""
        base, places = self.base_terms(sentences)
        table = staged(self.partition(staged(base)))
        return table, self.comprehension(sentences, table, places)

    def comprehension(self, sentences: DataFrame, table: DataFrame, places: DataFrame) -> DataFrame:
        """Sentences with the mean comprehension of their terms; after a new `partition` of the same terms only this is made again."""
        return vocabulary.sentence_comprehension(sentences, places.join(table.select("term_id", "comprehension"), "term_id"))

    def analyze(self, sentences: DataFrame) -> DataFrame:
        """Corpus counts by lemma: lemma, reading, n. Phrases that a dictionary has count besides their words."""
        words = self.segmented(sentences).filter(T.trim(F.col("surface")) != "")
        part = F.struct(F.col("full_segment").alias("full"), F.col("full_reading").alias("reading"), F.col("surface").alias("lemma"), F.col("surface_reading").alias("lemma_reading"), "pos", F.lit(frequency.NO_DATA).alias("freq"))
        phrases = terms.promote_phrases(words.select("sentence_id", F.col("ord").alias("pos_in_sentence"), part.alias("word")), self.entries, corpus=True)
        form, reading = F.col("form"), F.col("reading")
        counted = ["surface", "surface_reading", "full_segment", "full_reading", "pos", "lemma", "lemma_reading"]
        more = phrases.select(form.alias("surface"), reading.alias("surface_reading"), form.alias("full_segment"), reading.alias("full_reading"), "pos", form.alias("lemma"), reading.alias("lemma_reading"))
        words = staged(words.select(*counted).unionByName(more))
        counts = corpus.count_surfaces(words)
        pos = words.groupBy("surface", "surface_reading").agg(F.min("pos").alias("pos"), F.min("lemma").alias("lemma"), F.min("lemma_reading").alias("lemma_reading"))
        pos = pos.withColumn("word_id", F.struct("surface", "surface_reading"))
        lemmas = frequency.choose_lemma(segmentation.lemma_candidates(pos, corpus=True), self.entries, prefer=False)
        lemmas = lemmas.select(F.col("word_id.surface").alias("surface"), F.col("word_id.surface_reading").alias("reading"), "lemma", "lemma_reading")
        return corpus.merge_lemmas(counts, lemmas)

    def knowledge(self) -> DataFrame:
        """kind, band, coverage, comprehension, total; empty without a vocabulary."""
        schema = "kind string, band string, coverage double, comprehension double, total bigint"
        if self.vocab is None:
            return self.spark.createDataFrame([], schema)
        rows = summary.frequency_summary(self.vocab, self.entries, self.config.known_interval).select(F.lit("frequency").alias("kind"), "*")
        if self.jlpt is not None:
            rows = summary.level_summary(self.jlpt, self.vocab, vocabulary.pair_confidence(self.freq), self.config.known_interval).select(F.lit("jlpt").alias("kind"), "*").unionByName(rows)
        return rows

    def refresh(self, base: DataFrame, sentences: DataFrame, places: DataFrame, vocab: DataFrame | None = None, ignore: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The same terms under a new vocabulary or ignore list: partition and comprehension are made again, nothing is segmented."""
        self.vocab, self.ignore = vocab if vocab is not None else self.vocab, ignore if ignore is not None else self.ignore
        table = staged(self.partition(base))
        return table, self.comprehension(sentences, table, places)

    def set_dictionaries(self, freq: DataFrame | None = None, settings: dict[str, tuple[float, bool]] | None = None) -> None:
        """Take other dictionaries, or weights and switches of some of them (weight, enabled); terms made before keep their frequencies until they are made again."""
        if freq is not None:
            self.freq = staged(freq)
        if settings:
            weights = self.config.weights | {d: max(w, frequency.LEAST_WEIGHT) for d, (w, _) in settings.items()}
            off = {d for d in self.config.disabled if settings.get(d, (0, False))[1] is False} | {d for d, (_, on) in settings.items() if not on}
            self.config = replace(self.config, weights=weights, disabled=tuple(sorted(off)))

    def dictionaries(self) -> DataFrame:
        """dict, weight, enabled, n_entries of the loaded dictionaries, by name."""
        n = self.freq.groupBy("dict").agg(F.count("*").alias("n_entries"))
        state = self.dict_state.withColumnRenamed("dict", "_d")
        return n.join(state, F.col("dict") == F.col("_d"), "left").select("dict", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("enabled", F.lit(True)).alias("enabled"), "n_entries").orderBy("dict")

    def export(self, counts: DataFrame, path: str, kind: str = "csv", title: str = "corpus", drop_hapax: bool = False) -> None:
        """Corpus counts as a CSV rank list or a dictionary archive."""
        if kind == "csv":
            sinks.write_frequency_csv(counts, path, drop_hapax)
        else:
            sinks.write_dictionary_zip(counts, path, title, drop_hapax=drop_hapax)

    def mined_state(self, table: DataFrame, recorded: DataFrame, harvested: DataFrame, recent: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Terms with mined (lemma or surface among the recently added terms), and all sentences that notes have."""
        sentences = mining.mined_sentences(recorded.select("sentence").unionByName(recent.select("sentence").filter("sentence IS NOT NULL")), harvested)
        return mining.with_mined(table, recent.select("term").filter("term IS NOT NULL")), sentences

    def cards(self, notes: DataFrame, formats: DataFrame) -> DataFrame:
        """Cards to create: the formats' templates filled from notes (note_id, model, values)."""
        return mining.assemble(notes, formats)

    def view(self, table: DataFrame, state: controls.Controls) -> DataFrame:
        return controls.apply(table, state)
