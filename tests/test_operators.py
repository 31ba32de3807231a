"""Frequencies, vocabulary, terms, controls and corpus operators on small tables."""

import hashlib
import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termflow.operators import controls, corpus, frequency, mining, segmentation, summary, terms, vocabulary
from termflow.plans.session import Engine

FREQ = "dict string, term string, reading string, value bigint, display string, kana_marker boolean, entry_ord bigint"
VOCAB = "vocab_idx long, term string, reading string, interval double"


def match(spark, word, reading, card, card_reading, pos="Verb", entries=()):
    forms = spark.createDataFrame([(1, word, reading, pos)], "form_id long, word string, reading string, pos string")
    vocab = spark.createDataFrame([(0, card, card_reading, 30.0)], VOCAB)
    conf = vocabulary.pair_confidence(spark.createDataFrame(list(entries), FREQ))
    row = vocabulary.best_match(forms, vocab, conf).first()
    return row["score"] if row else 0.0


def test_inclusivity_ladder(spark):
    assert match(spark, "犬", "いぬ", "犬", "いぬ") == 1.0
    assert match(spark, "だます", "だます", "騙す", "だます") >= 0.60
    assert match(spark, "話し掛ける", "はなしかける", "話しかける", "はなしかける") == 0.85
    assert match(spark, "上る", "のぼる", "昇る", "のぼる") < 0.60
    assert match(spark, "橋", "はし", "箸", "はし", "Noun") < 0.60
    assert match(spark, "の", "の", "野", "の", "Postposition") == 0.0
    entries = [("d", "犬", "いぬ", 100, None, False, 0), ("d", "犬", "けん", 9000, None, False, 1)]
    assert match(spark, "けん", "けん", "犬", "けん", "Noun", entries) < 0.60
    assert match(spark, "いぬ", "いぬ", "犬", "いぬ", "Noun", entries) == pytest.approx(0.85 * 0.9)


def test_comprehension(one):
    c = one(vocabulary.comprehension(F.lit(1.0)), vocabulary.comprehension(F.lit(None).cast("double")), vocabulary.comprehension(F.lit(30.0)), vocabulary.comprehension(F.lit(90.0)))
    assert c[0] == pytest.approx(math.log(2) / math.log(31)) and c[1:] == (0.0, 1.0, 1.0)


def test_lookup_priority(spark):
    freq = spark.createDataFrame([("d", "いぬ", "いぬ", 5, "5㋕", True, 0), ("d", "いぬ", None, 7, None, False, 1), ("d", "いぬ", "いぬ", 3, None, False, 2), ("d", "犬", "いぬ", 9, None, False, 3), ("d", "犬", "いぬ", 8, None, False, 4), ("d", "けが人", "けがにん", 11, None, False, 5)], FREQ)
    words = spark.createDataFrame([(1, "いぬ", "いぬ", True), (2, "犬", "いぬ", False), (3, "犬", "けん", False), (4, "ケガ人", "けがにん", False)], "word_id long, word string, reading string, is_kana boolean")
    assert {r["word_id"]: r["value"] for r in frequency.lookup_folded(words, freq).collect()} == {1: 5, 2: 8, 4: 11}


def test_means(spark):
    df = spark.createDataFrame([(2, 1.0), (6, 1.0), (0, 5.0)], "v long, w double").agg(frequency.harmonic(F.col("v")).alias("h"), frequency.weighted_harmonic(F.col("v"), F.col("w")).alias("w"))
    assert tuple(df.first()) == (3, 3)
    empty = spark.createDataFrame([], "v long, w double").agg(frequency.harmonic(F.col("v")).alias("h"), frequency.weighted_harmonic(F.col("v"), F.col("w")).alias("w"))
    assert tuple(empty.first()) == (None, frequency.NO_DATA)


def test_means_of_a_half_in_any_order(spark):
    for values in [(6, 9, 18, 21), (14, 15, 35, 26), (60, 40, 25, 40)]:
        df = spark.createDataFrame([(k, v) for k, order in enumerate(itertools.permutations(values)) for v in order], "k long, v long").coalesce(1)
        for mean in (frequency.harmonic(F.col("v")), frequency.weighted_harmonic(F.col("v"), F.lit(0.5))):
            assert len({r["m"] for r in df.groupBy("k").agg(mean.alias("m")).collect()}) == 1


def test_pair_frequency(spark):
    e = spark.createDataFrame([("a", "行く", "いく", 10, None, False, 0), ("b", "行く", "いく", 30, None, False, 1), ("a", "上", None, 4, None, False, 2), ("a", "下", "した", 4, None, False, 3), ("a", "する", "する", 1, None, False, 4)], FREQ)
    p = spark.createDataFrame([("1", "行く", "いく"), ("2", "上", "うえ"), ("3", "下", "しも"), ("4", "する", "する")], "pair_id string, word string, reading string")
    assert {r[0]: r[1] for r in frequency.pair_frequency(p, e).collect()} == {"1": 15, "2": 4}


def test_level_is_easier(spark):
    jlpt = spark.createDataFrame([("犬", "いぬ", "N4"), ("犬", "いぬ", "N5"), ("", "です", "N5")], "kanji string, kana string, level string")
    t = spark.createDataFrame([("犬", "イヌ"), ("いぬ", "いぬ"), ("です", "です"), ("猫", "ねこ")], "lemma string, lemma_reading string")
    assert {r["lemma"]: r["level"] for r in vocabulary.with_level(t, jlpt).collect()} == {"犬": "N5", "いぬ": "N5", "です": "N5", "猫": None}


def test_span_knowledge(spark):
    seg = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 3, 6), (0, 2, 6, 9)], "sentence_id long, seg_id long, seg_start int, seg_end int")
    spans = spark.createDataFrame([(0, 0, 6, 2), (0, 3, 4, 1)], "sentence_id long, start int, end int, knowledge int")
    assert [r["knowledge"] for r in terms.span_knowledge(seg, spans).orderBy("seg_id").collect()] == [2, 1, None]


def token(surface, start, **kw):
    return segmentation.Token(surface, **{"surface_reading": surface, "lemma": surface, "lemma_reading": surface} | kw, start_byte=start, end_byte=start + len(surface.encode()))


def test_merge_rules():
    t = [token("勉強", 0, pos1="名詞", pos2="普通名詞", pos3="サ変可能", surface_reading="ベンキョウ"), token("し", 6, pos1="動詞", c_type="サ行変格"), token("まし", 9, pos1="助動詞", c_type="助動詞-マス"), token("た", 15, pos1="助動詞", c_type="助動詞-タ")]
    (w,) = segmentation.build_words(t)
    assert (w.surface, w.pos, w.facts()[0], w.facts()[1]) == ("勉強しました", "SuruVerb", "勉強", "べんきょう")
    t = [token("8", 0, pos1="名詞", pos2="数詞", surface_reading="ハチ"), token("月", 1, pos1="名詞", pos2="普通名詞", pos3="助数詞可能"), token("2", 4, pos1="名詞", pos2="数詞"), token("2", 5, pos1="名詞", pos2="数詞"), token("日", 6, pos1="名詞", pos2="普通名詞", pos3="助数詞可能")]
    a, b = segmentation.build_words(t)
    assert (a.surface, a.pos, b.surface, b.pos, b.tokens[0].surface_reading) == ("8月", "Counter", "22日", "Counter", "ニジュウニ")
    (w,) = segmentation.build_words([token("悪", 0, pos1="形容詞", lemma="悪い"), token("そう", 3, pos1="形状詞", pos2="助動詞語幹")])
    assert (w.surface, w.lemma, w.pos) == ("悪そう", "悪い", "Adjective")
    assert len(segmentation.DEFAULT_RULES) == 26


def test_excluded_tokens(spark):
    """Signs that count as Japanese are listed one by one; what isn't Japanese is excluded anyway."""
    signs = list("。｡、！？‼⁉・･…～〜ー「」『』【】（）｟｠《》()[]{},.!?;:\"'`´“”-–—―_＿/\\|｜*＊※☆★♪♬♫♩→←↑↓➡⇒○●◯◎□■◆◇△▲▽▼　＃#&＆@＠+＋=＝<>＜＞≪≫%％$￥¥°℃℉〒§")
    assert len(signs) == len(corpus.PUNCTUATION) == 107 and set(signs) == set(corpus.PUNCTUATION)
    df = spark.createDataFrame([(x,) for x in [*signs, "abc", "", " ", "犬", "いぬ", "イヌー", "ーー"]], "t string").select("t", corpus.excluded_token(F.col("t")).alias("out"))
    got = {r["t"]: r["out"] for r in df.collect()}
    assert all(got[x] for x in [*signs, "abc", "", " "]) and not any(got[x] for x in ("犬", "いぬ", "イヌー", "ーー"))


def test_rescue():
    bad = [token("負け", 0, pos1="名詞", pos2="普通名詞"), token("じと", 6, pos1="名詞", pos2="普通名詞")]
    good = [token("負けじ", 0, pos1="名詞", pos2="普通名詞"), token("と", 9, pos1="助詞")]
    words = segmentation.build_words(bad)
    known = {("負けじ", "負けじ")}
    assert [w.surface for w in segmentation.rescue(words, [bad, good], known)] == ["負けじ", "と"]
    assert segmentation.rescue(words, [bad, good], {p for w in words for p in segmentation.candidate_pairs(w)}) == words


def test_compound_split():
    t = [token("夏子", 0, pos1="名詞", pos2="固有名詞"), token("おばさん", 6, pos1="名詞", pos2="普通名詞")]
    (w,) = segmentation.build_words(t)
    assert w.pos == "CompoundNoun"
    assert [x.surface for x in segmentation.split_compounds([w], set())] == ["夏子", "おばさん"]
    assert segmentation.split_compounds([w], {(w.surface, w.reading)}) == [w]


def test_rendaku(one):
    assert one(terms.rendaku(F.lit("どようひ"), F.array(F.lit(3))))[0] == ["どようひ", "どようび", "どようぴ"]


def test_phrase_promotion(spark):
    part = "struct<full:string,reading:string,lemma:string,lemma_reading:string,pos:string,freq:bigint>"
    w = lambda x, r: (x, r, x, r, "Noun", 5000)
    words = spark.createDataFrame([(0, 0, w("土曜", "どよう")), (0, 1, w("日", "ひ"))], f"sentence_id long, pos_in_sentence int, word {part}")
    e = spark.createDataFrame([("d", "土曜日", "どようび", 900, None, False, 0)], FREQ)
    row = terms.promote_phrases(words, e).first()
    assert (row["form"], row["reading"], row["pos"], row["suppresses"]) == ("土曜日", "どようび", "NounExpression", True)
    assert terms.drop_suppressed(words, terms.promote_phrases(words, e)).count() == 0


def test_long_phrases(spark):
    """Phrases of any number of words, as far as the dictionary's longest term goes; corpus counts need no gates."""
    part = "struct<full:string,reading:string,lemma:string,lemma_reading:string,pos:string,freq:bigint>"
    row = lambda s, k, x, pos="Noun": (s, k, (x, x, x, x, pos, 5000))
    words = spark.createDataFrame([row(0, k, x) for k, x in enumerate("いろはにほへとちり")] + [row(1, 0, "気"), row(1, 1, "に", "Postposition"), (1, 2, ("なった", "なった", "なる", "なる", "Verb", 5))], f"sentence_id long, pos_in_sentence int, word {part}")
    e = spark.createDataFrame([("d", "いろはにほへとち", "いろはにほへとち", 900, None, True, 0), ("d", "気になる", "気になる", 9000, None, False, 1)], FREQ)
    got = {(r["sentence_id"], r["start"], r["size"], r["form"], r["lemma"]) for r in terms.promote_phrases(words, e).collect()}
    assert got == {(0, 0, 8, "いろはにほへとち", "いろはにほへとち"), (1, 0, 3, "気になった", "気になる")}
    counted = terms.promote_phrases(words, e, corpus=True)
    assert {(r["form"], r["lemma"]) for r in counted.collect()} == {("いろはにほへとち", "いろはにほへとち"), ("気になった", "気になる")}
    assert terms.promote_phrases(words, e.limit(0)).count() == 0


def test_corpus_counts_phrases(spark):
    freq = spark.createDataFrame([("d", "犬猫鳥", "犬猫鳥", 120, None, False, 0)], FREQ)
    noun = lambda x, at: token(x, at, pos1="名詞", pos2="普通名詞")
    script = {"犬猫鳥": [[noun("犬", 0), noun("猫", 3), noun("鳥", 6)]]}
    sent = spark.createDataFrame([(0, "犬猫鳥"), (1, "犬猫鳥")], "sentence_id long, text string")
    got = {r["lemma"]: r["n"] for r in Engine(spark, tokenizer=segmentation.ScriptedTokenizer(script), freq=freq).analyze(sent).collect()}
    assert got == {"犬": 2, "猫": 2, "鳥": 2, "犬猫鳥": 2}


def test_span_retries():
    """A span that the sentence's paths agree on is read again by itself, then with the word before it."""
    verb = lambda s, at, **kw: token(s, at, pos1="動詞", **kw)
    path = [verb("つけ", 0), token("た", 6, pos1="助動詞", c_type="助動詞-タ"), verb("けれ", 9, c_form="仮定形-一般"), token("ば", 15, pos1="助詞", pos2="接続助詞")]
    joined = [verb("つけ", 0), token("たけれ", 6, pos1="助動詞", c_type="助動詞-タイ", c_form="仮定形-一般"), token("ば", 15, pos1="助詞", pos2="接続助詞")]
    words = segmentation.build_words(path)
    asked = []
    again = lambda s, e: asked.append((s, e)) or ([joined] if s == 0 else [path[2:]])
    done = segmentation.rescue(words, [path], {("つける", "つける"), ("つけたければ", "つけたければ"), ("ける", "ける")} | {p for w in segmentation.build_words(joined) for p in segmentation.candidate_pairs(w)}, again)
    assert [w.surface for w in done] == ["つけたければ"] and asked[0] == words[1].span and asked[1][0] == 0


def test_display_text(spark):
    seg = spark.createDataFrame([(0, 0, 3, "気"), (0, 3, 6, "に"), (0, 6, 15, "なった"), (1, 0, 3, "犬")], "sentence_id long, seg_start int, seg_end int, surface string")
    occ = spark.createDataFrame([(1, 0, 0, 15), (2, 0, 7, 8), (3, 1, 3, 9)], "occ_id long, sentence_id long, start int, end int")
    assert {r["occ_id"]: r["text"] for r in terms.display_text(occ, seg).collect()} == {1: "気になった", 2: "なった", 3: ""}


def test_best_match_ties(spark):
    """Of equal scores the earlier key, then the earlier entry; repeated forms each get the result, equal entries count once, the first."""
    forms = spark.createDataFrame([(i, "犬", "いぬ", "Noun") for i in range(4)] + [(9, "猫", None, "Noun")], "form_id long, word string, reading string, pos string")
    vocab = spark.createDataFrame([(0, "いぬ", "いぬ", 1.0), (1, "犬", "いぬ", 2.0), (2, "犬", "いぬ", 3.0), (3, "犬", "けん", 4.0)], VOCAB)
    assert {(r["form_id"], r["score"], r["vocab_idx"], r["interval"]) for r in vocabulary.best_match(forms, vocab).collect()} == {(i, 1.0, 1, 2.0) for i in range(4)}


def test_field_guesses(spark):
    none = F.create_map().cast("map<string,string>")
    names = lambda *x: F.array(*map(F.lit, x))
    note = F.create_map(F.lit("Front"), F.lit("食べる"), F.lit("Kana"), F.lit("たべる"), F.lit("Back"), F.lit("毎日パンを<b>食べる</b>。"))
    row = spark.range(1).select(
        mining.guess_sentence_field(names("Word", "Sentence Meaning", "Sentence", "Notes"), none).alias("a"), mining.guess_sentence_field(names("Expression", "SentenceFurigana", "SentenceAudio", "ExampleSentence"), none).alias("b"),
        mining.guess_sentence_field(names("Expression", "SentenceFurigana", "IsSentenceCard"), none).alias("c"), mining.guess_sentence_field(names("Front", "Back"), note).alias("d"), mining.guess_sentence_field(names("Front", "例文"), none).alias("e"),
        mining.guess_term_fields(names("Front", "Kana", "Back"), note).alias("f"), mining.guess_term_fields(names("Kana", "Front"), note).alias("g"), mining.guess_term_fields(names("Back"), note).alias("h"),
    ).first()
    assert row[:5] == ("Sentence", "ExampleSentence", None, "Back", "例文")
    assert tuple(row["f"]) == ("Front", "Kana") and tuple(row["g"]) == ("Front", "Kana") and tuple(row["h"]) == (None, None)


def test_recently_added(spark):
    notes = spark.createDataFrame([(1, "m", {"w": "<b>犬</b>", "s": "犬 だ"}, "2024-01-02 10:00:00"), (2, "m", {"w": "猫", "s": ""}, "2024-01-01 09:00:00"), (3, "m", {"w": " ", "s": ""}, "2024-01-02 11:00:00"), (4, "x", {"w": "鳥"}, "2024-01-02 11:00:00")], "note_id long, model string, fields map<string,string>, added string").withColumn("added", F.col("added").cast("timestamp"))
    mapping = spark.createDataFrame([("m", "w", "r", "s")], "model string, term_field string, reading_field string, sentence_field string")
    got = mining.recently_added(notes, mapping, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()
    assert [tuple(r) for r in got] == [(1, "犬", "犬だ")]


def test_lemma_choice(spark):
    t = spark.createDataFrame([(1, "行った", "いった", "行く", "いく", "Verb")], "word_id long, surface string, surface_reading string, lemma string, lemma_reading string, pos string")
    e = spark.createDataFrame([("d", "行う", "いう", 5, None, False, 0), ("d", "行く", "いく", 50, None, False, 1)], FREQ)
    c = segmentation.lemma_candidates(t)
    assert frequency.choose_lemma(c, e).first()["lemma"] == "行く"
    assert frequency.choose_lemma(c, e, prefer=False).first()["lemma"] == "行う"


def test_engine(spark):
    freq = spark.createDataFrame([("d", "犬", "犬", 120, None, False, 0)], FREQ)
    vocab = spark.createDataFrame([(0, "犬", "犬", 30.0)], VOCAB)
    sent = spark.createDataFrame([(0, "犬と猫"), (1, "犬。鳥"), (2, "")], "sentence_id long, text string")
    table, comp = Engine(spark, freq=freq, vocab=vocab).process(sent)
    status = {r["lemma"]: r["status"] for r in table.collect()}
    assert status["犬"] == "known" and status["と"] == "ignored" and status["猫"] == "unknown"
    assert comp.count() == 3 and comp.filter("sentence_id = 2").first()["comprehension"] == 0.0
    assert {r["lemma"]: r["n"] for r in Engine(spark, freq=freq).analyze(sent).collect()}["犬"] == 2
    assert {r["band"] for r in Engine(spark, freq=freq, vocab=vocab).knowledge().collect()} == {"<1.5k"}


def test_engine_commands(spark, tmp_path):
    freq = spark.createDataFrame([("b", "犬", "犬", 120, None, False, 0), ("a", "猫", "猫", 50, None, False, 0)], FREQ)
    engine = Engine(spark, freq=freq)
    sent = spark.createDataFrame([(0, "犬と猫"), (1, "猫")], "sentence_id long, text string")
    base, places = engine.base_terms(sent)
    assert {(r["lemma"], r["n_refs"]) for r in base.collect()} == {("犬", 1), ("と", 1), ("猫", 2)} and places.count() == 4
    vocab = spark.createDataFrame([(0, "猫", "猫", 30.0)], VOCAB)
    table, comp = engine.refresh(base, sent, places, vocab=vocab)
    assert {r["lemma"]: r["status"] for r in table.collect()} == {"犬": "unknown", "と": "ignored", "猫": "known"}
    assert comp.filter("sentence_id = 1").first()["comprehension"] == 1.0
    engine.set_dictionaries(settings={"a": (0.01, True), "b": (2.0, False)})
    assert [tuple(r) for r in engine.dictionaries().collect()] == [("a", 0.1, True, 1), ("b", 2.0, False, 1)]
    assert {r["dict"] for r in engine.entries.collect()} == {"a"}
    engine.set_dictionaries(settings={"b": (1.0, True)})
    assert {r["dict"] for r in engine.entries.collect()} == {"a", "b"}
    engine.export(engine.analyze(sent), str(tmp_path / "out.csv"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out.csv")).collect()]
    assert lines[0] == "Rank,Term,Reading,Frequency" and '1,"猫","猫",2' in lines
    recent = spark.createDataFrame([("犬", "犬と猫"), (None, "x")], "term string, sentence string")
    none = spark.createDataFrame([("y",)], "sentence string")
    flagged, sentences = engine.mined_state(table, none, none, recent)
    assert {r["lemma"] for r in flagged.filter("mined").collect()} == {"犬"} and {r[0] for r in sentences.collect()} == {"犬と猫", "x", "y"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=45))
def test_trimmed_mean(spark, sizes):
    df = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "source string, size long")
    each = len(sizes) // 20
    kept = sorted(sizes)[each : len(sizes) - each]
    assert corpus.trimmed_mean(df).first()["target"] == sum(kept) // len(kept)


def test_balance_by_ranges(spark):
    """Running sums by hash ranges are those over a whole source."""
    rng = random.Random(3)
    rows = [(i, f"s{min(i % 7, 3)}", rng.randrange(1, 90)) for i in range(600)]
    df = spark.createDataFrame(rows, "file_id long, source string, size long")
    got = {r["file_id"] for r in corpus.balance(df).collect()}
    total = {s: sum(r[2] for r in rows if r[1] == s) for s in {r[1] for r in rows}}
    target, want = sum(total.values()) // len(total), set()
    for s in total:
        before = 0
        for i, _, size in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
            want |= {i} if total[s] <= target or before < target else set()
            before += size
    assert got == want


def test_rank_is_competition(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 2)], "t string, n long")
    assert {r["t"]: r["rank"] for r in corpus.ranked(df).collect()} == {"a": 1, "b": 1, "c": 3}


def test_bands(spark):
    r = spark.createDataFrame([(1, 30.0), (2, None), (1_600, 90.0)], "rank long, interval double")
    rows = {x["band"]: x for x in summary.rank_bands(r, 2_000).collect()}
    assert set(rows) == {"<1.5k", "<3k"} and rows["<3k"]["total"] == 500 and rows["<1.5k"]["coverage"] == pytest.approx(2 / 1500)


def test_conflicts(spark):
    items = spark.createDataFrame([(1, "a b", 5, None), (2, "ab", 3, None), (3, "", 1, None), (4, "c", 1, None)], "item_id long, sentence string, ts long, picked boolean")
    assert [tuple(r) for r in mining.conflict_groups(items).collect()] == [("ab", 2, 1, 2)]
    assert sorted(tuple(r) for r in mining.conflict_items(items).collect()) == [("ab", 1), ("ab", 2)]
    assert {r["key"]: r["item_id"] for r in mining.keepers(items).collect()} == {"ab": 2, "c": 4}


def test_harvest(spark):
    notes = spark.createDataFrame([(1, "m", {"T": "いぬ", "R": "", "S": "<b>い ぬ</b>"}), (2, "x", {"T": "a"})], "note_id long, model string, fields map<string,string>")
    mapping = spark.createDataFrame([("m", "T", "R", "S")], "model string, term_field string, reading_field string, sentence_field string")
    assert [tuple(r) for r in mining.harvest(notes, mapping).collect()] == [(1, "いぬ", "いぬ", "いぬ")]


def test_columns():
    assert controls.reconcile_columns([("jlpt", False), ("term", False), ("x", True), ("jlpt", True)])[:2] == [("jlpt", False), ("term", True)]
