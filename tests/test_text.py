"""Text and naming functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from termflow.functions import japanese as J
from termflow.functions import naming as N
from termflow.functions import text as T


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("raw,want", [("&lt;i&gt;心の声&lt;/i&gt;", "<i>心の声</i>"), ("&amp;lt;", "&lt;"), ("パンケーキ&エッグ", "パンケーキ&エッグ"), ("&#12354;と&#x3042;", "あとあ"), ("&unknown; &#xZZ; &;", "&unknown; &#xZZ; &;"), ("", ""), (None, None), ("&#1114112;", "&#1114112;")])
def test_entities(one, raw, want):
    assert one(T.decode_entities(lit(raw)))[0] == want


@pytest.mark.parametrize("raw,want", [("&lt;i&gt;心の声&lt;/i&gt;", "心の声"), ('<font color="#fff">台詞</font>', "台詞"), ("{\\i1}斜体{\\i0}のまま", "斜体のまま"), ("次の行(つぎの ぎょー)です", "次の行です"), ("　a\n b　", "a b"), ("(田中)", "(田中)")])
def test_clean_subtitle(one, raw, want):
    assert one(T.clean_subtitle(lit(raw)))[0] == want


def test_sentences(one):
    assert one(T.split_sentences(lit("今日は良い天気。散歩に行く！")))[0] == ["今日は良い天気", "散歩に行く"]
    assert one(T.split_sentences(lit("...")))[0] == []


@pytest.mark.parametrize("preset,raw,want", [("parentheses", "（田中）こんにちは", "こんにちは"), ("lyric-lines", "♪ 夢の中へ", ""), ("lenticular", "【次回予告】続きへ", "続きへ")])
def test_presets(spark, one, preset, raw, want):
    assert one(T.apply_filters(lit(raw), T.compile_filters(spark, [preset])))[0] == want


def test_custom_filters(spark):
    assert len(T.compile_filters(spark, (), [("a", "b", True), ("c", "d", False)])) == 1
    assert T.compile_filters(spark, (), [("[unclosed", "", True), ("a", "$1", True)]) == []


def test_sentence_key(one):
    assert one(T.sentence_key(lit("毎日　パンを <b>食べる</b>。\n")), T.sentence_key(lit("<ruby>食<rt>た</rt></ruby>べる")), T.sentence_key(lit("a<b")))[:] == ("毎日パンを食べる。", "食たべる", "a")


def test_long_vowels(one):
    assert one(T.fold_long_vowels(lit("とおいねえおおお")), T.fold_long_vowels(lit("トオイ")), T.comparison_key(lit("トオイ")))[:] == ("とういねいおうお", "トオイ", "とうい")


NUMBERS = {"0": "ゼロ", "22": "ニジュウニ", "300": "サンビャク", "816": "ハッピャクジュウロク", "8000": "ハッセン", "12500": "イチマンニセンゴヒャク", "100000000": "イチオク", "2024": "ニセンニジュウヨン", "007": "ゼロゼロナナ", "12345678901234567": None, "12a": None}


@pytest.mark.parametrize("digits,want", NUMBERS.items())
def test_numbers(one, digits, want):
    assert J.number_to_katakana(digits) == want
    assert one(J.number_reading(lit(digits)))[0] == want


def test_deinflection():
    assert J.deinflection_pairs("行った", "いった") == [("行った", "いった"), ("行く", "いく"), ("行う", "いう"), ("行つ", "いつ"), ("行る", "いる"), ("行っる", "いっる")]
    assert J.deinflection_pairs("-（御", "x") == [("-（御", "x")]
    assert J.deinflection_pairs("𠮟った", "しかった") == [("𠮟った", "しかった")]
    assert ("食べる", "たべる") in J.deinflection_pairs("食べなかった", "たべなかった")
    assert ("美しい", "うつくしい") in J.deinflection_pairs("美しくて", "うつくしくて")


def test_furigana():
    assert J.furigana("話し掛ける", "はなしかける") == [("話", "はな"), ("し", None), ("掛", "か"), ("ける", None)]
    assert J.furigana("今日", "きょう") == [("今日", "きょう")]


def test_repetitive_katakana():
    assert J.repetitive_katakana("ドドド") and J.repetitive_katakana("ゴロゴロゴロ") and not J.repetitive_katakana("ゴロゴロ")


@pytest.mark.parametrize("name,kind,title,season,episode,year,source", [
    ("ダンダダン.S01E08.x.Netflix.ja[cc].srt", "tv", "ダンダダン", 1, 8, None, "Netflix"), ("Slam Dunk E001 [NF].srt", "tv", "Slam Dunk", None, 1, None, None),
    ("Your Name (2016) [1080p] BluRay.mkv", "movie", "Your Name", None, None, 2016, None), ("SHOW_NAME.srt", "generic", "Show Name", None, None, None, None),
])
def test_media(one, name, kind, title, season, episode, year, source):
    m = one(N.media(lit(name)).alias("m"))["m"]
    assert (m["kind"], m["title"], m["season"], m["episode"], m["year"], m["source"]) == (kind, title, season, episode, year, source)


def test_titles(one):
    assert one(N.clean_title(lit("[Release] show.name_here")), N.clean_title(lit("movie.title.en[cc]")))[:] == ("Show Name Here", "Movie Title")


def test_versions(one):
    assert one(N.is_newer(lit("0.6.1"), lit("0.6.0")), N.is_newer(lit("0.6.0b2"), lit("0.5")), N.is_newer(lit("1.0"), lit("1.0.0")))[:] == (True, False, False)


def test_templates(one):
    values = F.create_map(F.lit("expression"), F.lit("犬"))
    assert one(N.fill(lit("{expression} {oops"), values), N.fill(lit("{missing}x"), values))[:] == ("犬 {oops", "x")
    c = one(N.cloze(lit("毎日パンを食べる。"), lit("食べる")).alias("c"))["c"]
    assert tuple(c) == ("毎日パンを", "食べる", "。")


def test_clock(one):
    assert one(T.clock(F.lit(3_723_004)), T.milliseconds(lit("01:02:03,004")))[:] == ("01:02:03,004", 3_723_004)


def test_long_marks_and_romaji(one):
    from termflow.functions import japanese as J

    words = ["キノー", "ラーメン", "らーめん", "エーー", "ー", "スーパー"]
    want = ["きのう", "らあめん", "らーめん", "えええ", "ー", "すうぱあ"]
    assert list(one(*[T.to_hiragana(F.lit(w)) for w in words])) == [J.to_hiragana(w) for w in words] == want
    assert one(T.comparison_key(F.lit("ケーキ")))[0] == "けいき"
    assert [J.romaji_to_hiragana(w) for w in ("taberu", "gakkou", "shashin", "kon'ya", "onna", "chotto", "xyz1")] == ["たべる", "がっこう", "しゃしん", "こんや", "おんな", "ちょっと", "xyz1"]
    assert one(T.search(F.lit("毎日たべる"), "taberu"), T.search(F.lit("I eat"), "EAT"), T.search(F.lit("毎日"), "taberu"), T.search(F.lit("x"), ""))[:] == (True, True, False, True)


def test_filter_dry_run(spark):
    assert T.try_filters(spark, ["parentheses"], [("[0-9]+", "#", True), ("[unclosed", "", False)], "a(b) 12 ") == "a #"
    with pytest.raises(ValueError, match="unclosed"):
        T.try_filters(spark, [], [("[unclosed", "", True)], "x")
