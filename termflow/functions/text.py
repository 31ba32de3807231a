"""Per-row text transforms as Column -> Column functions; everything stays inside the JVM.

Java's `\\s` and Spark's `trim` know ASCII white space only, so patterns use `(?U)`. Defined for null:
the result is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from termflow.functions.japanese import LONG_MARKS, romaji_to_hiragana

# Patterns and code points that results depend on.
#: Code points that the script extension property of Hiragana covers.
HIRAGANA_EXTENDED = "、-〃〈-】〓-〟〰-〵〷〼〽ぁ-ゖ゙-゠・ー﹅﹆｡-･ｰﾞﾟ\U0001b001-\U0001b11f\U0001b123\U0001b132\U0001b150-\U0001b152\U0001f200"
KANA_READING = rf"(?U)[(（][{HIRAGANA_EXTENDED}・･\s]+[)）]"
INLINE_TAG = r"(?i)</?[a-z][^<>]*>|\{\\[^}]*\}"
SENTENCE_END = "[。！？｡!?.]+"
NAMED_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "#39": "'", "nbsp": " "}
#: Characters between & and ; at most.
LONGEST_ENTITY = 8
#: Preset filters in the order they are applied.
FILTER_PRESETS = {"parentheses": "[（(][^（）()]*[）)]", "lyric-lines": "^.*[♪♫♬].*$", "lenticular": "【[^【】]*】", "angle": "《[^《》]*》"}
O_ROW, E_ROW = "おこそとのほもよろごぞどぼぽ", "けせてねへめれげぜでべぺ"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
KANJI = "㐀-䶿一-鿿々"
JAPANESE = f"[぀-ヿ{KANJI}ｦ-ﾟ０-９Ａ-Ｚａ-ｚ！-／：-＠［-｀｛-･　-〿]"


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(trim(text), r"(?U)\s+", " ")


def character(code: Column) -> Column:
    """The character of a code point; null if it is no scalar value."""
    valid = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Decode character references once: `&amp;lt;` becomes `&lt;`. Unknown ones stay as they are.

    The text is cut before each `&`; a piece is decoded by its own beginning alone, so nothing that was
    decoded is read again.
    """

    def piece(p: Column) -> Column:
        end = F.instr(p, ";")
        name = F.substring(p, F.lit(2), end - 2)
        rest = F.substring(p, end + 1, F.length(p))
        out = reduce(lambda c, kv: c.when(name == kv[0], kv[1]), NAMED_ENTITIES.items(), F.when(F.lit(False), ""))
        hexa = F.when(name.rlike("^#[xX][+]?[0-9a-fA-F]{1,8}$"), character(F.conv(F.regexp_replace(name, "^#[xX][+]?", ""), 16, 10).cast("long")))
        number = F.when(name.rlike("^#[+]?[0-9]{1,10}$"), character(F.regexp_replace(name, "^#[+]?", "").cast("long")))
        done = F.coalesce(out, hexa, number)
        return F.when((F.substring(p, 1, 1) == "&") & (end > 0) & (F.octet_length(name) <= LONGEST_ENTITY) & done.isNotNull(), F.concat(done, rest)).otherwise(p)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def drop_kana_readings(text: Column) -> Column:
    """Without parentheses that hold only a reading in hiragana."""
    return F.regexp_replace(text, KANA_READING, "")


def strip_tags(text: Column) -> Column:
    """Without markup tags and `{\\...}` overrides."""
    return F.regexp_replace(text, INLINE_TAG, "")


def clean_subtitle(text: Column) -> Column:
    """A cue's text: references decoded, white space collapsed, readings and tags dropped."""
    return trim(strip_tags(drop_kana_readings(collapse(decode_entities(text)))))


def split_sentences(line: Column) -> Column:
    """The cleaned sentences of a line, in order: cut at sentence ends first, so a delimiter inside a tag cuts too."""
    parts = F.transform(F.split(trim(line), SENTENCE_END), lambda p: trim(strip_tags(drop_kana_readings(decode_entities(trim(p))))))
    return F.filter(parts, lambda p: p != "")


def compile_filters(spark: SparkSession, presets: Sequence[str] = (), rules: Sequence[tuple[str, str, bool]] = ()) -> list[tuple[str, str]]:
    """(pattern, replacement) of the enabled presets in table order, then of the enabled custom rules (pattern, replacement, enabled) that compile."""
    out = [(pattern, "") for name, pattern in FILTER_PRESETS.items() if name in presets]
    return out + [(p, r) for p, r, on in rules if on and filter_error(spark, p, r) is None]


def apply_filters(text: Column, filters: Sequence[tuple[str, str]]) -> Column:
    """All filters in order, then trimmed."""
    return trim(reduce(lambda c, f: F.regexp_replace(c, f[0], f[1]), filters, text))


def is_hiragana(text: Column) -> Column:
    return text.rlike("^[ぁ-ゖー]+$")


def is_katakana(text: Column) -> Column:
    return text.rlike("^[ァ-ヺー・]+$")


def is_kana(text: Column) -> Column:
    """Only kana, at least one."""
    return text.rlike("^[ぁ-ゖゝゞァ-ヺー・ヽヾ]+$")


def is_all_kana(text: Column) -> Column:
    """Only characters of the kana blocks; true for an empty text."""
    return text.rlike("^[぀-ヿ]*$")


def is_japanese(text: Column) -> Column:
    """Only kana, kanji, full-width forms and CJK punctuation, at least one."""
    return text.rlike(f"^{JAPANESE}+$")


def has_kanji(text: Column) -> Column:
    return text.rlike(f"[{KANJI}]")


def all_kanji(text: Column) -> Column:
    return text.rlike(f"^[{KANJI}]+$")


def fold_katakana(text: Column) -> Column:
    """Katakana letters as hiragana; everything else, the long mark too, stays."""
    return F.translate(text, KATAKANA, HIRAGANA)


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def to_hiragana(text: Column) -> Column:
    """Katakana as hiragana, long marks after them as vowels; a mark after anything else stays."""
    marked = reduce(lambda c, kv: F.regexp_replace(c, f"(?<=[{kv[1]}]ー{{0,20}})ー", kv[0]), LONG_MARKS.items(), text)
    return fold_katakana(F.when(F.contains(text, F.lit("ー")), marked).otherwise(text))


def fold_long_vowels(text: Column) -> Column:
    """お after an o-row kana becomes う and え after an e-row kana い, in texts of hiragana only."""
    return F.when(is_hiragana(text), F.regexp_replace(F.regexp_replace(text, f"([{O_ROW}])お", "$1う"), f"([{E_ROW}])え", "$1い")).otherwise(text)


def comparison_key(text: Column) -> Column:
    """Hiragana with folded long vowels: how readings are compared."""
    return fold_long_vowels(to_hiragana(text))


def reading_key(surface: Column, reading: Column) -> Column:
    """A reading in the script of its surface: katakana stays katakana."""
    return F.when(is_katakana(surface), to_katakana(reading)).otherwise(comparison_key(reading))


def keep_kana(text: Column) -> Column:
    return F.regexp_replace(text, "[^ぁ-ゖゝゞァ-ヺーヽヾ]", "")


def sentence_key(text: Column, tags: bool = True) -> Column:
    """What sentences are matched by: no tags (an unclosed one swallows the rest), no white space."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]*(?:>|$)", ""), "&nbsp;", " ") if tags else text
    return F.regexp_replace(bare, r"(?U)\s+", "")


def text_matches(text: Column, query: Column) -> Column:
    """Whether the query is found: by comparison key, or without regard to case."""
    return (query == "") | F.contains(comparison_key(text), comparison_key(query)) | F.contains(F.lower(text), F.lower(query))


def search(text: Column, query: str) -> Column:
    """`text_matches` of a query as it was typed, in Latin letters too: those are read as kana as well."""
    found = text_matches(text, F.lit(query))
    kana = romaji_to_hiragana(query.lower())
    return found | F.contains(comparison_key(text), comparison_key(F.lit(kana))) if kana != query.lower() else found


def filter_error(spark: SparkSession, pattern: str, replacement: str = "") -> str | None:
    """What the JVM says of a custom pattern that it can't compile, on one row; None if it can."""
    try:
        spark.range(1).select(F.regexp_replace(F.lit("x"), f"(?:{pattern})|(?s:.)", replacement)).collect()  # the second branch uses the replacement
    except Exception as e:
        return str(e).splitlines()[0]
    return None


def try_filters(spark: SparkSession, presets: Sequence[str], rules: Sequence[tuple[str, str, bool]], sample: str) -> str:
    """A sample text under presets and custom rules; an enabled rule that doesn't compile is an error here, not skipped."""
    for pattern, replacement, on in rules:
        if on and (error := filter_error(spark, pattern, replacement)) is not None:
            raise ValueError(f'invalid pattern "{pattern}": {error}')
    return spark.range(1).select(apply_filters(F.lit(sample), compile_filters(spark, presets, rules)).alias("text")).first()["text"]


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two UTF-8 byte places."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def seconds(ms: Column) -> Column:
    """Milliseconds of a day as seconds; days wrap."""
    return (ms % 86_400_000) / 1000.0


def clock(ms: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds; days wrap."""
    t = ms % 86_400_000
    div = lambda n: F.floor(t / n)
    return F.format_string("%02d:%02d:%02d,%03d", div(3_600_000), div(60_000) % 60, div(1000) % 60, t % 1000)


def milliseconds(stamp: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm (or a point; fewer digits count as fractions)."""
    part = lambda k: F.regexp_extract(stamp, r"(\d+):(\d{1,2}):(\d{1,2})[,.]?(\d{0,3})", k)
    return (part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")) * 1000 + F.rpad(part(4), 3, "0").cast("long")


def html_lines(html: Column) -> Column:
    """Text lines of well-formed markup: scripts, styles, heads and ruby readings dropped, block ends cut lines, references decoded."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>|<(rt|rp|script|style|head|title)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|body|br|hr|dd|dt|dl|figure|figcaption|pre)\b[^>]*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^<>]*>", ""))
    return F.filter(F.transform(F.split(out, "\n"), trim), lambda x: x != "")
