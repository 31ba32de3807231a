"""Japanese kernels: number readings, deinflection, furigana. Plain Python, for use inside Arrow batches; `number_reading` also as a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIGITS = ["", "イチ", "ニ", "サン", "ヨン", "ゴ", "ロク", "ナナ", "ハチ", "キュウ"]
THOUSANDS = {1: "セン", 3: "サンゼン", 8: "ハッセン"}
HUNDREDS = {1: "ヒャク", 3: "サンビャク", 6: "ロッピャク", 8: "ハッピャク"}
MYRIADS = ["", "マン", "オク", "チョウ"]
LONGEST_NUMBER = 16
KANA = re.compile("^[ぁ-ゖゝゞァ-ヺー・ヽヾ]+$")
HIRAGANA = re.compile("^[ぁ-ゖー]+$")
KATAKANA = re.compile("^[ァ-ヺー・]+$")
KANJI = re.compile("[㐀-䶿一-鿿々]")
LONG_O, LONG_E = re.compile("([おこそとのほもよろごぞどぼぽ])お"), re.compile("([けせてねへめれげぜでべぺ])え")
#: Godan rows: dictionary ending, its a, i, e and o forms, and what its te-form ends with.
GODAN = [("う", "わ", "い", "え", "お", "って"), ("く", "か", "き", "け", "こ", "いて"), ("ぐ", "が", "ぎ", "げ", "ご", "いで"), ("す", "さ", "し", "せ", "そ", "して"), ("つ", "た", "ち", "て", "と", "って"), ("ぬ", "な", "に", "ね", "の", "んで"), ("ぶ", "ば", "び", "べ", "ぼ", "んで"), ("む", "ま", "み", "め", "も", "んで"), ("る", "ら", "り", "れ", "ろ", "って")]
#: What follows the forms of a verb.
AFTER_A = ["ない", "なかった", "なくて", "なければ", "なきゃ", "ず", "ずに", "れる", "れた", "れて", "せる", "せた", "せて"]
AFTER_I = ["", "ます", "ました", "ましょう", "ません", "たい", "たかった", "たくて", "ながら", "そう", "すぎる", "なさい"]
AFTER_E = ["", "ば", "る", "た", "て", "ない", "ます", "ました"]
AFTER_ICHIDAN = ["ない", "なかった", "なくて", "なければ", "なきゃ", "ず", "ずに", "た", "て", "たり", "たら", "ます", "ました", "ましょう", "ません", "たい", "たかった", "ながら", "そう", "すぎる", "られる", "られた", "られて", "させる", "させた", "させて", "れば", "よう", "ろ", "よ"]
AFTER_ADJECTIVE = ["げ", "く", "くて", "くない", "くなかった", "かった", "ければ", "さ", "そう", "すぎる", "くなる"]


#: Hiragana of each consonant's syllables, in the order of the vowels.
ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
#: Consonant signs before small ya, yu, yo: the kana they begin with, and other spellings.
GLIDES = {"ky": "き", "sy": "し", "sh": "し", "ty": "ち", "ch": "ち", "ny": "に", "hy": "ひ", "my": "み", "ry": "り", "gy": "ぎ", "zy": "じ", "j": "じ", "jy": "じ", "by": "び", "py": "ぴ"}


def _syllables() -> dict[str, str]:
    """Spelling -> hiragana."""
    out = {c + v: kana for c, row in ROWS.items() for v, kana in zip("aiueo", row, strict=True)}
    out |= {c + v: first + small for c, first in GLIDES.items() for v, small in (("a", "ゃ"), ("u", "ゅ"), ("o", "ょ"))}
    return out | {"shi": "し", "she": "しぇ", "chi": "ち", "che": "ちぇ", "tsu": "つ", "fu": "ふ", "ji": "じ", "je": "じぇ", "fa": "ふぁ", "fi": "ふぃ", "fe": "ふぇ", "fo": "ふぉ", "ya": "や", "yu": "ゆ", "yo": "よ", "wa": "わ", "wo": "を", "vu": "ゔ", "n'": "ん", "-": "ー"}


SYLLABLES = _syllables()
#: The vowel that a long mark after a katakana of these rows stands for.
LONG_MARKS = {"あ": "ァアカガサザタダナハバパマャヤラヮワヵ", "い": "ィイキギシジチヂニヒビピミリヰ", "う": "ゥウクグスズツヅヌフブプムュユルヴォオコゴソゾトドノホボポモョヨロヲ", "え": "ェエケゲセゼテデネヘベペメレヱヶ"}
VOWEL = {c: v for v, row in LONG_MARKS.items() for c in row}


def small_number(n: int) -> str:
    """Reading of 1 to 9999."""
    t, h, z, e = n // 1000, n // 100 % 10, n // 10 % 10, n % 10
    out = THOUSANDS.get(t, DIGITS[t] + "セン") if t else ""
    out += HUNDREDS.get(h, DIGITS[h] + "ヒャク") if h else ""
    return out + ((DIGITS[z] if z > 1 else "") + "ジュウ" if z else "") + DIGITS[e]


def number_to_katakana(digits: str) -> str | None:
    """Reading of a decimal number; digit by digit with leading zeros; None over sixteen digits or with other characters."""
    if not re.fullmatch("[0-9]{1,16}", digits):
        return None
    if len(digits) > 1 and digits[0] == "0":
        return "".join(DIGITS[int(d)] or "ゼロ" for d in digits)
    groups = [int(digits[max(0, len(digits) - 4 * (k + 1)) : len(digits) - 4 * k]) for k in range((len(digits) + 3) // 4)]
    return "".join(small_number(g) + MYRIADS[k] for k, g in reversed(list(enumerate(groups))) if g) or "ゼロ"


def number_reading(digits: Column) -> Column:
    """`number_to_katakana` as a column expression."""
    table = lambda values: F.array(*map(F.lit, values))
    irregular = lambda own, unit: table([own.get(d, DIGITS[d] + unit) if d else "" for d in range(10)])
    places = [table(DIGITS), table(["", "ジュウ", *[d + "ジュウ" for d in DIGITS[2:]]]), irregular(HUNDREDS, "ヒャク"), irregular(THOUSANDS, "セン")]
    padded = F.lpad(digits, LONGEST_NUMBER, "0")
    digit = lambda i: F.substring(padded, LONGEST_NUMBER - i, 1).cast("int")
    groups = []
    for k in reversed(range(4)):
        read = F.concat(*[F.get(places[p], digit(4 * k + p)) for p in (3, 2, 1, 0)])
        groups.append(F.when(read != "", F.concat(read, F.lit(MYRIADS[k]))).otherwise(""))
    each = F.array_join(F.transform(F.split(digits, "(?<!^)(?!$)"), lambda d: F.get(table(["ゼロ", *DIGITS[1:]]), d.cast("int"))), "")
    number = F.concat(*groups)
    return F.when(~digits.rlike("^[0-9]{1,16}$"), None).when((F.length(digits) > 1) & digits.startswith("0"), each).otherwise(F.when(number == "", "ゼロ").otherwise(number))


def fold_katakana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def to_hiragana(text: str) -> str:
    """Katakana as hiragana, long marks after them as vowels; a mark after anything else stays."""
    out, vowel = "", ""
    for c in text:
        if c == "ー" and vowel:
            out += vowel
            continue
        vowel = VOWEL.get(c, "")
        out += fold_katakana(c)
    return out


def romaji_to_hiragana(text: str) -> str:
    """Lower-case Latin letters read as kana, longest syllables first; what is no syllable stays."""
    out, at = "", 0
    while at < len(text):
        c, after = text[at], text[at + 1 : at + 2]
        if c == after and c in "kstcpgzdbfhjmryw":
            out, at = out + "っ", at + 1
            continue
        for n in (4, 3, 2, 1):
            if text[at : at + n] in SYLLABLES:
                out, at = out + SYLLABLES[text[at : at + n]], at + n
                break
        else:
            if c == "n":  # before a consonant or the end
                out, at = out + "ん", at + 1
            else:
                out, at = out + c, at + 1
    return out


def to_katakana(text: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)


def fold_long_vowels(text: str) -> str:
    return LONG_E.sub(r"\1い", LONG_O.sub(r"\1う", text)) if HIRAGANA.match(text) else text


def reading_key(surface: str, reading: str) -> str:
    """A reading in the script of its surface."""
    return to_katakana(reading) if KATAKANA.match(surface) else fold_long_vowels(to_hiragana(reading))


def _table() -> dict[str, list[str]]:
    """Ending -> dictionary endings, in the order of the rows."""
    out: dict[str, list[str]] = {}

    def add(ending: str, to: str) -> None:
        if to not in out.setdefault(ending, []):
            out[ending].append(to)

    add("った", "く")
    add("って", "く")  # only 行く
    for u, a, i, e, o, te in GODAN:
        for x in AFTER_A:
            add(a + x, u)
        for x in AFTER_I:
            add(i + x, u)
        for x in AFTER_E:
            add(e + x, u)
        add(o + "う", u)
        voiced = te[-1] == "で"
        for x in ("て", "た", "たら", "たり", "ている", "ていた", "てる", "てた"):
            add(te[:-1] + ("でだ"[x[0] == "た"] if voiced else x[0]) + x[1:], u)
    for x in ("した", "して", "しない", "します", "しました", "したい", "される", "させる", "しろ", "すれば", "しよう", "している"):
        add(x, "する")
    for x in ("きた", "きて", "こない", "きます", "こられる", "こよう"):
        add(x, "くる")
    for x in AFTER_ICHIDAN:
        add(x, "る")
    for x in AFTER_ADJECTIVE:
        add(x, "い")
    return out


DEINFLECT = _table()
LONGEST_ENDING = max(map(len, DEINFLECT))


def deinflect(word: str) -> list[str]:
    """Possible dictionary forms of an inflected word: longest endings first, then in the table's order."""
    out: list[str] = []
    for n in range(min(LONGEST_ENDING, len(word) - 1), 0, -1):
        for to in DEINFLECT.get(word[-n:], ()):
            if (form := word[:-n] + to) != word and form not in out:
                out.append(form)
    return out


def deinflection_pairs(word: str, reading: str) -> list[tuple[str, str]]:
    """The word itself, then its candidates, each with the reading adjusted: the kanji base is replaced by the base's reading.

    Words with a character that isn't three bytes long in UTF-8 are only themselves.
    """
    out = [(word, reading)]
    if any(len(c.encode()) != 3 for c in word):
        return out
    tail = len(word) - len(word.rstrip("".join(c for c in set(word) if KANA.match(c))))
    base, base_reading = word[: len(word) - tail], reading[: max(0, len(reading) - tail)]
    return out + [(form, form.replace(base, base_reading, 1) if base else base_reading + form) for form in deinflect(word)]


def repetitive_katakana(surface: str) -> bool:
    """A one or two character unit three times in a row, in katakana."""
    return bool(KATAKANA.match(surface)) and re.search(r"(.{1,2}?)\1{2,}", surface) is not None


def furigana(surface: str, reading: str) -> list[tuple[str, str | None]]:
    """(run, its reading; None for kana): kana runs anchor the reading; a word that can't be aligned is one run."""
    runs = re.findall("[㐀-䶿一-鿿々]+|[^㐀-䶿一-鿿々]+", surface)
    key = fold_katakana(reading)
    pattern = "".join("(.+?)" if KANJI.match(r) else f"({re.escape(fold_katakana(r))})" for r in runs)
    m = re.fullmatch(pattern, key)
    if not m:
        return [(surface, reading if reading and key != fold_katakana(surface) else None)]
    return [(r, reading[m.start(k + 1) : m.end(k + 1)] if KANJI.match(r) else None) for k, r in enumerate(runs)]
