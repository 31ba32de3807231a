"""Corpus statistics: counts, ranks, balancing, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termflow.functions import text as T

# Parts of speech that aren't counted, and signs that are no terms.
SKIPPED_POS = ["Onomatopoeia", "Number"]
PUNCTUATION = [
    "。", "｡", "、", "！", "？", "‼", "⁉",
    "・", "･", "…", "～", "〜", "ー",
    "「", "」", "『", "』", "【", "】",
    "（", "）", "｟", "｠", "《", "》",
    "(", ")", "[", "]", "{", "}",
    ",", ".", "!", "?", ";", ":",
    '"', "'", "`", "´", "“", "”",
    "-", "–", "—", "―", "_", "＿",
    "/", "\\", "|", "｜",
    "*", "＊", "※", "☆", "★",
    "♪", "♬", "♫", "♩",
    "→", "←", "↑", "↓", "➡", "⇒",
    "○", "●", "◯", "◎", "□", "■",
    "◆", "◇", "△", "▲", "▽", "▼",
    "　",
    "＃", "#", "&", "＆", "@", "＠",
    "+", "＋", "=", "＝", "<", ">",
    "＜", "＞", "≪", "≫",
    "%", "％", "$", "￥", "¥",
    "°", "℃", "℉",
    "〒", "§",
]
TRIM_TENTHS, PREVIEW = 1, 250
#: Hexadecimal digits of a file's hash that make its range: 4096 ranges.
RANGE_DIGITS = 3
HAPAX = 1


def excluded_token(surface: Column) -> Column:
    """Blank, not Japanese, or a listed sign."""
    return (T.trim(surface) == "") | ~T.is_japanese(surface) | surface.isin(PUNCTUATION)


def tokens_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source, ord and token of the default tokenizer: lower-cased runs of letters."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    return documents.select("doc_id", "lang", "source", F.posexplode(words).alias("ord", "token"))


def count_surfaces(terms: DataFrame, any_script: bool = False) -> DataFrame:
    """surface, reading, n over all files; a full segment that differs from the surface counts as well, under its own reading.

    `terms` has (surface, surface_reading, full_segment, full_reading, pos). With `any_script` words needn't be Japanese.
    """
    excluded = (T.trim(F.col("surface")) == "") | F.col("surface").isin(PUNCTUATION) if any_script else excluded_token(F.col("surface"))
    keep = terms.filter(~F.col("pos").isin(SKIPPED_POS) & ~excluded)
    main = F.struct(F.col("surface").alias("surface"), F.col("surface_reading").alias("reading"), F.lit(1).alias("main"))
    full = F.struct(F.col("full_segment").alias("surface"), F.col("full_reading").alias("reading"), F.lit(0).alias("main"))
    both = F.when((F.col("full_segment") != "") & (F.col("full_segment") != F.col("surface")), F.array(main, full)).otherwise(F.array(main))
    return keep.select(F.explode(both).alias("t")).groupBy("t.surface", "t.reading").agg(F.count("*").alias("n"), F.sum("t.main").cast("long").alias("n_main"))


def merge_lemmas(counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """lemma, reading (null for a kana lemma), n: surface counts under their lemma (surface, reading, lemma, lemma_reading), or themselves."""
    m = lemmas.select(F.col("surface").alias("_s"), F.col("reading").alias("_r"), "lemma", "lemma_reading")
    df = counts.join(m, (F.col("surface") == F.col("_s")) & F.col("reading").eqNullSafe(F.col("_r")), "left")
    lemma, reading = F.coalesce("lemma", "surface"), F.coalesce("lemma_reading", "reading")
    return df.groupBy(lemma.alias("lemma"), F.when(~T.is_kana(lemma), reading).alias("reading")).agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, n: str = "n", drop_hapax: bool = False) -> DataFrame:
    """Competition rank (1, 1, 3) by descending count.

    Ranks are sums over the distinct counts, which are few, so no task sorts all terms: a term's rank is
    one more than the number of terms with a larger count.
    """
    if drop_hapax:
        counts = counts.filter(F.col(n) > HAPAX)
    sizes = counts.groupBy(n).agg(F.count("*").alias("_same"))
    above = Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select(F.col(n).alias("_n"), (F.coalesce(F.sum("_same").over(above), F.lit(0)) + 1).alias("rank"))
    return counts.join(ranks, F.col(n) == F.col("_n")).drop("_n")


def preview(counts: DataFrame, keys: list[tuple[str, bool]], size: int = PREVIEW) -> tuple[DataFrame, DataFrame]:
    """The first and the last `size` rows by keys (column, descending); both are top-k plans, not full sorts."""
    order = lambda turn: [F.desc(k) if down != turn else F.asc(k) for k, down in keys]
    return counts.orderBy(*order(False)).limit(size), counts.orderBy(*order(True)).limit(size)


def source_sizes(files: DataFrame) -> DataFrame:
    """source, size, n of files (source, size)."""
    return files.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def trimmed_mean(sizes: DataFrame) -> DataFrame:
    """One row, target: whole mean of the sizes without a twentieth at each end (from twenty sources on)."""
    n = sizes.agg(F.count("*").alias("n_sources")).withColumn("cut", F.expr("n_sources div 20"))
    place = Window.orderBy("size", "source")  # one row per source
    rows = sizes.select("size", F.row_number().over(place).alias("nth")).crossJoin(F.broadcast(n))  # n is one row
    return rows.filter((F.col("nth") > F.col("cut")) & (F.col("nth") <= F.col("n_sources") - F.col("cut"))).agg(F.expr("sum(size) div count(*)").alias("target"))


def balance(files: DataFrame, salt: str = "") -> DataFrame:
    """Files (file_id, source, size) of a balanced corpus: all of a source within the target, else files in shuffled order while what came before is under the target.

    The order is a hash of the id, so a run can be repeated; with one source nothing is dropped. What came before
    is the sum of the earlier hash ranges and of the own range so far, so no task sorts all files of a source.
    """
    sizes = source_sizes(files)
    target = trimmed_mean(sizes).crossJoin(F.broadcast(sizes.agg(F.count("*").alias("n_sources"))))  # one row each
    df = files.join(sizes.select("source", F.col("size").alias("total")), "source").crossJoin(F.broadcast(target))
    digest = F.md5(F.concat(F.lit(salt), F.col("file_id").cast("string")))
    df = df.withColumns({"_digest": digest, "_range": F.substring(digest, 1, RANGE_DIGITS)})
    earlier = Window.partitionBy("_source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges of a source
    ranges = df.groupBy(F.col("source").alias("_source"), F.col("_range").alias("_r")).agg(F.sum("size").alias("_sum"))
    ranges = ranges.select("_source", "_r", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    own = Window.partitionBy("source", "_range").orderBy("_digest", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(ranges, (F.col("source") == F.col("_source")) & (F.col("_range") == F.col("_r")))
    df = df.withColumn("before", F.col("_earlier") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    keep = (F.col("n_sources") <= 1) | (F.col("total") <= F.col("target")) | (F.col("before") < F.col("target"))
    return df.filter(keep).select("file_id", "source", "size", "target")


def append_new(corpus: DataFrame, fetched: DataFrame, text: str = "text") -> DataFrame:
    """`corpus` with the fetched sentences that it doesn't have, each once; blank ones are left out. Rows of `corpus` stay as they are."""
    new = fetched.select(text).filter(T.trim(F.col(text)) != "").distinct().join(corpus.select(F.col(text).alias("_have")), F.col(text) == F.col("_have"), "left_anti")
    return corpus.select(text).unionByName(new)


def sampled(files: DataFrame, share: int, of: int, key: str = "file_id") -> DataFrame:
    """A repeatable sample: ids whose hash falls into `share` of `of` parts."""
    return files.filter(F.pmod(F.xxhash64(key), F.lit(of)) < share)


def review_lines(lines: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Lines (file_id, ord, line) for review: no timing or ASCII-only lines, no line that repeats the one before, `n` in shuffled order."""
    real = lines.filter(~F.col("line").rlike("-->") & F.col("line").rlike(r"[^\x00-\x7f]"))
    before = F.lag("line").over(Window.partitionBy("file_id").orderBy("ord"))
    return real.withColumn("_before", before).filter("_before IS NULL OR _before <> line").drop("_before").orderBy(F.xxhash64("file_id", "ord", F.lit(seed)), "file_id", "ord").limit(n)
