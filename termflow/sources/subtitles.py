"""Subtitle and plain text sources: files -> sentences.

A sentence is (path, ord, text, start_ms, end_ms): one dense `ord` in file order. Files are read whole,
one row each, as a cue spans lines. Files that give nothing are reported, not fatal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.functions import naming as N
from termflow.functions import text as T

TIMING = r"(\d+:\d{1,2}:\d{1,2}[,.]?\d{0,3})\s*-->\s*(\d+:\d{1,2}:\d{1,2}[,.]?\d{0,3})"
SUPPORTED = ["SRT", "SSA", "TXT", "EPUB"]


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, type, content of all files under a path, byte order marks dropped, line ends made \\n."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    content = F.regexp_replace(F.regexp_replace("value", "^﻿+", ""), "\r\n?", "\n")
    return df.select(F.input_file_name().alias("path"), content.alias("content")).withColumn("type", N.file_type(F.col("path")))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """With a dense ord in each file."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1)


def srt_cues(files: DataFrame) -> DataFrame:
    """path, cue, start_ms, end_ms, raw of SRT files: blocks between blank lines that have a timing line."""
    blocks = files.select("path", F.posexplode(F.split("content", r"\n[ \t]*\n")).alias("cue", "block"))
    raw = F.regexp_extract("block", rf"(?s){TIMING}[^\n]*\n(.*)$", 3)
    stamp = lambda k: T.milliseconds(F.regexp_extract("block", TIMING, k))
    return blocks.filter(F.col("block").rlike(TIMING)).select("path", "cue", stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), raw.alias("raw"))


def ssa_cues(files: DataFrame) -> DataFrame:
    """path, cue, start_ms, end_ms, raw of the Dialogue lines of SSA and ASS files, by start."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line")).filter(F.col("line").startswith("Dialogue:"))
    part = F.split("line", ",", 10)
    stamp = lambda k: T.milliseconds(F.regexp_replace(T.trim(F.get(part, F.lit(k))), r"\.(\d\d)$", ".$10"))
    raw = F.regexp_replace(F.get(part, F.lit(9)), r"\\[Nn]", "\n")
    df = lines.select("path", F.struct(stamp(1), "n").alias("cue"), stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), raw.alias("raw"))
    return df.filter("raw IS NOT NULL")


def cue_sentences(cues: DataFrame) -> DataFrame:
    """Sentences of cues; empty ones, also after cleaning, are dropped."""
    df = cues.filter(F.trim("raw") != "").withColumn("text", T.clean_subtitle(F.col("raw"))).filter("text <> ''")
    return numbered(df, ["cue"]).select("path", "ord", "text", "start_ms", "end_ms")


def line_sentences(lines: DataFrame, order: list[str]) -> DataFrame:
    """Sentences of lines (path, line, order columns)."""
    df = lines.select("path", *order, F.posexplode(T.split_sentences(F.col("line"))).alias("_part", "text"))
    none = F.lit(None).cast("long")
    return numbered(df, [*order, "_part"]).select("path", "ord", "text", none.alias("start_ms"), none.alias("end_ms"))


def txt_sentences(files: DataFrame) -> DataFrame:
    """Sentences of plain text files."""
    return line_sentences(files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line")), ["n"])


def read_sentences(spark: SparkSession, path: str, filters: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sentences of all supported files under a path, and skipped (path, type, reason).

    With filters, texts they empty are dropped and the rest is numbered anew.
    """
    from termflow.sources.books import chapter_lines, read_books

    files = whole_files(spark, path, "*.{srt,SRT,ass,ASS,ssa,SSA,txt,TXT}")
    of = lambda kind: files.filter(F.col("type") == kind)
    parts = [cue_sentences(srt_cues(of("SRT"))), cue_sentences(ssa_cues(of("SSA"))), txt_sentences(of("TXT"))]
    books = chapter_lines(read_books(spark, path)).select("path", F.struct("chapter", "ord").alias("_o"), "line")
    parts.append(line_sentences(books, ["_o"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if filters:
        out = out.withColumn("text", T.apply_filters(F.col("text"), filters)).filter("text <> ''").withColumnRenamed("ord", "_old")
        out = numbered(out, ["_old"]).select("path", "ord", "text", "start_ms", "end_ms")
    everything = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").withColumn("type", N.file_type(F.col("path")))
    reason = F.when(~F.col("type").isin(SUPPORTED), "unsupported file type").otherwise("no text")
    skipped = everything.join(out.select(F.regexp_replace("path", "^file:/+", "/").alias("_p")).distinct(), F.regexp_replace("path", "^file:/+", "/") == F.col("_p"), "left_anti")
    return out, skipped.select("path", "type", reason.alias("reason"))


def listed(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, size of files whose extension, in this very case, is listed; from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    return files.filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(extensions))
