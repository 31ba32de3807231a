"""Sinks: rank lists, dictionary archives, subtitles, lists."""

from __future__ import annotations

import datetime
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.functions import naming as N
from termflow.functions import text as T
from termflow.operators.corpus import ranked


def frequency_lines(counts: DataFrame, drop_hapax: bool = False) -> DataFrame:
    """ord, line of the CSV export: header, then rank, quoted term and reading (an empty one for null, quotes inside as they are), count; by descending count."""
    df = ranked(counts, drop_hapax=drop_hapax)
    line = F.format_string('%d,"%s","%s",%d', F.col("rank").cast("long"), "lemma", F.coalesce("reading", F.lit("")), "n")
    order = F.struct((-F.col("n")).alias("n"), "lemma", "reading")
    head = df.sparkSession.createDataFrame([("Rank,Term,Reading,Frequency",)], "line string").select(F.lit(None).cast(df.select(order.alias("o")).schema["o"].dataType).alias("ord"), "line")
    return head.unionByName(df.select(order.alias("ord"), line.alias("line")))


def write_frequency_csv(counts: DataFrame, path: str, drop_hapax: bool = False) -> None:
    """One text file in order."""
    frequency_lines(counts, drop_hapax).orderBy(F.asc_nulls_first("ord")).select("line").coalesce(1).write.mode("overwrite").text(path)


def dictionary_rows(counts: DataFrame, drop_hapax: bool = False) -> DataFrame:
    """rank, lemma, row (JSON) of a rank dictionary: a kana lemma has its rank alone, any other its reading as well."""
    df = ranked(counts, drop_hapax=drop_hapax).withColumn("rank", F.col("rank").cast("long"))
    reading = T.fold_long_vowels(T.fold_katakana(F.col("reading")))
    simple = F.concat(F.lit("["), F.to_json(F.struct("lemma")).substr(F.lit(10), F.length(F.to_json(F.struct("lemma"))) - 10), F.lit(',"freq",'), F.col("rank").cast("string"), F.lit("]"))
    nested = F.concat(F.lit("["), F.to_json(F.struct("lemma")).substr(F.lit(10), F.length(F.to_json(F.struct("lemma"))) - 10), F.lit(',"freq",'), F.to_json(F.struct(reading.alias("reading"), F.col("rank").alias("frequency"))), F.lit("]"))
    return df.select("rank", "lemma", "reading", F.when(T.is_kana(F.col("lemma")) | F.col("reading").isNull(), simple).otherwise(nested).alias("row"))


def write_dictionary_zip(counts: DataFrame, path: str, title: str, prefix: str = "", description: str = "", drop_hapax: bool = False, pretty: bool = False, today: datetime.date | None = None) -> None:
    """A rank dictionary archive; rows are made by the executors and streamed in order, a partition at a time."""
    day = (today or datetime.date.today()).isoformat()
    index = {"title": title, "revision": f"{prefix}.frequency.{day}" if prefix else day, "format": 3, "frequencyMode": "rank-based", "description": description}
    rows = dictionary_rows(counts, drop_hapax).orderBy("rank", "lemma", "reading").select("row")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("index.json", json.dumps(index, ensure_ascii=False, indent=2 if pretty else None))
        with z.open("term_meta_bank_1.json", "w") as f:
            f.write(b"[")
            for n, r in enumerate(rows.toLocalIterator()):
                f.write((",\n" if n and pretty else "," if n else "").encode() + r["row"].encode())
            f.write(b"]")


def srt_blocks(cues: DataFrame) -> DataFrame:
    """path, ord, block of cues (path, ord, text, start_ms, end_ms), numbered from one."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    return cues.select("path", "ord", F.concat_ws("\n", n.cast("string"), F.concat(T.clock(F.col("start_ms")), F.lit(" --> "), T.clock(F.col("end_ms"))), F.col("text"), F.lit("")).alias("block"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One subtitle file in cue order."""
    srt_blocks(cues).orderBy("path", "ord").select("block").coalesce(1).write.mode("overwrite").text(path)


def save_srt(cues: DataFrame, folder: str, title: str) -> str:
    """A video's cues under a name made of its title; written over what an earlier load of it left. Returns the path."""
    stem = cues.sparkSession.range(1).select(N.safe_stem(F.lit(title)).alias("s")).first()["s"]
    write_srt(cues, path := f"{folder}/{stem}.srt")
    return path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a saved table; whether there was one."""
    fs, where = _files(spark, path)
    return fs.exists(where) and fs.delete(where, True)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A sorted list, one value a line."""
    df.select(column).distinct().orderBy(column).coalesce(1).write.mode("overwrite").text(path)
