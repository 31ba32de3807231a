"""Frequency dictionaries and word lists as sources.

A dictionary folder or archive holds `index.json` and `term_meta_bank_N.json`. Banks become the long table
`freq` (see operators.frequency); a rebuilt table is kept as Parquet by title and revision.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.functions import text as T
from termflow.sources.staging import ship

# Fixed values.
FORMAT, KANA_MARK, LARGEST = 3, "㋕", 4294967295
BANK = r"^term_meta_bank_\d+\.json$"
FILES = "folder string, name string, content string"
FREQ = "dict string, term string, reading string, value bigint, display string, kana_marker boolean, entry_ord bigint"
DETAIL = "struct<value:string,displayValue:string,reading:string,frequency:string>"


def dictionary_files(spark: SparkSession, path: str) -> DataFrame:
    """folder, name, content of index and bank files, in folders and inside archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,zip}").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                folder, name = posixpath.split(p)
                rows = []
                if name.endswith(".json"):
                    rows.append((folder, name, c.decode("utf-8", "replace")))
                elif zipfile.is_zipfile(io.BytesIO(c)):
                    with zipfile.ZipFile(io.BytesIO(c)) as z:
                        rows += [(p, posixpath.basename(n), z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".json")]
                rows = [r for r in rows if r[1] == "index.json" or re.match(BANK, r[1])]
                yield pd.DataFrame(rows, columns=["folder", "name", "content"])

    ship(spark)
    return files.mapInPandas(unpack, FILES)


def indexes(files: DataFrame) -> DataFrame:
    """folder, title, revision of readable indexes of the supported format (`format`, else `version`)."""
    j = F.from_json("content", "title string, revision string, format int, version int, frequencyMode string")
    df = files.filter("name = 'index.json'").select("folder", j.alias("j")).select("folder", "j.*")
    return df.filter((F.coalesce("format", "version") == FORMAT) & F.col("title").isNotNull()).select("folder", "title", F.coalesce("revision", F.lit("")).alias("revision"))


def whole_number(value: Column) -> Column:
    """A number or numeric text from 0 to the largest 32-bit value; null otherwise."""
    n = F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).try_cast("bigint"))
    return F.when(n <= LARGEST, n)


def bank_entries(files: DataFrame, index: DataFrame) -> DataFrame:
    """FREQ rows of all banks; malformed rows and other kinds than `freq` are dropped, keys and readings normalised."""
    banks = files.filter("name <> 'index.json'").join(index, "folder")
    number = F.regexp_extract("name", r"(\d+)", 1).cast("bigint")
    rows = banks.select("title", number.alias("bank"), F.posexplode(F.from_json("content", "array<string>")).alias("n", "row"))
    cell = F.from_json("row", "array<string>")
    rows = rows.select("title", (F.col("bank") * 1_000_000_000 + F.col("n")).alias("entry_ord"), cell.alias("c")).filter((F.size("c") >= 3) & (F.get("c", F.lit(1)) == "freq"))
    data = F.get("c", F.lit(2))
    d, inner = F.from_json(data, DETAIL), F.from_json(F.get_json_object(data, "$.frequency"), DETAIL)
    nested = F.get_json_object(data, "$.reading").isNotNull()
    plain = F.coalesce(whole_number(data), whole_number(d["value"]))
    deep = F.coalesce(whole_number(d["frequency"]), whole_number(inner["value"]))
    display = F.when(nested, inner["displayValue"]).otherwise(d["displayValue"])
    df = rows.select(
        F.col("title").alias("dict"), T.fold_long_vowels(F.get("c", F.lit(0))).alias("term"), F.when(nested, T.fold_long_vowels(T.fold_katakana(F.get_json_object(data, "$.reading")))).alias("reading"),
        F.when(nested, deep).otherwise(plain).alias("value"), display.alias("display"), F.coalesce(F.contains(display, F.lit(KANA_MARK)), F.lit(False)).alias("kana_marker"), "entry_ord",
    )
    return df.filter("value IS NOT NULL AND term IS NOT NULL")


def load_dictionaries(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """All entries under a path; with a cache folder, dictionaries of a kept (title, revision) are read from it and new ones are added."""
    files = dictionary_files(spark, path)
    index = indexes(files)
    if cache is None:
        return bank_entries(files, index)
    try:
        kept = spark.read.parquet(cache)
    except Exception:
        kept = spark.createDataFrame([], FREQ + ", title string, revision string")
    have = kept.select("title", "revision").distinct()
    new = index.join(have, ["title", "revision"], "left_anti")
    if not new.isEmpty():
        fresh = bank_entries(files, new).join(new.select("title", "revision"), F.col("dict") == F.col("title"))
        fresh.write.mode("append").partitionBy("title", "revision").parquet(cache)
        kept = spark.read.parquet(cache)
    return kept.join(index.select("title", "revision"), ["title", "revision"], "left_semi").select(*[c.split()[0] for c in FREQ.split(", ")])


def not_imported(archives: DataFrame, present: DataFrame) -> DataFrame:
    """Archives (name) whose file name isn't there yet."""
    return archives.join(present.select("name"), "name", "left_anti")


def without_dictionary(freq: DataFrame, title: str) -> DataFrame:
    return freq.filter(F.col("dict") != title)


def replaced_dictionary(freq: DataFrame, new: DataFrame) -> DataFrame:
    """`freq` with the dictionaries of `new` in place of those of the same title."""
    return freq.join(new.select("dict").distinct(), "dict", "left_anti").select(*freq.columns).unionByName(new.select(*freq.columns))


def jlpt_list(spark: SparkSession, path: str) -> DataFrame:
    """kanji, kana, level, pos; empty where the file can't be read."""
    from termflow.sources.appdata import json_or_empty

    return json_or_empty(spark, path, "kanji string, kana string, level string, pos string")


def build_jlpt(words: DataFrame, senses: DataFrame) -> DataFrame:
    """kanji, kana, level, pos of level lists (seq, kanji, kana, level) matched with dictionary senses (seq, kanji, kana, sense_ord, pos).

    By number, else by both forms, else by kanji, else by kana; the first sense with a known part of speech
    counts, Noun without; a single kanji without a match is dropped.
    """
    first = lambda keys: senses.filter("pos IS NOT NULL").groupBy(*keys).agg(F.min_by("pos", "sense_ord").alias("pos"))
    df, found = words, []
    for n, keys in enumerate((["seq"], ["kanji", "kana"], ["kanji"], ["kana"])):
        df = df.join(first(keys).withColumnRenamed("pos", f"_p{n}"), keys, "left")
        found.append(f"_p{n}")
    pos = F.coalesce(*found)
    single = (F.length("kanji") == 1) & T.has_kanji(F.col("kanji"))
    return df.filter(pos.isNotNull() | ~F.coalesce(single, F.lit(False))).select("kanji", "kana", "level", F.coalesce(pos, F.lit("Noun")).alias("pos"))


def index_json(title: str, revision: str) -> str:
    return json.dumps({"title": title, "revision": revision, "format": FORMAT}, ensure_ascii=False)
