"""Small application tables: ignore lists, recents, histories, vocabulary snapshots, settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Entries of the recents list at most.
RECENTS = 50
# Terms that a new ignore list holds.
DEFAULT_IGNORED = ["の", "は", "に", "へ", "を", "て", "が", "だ", "た", "と", "から", "も", "で", "か", "です", "ね", "な", "ん", "し", "お"]

IGNORE = "term string, origin string, enabled boolean"
VOCAB = "term string, reading string, card_id bigint, interval double"


@dataclass(frozen=True)
class EngineConfig:
    """Settings that the engine reads; a missing one has its default."""

    known_interval: int = 30
    frequency_least: int | None = None
    frequency_most: int | None = None
    include_unknown: bool = True
    pos_filters: dict[str, bool] = field(default_factory=dict)
    level_filters: dict[str, bool] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()
    filter_presets: tuple[str, ...] = ()
    text_filters: tuple[tuple[str, str, bool], ...] = ()
    field_mappings: dict[str, dict[str, str]] = field(default_factory=dict)


def json_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON table, or an empty one where the file is missing or no JSON."""
    try:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)
        df.limit(1).collect()
        return df
    except Exception:
        return spark.createDataFrame([], schema)


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """The ignore table of a list file {ignored_terms, files: [{path, enabled}]}; the defaults where it is missing."""
    raw = json_or_empty(spark, path, "ignored_terms array<string>, files array<struct<path:string,enabled:boolean>>").limit(1).collect()
    if not raw:
        return spark.createDataFrame([(t, "manual", True) for t in DEFAULT_IGNORED], IGNORE)
    manual = spark.createDataFrame([(t, "manual", True) for t in raw[0]["ignored_terms"] or ()], IGNORE)
    files = [term_file(spark, f["path"]).withColumn("enabled", F.lit(bool(f["enabled"]))) for f in raw[0]["files"] or ()]
    return reduce(DataFrame.unionByName, files, manual)


def term_file(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a list file, one a line, blank ones dropped; origin is the path."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("term"), F.lit(path).alias("origin"), F.lit(True).alias("enabled")).filter("term <> ''")


def active_ignored(ignore: DataFrame) -> DataFrame:
    """Distinct terms of the enabled origins."""
    return ignore.filter("enabled").select("term").distinct()


def add_ignored(ignore: DataFrame, term: str) -> DataFrame:
    """With a manual term, if it isn't there."""
    new = ignore.sparkSession.createDataFrame([(term, "manual", True)], IGNORE)
    return new.join(ignore.filter("origin = 'manual'").select("term"), "term", "left_anti").select("term", "origin", "enabled").unionByName(ignore)


def remove_ignored(ignore: DataFrame, term: str) -> DataFrame:
    return ignore.filter((F.col("origin") != "manual") | (F.col("term") != term))


def set_ignored(ignore: DataFrame, terms: list[str]) -> DataFrame:
    """With these manual terms, in order and each once, in place of the earlier ones; an empty list clears them."""
    new = ignore.sparkSession.createDataFrame([(t, "manual", True) for t in dict.fromkeys(terms)], IGNORE)
    return new.unionByName(ignore.filter("origin <> 'manual'"))


def set_ignore_files(spark: SparkSession, ignore: DataFrame, files: list[tuple[str, bool]]) -> DataFrame:
    """With the terms of these files (path, enabled), read anew, in place of the earlier files'."""
    manual = ignore.filter("origin = 'manual'")
    return reduce(DataFrame.unionByName, [term_file(spark, path).withColumn("enabled", F.lit(on)) for path, on in files], manual)


def ignore_view(ignore: DataFrame) -> DataFrame:
    """origin, enabled, n_terms of each list."""
    return ignore.groupBy("origin", "enabled").agg(F.countDistinct("term").alias("n_terms"))


def recents(opened: DataFrame, limit: int = RECENTS) -> DataFrame:
    """The newest entry of each path (path, last_opened, ...), the newest `limit` of these."""
    rest = [c for c in opened.columns if c not in ("path", "last_opened")]
    one = opened.groupBy("path").agg(F.max("last_opened").alias("last_opened"), *[F.max_by(c, "last_opened").alias(c) for c in rest])
    return one.orderBy(F.desc("last_opened"), "path").limit(limit)


def drop_recent(entries: DataFrame, path: str) -> DataFrame:
    return entries.filter(F.col("path") != path)


def read_parts(history: DataFrame, new: DataFrame) -> DataFrame:
    """path, parts: sorted distinct part ids of each book that were read (path, part)."""
    return history.select("path", F.explode("parts").alias("part")).unionByName(new.select("path", "part")).groupBy("path").agg(F.array_sort(F.collect_set("part")).alias("parts"))


def chapters_seen(parts: DataFrame, history: DataFrame) -> DataFrame:
    """`parts` (path, part, ...) with seen."""
    h = history.select("path", F.explode("parts").alias("part")).withColumn("_seen", F.lit(True))
    return parts.join(h, ["path", "part"], "left").withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_seen")


def vocab_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved vocabulary with vocab_idx by its order in the file, or None where there is none."""
    raw = json_or_empty(spark, path, VOCAB)
    if raw.isEmpty():
        return None
    return raw.withColumn("vocab_idx", F.monotonically_increasing_id())


def catalog_status(catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """title, status of recommended dictionaries (title, revision): missing, installed, outdated, or unknown without a catalog revision."""
    i = installed.select(F.col("title").alias("_t"), F.col("revision").alias("_r"))
    df = catalog.join(i, F.col("title") == F.col("_t"), "left")
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("revision").isNull(), "unknown").when(F.col("revision") == F.col("_r"), "installed").otherwise("outdated")
    return df.select("title", status.alias("status"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
