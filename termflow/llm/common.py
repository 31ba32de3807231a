"""Small helpers shared by the training-data operators.

Column names of the input are only ever read by name, so extra columns (also ones whose names
clash with an operator's outputs) never reach the working plans: every operator selects what it
needs first.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.sources.staging import ship

#: The word separators of every contract here: space and U+0009 to U+000D.
SPACES = " \t-\r"
#: Bytes that a side may have at most, as its values and ROW_BYTES for each row, to be broadcast; beyond it the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the session's `spark.checkpoint.dir`; only where that is unset and all executors are on this machine, as in tests, a folder in the warehouse."""
    to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not to and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{to or spark.conf.get('spark.sql.warehouse.dir') + '/_cut'}/termflow-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again, so a lost executor costs no recomputation.

    A table is compressed and written in one pass, unlike a checkpoint. `drop_cut` removes one that
    is no longer needed; the rest goes when the application ends.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


_folders: set[str] = set()
_made: list[str] = []


def written(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of `make` by `cut`; tables that were cut on the way there are removed."""
    before = len(_made)
    out = cut(make())
    for path in _made[before:]:
        if path != out._cut_path:
            _remove(out.sparkSession, path)
    _made[before:] = [out._cut_path]
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the table behind a result of `cut`."""
    _remove(df.sparkSession, df._cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        return


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its values, which are measured, are within `most` bytes, else as it is.

    What is given should be the result of `cut` or cheap to make, as it is read once more.
    """
    width = F.lit(ROW_BYTES)
    for f in df.schema:
        width = width + (F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose doc_id isn't among `ids` (distinct); all columns stay, whatever their names, and so do rows without doc_id."""
    name = fresh(df, "_gone")
    return df.join(small_side(cut(ids.select(F.col("doc_id").alias(name)))), F.col("doc_id") == F.col(name), "left_anti")


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    """Apply `fn` to slices of at most `rows` rows, which bounds what a task holds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(fn.__module__)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None:
                    yield out
        trim()

    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `fn` to whole groups of equal `key`, many at a time: a table sorted by key and the groups' bounds.

    Groups are streamed off a sorted partition, so a task holds one Arrow batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(fn.__module__)
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(key)
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            if rest and keys[-1] == last:
                rest.append(batch)
                continue
            cut_at = int(np.argmax(keys == keys[-1]))
            yield from whole([*rest, batch.slice(0, cut_at)], at)
            rest, last = [batch.slice(cut_at)], keys[-1]
        if rest:
            yield from whole(rest, at)
        trim()

    def whole(parts: list[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if parts:
            got = pa.Table.from_batches(parts).combine_chunks()
            keys = got.column(at).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            if (out := fn(got, bounds)) is not None:
                yield out

    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


class Recent(dict):
    """A bounded dictionary that makes what it lacks: two generations of `limit` entries each.

    When the young one is full it becomes the old one, whose entries move back as they are asked for, so
    frequent keys stay. What is made of a key over LONGEST_KEY characters isn't kept, which bounds the bytes.
    """

    LONGEST_KEY = 64

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_held: dict[str, object] = {}


def held(owner: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one operator's value at a time, so caches of earlier stages don't add up."""
    if _held.get("owner") != owner:
        release("")
        _held.update(owner=owner, value=make(), module=getattr(make, "__module__", ""))
    return _held["value"]


def release(module: str) -> None:
    """Give back what another module's operator keeps in this worker."""
    if _held and _held.get("module") != module:
        _held.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give unused memory back to the system, as an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its free lists
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of BATCH_BYTES, unless it was told another size than Spark's own; both sides hold a few of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def text_of(name: str = "text") -> Column:
    """The text, a null one empty."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value's decimal text, modulo n: the fold of a row. A null has none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(folds: int, fold: int) -> Column:
    """Whether a document is of the held-out fold; one without doc_id is of no fold: not held out, and no label of it is learnt."""
    return F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def bounded_sample(df: DataFrame, id_col: str, class_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """At most `per_class` rows of each class, the same ones on every run (those of least hash) with their rank `nth`, and the classes' counts.

    A first pass counts the classes, all of which are kept; a second keeps rows whose hash lies under a
    class's share, so only about twice the sample reaches the exact top-k.
    """
    counts = {r[0]: r[1] for r in df.filter(F.col(class_col).isNotNull()).groupBy(class_col).count().collect()}
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    rows = [(value, min(1 << 30, int((2 * per_class + 64) / n * (1 << 30)) + 1)) for value, n in counts.items()]
    share = df.sparkSession.createDataFrame(rows, f"_class {df.schema[class_col].dataType.simpleString()}, _share long")  # a row for each class
    keep = df.join(F.broadcast(share), F.col(class_col) == F.col("_class")).filter(at < F.col("_share")).select(*df.columns)
    return keep.withColumn("nth", F.row_number().over(Window.partitionBy(class_col).orderBy(at, id_col))).filter(F.col("nth") <= per_class), counts


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> tuple[DataFrame, dict]:
    """doc_id, text and label of a bounded sample of the labelled documents outside the held-out fold, and the classes' counts.

    A doc_id that is labelled twice counts once, by its larger label.
    """
    known = labels.select("doc_id", label).filter(F.col(label).isNotNull() & (crc_mod("doc_id", folds) != held_out))
    chosen, counts = bounded_sample(known.groupBy("doc_id").agg(F.max(label).alias("label")), "doc_id", "label", per_class)
    chosen = chosen.drop("nth")
    texts = documents.select("doc_id", text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), counts  # per_class bounds the sample
