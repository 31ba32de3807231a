"""E-books: chapters, parts, lines.

The archive itself is read per file with an Arrow-free Python map over `binaryFile` rows (a zip isn't
splittable); everything after that is relational.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.functions import text as T
from termflow.sources.staging import ship

# Fixed values.
PART_CHARS, LEAST_CHARS = 10_000, 10
SPINE = "path string, title string, spine_pos int, href string, toc_label string, toc_pos int, xhtml string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def open_book(path: str, data: bytes) -> list[tuple]:
    """Rows of SPINE for one book; a broken archive has none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = set(z.namelist())
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile")
        base = posixpath.dirname(opf)
        package = ElementTree.fromstring(z.read(opf))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return []
    title = next(((e.text or "").strip() for e in package.iter() if _local(e.tag) == "title"), "")
    items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
    spine = [items[r.get("idref")] for r in package.iter() if _local(r.tag) == "itemref" and r.get("idref") in items]
    hrefs = [posixpath.normpath(posixpath.join(base, e.get("href", ""))) for e in spine]
    labels = toc_labels(z, names, base, items)
    rows = []
    for i, h in enumerate(hrefs):
        label = labels.get(h)
        xhtml = z.read(h).decode("utf-8", "replace") if h in names else None
        rows.append((path, title, i, h, label, None if label is None else i, xhtml))
    return rows


def toc_labels(z: zipfile.ZipFile, names: set[str], base: str, items: dict) -> dict[str, str]:
    """href -> first label, from the NCX or the navigation document."""
    out: dict[str, str] = {}
    for e in items.values():
        href = posixpath.normpath(posixpath.join(base, e.get("href", "")))
        if href not in names:
            continue
        folder = posixpath.dirname(href)
        if e.get("media-type") == "application/x-dtbncx+xml":
            for p in ElementTree.fromstring(z.read(href)).iter():
                if _local(p.tag) == "navPoint":
                    text = next((t.text or "" for t in p.iter() if _local(t.tag) == "text"), "")
                    src = next((c.get("src", "") for c in p.iter() if _local(c.tag) == "content"), "")
                    out.setdefault(posixpath.normpath(posixpath.join(folder, src.split("#")[0])), text.strip())
        elif "nav" in (e.get("properties") or "").split():
            for src, text in re.findall(r'<a\b[^>]*href="([^"#]+)[^"]*"[^>]*>(.*?)</a>', z.read(href).decode("utf-8", "replace"), re.S):
                out.setdefault(posixpath.normpath(posixpath.join(folder, src)), re.sub("<[^>]*>", "", text).strip())
    return out


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Spine files of all books under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(open_book(p, c), columns=["path", "title", "spine_pos", "href", "toc_label", "toc_pos", "xhtml"]).astype({"toc_pos": "Int32", "spine_pos": "int32"})

    ship(spark)
    return files.mapInPandas(rows, SPINE)


def assign_chapters(spine: DataFrame) -> DataFrame:
    """`spine` with chapter (place of the contents entry that owns the file) and chapter_title.

    A file belongs to the last contents entry at or before it; files before the first are dropped; without
    any entry every file is a chapter.
    """
    from pyspark.sql import Window

    up = Window.partitionBy("path").orderBy("spine_pos")
    any_entry = F.count("toc_pos").over(Window.partitionBy("path")) > 0
    df = spine.withColumns({"_any": any_entry, "_at": F.last("toc_pos", True).over(up), "_label": F.last("toc_label", True).over(up)})
    chapter = F.when(F.col("_any"), F.col("_at")).otherwise(F.col("spine_pos"))
    title = F.when(F.coalesce(F.when(F.col("_any"), F.col("_label")), F.lit("")) == "", F.concat(F.lit("Chapter "), (chapter + 1).cast("string"))).otherwise(F.col("_label"))
    return df.withColumns({"chapter": chapter, "chapter_title": title}).filter("chapter IS NOT NULL").drop("_any", "_at", "_label")


def chapter_lines(spine: DataFrame) -> DataFrame:
    """path, chapter, chapter_title, ord (struct of file and line), line; chapters under LEAST_CHARS characters are dropped."""
    lines = assign_chapters(spine).select("path", "chapter", "chapter_title", "spine_pos", F.posexplode(T.html_lines(F.coalesce("xhtml", F.lit("")))).alias("n", "line"))
    lines = lines.withColumn("ord", F.struct("spine_pos", "n"))
    size = lines.groupBy("path", "chapter").agg(F.sum(F.length("line")).alias("_chars")).filter(F.col("_chars") >= LEAST_CHARS)
    return lines.join(size, ["path", "chapter"], "left_semi").drop("spine_pos", "n")


def part_numbers(sizes: Column) -> Column:
    """Part of each line from the lines' sizes in order: a part closes once its share of the chapter is reached, one part a line at most."""
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    parts = F.greatest(F.expr("1"), F.floor((total + PART_CHARS // 2) / PART_CHARS).cast("int"))
    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        done = s["done"] + x
        close = (s["part"] + 1 < parts) & (done.cast("long") * parts >= total.cast("long") * (s["part"] + 1))
        return F.struct(done.alias("done"), (s["part"] + close.cast("int")).alias("part"), F.concat(s["of"], F.array(s["part"])).alias("of"))

    return F.aggregate(sizes, start, step, lambda s: s["of"])


def split_chapters(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`lines` (keys, ord, line) with part, numbered in each chapter; a chapter's line sizes are gathered, not its text."""
    keys = keys or ["chapter"]
    sizes = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.length("line").alias("n")))).alias("_l"))
    # the array of sizes is made before it is folded, so the fold refers to one column
    sizes = sizes.select(*keys, F.transform("_l", lambda x: x["ord"]).alias("_ord"), F.transform("_l", lambda x: x["n"]).alias("_n"))
    parts = sizes.select(*keys, F.explode(F.arrays_zip(F.col("_ord").alias("ord"), part_numbers(F.col("_n")).alias("part"))).alias("p")).select(*keys, "p.ord", "p.part")
    return lines.join(parts, [*keys, "ord"])


def list_parts(parts: DataFrame) -> DataFrame:
    """path, chapter, chapter_title, part, part_id (numbered over the book), chars."""
    from pyspark.sql import Window

    one = parts.groupBy("path", "chapter", "chapter_title", "part").agg(F.sum(F.length("line")).alias("chars"))
    return one.withColumn("part_id", F.row_number().over(Window.partitionBy("path").orderBy("chapter", "part")) - 1)


def select_parts(parts: DataFrame, ids: list[int] | None) -> DataFrame:
    """Lines of the chosen parts, in book order; None means all, ids out of range are ignored."""
    if ids is None:
        return parts
    chosen = list_parts(parts).filter(F.col("part_id").isin(sorted(set(ids)))).select("path", "chapter", "part")
    return parts.join(chosen, ["path", "chapter", "part"], "left_semi")
