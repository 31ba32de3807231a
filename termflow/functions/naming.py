"""File and media names, versions and labels as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termflow.functions.text import trim

# Streaming services, patterns of media file names, and the last episode that a bare number may be.
SERVICES = ["Netflix", "Crunchyroll", "Funimation", "Amazon", "Hulu", "Disney", "HBO", "Paramount", "Apple", "Peacock", "MAX"]
SEASON_EPISODE = r"(?i)(.+?)[\.\s\-\_\[\]]*[Ss](\d{1,2})[Ee](\d{1,3})(?:[\.\s\-\_]*(.+))?"
EPISODE = r"(?i)(.+?)[\.\s\-\_\[\]]*(?:episode|ep|e)[\.\s\-\_]*(\d{1,3})(?:[\.\s\-\_]*(.+))?"
BARE_NUMBER = r"(?i)(.+?)[\s\-]+(\d{1,3})(?:\s+\((.+?)\)|\s+(.+?))?$"
MOVIE = r"(?i)(.+?)[\s\.\-\_]*\((\d{4})\)(?:[\s\.\-\_]*(.+))?"
BRACKETED = r"[\[\(][^\]\)]*[\]\)]"
LANGUAGE_SUFFIX = r"\.(?:ja|en|es|fr|de|it|pt|ru|ko|zh)(?:\[cc\])?$"
LAST_BARE_EPISODE = 200


def file_type(path: Column) -> Column:
    """SRT, SSA, TXT or EPUB from the extension in any case; else the extension in capitals, empty without one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("ass", "ssa"), "SSA").otherwise(F.upper(ext))


def stem(path: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def service(text: Column) -> Column:
    """First streaming service, in list order, that a text names in any case."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(s.lower())), s) for s in SERVICES])


def clean_title(title: Column) -> Column:
    """Without bracketed text and language suffix, separators as spaces; words are capitalised only if all letters have one case."""
    bare = F.regexp_replace(F.regexp_replace(title, BRACKETED, ""), LANGUAGE_SUFFIX, "")
    bare = trim(F.regexp_replace(F.translate(bare, "._-", "   "), r"(?U)\s+", " "))
    letters = F.regexp_replace(bare, r"[^\p{L}]", "")
    one_case = (letters != "") & (~letters.rlike(r"[^\p{Lu}]") | ~letters.rlike(r"[^\p{Ll}]"))
    return F.when(one_case, F.initcap(bare)).otherwise(bare)


def media(filename: Column) -> Column:
    """struct(kind, title, season, episode, year, source) of a media file's name: TV show, movie or generic.

    The raw parts are chosen first and cleaned once, behind a lambda variable, so the plan stays small.
    """
    name = stem(filename)
    part = lambda pattern, k: F.regexp_extract(name, pattern, k)
    null_int, nothing = F.lit(None).cast("int"), F.lit("")

    def row(kind, title, tail, season=null_int, episode=null_int, year=null_int):
        return F.struct(F.lit(kind).alias("kind"), title.alias("title"), season.alias("season"), episode.alias("episode"), year.alias("year"), tail.alias("tail"))

    number = part(BARE_NUMBER, 2)
    tail = F.coalesce(F.nullif(part(BARE_NUMBER, 3), nothing), part(BARE_NUMBER, 4))
    size = F.contains(tail, F.lit("x")) & F.contains(tail, number)  # like 1920x1080
    bare = name.rlike(BARE_NUMBER) & (number.cast("int") <= LAST_BARE_EPISODE) & ~size
    raw = (
        F.when(name.rlike(SEASON_EPISODE), row("tv", part(SEASON_EPISODE, 1), part(SEASON_EPISODE, 4), part(SEASON_EPISODE, 2).cast("int"), part(SEASON_EPISODE, 3).cast("int")))
        .when(name.rlike(EPISODE), row("tv", part(EPISODE, 1), part(EPISODE, 3), episode=part(EPISODE, 2).cast("int")))
        .when(bare, row("tv", part(BARE_NUMBER, 1), part(BARE_NUMBER, 4), episode=number.cast("int")))
        .when(name.rlike(MOVIE), row("movie", part(MOVIE, 1), part(MOVIE, 3), year=part(MOVIE, 2).cast("int")))
        .otherwise(row("generic", name, nothing))
    )

    def clean(r: Column) -> Column:
        source = F.coalesce(service(r["tail"]), F.when(r["kind"] != "movie", service(name)))
        return F.struct(r["kind"].alias("kind"), clean_title(r["title"]).alias("title"), r["season"].alias("season"), r["episode"].alias("episode"), r["year"].alias("year"), source.alias("source"))

    return F.transform(F.array(raw), clean)[0]


def display_title(m: Column) -> Column:
    """Title with season and episode, or year."""
    return (
        F.when(m["season"].isNotNull() & m["episode"].isNotNull(), F.format_string("%s - S%02dE%02d", m["title"], m["season"], m["episode"]))
        .when(m["episode"].isNotNull(), F.format_string("%s - Episode %d", m["title"], m["episode"]))
        .when(m["year"].isNotNull(), F.format_string("%s (%d)", m["title"], m["year"]))
        .otherwise(m["title"])
    )


def matchable(m: Column) -> Column:
    """Whether a media database can be asked for it."""
    return F.when(m["kind"] == "tv", m["season"].isNotNull() & m["episode"].isNotNull()).otherwise(m["year"].isNotNull())


def human_time(ms: Column) -> Column:
    """H:MM:SS-like label, padded to eleven characters."""
    t = ms % 86_400_000
    h, m, s = F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60
    return F.rpad(F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s)), 11, " ")


def opened_label(at: Column) -> Column:
    """When a file was opened, to the minute, in the session's time zone."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def terms_label(n: Column) -> Column:
    """A number of terms in words; `Unknown terms` for null."""
    return F.when(n.isNull(), "Unknown terms").when(n == 1, "1 term").otherwise(F.format_string("%d terms", n))


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB; `Unknown` for null."""
    return F.when(n.isNull(), "Unknown").when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / float(1 << 20), 1)))


def is_newer(version: Column, current: Column) -> Column:
    """Whether dotted numeric versions compare as newer; a part that is no number makes the answer false."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda p: F.expr("1") * F.regexp_extract(p, r"^(\d+)$", 1).try_cast("long"))
    a, b = parts(version), parts(current)
    longer = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), longer - F.size(x)))
    bad = F.exists(a, lambda p: p.isNull()) | F.exists(b, lambda p: p.isNull())
    return F.when(bad, F.lit(False)).otherwise(pad(a) > pad(b))


def safe_stem(name: Column, longest: int = 80, default: str = "video") -> Column:
    """A name that every file system takes; a default for a blank one."""
    bare = trim(F.substring(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, longest))
    return F.when(F.coalesce(bare, F.lit("")) == "", default).otherwise(bare)


def source_file(path: Column, book_title: Column | None = None, label: Column | None = None) -> Column:
    """struct(file_type, title, creator, original_file, label) of a file: a book has its own title, if any, and the label of what was picked from it; all others are named by their media name, and the service is the creator."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    m, kind = media(name), file_type(path)
    own = display_title(m)
    nothing = F.lit(None).cast("string")
    title = F.when((kind == "EPUB") & (F.coalesce(book_title, F.lit("")) != ""), book_title).otherwise(own) if book_title is not None else own
    picked = F.when((kind == "EPUB") & (trim(label) != ""), trim(label)) if label is not None else nothing
    return F.struct(kind.alias("file_type"), title.alias("title"), m["source"].alias("creator"), path.alias("original_file"), picked.alias("label"))


def file_tree(files: DataFrame) -> DataFrame:
    """depth, prefix, parent, name, path, n_files of the nested tree over files (path): folders that all share are left out, a file keeps its name, folders have a null path; rows of one parent sort by folder first, then name.

    The shared folders are found by an aggregate over the paths' prefixes, not on the driver.
    """
    df = files.select("path", F.filter(F.split("path", r"[/\\]"), lambda p: p != "").alias("_p")).distinct()
    n, shortest = F.count("*").alias("_n"), F.min(F.size("_p") - 1).alias("_least")
    total = df.agg(n, shortest)
    upto = df.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p") - 1, F.lit(1))), lambda k: F.array_join(F.slice("_p", F.lit(1), k), "/"))).alias("_k", "_prefix"))
    shared = upto.groupBy("_k", "_prefix").agg(F.count("*").alias("_same")).crossJoin(F.broadcast(total)).filter((F.col("_same") == F.col("_n")) & (F.col("_k") < F.col("_least")))  # total is one row
    skip = shared.agg(F.coalesce(F.max("_k") + 1, F.lit(0)).alias("_skip"))
    df = df.crossJoin(F.broadcast(skip)).select("path", F.slice("_p", F.col("_skip") + 1, F.size("_p")).alias("_p"))  # skip is one row
    rows = df.select("path", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    at = lambda k: F.array_join(F.slice("_p", F.lit(1), k), "/")
    leaf = F.col("depth") == F.size("_p")
    rows = rows.select("depth", at(F.col("depth")).alias("prefix"), at(F.col("depth") - 1).alias("parent"), F.get("_p", F.col("depth") - 1).alias("name"), F.when(leaf, F.col("path")).alias("path"))
    return rows.groupBy("depth", "prefix", "parent", "name", "path").agg(F.count("*").alias("n_files"))


def prefixes(path: Column) -> Column:
    """Every folder above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def filled_bars(share: Column) -> Column:
    """Comprehension in bars of twenty per cent, five at most."""
    return F.least(F.ceil(share * 5), F.lit(5)).cast("int")


def markers(template: Column) -> Column:
    """Distinct `{name}` markers of a template, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^{}]*)\}"), F.lit(1)))


def fill(template: Column, values: Column) -> Column:
    """A template with its markers replaced from a map; a missing one becomes empty, an unclosed brace stays."""
    pieces = F.split(template, r"(?=\{[^{}]*\})|(?<=\})")
    name = lambda p: F.regexp_extract(p, r"^\{([^{}]*)\}$", 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\{[^{}]*\}$"), F.coalesce(F.element_at(values, name(p)), F.lit(""))).otherwise(p)), "")


def cloze(sentence: Column, word: Column) -> Column:
    """struct(prefix, body, suffix) around a word's first occurrence; the whole sentence is the prefix without one."""
    at = F.instr(sentence, word)
    return F.struct(
        F.when(at > 0, F.substring(sentence, F.lit(1), at - 1)).otherwise(sentence).alias("prefix"),
        F.when(at > 0, word).otherwise("").alias("body"),
        F.when(at > 0, F.substring(sentence, at + F.length(word), F.length(sentence))).otherwise("").alias("suffix"),
    )


def first_of(columns: list[Column]) -> Column:
    """The first value that isn't null."""
    return reduce(lambda a, b: F.coalesce(a, b), columns)
