"""Quality rules with thresholds that adapt to each language and source.

DataFrame functions only. `measures` counts a text's features; `sketch` is a mergeable quantile sketch
of each rate per (lang, source): counts in logarithmic buckets, eight per octave (relative error under
1/8; values below 16 exact). Merging sketches is adding counts, so partial aggregation merges them
before the shuffle and no result depends on their order. `thresholds` reads the median and the upper
quartile off the merged sketches of a group, its language and all documents: the fewer documents a
group has, the more its limits are those of its language, and likewise a language's those of all.
`judge` joins the limits back.

A document fails the method if a rate is over its group's limit: median + SPREAD * (upper quartile -
median) + a slack, so a uniform group doesn't reject its ordinary documents.

Defined results: a null text has no words, an empty one neither, and both fail the base (fewer than ten
words); null lang or source are groups of their own; repeated rows are judged alike; an empty table
gives an empty result; texts are measured whole, whatever their length; a rate at its limit passes; rows without
doc_id are judged like others; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.llm.common import cut, small_side, table, text_of

#: Words of a window, and the base's limits as the contract fixes them.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Rates in thousandths, and the slack of each limit.
SLACK = {"symbol_rate": 50, "dup_line_rate": 450, "repeat_rate": 180, "upper_rate": 200}
SPREAD = 3
#: Documents from which a group's own quantiles count fully.
FULL_GROUP = 200
BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: a lambda's variable stands for it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by windows that a text has twice or more; windows are compared by 64-bit hash.

    Texts without a repeated window (most) stop at the distinct count; others sort (hash, place), keep
    places whose neighbour has the same hash and add up the stretches to the next kept place.
    """

    def covered(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(placed, lambda p: let(twice(p), span))

    def twice(p: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(p, k)["g"] == x["g"], F.lit(False))
        marked = F.transform(p, lambda x, k: F.when(near(x, k + 1) | ((k > 0) & near(x, k - 1)), x["i"]))
        return F.array_sort(F.array_compact(marked))

    def span(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.when(F.size(words) > WINDOW, found).otherwise(0)


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the contract's counts and the method's rates of every document."""
    df = documents.select("doc_id", "lang", "source", text_of().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \t-\r]"))
    df = df.select("doc_id", "lang", "source", F.array_remove(F.split("text", "[ \t-\r]+"), "").alias("words"), lines.alias("lines"))
    df = df.select("*", F.array_join("words", "").alias("joined"))
    without = lambda pattern: F.length("joined") - F.length(F.regexp_replace("joined", pattern, ""))
    df = df.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), without("[A-Z]+").cast("long").alias("n_upper"),
    )
    rate = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return df.select("*", rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("n_upper", "word_chars").alias("upper_rate"))


def bucket(value: str) -> Column:
    """Index of the logarithmic bucket of a whole number from 0."""
    return F.expr(f"CASE WHEN {value} < 16 THEN {value} ELSE 8L * (length(bin({value})) - 4) + shiftright({value}, length(bin({value})) - 4) END")


def least_of(index: str) -> Column:
    """The least value of a bucket."""
    return F.expr(f"CASE WHEN {index} < 16 THEN {index} ELSE shiftleft({index} % 8 + 8, cast({index} div 8 - 1 as int)) END")


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, bucket, n: the merged sketch of each rate in each group."""
    each = F.expr("stack(%d, %s) as (rate, value)" % (len(SLACK), ", ".join(f"'{r}', {r}" for r in SLACK)))
    return measured.select(*keys, each).groupBy(*keys, "rate", bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, n, median and upper quartile of each group."""
    group = Window.partitionBy(*keys, "rate")
    df = sketched.select("*", F.sum("n").over(group).alias("all"), F.sum("n").over(group.orderBy("bucket")).alias("upto"))
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("all"), F.col("bucket")))
    df = df.groupBy(*keys, "rate").agg(F.max("all").alias("n"), at(50).alias("b50"), at(75).alias("b75"))
    return df.select(*keys, "rate", "n", least_of("b50").alias("mid"), least_of("b75").alias("high"))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and the limit of each rate."""
    fine = sketch(measured, ["lang", "source"])
    by_lang = fine.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    a = quantiles(fine, ["lang", "source"])
    b = quantiles(by_lang, ["lang"]).select(F.col("lang").alias("b_lang"), F.col("rate").alias("b_rate"), F.col("n").alias("b_n"), F.col("mid").alias("b_mid"), F.col("high").alias("b_high"))
    c = quantiles(overall, []).select(F.col("rate").alias("c_rate"), F.col("mid").alias("c_mid"), F.col("high").alias("c_high"))
    df = a.join(b, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("rate") == F.col("b_rate"))).join(c, F.col("rate") == F.col("c_rate"))
    blend = lambda own, n, other: f"(({own}) * least({n}, {FULL_GROUP}) + ({other}) * ({FULL_GROUP} - least({n}, {FULL_GROUP}))) div {FULL_GROUP}"
    at = {x: blend(x, "n", blend(f"b_{x}", "b_n", f"c_{x}")) for x in ("mid", "high")}
    slack = "CASE rate " + " ".join(f"WHEN '{r}' THEN {s}L" for r, s in SLACK.items()) + " END"
    df = df.select("lang", "source", "rate", F.expr(f"{at['mid']} + {SPREAD} * ({at['high']} - {at['mid']}) + {slack}").alias("most"))
    return df.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col("most"))).alias(f"most_{r}") for r in SLACK])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The contract's columns, the rates, and `failed_rule`: the first rule a document breaks."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    df = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rule = F.when(base, "base")
    for r in SLACK:
        rule = rule.when(F.col(r) > F.col(f"most_{r}"), r)
    return df.select("doc_id", "n_words", *BASE, base.alias("base_failed"), rule.isNull().alias("kept"), rule.alias("failed_rule"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(measures(table(spark, sf_dir, "documents")))
    limits = cut(thresholds(measured))
    return judge(measured, small_side(limits))


def _sql() -> str:
    """DuckDB SQL of the query."""
    full = FULL_GROUP
    bucket_sql = "CASE WHEN value < 16 THEN value ELSE 8 * (length(bin(value)) - 4) + (value >> (length(bin(value)) - 4)) END"
    least = lambda b: f"CASE WHEN {b} < 16 THEN {b} ELSE ({b} % 8 + 8) << ({b} // 8 - 1) END"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS value FROM m" for r in SLACK)
    quant = lambda src, keys: (
        f"SELECT {keys}rate, max(tot) AS n, min(bucket) FILTER (100 * upto >= 50 * tot) AS b50, min(bucket) FILTER (100 * upto >= 75 * tot) AS b75 FROM "
        f"(SELECT *, sum(n) OVER (PARTITION BY {keys}rate) AS tot, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bucket) AS upto FROM {src}) GROUP BY {keys}rate"
    )
    blend = lambda own, n, other: f"(({own}) * least({n}, {full}) + ({other}) * ({full} - least({n}, {full}))) // {full}"
    at = {x: blend(least(f"a.{x}"), "a.n", blend(least(f"b.{x}"), "b.n", least(f"c.{x}"))) for x in ("b50", "b75")}
    slack = "CASE a.rate " + " ".join(f"WHEN '{r}' THEN {s}" for r, s in SLACK.items()) + " END"
    limits = ", ".join(f"max(most) FILTER (rate = '{r}') AS most_{r}" for r in SLACK)
    rule = "CASE WHEN n_words < 10 OR 100 * n_repeat_words > 20 * n_words THEN 'base' " + " ".join(f"WHEN {r} > most_{r} THEN '{r}'" for r in SLACK) + " END"
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines FROM t),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h) GROUP BY doc_id),
m0 AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(array_to_string(words, '')) - length(regexp_replace(array_to_string(words, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
        length(array_to_string(words, '')) - length(regexp_replace(array_to_string(words, ''), '[A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN rw ON w.doc_id = rw.doc_id),
m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 1000 * n_upper // greatest(word_chars, 1) AS upper_rate FROM m0),
fine AS (SELECT lang, source, rate, {bucket_sql} AS bucket, count(*) AS n FROM ({stacked}) GROUP BY ALL),
langs AS (SELECT lang, rate, bucket, sum(n) AS n FROM fine GROUP BY ALL),
whole AS (SELECT rate, bucket, sum(n) AS n FROM langs GROUP BY ALL),
a AS ({quant("fine", "lang, source, ")}), b AS ({quant("langs", "lang, ")}), c AS ({quant("whole", "")}),
most AS (SELECT a.lang, a.source, a.rate, {at["b50"]} + {SPREAD} * (({at["b75"]}) - ({at["b50"]})) + {slack} AS most
        FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate JOIN c ON a.rate = c.rate),
limits AS (SELECT lang, source, {limits} FROM most GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        ({rule}) IS NULL AS kept, {rule} AS failed_rule
FROM m LEFT JOIN limits ON m.lang IS NOT DISTINCT FROM limits.lang AND m.source IS NOT DISTINCT FROM limits.source
"""


SQL = _sql()
