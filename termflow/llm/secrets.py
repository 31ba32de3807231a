"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame functions only. `base_spans` finds the contract's kinds with their places: a text is split by
the pattern it was matched with, so a match starts where the pieces and matches before it end. `train`
counts character transitions - values of base spans are random strings, all other words ordinary
identifiers - over all documents, aggregated before the shuffle (at most two counts for each pair of
characters reach the driver), and adds a uniform prior to both, which larger inputs outweigh. `markov_spans` scores every other word-like run of LEAST
characters or more in all texts by the models' log-likelihood ratio and adds those over the limits.

Defined results: a null text counts as empty, and an empty text has no spans (base_sha256 is that of the
empty string); repeated rows give repeated results and so do rows without doc_id; spans that start alike are
ordered by kind, as KINDS lists them; texts are scanned whole; an empty table gives an empty result and only
the prior is learnt; further columns are ignored by the query, kept by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import fresh, table, text_of
from termflow.llm.quality_rules import let

#: Fixed values of the contract: kind, pattern, the group whose length counts, its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
]
#: Of `hex`, only runs that can count are matched; the others would be dropped anyway.
FAST = {"hex": r"((?<![0-9a-f])[0-9a-f]{24,}+)", "access": r"(AKIA[A-Z0-9]{16,}+)"}
#: The method's kind: word-like runs of LEAST characters, and the limits of their ratio.
MARKOV, RUN, LEAST = "markov", r"[A-Za-z0-9+/_=-]+", 20
MIN_TOTAL, MIN_MEAN = 14.0, 0.55
#: Pseudo-counts of each transition.
PRIOR_RANDOM, PRIOR_ORDINARY = 2.0, 0.2
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def located(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group is long enough."""
    pieces, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(F.transform(pieces, lambda x: F.length(x)).alias("before"), F.transform(whole, lambda x: F.length(x)).alias("long"), F.transform(part, lambda x: F.length(x)).alias("counts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        first = s["at"] + x["before"]
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), (first + x["long"]).alias("end"))
        spans = F.when(x["counts"] >= least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((first + F.coalesce(x["long"], F.lit(0))).alias("at"), spans.alias("spans"))

    return F.aggregate(each, start, step, lambda s: s["spans"])


def base_spans(text: Column) -> Column:
    """All spans of the contract's kinds, by start, then kind."""
    none = F.array().cast(SPAN)
    found = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        pattern = FAST.get(kind, pattern)
        found.append(F.when(text.rlike(pattern), located(text, pattern, group, least, k)).otherwise(none))
    return F.array_sort(F.concat(*found))


def train(df: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition, row by row over ALPHABET; starts and ends don't count."""
    spans = base_spans(F.col("text"))
    value = "|".join(FAST.get(kind, pattern) for kind, pattern, _, _ in KINDS)
    secret = F.transform(spans, lambda s: F.regexp_replace(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), r"""^.*[:=]\x20*["']?(?=.)""", ""))
    ordinary = F.regexp_extract_all(F.regexp_replace("text", value, " "), F.lit(RUN), F.lit(0))
    words = df.select(text_of().alias("text")).select(F.posexplode(F.array(secret, ordinary)).alias("ordinary", "words")).select("ordinary", F.explode("words").alias("word"))
    steps = words.filter(F.length("word") > 1).select("ordinary", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("two"))
    size = len(ALPHABET)
    counts = [[PRIOR_RANDOM] * size * size, [PRIOR_ORDINARY] * size * size]
    at = {c: i for i, c in enumerate(ALPHABET)}
    # at most two counts for each pair of the alphabet's characters
    for which, two, n in steps.groupBy("ordinary", "two").count().collect():
        if two[0] in at and two[1] in at:
            counts[which][at[two[0]] * size + at[two[1]]] += n
    out = []
    for i in range(size):
        rows = [c[i * size : (i + 1) * size] for c in counts]
        sums = [sum(r) for r in rows]
        out += [math.log(a / sums[0]) - math.log(b / sums[1]) for a, b in zip(*rows, strict=True)]
    return out


def markov_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Runs that read like random strings and touch no base span."""
    size = len(ALPHABET)
    model = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    codes = F.split(F.lit(",".join(str(ALPHABET.find(chr(c))) for c in range(128))), ",").cast("array<int>")
    code = lambda word, i: F.get(codes, F.ascii(F.substring(word, i, F.lit(1))))

    def score(word: Column) -> Column:
        state = F.struct(code(word, F.lit(1)).alias("last"), F.lit(0.0).alias("sum"))

        def step(s: Column, i: Column) -> Column:
            return let(code(word, i), lambda c: F.struct(c.alias("last"), (s["sum"] + F.get(model, s["last"] * size + c)).alias("sum")))

        return F.aggregate(F.sequence(F.lit(2), F.length(word)), state, step, lambda s: s["sum"])

    def random(s: Column) -> Column:
        word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        apart = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return apart & let(word, lambda w: let(score(w), lambda x: (x > MIN_TOTAL) & (x > MIN_MEAN * F.length(w))))

    pattern = f"((?<![A-Za-z0-9+/_=-]){RUN[:-1]}{{{LEAST},}}+)"
    return F.when(text.rlike(pattern), F.filter(located(text, pattern, 1, LEAST, len(KINDS)), random)).otherwise(F.array().cast(SPAN))


def named(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(df: DataFrame) -> DataFrame:
    """`df`'s doc_id and text with `base` and `spans`, the latter with the method's."""
    ratios = train(df)
    df = df.select("doc_id", text_of().alias("text"))
    df = df.select("*", base_spans(F.col("text")).alias("base"))
    return df.select("*", F.array_sort(F.concat("base", markov_spans(F.col("text"), F.col("base"), ratios))).alias("spans"))


def digest_spans(df: DataFrame) -> DataFrame:
    """The contract's columns, and n_markov."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    kinds = [*(k[0] for k in KINDS), MARKOV]
    return scan(df).select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(kinds)], F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def redact(df: DataFrame) -> DataFrame:
    """`df` with every span of its text replaced by `<secret>` (overlapping spans by one), and n_chars, if there, counted anew for those rows; a null text stays null, and all other columns stay, whatever their names."""
    ratios = train(df)
    keep = df.columns
    base, spans = fresh(df, "_base"), fresh(df, "_spans")
    df = df.withColumn(base, base_spans(F.coalesce("text", F.lit(""))))
    df = df.withColumn(spans, F.array_sort(F.concat(base, markov_spans(F.coalesce("text", F.lit("")), F.col(base), ratios))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit("<secret>")))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), piece.alias("out"))

    done = F.aggregate(spans, state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    df = df.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text")))
    if "n_chars" in keep:
        df = df.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*[f"`{c}`" for c in keep])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_spans(table(spark, sf_dir, "documents"))
