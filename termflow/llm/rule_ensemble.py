"""Quality classifier: a sparse rule ensemble, compiled into column expressions.

`statistics` counts a text's features with DataFrame functions. On a bounded sample of labelled rows
(PER_CLASS of each class, their statistics only) the driver grows small boosted trees, reads every path
from a root as a conjunctive rule, and fits lasso logistic weights over the rules; most weights become
zero. `compiled` turns the rest into one expression that scores all texts inside the executors' JVMs.

Defined results: a null text counts as empty and gets the score of an empty text; without labelled rows
of both classes every score is about the known class (0.5 without any); of cuts with equal gain the first
statistic's and the least wins, of rules that cover the same rows the shortest; repeated rows get equal scores;
rows without doc_id are scored, but never learnt from and not held out; texts are measured whole; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import held_out, labelled_texts, table, text_of
from termflow.llm.quality_rules import repeated_words

#: Labelled rows of each class that are learnt from at most.
PER_CLASS = 2000
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
TREES, DEPTH, LEAF, CANDIDATE_CUTS, SHRINK, ROW_SHARE, SEED = 40, 3, 12, 24, 0.3, 0.6, 7
LASSO, STEPS = 0.002, 600
STATISTICS = ["words", "word_length", "symbols", "uppers", "digits", "stops", "shouts", "bars", "foreign", "distinct", "repeats", "line_words", "dup_lines"]
#: (statistic, True for "at most", cut) of each condition.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(df: DataFrame) -> DataFrame:
    """`df` (with text) with STATISTICS as doubles; text is dropped."""
    rest = [c for c in df.columns if c != "text"]
    df = df.select(*rest, text_of().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \t-\r]"))
    df = df.select(*rest, F.array_remove(F.split("text", "[ \t-\r]+"), "").alias("_words"), lines.alias("_lines"))
    df = df.select("*", F.array_join("_words", "").alias("_all"))
    share = lambda pattern: (F.length("_all") - F.length(F.regexp_replace("_all", pattern, ""))) / F.greatest(F.length("_all"), F.lit(1))
    n, lines = F.greatest(F.size("_words"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    values = [
        F.size("_words"), F.length("_all") / n, share("[#*$%&|<>]+"), share(r"[\p{Lu}]+"), share("[0-9]+"), share("[.,;:?]+"), share("!+"), share(r"\|+"), share("[^\\x00-\\x7f]+"),
        F.size(F.array_distinct("_words")) / n, repeated_words(F.col("_words")) / n, F.size("_words") / lines, (F.size("_lines") - F.size(F.array_distinct("_lines"))) / lines,
    ]
    return df.select(*rest, *[v.cast("double").alias(k) for k, v in zip(STATISTICS, values, strict=True)])


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, path: Rule, depth: int, out: list[Rule]) -> list[tuple[np.ndarray, float]]:
    """A regression tree on the residuals; adds the rule of every node but the root to `out`, returns (rows, value) of the leaves."""
    if path:
        out.append(path)
    total, best = weight.sum(), (1e-9, -1, 0.0)
    value = float((weight * residual).sum() / max(total, 1e-12))
    leaf = [(np.ones(len(x), bool), value)]
    if depth == 0 or len(x) < 2 * LEAF:
        return leaf
    for j in range(x.shape[1]):
        for at in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CANDIDATE_CUTS))):
            left = x[:, j] <= at
            if min(left.sum(), (~left).sum()) < LEAF:
                continue
            a, b = (weight * residual)[left].sum(), (weight * residual)[~left].sum()
            p = weight[left].sum()
            if (gain := a * a / p + b * b / (total - p) - (a + b) ** 2 / total) > best[0]:
                best = (gain, j, float(at))
    if best[1] < 0:
        return leaf
    _, j, at = best
    leaves = []
    for side in (True, False):
        rows = np.flatnonzero((x[:, j] <= at) == side)
        for own, v in grow(x[rows], residual[rows], weight[rows], (*path, (STATISTICS[j], side, at)), depth - 1, out):
            full = np.zeros(len(x), bool)
            full[rows[own]] = True
            leaves.append((full, v))
    return leaves


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Which rows a rule covers."""
    out = np.ones(len(x), bool)
    for name, at_most, at in rule:
        out &= (x[:, STATISTICS.index(name)] <= at) == at_most
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[Rule, float]]:
    """Intercept and the rules whose lasso logistic weight isn't zero."""
    weight = weight / weight.sum() * len(y)
    rng, rules, margin = np.random.default_rng(SEED), [], np.zeros(len(y))
    for _ in range(TREES):
        rows = np.sort(rng.permutation(len(y))[: max(1, int(ROW_SHARE * len(y)))])
        found: list[Rule] = []
        residual = y - 1 / (1 + np.exp(-margin))
        for own, v in grow(x[rows], residual[rows], weight[rows], (), DEPTH, found):
            margin[rows[own]] += SHRINK * 4 * v
        rules += found
    cover = {holds(r, x).tobytes(): r for r in sorted(set(rules), key=lambda r: (-len(r), r))}  # of rules that cover the same rows the shortest stays
    rules = sorted(cover.values())
    a = np.array([holds(r, x) for r in rules], float).T.reshape(len(y), -1)
    spread = np.sqrt(np.maximum(a.mean(0) * (1 - a.mean(0)), 1e-4))
    a = (a - a.mean(0)) / spread
    step = 4 * len(y) / max(1e-9, float(np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2))
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 0.0, 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        g = weight * (1 / (1 + np.exp(-(a @ v + b))) - y) / len(y)
        new = v - step * (a.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        b -= min(step * a.shape[1], 2.0) * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    raw = np.array([holds(r, x).mean() for r in rules])
    return float(b - (w * raw / spread).sum()), {r: float(c / s) for r, c, s in zip(rules, w, spread, strict=True) if abs(c) > 1e-6}


def learn(documents: DataFrame, labels: DataFrame) -> tuple[float, dict[Rule, float]]:
    """Intercept and weights from a bounded sample of labelled documents outside the held-out fold."""
    texts, counts = labelled_texts(documents, labels, "quality", FOLDS, HELD_OUT, PER_CLASS)
    rows = sorted(statistics(texts).collect(), key=lambda r: r["doc_id"]) if len(counts) else []  # PER_CLASS rows of numbers for each class
    y = np.array([float(r["label"] > 0) for r in rows])
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return float(np.log((share + 0.01) / (1.01 - share))), {}
    x = np.array([[r[s] for s in STATISTICS] for r in rows])
    taken = {k: max(1, sum(r["label"] == k for r in rows)) for k in counts}
    return fit(x, y, np.array([counts[r["label"]] / taken[r["label"]] for r in rows]))


def compiled(model: tuple[float, dict[Rule, float]]) -> Column:
    """The model as one expression over STATISTICS: 0 to 1."""
    margin = F.lit(model[0])
    for rule, w in model[1].items():
        cond = F.lit(True)
        for name, at_most, at in rule:
            cond = cond & ((F.col(name) <= at) if at_most else (F.col(name) > at))
        margin = margin + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn(documents, table(spark, sf_dir, "labels"))
    scored = statistics(documents.select("doc_id", "text")).select("doc_id", compiled(model).alias("score"))
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
