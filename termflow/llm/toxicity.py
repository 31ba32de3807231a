"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (signs or digits among its letters, a letter three times or more, letters
spaced out) becomes a lattice of characters: a sign or digit may stand for letters it resembles, a mask
for any letter, a repeated letter or a separator for nothing. Viterbi decoding under a character
trigram model picks the likeliest reading; other words are their own reading. Words over LONG characters
are addresses or keys: the parts between their signs are words (not decoded if still over LONG), and
spaced-out letters are read LONG at a time. The restored words are scored: terms (whole words and word
beginnings) whose rate differs significantly between toxic and other labelled texts have a log-rate
weight, and a logistic curve over a text's summed weight and its density gives the score.

The character model counts all texts outside the held-out fold, labelled or not. Term weights and the
curve come from a bounded sample (PER_CLASS labelled texts of each class outside that fold). Workers count,
only counts are merged, and the driver gets at most TERMS terms and the TRIGRAMS most frequent trigrams.

Defined results: a null text counts as empty and gets the score of a text without toxic terms, which is under
0.49 however the labels fall; without labels of both classes every score is the toxic share, under 0.49 too; repeated rows get equal
scores; of readings of equal cost the option listed first wins; a row without doc_id is scored, never learnt
from and not held out; texts are read whole; an empty table gives an empty result; further columns are no input.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import Recent, crc_mod, held, held_out, labelled_texts, mapped, ship, table, text_of

FOLDS, HELD_OUT, CUT = 5, 0, 0.5
#: Labelled texts of each class, terms and trigrams that are kept at most.
PER_CLASS, TERMS, TRIGRAMS = 4000, 20_000, 60_000
#: Beginnings that are terms, share of false ones among the significant terms, least log rate, and pseudo-counts.
SHORTEST, LONGEST, FALSE_SHARE, LEAST_RATE, PRIOR = 4, 8, 0.01, 1.5, 0.5
#: Letters that a sign or digit is written for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "ø": "o"}
MASKS, SEPARATORS = "*#?%", ".-_~'`^/\\,:;"
#: Costs (negative logs) of the channel: reading a look-alike, any letter for a mask, dropping a separator, a letter of a run of three or more, one of two, or an unread sign.
SWAP, MASK, DROP, AGAIN, TWICE, LOST = 0.4, 2.5, 0.3, 0.1, 3.0, 12.0
#: Log-odds at most of a text without toxic terms: it is never predicted toxic.
NO_TERMS = -0.05
CACHE_WORDS, ROWS = 60_000, 128
EDGE = ".,;:!?\"'()[]{}<>|*%&#$«»„“”‘’¿¡…-–—_/\\=+~`^"
DISGUISED = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][\d_@$!|+€£]|[\d_@$!|+€£][^\W\d_]|([^\W\d_])\1\1")
#: What of DISGUISED a word of letters only can have.
THRICE = re.compile(r"(.)\1\1")
#: Characters of a word at most that may be disguised: of longer ones (addresses, keys) the parts between signs are words.
LONG, PARTS = 40, re.compile(r"[^\W_]+")
#: Stands for every character that the model has no count of: no letter of any text.
OTHER = "\ufffe"
FOUR_LETTERS = bytes([1, 1, 1, 1])
SPACED = re.compile(r"(?:(?<=\s)|^)[^\s](?:\s[^\s]){3,}(?=\s|$)")


class Channel:
    """The character model and the lattice decoder."""

    def __init__(self, trigrams: dict[str, int]):
        pairs, singles, self.tri = Counter(), Counter(), trigrams
        for t, n in trigrams.items():
            pairs[t[:2]] += n
            singles[t[2]] += n
        self.pairs, self.singles, self.total = pairs, singles, sum(singles.values()) + 1.0
        self.letters = [c for c, _ in singles.most_common(40) if c.isalpha()]
        self.cost: dict[str, float] = {}
        #: Characters of the model; the last one stands for all others, which it knows nothing of.
        self.symbols = ["^", *sorted({c for t in trigrams for c in t} - {"^", "$"}), OTHER]
        self.number = {c: i for i, c in enumerate(self.symbols)}
        self._table: np.ndarray | None = None

    def letter(self, context: str, c: str) -> float:
        """-log P(c | two characters before), interpolated with the single character's share."""
        key = context + c
        if key not in self.cost:
            n = self.pairs.get(context, 0)
            one = (self.singles.get(c, 0) + 0.1) / (self.total + 10)
            self.cost[key] = -math.log((self.tri.get(key, 0) + 2.0 * one) / (n + 2.0))
        return self.cost[key]

    @property
    def table(self) -> np.ndarray:
        """`letter` of all symbols: [first, second, next], the end of a word as the last `next`."""
        if self._table is None:
            k, to = len(self.symbols), [*self.symbols, "$"]
            one = np.array([(self.singles.get(c, 0) + 0.1) / (self.total + 10) for c in to])
            counts, at = np.zeros((k, k, k + 1)), {c: i for i, c in enumerate(to)}
            for t, n in self.tri.items():
                if t[0] in self.number and t[1] in self.number:
                    counts[self.number[t[0]], self.number[t[1]], at[t[2]]] += n
            n = np.array([[self.pairs.get(a + b, 0) for b in self.symbols] for a in self.symbols], float)
            self._table = -np.log((counts + 2.0 * one) / (n[:, :, None] + 2.0))
        return self._table

    def options(self, word: str, i: int) -> list[tuple[str, float]]:
        """Readings of one character ('' drops it) with the channel's cost."""
        c = word[i]
        again = AGAIN if c * 3 in word[max(0, i - 2) : i + 3] else TWICE
        if c.isalpha() and c not in LOOKS:
            return [(c, 0.0), ("", again)] if i and word[i - 1] == c else [(c, 0.0)]
        out = [(x, SWAP) for x in LOOKS.get(c, "")]
        if c in MASKS:
            out += [(x, MASK) for x in self.letters]
        if i and word[i - 1] == c:
            out.append(("", again))
        return [*out, ("", DROP if c in SEPARATORS or c.isspace() else LOST)]

    def decode(self, word: str) -> str:
        """The likeliest reading; a state is the two last letters read. Of equal costs the option listed first wins."""
        if any(c in MASKS for c in word):
            return self.decode_masked(word)
        best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for i in range(len(word)):
            after: dict[str, tuple[float, str]] = {}
            for c, extra in self.options(word, i):
                for state, (cost, read) in best.items():
                    # a dropped repetition must repeat what was read
                    if not c and word[i].isalpha() and word[i] not in LOOKS and state[1] != word[i]:
                        continue
                    to, sum_ = (state[1] + c, cost + extra + self.letter(state, c)) if c else (state, cost + extra)
                    if to not in after or sum_ < after[to][0]:
                        after[to] = (sum_, read + c)
            best = after or best
        return min((cost + self.letter(s, "$"), read) for s, (cost, read) in best.items())[1]

    def decode_masked(self, word: str) -> str:
        """`decode` with all states in one matrix [last but one, last], as a mask leads to every pair of letters."""
        k, other = len(self.symbols), len(self.symbols) - 1
        number = lambda c: self.number.get(c, other)
        cost = np.full((k, k), np.inf)
        cost[0, 0] = 0.0
        steps = []  # by place: the option that led to each state, and the letter before its two
        for i in range(len(word)):
            after, option, before = np.full((k, k), np.inf), np.zeros((k, k), np.int16), np.zeros((k, k), np.int16)
            options = self.options(word, i)
            for o, (c, extra) in enumerate(options):
                if c:
                    x = number(c)
                    step = cost + self.table[:, :, x] + extra
                    first = step.argmin(0)
                    low = step[first, np.arange(k)]
                    better = low < after[:, x]
                    after[better, x], option[better, x], before[better, x] = low[better], o, first[better]
                else:
                    step = cost + extra
                    if word[i].isalpha() and word[i] not in LOOKS:
                        step = np.where(np.arange(k) == number(word[i]), step, np.inf)
                    better = step < after
                    after[better], option[better] = step[better], o
            steps.append((options, option, before))
            cost = after
        a, b = np.unravel_index(int((cost + self.table[:, :, k]).argmin()), cost.shape)
        read = []
        for options, option, before in reversed(steps):
            if c := options[option[a, b]][0]:
                read.append(c)
                a, b = before[a, b], a
        return "".join(reversed(read))


def readings(text: str) -> tuple[list[str], list[str]]:
    """The words of a text, lower-cased, long ones cut into their parts; and what spaced-out letters make up."""
    low = text.lower()
    words = low.split()
    if not words:
        return [], []
    sizes = [len(w) for w in words]
    longest, spaced = max(sizes), []
    if FOUR_LETTERS in bytes(sizes if longest < 256 else [min(n, 255) for n in sizes]):  # else no four single letters follow each other
        spaced = ["".join(x.split()) for x in SPACED.findall(low)]
    if longest > LONG:
        words = [p for w in words for p in ([w] if len(w) <= LONG else PARTS.findall(w))]
    return words, [s[at : at + LONG] for s in spaced for at in range(0, len(s), LONG)]


def restored(word: str, channel: Channel | None) -> str:
    """A word without its edges, decoded if it may be disguised."""
    bare = word if word.isalpha() else word.strip(EDGE)
    if channel is None or len(bare) > LONG or bare.isalpha() and not THRICE.search(bare):
        return bare
    # signs at an edge may stand for letters: then the word with them is decoded too, if it is a known term (see Scorer)
    return channel.decode(bare) if any(c.isalpha() for c in bare) and DISGUISED.search(bare) else bare


def terms(word: str) -> list[str]:
    """The whole word and its beginnings."""
    return [word + "$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))] if len(word) >= 2 else []


class Scorer:
    """Weights of raw words: that of the restored form's strongest term (0 for most)."""

    def __init__(self, weights: dict[str, float], channel: Channel):
        self.weights, self.channel, self.known = weights, channel, Recent(self.raw, CACHE_WORDS)
        self.starts = {t[:SHORTEST] for t in weights}  # how the words that have a term begin

    def of(self, word: str) -> float:
        if (word + "$")[:SHORTEST] not in self.starts:
            return 0.0
        return max([self.weights.get(t, 0.0) for t in terms(word)], default=0.0)

    def raw(self, word: str) -> float:
        value = self.of(restored(word, self.channel))
        if not value and (word[:1] in LOOKS or word[-1:] in LOOKS) and len(word) <= LONG and any(c.isalpha() for c in word):
            value = self.of(self.channel.decode(word))
        return value

    def features(self, text: str) -> tuple[float, float]:
        """Summed weight and weight per hundred words, as logs."""
        words, spaced = readings(text)
        known = self.known
        total = sum([known[w] for w in words]) + sum([known[s] for s in spaced])
        return math.log1p(total), math.log1p(100 * total / max(1, len(words)))


def counted(texts: DataFrame) -> DataFrame:
    """term, label, n (occurrences), docs; all words are the term of a tab and #."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                words = Counter(restored(w, None) for w in readings(text)[0])
                for w, k in words.items():
                    for t in terms(w):
                        own[t] += k
                    own["\t#"] += k
                n[label].update(own)
                docs[label].update(own.keys())
        rows = [(t, label, n[label][t], docs[label][t]) for label in (0, 1) for t in n[label]]
        for at in range(0, len(rows), 50_000):
            t, label, k, d = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(label, pa.int32()), pa.array(k, pa.int64()), pa.array(d, pa.int64())], ["term", "label", "n", "docs"])

    ship(texts.sparkSession)
    each = texts.select("text", (F.col("label") > 0).cast("int").alias("label")).mapInArrow(count, "term string, label int, n long, docs long")
    return each.groupBy("term", "label").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def trigrams_of(words: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    """Trigrams of words with their counts; ^^ begins a word and $ ends it."""
    if not words:
        return [], []
    points = np.frombuffer("".join([f"^^{w}$" for w, _ in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, number = np.unique(points, return_inverse=True)
    sizes, times = np.array([len(w) + 1 for w, _ in words]), np.array([k for _, k in words])
    last = np.repeat(np.cumsum(sizes + 2) - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = (number[last - 2] * len(letters) + number[last - 1]) * len(letters) + number[last]
    found, at = np.unique(code, return_inverse=True)
    n = np.bincount(at, np.repeat(times, sizes)).astype(np.int64)
    three = [letters[found // len(letters) ** 2], letters[found // len(letters) % len(letters)], letters[found % len(letters)]]
    return ["".join(map(chr, t)) for t in zip(*(x.tolist() for x in three), strict=True)], n.tolist()


def spelled(texts: DataFrame) -> DataFrame:
    """trigram, n of all texts: each task counts words, then the characters of the distinct ones, CACHE_WORDS words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            trigrams, n = trigrams_of([(w, k) for raw, k in words.items() if (w := restored(raw, None)).isalpha()])
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(trigrams, pa.string()), pa.array(n, pa.int64())], ["trigram", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(readings(text)[0])
                if len(words) > CACHE_WORDS:
                    yield flush()
        yield flush()

    ship(texts.sparkSession)
    return texts.mapInArrow(count, "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, hold = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6]) * weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + hold, a.T @ (weight * (p - y)) + hold @ w)
    return w


def significance(tenths: dict[int, int], tested: int) -> float:
    """The G-squared that keeps the false discovery rate (Benjamini-Hochberg, one-sided) at FALSE_SHARE, from counts of terms by tenths of it."""
    reached, least = 0, math.inf
    for k in sorted(tenths, reverse=True):
        reached += tenths[k]
        if tested * math.erfc(math.sqrt(max(k, 0) / 20)) / 2 <= FALSE_SHARE * reached:
            least = k / 10
    return least


def learn(documents: DataFrame, labels: DataFrame) -> dict:
    """Term weights, trigrams and the logistic curve."""
    texts, counts = labelled_texts(documents, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS)
    no, yes = sum(n for k, n in counts.items() if k <= 0), sum(n for k, n in counts.items() if k > 0)
    if not no or not yes:
        return {"id": uuid.uuid4().hex, "weights": {}, "trigrams": {}, "curve": [0.0, 0.0, min(math.log((yes + 0.5) / (no + 0.5)), NO_TERMS)]}
    found = counted(texts).groupBy("term").pivot("label", [0, 1]).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).fillna(0).cache()
    size = {int(k): (r or 0) for k, r in zip("01", found.filter(F.col("term") == "\t#").select("0_n", "1_n").first() or (0, 0), strict=True)}
    taken = [min(PER_CLASS, no), min(PER_CLASS, yes)]
    a, b, p, q = F.col("1_n") + PRIOR, F.col("0_n") + PRIOR, taken[1] / sum(taken), taken[0] / sum(taken)
    rate = F.log(a / (size[1] + 1.0)) - F.log(b / (size[0] + 1.0))
    d1, d0 = F.col("1_docs"), F.col("0_docs")
    part = lambda d, share: F.when(d > 0, d * F.log(d / ((d1 + d0) * share))).otherwise(0.0)
    strong = found.filter(~F.col("term").startswith("\t") & (d1 >= 3)).withColumns({"rate": rate, "g": 2 * (part(d1, p) + part(d0, q)), "more": d1 * q > d0 * p})
    tenths = strong.groupBy("more", F.floor(10 * F.least("g", F.lit(200.0))).alias("tenth")).count().collect()  # 2001 counts of each at most
    least = significance({r["tenth"]: r["count"] for r in tenths if r["more"]}, sum(r["count"] for r in tenths))
    strong = strong.filter((F.col("g") >= least) & (F.col("rate") >= LEAST_RATE) & F.col("more")).orderBy(F.desc("g"), "term").limit(TERMS)
    weights = {r["term"]: r["rate"] for r in strong.select("term", "rate").collect()}
    own = documents.filter(F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(True))).select(text_of().alias("text"))
    tri = spelled(own).orderBy(F.desc("n"), "trigram").limit(TRIGRAMS)
    model = {"id": uuid.uuid4().hex, "weights": weights, "trigrams": {r["trigram"]: r["n"] for r in tri.collect()}, "curve": [0.0, 0.0, 0.0]}
    found.unpersist()
    rows = featured(texts.select("doc_id", "text", "label"), model).orderBy("doc_id").collect()  # three numbers of PER_CLASS texts each
    y = np.array([float(r["label"] > 0) for r in rows])
    weight = np.where(y > 0, yes / taken[1], no / taken[0])
    a, b, c = logistic(np.array([[r["total"], r["density"]] for r in rows]), y, weight).tolist()
    model["curve"] = [a, b, min(c, NO_TERMS)]
    return model


def scorer(sent) -> Scorer:
    """This worker's scorer of a broadcast model."""
    return held(sent.value["id"], lambda: Scorer(sent.value["weights"], Channel(sent.value["trigrams"])))


def featured(df: DataFrame, model: dict) -> DataFrame:
    """`df` (doc_id, text, ...) without text, with total and density."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS and TRIGRAMS
    rest = [c for c in df.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scorer(sent)
        got = [own.features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], [*rest, "total", "density"])

    spec = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return mapped(df.select(*rest, text_of().alias("text")), run, spec + "total double, density double", ROWS)


def scored(df: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every text."""
    a, b, c = model["curve"]
    return featured(df.select("doc_id", "text"), model).select("doc_id", (1 / (1 + F.exp(-(a * F.col("total") + b * F.col("density") + c)))).alias("score"))


def keep_clean(df: DataFrame, model: dict) -> DataFrame:
    """The rows of `df` whose text scores under CUT; all columns stay as they are."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, (a, b, c) = scorer(sent), sent.value["curve"]
        keep = []
        for text in batch.column(at).to_pylist():
            x, y = own.features(text or "")
            keep.append(a * x + b * y + c < math.log(CUT / (1 - CUT)))
        return batch.filter(pa.array(keep, pa.bool_()))

    return mapped(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = scored(documents, learn(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(FOLDS, HELD_OUT), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
