"""Language identification with blended-spectrum string kernels.

A text's features are the character n-grams (one to three long) that occur in it: letters lower-cased,
runs of everything else one boundary, each n-gram hashed to BITS bits of its length. The kernel of two
texts counts the n-grams both have, over the geometric mean of how many each has. Texts of a bounded
labelled sample, as many of each language, span a Nyström space, and one-versus-rest kernel ridge
regression is solved in it: workers project the sample on the landmarks and send sums of products, the
driver solves for the weights. Workers score batches of whole texts by matrix products: presence x
landmarks, then x weights.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text if no
language could be learnt; every value of lang is a language, however rare; of languages with equal scores
the first in order is predicted; repeated rows get equal results; rows without doc_id are predicted, but
never learnt from and not held out; texts are read whole; an empty table gives an empty result; further
columns (lang and source among them) are no input of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import bounded_sample, crc_mod, held_out, mapped, release, ship, table, text_of

FOLDS, HELD_OUT = 4, 2
#: Labelled texts of each language that are learnt from at most; landmarks in all, but one of each language at least.
PER_LANGUAGE, LANDMARKS = 200, 64
RIDGE, TEMPERATURE, ROWS = 1e-3, 0.15, 128
#: Bits of the hash of an n-gram; each length has its own numbers.
BITS = 18
SPACE = 3 << BITS
_TIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (2), marks that belong to one (1) or neither (0)."""
    if not _letters:
        _letters.append(np.array([2 if chr(c).isalpha() else unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)], np.uint8))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Ids of the text's n-grams, with repetitions; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letters()[points]
    if not (kind == 2).any():
        return np.zeros(0, np.int64)
    a = np.where(kind > 0, points, np.uint32(0))
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)  # runs of other characters are one boundary
    a = np.concatenate([np.zeros(1, np.uint32), a[keep], np.zeros(1, np.uint32)])
    one = a * _TIMES[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _TIMES[1] + a[1:] * _TIMES[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * _TIMES[1] + a[2:] * _TIMES[2]
    ids = [((x ^ (x >> np.uint32(14))) * _TIMES[0] >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS) for k, x in enumerate((one, two, three))]
    return np.concatenate(ids)


class Presence:
    """Scratch space that turns texts into presence rows over a vocabulary."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.flags = vocabulary, np.zeros(SPACE, bool)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence (float32) over the vocabulary, and how many distinct n-grams each text has."""
        out, sizes = np.zeros((len(texts), len(self.vocabulary)), np.float32), np.zeros(len(texts), np.float32)
        for i, text in enumerate(texts):
            ids = grams(text)
            if len(ids):
                self.flags[ids] = True
                out[i], sizes[i] = self.flags[self.vocabulary], np.count_nonzero(self.flags)
                self.flags[ids] = False
        return out, sizes


class Space:
    """The landmarks: vocabulary, and a matrix (vocabulary x landmarks) of presence over the root of each one's size."""

    def __init__(self, marks: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(marks))
        self.own = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for j, x in enumerate(marks):
            self.own[np.searchsorted(self.vocabulary, x), j] = 1 / np.sqrt(len(x))

    def kernel(self, texts: list[str], presence: Presence) -> tuple[np.ndarray, np.ndarray]:
        """Kernel of texts and landmarks, and the texts' sizes."""
        has, sizes = presence.rows(texts)
        return (has @ self.own) / np.sqrt(np.maximum(sizes, 1))[:, None], sizes


def products(sample: DataFrame, space: Space, languages: list[str], weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums over the sample (text, lang) of kernel rows' products with themselves and with the languages; a task sends one of each."""
    sent = sample.sparkSession.sparkContext.broadcast(space)
    m, order = space.own.shape[1] + 1, {g: i for i, g in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(__name__)
        square, cross, presence = np.zeros((m, m)), np.zeros((m, len(languages))), Presence(sent.value.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                k, sizes = sent.value.kernel(part.column(0).to_pylist(), presence)
                phi = np.hstack([k, np.ones((len(k), 1))])[sizes > 0].astype(np.float64)
                of = [g for g, n in zip(part.column(1).to_pylist(), sizes, strict=True) if n]
                share = np.array([weights[g] for g in of])
                square += phi.T @ (phi * share[:, None])
                np.add.at(cross.T, [order[g] for g in of], phi * share[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())], ["a", "b"])

    ship(sample.sparkSession)
    square, cross = np.zeros((m, m)), np.zeros((m, len(languages)))
    for r in sample.select("text", "lang").repartition(8).mapInArrow(run, "a binary, b binary").toLocalIterator():
        square += np.frombuffer(r["a"]).reshape(m, m)
        cross += np.frombuffer(r["b"]).reshape(m, -1)
    return square, cross


def learn(documents: DataFrame) -> tuple[list[str], Space, np.ndarray] | None:
    """Languages, landmarks and weights (landmarks and a constant x languages)."""
    known = documents.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    lettered = known.filter(F.col("text").rlike(r"\p{L}"))
    sample, counts = bounded_sample(lettered.select("doc_id", "lang"), "doc_id", "lang", PER_LANGUAGE)
    if not counts:
        return None
    languages = sorted(counts)
    each = -(-LANDMARKS // len(languages))
    chosen = known.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "lang", "nth")  # bounded by PER_LANGUAGE of each language

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.unique(grams(t)).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["lang", "ids"])

    got = mapped(chosen.filter(F.col("nth") <= each).select("lang", "text"), distinct, "lang string, ids binary").collect()  # the landmarks
    marks = sorted((r["lang"], r["ids"]) for r in got if r["ids"])
    if not marks:
        return None
    space = Space([np.frombuffer(ids, np.int32) for _, ids in marks])
    taken = {g: 1.0 / min(PER_LANGUAGE, n) for g, n in counts.items()}
    square, cross = products(chosen, space, languages, taken)
    value, vector = np.linalg.eigh((space.own.T @ space.own).astype(np.float64))
    good = value > 1e-6
    root = np.zeros((len(value) + 1, good.sum() + 1))
    root[:-1, :-1], root[-1, -1] = vector[:, good] / np.sqrt(value[good]), 1  # to the inverse square root, and the constant
    w = np.linalg.solve(root.T @ square @ root + RIDGE * np.eye(root.shape[1]), root.T @ cross)
    return languages, space, (root @ w).astype(np.float32)


def predict(df: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # the landmarks' n-grams: bounded by their number x SPACE
    state: dict[str, Presence] = {}

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        lang, best = np.array(["und"] * len(texts), object), np.zeros(len(texts))
        if sent.value is not None:
            languages, space, weights = sent.value
            if "presence" not in state:
                state["presence"] = Presence(space.vocabulary)
            kernel, sizes = space.kernel(texts, state["presence"])
            z = (kernel @ weights[:-1] + weights[-1]) / TEMPERATURE
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            ok = sizes > 0
            lang[ok], best[ok] = np.array(languages, object)[p.argmax(1)][ok], p.max(1)[ok]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(best.clip(0, 1), pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(df.select("doc_id", text_of().alias("text")), score, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, learn(documents)).select("doc_id", held_out(FOLDS, HELD_OUT), "lang_pred", "score")
