"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, names (capitalised words, at the start of a sentence
too) and units (after a number) become typed placeholders, all other words their lower-cased letters. Every
place starts a window of WINDOW tokens. One with fewer than LITERALS literal tokens says too little as a
template: it grows until it holds so many, and counts besides by its words as they are, so verbatim copies
of slot-dense texts always fit. Hashes of the benchmark's windows set a bitmap that goes to all workers;
document windows outside it are never emitted, the others are hash-joined with the benchmark's.

For each document, item and alignment the slots are compared: a value of the item must stand for one value
of the document wherever it occurs, and a document's name for one name of the item. An alignment with more
conflicts than TOLERANCE of its slots is not a re-parameterised copy: of its windows only those count whose
slots are unchanged. A document is contaminated by an item if COVER of the item's windows, or ENOUGH of them, fit.

Defined results: an item shorter than a window is one window of its own length (compared by its words if that
holds fewer than all but one of its tokens as literals, or has under four); a place of an item after which
LITERALS literals don't follow has the window of its words only; null and empty texts or items match nothing;
identical items count once, under their least item_id; of items with equal coverage and windows the one of least
item_id is named; repeated rows of a document are one and rows without doc_id are not looked at (and kept by
`drop_contaminated`); texts are read whole; empty tables give an empty result; further columns are ignored by the
query and kept by `drop_contaminated`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import cut, grouped, held, mapped, small_side, table, text_of, without
from termflow.llm.near_dedup import mixed, powers

WINDOW, LITERALS = 8, 5
COVER, ENOUGH, TOLERANCE = 0.5, 24, 0.05
#: Bits of the bitmap for each window of the benchmark, and its size at least and at most; a fuller one only lets more windows reach the join.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 23, 1 << 28
CACHE_WORDS = 120_000
#: Words and signs that are units when they follow a number.
UNITS = set("% ° °c °f $ € £ ¥ mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours d day days week weeks month months year years am pm mph kmh km/h m/s hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal n pa k c f degree degrees percent cent cents dollar dollars euro euros times".split())
NUMBER = re.compile(r"^[-+]?[$€£¥]?\d[\d.,:/]*(?:st|nd|rd|th)?$|^[-+]?[$€£¥]?\d[\d.,]*([^\W\d]{1,4}|%|°[cf]?)$", re.IGNORECASE)
EDGES = re.compile(r"^[^\w$€£¥%°+-]+|[^\w%°]+$|^[-+](?!\d)")
NUM, NAME, UNIT = 1, 2, 3


class Tokens(NamedTuple):
    """The tokens of some texts, one text after another: template and plain hashes, slot types (0: literal), word ids, first and last token of each token's text."""

    typed: np.ndarray
    plain: np.ndarray
    kind: np.ndarray
    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Canon:
    """Template tokens of texts; what each word is, is remembered."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple[int, int, bool]] = []  # of words that aren't in the tables yet
        self.values: list[str] = [""]  # id 0 is no word
        self.size = 1
        self.tables = [np.zeros(CACHE_WORDS * 2, k) for k in (np.uint64, np.int8, bool)]

    def look(self, word: str) -> int:
        """Id of a word; notes its hash, its slot type and whether it is a unit word."""
        bare = word if word.isalpha() else word[:-1] if word[:-1].isalpha() and not word[-1].isalnum() and word[-1] not in "%°" else EDGES.sub("", word) or word
        low = bare.lower()
        raw = low.encode("utf-8", "surrogatepass")
        plain = int.from_bytes(raw if len(raw) <= 8 else hashlib.blake2b(raw, digest_size=8).digest(), "little")
        kind = NAME if bare[:1].isupper() and bare[1:2].islower() else 0 if bare.isalpha() else NUM if NUMBER.match(bare) else 0
        self.ids[word] = i = len(self.values)
        self.values.append(low)
        self.rows.append((plain, kind, low in UNITS))
        return i

    def fill(self) -> None:
        """Put the noted words into the tables."""
        to = len(self.values)
        for k, column in enumerate(zip(*self.rows, strict=True)):
            if to > len(self.tables[k]):
                self.tables[k] = np.concatenate([self.tables[k], np.zeros(to, self.tables[k].dtype)])
            self.tables[k][self.size : to] = column
        self.size, self.rows = to, []

    def read(self, texts: list[str]) -> Tokens:
        """The tokens of all texts."""
        if len(self.ids) > CACHE_WORDS:
            self.reset()
        get, look = self.ids.get, self.look
        ids: list[int] = []
        bounds = [0]
        for text in texts:
            ids += [get(w) or look(w) for w in text.split()]
            bounds.append(len(ids))
        ids = np.array(ids, np.int64)
        if self.rows:
            self.fill()
        plain, kind, unit = (t[ids] for t in self.tables)
        sizes = np.diff(bounds)
        begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        after = np.zeros(len(ids), bool)  # follows a number of its text
        after[1:] = (kind[:-1] == NUM) & (begin[1:] == begin[:-1])
        kind = np.where(unit & after & (kind == 0), np.int8(UNIT), kind)
        plain = mixed(plain)
        return Tokens(np.where(kind > 0, mixed(kind.astype(np.uint64), 1), plain), plain, kind, ids, begin, end)


def windows(t: Tokens, lengths: list[int], item: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and hash of the windows, and whether that is of the words as they are.

    `lengths` are those of items shorter than WINDOW that documents are searched for. Of an item's place
    only the most telling window is made.
    """
    size = len(t.kind)
    up, down = powers(size + 1)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x * up[:-1], dtype=np.uint64)]) for x in (t.typed, t.plain)]
    literal = np.flatnonzero(t.kind == 0)
    many = np.concatenate([[0], np.cumsum(t.kind == 0)])
    out: list[tuple[np.ndarray, ...]] = []

    def add(p: np.ndarray, n: np.ndarray, plain: bool) -> None:
        s = sums[plain]
        h = mixed((s[p + n] - s[p]) * down[p] + n.astype(np.uint64) * np.uint64(2) + np.uint64(plain), 1) | np.uint64(1)
        out.append((p, n, h, np.full(len(p), plain)))

    p = np.flatnonzero(np.arange(size) + WINDOW <= t.end)
    dense = many[p + WINDOW] - many[p] < LITERALS
    add(p[~dense], np.full((~dense).sum(), WINDOW), False)
    p = p[dense]
    last = many[p] + LITERALS - 1  # the literal at which it holds enough
    stop = np.concatenate([literal, [size]])[np.minimum(last, len(literal))] + 1
    grows = stop <= t.end[p]
    add(p[grows], stop[grows] - p[grows], False)
    own = p[~grows] if item else p
    add(own, np.full(len(own), WINDOW), True)
    for n in lengths if not item else range(1, WINDOW):
        p = np.flatnonzero(np.arange(size) + n <= t.end)
        p = p[(p == t.begin[p]) & (p + n == t.end[p])] if item else p
        plain = (many[p + n] - many[p] < min(LITERALS, n - 1)) | (n < 4)
        for kind in (False, True):
            add(p[plain == kind], np.full((plain == kind).sum(), n), kind)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def slots(canon: Canon, t: Tokens, p: int, n: int, item: bool) -> str:
    """Values of the slots in a window, one to a line; those of items with their place in the window and their type."""
    at = np.flatnonzero(t.kind[p : p + n]).tolist()
    return "\n".join([f"{k}:{t.kind[p + k]}:{canon.values[t.ids[p + k]]}" if item else canon.values[t.ids[p + k]] for k in at])


WINDOWS = "id long, hash long, pos int, slots string, length int"


def windowed(df: DataFrame, lengths: list[int] | None = None, bitmap=None) -> DataFrame:
    """id, hash, pos, slots, length of the windows of items (id, text); with a bitmap, of documents' windows in it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        canon = held("decontam", lambda: Canon())
        t = canon.read(batch.column(1).to_pylist())
        if not len(t.kind):
            return None
        p, n, h, plain = windows(t, lengths or [], bitmap is None)
        if bitmap is not None:
            bits = bitmap.value
            at = ((h >> np.uint64(20)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            p, n, h, plain = p[keep], n[keep], h[keep], plain[keep]
        if not len(p):
            return None
        starts = np.flatnonzero(np.concatenate([[True], t.begin[1:] != t.begin[:-1]]))
        texts = np.flatnonzero(np.array([bool(x and not x.isspace()) for x in batch.column(1).to_pylist()]))  # those with tokens
        of = texts[np.searchsorted(t.begin[starts], t.begin[p])]
        said = ["" if w else slots(canon, t, a, b, bitmap is None) for a, b, w in zip(p.tolist(), n.tolist(), plain.tolist(), strict=True)]
        columns = (batch.column(0).take(pa.array(of)), pa.array(h.view(np.int64)), pa.array(p - t.begin[p], pa.int32()), pa.array(said, pa.string()), pa.array(n, pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns), ["id", "hash", "pos", "slots", "length"])

    return mapped(df, run, WINDOWS, 256)


def bits_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all hashes; each of eight tasks sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            at = ((b.column(0).to_numpy().view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits >> 3, np.uint8)
    for r in hashes.select("hash").repartition(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


class Slot(NamedTuple):
    """A slot of an alignment: its place in the item, its type and both values."""

    at: int
    kind: str
    ours: str
    theirs: str


def slots_of(at: int, ours: str, theirs: str) -> list[Slot]:
    """The slots of a pair of windows."""
    if not ours:
        return []
    mine = [x.split(":", 2) for x in ours.split("\n")]
    return [Slot(at + int(k), kind, a, b) for (k, kind, a), b in zip(mine, theirs.split("\n"), strict=True)]


def conflicts(slots: set[Slot]) -> int:
    """Slots that don't follow the mapping most slots agree on: item value to document value, and document name to item name."""
    there: dict[tuple, Counter] = defaultdict(Counter)
    for s in slots:
        there[0, s.kind, s.ours][s.theirs] += 1
        if s.kind == str(NAME):
            there[1, s.kind, s.theirs][s.ours] += 1
    return sum(sum(n.values()) - max(n.values()) for n in there.values())


def consistent(got: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
    """For each document and item: the item's windows that count, its windows, distinct pairs of slot values, those with another value, and conflicts."""
    cols = {n: got.column(n).to_pylist() for n in ("doc_id", "item_id", "pos", "at", "theirs", "ours", "of")}
    out: list[list] = [[], [], [], [], [], [], []]
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        by: dict[int, list[tuple[int, list[Slot]]]] = {}
        for r in range(x, y):
            by.setdefault(cols["pos"][r] - cols["at"][r], []).append((cols["at"][r], slots_of(cols["at"][r], cols["ours"][r], cols["theirs"][r])))
        fit: set[int] = set()
        pairs: set[tuple[str, str]] = set()
        wrong = 0
        for pairs_of_windows in by.values():
            every = {s for _, own in pairs_of_windows for s in own}
            bad = conflicts(every)
            refused = bad > TOLERANCE * len(every)
            wrong += bad
            for at, own in pairs_of_windows:
                if not refused or all(s.ours == s.theirs for s in own):
                    fit.add(at)
                    pairs.update((s.ours, s.theirs) for s in own)
        if len(fit) >= COVER * cols["of"][x] or len(fit) >= ENOUGH:
            for c, v in zip(out, (cols["doc_id"][x], cols["item_id"][x], len(fit), cols["of"][x], len(pairs), sum(a != b for a, b in pairs), wrong), strict=True):
                c.append(v)
    if not out[0]:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "n_windows", "of_windows", "n_slots", "n_changed", "n_conflicts"])


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, of_windows, n_slots, n_changed, n_conflicts of every document and item that it holds."""
    spark = documents.sparkSession
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("id")).select("id", "text")
    ours = cut(windowed(items))
    of = ours.groupBy("id").agg(F.countDistinct("pos").alias("of"))
    ours = cut(ours.join(of, "id").select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("at"), F.col("slots").alias("ours"), F.col("length").alias("_length"), "of"))
    n, short = ours.agg(F.count("*"), F.sort_array(F.collect_set(F.when(F.col("_length") < WINDOW, F.col("_length"))))).first()  # lengths under WINDOW
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    bitmap = spark.sparkContext.broadcast(bits_of(ours, bits))
    theirs = windowed(documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), text_of().alias("text")), list(short), bitmap)
    theirs = theirs.select(F.col("id").alias("doc_id"), "hash", "pos", F.col("slots").alias("theirs"), "length")
    both = theirs.join(small_side(ours), "hash").filter("length = _length")
    key = F.concat_ws(":", "doc_id", "item_id")
    return grouped(both.select(key.alias("key"), "doc_id", "item_id", "pos", "at", "theirs", "ours", "of"), "key", consistent, "doc_id long, item_id long, n_windows long, of_windows long, n_slots long, n_changed long, n_conflicts long")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document: the item it holds most of, that item's windows, slots, changed slots and conflicts, and how many items it holds."""
    found = contaminated(documents, benchmark)
    best = F.max(F.struct((F.col("n_windows") / F.col("of_windows")).alias("coverage"), "n_windows", (-F.col("item_id")).alias("_item"), "n_slots", "n_changed", "n_conflicts")).alias("b")
    df = found.groupBy("doc_id").agg(best, F.count("*").alias("n_items"))
    return df.select("doc_id", (-F.col("b._item")).alias("item_id"), "b.n_windows", "b.coverage", "b.n_slots", "b.n_changed", "b.n_conflicts", "n_items")


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `df` that hold no benchmark item."""
    return without(df, contaminated(df, benchmark).select("doc_id").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
