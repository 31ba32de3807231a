"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Whole texts become sets of hashed five-word shingles and signatures of COORDS minima. Documents with
   the same set share one class, whose representative is its least doc_id.
2. Representatives are posted under (coordinate, value) for the first coordinates: two signatures
   that agree in m or more of COORDS agree in at least one of any COORDS - m + 1 (m: `matches_of`). Lists
   with one entry vanish in an aggregate of counts; in lists of up to LONG the collisions over all
   coordinates are counted, and members that agree in m or more are linked.
3. Longer lists (a line that many documents share) are skipped, as every representative is also posted
   under BANDS keys of WIDTH coordinates each. Long lists of those are posted again under pairs of keys;
   what is still long there agrees in 2 * WIDTH coordinates and is linked to its least member: one row
   each. Bands have no coordinate in common, so a pair at the threshold shares none with a chance of 2e-9
   at 85 % (3e-7 at 80 %) and just one with 7e-8 (6e-6): what a pair whose lists are all long can be
   missed by, besides MISS.
4. Links so far only say who is to be compared. Components of them are dealt into blocks of bounded
   size, and in each task the sets of a block are intersected exactly (64-bit shingle hashes). Blocks of a
   large component are compared with themselves and some anchors (those of least hash); then only members
   that aren't joined to its largest part yet are compared with all others (`exact_links`). Links that hold
   give the components that are returned. No step emits all pairs.

Defined results: documents without words have no shingles, are linked with nothing and are kept; so is a
row without doc_id, with a null component; a text
with fewer than five words is one shingle; repeated rows of a doc_id are one document (with different texts
it is linked by each of them); of a component the least doc_id is kept, whatever the similarities; an empty
table gives an empty result; further columns are ignored by the query and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.llm.common import cut, fresh, grouped, mapped, small_side, table, text_of, without, written
from termflow.llm.components import components

#: Words of a shingle; the query's similarity in percent, which its contract fixes (100 * intersection >= percent * union), and that of pipeline stages.
WORDS, PERCENT, SIMILAR = 5, 85, 80
#: Signature length, and the chance at most that a pair at the threshold has fewer agreements than a candidate needs.
COORDS, MISS = 64, 3e-6
#: Bands, and coordinates of each; no coordinate is in two bands.
BANDS, WIDTH = 21, 3
#: Entries of a list within which all members are compared by signature.
LONG = 256
#: Members and shingles of a block of a component, and members that all its blocks are compared with.
BLOCK, BLOCK_SHINGLES, ANCHORS = 512, 1_000_000, 16
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240607)
_odd = lambda n, kind: _rng.integers(0, np.iinfo(kind).max, n, dtype=kind) | kind(1)
ROOT = np.uint64(0x9E3779B97F4A7C15)
PLACE, MIX = _odd(WORDS, np.uint64), _odd(2, np.uint64)
FLIP, TIMES = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint32), _odd(COORDS, np.uint32)
TURN = _odd(COORDS, np.uint32)
#: Coordinates of each band.
BAND = _rng.permutation(COORDS)[: BANDS * WIDTH].reshape(BANDS, WIDTH)


def matches_of(percent: int) -> int:
    """Agreements of a candidate: the most that a pair at the threshold misses with a chance of MISS or less (40 at 85 %, 35 at 80 %)."""
    p, below, m = percent / 100, 0.0, 0
    while (below := below + math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)) <= MISS:
        m += 1
    return m


def mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * MIX[k]
    return x ^ (x >> np.uint64(29))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**k and its inverse modulo 2**64, k below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        inverse = np.uint64(pow(int(ROOT), -1, 1 << 64))
        for name, base in (("up", ROOT), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, and each text's first word's index (one more at the end)."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    buffer = np.where((buffer >= 65) & (buffer <= 90), buffer + np.uint8(32), buffer)
    inside = ~((buffer == 32) | ((buffer >= 9) & (buffer <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * PLACE[0])
    return h, np.concatenate([[0], np.searchsorted(first, ends)])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
            size += len(texts[to])
            to += 1
        h, starts = word_hashes(texts[at:to])
        n = max(0, len(h) - WORDS + 1)
        windows = np.zeros(n, np.uint64)
        for k in range(WORDS):
            windows += h[k : k + n] * PLACE[k]
        windows = mixed(windows, 1)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= WORDS:
                own = np.sort(windows[a : b - WORDS + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:  # the whole sequence as one
                out.append(mixed((h[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a), 1))
            else:
                out.append(h[:0])
        at = to
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS minima for each set; all sets have members."""
    out = np.zeros((len(sets), COORDS), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size < CHUNK // 8):
            size += len(sets[to])
            to += 1
        x = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        for c in range(COORDS):
            v = (x ^ FLIP[c]) * TIMES[c]
            v ^= v >> np.uint32(15)
            v *= TURN[c]
            out[at:to, c] = np.minimum.reduceat(v, starts)
        at = to
    return out


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set; null for an empty one) and signature."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()])
        full = [s for s in sets if len(s)]
        rows = iter(signatures(full)) if full else iter(())
        keys, signs = [], []
        for s in sets:
            keys.append(mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s, 1).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(8, "little") if len(s) else None)
            signs.append(next(rows).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return mapped(df.select("doc_id", text_of().alias("text")), run, "doc_id long, n_shingles long, set_key binary, signature binary", 256)


def key_of(values: np.ndarray, salt: int) -> np.ndarray:
    """One key for each row of signature values."""
    out = np.full(len(values), (salt + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
    for c in range(values.shape[1]):
        out = mixed(out ^ values[:, c].astype(np.uint64))
    return out.view(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """Rows of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """key, band (-1 for a single coordinate), rep: one row a class for each of COORDS - matches + 1 coordinates and of BANDS bands."""
    prefix = COORDS - matches_of(percent) + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sign = matrix(batch.column(1), np.uint32)
        keys = [key_of(sign[:, [c]], c) for c in range(prefix)] + [key_of(sign[:, b], COORDS + k) for k, b in enumerate(BAND)]
        band = np.repeat(np.array([-1] * prefix + list(range(BANDS)), np.int8), len(sign))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(band), pa.array(np.tile(batch.column(0).to_numpy(), prefix + BANDS))], ["key", "band", "rep"])

    return mapped(classes.select("rep", "signature"), run, "key long, band byte, rep long", 4096)


def paired_postings(members: DataFrame) -> DataFrame:
    """From members of long lists (bands: a bit for each whose list is long, rep, signature): key, rep under each pair of such a band's key and another's."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rep, sign = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), np.uint32)
        of = np.stack([key_of(sign[:, b], COORDS + k).view(np.uint64) for k, b in enumerate(BAND)], 1)
        keys, reps = [], []
        for low in range(BANDS):
            for high in range(low + 1, BANDS):
                rows = np.flatnonzero(own & (1 << low | 1 << high))
                keys.append(mixed(mixed(of[rows, low]) ^ of[rows, high]).view(np.int64))
                reps.append(rep[rows])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(reps))], ["key", "rep"])

    return mapped(members.select("bands", "rep", "signature"), run, "key long, rep long", 4096)


def stars(agree: np.ndarray) -> np.ndarray:
    """Least member (index) of each member's component, from a symmetric matrix."""
    label = np.arange(len(agree))
    while True:
        new = np.where(agree, label[None, :], len(agree)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def counted_links(lists: DataFrame, matches: int) -> DataFrame:
    """From lists (key, rep, signature) of at most LONG members: links of members that agree in `matches` coordinates or more, as stars."""
    short = lists.select("key", "rep", "signature")

    def run(got: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        rep, sign = got.column(1).to_numpy(), matrix(got.column(2), np.uint8)
        sizes, a, b = np.diff(bounds), [], []
        two = bounds[:-1][sizes == 2]
        if len(two):
            yes = two[(sign[two] == sign[two + 1]).sum(1) >= matches]
            a.append(rep[yes])
            b.append(rep[yes + 1])
        for k in np.flatnonzero(sizes > 2):
            own, ids = sign[bounds[k] : bounds[k + 1]], rep[bounds[k] : bounds[k + 1]]
            agree = np.zeros((len(own), len(own)), np.uint8)
            for c in range(COORDS):
                agree += own[:, c, None] == own[None, :, c]
            least = stars(agree >= matches)
            far = least != np.arange(len(ids))
            a.append(ids[far])
            b.append(ids[least[far]])
        if not a or not sum(map(len, a)):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return grouped(short, "key", run, "a long, b long")


def listed(posted: DataFrame) -> DataFrame:
    """`posted` with each list's size and least member; lists of one entry are gone."""
    sizes = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
    return posted.join(sizes, "key")


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all classes that may be similar into components."""
    # the low eight bits of each coordinate (the first byte) are enough to count agreements: one in 256 agrees by chance
    short = classes.select(F.col("rep").alias("_rep"), "short")
    lists = cut(listed(postings(classes, percent)))
    few = lists.filter(f"n <= {LONG}").join(short, F.col("rep") == F.col("_rep")).select("key", "rep", F.col("short").alias("signature"))
    out = counted_links(few, matches_of(percent))
    long = lists.filter(f"n > {LONG} AND band >= 0").select("rep", F.expr("shiftleft(1, int(band))").alias("bit"))
    if long.isEmpty():
        return out
    long = long.groupBy("rep").agg(F.bit_or("bit").alias("bands"))
    pairs = paired_postings(long.join(classes.select(F.col("rep").alias("_rep"), "signature"), F.col("rep") == F.col("_rep")))
    pairs = cut(listed(pairs))
    few = pairs.filter(f"n <= {LONG}").join(short, F.col("rep") == F.col("_rep")).select("key", "rep", F.col("short").alias("signature"))
    return out.unionByName(counted_links(few, matches_of(percent))).unionByName(pairs.filter(f"n > {LONG} AND rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))


def exact_links(documents: DataFrame, classes: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """a, b: links over the threshold that join each component of the candidates as all its links do, as stars.

    A component of one block is compared in one task. In a larger one each block is compared with itself and
    with ANCHORS members of its component. All members that a block's links join to the main anchor are
    connected, whatever their blocks, and need no comparison with each other; the others are compared with
    all blocks.
    """
    members = components(candidates).join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    at = F.xxhash64(F.col("node") + 1)
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min(at).alias("least"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    # anchors are those of least hash: some 8 * ANCHORS members of a component are asked, the least one among them
    low = (at == F.col("least")) | (at.cast("double") / 2.0**64 + 0.5 <= 8.0 * ANCHORS / F.col("n"))
    members = cut(members.join(sizes, "component").select("node", "component", "n_shingles", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), low.alias("low")))
    order = Window.partitionBy("component").orderBy(at, "node")
    anchors = members.filter("blocks > 1 AND low").withColumns({"nth": F.row_number().over(order), "upto": F.sum("n_shingles").over(order)})
    anchors = cut(anchors.filter(f"nth = 1 OR nth <= {ANCHORS} AND upto <= {BLOCK_SHINGLES}").select("node", "component", "blocks", "block"))
    key = lambda *parts: F.concat_ws(":", *parts).alias("key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    elsewhere = anchors.select("node", "component", "block", every("blocks").alias("other")).filter("other <> block")
    first = members.select("node", key("component", "block")).unionByName(elsewhere.select("node", key("component", "other")))
    first = first.join(small_side(anchors.select(F.col("node").alias("_a"))), F.col("node") == F.col("_a"), "left").select("node", "key", F.col("_a").isNotNull().alias("anchor"))
    found = cut(compared(documents, first, percent))
    links, rest = found.filter("NOT rest").select("a", "b"), found.filter("rest").select(F.col("a").alias("_rest"))
    if rest.isEmpty():
        return links
    rest = cut(rest.distinct().join(members, F.col("node") == F.col("_rest")).select("node", "component", "blocks", "block"))
    others = rest.groupBy(F.col("component").alias("_c")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("others"))
    asked = rest.join(others, F.col("component") == F.col("_c")).select("node", "component", F.pmod(F.xxhash64("node"), F.col("others")).cast("int").alias("other"), F.col("block").alias("own"), every("blocks").alias("block"))
    # a member's own block has it among the others already
    asked = asked.filter("block <> own").drop("own")
    against = members.join(others, F.col("component") == F.col("_c")).select("node", "component", every("others").alias("other"), "block")
    second = asked.unionByName(against).select("node", key("component", "other", "block"), F.lit(False).alias("anchor"))
    return links.unionByName(cut(compared(documents, second, percent)).filter("NOT rest").select("a", "b"))


def compared(documents: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    """a, b, rest: links over the threshold, as stars, among the documents of each key of `dealt` (node, key, anchor); with rest, a document that they don't join to its key's main anchor."""
    dealt = cut(dealt.select(F.col("node").alias("_node"), "key", "anchor"))
    nodes = dealt.select("_node").distinct()
    texts = documents.select("doc_id", text_of().alias("text")).join(small_side(nodes), F.col("doc_id") == F.col("_node"), "left_semi")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = [s.tobytes() for s in shingle_sets([t.encode() for t in batch.column(1).to_pylist()])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "shingles"])

    with_sets = mapped(texts, sets, "doc_id long, shingles binary", 256)
    both = with_sets.join(small_side(dealt), F.col("doc_id") == F.col("_node")).select("key", "doc_id", "shingles", "anchor")
    return grouped(both, "key", lambda got, bounds: verified(got, bounds, percent), "a long, b long, rest boolean")


def verified(got: pa.Table, bounds: np.ndarray, percent: int) -> pa.RecordBatch | None:
    """Stars of the links over the threshold in each group (key, doc_id, shingles, anchor), and the documents that aren't joined to the main anchor, if there are anchors."""
    ids, blobs, anchor = got.column(1).to_numpy(), got.column(2), got.column(3).to_numpy(zero_copy_only=False)
    a, b, rest = [], [], []
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        own, first = np.unique(ids[x:y], return_index=True)
        if len(own) < 2:
            continue
        agree = similar([np.frombuffer(blobs[x + int(i)].as_buffer(), np.uint64) for i in first], percent)
        least = stars(agree)
        far = least != np.arange(len(own))
        a.append(own[far])
        b.append(own[least[far]])
        rest.append(np.zeros(far.sum(), bool))
        marks = np.flatnonzero(anchor[x:y][first])
        if len(marks):
            # the anchors alone are the same in every block, and so is the main one: the first of their largest part
            parts = stars(agree[np.ix_(marks, marks)])
            main = marks[np.bincount(parts).argmax()]
            apart = own[least != least[main]]
            a.append(apart)
            b.append(apart)
            rest.append(np.ones(len(apart), bool))
    if not a or not sum(map(len, a)):
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(rest))], ["a", "b", "rest"])


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the threshold: shared members are counted by products of presence matrices."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yes = 100 * n >= percent * (sizes.sum() - n)
        return np.array([[True, yes], [yes, True]])
    every = np.concatenate(sets)
    _, at, often = np.unique(every, return_inverse=True, return_counts=True)
    order = np.full(len(often), -1, np.int64)
    shared = np.flatnonzero(often > 1)
    order[shared] = np.arange(len(shared))
    column, row = order[at], np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    both, width = np.zeros((len(sets), len(sets)), np.int64), max(64, (1 << 22) // len(sets))
    for start in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(sets), min(width, len(shared) - start)), np.float32)
        has[row[lo:hi], column[lo:hi] - start] = 1
        both += (has @ has.T).astype(np.int64)  # counts stay under 2**24, so float32 is exact
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, linked where 100 * intersection >= percent * union."""
    marks = cut(fingerprints(documents))
    classes = marks.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("signature").alias("signature"), F.max("n_shingles").alias("n_shingles"))
    short = F.unhex(F.concat(*[F.substring(F.hex("signature"), 8 * c + 1, 2) for c in range(COORDS)]))
    classes = cut(classes.select("set_key", "rep", "signature", "n_shingles", short.alias("short")))
    links = written(lambda: exact_links(documents, classes, cut(candidate_links(classes, percent)), percent))
    parts = components(links).withColumnsRenamed({"node": "_node"})
    of = classes.select(F.col("set_key").alias("_key"), "rep").join(parts, F.col("rep") == F.col("_node"), "left").select("_key", F.coalesce("component", "rep").alias("component"))
    df = marks.select("doc_id", "n_shingles", "set_key").join(of, F.col("set_key") == F.col("_key"), "left")
    df = df.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return df.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`df` with one row of each component: the document of least doc_id, and of several rows of that the one whose text sorts first (a null text before all)."""
    gone = near_duplicates(df, percent).filter("NOT kept").select("doc_id").distinct()
    left = without(df, gone)
    twice = cut(left.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if twice.isEmpty():
        return left
    name = fresh(df, "_twice")
    of = small_side(twice.select(F.col("doc_id").alias(name)))
    nth = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    first = left.join(of, F.col("doc_id") == F.col(name), "left_semi").withColumn(name, F.row_number().over(nth)).filter(F.col(name) == 1).drop(name)
    return left.join(of, F.col("doc_id") == F.col(name), "left_anti").unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + {WORDS - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN two e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON d.doc_id = c.a
"""
