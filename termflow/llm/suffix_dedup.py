"""Exact-substring deduplication with merged Burrows-Wheeler transforms.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

Finding what can repeat. All windows of LENGTH bytes whose least SEED-byte hash is the same and which
follow each other form a run; equal windows always lie in runs of equal hash. Documents are dealt into
chunks of bounded size, one exchange that all passes reuse.
1. Each chunk sends its hashes (KEY_BITS within a bucket, one bit "in two documents here", the logarithm of
   its distinct strings) to buckets of hashes; a bucket answers every chunk which of its hashes occur in two
   documents anywhere, and which are hot: too many strings for one bucket. The windows of hot hashes go on
   as single runs under a hash of all their bytes, so equal ones meet and one hash has one string.
2. For those each chunk sends its distinct runs: bytes and least doc_id. So a passage that a chunk holds
   a thousand times is sent once, and no step ever lists the documents that share something.
3. A bucket groups runs by hash. Where one byte string is all there is, its least doc_id holds for all
   its windows. The others become shards, by the chunk they came from: each shard's transform is made
   on its own, and the transforms are merged by interleave refinement. An interleave is the sequence of
   shard numbers in sorted order; sorting it stably by the merged transforms' characters extends the
   order by one character, and where neighbours first differ their common prefix is known. After LENGTH
   rounds the intervals of common prefix LENGTH are the equal windows, without sorting their suffixes
   together. Each interval's least doc_id is answered to the chunks that hold it and know only a larger.
4. Each chunk marks covered bytes and hashes what is left.

Defined results: a null text counts as empty (nothing removed, the empty string's hash); rows of equal
doc_id count as one document for "smaller"; a row without doc_id loses nothing and gives nothing; texts shorter than LENGTH bytes lose nothing; texts are read
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import ship, table, text_of
from termflow.llm.near_dedup import mixed, powers

LENGTH, SEED = 50, 20
WINDOW = LENGTH - SEED + 1
#: Bytes of text of a chunk and of a bucket, on average; bytes hashed at a time; shards of a merge at most.
CHUNK_BYTES, BUCKET_BYTES, BLOCK, SHARDS = 8 << 20, 8 << 20, 1 << 20, 4
#: Distinct strings of one hash, counted by chunk, from which its windows are dealt by hashes of their own: a bucket's worth.
HOT = 1 << 17
#: Partitions of an exchange at most; beyond them a partition holds several chunks or buckets, one after another.
PARTITIONS = 20_000
#: Bits of a hash within its bucket, and bits of the logarithm of a count.
KEY_BITS, COUNT_BITS = 35, 4
KEY = np.uint64((1 << KEY_BITS) - 1)
ROLL = [np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) for k in range(SEED + 1)]


def rolled(x: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each place, by doubling."""
    one = x.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * ROLL[1] + one[1:]
    four = two[:-2] * ROLL[2] + two[2:]
    eight = four[:-4] * ROLL[4] + four[4:]
    sixteen = eight[:-8] * ROLL[8] + eight[8:]
    return mixed(sixteen[:-4] * ROLL[4] + four[16:])


def least(h: np.ndarray) -> np.ndarray:
    """Minimum over WINDOW (31) neighbours, by doubling."""
    for k in (1, 2, 4, 8):
        h = np.minimum(h[:-k], h[k:])
    return np.minimum(h[:-15], h[15:])


class Chunk:
    """The documents of a chunk and their runs: value, string (hash of the bytes), start, count of windows, doc_id."""

    def __init__(self, docs: pa.Table):
        docs = docs.select(["doc_id", "text"]).combine_chunks().sort_by("doc_id")
        self.ids = docs.column(0).to_numpy()
        col = docs.column(1).combine_chunks().cast(pa.large_binary())
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
        self.at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = col.buffers()[2] if len(col) else None
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        parts = [[], [], [], [], []]
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + BLOCK, "right")) - 1)
            for p, x in zip(parts, self.block(i, j), strict=True):
                p.append(x)
            i = j
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        self.value, self.string, self.start, self.count, self.doc = (np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True))

    def block(self, i: int, j: int) -> tuple[np.ndarray, ...]:
        """Runs of documents i to j."""
        x = self.data[self.at[i] : self.at[j]]
        n = len(x) - LENGTH + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none, none
        low = least(rolled(x))
        sizes = np.diff(self.at[i : j + 1])
        of = np.repeat(np.arange(i, j), sizes)[:n]
        fits = np.arange(n) + LENGTH <= self.at[of + 1] - self.at[i]
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1]) | ~fits[:-1]
        start = np.flatnonzero(new & fits)
        last = np.ones(n, bool)
        last[:-1] = new[1:] | ~fits[1:]
        count = np.flatnonzero(last & fits) - start + 1
        up, down = powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        end = start + count + LENGTH - 1
        string = mixed(mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), 1)
        return mixed(low[start]), string, start + self.at[i], count, self.ids[of[start]]

    def split(self, hot: np.ndarray, buckets: int) -> None:
        """Put single windows, each under a hash of all its bytes, in place of the runs whose hash is hot; they come last."""
        runs = found(hot, code_of(self.value, buckets))
        rest = np.setdiff1d(np.arange(len(self.value)), runs)
        count = self.count[runs]
        start = np.repeat(self.start[runs] - np.cumsum(count) + count, count) + np.arange(count.sum())
        up, _ = powers(LENGTH)
        value, string = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for k in range(LENGTH):
            byte = self.data[start + k].astype(np.uint64) + np.uint64(1)
            value = value * ROLL[1] + byte
            string += byte * up[k]
        parts = (mixed(value), mixed(mixed(string + np.uint64(LENGTH)), 1), start, np.ones(len(start), np.int64), np.repeat(self.doc[runs], count))
        self.value, self.string, self.start, self.count, self.doc = (np.concatenate([a[rest], b]) for a, b in zip((self.value, self.string, self.start, self.count, self.doc), parts, strict=True))


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def code_of(value: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and hash within it as one number."""
    return (bucket_of(value, buckets).astype(np.uint64) << np.uint64(KEY_BITS)) | (value & KEY)


def labels(n: int) -> list[int]:
    """Integers that Spark's hash partitioning puts into partitions 0 to n - 1, so that groups are dealt evenly.

    The inverse of Murmur3 on one 32-bit number with seed 42.
    """
    odd = lambda k: pow(k, -1, 1 << 32)
    turn = lambda x, k: (x >> k | x << 32 - k) & 0xFFFFFFFF
    out = []
    for h in range(n):
        h ^= h >> 16
        h = h * odd(0xC2B2AE35) & 0xFFFFFFFF
        h ^= h >> 13 ^ h >> 26
        h = h * odd(0x85EBCA6B) & 0xFFFFFFFF
        h ^= h >> 16 ^ 4
        h = turn((h - 0xE6546B64) * odd(5) & 0xFFFFFFFF, 13) ^ 42
        h = turn(h * odd(0x1B873593) & 0xFFFFFFFF, 15) * odd(0xCC9E2D51) & 0xFFFFFFFF
        out.append(h - (h >> 31 << 32))
    return out


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of `keys` that are among the sorted ones."""
    at = np.searchsorted(sorted_keys, keys).clip(max=max(0, len(sorted_keys) - 1))
    return np.flatnonzero(sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(0, np.int64)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Bounds of the groups of equal keys."""
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]]) if len(sorted_keys) else np.zeros(1, np.int64)


def five(x: np.ndarray) -> bytes:
    """40-bit numbers as bytes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unfive(x: bytes) -> np.ndarray:
    a = np.zeros((len(x) // 5, 8), np.uint8)
    a[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return a.view("<u8")[:, 0]


def rows(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema)


KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary())])
RUNS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hot", pa.binary()), *((n, pa.binary()) for n in ("keys", "strings", "docs", "sizes", "bytes"))])
FIRSTS = pa.schema([("chunk", pa.int32()), ("hot", pa.binary()), *((n, pa.binary()) for n in ("strings", "parts", "from", "docs"))])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def send_keys(chunk: int, own: Chunk, names: list[int]) -> pa.Table:
    """Pass 1: the chunk's hashes for each bucket, sorted, with a bit that says "two documents" and the logarithm of their distinct strings."""
    out: dict[str, list] = {f.name: [] for f in KEYS}
    code = code_of(own.value, len(names))
    by = np.lexsort((own.string, code))
    code, string, doc = code[by], own.string[by], own.doc[by]
    g = groups(code)
    first = g[:-1]
    if len(first):
        twice = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        new = np.ones(len(by), np.int64)
        new[1:] = (string[1:] != string[:-1]) | (code[1:] != code[:-1])
        many = np.log2(np.add.reduceat(new, first)).astype(np.uint64).clip(max=(1 << COUNT_BITS) - 1)
        packed = ((code[first] & KEY) << np.uint64(COUNT_BITS + 1)) | (many << np.uint64(1)) | twice.astype(np.uint64)
        where = (code[first] >> np.uint64(KEY_BITS)).astype(np.int64)
        bounds = groups(where)
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            for c, v in (("bucket", names[where[x]]), ("chunk", chunk), ("keys", five(packed[x:y]))):
                out[c].append(v)
    return rows(out, KEYS)


def answer_keys(got: pa.Table, hot: int) -> pa.Table:
    """Bucket: for every chunk those of its hashes that two documents have, with a bit that says "hot"."""
    sent = [unfive(b) for b in got.column("keys").to_pylist()]
    all_ = np.concatenate(sent)
    values, at, often = np.unique(all_ >> np.uint64(COUNT_BITS + 1), return_inverse=True, return_counts=True)
    many = often > 1
    many[at[(all_ & np.uint64(1)) > 0]] = True
    strings = np.bincount(at, np.exp2(((all_ >> np.uint64(1)) & np.uint64((1 << COUNT_BITS) - 1)).astype(np.float64)))
    out: dict[str, list] = {f.name: [] for f in KEYS}
    keep, bounds = many[at], np.cumsum([0, *map(len, sent)])
    reply = (values << np.uint64(1) | (strings >= hot).astype(np.uint64))[at]
    for i, (b, c) in enumerate(zip(got.column("bucket").to_pylist(), got.column("chunk").to_pylist(), strict=True)):
        own = reply[bounds[i] : bounds[i + 1]][keep[bounds[i] : bounds[i + 1]]]
        if len(own):
            for n, v in (("bucket", b), ("chunk", c), ("keys", five(own))):
                out[n].append(v)
    return rows(out, KEYS)


def send_runs(chunk: int, own: Chunk, answers: pa.Table, names: list[int]) -> pa.Table:
    """Pass 2: the chunk's distinct runs with a hash that repeats, by bucket: hash, string, least doc_id, size and bytes; once also the hot hashes."""
    out: dict[str, list] = {f.name: [] for f in RUNS}
    if answers.num_rows and len(own.value):
        number = {b: i for i, b in enumerate(names)}
        told = [(np.uint64(number[b]) << np.uint64(KEY_BITS), unfive(k)) for b, k in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist(), strict=True)]
        asked = np.sort(np.concatenate([b | k >> np.uint64(1) for b, k in told]))
        hot = np.sort(np.concatenate([(b | k >> np.uint64(1))[k & np.uint64(1) > 0] for b, k in told]))
        code = code_of(own.value, len(names))
        use = found(asked, code)
        if len(hot):
            before = len(own.value) - len(found(hot, code))
            use = found(asked, code[np.setdiff1d(np.arange(len(code)), found(hot, code))])
            own.split(hot, len(names))
            use = np.concatenate([use, np.arange(before, len(own.value))])  # the single windows are at the end
        bucket = bucket_of(own.value, len(names))
        use = use[np.lexsort((own.doc[use], own.string[use], bucket[use]))]
        new = np.ones(len(use), bool)
        new[1:] = (own.string[use][1:] != own.string[use][:-1]) | (bucket[use][1:] != bucket[use][:-1])
        use = use[new]  # the least doc_id of each string
        bounds = groups(bucket[use])
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            r = use[x:y]
            size = own.count[r] + LENGTH - 1
            place = np.repeat(own.start[r] - np.cumsum(size) + size, size) + np.arange(size.sum())
            row = {"bucket": names[bucket[r[0]]], "chunk": chunk, "hot": hot.tobytes() if not x else b"", "keys": five(own.value[r] & KEY), "strings": own.string[r].tobytes(), "docs": own.doc[r].tobytes(), "sizes": size.astype(np.uint32).tobytes(), "bytes": own.data[place].tobytes()}
            for n, v in row.items():
                out[n].append(v)
    return rows(out, RUNS)


#: Closes a shard's strings: no byte of UTF-8. Characters that the first interleave compares.
END, HEAD = np.uint8(255), 7


def heads(text: np.ndarray) -> np.ndarray:
    """The HEAD characters from each place of a shard as one number."""
    key = np.zeros(len(text), np.int64)
    for k in range(HEAD):
        key = key << 8 | np.roll(text, -k)
    return key


def transform(key: np.ndarray) -> np.ndarray:
    """Order of a shard's rotations, sorted to LENGTH characters or more: from its heads, ranks of twice as many characters, and so on."""
    n, reach = len(key), HEAD
    while True:
        order = np.argsort(key)
        if reach >= LENGTH:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        key = rank * (n + 1) + np.roll(rank, -reach)
        reach *= 2


def equal_windows(shards: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Merge the shards' transforms: (order of each shard, interleave, interval number of each merged place).

    Places of one interval start with the same LENGTH characters. The first interleave merges the shards'
    places by their heads. A refinement takes for each place the block of characters before it: their number
    among all blocks of that length, which an earlier interleave gives, so blocks of several characters cost one
    round. `interval` numbers are refined along with the interleave: a new one starts where an interval's
    places have different blocks before them.
    """
    keys = [heads(t) for t in shards]
    orders = [transform(k) for k in keys]
    starts = np.cumsum([0, *map(len, shards)])
    place = np.concatenate([o + a for o, a in zip(orders, starts, strict=False)])  # of all texts, in each shard's order
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), np.diff(starts))
    merged = np.concatenate([k[o] for k, o in zip(keys, orders, strict=True)])
    by = np.argsort(merged, kind="stable")  # sorted runs: a merge
    which, interval = which[by], numbered(merged[by])
    numbers, depth = {1: np.concatenate(shards).astype(np.int32)}, HEAD
    while depth < LENGTH:
        home = np.argsort(which, kind="stable")  # where the places of each shard are, in its own order
        if depth <= LENGTH - depth:  # long blocks that a later round can use
            numbers[depth] = np.empty(len(which), np.int32)
            numbers[depth][place] = interval[home]
        step = max(d for d in numbers if d <= LENGTH - depth)
        block = np.concatenate([np.roll(numbers[step][a:b], step)[o] for a, b, o in zip(starts[:-1], starts[1:], orders, strict=True)])
        merged = np.empty(len(which), np.uint64)
        merged[home] = block.astype(np.uint64) << np.uint64(32)
        merged |= np.arange(len(which), dtype=np.uint64)  # makes the sort stable
        merged.sort()
        by = (merged & np.uint64(0xFFFFFFFF)).astype(np.int64)
        which, interval = which[by], numbered(merged >> np.uint64(32), interval[by])
        depth += step
    return orders, which, interval


def numbered(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the runs of equal values, or of equal pairs."""
    new = np.zeros(len(first), bool)
    np.not_equal(first[1:], first[:-1], out=new[1:])
    if second is not None:
        new[1:] |= second[1:] != second[:-1]
    return np.cumsum(new, dtype=np.int32)


def first_documents(sizes: np.ndarray, data: np.ndarray, docs: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least doc_id of every window of the strings (one after another), and the bounds of the strings' windows."""
    counts = sizes - LENGTH + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(bounds[-1], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    names, shard = np.unique(shard, return_inverse=True)
    texts, places = [], []
    for s in range(len(names)):
        own = np.flatnonzero(shard == s)
        long = sizes[own] + 1
        ends = np.cumsum(long)
        text = np.full(ends[-1], END)
        place = np.full(ends[-1], -1, np.int64)  # window of each character, -1 where none starts
        inner = np.arange(ends[-1]) - np.repeat(ends - long, long)
        real = inner < np.repeat(sizes[own], long)
        text[real] = data[np.repeat(at[own], long)[real] + inner[real]]
        starts = inner < np.repeat(counts[own], long)
        place[starts] = (np.repeat(bounds[own], long) + inner)[starts]
        texts.append(text)
        places.append(place)
    orders, which, interval = equal_windows(texts)
    window = np.empty(len(which), np.int64)
    for s, o in enumerate(orders):
        window[which == s] = places[s][o]
    doc_of = np.repeat(docs, counts)
    ok = window >= 0
    window, interval = window[ok], interval[ok]
    if len(window):
        first = np.concatenate([[0], np.flatnonzero(interval[1:] != interval[:-1]) + 1])
        low = np.minimum.reduceat(doc_of[window], first)
        out[window] = np.repeat(low, np.diff(np.concatenate([first, [len(window)]])))
    return out, bounds


def answer_runs(got: pa.Table) -> pa.Table:
    """Bucket: for every chunk the runs of which it doesn't know the first document: parts of windows and their least doc_id."""
    blob = lambda n, k: np.concatenate([np.frombuffer(b, k) for b in got.column(n).to_pylist()])
    key = np.concatenate([unfive(b) for b in got.column("keys").to_pylist()])
    string, doc, size, data = blob("strings", np.uint64), blob("docs", np.int64), blob("sizes", np.uint32).astype(np.int64), blob("bytes", np.uint8)
    n_of = [len(b) // 8 for b in got.column("docs").to_pylist()]
    row = np.repeat(np.arange(len(n_of)), n_of)
    chunk = np.array(got.column("chunk").to_pylist(), np.int64)
    by = np.lexsort((doc, string, key))
    new = np.ones(len(by), bool)
    new[1:] = (string[by][1:] != string[by][:-1]) | (key[by][1:] != key[by][:-1])
    number = np.cumsum(new) - 1  # of the distinct string, along `by`
    one = by[new]  # where the distinct string has its least document
    alone = np.diff(groups(key[one]))
    contested = np.repeat(alone > 1, alone)
    parts, begin = np.ones(len(one), np.int64), None
    low = doc[one].copy()
    firsts = bounds = None
    if contested.any():
        at = np.concatenate([[0], np.cumsum(size)])
        own = one[contested]
        place = np.repeat(at[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
        firsts, bounds = first_documents(size[own], data[place], doc[own], chunk[row[own]] % SHARDS)
        change = np.ones(len(firsts), bool)
        change[1:] = firsts[1:] != firsts[:-1]
        change[bounds[:-1]] = True
        begin = np.flatnonzero(change)
        parts[contested] = np.diff(np.searchsorted(begin, bounds))
        low[contested] = np.minimum.reduceat(firsts, bounds[:-1])
    rank = np.cumsum(contested) - 1  # of a distinct string among the contested
    # a chunk needs an answer if some window starts earlier than the chunk's own first document of the string
    need = np.flatnonzero(low[number] < doc[by])
    out: dict[str, list] = {f.name: [] for f in FIRSTS}
    for c, h in zip(got.column("chunk").to_pylist(), got.column("hot").to_pylist(), strict=True):
        if h:
            for n, v in {"chunk": c, "hot": h, "strings": b"", "parts": b"", "from": b"", "docs": b""}.items():
                out[n].append(v)
    need = need[np.argsort(row[by[need]], kind="stable")]
    g = groups(row[by[need]])
    for x, y in zip(g[:-1], g[1:], strict=True):
        d = number[need[x:y]]
        k = parts[d]
        start, docs = np.zeros(k.sum(), np.int64), np.repeat(low[d], k)
        if (hard := contested[d]).any():
            r = rank[d[hard]]
            first = np.searchsorted(begin, bounds[r])
            inside = np.repeat(hard, k)
            kk = k[hard]
            pick = np.repeat(first - np.cumsum(kk) + kk, kk) + np.arange(kk.sum())
            start[inside] = begin[pick] - np.repeat(bounds[r], kk)
            docs[inside] = firsts[begin[pick]]
        values = {"chunk": int(chunk[row[by[need[x]]]]), "hot": b"", "strings": string[by[need[x:y]]].tobytes(), "parts": k.astype(np.uint32).tobytes(), "from": start.astype(np.uint32).tobytes(), "docs": docs.tobytes()}
        for n, v in values.items():
            out[n].append(v)
    return rows(out, FIRSTS)


def finish(own: Chunk, answers: pa.Table, buckets: int) -> pa.Table:
    """Pass 3: what each document of the chunk loses."""
    if hot := b"".join(answers.column("hot").to_pylist()):
        own.split(np.frombuffer(hot, np.uint64), buckets)
    cover = np.zeros(len(own.data) + 1, np.int32)
    if len(own.string):
        # inside the chunk the first document of a string is known
        by = np.lexsort((own.doc, own.string))
        g = groups(own.string[by])
        low = np.empty(len(by), np.int64)
        low[by] = np.repeat(own.doc[by][g[:-1]], np.diff(g))
        simple = low < own.doc
        if answers.num_rows:
            blob = lambda n, k: np.concatenate([np.frombuffer(b, k) for b in answers.column(n).to_pylist()])
            string, parts, begin, docs = blob("strings", np.uint64), blob("parts", np.uint32).astype(np.int64), blob("from", np.uint32).astype(np.int64), blob("docs", np.int64)
            at = np.cumsum(parts) - parts
            order = np.argsort(string)
            string, parts, at = string[order], parts[order], at[order]
            told = found(string, own.string)
            simple[told] = False
            place = np.searchsorted(string, own.string[told])
            k = parts[place]
            pick = np.repeat(at[place] - np.cumsum(k) + k, k) + np.arange(k.sum())
            run = np.repeat(told, k)
            final = np.zeros(len(pick), bool)
            final[np.cumsum(k) - 1] = True
            stop = np.where(final, own.count[run], np.roll(begin[pick], -1))
            use = docs[pick] < own.doc[run]
            np.add.at(cover, own.start[run][use] + begin[pick][use], 1)
            np.add.at(cover, own.start[run][use] + stop[use] + LENGTH - 1, -1)
        np.add.at(cover, own.start[simple], 1)
        np.add.at(cover, own.start[simple] + own.count[simple] + LENGTH - 1, -1)
    gone = np.cumsum(cover[:-1]) > 0
    rise = gone & ~np.concatenate([[False], gone[:-1]])
    if len(gone):
        starts = own.at[:-1][np.diff(own.at) > 0]
        rise[starts] = gone[starts]  # a span ends with its document
    removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(rise)])
    sha = [hashlib.sha256(own.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(own.at[:-1], own.at[1:], strict=True)]
    return rows({"doc_id": own.ids, "n_bytes": np.diff(own.at), "n_removed": np.diff(removed[own.at]), "n_spans": np.diff(spans[own.at]), "kept_sha256": sha}, RESULT)


def ddl(schema: pa.Schema) -> str:
    """The schema for Spark."""
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def deduplicate(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    nameless = documents.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("b"))
    nameless = nameless.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("b", 256).alias("kept_sha256"))
    documents = documents.filter("doc_id IS NOT NULL")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, names = max(1, math.ceil(total / chunk_bytes)), labels(max(1, math.ceil(total / bucket_bytes)))
    ship(documents.sparkSession)
    nth = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
    docs = documents.select(F.get(F.lit(labels(chunks)), nth).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    docs = docs.repartition(min(chunks, PARTITIONS), "chunk")  # the one exchange of texts: all three passes reuse it
    number = lambda t: t.column("chunk")[0].as_py()
    keys = docs.groupBy("chunk").applyInArrow(lambda t: send_keys(number(t), Chunk(t), names), ddl(KEYS))
    buckets = min(len(names), PARTITIONS)
    asked = keys.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: answer_keys(t, hot), ddl(KEYS))
    empty = lambda s: s.empty_table()
    runs = docs.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda t, a: send_runs(number(t), Chunk(t), a, names) if t.num_rows else empty(RUNS), ddl(RUNS))
    told = runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer_runs, ddl(FIRSTS))
    done = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda t, a: finish(Chunk(t), a, len(names)) if t.num_rows else empty(RESULT), ddl(RESULT))
    return done.unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS win FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS p FROM h WHERE length(h) >= {2 * LENGTH})),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
hit AS (SELECT w.doc_id, p FROM w JOIN f ON w.win = f.win WHERE first < w.doc_id),
island AS (SELECT doc_id, p, sum(CASE WHEN p <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -999) AS before FROM hit)),
gone AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM island GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM (SELECT doc_id, a, b FROM gone UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM h)),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM cuts c JOIN h ON c.doc_id = h.doc_id GROUP BY c.doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT h.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN kept ON h.doc_id = kept.doc_id LEFT JOIN n ON h.doc_id = n.doc_id
"""
