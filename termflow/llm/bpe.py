"""Byte-pair encoding and decoding by a queue of merge ranks over a linked symbol list.

The tokenizer file is a parameter; its normaliser (NFC, white space to one space, lower case), its
splitting pattern, its byte alphabet and its word-end suffix are followed as the file states them.
Every word is merged once per worker: a bounded dictionary keeps what it became.

Defined results: a null text counts as empty, and an empty text has no tokens and decodes to an empty
text; texts of any length are taken whole; repeated rows and rows without doc_id give a result each; of
equal merges the leftmost comes first; an empty table gives none; further columns are ignored by the query
and kept by `add_tokens`, which replaces `token_ids` and `decoded`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from termflow.llm.common import Recent, held, mapped, table, text_of

#: Words that a worker remembers at most, twice.
CACHE_WORDS = 120_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Bpe:
    """One tokenizer file, ready to encode."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # a pair's key is one number, as every id is under 2**20
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known = Recent(self.word, CACHE_WORDS)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the queue yields the lowest rank, leftmost first; entries whose symbols have changed since are stale."""
        data, first = word.encode(), self.first
        symbols = [first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n, rank_of = len(symbols), self.ranks.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r[0], i, r[1]) for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j < 0 or (now := rank_of(symbols[i] << 20 | symbols[j])) is None or now[1] != merged:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank_of(merged << 20 | symbols[k]):
                    heapq.heappush(queue, (r[0], i, r[1]))
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 20 | merged)):
                heapq.heappush(queue, (r[0], h, r[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[str, str]:
        """A word's ids and its vocabulary strings, each joined by spaces."""
        ids = self.merge(word)
        return " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids])

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """What each word of a text became, in order."""
        out: list[tuple[str, str]] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                out.append((str(self.added[part]), part))
                continue
            # lower() would choose a final sigma by its neighbours; the tokenizer lowers character by character
            # (white space needn't be made one space: no word holds any)
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            known = self.known
            out += [known[w] for w in self.words.findall(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, with one space between (the file names no decoder); unknown ids are skipped."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


def load(path: str) -> Bpe:
    """Read a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def shipped(spark: SparkSession, path: str) -> str:
    """Send the file to every executor; returns the name under which workers find it."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def digest_tokens(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text."""
    name = shipped(df.sparkSession, path)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = held(name, lambda: load(SparkFiles.get(name)))
        n, ids, texts = [], [], []
        for text in batch.column(1).to_pylist():
            pieces = bpe.pieces(text)
            own = " ".join([p[0] for p in pieces])
            n.append(own.count(" ") + 1 if own else 0)
            ids.append(hashlib.sha256(own.encode()).hexdigest())
            texts.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(df.select("doc_id", text_of().alias("text")), encode, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", 128)


def add_tokens(df: DataFrame, path: str) -> DataFrame:
    """`df` with `token_ids array<int>` and `decoded string`; input columns of these names are replaced."""
    name = shipped(df.sparkSession, path)
    df = df.drop("token_ids", "decoded")
    at = df.columns.index("text")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", token_ids array<int>, decoded string"

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = held(name, lambda: load(SparkFiles.get(name)))
        ids, counts, texts = [], [0], []
        for text in batch.column(at).to_pylist():
            pieces = bpe.pieces(text or "")
            own = np.array(" ".join([p[0] for p in pieces]).split(), np.int32)
            ids.append(own)
            counts.append(len(own))
            texts.append(" ".join([p[1] for p in pieces]))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(texts, pa.string())], [*batch.schema.names, "token_ids", "decoded"])

    return mapped(df, encode, spec, 64)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files have this one."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
