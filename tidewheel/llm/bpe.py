"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 8).

Two tiers. A minimal perfect hash over the vocabulary answers every pre-token that is a token as a whole; the
others are merged with a heap over linked bytes, O(n log n) in their length. The vocabulary has a fixed size, so
the tables are broadcast; texts stream through Arrow batches without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text into pre-tokens before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: The same for texts without characters of which the two regular expression engines think differently.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: Encoded pre-tokens that a worker remembers, and their greatest length; a full memory is emptied.
REMEMBERED, LONGEST = 600_000, 64


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement per bucket of about four keys."""

    def __init__(self, keys: list[bytes]):
        import numpy as np

        n = max(1, len(keys))
        self.size, self.buckets = n, n // 4 + 1
        digest = [self._digest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(digest):
            members[h % self.buckets].append(i)
        taken, self.slot_key = bytearray(n), np.full(n, -1, "int32")
        shift = np.zeros(self.buckets, "int32")
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = None
        for b in order:
            own = members[b]
            if not own:
                break
            if len(own) == 1:  # single keys take the free slots in turn; a negative shift names the slot
                free = free or [i for i in range(n) if not taken[i]]
                slot = free.pop()
                taken[slot], shift[b], self.slot_key[slot] = 1, -slot - 1, own[0]
                continue
            d = 0
            while True:
                at = [self._slot(digest[i], d) for i in own]
                if len(set(at)) == len(at) and not any(taken[s] for s in at):
                    break
                d += 1
            shift[b] = d
            for i, s in zip(own, at):
                taken[s], self.slot_key[s] = 1, i
        self.shift, self.slot_key = shift.tolist(), self.slot_key.tolist()

    @staticmethod
    def _digest(key: bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(key)

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return ((x >> 32) * self.size) >> 32

    def index(self, key: bytes) -> int:
        """Number of the only key that `key` can be; the caller compares them."""
        h = self._digest(key)
        d = self.shift[h % self.buckets]
        return self.slot_key[-d - 1 if d < 0 else self._slot(h, d)]


class ByteBPE:
    """Encoder of one vocabulary; tokens[i] are the bytes of id i, ids are the order of merging."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        self.single = [self.token_id(bytes([c])) for c in range(256)]

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        """From a rank file: a line per token, its bytes in base 64 and its id."""
        with open(path, "rb") as f:
            ranks = sorted((int(i), base64.b64decode(t)) for t, i in (line.split() for line in f if line.strip()))
        if [i for i, _ in ranks] != list(range(len(ranks))):
            raise ValueError(f"{path}: ids aren't 0, 1, 2, ...")
        return cls([t for _, t in ranks])

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "hash": self.hash, "single": self.single}

    def token_id(self, piece: bytes) -> int:
        i = self.hash.index(piece)
        return i if self.tokens[i] == piece else -1

    def recent_id(self, piece: bytes) -> int:
        """token_id, remembered: the same few pairs are looked up again and again while merging."""
        seen = self.__dict__.setdefault("_seen", {})
        i = seen.get(piece)
        if i is None:
            if len(seen) >= REMEMBERED:
                seen.clear()
            i = seen[piece] = self.token_id(piece)
        return i

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token: whole if it is a token, else by merging the pair of least id, the leftmost first."""
        whole = self.token_id(piece)
        if whole >= 0:
            return (whole,)
        n, look = len(piece), self.recent_id
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # linked starts of the parts
        ids = [self.single[c] for c in piece]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := look(piece[i : i + 2])) >= 0]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            rank, i, end = heapq.heappop(heap)
            if gone[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:  # one of the two parts has changed since
                continue
            gone[j] = 1
            after[i], ids[i] = end, rank
            if end < n:
                before[end] = i
                if (r := look(piece[i : after[end]])) >= 0:
                    heapq.heappush(heap, (r, i, after[end]))
            p = before[i]
            if p >= 0 and (r := look(piece[p:end])) >= 0:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)


class _Memory(dict):
    """Pre-token (text) -> ids; what is missing is encoded and remembered."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=1)
def _patterns():
    """Splitters of ASCII, common and other texts, and the characters that make a text an other one.

    Those are numbers that aren't decimal digits, and the separators that only Python takes for white space.
    """
    import sys
    import unicodedata

    import regex

    odd = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f")
    return re.compile(ASCII_PATTERN, re.ASCII).findall, re.compile(COMMON_PATTERN).findall, regex.compile(PATTERN).findall, odd


def encode_text(memory: _Memory, text: str) -> Iterator[int]:
    plain, common, full, odd = _patterns()
    split = plain if text.isascii() else common if odd.isdisjoint(text) else full
    return chain.from_iterable(map(memory.__getitem__, split(text)))


def encoder(bpe: ByteBPE) -> _Memory:
    return _Memory(bpe)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE.load(path)


def _encoded(docs: DataFrame, doc_id: str, text: str, vocabulary: str, counts_only: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = shared.value
        memory = bpe.__dict__.setdefault("_memory", encoder(bpe))  # lives as long as the worker
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            parts, ends, at = [], [0], 0
            for t in texts:
                t = t.as_py()
                ids = np.fromiter(encode_text(memory, t), "int32") if t else np.empty(0, "int32")
                at += len(ids)
                ends.append(at)
                if not counts_only:
                    parts.append(ids)
            if counts_only:
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends), "int64")], names=[doc_id, "n_tokens"])
            else:
                flat = np.concatenate(parts) if parts else np.empty(0, "int32")
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(flat))], names=[doc_id, "ids"])

    made = "n_tokens bigint" if counts_only else "ids array<int>"
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {made}")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id` and `ids` (array<int>) of each row, without special tokens; text like a special token is plain text.

    Null and empty texts give an empty list, blank ones the ids of their blanks. Any length is encoded whole.
    Each row gives one row, repeated rows and null ids included; other columns are ignored.
    """
    return _encoded(docs, doc_id, text, vocabulary, False)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id` and `n_tokens` of each row; 0 for null and empty texts."""
    return _encoded(docs, doc_id, text, vocabulary, True)


#: Repeated ids that are sent to every task (some 50 MB at most).
REPEATED = 1_000_000


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` (id and text) without repeated rows.

    Up to REPEATED ids that occur again, only their rows are shuffled with their text, merged map-side first; beyond that all rows are.
    """
    docs = docs.select(doc_id, text)
    again = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(doc_id).alias("__id"))
    n = again.count()
    if not n:
        return docs
    if n > REPEATED:
        return docs.distinct()
    few = F.broadcast(again)
    same = docs[doc_id].eqNullSafe(F.col("__id"))
    return docs.join(few, same, "left_anti").unionByName(docs.join(few, same, "left_semi").distinct())
