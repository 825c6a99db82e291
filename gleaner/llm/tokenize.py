"""Encoding of whole texts with a public byte-level BPE vocabulary.

Speculate and verify.  A text is cut into words by the vocabulary's pattern.  For each distinct word
the longest match from the left proposes tokens.  A sequence of tokens is what merging would give if
and only if every adjacent pair stays two tokens when merged on its own; all pairs of a batch are
tested together against an array of pairs already judged, and new ones are judged all at once.  Only words
with a failing pair are merged exactly, the short ones of a batch together.

Null and empty texts give the empty list.  No special tokens are made; their strings in a text are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.session import spread

#: Fixed value: the pattern that cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_KEPT = 200_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The installed file of a public vocabulary; it is read in place."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of more bytes are merged one by one with a heap, the others all at once.
LONG = 64


class Encoder:
    """Encodes texts with the ranks of a vocabulary file; keeps words and pairs it has judged."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(PATTERN).findall
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.size = max(self.ranks.values()) + 1
        self.words: dict[str, list[int]] = {}
        self.good = np.zeros(0, np.int64)  # sorted codes of pairs that stay two tokens
        self.bad = np.zeros(0, np.int64)
        # every way to put a token together from two, by code of the two
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        ways = {self.ranks[t[:i]] * self.size + self.ranks[t[i:]]: n for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pairs = np.array(sorted(ways), np.int64)
        self.made = np.array([ways[c] for c in self.pairs.tolist()], np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair of the lowest rank first, leftmost of equals."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a + b) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (r := self.ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j == len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(parts) and (r := self.ranks.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left] + parts[right]))
        return [self.ranks[p] for p in parts if p is not None]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: the tokens in a row, and how many each word has.

        In each round every word that can still merge merges its leftmost pair of the lowest rank."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, owner = self.byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), sizes)
        done, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(flat):
            code = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            rank = np.append(np.where((self.pairs[at] == code) & (owner[:-1] == owner[1:]), self.made[at], self.size), self.size)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(flat)))
            over = np.repeat(best == self.size, count)
            done.append(flat[over])
            owners.append(owner[over])
            hit = np.flatnonzero((rank == np.repeat(best, count)) & ~over)
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]  # the leftmost of each word
            flat[hit] = rank[hit]
            keep = ~over
            keep[hit + 1] = False
            flat, owner = flat[keep], owner[keep]
        tokens, owner = np.concatenate(done), np.concatenate(owners)
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def propose(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        out, at, end = [], 0, len(word)
        ranks = self.ranks
        while at < end:
            for stop in range(min(end, at + self.longest), at, -1):
                token = ranks.get(word[at:stop])
                if token is not None:
                    out.append(token)
                    at = stop
                    break
        return out

    def _judge(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (as ``first * size + second``) stays two tokens."""
        fresh = np.unique(codes)
        fresh = fresh[~(np.isin(fresh, self.good, assume_unique=True) | np.isin(fresh, self.bad, assume_unique=True))]
        if len(fresh):
            tokens, count = self.merge_all([self.bytes_of[c // self.size] + self.bytes_of[c % self.size] for c in fresh.tolist()])
            start, stays = np.cumsum(count) - count, count == 2
            stays[stays] = tokens[start[stays]] * self.size + tokens[start[stays] + 1] == fresh[stays]
            if len(self.good) > 2_000_000:
                self.good, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64)
                return self._judge(codes)
            self.good = np.sort(np.concatenate([self.good, fresh[stays]]))
            self.bad = np.sort(np.concatenate([self.bad, fresh[~stays]]))
        at = np.searchsorted(self.good, codes)
        return (at < len(self.good)) & (self.good[np.minimum(at, max(len(self.good) - 1, 0))] == codes) if len(self.good) else np.zeros(len(codes), bool)

    def learn(self, words: list[str]) -> None:
        """Encode distinct new words: propose, test all pairs at once, merge the failing words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.ranks.get(r) for r in raw]
        rest = [i for i, t in enumerate(whole) if t is None]
        for i, t in enumerate(whole):
            if t is not None:
                self.words[words[i]] = [t]
        if not rest:
            return
        proposed = [self.propose(raw[i]) for i in rest]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(itertools.chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rest)), sizes)
        inside = owner[:-1] == owner[1:]
        ok = self._judge((flat[:-1] * self.size + flat[1:])[inside])
        failing = set(owner[:-1][inside][~ok].tolist())
        for k, i in enumerate(rest):
            self.words[words[i]] = proposed[k]
        short = [rest[k] for k in failing if len(raw[rest[k]]) <= LONG]
        tokens, count = self.merge_all([raw[i] for i in short])
        ends = np.cumsum(count).tolist()
        tokens = tokens.tolist()
        for i, start, end in zip(short, [0, *ends], ends):
            self.words[words[i]] = tokens[start:end]
        for k in failing:
            if len(raw[rest[k]]) > LONG:
                self.words[words[rest[k]]] = self.merge(raw[rest[k]])

    def encode(self, texts: list[str | None]) -> pa.Array:
        """An Arrow array of token lists."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        cut = [self.split(t) if t else [] for t in texts]
        known = self.words
        new = {w for ws in cut for w in ws if w not in known}
        if new:
            self.learn(list(new))
        lists = [[t for w in ws for t in known[w]] for ws in cut]
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (a longer text is a part of its own)."""
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), np.int64, len(batch))
    start = 0
    for stop in [*np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1, len(batch)]:
        if stop > start:
            yield batch.slice(start, int(stop) - start)
        start = int(stop)


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, ids)`` for every row: the token ids of the whole text, in its order."""
    path = path or tokenizer_path()
    rows = spread(df.select(key, text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in _slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1).to_pylist())], [key, "ids"])

    return rows.mapInArrow(encode, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")
