"""Passages of evaluation items inside corpus documents.

Texts become words: look-alike characters in one form, case folded, runs of letters and digits.  The
positions of a window are dealt to ``GROUPS`` classes, and each fixed mask ignores ``misses`` of them
(spaced seeds): so many replaced words of a window lie in at most so many classes, so that one of the
masks passes over all of them and its seed is still equal.  The seeds of the evaluation items meet those
of the documents by equality; every hit is then verified word by word.  No window with at most
``misses`` replaced words is lost.

An overlap of a document and an item joins the verified windows on one diagonal (equal distance of
positions): ``n_words`` positions, of which ``n_equal`` hold equal words; ``exact`` tells whether one of
the windows has no replaced word at all.

The evaluation side is sent to the executors only if its size, which is measured first, stays within
``SENT_WORDS``.  Beyond that the seeds of both sides meet in a join: document windows carry their own word
numbers and pass a filter of ``FILTER_BITS`` bits of the items' seeds first, so that only hits are
shuffled and no text is read twice.

Null and empty texts and texts shorter than the window hold no passage.  Rows repeated under one id count
once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.lookalike import default_rewriter
from gleaner.llm.tokenize import _slices
from gleaner.session import materialize, spread

WINDOW, GROUPS, MISSES = 14, 4, 2
SENT_WORDS = 4_000_000
FILTER_BITS = 1 << 26
PRIME = np.uint64(0x9E3779B97F4A7C15)
_find = re.compile(r"[^\W_]+").findall


def masks_of(window: int, misses: int) -> tuple[str, ...]:
    """The masks, 0 where a word is ignored; without misses the one full mask."""
    return tuple("".join("0" if i % GROUPS in skip else "1" for i in range(window)) for skip in combinations(range(GROUPS), misses))


def words_of(text: str | None) -> list[str]:
    """The words of a text in the form in which they are compared."""
    return _find(default_rewriter()(text).casefold()) if text else []


def word_hash(word: str) -> int:
    """A 64-bit number of a word, never 0."""
    return xxhash.xxh64_intdigest(word) or 1


class Hasher:
    """Word hashes with a cache; words outside ``only`` (if given) are 0."""

    def __init__(self, only: frozenset[str] | None = None) -> None:
        self.only, self.known = only, {w: word_hash(w) for w in only or ()}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if self.only is not None:
            return [known.get(w, 0) for w in words]
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = word_hash(w)
        return [known[w] for w in words]


def seeds(ids: np.ndarray, owner: np.ndarray, masks: tuple[str, ...], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: start positions and seeds of all windows inside one owner without unknown words
    at the mask's ones."""
    n = len(ids) - window + 1
    if n <= 0:
        return
    inside = owner[:n] == owner[window - 1 :]
    for k, mask in enumerate(masks):
        seed = np.full(n, k + 1, np.uint64)
        good = inside.copy()
        for at, one in enumerate(mask):
            if one == "1":
                part = ids[at : at + n]
                good &= part != 0
                seed = (seed ^ part) * PRIME
                seed ^= seed >> np.uint64(29)
        start = np.flatnonzero(good)
        yield start, seed[start]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts in a row, and which text each belongs to."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for x in lists for i in x), np.uint64, int(sizes.sum()))
    return ids, np.repeat(np.arange(len(lists)), sizes)


class Items:
    """The evaluation side in memory: word numbers, seeds in order, and where each seed stands."""

    def __init__(self, texts: list[str | None], masks: tuple[str, ...], window: int) -> None:
        words = [words_of(t) for t in texts]
        self.hasher = Hasher(frozenset(w for ws in words for w in ws))
        self.masks, self.window = masks, window
        self.ids, self.owner = flat([self.hasher(ws) for ws in words])
        found = list(seeds(self.ids, self.owner, masks, window))
        at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
        seed = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.at = seed[order], at[order]

    def overlaps(self, texts: list[str | None], misses: int) -> np.ndarray:
        """Rows ``text, item, n_equal, n_words, exact``: the best verified overlap of each pair."""
        ids, owner = flat([self.hasher(words_of(t)) for t in texts])
        here, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, seed in seeds(ids, owner, self.masks, self.window) if len(self.seed) else ():
            low, high = np.searchsorted(self.seed, seed, "left"), np.searchsorted(self.seed, seed, "right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            here.append(np.repeat(start[hit], count))
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            there.append(self.at[np.repeat(low[hit], count) + step])
        i, j = np.concatenate(here), np.concatenate(there)
        if not len(i):
            return np.zeros((0, 5), np.int64)
        code = np.unique(i * len(self.ids) + j)
        i, j = code // len(self.ids), code % len(self.ids)
        span = np.arange(self.window)
        equal = ids[i[:, None] + span] == self.ids[j[:, None] + span]
        n = equal.sum(1)
        good = n >= self.window - misses
        i, j, equal, n = i[good], j[good], equal[good], n[good]
        # all positions of the windows once, then the sums of each diagonal
        cell, first = np.unique(((i[:, None] + span) * len(self.ids) + j[:, None] + span).ravel(), return_index=True)
        same, i, j, whole = equal.ravel()[first], cell // len(self.ids), cell % len(self.ids), np.repeat(n == self.window, self.window)
        exact = np.zeros(len(cell), bool)
        np.logical_or.at(exact, np.searchsorted(cell, ((code[good] // len(self.ids))[:, None] + span).ravel() * len(self.ids) + ((code[good] % len(self.ids))[:, None] + span).ravel()), whole)
        line = np.stack([owner[i], self.owner[j], i - j], 1)
        lines, of = np.unique(line, axis=0, return_inverse=True)
        of = of.ravel()
        words, hits = np.bincount(of), np.bincount(of, same).astype(np.int64)
        full = np.bincount(of, exact) > 0
        order = np.lexsort((-words, -hits, lines[:, 1], lines[:, 0]))
        pair, at = np.unique(lines[order][:, :2], axis=0, return_index=True)
        any_full = np.maximum.reduceat(full[order].astype(np.int64), at)
        best = order[at]
        return np.column_stack([pair, hits[best], words[best], any_full])


_items: dict[str, Items] = {}


def _sent(name: str, rows: Broadcast, masks: tuple[str, ...], window: int) -> Items:
    """The evaluation side, built once a worker process."""
    if name not in _items:
        _items.clear()
        _items[name] = Items(rows.value, masks, window)
    return _items[name]


def _scan(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, misses: int, window: int) -> DataFrame:
    """Overlaps with items that are small enough to be sent."""
    masks = masks_of(window, misses)
    rows = items.select(item, item_text).where(F.col(item_text).isNotNull()).toArrow()
    ids = rows.column(0).combine_chunks()
    sent, name = docs.sparkSession.sparkContext.broadcast(rows.column(1).to_pylist()), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _sent(name, sent, masks, window)
        for batch in batches:
            for part in _slices(batch, 1):
                got = own.overlaps(part.column(1).to_pylist(), misses)
                keys, where = part.column(0).take(pa.array(got[:, 0])), ids.take(pa.array(got[:, 1]))
                yield pa.RecordBatch.from_arrays([keys, where, pa.array(got[:, 2], pa.int32()), pa.array(got[:, 3], pa.int32()), pa.array(got[:, 4] > 0)], ["_d", "_i", "n_equal", "n_words", "exact"])

    source = spread(docs.select(F.col(key).alias("_d"), F.col(text).alias("_t")).where("_t is not null"))
    return source.mapInArrow(scan, f"_d {docs.schema[key].dataType.simpleString()}, _i {items.schema[item].dataType.simpleString()}, n_equal int, n_words int, exact boolean")


def _spots(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a seed sets."""
    return seed % np.uint64(bits), (seed >> np.uint64(17)) * PRIME % np.uint64(bits)


def _windows(df: DataFrame, key: str, text: str, window: int, masks: tuple[str, ...], passes: np.ndarray | None = None) -> DataFrame:
    """``(_k, _v, _at, _seed, _w)``: the windows of every text with their seeds and word numbers; ``_v``
    tells texts of one id apart; only seeds that pass the filter, if there is one."""
    sent = df.sparkSession.sparkContext.broadcast(passes) if passes is not None else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        span = np.arange(window)
        for batch in batches:
            for part in _slices(batch, 1, 1 << 20):
                ids, owner = flat([hasher(words_of(t)) for t in part.column(1).to_pylist()])
                size = np.searchsorted(owner, np.arange(len(part)))
                for start, seed in seeds(ids, owner, masks, window):
                    if sent is not None:
                        a, b = _spots(seed, FILTER_BITS)
                        ok = ((sent.value[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (sent.value[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                        start, seed = start[ok], seed[ok]
                    own = owner[start]
                    words = pa.FixedSizeListArray.from_arrays(pa.array(ids[start[:, None] + span].ravel().view(np.int64)), window).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(2).take(pa.array(own)), pa.array(start - size[own], pa.int32()), pa.array(seed.view(np.int64)), words], ["_k", "_v", "_at", "_seed", "_w"])

    source = spread(df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(text).alias("_v")).where("_t is not null"))
    return source.mapInArrow(make, f"_k {df.schema[key].dataType.simpleString()}, _v long, _at int, _seed long, _w array<long>")


def _filter(rows: DataFrame) -> np.ndarray:
    """The bits of all seeds, of fixed size whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            for spot in _spots(batch.column(0).to_numpy().view(np.uint64), FILTER_BITS):
                np.bitwise_or.at(bits, spot >> np.uint64(6), np.uint64(1) << (spot & np.uint64(63)))
        hit = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(bits[hit].view(np.int64))], ["k", "b"])

    got = rows.select("_seed").mapInArrow(mark, "k long, b long").groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column("k").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def _join(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, misses: int, window: int) -> DataFrame:
    """Overlaps with items of any number: seeds meet in a join, hits are verified on the word numbers that
    they carry."""
    masks = masks_of(window, misses)
    right = materialize(_windows(items, item, item_text, window, masks), "seeds")
    left = _windows(docs, key, text, window, masks, _filter(right))
    right = right.select("_seed", F.col("_k").alias("_i"), F.col("_v").alias("_u"), F.col("_at").alias("_b"), F.col("_w").alias("_x"))
    hits = left.join(right, "_seed").withColumn("_e", F.zip_with("_w", "_x", lambda a, b: a == b))
    n = F.size(F.filter("_e", lambda e: e))
    hits = hits.where(n >= window - misses)
    cells = hits.select(F.col("_k").alias("_d"), "_v", "_i", "_u", (F.col("_at") - F.col("_b")).alias("_line"), "_at", (n == window).alias("exact"), F.posexplode("_e").alias("_p", "_e"))
    cells = cells.groupBy("_d", "_v", "_i", "_u", "_line", (F.col("_at") + F.col("_p")).alias("_p")).agg(F.max(F.col("_e").cast("int")).alias("_e"), F.max("exact").alias("exact"))
    return cells.groupBy("_d", "_v", "_i", "_u", "_line").agg(F.sum("_e").cast("int").alias("n_equal"), F.count("*").cast("int").alias("n_words"), F.max("exact").alias("exact"))


def overlaps(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, misses: int = MISSES, window: int = WINDOW, sent_words: int = SENT_WORDS) -> DataFrame:
    """``(key, item, n_equal, n_words, exact)``: documents and the items of which they hold a passage of at
    least ``window`` words, at most ``misses`` of them (fewer than GROUPS) replaced in any window; the
    overlap with most equal words of each pair."""
    size = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    way = _scan if size <= sent_words * 6 else _join
    found = way(docs, key, text, items, item, item_text, misses, window)
    best = found.groupBy("_d", "_i").agg(F.max(F.struct("n_equal", "n_words")).alias("_x"), F.max("exact").alias("exact"))
    return best.select(F.col("_d").alias(key), F.col("_i").alias(item), "_x.n_equal", "_x.n_words", "exact")
