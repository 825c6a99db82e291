"""Subject areas of documents.

Texts are cut into sentences and words once; words travel as 64-bit hashes.  A document is the
normalised vector of its word weights (inverse document frequency times how far the labelled documents
with the word differ in subject from all labelled ones).  Bisecting k-means splits the corpus into
leaves, every round over all documents; a node starts from the two subjects its labels disagree on, or,
where it has no two, from its heaviest term against its mean.  Leaves take their subjects from the
labels among their documents and from their discriminative terms.

A document is a mixture of leaves: each of its sentences goes to the leaves by their terms, terms of
leaves are counted again from the sentences, and after some rounds the subjects of the leaves that a
sentence is likely to come from decide what it deals with.  A document has each subject with which at
least ``share`` of its sentences deal.

Works for any language that the labels cover.  Null, empty and blank texts, and texts in which no
sentence deals with a subject, give no row.  Labels are trimmed and compared without case; null and
unknown subjects are ignored, several labels of a document share its vote.  Without any labels the
words of the subjects' names and descriptions count as labels do.  Rows repeated under one id give
one row.  Ties between subjects go to the alphabetically first.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.lookalike import default_rewriter
from gleaner.llm.tokenize import _slices
from gleaner.session import materialize, spread

#: A word counts if MIN_DOCS documents hold it and it occurs in MIN_LABELLED labelled documents, in a
#: description, or in MIN_SHARE of all documents.  The bounds on labels and share bound the vocabulary;
#: words of labelled documents never leave it however large the corpus is.
MIN_SHARE, MIN_DOCS, MIN_LABELLED = 0.0004, 3, 4
#: Labelled documents that are used, by hash order: the bounded sample that names and starts leaves.
LABELLED = 20_000
#: A sentence that WHOLE labelled documents hold unchanged (a footer, a link, a copied line) is one term of
#: its own: what it deals with is told by those documents and not by its words.
WHOLE = 10
LEAVES, PASSES, ROUNDS = 96, 2, 3
#: Terms below this share of the greatest weight do not move a document and are left out of clustering.
LIGHT = 0.05
#: Purity from which a term speaks for a subject; so many votes of labelled documents weigh as much as
#: what the leaves say about a term.
PURE, DOUBT = 0.5, 3.0
_find = re.compile(r"[^\W\d_]+|[.!?]+(?=\s|$)|\d+").findall
END, OTHER = 0, 1  # numbers of a sentence's end and of digits and short words


def word_hash(word: str) -> int:
    """A signed 64-bit number of a word of three letters or more, OTHER for the rest, END for a full stop."""
    if word[0] in ".!?":
        return END
    if len(word) < 3 or not word[0].isalpha():
        return OTHER
    h = xxhash.xxh64_intdigest(word)
    h -= (h >> 63) << 64
    return h if h not in (END, OTHER) else 2


class Cutter:
    """Texts as flat arrays of word numbers with the sizes of their sentences; keeps words it has seen."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Sentences of each text, words of each sentence, numbers of the sentences as wholes, words."""
        plain, known = default_rewriter(), self.known
        if len(known) > 300_000:
            known.clear()
        cut = [_find(plain(t).casefold()) if t else [] for t in texts]
        for ws in cut:
            ws.append(".")
        for w in set().union(*cut).difference(known):
            known[w] = word_hash(w)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(cut)), sizes)
        sentence = np.cumsum(flat == END)
        keep = flat != END
        flat, text, sentence = flat[keep], text[keep], sentence[keep]
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        number = np.cumsum(np.diff(sentence, prepend=-1) != 0) - 1
        words = flat != OTHER
        place = np.arange(len(flat)) - first[number] + 1 if len(flat) else flat
        mixed = (flat.view(np.uint64) ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), first).view(np.int64) if len(first) else np.zeros(0, np.int64)
        return np.bincount(text[first], minlength=len(cut)).tolist(), np.bincount(number[words], minlength=len(first)), whole, flat[words]


def sentences_of(text: str | None) -> list[int]:
    """The number of words in each sentence of a text."""
    return Cutter()([text])[1].tolist()


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _hashed(docs: DataFrame) -> DataFrame:
    """``(doc, sizes, wholes, words)`` of the documents with a sentence: the one pass over their texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            for part in _slices(batch, 1):
                count, sizes, wholes, words = cutter(part.column(1).to_pylist())
                inside = np.add.reduceat(np.append(sizes, 0), np.minimum(np.cumsum([0, *count[:-1]]), len(sizes))) if count else np.zeros(0, np.int64)
                inside = np.where(np.array(count) > 0, inside, 0)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(count, sizes, pa.int32()), _lists(count, wholes, pa.int64()), _lists(inside, words, pa.int64())], ["doc", "sizes", "wholes", "words"])

    return docs.mapInArrow(cut, f"doc {docs.schema['doc'].dataType.simpleString()}, sizes array<int>, wholes array<long>, words array<long>").where("size(sizes) > 0")


def _places(vocabulary: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where each number stands in a sorted vocabulary, -1 for unknown ones."""
    if not len(vocabulary):
        return np.full(len(numbers), -1)
    at = np.minimum(np.searchsorted(vocabulary, numbers), len(vocabulary) - 1)
    return np.where(vocabulary[at] == numbers, at, -1)


def _encoded(hashed: DataFrame, words: np.ndarray, wholes: np.ndarray) -> DataFrame:
    """``(doc, sizes, terms)``: the terms of every sentence by number, known words or the known whole."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per, flat = batch.column("sizes").flatten().to_numpy(), batch.column("words").flatten().to_numpy()
            count = np.asarray(batch.column("sizes").value_lengths()).astype(np.int64)
            one = _places(wholes, batch.column("wholes").flatten().to_numpy())
            sentence = np.repeat(np.arange(len(per)), per)
            at = _places(words, flat)
            known = np.flatnonzero((at >= 0) & (one < 0)[sentence]) if len(flat) else np.zeros(0, np.int64)
            alone = np.flatnonzero(one >= 0)
            owner, term = np.concatenate([sentence[known], alone]), np.concatenate([at[known], len(words) + one[alone]])
            order = np.argsort(owner, kind="stable")
            doc = np.repeat(np.arange(len(batch)), count)[owner]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(count, np.bincount(owner, minlength=len(per)), pa.int32()), _lists(np.bincount(doc, minlength=len(batch)), term[order], pa.int32())], ["doc", "sizes", "terms"])

    return hashed.mapInArrow(encode, f"doc {hashed.schema['doc'].dataType.simpleString()}, sizes array<int>, terms array<int>")


def _heavy(encoded: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``(sizes, terms)`` with the heavy terms only, each document as one sentence."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            flat = terms.flatten().to_numpy()
            kept = _places(heavy, flat) >= 0
            count = np.bincount(np.repeat(np.arange(len(batch)), np.asarray(terms.value_lengths()))[kept], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([_lists(np.ones(len(batch), int), count, pa.int32()), _lists(count, flat[kept], pa.int32())], ["sizes", "terms"])

    return encoded.select("terms").mapInArrow(thin, "sizes array<int>, terms array<int>")


class Tree:
    """Splits by level: ``place[node]`` is the row of ``ways`` that splits a node (-1: none), ``child``
    the node that takes the documents on the negative side."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaves = 1

    def grown(self, nodes: np.ndarray, ways: np.ndarray) -> Tree:
        out = Tree()
        place, child = np.full(self.leaves, -1), np.zeros(self.leaves, np.int64)
        place[nodes], child[nodes] = np.arange(len(nodes)), self.leaves + np.arange(len(nodes))
        out.levels, out.leaves = [*self.levels, (place, child, ways.astype(np.float32))], self.leaves + len(nodes)
        return out


class Batch:
    """One Arrow batch of encoded documents as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray) -> None:
        self.n = len(batch)
        sizes, terms = batch.column("sizes"), batch.column("terms")
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.asarray(sizes.value_lengths().fill_null(0)).astype(np.int64)
        self.sentence_doc = np.repeat(np.arange(self.n), count)
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.doc = self.sentence_doc[self.sentence] if len(self.sizes) else np.zeros(0, np.int64)
        w = weight[self.terms] if len(self.terms) else np.zeros(0)
        norm = np.sqrt(np.bincount(self.doc, w * w, self.n))
        self.w = w / np.maximum(norm, 1e-12)[self.doc] if len(w) else w

    def leaf(self, tree: Tree) -> np.ndarray:
        """The leaf each document reaches."""
        node = np.zeros(self.n, np.int64)
        for place, child, ways in tree.levels:
            row = place[node]
            at = row[self.doc]
            moved = at >= 0
            score = np.bincount(self.doc[moved], self.w[moved] * ways[at[moved], self.terms[moved]], self.n) if moved.any() else np.zeros(self.n)
            node = np.where((row >= 0) & (score < 0), child[node], node)
        return node


def _collected(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums ``(k, v)`` of all tasks as a dense array; there are at most as many rows as cells."""
    out = np.zeros(shape[0] * shape[1])
    got = rows.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(shape)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    hit = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["k", "v"])


def _sums(encoded: DataFrame, weight: np.ndarray, tree: Tree, plain: bool = False) -> np.ndarray:
    """Sums of document vectors (``plain``: of counts) by leaf over all documents, the number of
    documents in the last column."""
    size = len(weight)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tree.leaves * (size + 1))
        for batch in batches:
            b = Batch(batch, weight)
            leaf = b.leaf(tree)
            total += np.bincount(leaf * (size + 1) + size, minlength=len(total))
            if len(b.w):
                total += np.bincount(leaf[b.doc] * (size + 1) + b.terms, None if plain else b.w, len(total))
        yield _cells(total)

    return _collected(encoded.select("sizes", "terms").mapInArrow(add, "k long, v double"), (tree.leaves, size + 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(-1, keepdims=True)), 1e-12)


def _sorted_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ``w`` in order with their counts ``n``."""
    got = rows.select("w", "n").toArrow()
    w, n = got.column("w").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(float)
    at = np.argsort(w)
    return w[at], n[at]


class Labelled:
    """The bounded sample of labelled documents as one batch, with their votes by subject."""

    def __init__(self, rows: pa.Table, weight: np.ndarray, subjects: int) -> None:
        batch = rows.combine_chunks().to_batches()
        self.votes = np.array([r.as_py() for r in rows.column("votes")]).reshape(-1, subjects) if rows.num_rows else np.zeros((0, subjects))
        self.batch = Batch(batch[0], weight) if batch else None

    def inside(self, tree: Tree) -> np.ndarray:
        """Votes by leaf and subject."""
        out = np.zeros((tree.leaves, self.votes.shape[1]))
        if self.batch:
            np.add.at(out, self.batch.leaf(tree), self.votes)
        return out

    def starts(self, tree: Tree, nodes: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """A first direction for each node: between its two strongest subjects, or from its heaviest
        term to its mean."""
        means, votes = _unit(sums[nodes]), self.inside(tree)[nodes]
        leaf = self.batch.leaf(tree) if self.batch else np.zeros(0, np.int64)
        ways = np.zeros_like(means)
        for i, node in enumerate(nodes):
            first, second = np.argsort(-votes[i], kind="stable")[:2] if votes.shape[1] > 1 else (0, 0)
            if first != second and votes[i, second] >= 1:
                b = self.batch
                side = (self.votes[:, first] - self.votes[:, second]) * (leaf == node)
                pull = [np.bincount(b.terms, b.w * np.maximum(sign * side, 0)[b.doc], means.shape[1]) for sign in (1, -1)]
                ways[i] = _unit(pull[0]) - _unit(pull[1])
            else:
                ways[i] = -means[i]
                ways[i, means[i].argmax()] += 1
        return ways


def bisect(encoded: DataFrame, weight: np.ndarray, labelled: Labelled, leaves: int = LEAVES, passes: int = PASSES) -> tuple[Tree, np.ndarray]:
    """Bisecting k-means over all documents: the tree, and the sums of its leaves.

    Each round splits all nodes, from 16 on the two thirds whose labels disagree most (without labels, whose documents
    lie farthest from their mean), and moves the halves by ``passes`` passes over everything."""
    tree, size = Tree(), len(weight)
    sums = _sums(encoded, weight, tree)
    while tree.leaves < leaves and size:
        votes, n, total = labelled.inside(tree), sums[:, size], np.sqrt((sums[:, :size] ** 2).sum(1))
        apart = votes.sum(1) - votes.max(1) if votes.shape[1] else np.zeros(tree.leaves)
        spread_ = n - total
        cost = apart / max(apart.sum(), 1e-9) + 0.1 * spread_ / max(spread_.sum(), 1e-9)
        order = np.argsort(-cost, kind="stable")
        nodes = np.sort([k for k in order[: min(tree.leaves if tree.leaves < 16 else tree.leaves * 2 // 3, leaves - tree.leaves)] if n[k] > 1 and spread_[k] > 1e-9])
        if not len(nodes):
            break
        ways = labelled.starts(tree, nodes, sums[:, :size])
        for _ in range(passes):
            grown = tree.grown(nodes, ways)
            moved = _sums(encoded, weight, grown)
            ways = _unit(moved[nodes, :size]) - _unit(moved[tree.leaves :, :size])
        tree = tree.grown(nodes, ways)
        sums = moved
        if not (moved[nodes, size] * moved[tree.leaves - len(nodes) :, size]).any():
            break
    return tree, sums


class Judge:
    """Sends sentences to leaves by the counts of terms by leaf, and to subjects by those of the leaves."""

    def __init__(self, counts: np.ndarray, subjects: np.ndarray, prior: np.ndarray, votes: np.ndarray) -> None:
        """``counts``: terms by leaf, the last column without a subject; ``subjects``: leaf by subject;
        ``votes``: terms by subject in the labelled documents, which may deny what the leaves say."""
        inside = counts[:, :-1]
        size = np.maximum(inside.sum(0), 1e-9)
        self.mix = subjects
        self.log_leaf = np.log((size + 1) / (size + 1).sum())
        p = (inside @ subjects + 2.0 * prior) / (counts.sum(1, keepdims=True) + 2.0)
        p = (votes + DOUBT * p) / (votes.sum(1, keepdims=True) + DOUBT)
        self.pure = p.max(1) if len(p) else np.zeros(0)
        held = inside.sum(1, keepdims=True)
        base = size / size.sum()
        self.pull = np.log((inside + 0.5 * base) / (held + 0.5) / base).astype(np.float32)
        self.use = (self.pure >= PURE) & (counts.sum(1) >= 1)

    def __call__(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """The leaf and the subject of each sentence, -1 for none."""
        leaf, subject = np.full(len(b.sizes), -1), np.full(len(b.sizes), -1)
        known = np.flatnonzero(self.use[b.terms]) if len(b.terms) else np.zeros(0, np.int64)
        for at in range(0, len(known), 50_000):  # a sentence cut in two by a part is judged by its last
            part = known[at : at + 50_000]
            if at and b.sentence[part[0]] == b.sentence[known[at - 1]]:
                part = np.concatenate([known[np.searchsorted(b.sentence[known], b.sentence[part[0]]) : at], part])
            first = np.flatnonzero(np.diff(b.sentence[part], prepend=-1))
            score = np.add.reduceat(self.pull[b.terms[part]], first, axis=0) + self.log_leaf
            to = b.sentence[part[first]]
            leaf[to] = score.argmax(1)
            score = np.exp(score - score.max(1, keepdims=True))
            subject[to] = (score @ self.mix).argmax(1)
        return leaf, subject


def _recount(encoded: DataFrame, weight: np.ndarray, tree: Tree, judge: Judge) -> np.ndarray:
    """Counts of terms by leaf from the sentences of all documents.

    Terms of sentences without a subject are shared by the leaves of their document's other sentences;
    where it has none, they count for no leaf (the last column)."""
    size = len(weight)
    wide = tree.leaves + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * wide)
        for batch in batches:
            b = Batch(batch, weight)
            if not len(b.terms):
                continue
            to, _ = judge(b)
            kept = to >= 0
            total += np.bincount(b.terms[kept[b.sentence]] * wide + to[b.sentence[kept[b.sentence]]], minlength=len(total))
            # (document, leaf) pairs with their shares, in order of documents
            pair, n = np.unique(b.sentence_doc[kept] * wide + to[kept], return_counts=True)
            doc, leaf = pair // wide, pair % wide
            share = n / np.maximum(np.bincount(doc, n, b.n), 1)[doc]
            start, count = np.searchsorted(doc, np.arange(b.n)), np.bincount(doc, minlength=b.n)
            open_ = np.flatnonzero(~kept[b.sentence])
            lone = open_[count[b.doc[open_]] == 0]
            total += np.bincount(b.terms[lone] * wide + wide - 1, minlength=len(total))
            size_of = count[b.doc[open_]]
            step = np.arange(int(size_of.sum())) - np.repeat(np.cumsum(size_of) - size_of, size_of)
            at = np.repeat(start[b.doc[open_]], size_of) + step
            total += np.bincount(np.repeat(b.terms[open_], size_of) * wide + leaf[at], share[at], len(total))
        yield _cells(total)

    return _collected(encoded.select("sizes", "terms").mapInArrow(add, "k long, v double"), (size, wide))


class Model:
    """What is learnt from a corpus: vocabulary, tree, subjects of leaves and the judge of sentences."""

    def __init__(self, docs: DataFrame, areas: list[tuple[str, str]], labels: DataFrame | None, leaves: int = LEAVES) -> None:
        self.subjects, self.docs = [s for s, _ in areas], docs
        k = len(areas)
        if not k:
            return
        hashed = materialize(_hashed(docs), "hashed")
        votes = self._votes(labels, hashed)
        named = [{w for t in area for w in Cutter()([t])[3].tolist()} for area in areas]
        if votes is not None:  # at most LABELLED rows, so that they can be sent
            self.labelled = materialize(hashed.join(F.broadcast(votes), "doc"), "labelled")
        total = hashed.count()
        self.words, df = self._vocabulary(hashed, votes, sorted(set().union(*named)), total)
        wholes, often = self._wholes(hashed, votes)
        df = np.concatenate([df, often])
        size = len(df)
        self.encoded = encoded = materialize(_encoded(hashed, self.words, wholes), "encoded")
        idf = np.log(max(total, 1) / np.maximum(df, 1)) if size else np.zeros(0)
        sample = encoded.join(F.broadcast(votes), "doc").select("sizes", "terms", "votes").toArrow() if votes is not None else pa.table({"sizes": pa.array([], pa.list_(pa.int32())), "terms": pa.array([], pa.list_(pa.int32())), "votes": pa.array([], pa.list_(pa.float64()))})
        counts = self._counts(sample, size, k)
        all_votes = np.maximum(np.array([r.as_py() for r in sample.column("votes")]).reshape(-1, k).sum(0), 1.0)
        self.prior = prior = all_votes / all_votes.sum()
        for s, ws in enumerate(named):
            at = _places(self.words, np.array(sorted(ws), np.int64))
            counts[at[at >= 0], s] += 0.5
        p = (counts + 2.0 * prior) / (counts.sum(1, keepdims=True) + 2.0)
        far = (p * np.log(np.maximum(p, 1e-9) / prior)).sum(1)
        self.weight = idf * np.maximum(far, 0.01)
        labelled = Labelled(sample, self.weight, k)
        heavy = np.flatnonzero(self.weight >= LIGHT * self.weight.max(initial=0))
        self.tree, sums = bisect(materialize(_heavy(encoded, heavy), "heavy"), self.weight, labelled, leaves)
        # leaves by subject: labels inside, and the terms that set the leaf apart
        self.centres = _unit(sums[:, :size])
        by_terms = np.maximum(self.centres - self.centres.mean(0), 0) @ p if size else np.zeros((self.tree.leaves, k))
        by_terms = np.where(by_terms.sum(1, keepdims=True) > 0, by_terms / np.maximum(by_terms.sum(1, keepdims=True), 1e-12), prior)
        inside = labelled.inside(self.tree)
        self.mixture = (inside + 2.0 * by_terms) / (inside.sum(1, keepdims=True) + 2.0)
        seen = np.concatenate([_sums(encoded, self.weight, self.tree, plain=True)[:, :size].T, np.zeros((size, 1))], 1)
        self.judge = Judge(seen, self.mixture, prior, counts)
        for _ in range(ROUNDS if size else 0):
            seen = _recount(encoded, self.weight, self.tree, self.judge)
            self.mixture = self._mixture(labelled, by_terms)
            self.judge = Judge(seen, self.mixture, prior, counts)

    def _mixture(self, labelled: Labelled, by_terms: np.ndarray) -> np.ndarray:
        """Leaves by subject from the labels of the sentences they hold."""
        out = 2.0 * by_terms
        if labelled.batch:
            leaf, _ = self.judge(labelled.batch)
            kept = leaf >= 0
            n = np.maximum(np.bincount(labelled.batch.sentence_doc[kept], minlength=labelled.batch.n), 1)
            doc = labelled.batch.sentence_doc[kept]
            np.add.at(out, leaf[kept], labelled.votes[doc] / n[doc][:, None])
        return out / np.maximum(out.sum(1, keepdims=True), 1e-12)

    def _votes(self, labels: DataFrame | None, hashed: DataFrame) -> DataFrame | None:
        """``(doc, votes)`` of at most LABELLED labelled documents; a document's labels share one vote."""
        if labels is None:
            return None
        k = len(self.subjects)
        names = labels.sparkSession.createDataFrame([(s.strip().lower(), i) for i, s in enumerate(self.subjects)], "_name string, s int")
        rows = labels.select("doc", F.lower(F.trim("subject")).alias("_name")).join(F.broadcast(names), "_name")
        each = [(F.count_if(F.col("s") == i) / F.count("*")).cast("double") for i in range(k)]
        return materialize(rows.join(hashed.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.array(*each).alias("votes")).orderBy(F.xxhash64("doc"), "doc").limit(LABELLED), "votes")

    def _vocabulary(self, hashed: DataFrame, votes: DataFrame | None, named: list[int], total: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers in order, and their document counts."""
        words = hashed.select(F.explode(F.array_distinct("words")).alias("w"))
        counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS), "words")
        asked = hashed.sparkSession.createDataFrame([(w,) for w in named], "w long")
        if votes is not None:
            own = self.labelled.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().where(F.col("count") >= MIN_LABELLED).select("w")
            asked = asked.unionByName(own).distinct()
        kept = counts.join(asked.withColumn("_own", F.lit(True)), "w", "left").where(F.col("_own") | (F.col("n") >= MIN_SHARE * total))
        return _sorted_counts(kept)

    def _wholes(self, hashed: DataFrame, votes: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        """Sentences that recur in labelled documents, and how many documents hold them."""
        if votes is None:
            return np.zeros(0, np.int64), np.zeros(0)
        each = lambda rows: rows.select(F.explode(F.array_distinct("wholes")).alias("w"))
        known = each(self.labelled).groupBy("w").count().where(F.col("count") >= WHOLE).select("w")
        return _sorted_counts(each(hashed).join(F.broadcast(known), "w").groupBy("w").agg(F.count("*").alias("n")))

    @staticmethod
    def _counts(sample: pa.Table, size: int, k: int) -> np.ndarray:
        """Votes of labelled documents by term and subject."""
        out = np.zeros((size, k))
        for terms, votes in zip(sample.column("terms").to_pylist(), sample.column("votes").to_pylist()):
            out[list(set(terms))] += votes
        return out

    def shares(self) -> DataFrame:
        """``(doc, subject, n_sentences, n_all)``: how many sentences deal with each subject."""
        weight, judge, k, names = self.weight, self.judge, len(self.subjects), self.subjects

        def judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = Batch(batch, weight)
                _, to = judge(b)
                kept = to >= 0
                n = np.bincount(b.sentence_doc[kept] * k + to[kept], minlength=b.n * k)
                all_ = np.bincount(b.sentence_doc, minlength=b.n)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(hit // k)), pa.array([names[s] for s in hit % k], pa.string()), pa.array(n[hit]), pa.array(all_[hit // k])], ["doc", "subject", "n_sentences", "n_all"])

        kind = self.encoded.schema["doc"].dataType.simpleString()
        rows = self.encoded.mapInArrow(judge_all, f"doc {kind}, subject string, n_sentences long, n_all long")
        return rows.groupBy("doc", "subject").agg(F.max("n_sentences").alias("n_sentences"), F.min("n_all").alias("n_all"))

    def leaf_table(self, terms: int = 8) -> list[tuple[int, str, float, str]]:
        """Each leaf with its first subject, that subject's share and its discriminative terms, which one
        more pass over the texts spells out."""
        mean = self.centres.mean(0)
        n = len(self.words)
        best = [[int(self.words[t]) for t in np.argsort((mean - c)[:n], kind="stable")[:terms] if c[t] > mean[t]] for c in self.centres]
        wanted = {w for ws in best for w in ws}

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, str] = {}
            for batch in batches:
                for t in batch.column(1).to_pylist():
                    seen.update((h, w) for w in set(_find(default_rewriter()(t).casefold())) if (h := word_hash(w)) in wanted)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.string())], ["h", "w"])

        name = {r["h"]: r["w"] for r in self.docs.mapInArrow(spell, "h long, w string").groupBy("h").agg(F.min("w").alias("w")).collect()}
        return [(i, self.subjects[int(m.argmax())], round(float(m.max()), 4), " ".join(name.get(w, "?") for w in ws)) for i, (m, ws) in enumerate(zip(self.mixture, best))]


def fit(docs: DataFrame, key: str, text: str, areas: DataFrame, labels: DataFrame | None, most_areas: int = 10_000, leaves: int = LEAVES) -> Model:
    """Learn from ``docs``; ``areas`` has ``subject, description``, ``labels`` has ``key, subject``.

    More than ``most_areas`` subjects are an error."""
    rows = areas.where("subject is not null").groupBy("subject").agg(F.min(F.coalesce("description", F.lit(""))).alias("d")).orderBy("subject").limit(most_areas + 1).collect()
    if len(rows) > most_areas:
        raise ValueError(f"more than {most_areas} subjects")
    own = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null"))
    named = labels.select(F.col(key).alias("doc"), "subject").where("doc is not null and subject is not null") if labels is not None else None
    return Model(own, [(r["subject"], r["d"]) for r in rows], named, leaves)


def subjects(docs: DataFrame, key: str, text: str, areas: DataFrame, labels: DataFrame | None, share: float = 0.25, leaves: int = LEAVES) -> DataFrame:
    """``(key, subject)``: every subject with which at least ``share`` of the sentences deal."""
    model = fit(docs, key, text, areas, labels, leaves=leaves)
    if not model.subjects:
        return docs.where("false").select(key, F.lit("").alias("subject"))
    return model.shares().where(F.col("n_sentences") >= share * F.col("n_all")).select(F.col("doc").alias(key), "subject")
