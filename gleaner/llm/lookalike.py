"""Strings that look the same, brought to one form of characters.

Seed pairs of look-alike strings (letters of other scripts, full-width forms, ligatures, composed
and decomposed accents, invisible characters, kinds of spaces and hyphens) are joined by union-find
into transitive classes.  The member of a class that the corpus holds most often represents it.  A
multi-pattern automaton then rewrites every string, leftmost and longest first, until it no longer
changes.

Case, accents, superscripts, spelling and underscore against space stay as they are: they are
visible.  Null stays null, an empty string stays empty, a string of invisible characters only
becomes empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize, spread

#: Letters of other scripts that most fonts draw like the Latin letter in front.
LETTERS = """
A Α А Ꭺ
B Β В Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Ε Е Ꭼ
G Ԍ Ꮐ
H Η Н Ꮋ
I Ι І Ӏ
J Ј Ϳ Ꭻ
K Κ К Ꮶ
L Ꮮ
M Μ М Ꮇ
N Ν
O Ο О Օ
P Ρ Р Ꮲ
Q Ԛ
S Ѕ Տ Ꮪ
T Τ Т Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Χ Х
Y Υ Ү
Z Ζ Ꮓ
a а
c с ϲ
d ԁ
e е
f ք
g ɡ ց
h һ հ
i і
j ј ϳ
l ӏ
n ո
o ο о օ
p р ρ
q ԛ զ
s ѕ
u ս
v ν ѵ
w ԝ
x х
y у ү
"""
#: Hyphens that look like the ASCII one.
HYPHENS = "‐‑﹣"
#: Characters that show nothing, besides the categories Cf and variation selectors.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
MARKS = "̧̨̀́̂̃̄̆̇̈̊̋̌"


def seed_pairs() -> Iterator[tuple[str, str]]:
    """The pairs of look-alike strings that the classes grow from; rules wherever there is one."""
    for line in LETTERS.split("\n"):
        first, *rest = line.split() or [""]
        yield from ((first, other) for other in rest)
    yield from (("-", h) for h in HYPHENS)
    for code in range(0x80, 0x30000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or ch in INVISIBLE:
            yield "", ch
        elif kind == "Zs":
            yield " ", ch
        elif form := unicodedata.decomposition(ch):
            tag, _, rest = form.rpartition(">")
            parts = "".join(chr(int(x, 16)) for x in rest.split())
            ligature = tag == "<compat" and 0xFB00 <= code <= 0xFB06
            if tag in ("<wide", "<narrow") and len(parts) == 1 or ligature:
                yield parts.replace("ſ", "s"), ch
            elif not tag and len(parts) <= 2:
                yield parts, ch
    for code in range(0xAC00, 0xD7A4):  # syllables of two and three jamo
        tail = (code - 0xAC00) % 28
        yield (chr(code - tail) + chr(0x11A7 + tail) if tail else unicodedata.normalize("NFD", chr(code))), chr(code)
    for code in range(0xE0100, 0xE01F0):
        yield "", chr(code)


@lru_cache(1)
def classes() -> dict[str, tuple[str, ...]]:
    """Every string of a class, with its class: the closure by union-find.

    Composed letters follow their parts: where a letter has look-alikes, each look-alike with the
    same accent joins the composed letter's class.
    """
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(a: str, b: str) -> None:
        parent[find(b)] = find(a)

    pairs = list(seed_pairs())
    for a, b in pairs:
        union(a, b)
    same: dict[str, list[str]] = defaultdict(list)
    for x in list(parent):
        if len(x) == 1:
            same[find(x)].append(x)
    for parts, ch in pairs:
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            for base, mark in product(same.get(find(parts[0]), [parts[0]]), same.get(find(parts[1]), [parts[1]])):
                union(ch, base + mark)
    groups: dict[str, list[str]] = defaultdict(list)
    for x in list(parent):
        groups[find(x)].append(x)
    return {x: tuple(sorted(g)) for g in groups.values() if len(g) > 1 for x in g}


def _count_batch(arrays: list[pa.Array], long: dict[str, None]) -> Counter:
    """Occurrences of code points, and of the strings of ``long``, in string arrays."""
    got: Counter = Counter()
    plain = [x for x in long if x.isascii()]
    for array in arrays:
        values = array.drop_null().cast(pa.string())
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\n")[0].as_py()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        marked = np.flatnonzero((codes[1:] >= 0x300) & (codes[1:] < 0x370))
        for pair, n in Counter(text[k : k + 2] for k in marked.tolist()).items():
            if pair in long:
                got[pair] += n
        for part in plain:
            got[part] += text.count(part)
        counts = np.bincount(codes)
        hit = np.flatnonzero(counts)
        for code, n in zip(hit.tolist(), counts[hit].tolist()):
            got[chr(code)] += n
    return got


def member_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(member, n)``: how often the corpus holds each string of a look-alike class.

    One pass over all rows; what is shuffled and later collected is bounded by the classes, not by
    the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes()
        long = dict.fromkeys(x for x in table if len(x) > 1)
        total: Counter = Counter()
        for batch in batches:
            total += _count_batch(batch.columns, long)
        rows = [(k, n) for k, n in total.items() if k in table]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["member", "n"])

    return df.select(*columns).mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Every member of a class to its representative: the most frequent member, ties to the least
    string.  Invisible characters always become nothing."""
    table: dict[str, str] = {}
    for group in set(classes().values()):
        best = "" if "" in group else min(group, key=lambda x: (-counts.get(x, 0), len(x), x))
        table.update((x, best) for x in group if x != best and x)
    return table


class Rewriter:
    """Greedy leftmost-longest rewriting of strings by a table of patterns."""

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.table = table
        self.ascii_changes = any(k.isascii() for k in table)
        self.automaton = ahocorasick.Automaton()
        for key, value in table.items():
            self.automaton.add_word(key, (len(key), value))
        self.automaton.make_automaton()
        # every key ends in one of these characters: a text without them stays as it is; characters beyond
        # the basic plane are a class of their own, which keeps the search for the others fast
        near = "".join(re.escape(c) for c in sorted({k[-1] for k in table}) if c <= "\uffff")
        self._near = re.compile(f"[{near}]").search if near else lambda text: None
        self._far = re.compile("[\U00010000-\U0010ffff]").search
        self.known: dict[str, str] = {}

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (size, value) in self.automaton.iter_long(text):
            out += (text[at : end + 1 - size], value)
            at = end + 1
        return "".join(out) + text[at:] if at else text

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii() and not self.ascii_changes or not (self._near(text) or self._far(text)):
            return text
        if (done := self.known.get(text)) is not None:
            return done
        done, last = self._once(text), text
        for _ in range(len(text) + 64):  # each round but the last shortens the text or brings it nearer to representatives
            if done == last:
                break
            done, last = self._once(done), done
        else:
            raise RuntimeError("rewriting found no end")
        if len(text) < 64:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[text] = done
        return done

    def array(self, array: pa.Array) -> pa.Array:
        """A string array rewritten; only strings with other than ASCII characters leave Arrow."""
        if self.ascii_changes:
            return pa.array([self(x) for x in array.to_pylist()], pa.string())
        foreign = pc.fill_null(pc.invert(pc.string_is_ascii(array)), False)
        if not pc.any(foreign).as_py():
            return array
        return pc.replace_with_mask(array, foreign, pa.array([self(x) for x in array.filter(foreign).to_pylist()], pa.string()))


_made: dict[int, tuple[dict, Rewriter]] = {}


def rewriter(table: dict[str, str]) -> Rewriter:
    """One automaton a worker process and table."""
    if (got := _made.get(len(table))) and got[0] == table:
        return got[1]
    _made[len(table)] = (table, Rewriter(table))
    return _made[len(table)][1]


@lru_cache(1)
def default_rewriter() -> Rewriter:
    """One automaton of the default table a process."""
    return Rewriter(default_table())


def learn(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The rewriting table of a corpus; the driver gets only counts of class members."""
    return representatives({r["member"]: r["n"] for r in member_counts(df, columns).collect()})


def default_table() -> dict[str, str]:
    """A table for use without a corpus: Latin letters and composed accents represent."""
    known = {x: 4 - (ord(x) > 127) * 2 for x in classes() if len(x) == 1 and unicodedata.name(x, "").startswith(("LATIN", "SPACE", "HYPHEN-MINUS", "DIGIT"))}
    known |= {x: 3 for x in classes() if x.isascii()}
    return representatives(known)


def canonical(df: DataFrame, columns: list[str], table: dict[str, str] | None = None) -> DataFrame:
    """``df`` with each of ``columns`` (strings) rewritten; other columns, of any name, stay."""
    table = learn(df, columns) if table is None else table

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rw = rewriter(table)
        for batch in batches:
            arrays = [rw.array(a) if n in columns else a for n, a in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return df.mapInArrow(rewrite, df.schema)


def same_looking_pairs(df: DataFrame, key: str, group: str, columns: list[str], table: dict[str, str] | None = None) -> DataFrame:
    """``(key_1, key_2)``, smaller first: rows of one ``group`` that look the same in all ``columns``
    although at least one column differs in its characters.

    Rows meet by a 128-bit hash of their canonical forms; exact copies are never paired, nor compared:
    the different spellings of a form meet first and their rows after them.  Groups in which all rows are
    copies of each other drop out after a map-side combined minimum and maximum, so only groups with real
    variants reach the join.  Null equals null only; a null ``group``
    relates to nothing.
    """
    table = learn(df, columns) if table is None else table
    forms = [f"_c{i}" for i in range(len(columns))]
    seen = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in forms]
    rows = df.select(F.col(key).alias("_id"), F.col(group).alias("_group"), *[F.col(c).alias(f) for c, f in zip(columns, forms)]).where(F.col("_group").isNotNull())
    rows = canonical(spread(rows).withColumn("_raw", F.xxhash64(*seen)), forms, table)
    rows = materialize(rows.select("_id", F.xxhash64(F.lit(7), "_group", *seen).alias("_k1"), F.xxhash64(F.lit(11), *seen, "_group").alias("_k2"), "_raw"), "looks")
    mixed = rows.groupBy("_k1", "_k2").agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi")).where("_lo <> _hi").select("_k1", "_k2")
    left = materialize(rows.join(mixed, ["_k1", "_k2"], "left_semi"), "variants")
    # pairs of different forms first, then the rows that have them: copies never meet each other
    forms = left.select("_k1", "_k2", "_raw").distinct()
    pairs = forms.withColumnRenamed("_raw", "_a").join(forms.withColumnRenamed("_raw", "_b"), ["_k1", "_k2"]).where("_a < _b")
    one = left.select("_k1", "_k2", F.col("_raw").alias("_a"), F.col("_id").alias("_i"))
    two = left.select("_k1", "_k2", F.col("_raw").alias("_b"), F.col("_id").alias("_j"))
    both = pairs.join(one, ["_k1", "_k2", "_a"]).join(two, ["_k1", "_k2", "_b"])
    return both.select(F.least("_i", "_j").alias(f"{key}_1"), F.greatest("_i", "_j").alias(f"{key}_2"))
