"""Quantities recorded in different units, brought to one unit for each kind.

A recorded amount is a number and a notation: what is left of its text, its unit column, and, where
neither names a unit, the unit its question asks for.  Notations are the sources of amounts.  Amounts
of the same entity in different notations are linked.  The ratio of each link snaps to known
conversions; for every pair of notations the scale is the ratio that most links tell, so that unrelated
pairs do no harm, and the offset a median of what is left.  Notations of the common units themselves
anchor the graph of sources; all others get their kind, factor and offset by propagation from them, the
votes of a notation's links pooled over all its neighbours.  Where a notation has too few links, its
words decide.

Null, empty, non-numeric and many-valued texts are no amounts and come out with null ``value``; an
amount whose unit nobody names or links has null ``kind``.  Zero, negative and very large numbers are
amounts as any other.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import materialize

#: Kind, factor to the common unit, and the ways it is written.
UNITS = """
money 1: $, us$, usd, dollar, dollars, us dollar, us dollars, u.s. dollars
money 0.01: cent, cents, us cent, us cents, usd cent, usd cents, ¢
ratio 1: fraction, decimal fraction, ratio
ratio 0.01: %, percent, per cent, pct, percentage, percentage points, pp
ratio 0.001: ‰, per mille, permille, per mill, per thousand
ratio 0.0001: basis point, basis points, bp, bps, ‱
length 1: metre, metres, meter, meters, m
length 1000: kilometre, kilometres, kilometer, kilometers, km
length 0.01: centimetre, centimetres, centimeter, centimeters, cm
length 0.001: millimetre, millimetres, millimeter, millimeters, mm
length 1609.344: mile, miles, mi, statute miles
length 0.9144: yard, yards, yd
length 0.3048: foot, feet, ft, ′
length 0.0254: inch, inches, in, ″
mass 1: kilogram, kilograms, kilogramme, kilogrammes, kilo, kilos, kg, kgs
mass 0.001: gram, grams, gramme, grammes, g
mass 0.000001: milligram, milligrams, mg
mass 1000: tonne, tonnes, metric ton, metric tons, metric tonne, metric tonnes, t
mass 0.45359237: pound, pounds, lb, lbs
mass 0.028349523125: ounce, ounces, oz
time 1: second, seconds, sec, secs, s
time 0.001: millisecond, milliseconds, ms
time 60: minute, minutes, min, mins
time 3600: hour, hours, hr, hrs, h
time 86400: day, days, d
time 604800: week, weeks
area 1: square metre, square metres, square meter, square meters, sq m, m², m2, m^2, sqm
area 1000000: square kilometre, square kilometres, square kilometer, square kilometers, sq km, km², km2, km^2
area 10000: hectare, hectares, ha
area 4046.8564224: acre, acres, ac
area 2589988.110336: square mile, square miles, sq mi, mi², mi2, mi^2
area 0.09290304: square foot, square feet, sq ft, ft², ft2
persons 1: person, persons, people, inhabitant, inhabitants, resident, residents, count, units, unit
"""
#: Scales.  Those of one letter, and mm, count as scales beside a currency only.
SCALES = """
1000: thousand, thousands, k, 000, 000s
1000000: million, millions, mn, mln, mio, m, mm
1000000000: billion, billions, bn, bln, b
1000000000000: trillion, trillions, tn
"""
FILLERS = frozenset("a an and as at in of the number about around approximately approx ca total".split())
#: Known affine conversions between sources that share no zero: scale and offset.
AFFINE = ((1.8, 32.0), (1 / 1.8, -32.0 / 1.8), (1.0, 273.15), (1.0, -273.15))
BIN = 0.0015
MIN_LINKS, MIN_SHARE, MIN_LINE = 3, 0.3, 20

_number = r"\d{1,3}(?:[ ,]\d{3})+(?![\d])(?:\.\d+)?|\d+(?:\.\d+)?(?:e[+-]?\d+)?|\.\d+"
_find_number = re.compile(_number)
_scale_mark = re.compile(r"\(\s*'?000'?s?\s*\)|(?<![\d.,])(?<!\d[ ,.])'?000'?s?(?![\d])")
_clock = re.compile(r"(-?)(\d+):([0-5]?\d):([0-5]?\d(?:\.\d+)?)")
_parts = re.compile(rf"({_number})\s*([^\d\s.,:()-]+)\s*,?\s*(?:and\s+)?")
_words = re.compile(r"u\.s\.|us\$|[$¢%‰‱′″]|[^\W\d_]+(?:[²2](?!\w)|\^2)?|\S")
_asked = re.compile(r"(?<![\w])(?=((?:in|as|per)\s[^?()\d]*?)\)?\s*\??\s*$)")


@lru_cache(1)
def lexicon() -> tuple[dict[tuple[str, ...], tuple[str, float]], dict[str, float]]:
    """Known units by their words, and known scales."""
    units = {}
    for line in UNITS.strip().split("\n"):
        head, _, names = line.partition(": ")
        kind, factor = head.split()
        for name in names.split(", "):
            units[tuple(_words.findall(name))] = kind, float(factor)
    scales = {}
    for line in SCALES.strip().split("\n"):
        head, _, names = line.partition(": ")
        scales |= dict.fromkeys(names.split(", "), float(head))
    return units, scales


@lru_cache(1)
def known_ratios() -> list[float]:
    """Logarithms of the ratios between known conversions of a kind, with scales."""
    by_kind: dict[str, set[float]] = {}
    for kind, factor in lexicon()[0].values():
        by_kind.setdefault(kind, set()).add(factor)
    scales = {1.0, *lexicon()[1].values()}
    whole = {a * s for s in scales for a in scales for s in (1 / a, a)} | scales
    return sorted({round(math.log(a / b * s), 9) for fs in by_kind.values() for a in fs for b in fs for s in whole})


@lru_cache(50_000)
def read_notation(text: str) -> tuple[tuple[str, float] | None, float | None, str]:
    """The unit, the scale and the unknown words of a notation; what is named twice counts once."""
    units, scales = lexicon()
    words = _words.findall(text.replace("(s)", "s"))
    unit, scale, unknown, short = None, None, [], []
    i = 0
    while i < len(words):
        for size in (3, 2, 1):
            part = tuple(words[i : i + size])
            if len(part) == size and part in units and not (part == ("in",)):
                if len(part) == 1 and part[0] in scales:
                    short.append(part[0])  # m, mm: a unit or a scale
                else:
                    unit = unit or units[part]
                i += size
                break
        else:
            word = words[i]
            if word in scales:
                if len(word) == 1 and word != "k":
                    short.append(word)
                else:
                    scale = scale or scales[word]
            elif word not in FILLERS and (word.isalnum() or ord(word[0]) > 127):
                unknown.append(word)
            i += 1
    for word in short:
        if unit and unit[0] == "money":
            scale = scale or scales[word]
        elif unit is None and (word,) in units:
            unit = units[(word,)]
        elif unit is None and scale is None:
            scale = scales[word]
    return unit, scale, " ".join(unknown)


def _clean(text: str) -> str:
    text = re.sub(r"[  -   　]", " ", text.casefold())
    return re.sub(r"[−‐‑‒﹣－]", "-", text).replace("’", "'").strip()


def split_amount(text: str) -> tuple[float, str] | None:
    """The number of a text and the notation around it; None for texts that hold no single amount."""
    x = _clean(text)
    if m := _clock.fullmatch(x):
        value = int(m[2]) * 3600 + int(m[3]) * 60 + float(m[4])
        return (-value if m[1] else value), "seconds"
    marked = re.sub(r"(?<=\d)\s*'(?!\s*0{3})", "′ ", x).replace("′ ′", "″").replace('"', "″")
    parts = _parts.findall(marked)
    if len(parts) > 1 and not _parts.sub("", marked).strip("-() "):
        known = [lexicon()[0].get((u,), ("", 0.0)) for _, u in parts]
        kind = known[0][0]
        if kind in ("time", "length", "mass") and all(k == kind for k, _ in known):
            total = sum(float(re.sub("[ ,]", "", n)) * f for (n, _), (_, f) in zip(parts, known))
            return (-total if marked[:1] in "-(" else total), {"time": "seconds", "length": "metres", "mass": "kilograms"}[kind]
    x = _scale_mark.sub(" thousand ", x)
    numbers = [m for m in _find_number.finditer(x) if not (m[0] == "2" and re.search(r"[a-z^]$", x[: m.start()]))]
    if len(numbers) != 1:
        return None
    (m,) = numbers
    value = float(re.sub("[ ,]", "", m[0]))
    before, after = x[: m.start()], x[m.end() :]
    if before.rstrip().endswith("(") and after.lstrip().startswith(")"):
        before, after, value = before.rstrip()[:-1], after.lstrip()[1:], -value
    if "-" in before:
        if re.search(r"-\s*(?:us\$|usd|\$|¢)?\s*$", before.replace("(", "")):
            value = -value
        before = before.replace("-", " ")
    if before.count("(") != before.count(")") or "(" in before:
        before = before.replace("(", " ").replace(")", " ")
    return value, " ".join(f"{before} {after}".split())


def single(text: str | None) -> str | None:
    """The one scalar of a JSON text (a list or object with one value is unwrapped), else the text."""
    if text is None:
        return None
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        return text
    while isinstance(x, (list, dict)):
        if len(x) != 1 and not (isinstance(x, dict) and "value" in x):
            return None
        x = x.get("value", next(iter(x.values()))) if isinstance(x, dict) else x[0]
    if x is None or isinstance(x, bool):
        return None
    return x if isinstance(x, str) else repr(x)


@lru_cache(50_000)
def asked_unit(question: str | None) -> str:
    """The phrase at the end of a question that asks for a unit, if all of it is known."""
    x = _clean(question or "").rstrip("? )") + "?"
    for m in _asked.finditer(x):
        unit, _, unknown = read_notation(m[1])
        if unit and not unknown:
            return m[1].strip()
    return ""


def read_amount(text: str | None, unit: str | None, question: str | None) -> tuple[float, str, str | None, float | None] | None:
    """``value, notation, kind, factor`` of a recorded amount; kind and factor are None while unknown."""
    one = single(text)
    got = split_amount(one) if one else None
    if got is None or not math.isfinite(got[0]):
        return None
    value, around = got
    column = " ".join(_scale_mark.sub(" thousand ", _clean(unit or "")).split())
    found, scale, _ = read_notation(f"{around} ; {column}")
    asked = ""
    if found is None:
        asked = asked_unit(question)
        if asked:
            found, asked_scale, _ = read_notation(asked)
            scale = scale or asked_scale
        elif scale:
            found = ("persons", 1.0)  # a bare count in thousands or millions
    notation = "|".join((around, column, asked))
    if found is None or read_notation(around)[2]:
        return value, notation, None, None
    return value, notation, found[0], found[1] * (scale or 1.0)


def amounts(df: DataFrame, keys: list[str], text: Column, unit: Column, question: Column) -> DataFrame:
    """``keys, value, notation, kind, factor`` of the rows that record an amount."""
    source = df.select(*keys, text.cast("string").alias("_text"), unit.cast("string").alias("_unit"), question.cast("string").alias("_question")).where("_text is not null")
    kinds = [source.schema[k] for k in keys]
    ddl = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds) + ", value double, notation string, kind string, factor double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_amount(*row) for row in zip(*(batch.column(n).to_pylist() for n in ("_text", "_unit", "_question")))]
            at = pa.array([i for i, g in enumerate(got) if g], pa.int64())
            rows = [g for g in got if g]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], [*keys, "value", "notation", "kind", "factor"])

    return source.mapInArrow(run, ddl)


def pairwise(links: DataFrame) -> DataFrame:
    """For links ``(a, x, b, y)`` of one quantity as ``x`` in notation ``a`` and ``y`` in ``b``: the
    scale of each pair of notations, its support, its snapped value and the offset left over."""
    use = links.where("a <> b and x <> 0 and y <> 0 and sign(x) = sign(y)")
    bins = use.withColumn("_bin", F.round(F.log(F.abs(F.col("y") / F.col("x"))) / BIN).cast("long"))
    counts = bins.groupBy("a", "b", "_bin").agg(F.count("*").alias("n"), F.avg(F.log(F.abs(F.col("y") / F.col("x")))).alias("_log"))
    pair = Window.partitionBy("a", "b")
    best = counts.withColumn("n_links", F.sum("n").over(pair)).withColumn("_rank", F.row_number().over(pair.orderBy(F.desc("n"), "_bin")))
    best = best.where("_rank = 1").select("a", "b", "n_links", F.col("n").alias("n_equal"), F.col("_log").alias("log_scale"))
    quart = use.groupBy("a", "b").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75]).alias(f"_{c}") for c in ("x", "y")])
    slope = (F.col("_y")[2] - F.col("_y")[0]) / F.nullif(F.col("_x")[2] - F.col("_x")[0], F.lit(0.0))
    best = best.join(quart, ["a", "b"]).withColumn("line_scale", slope).withColumn("line_offset", F.col("_y")[1] - F.col("line_scale") * F.col("_x")[1]).drop("_x", "_y")
    # the nearest known ratio stands in the same cell of a grid or in a neighbouring one
    cell = 4 * BIN
    known = links.sparkSession.createDataFrame([(math.floor(v / cell) + d, v) for v in known_ratios() for d in (-1, 0, 1)], "_cell long, _v double")
    best = best.withColumn("_cell", F.floor(F.col("log_scale") / cell)).join(F.broadcast(known), "_cell", "left")
    keep = [c for c in best.columns if c not in ("_cell", "_v")]
    best = best.groupBy(*keep).agg(F.min_by("_v", F.abs(F.col("_v") - F.col("log_scale"))).alias("_v"))
    best = best.withColumn("snapped", F.when(F.abs(F.col("_v") - F.col("log_scale")) < 2 * BIN, F.exp("_v"))).drop("_v")
    offset, scale = _affine(F.col("line_scale"), F.col("line_offset"), (F.col("n_equal") < MIN_SHARE * F.col("n_links")) & (F.col("n_links") >= MIN_LINE))
    return best.withColumn("known_offset", offset).withColumn("known_scale", scale)


def _affine(scale: Column, offset: Column, held: Column) -> tuple[Column, Column]:
    """The offset and scale of the known affine conversion that a line is near, 0 and null for none."""
    known_offset, known_scale = F.lit(0.0), F.lit(None).cast("double")
    for s, o in AFFINE:
        fits = held & (F.abs(scale - s) < 0.02 * s) & (F.abs(offset - o) < 0.02 * abs(o))
        known_offset, known_scale = F.when(fits, o).otherwise(known_offset), F.when(fits, s).otherwise(known_scale)
    return known_offset, known_scale


def lines(links: DataFrame) -> DataFrame:
    """``(a, b, known_scale, known_offset)`` of the pairs of notations whose quartiles lie on a line of a known affine
    conversion; one aggregate over all links."""
    use = links.where("a <> b and x <> 0 and y <> 0 and sign(x) = sign(y)")
    quart = use.groupBy("a", "b").agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75]).alias(f"_{c}") for c in ("x", "y")]).where(F.col("n") >= MIN_LINE)
    slope = (F.col("_y")[2] - F.col("_y")[0]) / F.nullif(F.col("_x")[2] - F.col("_x")[0], F.lit(0.0))
    offset, scale = _affine(slope, F.col("_y")[1] - slope * F.col("_x")[1], F.lit(True))
    return quart.select("a", "b", scale.alias("known_scale"), offset.alias("known_offset")).where("known_offset <> 0")


def snapped_votes(links: DataFrame) -> DataFrame:
    """``(a, b, s, n)``: for links ``(a, x, b, y)`` in both directions, how many say that an amount in ``b``
    is ``exp(s)`` times the same amount in ``a``, ``s`` being the known ratio nearest to theirs.

    Links whose ratio is near no known one, of unlike signs or with a zero say nothing."""
    cell = 4 * BIN
    cells: dict[int, list[float]] = {}
    for v in known_ratios():
        for d in (-1, 0, 1):
            cells.setdefault(math.floor(v / cell) + d, []).append(v)
    known = links.sparkSession.createDataFrame(sorted(cells.items()), "_cell long, _vs array<double>")
    use = links.where("a <> b and x <> 0 and y <> 0 and sign(x) = sign(y)").select("a", "b", F.log(F.abs(F.col("y") / F.col("x"))).alias("_log"))
    near = use.withColumn("_cell", F.floor(F.col("_log") / cell)).join(F.broadcast(known), "_cell")
    near = near.withColumn("_best", F.array_min(F.transform("_vs", lambda v: F.struct(F.abs(v - F.col("_log")).alias("d"), v.alias("v")))))
    counts = near.where(F.col("_best.d") < BIN).groupBy("a", "b", F.col("_best.v").alias("s")).agg(F.count("*").alias("n"))
    return counts.select(F.inline(F.array(F.struct("a", "b", "s", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("s")).alias("s"), "n")))).groupBy("a", "b", "s").agg(F.sum("n").alias("n"))


def proposals(votes: DataFrame, known: DataFrame) -> DataFrame:
    """``(notation, kind, factor, n, second)``: for every notation the conversion that most of its links to
    ``known`` notations (``notation, kind, factor``) tell, pooled over all of them and snapped to the known
    conversions of the kind, with the votes of the runner-up; ties go to the least kind and factor."""
    of_kind: dict[str, set[float]] = {}
    for kind, factor in lexicon()[0].values():
        of_kind.setdefault(kind, set()).update(factor * s for s in (1.0, *lexicon()[1].values()))
    facts = votes.sparkSession.createDataFrame([(k, sorted(fs)) for k, fs in of_kind.items()], "kind string, _fs array<double>")
    told = votes.join(known.select(F.col("notation").alias("b"), "kind", "factor"), "b").join(F.broadcast(facts), "kind")
    near = F.array_min(F.transform("_fs", lambda f: F.struct(F.abs(F.log(f) - F.log("factor") - F.col("s")).alias("d"), f.alias("f"))))
    told = told.withColumn("_x", near).where(F.col("_x.d") < BIN).groupBy("a", "kind", F.col("_x.f").alias("factor")).agg(F.sum("n").alias("n"))
    # a notation has at most as many proposals as there are known conversions
    ranked = told.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "factor"))).alias("_r"))
    best, rest = F.col("_r")[0], F.get("_r", F.lit(1))
    return ranked.select(F.col("a").alias("notation"), best["kind"].alias("kind"), best["factor"].alias("factor"), (-best["m"]).alias("n"), F.coalesce(-rest["m"], F.lit(0)).alias("second"))


def supported(found: DataFrame) -> DataFrame:
    """Proposals with enough links, and twice as many as the runner-up."""
    return found.where((F.col("n") >= MIN_LINKS) & (F.col("n") >= 2 * F.col("second")))


def propagate(anchors: DataFrame, votes: DataFrame, affine: DataFrame | None = None) -> DataFrame:
    """``(notation, kind, factor, offset, hops)``: anchors, and all notations reached over links, so that
    an amount times ``factor`` plus ``offset`` is in the unit of the anchors.

    ``affine`` are pairs ``a, b, known_scale, known_offset`` of notations that share no zero.  In each
    round all notations still open take the best supported proposal of their links to reached ones, until
    none is reached any more.  An amount with no words at all has no unit and gets none."""
    reached = materialize(anchors.where("notation <> '||'").select("notation", "kind", F.col("factor").cast("double"), F.lit(0.0).alias("offset"), F.lit(0).alias("hops")), "reached")
    if affine is not None:
        affine = affine.select(F.inline(F.array(F.struct("a", "b", F.col("known_scale").alias("s"), F.col("known_offset").alias("o")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (1 / F.col("known_scale")).alias("s"), (-F.col("known_offset") / F.col("known_scale")).alias("o")))))
        affine = materialize(affine, "lines")
        affine = None if affine.isEmpty() else affine
    for hop in itertools.count(1):
        new = supported(proposals(votes.where("a <> '||'").join(reached, votes["a"] == reached["notation"], "left_anti"), reached.where("offset = 0"))).select("notation", "kind", "factor", F.lit(0.0).alias("offset"))
        if affine is not None:
            over = affine.join(reached, affine["b"] == reached["notation"]).select(F.col("a").alias("notation"), "kind", (F.col("factor") * F.col("s")).alias("factor"), (F.col("factor") * F.col("o") + F.col("offset")).alias("offset"))
            over = over.join(reached, "notation", "left_anti").groupBy("notation").agg(F.min(F.struct("kind", "factor", "offset")).alias("_x")).select("notation", "_x.*")
            new = new.unionByName(over.join(new, "notation", "left_anti"))
        new = materialize(new.withColumn("hops", F.lit(hop)), "new")
        if new.isEmpty():
            return reached
        reached = materialize(reached.unionByName(new), "reached")


def by_words(recorded: DataFrame) -> DataFrame:
    """``(notation, kind, factor)`` of the notations whose words are all known."""
    return recorded.where("kind is not null").groupBy("notation").agg(F.min(F.struct("kind", "factor")).alias("_x")).select("notation", "_x.kind", "_x.factor")


def common_units(recorded: DataFrame, links: DataFrame) -> DataFrame:
    """``(notation, kind, factor, offset, hops)`` of the notations of ``recorded`` amounts.

    Notations that name the common unit of a kind itself are the anchors (0 hops).  All others are reached
    over links; those with too few links keep what their words say (null hops)."""
    words = materialize(by_words(recorded), "words")
    reached = propagate(words.where("factor = 1"), materialize(snapped_votes(links), "votes"), lines(links))
    rest = words.join(reached, "notation", "left_anti").select("notation", "kind", "factor", F.lit(0.0).alias("offset"), F.lit(None).cast("int").alias("hops"))
    return reached.unionByName(rest)


def recovered(recorded: DataFrame, links: DataFrame) -> DataFrame:
    """Every notation of known words hidden in turn: ``notation, kind, factor`` by its words beside
    ``kind_told, factor_told`` by its links to all others, the links that tell it, and ``supported``."""
    words = materialize(by_words(recorded), "words")
    told = proposals(snapped_votes(links), words).select("notation", F.col("kind").alias("kind_told"), F.col("factor").alias("factor_told"), "n", "second")
    both = words.join(told, "notation", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.withColumn("supported", (F.col("n") >= MIN_LINKS) & (F.col("n") >= 2 * F.col("second")))
