"""Problem 3: quantities recorded in different units, in common ones.

A number is read in whatever style it is written (grouped thousands, decimal comma, powers of ten, words), a range
gives both ends, and the unit is the one that follows it or that a table column or a list announces. Values are exact
(fractions, not floating point).

Numbers that are measured but have no unit are assigned one. What is measured is learnt: the words around explicit
quantities (before and after them, above their column or list) are counted for each kind of measure over all passages,
and a bare number is of the kind that its own words make most probable (naive Bayes, the VOCABULARY most frequent words
and the kinds' own names), or of none. For each kind a mixture on the logarithmic scale is fitted whose components are
one distribution shifted by the known conversion factors of the kind's units; the explicit quantities give its shape,
the bare numbers its weights. The unit with the highest posterior is taken. It is flagged where that is below CERTAIN,
or where less than CERTAIN of the explicit quantities that are written with about this value have that unit, so that
the flag does not rest on the mixture's own assumption. `masked` measures both on explicit quantities whose units are
hidden. Only histograms by kind, unit and bin reach the driver: their size depends on the bins and not on the
collection.

Defined results: null texts and ids take part in nothing; a passage delivered twice counts once in found; a value that
is not whole in thousandths of the common unit is rounded half to even; an alias without common unit is no unit; an
alias that two rows give different units for is a fatal error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.lookalikes import readable
from brindle.session import spread, written

# How many of its dimension's common unit a unit is.
PER_COMMON = {
    "nm": "1/1000", "um": "1", "mm": "1000", "cm": "10000", "m": "1000000",
    "mcg": "1/1000", "mg": "1", "g": "1000", "kg": "1000000",
    "uL": "1/1000", "mL": "1", "dL": "100", "L": "1000",
    "hour": "1", "day": "24", "week": "168",
    "mcg/kg": "1/1000", "mg/kg": "1", "g/kg": "1000",
    "mcg/L": "1/1000", "mg/L": "1", "g/L": "1000", "mg/dL": "10", "mcg/mL": "1",
    "mmHg": "1", "percent": "1",
}
# Numbers from two to twenty in words.
NUMBER_WORDS = {
    **{w: i + 2 for i, w in enumerate("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())},
    **{w: i + 2 for i, w in enumerate("zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig".split())},
    **{w: i + 2 for i, w in enumerate("deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt".split())},
    **{w: i + 2 for i, w in enumerate("dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte".split())},
}
MAX_ALIASES = 10_000
CERTAIN = 0.9
BIN = 0.1
#: Words around explicit quantities from which kinds are learnt: the most frequent ones, seen so often at least.
VOCABULARY, LEAST_SEEN = 20_000, 5
#: Posterior from which a bare number is taken to be of a kind.
KIND_CERTAIN = 0.8
CONTEXT_WORD = re.compile(r"[^\W\d_]{2,}")

NUMBER = r"(?:\d{1,3}(?:[ ,]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d+)?)(?:[eE][+-]?\d{1,3}(?!\d)| ?[×x] ?10(?:\^[+-]?\d{1,3}|[⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))?"
JOIN = r"(?: ?[–—-] ?| (?i:to|and|or|bis|und|à|et|a|y|hasta) )"
SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")


def value_of(number: str) -> Fraction:
    """A point is decimal; a comma or blank before exactly three digits groups thousands, any other comma is decimal."""
    word = NUMBER_WORDS.get(number.lower())
    if word is not None:
        return Fraction(word)
    m = re.match(r"([\d., ]*\d)(?:[eE]([+-]?\d+)| ?[×x] ?10(?:\^([+-]?\d+)|(\S+)))?$", number)
    digits = re.sub(r"(?<=\d)[ ,](?=\d{3}(?!\d))", "", m[1]).replace(",", ".")
    power = m[2] or m[3] or (m[4] or "0").translate(SUPER)
    return Fraction(digits) * Fraction(10) ** int(power)


class Reader:
    """Reads the quantities of a text; compiled once from the aliases."""

    def __init__(self, rows: list[tuple[str, str, str | None, str | None]], context: bool = False):
        self.context = context  # whether the words around explicit quantities are given too
        self.units: dict[str, tuple[str, str, str]] = {}
        counted = set()
        for alias, unit, dimension, common in rows:
            a = readable(alias)
            if common is None:
                counted.add(a)
                continue
            if unit not in PER_COMMON:
                raise ValueError(f"no conversion is known for the unit {unit!r}")
            if self.units.setdefault(a, (unit, dimension, common)) != (unit, dimension, common):
                raise ValueError(f"the alias {alias!r} stands for two units")
        # names of four letters and more are read in any case, symbols as they are
        self.names = {a.lower(): u for a, u in self.units.items() if len(a) > 3 and a.replace(" ", "").isalpha()}
        every = sorted({*self.units, *counted, *(a for a in self.names)}, key=len, reverse=True)
        symbols = "|".join(re.escape(a).replace(r"\ ", r"\s+") for a in every if a.lower() not in self.names)
        names = "|".join(re.escape(a).replace(r"\ ", r"\s+") for a in sorted(self.names, key=len, reverse=True))
        unit = "(?:" + "|".join(x for x in (f"(?i:{names})" if names else "", symbols) if x) + r")(?![\w/^]|['’]\w|-\w*\d)" if every else r"(?!)"
        words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
        number = rf"(?:{NUMBER}|(?i:\b(?:{words})\b))"
        self.quantity = re.compile(rf"(?<![\w.,^/])(?P<a>{number})(?:{JOIN}(?:[<>~≥≤] ?)?(?P<b>{number}))?(?P<u>\s?-?\s?(?P<unit>{unit}))?")
        self.bare = re.compile(rf"^\W*?(?P<a>{number})(?:{JOIN}(?P<b>{number}))?\W*$")
        self.header = re.compile(rf"[(\[]\s*(?P<p>{unit})\s*[)\]]\s*$|\b(?i:in)\s+(?P<i>{unit})\s*$")
        self.announced = re.compile(rf"\b(?i:are|is|given|values?|all)\b[^.:\n]*\b(?i:in)\s+(?P<i>{unit})\s*[.:]?\s*$")
        self.maybe = re.compile(rf"\d|(?i:\b(?:{words})\b)")

    def unit(self, alias: str) -> tuple[str, str, str] | None:
        a = re.sub(r"\s+", " ", alias)
        return self.units.get(a) or self.names.get(a.lower())

    def read(self, text: str) -> list[tuple[Fraction, tuple[str, str, str] | None, str, str]]:
        """(value as written, unit, where the unit stands, words before, words after and column heading
        or line above a list, a line each) of every number."""
        t = readable(text)
        if not self.maybe.search(t):
            return []
        out: list = []
        columns: list | None = None
        heads: list[str] = []
        listed, lead = None, ""
        for line in t.split("\n"):
            bar = line.strip()
            if bar.startswith("|") and bar.count("|") > 1:
                cells = [c.strip() for c in bar.strip("|").split("|")]
                if columns is None:
                    heads = cells
                    columns = [self._of(self.header.search(c)) for c in cells]
                    if any(columns):
                        continue
                for k, c in enumerate(cells):
                    m = self.bare.match(c)
                    if m and not set(c) <= set("-: "):
                        u = columns[k] if k < len(columns) else None
                        head = heads[k] if k < len(heads) and cells is not heads else ""
                        near = f"\n\n{head}" if self.context or not u else ""
                        out += [(value_of(m[g]), u, "column" if u else "none", near) for g in "ab" if m[g]]
                    else:
                        self._inline(c, out)
                continue
            columns = None
            if not bar:
                listed, lead = None, ""
                continue
            if listed and re.match(r"[-*•·]\s|\d+[.)]\s", bar):
                m = self.bare.match(bar.rsplit(":", 1)[1]) if ":" in bar else None
                if m:
                    out += [(value_of(m[g]), listed, "list", f"{bar.rsplit(':', 1)[0]}\n\n{lead}" if self.context else "") for g in "ab" if m[g]]
                    continue
            m = self.announced.search(bar)
            if m:
                listed = self._of(m)
            elif not re.match(r"[-*•·]\s|\d+[.)]\s", bar):
                listed = None
            item = re.match(r"[-*•·]\s|\d+[.)]\s", bar)
            self._inline(line, out, lead if item else "")
            lead = lead if item else bar[-60:]
        return out

    def _of(self, m: re.Match | None) -> tuple[str, str, str] | None:
        return None if m is None else self.unit(next(x for x in m.groupdict().values() if x))

    def _inline(self, line: str, out: list, lead: str = "") -> None:
        last = 0  # a number's words end at the numbers next to it
        for m in self.quantity.finditer(line):
            u = self.unit(m["unit"]) if m["u"] else None
            if m["u"] and u is None:
                continue  # a counted thing
            if u is None and not m["a"][0].isdigit():
                continue
            some = self.context or u is None
            near = line[max(last, m.start() - 60) : m.start()] if some else ""
            after = re.split(r"\d", line[m.end() : m.end() + 30], maxsplit=1)[0] if some else ""
            last = m.end()
            out += [(value_of(m[g]), u, "follows" if u else "none", f"{near}\n{after}\n{lead}") for g in "ab" if m[g]]


def _aliases(units: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    rows = units.select("alias", "unit", "dimension", "common_unit").where("alias IS NOT NULL AND alias <> ''").distinct().limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases; they are held in every task")
    return [tuple(r) for r in sorted(rows, key=str)]


def _double(value: Fraction) -> float:
    """Infinite beyond the range of a double."""
    try:
        return float(value)
    except OverflowError:
        return float("inf")


FIELDS = "passage_id string, source_id string, kind string, unit string, common_unit string, where string, value double, value_milli long, whole boolean, too_large boolean"


def quantities(passages: DataFrame, units: DataFrame, context: bool = False) -> DataFrame:
    """(passage_id, source_id, kind, unit, common_unit, where, value, value_milli, whole, too_large): a row for each number.

    kind is the unit's dimension, null for a bare number; value is as written, value_milli in thousandths of the common
    unit; whole tells whether that needed no rounding. With context also the different words around the number."""
    aliases = _aliases(units)
    held = passages.sparkSession.sparkContext.broadcast(aliases)
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["words"] * context
    kinds = (pa.string(),) * 6 + (pa.float64(), pa.int64(), pa.bool_(), pa.bool_()) + (pa.list_(pa.string()),) * context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value, context)
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for pid, sid, text in zip(*(c.to_pylist() for c in b.columns)):
                for value, unit, where, near in reader.read(text):
                    if unit:
                        x = value * Fraction(PER_COMMON[unit[0]]) * 1000
                        large = abs(round(x)) >= 1 << 63
                        row = [pid, sid, unit[1], unit[0], unit[2], where, _double(value), None if large else round(x), x.denominator == 1, large]
                    else:
                        row = [pid, sid, None, None, None, where, _double(value), None, None, False]
                    if context:
                        row.append(sorted(set(CONTEXT_WORD.findall(near.lower()))))
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    src = passages.select(F.col("passage_id").cast("string"), F.col("source_id").cast("string"), F.col("text")).where("passage_id IS NOT NULL AND text IS NOT NULL")
    return spread(src).mapInArrow(run, FIELDS + ", words array<string>" * context)


def found(passages: DataFrame, units: DataFrame) -> DataFrame:
    return quantities(passages, units).where("unit IS NOT NULL").select("passage_id", "common_unit", "value_milli").distinct()


def fit_mixture(explicit: dict[str, np.ndarray], bare: np.ndarray, shift: dict[str, float], rounds: int = 50) -> dict[str, np.ndarray]:
    """Posterior of each unit in each bin of the logarithm of a bare number.

    explicit: histogram of log10 values as written for each unit; their common shape is the mean of the histograms,
    each shifted into the common unit. A component is that shape shifted back by the unit's factor; the weights are
    fitted to the bare numbers by expectation and maximisation, starting from the units' explicit shares."""
    units = sorted(explicit)
    n = len(bare)
    shape = np.zeros(3 * n)
    for u in units:
        by = round(shift[u] / BIN)
        idx = np.arange(n) + n + by
        ok = (idx >= 0) & (idx < 3 * n)
        shape[idx[ok]] += explicit[u][ok]
    kernel = np.exp(-0.5 * (np.arange(-15, 16) / 5) ** 2)
    shape = np.convolve(shape, kernel / kernel.sum(), "same") + 1e-6
    comp = []
    for u in units:
        c = shape[np.clip(np.arange(n) + n + round(shift[u] / BIN), 0, 3 * n - 1)]
        comp.append(c / c.sum())
    comp_ = np.array(comp)
    w = np.array([explicit[u].sum() + 1.0 for u in units])
    w /= w.sum()
    prior = w.copy()
    for _ in range(rounds):
        post = w[:, None] * comp_
        post /= post.sum(axis=0)
        w = (post * bare).sum(axis=1) + prior * 5
        w /= w.sum()
    post = w[:, None] * comp_
    post /= post.sum(axis=0)
    return dict(zip(units, post))


def learn_kinds(q: DataFrame) -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """The kinds, the logarithm of each word's share of a kind's quantities, and of each kind's share of all."""
    explicit = q.where("unit IS NOT NULL")
    total = {r.kind: r.n for r in explicit.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kinds = sorted(total)
    counts = explicit.select("kind", F.explode("words").alias("word")).groupBy("word").pivot("kind", kinds).count() if kinds else None
    if counts is None:
        return [], {}, np.empty(0)
    seen = counts.fillna(0).withColumn("_n", sum((F.col(f"`{k}`") for k in kinds), F.lit(0)))
    rows = seen.where(F.col("_n") >= LEAST_SEEN).orderBy(F.desc("_n"), "word").limit(VOCABULARY).collect()
    n = np.array([total[k] for k in kinds], np.float64)
    words = {r.word: np.log((np.array([r[k] for k in kinds]) + 0.5) / (n + 1)) for r in rows}
    for i, kind in enumerate(kinds):
        for name in (kind, f"{kind}s"):  # the name of a kind tells it, whether or not explicit quantities stand by it
            known = words.get(name, np.log(0.5 / (n + 1))).copy()
            known[i] = max(known[i], np.log(0.5))
            words[name] = known
    return kinds, words, np.log(n / n.sum())


def with_kinds(q: DataFrame) -> DataFrame:
    """q with a kind for bare numbers whose words tell one with a posterior of KIND_CERTAIN."""
    kinds, words, prior = learn_kinds(q)
    held = q.sparkSession.sparkContext.broadcast((kinds, words, prior))

    @F.arrow_udf("string")
    def kind_of(a: pa.Array) -> pa.Array:
        kinds, words, prior = held.value
        out = []
        for some in a.to_pylist():
            known = [words[w] for w in some or () if w in words]
            if not known:
                out.append(None)
                continue
            p = prior + np.sum(known, axis=0)
            p = np.exp(p - p.max())
            out.append(kinds[int(p.argmax())] if p.max() / p.sum() >= KIND_CERTAIN else None)
        return pa.array(out, pa.string())

    bare = q.where("unit IS NULL")
    return q.where("unit IS NOT NULL").unionByName(bare.withColumn("kind", kind_of("words")))


def infer(q: DataFrame, *keep: str) -> DataFrame:
    """passage_id, source_id, kind, value, unit, common_unit, value_milli, posterior, uncertain, and the columns to keep:
    the bare numbers of q, which are quantities with context, with the unit that the mixture gives them."""
    lo, bins = -8.0, 200
    q = written(with_kinds(q.where("NOT too_large")))
    q = q.withColumn("bin", F.least(F.greatest(F.floor((F.log10("value") - lo) / BIN), F.lit(0)), F.lit(bins - 1)).cast("int"))
    hist = q.where("kind IS NOT NULL AND value > 0 AND (unit IS NOT NULL OR value < 1e12)").groupBy("kind", "unit", "common_unit", "bin").agg(F.count("*").alias("n")).collect()
    common = {r.kind: r.common_unit for r in hist if r.common_unit}
    rows = []
    for kind in sorted({r.kind for r in hist}):
        explicit: dict[str, np.ndarray] = {}
        bare = np.zeros(bins)
        for r in hist:
            if r.kind == kind:
                (bare if r.unit is None else explicit.setdefault(r.unit, np.zeros(bins)))[r.bin] += r.n
        if not explicit or not bare.any():
            continue
        post = fit_mixture(explicit, bare, {u: float(np.log10(float(Fraction(PER_COMMON[u])))) for u in explicit})
        names = sorted(post)
        p = np.array([post[u] for u in names])
        near = np.array([np.convolve(explicit[u], np.ones(5), "same") for u in names])
        share = near / (near.sum(axis=0) + 1)  # of the explicit quantities that are written with about this value
        for k in np.flatnonzero(bare).tolist():
            best = int(p[:, k].argmax())
            u = names[best]
            rows.append((kind, k, u, common[kind], float(p[best, k]), float(share[best, k]), float(Fraction(PER_COMMON[u]))))
    table = q.sparkSession.createDataFrame(rows, "kind string, bin int, unit string, common_unit string, posterior double, agreement double, factor double")
    bare_rows = q.where("unit IS NULL").select("passage_id", "source_id", "kind", "value", "bin", *keep)
    fits = F.when((F.col("value") > 0) & (F.col("value") < 1e12), F.col("bin"))  # others are in no bin
    out = bare_rows.withColumn("bin", fits).join(F.broadcast(table), ["kind", "bin"], "left")  # at most kinds x bins rows
    milli = F.round(F.col("value") * F.col("factor") * 1000)
    return out.select(
        "passage_id", "source_id", "kind", "value", "unit", "common_unit", F.when(milli < 2.0**63, milli).cast("long").alias("value_milli"),
        "posterior", F.coalesce(F.least("posterior", "agreement") < CERTAIN, F.lit(True)).alias("uncertain"), *keep,
    )


def infer_units(passages: DataFrame, units: DataFrame) -> DataFrame:
    """passage_id, source_id, kind, value, unit, common_unit, value_milli, posterior, uncertain: bare numbers with
    the unit that the mixture gives them. One of unknown kind, of a kind without explicit quantities, of 0 or from 10^12 on
    is in no mixture: it has no unit and is uncertain."""
    return infer(written(quantities(passages, units, context=True)))


def masked(passages: DataFrame, units: DataFrame, parts: int = 5) -> DataFrame:
    """How well infer_units does, by the explicit quantities of one passage in `parts` (by the id's hash) with their
    units hidden: for each kind the numbers, those given a unit, those given the right one, those given one with
    certainty, and the right ones of these."""
    q = written(quantities(passages, units, context=True))
    hidden = F.pmod(F.xxhash64("passage_id"), F.lit(parts)) == 0
    test = q.where(hidden & F.col("unit").isNotNull()).select("*", F.col("unit").alias("true_unit"), F.col("kind").alias("true_kind"))
    none = F.lit(None).cast("string")
    test = test.withColumns({"unit": none, "kind": none, "common_unit": none, "value_milli": F.lit(None).cast("long")})
    r = infer(q.where(~hidden).select("*", none.alias("true_unit"), none.alias("true_kind")).unionByName(test), "true_unit", "true_kind").where("true_unit IS NOT NULL")
    sure, right = ~F.col("uncertain"), F.col("unit").eqNullSafe(F.col("true_unit"))
    one = lambda c: F.sum(c.cast("long"))
    return r.groupBy(F.col("true_kind").alias("kind")).agg(
        F.count("*").alias("numbers"), one(F.col("unit").isNotNull()).alias("given"), one(right).alias("right"), one(sure).alias("certain"), one(sure & right).alias("certain_right")
    )
