"""Problem 4: one consistent form for text that looks the same but differs in its characters.

A longest-match transducer over grapheme clusters, compiled once in each process from a mapping that is checked for
conflicts. In one pass over a text it drops what is not drawn, folds widths and blanks, composes accents and replaces
look-alike letters. Whatever a reader can see (case, an accent, a raised digit, the length of a dash) stays.

A cluster is a character with everything after it that can attach to it: marks of any script, the second and later
parts of canonical compositions (Hangul vowels and finals among them), narrow voicing marks, and what is not drawn
between these. Clusters are taken apart, mapped and composed again, so the form is closed under canonical equivalence:
texts that NFC or NFD makes equal have one form. That holds for every character of Unicode and is tested so.

Defined results: null gives null, the empty text the empty text; the form of a form is itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions.lookalikes import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, OTHER_LOOKALIKES, SCRIPT_LOOKALIKES
from brindle.session import spread, written

LINE_ENDS = {"\r\n": "\n", "\r": "\n", chr(0x85): "\n", chr(0x2028): "\n", chr(0x2029): "\n"}
#: Not drawn, though not of category Cf: the grapheme joiner, Hangul fillers, variation selectors.
UNDRAWN = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
#: Roman numerals of one character are drawn as the letters they stand for.
ROMAN = range(0x2160, 0x2180)
#: Planes with assigned characters that are not for private use, and the second parts of Hangul syllables.
ASSIGNED = (*range(0x80, 0xD800), *range(0xF900, 0x32400), *range(0xE0000, 0xE1000))
HANGUL_PARTS = (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))


def _canonical(c: str) -> bool:
    """Whether the character has a canonical decomposition of its own (Hangul syllables are taken apart by rule)."""
    d = unicodedata.decomposition(c)
    return bool(d) and d[0] != "<"


class Conflict(ValueError):
    """The mapping sends one string to two forms, or a form is itself mapped on."""


def _put(rules: dict[str, str], source: str, target: str) -> None:
    if rules.setdefault(source, target) != target:
        raise Conflict(f"{source!r} goes to both {rules[source]!r} and {target!r}")


@cache
def rules() -> dict[str, str]:
    """Every mapped character (and CR LF) with its form; no form holds a mapped character."""
    out: dict[str, str] = {}
    for part in (CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, SCRIPT_LOOKALIKES, OTHER_LOOKALIKES, LINE_ENDS):
        for s, t in part.items():
            _put(out, s, t)
    for code in UNDRAWN:
        _put(out, chr(code), "")
    for code in ASSIGNED:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf":
            _put(out, c, "")
        elif kind == "Zs":
            _put(out, c, " ")
    for code in ROMAN:
        if unicodedata.decomposition(chr(code)):
            _put(out, chr(code), unicodedata.normalize("NFKC", chr(code)))
    for code in range(0xFF00, 0xFFF0):
        flat = unicodedata.decomposition(chr(code))
        if flat.startswith(("<wide>", "<narrow>")) and chr(code) not in out:
            wide = unicodedata.normalize("NFD", chr(int(flat.split()[-1], 16)))
            _put(out, chr(code), unicodedata.normalize("NFC", "".join(out.get(x, x) for x in wide)))
    single = {s: t for s, t in out.items() if len(s) == 1}
    for code in ASSIGNED:
        c = chr(code)
        if c in out or not _canonical(c):
            continue
        form = unicodedata.normalize("NFC", "".join(single.get(x, x) for x in unicodedata.normalize("NFD", c)))
        if form != c:
            _put(out, c, form)
    for s, t in out.items():
        if any(x in out for x in t):
            raise Conflict(f"{s!r} goes to {t!r}, which is itself mapped")
    return out


@cache
def attaching() -> str:
    """Every character that can attach to the one before it: marks, and whatever canonical composition may take in."""
    out = set(map(chr, HANGUL_PARTS))
    for code in ASSIGNED:
        c = chr(code)
        if unicodedata.category(c)[0] == "M":
            out.add(c)
        elif _canonical(c):
            out.update(unicodedata.normalize("NFD", c)[1:])
    mapping = rules()
    out.update(s for s, t in mapping.items() if len(s) == 1 and t and t[0] in out)
    return "".join(sorted(c for c in out if mapping.get(c) != ""))


def _ranges(chars: str) -> str:
    """The inside of a character class."""
    codes, out = sorted(map(ord, chars)), []
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[i])) + ("" if i == j else "-" + re.escape(chr(codes[j]))))
        i = j + 1
    return "".join(out)


class Transducer:
    """Longest match over clusters: a character with all that attaches to it, or a run of mapped and undrawn characters.
    What matches nothing is copied. Seen clusters are kept, so that each is worked out once."""

    def __init__(self, mapping: dict[str, str]):
        self.mapping = mapping
        undrawn = _ranges("".join(s for s, t in mapping.items() if t == ""))
        chars = _ranges("".join(s for s in mapping if len(s) == 1))
        marks = _ranges(attaching())
        self.has_marks = re.compile(f"[{marks}]").search
        cluster = f"[^{marks}{undrawn}]?(?:[{undrawn}]*[{marks}])+"
        basic = _ranges("".join(s for s in mapping if len(s) == 1 and s < "\U00010000"))
        # A class first, and one within the basic plane: the engine then has a table for it and skips to its next match.
        self.plain = re.compile(f"[{basic}][{basic}]*")
        # In two: the engine has a table for a class within the basic plane, and one comparison for the other planes.
        self.basic_mark = re.compile(f"[{_ranges(''.join(c for c in attaching() if c < chr(0x10000)))}]").search
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.marked = re.compile(f"{cluster}|[{chars}]+")
        self.seen: dict[str, str] = {}

    def _form(self, match: re.Match) -> str:
        s = match.group()
        if s[-1] == "\r" and match.string.startswith("\n", match.end()):  # CR LF is one line end
            s = s[:-1]
        t = self.seen.get(s)
        if t is None:
            t = "".join(self.mapping.get(x, x) for x in s.replace("\r\n", "\n"))
            if self.has_marks(s):
                parts = unicodedata.normalize("NFD", "".join(c for c in s if self.mapping.get(c) != ""))
                t = unicodedata.normalize("NFC", "".join(self.mapping.get(c, c) for c in parts))
            if len(self.seen) < 100_000:
                self.seen[s] = t
        return t

    def matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(begin, end, form) of every part that is not copied as it is; the same parts as in a call."""
        for m in self.pattern(text).finditer(text):
            yield m.start(), m.end(), self._form(m)

    def pattern(self, text: str) -> re.Pattern:
        return self.marked if self.basic_mark(text) or self.beyond(text) else self.plain

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        return self.pattern(text).sub(self._form, text)


@cache
def transducer() -> Transducer:
    return Transducer(rules())


def consistent(text: str | None) -> str | None:
    return None if text is None else transducer()(text)


def consistent_column(col: Column) -> Column:
    """The consistent form of a string column, worked out in Arrow batches."""

    @F.arrow_udf(StringType())
    def form(a: pa.Array) -> pa.Array:
        t = transducer()
        return pa.array([None if s is None else t(s) for s in a.to_pylist()], pa.string())

    return form(col)


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """All pairs of keys whose texts are different strings with one consistent form; (key_a, key_b), a < b.

    A key delivered twice counts once, null texts and keys take part in no pair. Rows are first reduced to one digest
    of the form and one of the text each; forms that really have two spellings give pairs of spellings, and only these
    are spread out to the keys, so that copies of one spelling never meet each other.
    """
    out = "form string, spelling string, k string"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        t = transducer()
        for b in batches:
            f, s, k = [], [], []
            for key_, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text_.isascii() and "\r" not in text_:
                    d = blake2b(text_.encode(), digest_size=16).hexdigest()
                    f.append(d), s.append(d), k.append(key_)
                else:
                    f.append(blake2b(t(text_).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                    s.append(blake2b(text_.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                    k.append(key_)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (f, s, k)], names=["form", "spelling", "k"])

    src = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = spread(src).mapInArrow(digests, out).distinct()
    mixed = rows.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo < hi").select("form")
    rows = written(rows.join(mixed, "form", "left_semi"))
    few = rows.select("form", "spelling").distinct()
    ways = few.select("form", F.col("spelling").alias("sa")).join(few.select("form", F.col("spelling").alias("sb")), "form").where("sa < sb").select("sa", "sb")
    a, b = rows.select(F.col("spelling").alias("sa"), F.col("k").alias("ka")), rows.select(F.col("spelling").alias("sb"), F.col("k").alias("kb"))
    hit = ways.join(a, "sa").join(b, "sb").where("ka <> kb")
    return hit.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
