"""Text functions as column expressions; Arrow functions only where Spark has no built-in (Unicode normal forms)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
WORD = r"[\p{L}\p{N}]+"
ABBREVIATIONS = ["e.g.", "i.e.", "fig.", "figs.", "approx.", "vs.", "etc.", "no.", "dr.", "st.", "cf.", "ca.", "al."]
STOP_WORDS = (
    "a an the of in on at to for from by with and or but is are was were be been being has have had do does did it its this that these those as into "
    "onto than then there their they them which who whom whose what when where why how also such can may will would should could very more most less "
    "least each every all some any no not"
).split()
ACTIVE_HTML = r"(?i)<\s*/?\s*[a-zA-Z][^>]*>|javascript:"
REMOTE_LINK = r"(?i)\]\(\s*(?:https?:|//|ftp:|data:)"
MARKUP = [r"<\s*/?\s*[a-zA-Z][^>]*>", "`", r"^\s*#{1,6}\s", r"^\s*(?:[-*+]\s|\d+[.)]\s)", r"\|", r"\[[^\]]*\]\([^)]*\)", r"(?i)\b(?:https?://|www\.)", r"\*\*|__"]
FOREIGN = r"[Ѐ-ӿ؀-ۿ一-鿿぀-ヿ가-힯]"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def match_terms(text: Column, most: int = 64) -> Column:
    """The terms a text is searched by: distinct, in order of first appearance, at most `most`; null if none."""
    t = F.slice(F.array_distinct(words(text)), 1, most)
    return F.when(F.size(t) > 0, t)


def token_count(text: Column, special: int = 2) -> Column:
    """The fixture token counter: max(1, (length + 5) // 6) for each word or sign, and the special tokens. Words are
    runs of letters and digits of any script, and blanks those of any script, as in Python."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"), F.lit(0))
    return F.aggregate(pieces, F.lit(special), lambda s, x: s + F.greatest(F.lit(1), F.floor((F.length(x) + 5) / 6).cast("int")))


def normalize_ws(text: Column) -> Column:
    """X01 without the normal form: format characters out, line ends to LF, blanks in a line collapsed, lines stripped."""
    t = F.regexp_replace(text, r"\p{Cf}", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\x{A0}]+", " ")
    return F.regexp_replace(t, r"(?m)^ | $", "")


def normal_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form, which Spark has no function for."""

    @F.arrow_udf("string")
    def normal(a: pa.Array) -> pa.Array:
        return pa.array([None if s is None else s if s.isascii() else unicodedata.normalize(form, s) for s in a.to_pylist()], pa.string())

    return normal(text)


def gate_normal(text: Column) -> Column:
    """struct(text, error). NFKC; a control character other than tab and line ends is an error, and so is a text
    without letter or digit; format characters go, line separators become LF, at most two LF stay in a row."""

    @F.arrow_udf("struct<text:string,error:string>")
    def normal(a: pa.Array) -> pa.Array:
        import re

        out = []
        for s in a.to_pylist():
            if s is None:
                out.append(None)
                continue
            s = unicodedata.normalize("NFKC", s)
            s = re.sub("\r\n?|[" + chr(0x2028) + chr(0x2029) + "]", "\n", s)
            kinds = {c: unicodedata.category(c) for c in set(s)}
            if any(k == "Cc" and c not in "\n\t" for c, k in kinds.items()):
                out.append({"text": None, "error": "control_character"})
                continue
            s = "".join(c for c in s if kinds[c] != "Cf")
            s = re.sub(r"\n{3,}", "\n\n", s).strip()
            out.append({"text": s, "error": None} if any(c.isalnum() for c in s) else {"text": None, "error": "no_content"})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return normal(text)


def folded(text: Column) -> Column:
    """Lower case with typographic quotes as plain ones."""
    return F.translate(F.lower(text), "‘’‚‛“”„‟", "''''\"\"\"\"")


def split_key(text: Column) -> Column:
    """Runs of anything but letters and digits to one blank, lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct word n-grams; a shorter text is one shingle. The words are bound to a name first, else their
    expression would be evaluated once for every n-gram."""
    grams = F.transform(F.array(tokens), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(t, i, n))))
    return F.array_distinct(grams[0])


def slug(text: Column, most: int = 80) -> Column:
    """X08"""
    s = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.left(F.when(s == "", "section").otherwise(s), F.lit(most))


def sentence_break() -> str:
    """Pattern of the blanks between two sentences: terminal punctuation and closing signs stand before them, but no
    abbreviation as a word of its own, and a capital, digit, quote or bracket after them."""
    abbreviation = "|".join(a[:-1].replace(".", r"\.") for a in ABBREVIATIONS)
    return rf"(?<=[.!?][\"')\]]{{0,9}})(?<!(?:^|\s)(?i:{abbreviation})\.)\s+(?=[\p{{Lu}}\p{{Nd}}\"'(\[])"


def sentences(text: Column) -> Column:
    """Array of sentences, without blanks at either end of the text."""
    ends = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return F.filter(F.split(ends, sentence_break()), lambda s: s != "")


def clauses(text: Column) -> Column:
    """The pieces between clause signs and conjunctions."""
    parts = F.split(text, r"(?i)[,;:()]|\b(?:and|or|but|whereas|while|which|although)\b")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def content_tokens(text: Column) -> Column:
    """X11 for words: stop words and single letters out, a plural s cut off words longer than three letters, distinct."""
    t = F.filter(ascii_words(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    t = F.transform(t, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.array_distinct(t)


def sentence_problem(text: Column) -> Column:
    """The first problem of a text that should be one well-formed sentence; null if there is none."""
    markup = F.lit(False)
    for p in MARKUP:
        markup = markup | text.rlike(p)
    foreign, latin = F.regexp_count(text, F.lit(FOREIGN)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (
        F.when(text.rlike(r"[\n\r\t]"), "multiline")
        .when(text != F.trim(text), "surrounding_whitespace")
        .when(markup, "markup")
        .when(~text.rlike(r"[.!?][\"')\]]*$"), "no_terminal_punctuation")
        .when((foreign > 0) & (foreign >= latin), "non_english_prose")
        .when(F.size(sentences(text)) != 1, "multiple_sentences")
    )


def html_escape(text: Column) -> Column:
    """X16"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unsafe_markup(text: Column) -> Column:
    """R08"""
    return F.when(text.rlike(ACTIVE_HTML), "active_html").when(text.rlike(REMOTE_LINK), "remote_link")
