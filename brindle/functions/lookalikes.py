"""Letters and signs that are drawn alike, each with the one that stands for it, and a plain reading form."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

CYRILLIC_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o",
    "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "µ": "μ",
}
# Armenian, Cherokee, Coptic and Lisu letters that are drawn as Latin ones.
SCRIPT_LOOKALIKES = {
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "ք": "p",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c",
    "Ⲧ": "T", "Ⲭ": "X",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O",
    "ꓴ": "U",
}
OTHER_LOOKALIKES = {
    "ɡ": "g", "‐": "-", "‑": "-", "﹣": "-", "‒": "–", "․": ".", "ʼ": "’", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl",
    "ﬃ": "ffi", "ﬄ": "ffl",
}


@cache
def _readable() -> tuple[re.Pattern, dict[str, str]]:
    out = {**CYRILLIC_LOOKALIKES, **GREEK_LOOKALIKES, **OTHER_LOOKALIKES}
    for code in range(0x80, 0x10000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= code < 0xFE10 or code == 0x34F:
            out[c] = ""
        elif kind == "Zs":
            out[c] = " "
        elif 0xFF01 <= code < 0xFF5F:
            out[c] = chr(code - 0xFEE0)
    chars = "".join(re.escape(c) for c in out)
    return re.compile(f"[{chars}]"), out


def readable(text: str) -> str:
    """The text as numbers, units and Latin words are read in it: widths, blanks and look-alikes folded, what is not
    drawn left out, accents composed."""
    if text.isascii():
        return text
    pattern, table = _readable()
    return unicodedata.normalize("NFC", pattern.sub(lambda m: table[m.group()], text))
