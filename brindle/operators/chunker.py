"""Blocks packed into chunks with sentence overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from types import SimpleNamespace

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import sentence_break
from brindle.session import spread
from brindle.sources.markdown import parse

TARGET, MOST, CARRY = 144, 160, 24
BREAK = regex.compile(sentence_break())
SCHEMA = "doc string, chunk int, kind string, heading string, text string, spans array<struct<block:string,start:int,end:int>>, quarantine string"


def tokens(text: str) -> int:
    """The fixture counter without special tokens."""
    return sum(max(1, (len(x) + 5) // 6) for x in re.findall(r"\w+|[^\w\s]", text))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets of sentences, parted where `functions.text.sentences` parts them."""
    gaps = [m.span() for m in BREAK.finditer(text)]
    begins, ends = [0, *(e for _, e in gaps)], [*(b for b, _ in gaps), len(text.rstrip())]
    return [(b, e) for b, e in zip(begins, ends) if text[b:e].strip()]


class _Packer:
    """Chunks of one section: units are whole lists or sentences, (block number, start, end, is a sentence)."""

    def __init__(self, blocks: list):
        self.blocks, self.open, self.done = blocks, [], []

    def text(self, units: list) -> str:
        parts = []
        for n, run in groupby(units, key=lambda u: u[0]):
            run = list(run)
            parts.append(self.blocks[n].text[run[0][1] : run[-1][2]])
        return "\n\n".join(parts)

    def size(self, units: list) -> int:
        return tokens(self.text(units))

    def close(self) -> list:
        """Ends the open chunk; gives the sentences that may be carried over: a tail within CARRY, never all of it."""
        whole, self.open = self.open, []
        if not whole:
            return []
        self.done.append(("text", whole, None))
        tail: list = []
        for u in reversed(whole):
            if not u[3] or self.size([u, *tail]) > CARRY:
                break
            tail = [u, *tail]
        return [] if len(tail) == len(whole) else tail

    def add(self, unit: tuple) -> None:
        if self.size([unit]) > MOST:  # what is too long is set aside and parts what stands around it
            self.close()
            self.done.append(("text", [unit], "long_sentence" if unit[3] else "oversize_list"))
            return
        if not self.open or self.size([*self.open, unit]) <= TARGET:
            self.open.append(unit)
            return
        tail = self.close()
        self.open = [*tail, unit] if tail and self.size([*tail, unit]) <= MOST else [unit]

    def run(self) -> list:
        for n, b in enumerate(self.blocks):
            if b.kind in ("table", "caption"):
                self.close()
                self.done.append((b.kind, [(n, 0, len(b.text), False)], f"oversize_{b.kind}" if tokens(b.text) > MOST else None))
            elif b.kind == "list":
                self.add((n, 0, len(b.text), False))
            else:
                for s, e in sentence_spans(b.text):
                    self.add((n, s, e, True))
        self.close()
        return self.done


def pack(blocks: list) -> list[tuple]:
    """(kind, heading, text, spans, quarantine) of each chunk of one document's blocks, in order."""
    rows = []
    for section, part in groupby(blocks, key=lambda b: tuple(b.section_path)):
        p = _Packer(list(part))
        for kind, units, why in p.run():
            spans = [{"block": p.blocks[n].block_id, "start": s, "end": e} for n, s, e, _ in units]
            rows.append((kind, " > ".join(section), p.text(units), spans, why))
    return rows


def chunk(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a chunk of each Markdown document, in order; quarantine says why a unit was set aside. A document is
    parsed and packed where it is read, so nothing is shuffled. A null text gives no chunk."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("block", pa.string()), ("start", pa.int32()), ("end", pa.int32())])), pa.string())
    names = ["doc", "chunk", "kind", "heading", "text", "spans", "quarantine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = [SimpleNamespace(block_id=i, kind=k, text=x, section_path=s) for i, k, x, s in parse(t)]
                rows += [(d, n + 1, *r) for n, r in enumerate(pack(blocks))]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return spread(docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string"), F.col(text))).mapInArrow(run, SCHEMA)
