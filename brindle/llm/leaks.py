"""Problem 9: evaluation texts inside the training corpus.

The items' runs of ten words form a set of hashes that every task holds; the corpus is scanned window by window, a hit
is verified word by word, and the spans it covers are cut out of the text as it is stored. The set is held in tasks
only while it is below MAX_GRAMS (about 150 MB). A larger item table is matched by a join: every task then holds a bit
table of fixed size (FILTER_BITS), corpus windows that pass it are joined to the items' windows on the hash, and the
hashes of the ten words themselves are compared, so both ways give the same rows.

Defined results: null and empty texts, and items of fewer than ten words, take part in nothing; an item or document
given twice counts once; a document with several items gives one row for each; where one
document id has two texts, each is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread, written

from .canonical import transducer
from .words import _alnum, grid, mix, plain

RUN = 10
MAX_GRAMS = 5_000_000
BATCH = 400
#: Size of the bit table that corpus windows must pass before they are shuffled.
FILTER_BITS = 1 << 27


def _grams(words: np.ndarray, n: int = RUN) -> np.ndarray:
    """Hash of every window of n words; windows run over text ends, the caller masks those."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return mix(h)


def _windows(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, window hashes, and for each window inside one text its position and the text's number."""
    words, at = grid(texts)
    h = _grams(words, n)
    if not len(h):
        return words, h, np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    pos = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
    return words, h[pos], pos, owner[pos]


class Items:
    """The items' windows, sorted by hash, with the words they stand for."""

    def __init__(self, keys: list, texts: list[str], n: int):
        self.n, self.keys = n, keys
        self.words, h, pos, owner = _windows(texts, n)
        order = np.argsort(h, kind="stable")
        self.h, self.pos, self.owner = h[order], pos[order], owner[order]
        bits = 1 << max(12, int(len(h) * 16 - 1).bit_length())
        self.mask = np.uint64(bits - 1)
        self.filter = np.zeros(bits, bool)
        self.filter[h & self.mask] = True

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text number, item number, position of the window's first word, all verified; and the texts' words."""
        words, h, pos, owner = _windows(texts, self.n)
        some = np.flatnonzero(self.filter[h & self.mask]) if len(h) else np.empty(0, np.int64)
        lo, hi = np.searchsorted(self.h, h[some], "left"), np.searchsorted(self.h, h[some], "right")
        n = hi - lo
        a = np.repeat(some, n)
        b = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
        same = np.ones(len(a), bool)
        for k in range(self.n):
            same &= words[pos[a] + k] == self.words[self.pos[b] + k]
        a, b = a[same], b[same]
        return owner[a], self.owner[b], pos[a], words


def word_places(text: str) -> np.ndarray:
    """(words, 2): where each word of the plain form begins and ends in the text as it is stored."""
    t = transducer()
    form, at, i = [], [], 0

    def put(piece: str, begin: int, end: int, one_to_one: bool) -> None:
        for k, c in enumerate(piece):
            low = c.lower()
            form.append(low)
            at.extend([(begin + k, begin + k + 1) if one_to_one else (begin, end)] * len(low))

    for begin, end, piece in t.matches(text):
        put(text[i:begin], i, begin, True)
        put(piece, begin, end, False)
        i = end
    put(text[i:], i, len(text), True)
    if not at:
        return np.empty((0, 2), np.int64)
    flag = np.zeros(len(at) + 2, np.int8)
    flag[1:-1] = _alnum()[np.frombuffer("".join(form).encode("utf-32-le", "surrogatepass"), np.uint32)]
    step, place = np.diff(flag), np.array(at, np.int64)
    return np.stack([place[np.flatnonzero(step == 1), 0], place[np.flatnonzero(step == -1) - 1, 1]], axis=1)


def without(text: str, starts: np.ndarray, n: int) -> tuple[str, int, int]:
    """The text without the windows of n words that begin at the given words; its words and how many went. What
    stands between the words of a window goes with them; where blanks then meet, one side's remain."""
    place = word_places(text)
    gone = np.zeros(len(place) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts + n, len(place)), -1)
    gone = np.cumsum(gone)[:-1] > 0
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, i = [], 0
    for first, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1):
        begin, end = int(place[first, 0]), int(place[last, 1])
        out.append(text[i:begin])
        while end < len(text) and text[end].isspace() and (begin == 0 or text[begin - 1].isspace()):
            end += 1
        i = end
    return "".join([*out, text[i:]]), len(place), int(gone.sum())


def _batches(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[tuple[list, list[str]]]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            part = b.slice(i, size)
            yield part.column(0).to_pylist(), [plain(t) for t in part.column(1).to_pylist()]


def _clean(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))).where("k IS NOT NULL AND t IS NOT NULL AND t <> ''")


def _held_items(docs: DataFrame, i: DataFrame, n: int, max_grams: int):
    """The items' windows for every task, or nothing where they are too many."""
    size = i.agg(F.sum(F.length("t"))).first()[0] or 0  # a word has a letter and a blank at least: a bound of the windows
    if size / 2 > max_grams:
        return None
    rows = i.orderBy("k", "t").collect()
    return docs.sparkSession.sparkContext.broadcast(Items([r.k for r in rows], [plain(r.t) for r in rows], n))


def _windows_of(n: int, held=None):
    """(k, h, pos, ten): windows of n words with their hash, place and words' hashes; those outside the bit table left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if held is None else held.value
        for k, t in _batches(batches):
            words, h, pos, owner = _windows(t, n)
            if table is not None and len(h):
                bit = h & np.uint64(FILTER_BITS - 1)
                some = np.flatnonzero(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                h, pos, owner = h[some], pos[some], owner[some]
            _, at = grid(t)
            ten = [words[p : p + n].tobytes() for p in pos]
            key = np.array(k, np.int64)[owner] if len(owner) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h.view(np.int64)), pa.array(pos - at[owner]), pa.array(ten, pa.binary())], names=["k", "h", "pos", "ten"])

    return run


def _joined_hits(d: DataFrame, i: DataFrame, n: int) -> DataFrame:
    """(d, i, pos), verified, by a join on the windows' hashes."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(b.column(0).to_numpy() & (FILTER_BITS - 1)))], names=["bit"])

    schema = "k long, h long, pos long, ten binary"
    wanted = written(i.mapInArrow(_windows_of(n), schema).select("h", "ten", F.col("k").alias("i")).distinct())
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in wanted.select("h").mapInArrow(bits, "bit long").groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 AS int))")).alias("v")).toLocalIterator():
        table[r.byte] = r.v  # one row a byte of the table at most
    held = d.sparkSession.sparkContext.broadcast(table)
    found = d.mapInArrow(_windows_of(n, held), schema).withColumnRenamed("k", "d")
    return found.join(wanted, ["h", "ten"]).select("d", "i", "pos")


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", n: int = RUN, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc key, item key) of every document that holds n or more words of an item in a row; distinct."""
    d, i = _clean(docs, doc_key, "text"), _clean(items, item_key, "text").distinct()
    held = _held_items(docs, i, n, max_grams)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        ik = np.array(index.keys, np.int64)
        for k, t in _batches(batches):
            if len(ik):
                a, b, _, _ = index.hits(t)
                pairs = np.unique(np.stack([np.array(k, np.int64)[a], ik[b]]), axis=1) if len(a) else np.empty((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["d", "i"])

    out = d.mapInArrow(scan, "d long, i long") if held else _joined_hits(d, i, n).select("d", "i")
    return out.distinct().select(F.col("d").alias(doc_key), F.col("i").alias(item_key))


def remove_leaks(docs: DataFrame, items: DataFrame, n: int = RUN, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, words, leaked_words, text: every text with a leak, its stored text with the leaked spans cut out and
    everything else as it was. Both ways of matching are used as in find_leaks; in the second the texts with a hit are
    joined to their hits."""
    d, i = _clean(docs, "doc_id", "text"), _clean(items, "item_id", "text").distinct()
    held = _held_items(docs, i, n, max_grams)
    schema = "doc_id long, words int, leaked_words int, text string"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "words", "leaked_words", "text"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for whole in batches:
            for s in range(0, whole.num_rows, BATCH):
                b = whole.slice(s, BATCH)
                texts = b.column(1).to_pylist()
                t = [plain(x) for x in texts]
                a, _, pos, _ = index.hits(t)
                _, at = grid(t)
                out = []
                for doc in np.unique(a):
                    text, total, gone = without(texts[doc], np.unique(pos[a == doc] - at[doc]), n)
                    out.append((b.column(0)[int(doc)].as_py(), total, gone, text))
                yield batch(out)

    if held:
        return d.mapInArrow(scan, schema).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, text, pos in zip(*(c.to_pylist() for c in b.columns)):
                rest, total, gone = without(text, np.array(pos, np.int64), n)
                out.append((k, total, gone, rest))
            yield batch(out)

    # an id may have two texts: hits are kept for each text, known by a digest
    d = d.withColumn("h", F.xxhash64("t"))
    hits = _joined_hits(d.select(F.col("h").alias("k"), "t"), i, n).groupBy(F.col("d").alias("h")).agg(F.collect_set("pos").alias("pos"))
    return d.join(hits, "h").select("k", "t", "pos").mapInArrow(cut, schema).distinct()
