"""Problem 10: abusive, hateful or sexually explicit language, by a bidirectional gated recurrent network.

Every text is read in overlapping windows of words. A word enters as its own vector (words of the training vocabulary)
joined with the mean of its letter trigrams' vectors, after problem 4's form, with repeated letters, digits used as
letters and single letters parted by hyphens undone; so spellings that hide a word stay close to it. Two gated
recurrent layers run over a window, one each way, attention pools their states, and a logistic unit scores the window.
A text's score is that of its highest window.

Labels are for whole texts, few of them and some wrong, and nothing else says which window of a text is meant: no list
of words is given. The network is trained here, in numpy, on windows: first those of positive texts in which words
stand that the labels show to be typical of positive texts, then, in a second round, those that the network itself
picks; positive texts without such a window are taken for mislabelled and left out, and so are windows of negative
texts that the first round is sure about. The threshold is the one with the best F1 on labelled texts that are held out.

Bound: at most MAX_POSITIVE and MAX_NEGATIVE labelled texts with the least hash of their id are used for training;
every document is scored, whole.

Defined results: null text gives a null score, a text without words 0; a document given twice is scored twice; labels
at odds with each other are not used; with no usable label of either kind every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread

from .canonical import consistent

MAX_POSITIVE, MAX_NEGATIVE = 2400, 3600
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 10, 12, 12, 4096
MIN_DF, EPOCHS, BATCH, RATE = 4, 5, 256, 0.01
#: Fewer windows are gone over more often, so that a small table trains as many steps as a larger one.
MIN_STEPS = 240
TOKEN = re.compile(r"[\w*@$!'’-]+")  # one class of characters: much faster than one that looks at what follows
# Digits and signs that stand for letters in hidden spellings.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})
REPEAT = re.compile(r"(.)\1+")


SPACED = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_]){3,}(?!\w)")
SPACED_HINT = re.compile(r" [^\W\d_] [^\W\d_] [^\W\d_](?!\w)")  # begins with a plain character, which is found fast


def tokens(text: str) -> list[str]:
    t = consistent(text).lower()
    if SPACED_HINT.search(t):
        t = SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    return TOKEN.findall(t)


def skeleton(word: str) -> str:
    """The word without the usual ways of hiding it: d-a-m-n, st0p, stoooop."""
    word = word.strip("-'’_!*$@")
    if "-" in word and all(len(x) == 1 for x in word.split("-")):
        word = word.replace("-", "")
    if not word.isalpha() and not word.isdigit():
        word = word.translate(LEET)
    return REPEAT.sub(r"\1", word)


def trigrams(word: str) -> list[int]:
    w = f"<{word}>"
    return [crc32(w[i : i + 3].encode("utf-8", "surrogatepass")) % CHAR_BUCKETS for i in range(max(len(w) - 2, 1))]


class Words:
    """Words seen by this process, numbered; 0 is no word. The inputs of the network are worked out once for each."""

    LIMIT = 150_000

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.own = [0]  # row in the word vectors; 0: not in the vocabulary
        self.grams: list[list[int]] = [[]]

    def ids(self, words: list[str]) -> list[int]:
        get, out = self.number.get, []
        for w in words:
            i = get(w)
            if i is None:
                i = self.number[w] = len(self.own)
                s = skeleton(w)
                self.own.append(self.vocabulary.get(s, 0))
                self.grams.append(trigrams(s))
            out.append(i)
        return out


def windows(ids: list[int]) -> list[list[int]]:
    """Overlapping windows over all words; the last one ends with the text."""
    n = len(ids)
    if n <= WINDOW:
        return [ids] if n else []
    out = [ids[i : i + WINDOW] for i in range(0, n - WINDOW, STRIDE)]
    out.append(ids[n - WINDOW :])
    return out


def _matrix(rows: list[list[int]]) -> np.ndarray:
    m = np.zeros((len(rows), WINDOW), np.int32)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, vocabulary: dict[str, int], seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        self.p: dict[str, np.ndarray] = {
            "word": r.normal(0, 0.3, (len(vocabulary) + 1, WORD_DIM)), "char": r.normal(0, 0.6, (CHAR_BUCKETS, CHAR_DIM)),
            "att": r.normal(0, 0.2, 2 * h), "out": r.normal(0, 0.2, 2 * h), "bias": np.full(1, -1.0),
        }
        for side in "fb":
            for gate in "zrn":
                self.p[f"W{gate}{side}"] = r.normal(0, d**-0.5, (d, h))
                self.p[f"U{gate}{side}"] = r.normal(0, h**-0.5, (h, h))
                self.p[f"c{gate}{side}"] = np.full(h, 0.5 if gate == "z" else 0.0)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.threshold = 0.5

    def inputs(self, own: np.ndarray, grams: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(g) for g in grams], np.int64)
        flat = np.fromiter((x for g in grams for x in g), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(n)), n)
        x = np.zeros((len(n), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["word"][own]
        some = np.flatnonzero(n)
        if len(some):
            x[some, WORD_DIM:] = np.add.reduceat(self.p["char"][flat], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
        return x, flat, of

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {g + s: x @ self.p[f"W{g}{s}"] + self.p[f"c{g}{s}"] for s in "fb" for g in "zrn"}

    def run(self, t: dict[str, np.ndarray], m: np.ndarray, keep: bool = False):
        """Logits of the windows m (rows of word numbers); with keep also what going back needs."""
        n, w = m.shape
        h_all = np.empty((w, n, 2 * HIDDEN), np.float32)
        mask = (m != 0).T.astype(np.float32)[:, :, None]
        full = bool(mask.all())
        tape: dict[str, list] = {"f": [], "b": []}
        for side, order in (("f", range(w)), ("b", range(w - 1, -1, -1))):
            uz, ur, un = (self.p[f"U{g}{side}"] for g in "zrn")
            h = np.zeros((n, HIDDEN), np.float32)
            lo = 0 if side == "f" else HIDDEN
            for k in order:
                at = m[:, k]
                z = t["z" + side][at]
                z += h @ uz
                np.negative(z, out=z), np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                r = t["r" + side][at]
                r += h @ ur
                np.negative(r, out=r), np.exp(r, out=r)
                r += 1
                np.reciprocal(r, out=r)
                hu = h @ un
                c = r * hu
                c += t["n" + side][at]
                c *= -2
                np.exp(c, out=c)
                c += 1
                np.reciprocal(c, out=c)
                c *= 2
                c -= 1
                new = h - c
                new *= z
                new += c
                if not full:
                    new = np.where(mask[k] > 0, new, h)
                if keep:
                    tape[side].append((k, h, z, r, c, hu))
                h = new
                h_all[k, :, lo : lo + HIDDEN] = h
        e = h_all @ self.p["att"]
        if not full:
            e += (mask[:, :, 0] - 1) * 30
        e -= e.max(axis=0)
        a = np.exp(e)
        a /= a.sum(axis=0)
        pooled = np.einsum("kn,knh->nh", a, h_all)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, h_all, a, pooled, tape, mask) if keep else logit

    def gradient(self, own: np.ndarray, grams: list[list[int]], m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, flat, of = self.inputs(own, grams)
        t = self.tables(x)
        logit, h_all, a, pooled, tape, mask = self.run(t, m, keep=True)
        p = _sigmoid(logit)
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = (weight * (p - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["out"]
        da = np.einsum("nh,knh->kn", dpool, h_all)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("kn,knh->h", de, h_all)
        dh_all = a[:, :, None] * dpool[None] + de[:, :, None] * self.p["att"]
        dt = {k: np.zeros_like(v) for k, v in t.items()}
        ids = np.unique(m)
        order = np.argsort(m.T.ravel(), kind="stable")
        first = np.searchsorted(m.T.ravel()[order], ids)
        steps: dict[str, np.ndarray] = {k: np.zeros((m.shape[1], len(m), HIDDEN), np.float32) for k in t}
        for side in "fb":
            lo = 0 if side == "f" else HIDDEN
            uz, ur, un = (self.p[f"U{q}{side}"] for q in "zrn")
            back = np.zeros((len(m), HIDDEN), np.float32)
            for k, h, z, r, c, hu in reversed(tape[side]):
                dh = dh_all[k, :, lo : lo + HIDDEN] + back
                live = mask[k]
                dn = dh * live
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * hu * r * (1 - r)
                steps["z" + side][k], steps["r" + side][k], steps["n" + side][k] = dz, dr, dc
                dcr = dc * r
                g[f"Uz{side}"] += h.T @ dz
                g[f"Ur{side}"] += h.T @ dr
                g[f"Un{side}"] += h.T @ dcr
                back = dh * (1 - live) + dn * z + dz @ uz.T + dr @ ur.T + dcr @ un.T
        dx = np.zeros_like(x)
        for key, s in steps.items():
            dt[key][ids] = np.add.reduceat(s.reshape(-1, HIDDEN)[order], first, axis=0)
            gate, side = key
            g[f"W{gate}{side}"] = x.T @ dt[key]
            g[f"c{gate}{side}"] = dt[key].sum(axis=0)
            dx += dt[key] @ self.p[f"W{gate}{side}"].T
        n = np.bincount(of, minlength=len(own))
        part = (dx[:, WORD_DIM:] / np.maximum(n, 1)[:, None])[of]
        for out, at, by in ((g["word"], own, dx[:, :WORD_DIM]), (g["char"], flat, part)):
            for k in range(by.shape[1]):  # faster than add.at by an order
                out[:, k] = np.bincount(at, weights=by[:, k], minlength=len(out))
        return loss, g

    def fit(self, words: Words, m: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        epochs = max(epochs, -(-MIN_STEPS // -(-len(m) // BATCH)))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        own_all, step = np.array(words.own), 0
        total = epochs * -(-len(m) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(m))
            for i in range(0, len(m), BATCH):
                at = order[i : i + BATCH]
                used, local = np.unique(m[at], return_inverse=True)
                if used[0] != 0:
                    used, local = np.concatenate([[0], used]), local + 1
                grams = [words.grams[u] for u in used]
                own = own_all[used]
                hide = r.random(len(own)) < 0.1  # a word outside the vocabulary must be known by its letters
                _, g = self.gradient(np.where(hide, 0, own), grams, local.reshape(m[at].shape).astype(np.int32), y[at], weight[at])
                step += 1
                rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / total)
                for k, v in g.items():
                    v += 1e-5 * self.p[k]
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def score(self, words: Words, m: np.ndarray, size: int = 4096) -> np.ndarray:
        out = np.zeros(len(m), np.float32)
        for i in range(0, len(m), size):
            part = m[i : i + size]
            used, local = np.unique(part, return_inverse=True)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            x, _, _ = self.inputs(np.array([words.own[u] for u in used]), [words.grams[u] for u in used])
            out[i : i + size] = self.run(self.tables(x), local.reshape(part.shape))
        return _sigmoid(out)


def _best(score: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.float32)
    np.maximum.at(out, doc, score)
    return out


def train(positive: list[str], negative: list[str], seed: int = 5) -> Network:
    """The network, trained on whole texts with a label each; one in eight is held out for the threshold."""
    texts = [tokens(t) for t in positive] + [tokens(t) for t in negative]
    y = np.array([1] * len(positive) + [0] * len(negative))
    skel: dict[str, str] = {}
    for t in texts:
        for w in t:
            if w not in skel:
                skel[w] = skeleton(w)
    held = np.arange(len(texts)) % 8 == 7
    np_, nn = max(int((y * ~held).sum()), 1), max(int(((1 - y) * ~held).sum()), 1)
    seen: list[dict[str, int]] = [{}, {}]
    for t, label, h in zip(texts, y, held):
        if not h:
            for s in {skel[w] for w in t}:
                seen[label][s] = seen[label].get(s, 0) + 1
    low = 2 if np_ < 60 else 3
    typical = {s: np.log((a + 0.1) / np_) - np.log((seen[0].get(s, 0) + 1) / nn) for s, a in seen[1].items() if a >= low}
    typical = {s: v for s, v in typical.items() if v > 1.0}
    df = {s: seen[0].get(s, 0) + seen[1].get(s, 0) for d in seen for s in d}
    vocabulary = {s: i + 1 for i, s in enumerate(sorted(s for s, n in df.items() if n >= MIN_DF))}
    words = Words(vocabulary)
    rows, doc = [], []
    for i, t in enumerate(texts):
        for w in windows(words.ids(t)):
            rows.append(w)
            doc.append(i)
    m, doc = _matrix(rows), np.array(doc, np.int64)
    value = np.zeros(len(words.own), np.float32)
    for w, i in words.number.items():
        value[i] = typical.get(skel[w], 0.0)
    hint = value[m].sum(axis=1)
    label = y[doc]
    best = _best(hint, doc, len(texts))
    pos = (label == 1) & ~held[doc] & (hint >= np.maximum(0.7 * best[doc], 3.0))
    r = np.random.default_rng(seed)
    neg = np.flatnonzero((label == 0) & ~held[doc])
    few = max(4 * int(pos.sum()), 2000)
    hard = neg[np.argsort(-hint[neg], kind="stable")][: few // 4]
    neg = np.concatenate([hard, r.permutation(neg)[: few - len(hard)]])
    net = Network(vocabulary, seed)
    if not pos.any() or not len(neg):
        net.threshold = 2.0
        return net
    for round_ in range(2):
        at = np.concatenate([np.flatnonzero(pos), neg])
        yy = np.concatenate([np.ones(int(pos.sum())), np.zeros(len(neg))]).astype(np.float32)
        weight = np.where(yy == 1, min(3.0, len(neg) / max(int(pos.sum()), 1)), 1).astype(np.float32)
        net.fit(words, m[at], yy, weight, EPOCHS, seed + round_)
        if round_ == 0:
            s = net.score(words, m)
            best = _best(s, doc, len(texts))
            pos = (label == 1) & ~held[doc] & (s >= np.maximum(0.6 * best[doc], 0.3))
            cand = np.flatnonzero((label == 0) & ~held[doc])
            sure = s[cand] > 0.9  # more likely a wrong label than a hard case
            cand = cand[~sure]
            few = max(4 * int(pos.sum()), 2000)
            hard = cand[np.argsort(-s[cand], kind="stable")][: few // 3]
            neg = np.concatenate([hard, r.permutation(cand)[: few - len(hard)]])
    s = _best(net.score(words, m), doc, len(texts))[held]
    truth = y[held]
    if truth.sum() >= 10:
        grid = np.linspace(0.2, 0.8, 25)
        f1 = [2 * ((s > g) & (truth == 1)).sum() / max((s > g).sum() + truth.sum(), 1) for g in grid]
        net.threshold = float(np.mean(grid[np.array(f1) >= max(f1) - 1e-9]))
    return net


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Network:
    """Trained on the driver from the bounded sample of labelled texts."""
    lab = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    lab = lab.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("k", "y")
    ranked = lab.withColumn("h", F.xxhash64("k"))
    keys = [r.k for r in ranked.where("y = 1").orderBy("h", "k").limit(max_positive).collect()], [r.k for r in ranked.where("y = 0").orderBy("h", "k").limit(max_negative).collect()]
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k, y) for y, ks in ((1, keys[0]), (0, keys[1])) for k in ks], "k long, y int")
    text = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = text.join(F.broadcast(wanted), "k").dropDuplicates(["k"]).collect()  # at most max_positive + max_negative rows
    rows = sorted(rows, key=lambda r: (crc32(str(r.k).encode()), r.k))
    sample = sha256(repr([(r.k, r.y, r.t) for r in rows]).encode("utf-8", "surrogatepass")).hexdigest()
    if sample not in _FITTED:
        if len(_FITTED) > 3:
            _FITTED.clear()
        _FITTED[sample] = train([r.t for r in rows if r.y == 1], [r.t for r in rows if r.y == 0])
    return _FITTED[sample]


#: Networks of this driver by the digest of what they were trained on, so that queries over the same labels train once.
_FITTED: dict[str, Network] = {}


def score(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """doc_id, score (0 to 1), flagged, and the columns to keep."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(net)
    cols = [c for c in keep if c not in ("doc_id", "score", "flagged")]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_t"), *cols)
    schema = src.drop("_t").schema.add("score", "double").add("flagged", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        words = Words(net.vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                if len(words.own) > Words.LIMIT:
                    words.clear()
                rows, doc = [], []
                texts = b.column(1).to_pylist()
                for k, t in enumerate(texts):
                    if t:
                        w = windows(words.ids(tokens(t)))
                        rows += w
                        doc += [k] * len(w)
                s = _best(net.score(words, _matrix(rows)), np.array(doc, np.int64), len(texts)).astype(np.float64) if net.threshold <= 1 else np.zeros(len(texts))
                null = np.array([t is None for t in texts], bool)
                out = [b.column(0), *b.columns[2:], pa.array(s, pa.float64(), mask=null), pa.array(s > net.threshold, pa.bool_(), mask=null)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *cols, "score", "flagged"])

    return spread(src).mapInArrow(run, schema)


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).where("flagged").select("doc_id").distinct()


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones, their share and the mean score."""
    s = score(docs, fit(docs, labels), "source")
    return s.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.col("flagged").cast("int"), F.lit(0))).alias("flagged"), F.avg(F.coalesce(F.col("flagged").cast("double"), F.lit(0.0))).alias("rate"), F.avg("score").alias("mean_score"))
