import collections
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("brindle.llm")

from brindle.llm import abuse, canonical, components, crosssplit, leaks, nearcopies, neighbours, packing, pieces, words  # noqa: E402
from brindle.session import shared_folder  # noqa: E402


# ---- 1 pieces
def passages(spark, texts, spans=None):
    rows = [(f"p{i}", t, '["A"]', (spans or {}).get(i), "A", "s", "1", "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "passage_id string, text string, section_path_json string, spans_json string, heading string, source_id string, source_version string, piece string")


def test_pieces_round_trip(spark):
    r = random.Random(3)
    texts = []
    for _ in range(60):
        blocks = [" ".join("word"[: r.randint(1, 4)] + r.choice(["", ".", ",", "。", "é"]) for _ in range(r.randint(1, 90))) for _ in range(r.randint(1, 6))]
        texts.append("\n\n".join(blocks))
    texts += ["x" * 1000, "", "a", "é" * 500, "\n\n" * 200, "字" * 300 + "。" + "字" * 100, "a" * 99 + " ", None]
    limit, overlap = 100, 20
    got = pieces.split_passages(passages(spark, texts), limit, overlap).orderBy("passage_id", "piece").collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.passage_id].append(x)
    for i, t in enumerate(texts):
        p = by[f"p{i}"]
        if t is None:
            assert not p
            continue
        assert "".join(t[x.body_start : x.body_end] for x in p) == t and [x.piece for x in p] == list(range(1, len(p) + 1))
        for a, b in zip(p, p[1:]):
            assert b.body_start == a.body_end and b.piece_start <= b.body_start
            whole = t[b.body_start : b.body_end].removesuffix("\n\n")
            most = min(overlap, limit - len(whole), a.body_end - a.body_start)
            assert b.overlap == b.body_start - b.piece_start <= most
            if b.overlap < most:  # less only by the rest of a word or by marks
                lost = t[b.body_start - most : b.piece_start]
                assert not lost.rstrip() or not t[b.body_start - most - 1].isspace() and len(lost.split()) == 1
        for x in p:
            assert len(x.text) <= limit and x.text == t[x.piece_start : x.body_end].removesuffix("\n\n") or len(t) <= limit
            assert x.section_path_json == '["A"]'


def test_pieces_cut_at_pauses(spark):
    t = "First one here. " * 5 + "\n\n" + "Second part there. " * 4
    p = pieces.split_passages(passages(spark, [t]), 100, 10).orderBy("piece").collect()
    assert [x.cut for x in p] == ["none", "block"] and p[0].blocks[0].id == "block-1" and p[1].blocks[-1].id == "block-2"
    ids = pieces.split_passages(passages(spark, [t], {0: '[["x-b1", 0, 80], ["x-b2", 0, 75]]'}), 100, 10).orderBy("piece").collect()
    assert ids[0].blocks[0].id == "x-b1" and ids[1].blocks[-1].id == "x-b2"


def test_pieces_of_a_very_long_text(spark):
    import time

    t = ("word and so on. " * 50 + "\n\n") * 6000
    began = time.time()
    got = pieces.split_passages(passages(spark, [t])).agg(F.count("*").alias("n"), F.max("pieces").alias("p"), F.sum(F.length("text") - F.col("overlap")).alias("c"), F.max(F.size("blocks")).alias("b"), F.max(F.length("text")).alias("m")).first()
    assert got.n == got.p == 6000 and got.c == 800 * 6000 and got.b <= 2 and got.m <= pieces.LIMIT
    assert time.time() - began < 60  # quadratic work would take many minutes


def test_pieces_found(spark):
    got = {r.passage_id: r.cut for r in pieces.found(passages(spark, ["a" * 1200, "a" * 1201, "a" * 1000 + "\n\n" + "b" * 1000, None, ""])).collect()}
    assert got == {"p1": "inside", "p2": "block"}
    assert pieces.found(passages(spark, ["a"]).limit(0)).count() == 0


# ---- 4 consistent form
@pytest.mark.parametrize("a, b", [("café", "café"), ("Ａ２", "A2"), ("nаme", "name"), ("a​b­", "ab"), ("a b", "a b"), ("µm", "μm"), ("ё", "ë"), ("e‍́", "é"), ("x\r\ny\rz", "x\ny\nz"), ("a‑b", "a-b"), ("\U000e0041a", "a")])
def test_alike(a, b):
    assert canonical.consistent(a) == canonical.consistent(b)


@pytest.mark.parametrize("a, b", [("a", "A"), ("e", "é"), ("10²", "102"), ("a-b", "a–b"), ("a b", "ab"), ("и", "й"), ("α", "a")])
def test_not_alike(a, b):
    assert canonical.consistent(a) != canonical.consistent(b)


def test_form_is_closed_under_canonical_equivalence():
    import unicodedata

    form = canonical.transducer()
    for code in [*range(0xD800), *range(0xE000, 0x110000)]:
        for x in (chr(code), f"a{chr(code)}b"):
            f = form(x)
            assert f == form(unicodedata.normalize("NFC", x)) == form(unicodedata.normalize("NFD", x)) == form(f), hex(code)


@pytest.mark.parametrize("a,b", [("\u1100\u1161\u11a8", "\uac01"), ("\u1100\u200b\u1161", "\uac00"), ("\uff76\uff9e", "\u30ac"), ("\u2163", "IV"), ("\u0585", "o"), ("q\u0307\u0323", "q\u0323\u0307"), ("\u0410\u030a", "\u00c5")])
def test_scripts_and_orders(a, b):
    assert canonical.consistent(a) == canonical.consistent(b)


def test_copies_of_a_spelling_never_meet(spark):
    d = spark.createDataFrame([(f"a{i}", "name", 1) for i in range(30)] + [(f"b{i}", "nаme", 1) for i in range(2)] + [("c", "nаmе", 1)], "passage_id string, text string, form int")
    assert canonical.lookalike_pairs(d, "passage_id", "text").count() == 30 * 2 + 30 + 2


def test_form_is_stable_and_checked():
    for s in canonical.rules():
        f = canonical.consistent(s)
        assert canonical.consistent(f) == f
    with pytest.raises(canonical.Conflict):
        canonical._put({"a": "b"}, "a", "c")


def test_lookalike_pairs(spark):
    d = spark.createDataFrame([("a", "nаme", 1), ("b", "name", 2), ("c", "name", 3), ("d", "Name", 4), ("b", "name", 2), (None, "name", 5), ("e", None, 6)], "passage_id string, text string, form int")
    assert sorted(tuple(r) for r in canonical.lookalike_pairs(d, "passage_id", "text").collect()) == [("a", "b"), ("a", "c")]
    assert canonical.lookalike_pairs(d.limit(0), "passage_id", "text").count() == 0
    assert [r[0] for r in d.select(canonical.consistent_column(F.col("text"))).collect()][:2] == ["name", "name"]


# ---- words
def test_words_match_regex():
    import re

    texts = ["", "?!", "one two", "été 10² x_y", "细胞 a", "a" * 5, "one two"]
    w, at = words.grid([words.plain(t) for t in texts])
    assert list(np.diff(at)) == [len(re.findall(r"[^\W_]+", words.plain(t))) for t in texts]
    assert (w[at[2] : at[3]] == w[at[6] : at[7]]).all()
    r, to = words.runs(w, at)
    assert list(np.diff(to)) == [max(1, n - 2) for n in np.diff(at)] and r[to[0]] == r[to[1]]
    h = words.text_hashes(w, at)
    assert h[0] == h[1] and h[2] == h[6] and len(set(h.tolist())) == 5


def runs_of(t):
    import re

    w = re.findall(r"[^\W_]+", words.plain(t))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def texts_with_edits(n, seed, size):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bdfgklmn" for b in ("ala", "elo", "iru", "one", "ubi")]
    out = []
    for _ in range(n):
        t = [r.choice(vocab) for _ in range(r.choice(size))]
        out.append(" ".join(t))
        for _ in range(r.randint(0, 3)):
            u = list(t)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(u))
                u[k : k + 1] = r.choice([[], [r.choice(vocab)], [u[k], r.choice(vocab)]])
                u = u or ["x"]
            out.append(" ".join(u).replace("a", "а" if r.random() < 0.2 else "a"))
    return out


# ---- 5 near copies
def test_bit_sliced_against_brute_force():
    r = np.random.default_rng(0)
    sig = r.integers(0, 256, (400, 16), dtype=np.uint8)
    sig[50:120] = sig[50]
    sig[60, 2] ^= 31
    group = np.sort(r.integers(0, 5, 400))
    i, j = nearcopies.close_pairs(sig, group, 52, stretch=1)
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if group[a] == group[b] and np.unpackbits(sig[a] ^ sig[b]).sum() <= 52}
    assert set(zip(i.tolist(), j.tolist())) == want
    assert len(nearcopies.close_pairs(sig[:0], group[:0], 5)[0]) == 0


def test_near_pairs_against_brute_force(spark):
    t = texts_with_edits(60, 5, [1, 3, 12, 40, 120])
    rows = [(f"p{i:04}", x, i) for i, x in enumerate(t)] + [("p0001", t[1], 1), (None, "x", 1), ("n", None, 1), ("e1", "", 1), ("e2", "?", 1)]
    d = spark.createDataFrame(rows, "passage_id string, text string, cls int")
    got = {tuple(r) for r in nearcopies.near_pairs(d).collect()}
    s = {k: runs_of(x) for k, x, _ in rows if k and x is not None}
    ks = sorted(s)
    want = {(a, b) for n, a in enumerate(ks) for b in ks[n + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.7}
    assert got == want
    g = {r.passage_id: r for r in nearcopies.groups(d, 0.7).collect()}
    assert set(g) == set(ks) and all(g[a].group_id == g[b].group_id for a, b in want)
    assert nearcopies.near_pairs(d.limit(0)).count() == 0


def test_hot_band_is_split(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        u = list(base)
        u[r.randrange(200)] = f"x{i}"
        rows.append((f"p{i:03}", " ".join(u)))
    d = spark.createDataFrame(rows, "passage_id string, text string").repartition(60)  # no partition repeats a key ten times
    c = nearcopies.classes(d)
    whole = {(x.a, x.b) for x in nearcopies.class_pairs(c, 0.7).collect()}
    parts = {(x.a, x.b) for x in nearcopies.class_pairs(c, 0.7, group=10).collect()}
    assert whole == parts and len(whole) == 120 * 119 // 2


def test_counters_count():
    r = np.random.default_rng(6)
    bits = r.random((100, 256)) < r.random(256)
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    c = nearcopies.Counters()
    for k in range(0, 100, 16):
        c.add(planes[k : k + 16])
    for radius in (0, 3, 50, 64, 99, 200):
        over = np.unpackbits(c.beyond(radius).view(np.uint8), bitorder="little").astype(bool)
        assert (over == (bits.sum(axis=0) > radius)).all()


def test_groups_recall_at_production_threshold(spark):
    t = texts_with_edits(400, 11, [30, 60, 120])
    d = spark.createDataFrame([(f"p{i:04}", x) for i, x in enumerate(t)], "passage_id string, text string")
    s = [runs_of(x) for x in t]
    of = collections.defaultdict(list)
    for i, x in enumerate(s):
        for run in x:
            of[run].append(i)
    near = {(a, b) for ks in of.values() for a in ks for b in ks if a < b}
    want = {(a, b) for a, b in near if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8}
    g = {int(r.passage_id[1:]): r.group_id for r in nearcopies.groups(d).collect()}
    assert len(want) > 300 and all(g[a] == g[b] for a, b in want)
    group = collections.defaultdict(set)
    for k, x in g.items():
        group[x].add(k)
    linked = collections.Counter(x for p in want for x in p)
    assert all(len(m) == 1 or all(linked[k] for k in m) for m in group.values())


# ---- 2 across splits
def cases(spark, rows):
    return spark.createDataFrame(rows, "case_id string, partition string, question string, group_id string, paired_with string, part int")


def test_cross_pairs_against_brute_force(spark):
    t = texts_with_edits(80, 9, [2, 8, 20, 25])
    r = random.Random(2)
    rows = [(f"c{i:04}", r.choice(["training", " Training", "final", "DEVELOPMENT ", None, "other"]), x, None, None, 1) for i, x in enumerate(t)]
    rows += [("c0001", rows[1][1], t[1], None, None, 1), (None, "final", t[0], None, None, 1), ("z", "final", None, None, None, 1)]
    d = cases(spark, rows)
    got = {tuple(x) for x in crosssplit.found(d).collect()}
    part = {k: (p or "").strip().lower() for k, p, *_ in rows if k}
    s = {k: runs_of(q) for k, _, q, *_ in rows if k and q is not None and part[k] in ("training", "development", "final")}
    want = {tuple(sorted((a, b))) for a in s for b in s if part[a] == "training" != part[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.7}
    assert got == want and want
    assert crosssplit.found(d.limit(0)).count() == 0
    rep = crosssplit.report(d).agg(F.sum("pairs"), F.sum("leaked")).first()
    assert rep[0] == len(want)


def questions(n, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(5))
    out = []
    for i in range(n):
        t = f"how does the {word()} of the {word()} specimen change when {word()} cells leave the {word()} margin after an injury at low temperature".split()
        out.append((f"a{i}", "training", " ".join(t), None, None, 1))
        if i % 10 == 0:
            out.append((f"b{i}", "final", " ".join(t[:-2]), None, None, 1))
        else:
            out.append((f"b{i}", "final", f"which {word()} cells of the {word()} touch the {word()} band and why is the {word()} border usually so here", None, None, 1))
    return out


def test_cross_pairs_write_little_for_each_case(spark, tmp_path):
    rows = questions(10_000)
    cases(spark, rows).repartition(8).write.parquet(f"{tmp_path}/cases")
    store, kept = spark.sparkContext._jsc.sc().statusStore(), Path(shared_folder(spark))

    def written_bytes():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        e = store.executorList(False)
        return sum(e.apply(i).totalShuffleWrite() for i in range(e.size())) + sum(x.stat().st_size for x in Path(kept.as_posix().removeprefix("file:")).rglob("*.parquet"))

    before = written_bytes()
    got = {tuple(x) for x in crosssplit.found(spark.read.parquet(f"{tmp_path}/cases")).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(0, 10_000, 10)}
    assert (written_bytes() - before) / len(rows) < 700  # a case takes some 170 bytes where it is stored, and four times that is the limit


@pytest.mark.parametrize("table, wanted", [(0, 4_000_000), (10, 4_000_000), (2_000_000, 0)])
def test_cross_pairs_beyond_what_tasks_hold(spark, monkeypatch, table, wanted):
    monkeypatch.setattr(crosssplit, "TABLE", table)
    monkeypatch.setattr(crosssplit, "WANTED", wanted)
    rows = questions(200) + [("c1", "training", "?", None, None, 1), ("c2", "final", "!", None, None, 1)] + [(f"d{i}", ("training", "final")[i % 2], "the same text again", None, None, 1) for i in range(20)]
    got = {tuple(x) for x in crosssplit.found(cases(spark, rows)).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(0, 200, 10)} | {("c1", "c2")} | {tuple(sorted((f"d{i}", f"d{j}"))) for i in range(0, 20, 2) for j in range(1, 20, 2)}


def test_signatures_differ_in_no_more_bits_than_the_sets():
    r = random.Random(3)
    t = ["", "x"] + [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 90))) for _ in range(200)]
    s, (sig, more) = [runs_of(x) for x in t], crosssplit.signatures(*words.grid(t))
    assert [x >> crosssplit.BITS for x in sig.tolist()] == [len(x) for x in s]
    bits = [(x & ((1 << crosssplit.BITS) - 1)) << 64 | y & ((1 << 64) - 1) for x, y in zip(sig.tolist(), more.tolist())]
    assert all((x ^ y).bit_count() <= len(p ^ q) for x, p in zip(bits, s) for y, q in zip(bits, s))
    assert max(x.bit_count() for x in bits) > 48


def test_chunks_cover_the_text_and_move_with_it():
    w, at = words.grid(["a b c d e f g h i j", "", "x", "new words in front a b c d e f g h i j"])
    for reach in (1, 2, 3):
        d, n, of = crosssplit.cut(w, at, 7, reach)
        assert len(d) == len(n) == of[-1] and [n[of[i] : of[i + 1]].sum() for i in range(4)] == [10, 0, 1, 14]
        first, last = d[of[0] : of[1]].tolist(), d[of[3] : of[4]].tolist()
        assert len(first) > 1 and len(set(first) & set(last)) >= len(first) - 2
    alone = [crosssplit.cut(*words.grid([t]), 7)[0].tolist() for t in ("x y z u", "a b c d e f g h i j")]
    both = crosssplit.cut(*words.grid(["x y z u", "a b c d e f g h i j"]), 7)[0].tolist()
    assert both == alone[0] + alone[1]


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_join_keys_lose_no_pair(hot):
    r = random.Random(hot)
    records = []
    for _ in range(150):
        chunks = {r.choice([r.randrange(6), r.randrange(60)]): 0 for _ in range(r.randint(1, 7))}
        records.append({c: 1 + c % 4 for c in chunks})
    n = collections.Counter(c for x in records for c in x)
    total = np.array([sum(x.values()) for x in records], np.int32)
    of = np.concatenate([[0], np.cumsum([len(x) for x in records])])
    flat = [(c, k, n[c]) for x in records for c, k in x.items()]
    key, row = crosssplit.join_keys(total, of, *(np.array(c, np.int64) for c in zip(*flat)), 0.5, hot)
    keys = collections.defaultdict(set)
    for k, i in zip(key.tolist(), row.tolist()):
        keys[i].add(k)
    for i in range(150):
        for j in range(i):
            if sum(k for c, k in records[i].items() if c in records[j]) >= 0.5 * max(total[i], total[j]):
                assert keys[i] & keys[j]


def test_recall_of_chunks_against_brute_force(spark):
    r = random.Random(8)
    stems = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstv"]
    rows = []
    for i in range(1500):  # templates with three changing words, then up to three edits
        a, b, c = r.sample(stems, 3)
        t = r.choice([f"how does the {a} of the {b} specimen change when cells leave the {c} margin after injury", f"explain why {a} fails in the {b} model although the border and the {c} rim stay branched", f"compare the {a} of the {b} region with that of the {c} region in the adult"]).split()
        rows.append((f"a{i}", "training", " ".join(t), None, None, 1))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], [r.choice(stems)], [t[k], r.choice(stems)]])
        rows.append((f"b{i}", r.choice(["final", "development"]), " ".join(t), None, None, 1))
    got = {tuple(x) for x in crosssplit.found(cases(spark, rows)).collect()}
    of = collections.defaultdict(lambda: ([], []))
    s = {x[0]: runs_of(x[2]) for x in rows}
    for k, x in s.items():
        for run in x:
            of[run][k[0] == "b"].append(k)
    near = {(x, y) for a, b in of.values() for x in a for y in b}
    want = {(x, y) for x, y in near if len(s[x] & s[y]) / len(s[x] | s[y]) >= 0.7}
    assert got <= want and len(got) >= 0.99 * len(want) > 600


# ---- 7 related records
def test_components_and_split(spark):
    r = random.Random(4)
    rows = [(f"c{i:03}", r.choice(["training", "Final ", None]), "q", r.choice([None, f"g{r.randrange(40)}", f" G{r.randrange(40)} "]), r.choice([None, None, f"c{r.randrange(300):03}", "gone"]), 1) for i in range(200)]
    rows += [rows[0], (None, "final", "q", "g1", None, 1)]
    d = cases(spark, rows)
    up: dict = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for c, _, _, g, m, _ in rows:
        if c:
            root("c" + c)
            if g:
                up[root("c" + c)] = root("g" + g.strip().lower())
            if m:
                up[root("c" + c)] = root("c" + m)
    parts = collections.defaultdict(set)
    for c, p, *_ in rows:
        if c and (p or "").strip().lower() in ("training", "development", "final"):
            parts[root("c" + c)].add(p.strip().lower())
    want = {c for c, *_ in rows if c and len(parts[root("c" + c)]) > 1}
    assert {x.case_id for x in components.found(d).collect()} == want
    a = components.assign(d).collect()
    assert len(a) == 200 and len({(root("c" + x.case_id), x.new_partition) for x in a}) == len({root("c" + x.case_id) for x in a})
    assert components.found(d.limit(0)).count() == 0 and components.assign(d.limit(0)).count() == 0


def test_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(300)], "u string, v string")
    assert {r.component for r in components.components(e).collect()} == {"n0000"}


def test_shares(spark):
    d = spark.range(20_000).select(components.share_of(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] / 20_000 for r in d}
    assert abs(n["training"] - 0.8) < 0.02 and abs(n["final"] - 0.1) < 0.02


# ---- 6 neighbours
def test_recall_and_copies(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 64))
    v = np.concatenate([c + r.normal(scale=0.3, size=(100, 64)) for c in centre]).astype(np.float32)
    v[600:900] = v[600]  # a quarter is one vector
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(0, v[0].tolist(), "x"), (5000, None, "x"), (5001, [0.0] * 64, "x"), (5002, [1.0] * 63, "x"), (5003, [float("nan")] * 64, "x"), (5004, [float("inf")] * 64, "x"), (None, v[3].tolist(), "x")]
    d = spark.createDataFrame(rows, "vector_row long, vector array<float>, ids string")
    got = {tuple(x) for x in neighbours.found(d).collect()}
    u = neighbours.unit(v)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    hit = n = 0
    for i in range(1200):
        if not 600 <= i < 900:
            for j in np.lexsort((np.arange(1200), -np.round(s[i], 12)))[:5]:
                n += 1
                hit += (min(i, j), max(i, j)) in got
    assert hit / n > 0.9
    assert {(600, 601), (600, 899), (604, 899)} <= got and (605, 899) not in got
    assert neighbours.found(d.limit(0)).count() == 0
    three = neighbours.neighbours(d.where("vector_row < 3")).collect()
    assert all(len(x.others) == 2 for x in three)


def clustered(n, seed, clusters=30, scale=0.25):
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, 64))
    return (c[r.integers(0, clusters, n)] + r.normal(scale=scale, size=(n, 64))).astype(np.float32)


def test_footrule_by_common_bits():
    u = neighbours.unit(clustered(90, 2)).astype(np.float32)
    pivots, length, step = u[:20], 8, 2
    code = neighbours.codes(u, pivots, length, step)
    perm = neighbours.permutations(u, pivots, length)
    weight = np.zeros((90, 20), int)
    for i, row in enumerate(perm):
        weight[i, row] = -(-(length - np.arange(length)) // step)
    for i, j in ((0, 1), (5, 80), (33, 34)):
        common = np.bitwise_count(code[:, i] & code[:, j]).sum()
        footrule = np.abs(weight[i] - weight[j]).sum()
        assert footrule == weight[i].sum() + weight[j].sum() - 2 * common
    near = neighbours.nearest_by_footrule(code, 10, 20, 15)
    for i, row in zip(range(10, 20), near):
        score = np.minimum(weight[i], weight).sum(axis=1)
        score[i] = 0
        assert i not in row and sorted(score[row]) == sorted(score)[-15:]


def test_ranking_in_a_file_keeps_within_its_memory():
    import tracemalloc

    v = clustered(neighbours.BLOCK, 3)
    tracemalloc.start()
    q, b, _ = neighbours.within(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    u = neighbours.unit(v)
    hit = 0
    for i in range(0, len(v), 100):
        s = u @ u[i]
        s[i] = -9
        hit += len(set(b[q == i]) & set(np.argsort(-s)[:5]))
    assert hit / (5 * len(v) / 100) > 0.9


@pytest.mark.parametrize("n,args", [(1_000, {}), (3_000, {}), (9_000, {}), (6_000, {"n_pivots": 8, "block": 600})])
def test_recall_at_sizes_and_levels(spark, n, args):
    v = clustered(n, n)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vector_row long, vector array<float>")
    got = {r.id: {o.id for o in r.others} for r in neighbours.neighbours(d, **args).collect()}
    u = neighbours.unit(v)
    hit = 0
    ask = range(0, n, 10)
    for i in ask:
        s = u @ u[i]
        s[i] = -9
        hit += len(got[i] & set(np.argsort(-s)[:5]))
    assert len(got) == n and hit / (5 * len(ask)) >= 0.95


# ---- 8 packing
def test_plan_uses_everything_once():
    r = np.random.default_rng(3)
    for n, cap in ((0, 10), (1, 10), (50, 10), (3000, 97), (500, 2048)):
        h = np.bincount(r.integers(1, cap + 1, n), minlength=cap + 1)
        used = np.zeros(cap + 1, int)
        for m, items in packing.plan(h, cap):
            assert sum(items) <= cap
            for x in items:
                used[x] += m
        assert (used == h).all()


def test_complement():
    c = np.zeros(50, np.int64)
    c[[5, 7, 20]] = 1, 2, 1
    assert packing._complement(20, c) == [20] and sorted(packing._complement(14, c)) == [7, 7] and sorted(packing._complement(19, c)) == [5, 7, 7] and packing._complement(11, c) is None


def test_pack(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["cell", "tissue", "vessel", "of", "the"]) for _ in range(r.randint(1, 60))), "x") for i in range(300)] + [(300, "", "x"), (301, None, "x"), (302, "cell " * 500, "x")] + [(400 + i, "same words here", "x") for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(7)
    p = packing.pack(d, 64).collect()
    assert len({x.doc_id for x in p}) == len(rows)
    assert all(x.sequence is None for x in p if x.doc_id in (300, 301))
    seq = collections.defaultdict(list)
    for x in p:
        if x.sequence is not None:
            seq[x.sequence].append(x)
    for s in seq.values():
        s.sort(key=lambda x: x.place)
        at = 0
        for k, x in enumerate(s):
            assert x.place == k + 1 and x.offset == at
            at += x.token_end - x.token_start
        assert at <= 64
    big = sorted((x.token_start, x.token_end) for x in p if x.doc_id == 302)
    assert big[0][0] == 0 and all(a[1] == b[0] for a, b in zip(big, big[1:])) and big[-1][1] == packing.count_tokens("cell " * 500)
    tokens = sum(x.token_end - x.token_start for x in p)
    assert len(seq) <= tokens / 64 * 1.05 + 1
    assert packing.pack(d.limit(0), 64).count() == 0


def test_long_text_counts(monkeypatch):
    t = "Some tissue holds 10 cells, and more. " * 300
    n = packing.count_tokens(t)
    monkeypatch.setattr(packing, "PART", 500)
    assert packing.count_tokens(t) == n


# ---- 9 leaks
def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 10, 14])))) for i in range(20)]
    docs = []
    for i in range(60):
        t = [r.choice(vocab) for _ in range(r.choice([0, 8, 30]))]
        for _ in range(r.randint(0, 2)):
            src = r.choice(items)[1].split()
            k = r.randint(0, max(0, len(src) - 10))
            t += src[k : k + r.choice([9, 10, 12])]
        docs.append((i, " ".join(t).replace("w1 ", "W​1 "), "x"))
    docs += [docs[0], (99, None, "x"), (98, "", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, k string")
    it = spark.createDataFrame([*items, items[0], (77, None)], "item_id long, text string")

    def grams(t):
        w = words.plain(t or "").split()
        return {tuple(w[k : k + 10]) for k in range(len(w) - 9)}

    want = {(a, b) for a, t, _ in docs for b, u in items if grams(t) & grams(u)}
    assert {tuple(x) for x in leaks.find_leaks(d, it).collect()} == want and want
    assert {tuple(x) for x in leaks.find_leaks(d, it, max_grams=0).collect()} == want
    gone = {x.doc_id: x for x in leaks.remove_leaks(d, it).collect()}
    assert set(gone) == {a for a, _ in want} and all(10 <= x.leaked_words <= x.words for x in gone.values())
    assert {tuple(x) for x in leaks.remove_leaks(d, it, max_grams=0).collect()} == {tuple(x) for x in gone.values()}
    assert leaks.find_leaks(leaks.remove_leaks(d, it), it).count() == 0
    assert leaks.find_leaks(d.limit(0), it).count() == 0 and leaks.find_leaks(d, it.limit(0)).count() == 0


def test_spans_are_cut_from_the_stored_text():
    t = "Кeep THIS, then: Ｏne two\u200b three; f\u00e9ur fe\u0301ur!  Stay \u2014 Here\r\n\u00cfx."
    w = [t[a:b] for a, b in leaks.word_places(t)]
    assert w == ["Кeep", "THIS", "then", "Ｏne", "two", "three", "f\u00e9ur", "fe\u0301ur", "Stay", "Here", "\u00cfx"]
    assert leaks.without(t, np.array([3, 4]), 3)[1:] == (11, 4)
    assert leaks.without(t, np.array([3, 4]), 3)[0] == "Кeep THIS, then: fe\u0301ur!  Stay \u2014 Here\r\n\u00cfx."
    assert leaks.without("a b c d", np.array([2]), 2)[0] == "a b " and leaks.without("a b c d", np.array([0]), 4) == ("", 4, 4)


# ---- 10 abuse
def test_gradient():
    r = np.random.default_rng(0)
    net = abuse.Network({f"w{i}": i for i in range(1, 9)})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grams = [[]] + [abuse.trigrams(f"w{i}") for i in range(1, 9)]
    own = np.arange(9)
    m = r.integers(1, 9, (6, abuse.WINDOW)).astype(np.int32)
    m[2, 5:] = 0
    y, weight = np.array([1, 0, 1, 0, 0, 1.0]), np.ones(6)
    _, g = net.gradient(own, grams, m, y, weight)
    for name in ("word", "char", "att", "out", "bias", "Wzf", "Urb", "Unf", "cnb"):
        idx = tuple(np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        old = net.p[name][idx]
        eps = 1e-3
        net.p[name][idx] = old + eps
        a, _ = net.gradient(own, grams, m, y, weight)
        net.p[name][idx] = old - eps
        b, _ = net.gradient(own, grams, m, y, weight)
        net.p[name][idx] = old
        assert g[name][idx] == pytest.approx((a - b) / (2 * eps), rel=0.05, abs=1e-6), name


@pytest.mark.parametrize("w, s", [("d-a-m-n", "damn"), ("st0p", "stop"), ("scccum", "scum"), ("idiiiota", "idiota"), ("spindle-shaped", "spindle-shaped"), ("1987", "1987"), ("fre$se", "frese")])
def test_skeleton(w, s):
    assert abuse.skeleton(w) == s


def test_windows_cover():
    for n in (0, 1, 24, 25, 36, 37, 100):
        w = abuse.windows(list(range(1, n + 1)))
        assert sorted({x for r in w for x in r}) == list(range(1, n + 1)) and all(len(r) <= abuse.WINDOW for r in w)


def test_held_out_accuracy(spark):
    r = random.Random(7)
    plain = [f"the {a} of the {b} holds {c} cells in a {d} layer" for a in ("wall", "lining", "coat") for b in ("liver", "skin", "lung") for c in ("pale", "tall") for d in ("thin", "thick")]
    bad = [f"you are a {a} {b} and nobody wants you here" for a in ("stupid", "useless", "filthy") for b in ("idiot", "moron", "fool", "clown")]
    docs, lab = [], []
    for i in range(600):
        t = [r.choice(plain) for _ in range(r.randint(1, 6))]
        y = int(i % 5 == 0)
        if y:
            t.insert(r.randint(0, len(t)), r.choice(bad))
        docs.append((i, ". ".join(t), f"s{i % 3}", 9))
        if i < 400:
            lab.append((i, 1 - y if i % 97 == 3 else y))
    docs += [(1000, None, None, 9), (1001, "", "s0", 9), (1002, "you are a st​upid id1ot and nobody wants you here", "s1", 9)]
    lab += [(5, 0), (7, None), (None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame(lab, "doc_id long, toxic int")
    net = abuse.fit(d, labels)
    s = {x.doc_id: x for x in abuse.score(d, net, "source").collect()}
    right = sum(s[i].flagged == (i % 5 == 0) for i in range(400, 600))
    assert right >= 196 and s[1000].score is None and s[1001].score == 0 and s[1002].flagged
    assert abuse.rates(d, labels).count() == 4
    assert abuse.found(d, labels.limit(0)).count() == 0 and abuse.found(d.limit(0), labels).count() == 0


def test_queries_registered(spark, sf):
    from brindle.llm import queries

    names = set(queries.QUERIES)
    assert {f"p{i}_found" for i in (1, 2, 4, 5, 6, 7, 9, 10)} <= names and "p8_packed" in names
    for n in ("p1_found", "p2_found", "p4_found", "p5_found", "p7_found", "p9_found"):
        queries.QUERIES[n](spark, sf).collect()


def test_hot_nodes_are_spread(spark, monkeypatch):
    rows = [(f"c{i:03}", "training" if i % 7 else "final", "q", "g" if i < 150 else f"g{i}", f"c{i - 150:03}" if i > 280 else None, 1) for i in range(300)]
    d = cases(spark, rows)
    plain = {x.case_id for x in components.found(d).collect()}, {(x.case_id, x.component) for x in components.assign(d).collect()}
    monkeypatch.setattr(components, "HOT", 20)
    assert ({x.case_id for x in components.found(d).collect()}, {(x.case_id, x.component) for x in components.assign(d).collect()}) == plain
    assert len(plain[0]) == 150 + 19
