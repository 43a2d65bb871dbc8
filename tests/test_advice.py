"""The whole job of queries whose SQL says only a part of it."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import corpus, ranking, units
from brindle.plans import retrieval, texts
from brindle.session import table

ITEMS = "query_id long, text string, terms array<string>"


def test_evidence_has_dense_candidates_threshold_selection_and_reasons(spark):
    rows = [(1, "red cell wall", "s", "t"), (2, "red cell wall", "s", "t"), (3, "red", "s", "t"), (4, "red cell wall", "z", None), (5, "red cell wall here", "s", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, title string")
    items = spark.createDataFrame([(1, "red cell wall", ["red", "cell", "wall"]), (2, "other", ["other"])], ITEMS)
    ok = docs.where("doc_id <> 5").select("doc_id")
    # 5 is not eligible, 2 repeats 1 in its source, 3 is below the threshold; 4 is another source
    got = sorted((r.query_id, r.doc_id, r.place, r.reason) for r in retrieval.evidence(docs, items, ok).where("doc_id IS NOT NULL").collect())
    assert got == [(1, 1, 1, "QUALIFYING_PASSAGES"), (1, 4, 2, "QUALIFYING_PASSAGES")]
    assert [r.reason for r in retrieval.evidence(docs, items, ok).where("doc_id IS NULL").collect()] == ["BELOW_THRESHOLD"]
    assert {r.reason for r in retrieval.evidence(docs, items, ok.limit(0)).collect()} == {"NO_ELIGIBLE_PASSAGES"}
    # nothing shares a word with item 2: its candidates come by vector
    f = retrieval.fused(docs, items, "doc_id", ok)
    assert f.where("query_id = 2").count() == 4
    assert retrieval.fused(docs.select(F.concat(F.lit("p"), "doc_id").alias("doc_id"), "text"), items, "doc_id").where("query_id = 2 AND doc_id = 'p5'").count() == 1


def tokens(s):
    return 2 + sum(max(1, (len(x) + 5) // 6) for x in re.findall(r"\w+|[^\w\s]", s))


def test_token_count_in_every_script(spark, sf):
    all_ = ["épithélium", "соединительная ткань", "上皮組織は", "a_b ½ x²", "blank\u00a0here\u3000and\x85there\x1fend", "e\u0301 x", "𝒜b\U0001f600", "", "plain words."]
    df = spark.createDataFrame([(s,) for s in all_], "t string").select("t", text.token_count(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {s: tokens(s) for s in all_}
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert {r.doc_id: r.tokens for r in texts.token_count(spark, sf).collect()} == {k: None if t is None else tokens(t) for k, t in docs.items()}


def test_dense_queries_are_the_stated_set(spark, sf):
    e = {r.vec_id: (r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()}

    def best(labels, k):
        out = set()
        for q in (x for x in e if x % 100 == 0):
            s = sorted((-round(float(np.dot(np.float64(e[q][0]), np.float64(v))), 9), i) for i, (v, lab) in e.items() if labels is None or lab in labels)
            out |= {(q, i, n + 1) for n, (_, i) in enumerate(s[:k])}
        return out

    assert {(r.query_id, r.vec_id, r.rank) for r in retrieval.dense_topk(spark, sf).collect()} == best(None, 30)
    assert {(r.query_id, r.vec_id, r.rank) for r in retrieval.dense_topk_filtered(spark, sf).collect()} == best({1, 3, 5}, 10)


def test_conflict_closure_reaches_its_fixpoint(spark):
    r = random.Random(5)
    chain = [(i, j) for i in range(30) for j in (i, i + 1)]  # thirty rounds
    loose = [(100 + i, 100 + r.randrange(80)) for i in range(40) for _ in range(2)]
    start = {(1, 0), (2, 15), (2, 999), (3, 105), (4, 998)} | {(5, 100 + i) for i in range(0, 80, 7)}
    want = set(start)
    while True:
        more = want | {(q, b) for q, p in want for k, a in chain + loose if a == p for n, b in chain + loose if n == k}
        if more == want:
            break
        want = more
    got = ranking.conflict_closure(spark.createDataFrame(sorted(start), "query_id long, passage_id long"), spark.createDataFrame(chain + loose, "record_id long, passage_id long"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_conflict_step_joins_sets_of_queries(spark):
    r = random.Random(9)
    ids = [-9_000_000_000, -129, -1, 0, 1, 63, 64, 127, 128, 9_000_000_000, None]
    records = [(r.randrange(40), r.randrange(60)) for _ in range(120)] + [(None, 3), (50, None), (7, 8), (7, 8)]
    start = [(r.choice(ids), r.randrange(70)) for _ in range(60)] + [(1, None), (64, 5), (64, 5)]
    want = set(start) | {(q, b) for q, p in start if p is not None for k, a in records if a == p and k is not None for n, b in records if n == k}
    for kind, of in (("long", lambda q: q), ("string", lambda q: None if q is None else f"q{q}")):
        d = spark.createDataFrame([(of(q), p) for q, p in start], f"query_id {kind}, passage_id long")
        got = ranking.conflict_step(d, spark.createDataFrame(records, "record_id long, passage_id long"))
        assert got.schema["query_id"].dataType == d.schema["query_id"].dataType
        assert sorted(str(tuple(x)) for x in got.collect()) == sorted(str((of(q), p)) for q, p in want)


def test_conflict_step_joins_no_row_for_each_query_and_record(spark):
    records = spark.createDataFrame([(i, j) for i in range(200) for j in (0, 1 + i)], "record_id long, passage_id long")
    got = ranking.conflict_step(spark.createDataFrame([(q, 0) for q in range(100)], "query_id long, passage_id long"), records)
    assert len(got.collect()) == 100 * 201

    def joined(node):
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        return node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0, *(x for n in below for x in joined(n))

    assert 0 < max(joined(got._jdf.queryExecution().executedPlan())) <= 400  # with a row for each query and record 20,000


def test_selection_brings_in_every_side_of_a_conflict(spark):
    c = spark.createDataFrame(
        [(q, f"p{i}", f"s{i}", "x", f"h{i}", None, 9.0 - i, 0.1) for q in range(1, 4) for i in range(8) if q != 2 or i != 7],
        "query_id long, passage_id string, source string, section string, text_sha string, spans array<struct<block:string,start:int,end:int>>, logit double, rrf double",
    )  # p0 to p4 come first; k1 draws in p6, and p6 by k2 p7
    k = spark.createDataFrame([("k1", "a", "p1", True), ("k1", "b", "p6", True), ("k2", "a", "p6", True), ("k2", "b", "p7", True)], "conflict_id string, side string, passage_id string, approved boolean")
    got = {}
    for r in ranking.select_evidence(c, 0.0, conflicts=k).orderBy("place").collect():
        got.setdefault(r.query_id, []).append((r.passage_id, r.error))
    assert [p for p, _ in got[1]] == ["p0", "p1", "p2", "p6", "p7"] == [p for p, _ in got[3]]
    assert got[2] == [(None, "CONFLICT_EVIDENCE_INCOMPLETE")]
    bad = ranking.select_evidence(c, 0.0, conflicts=k.withColumn("approved", F.lit(None).cast("boolean"))).collect()
    assert [r.error for r in bad] == ["CONFLICT_EVIDENCE_INCOMPLETE"] * 3
    many = spark.createDataFrame([("k", str(i), f"p{i}", True) for i in range(6)], k.schema)
    assert {r.error for r in ranking.select_evidence(c, 0.0, conflicts=many).collect()} == {"CONFLICT_EVIDENCE_INCOMPLETE"}


def test_group_split_keeps_families_whole(spark):
    rows = [(i, i // 2 if i < 200 else None, f"Text {i}" if i % 10 else f"copy, {i // 40}", "a" if i < 150 else "b") for i in range(400)] + [(400, None, None, "b")]
    d = spark.createDataFrame(rows, "id long, g long, t string, s string")
    got = {r.id: r for r in corpus.group_split(d, "id", "g", "t", "s", [("x", 0.6), ("y", 0.4)]).collect()}
    assert len(got) == 401
    first, root = {}, {r[0]: r[0] for r in rows}
    for i, g, t, _ in rows:
        for k in (("g", g), ("t", t)):
            if k[1] is not None:
                a, b = root[i], root[first.setdefault(k, i)]
                root.update({x: min(a, b) for x, y in root.items() if y in (a, b)})
    assert len({(root[i], r.family) for i, r in got.items()}) == len(set(root.values())) == len({r.family for r in got.values()})
    assert len({(r.family, r.split) for r in got.values()}) == len({r.family for r in got.values()})
    parts = [r.split for r in {r.family: r for r in got.values()}.values()]
    assert abs(parts.count("x") - 0.6 * len(parts)) <= 1


def test_values_too_large_are_kept(spark):
    p = spark.createDataFrame([("a", "s", "It is 5 × 10^16 kg, 2 kg, then 1e400 kg."), ("b", "s", "4e15 mg")], "passage_id string, source_id string, text string")
    u = spark.createDataFrame([("kg", "kg", "mass", "mg"), ("mg", "mg", "mass", "mg")], "alias string, unit string, dimension string, common_unit string")
    assert sorted((r.value, r.value_milli, r.too_large) for r in units.quantities(p, u).collect()) == [(2.0, 2_000_000_000, False), (4e15, 4 * 10**18, False), (5e16, None, True), (float("inf"), None, True)]
    assert {(r.passage_id, r.value_milli) for r in units.found(p, u).collect()} == {("a", 2_000_000_000), ("a", None), ("b", 4 * 10**18)}


def test_bare_numbers_are_inferred_or_flagged(spark):
    rows = [(f"a{i}", "s", f"A dose of {10 + i % 7} mg/kg, {20 + i % 5} mg left.") for i in range(40)]
    rows += [("c", "s", "| Mass | Other |\n| --- | --- |\n| 21 | 4 |"), ("d", "s", "We gave 12 as the dose."), ("e", "s", "Doses:\n- 13"), ("z", "s", "The mass was 0 or 5e12 there.")]
    p = spark.createDataFrame(rows, "passage_id string, source_id string, text string")
    u = spark.createDataFrame([("mg", "mg", "mass", "mg"), ("mg/kg", "mg/kg", "dose", "mg/kg")], "alias string, unit string, dimension string, common_unit string")
    got = {(r.passage_id, r.value, r.unit, r.uncertain) for r in units.infer_units(p, u).where("passage_id NOT LIKE 'a%'").collect()}
    assert got == {("c", 21.0, "mg", False), ("c", 4.0, None, True), ("d", 12.0, "mg/kg", False), ("e", 13.0, "mg/kg", False), ("z", 0.0, None, True), ("z", 5e12, None, True)}
