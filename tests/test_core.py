import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import hashing, metrics, rules, text, vector
from brindle.operators import chunker, corpus, events, lexical, ranking, relations
from brindle.sources import markdown, register, sinks, snapshot


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr).first()[0]


def test_rrf_worked_values(spark):
    a = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "query_id long, k string, score double")
    b = spark.createDataFrame([(1, "a", 9.0), (1, "c", 1.0), (1, "a", 3.0)], "query_id long, k string, score double")
    r = {x.k: x.score for x in ranking.rrf([a, b], "k").collect()}
    assert r["a"] == pytest.approx(2 / 61) and r["b"] == pytest.approx(1 / 62)
    x = spark.createDataFrame([(1, "b", 1.0)], "query_id long, k string, score double")
    y = spark.createDataFrame([(1, "a", 1.0)], "query_id long, k string, score double")
    assert [r.k for r in ranking.rrf([x, y], "k").orderBy("rank").collect()] == ["a", "b"]


def test_bm25_filter_changes_no_score(spark):
    d = spark.createDataFrame([(1, "red cell"), (2, "red red tissue"), (3, "blue"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, ["red"])], "query_id long, terms array<string>")
    full = {r.doc_id: r.score for r in lexical.bm25(d, q).collect()}
    only = {r.doc_id: r.score for r in lexical.bm25(d, q, eligible=d.where("doc_id = 2")).collect()}
    assert set(full) == {1, 2} and only == {2: full[2]}


def test_selection(spark):
    rows = [
        (1, "p1", "s", "x", "h1", [("b", 0, 100)], 3.0, 0.1), (1, "p2", "s", "x", "h2", [("b", 10, 100)], 2.0, 0.1), (1, "p3", "t", "x", "h1", [("b", 0, 100)], 1.5, 0.1),
        (1, "p4", "s", "x", "h4", [("b", 95, 200)], 1.0, 0.1), (1, "p5", "s", "x", "h5", [("c", 0, 9)], 0.5, 0.1), (1, "p6", "s", "x", "h6", None, 0.49, 0.1),
    ]
    c = spark.createDataFrame(rows, "query_id long, passage_id string, source string, section string, text_sha string, spans array<struct<block:string,start:int,end:int>>, logit double, rrf double")
    assert [r.passage_id for r in ranking.select_evidence(c, 0.5).orderBy("place").collect()] == ["p1", "p3", "p4", "p5"]
    with pytest.raises(ValueError):
        ranking.select_evidence(c, None)


def test_dense_top_k_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    r = ranking.dense_top_k(v, [(7, [1.0, 0.0])], 3).orderBy("rank").collect()
    assert [x.vec_id for x in r] == [19, 18, 17]


def test_reuse_vectors(spark):
    import hashlib

    q = spark.createDataFrame([(1, "m1", "hello"), (2, "m2", "hello"), (3, "m1", "x"), (4, None, "hello")], "i int, model string, t string")
    s = spark.createDataFrame([("m1", hashlib.sha256(b"hello").hexdigest(), [1.0])], "model string, text_sha256 string, v array<double>")
    assert {r.i: r.v for r in ranking.reuse_vectors(q, s, ["model"], "t", "v").collect()} == {1: [1.0], 2: None, 3: None, 4: None}


def test_metrics(spark):
    lo, hi = metrics.wilson(F.lit(190.0), F.lit(200.0))
    r = spark.range(1).select(lo, hi, metrics.zero_miss_bound(F.lit(100)), metrics.bin_of(F.lit(0.3)), metrics.wilson(F.lit(0.0), F.lit(0.0))[0]).first()
    assert round(r[0], 3) == 0.910 and round(r[1], 3) == 0.973 and round(r[2], 4) == 0.0295 and r[3] == 2 and r[4] is None


def test_text(spark):
    assert one(spark, text.match_terms(F.lit("The cell; the CELL or DROP TABLE"))) == ["the", "cell", "or", "drop", "table"]
    assert one(spark, text.match_terms(F.lit("?!"))) is None
    assert one(spark, text.sentences(F.lit("See Fig. 3 here. Cf. the other. End!"))) == ["See Fig. 3 here.", "Cf. the other.", "End!"]
    assert one(spark, text.shingles(F.split(F.lit("a b c d"), " "))) == ["a b c", "b c d"]
    assert one(spark, text.shingles(F.split(F.lit("a b"), " "))) == ["a b"]
    assert one(spark, text.slug(F.lit("  Äb C--d "))) == "b-c-d" and one(spark, text.slug(F.lit("??"))) == "section"
    assert one(spark, text.html_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    for s, p in [("One.", None), ("One. Two.", "multiple_sentences"), ("a\nb.", "multiline"), (" a.", "surrounding_whitespace"), ("**a**.", "markup"), ("a", "no_terminal_punctuation")]:
        assert one(spark, text.sentence_problem(F.lit(s))) == p
    assert one(spark, text.gate_normal(F.col("t")), t="ﬁ​n\r\n\n\n\nx")["text"] == "fin\n\nx"
    assert one(spark, text.gate_normal(F.col("t")), t="a\x00")["error"] == "control_character"


def test_rules(spark):
    assert rules.merged([(0, 5, "PHONE"), (3, 9, "ID"), (20, 22, "EMAIL")]) == [(0, 9, "PHONE"), (20, 22, "EMAIL")]
    r = one(spark, rules.redact(F.col("t")), t="Mail a.b@c.org or phone 555-123-45-67.")
    assert r["text"] == "Mail [EMAIL] or phone [PHONE]." and r["categories"] == "EMAIL,PHONE"
    r = one(spark, rules.redact(F.col("t")), t="My name is Ada Lovelace Has a cold; Dr. Who called. The student The Cell.")
    assert r["text"] == "My name is [PERSON] Has a cold; Dr. [PERSON] called. The student The Cell." and r["categories"] == "PERSON"
    assert [one(spark, rules.control_syntax(F.lit(t))) for t in ("<|im_start|>", "</think>", "a < b | c > d")] == [True, True, False]
    assert one(spark, rules.cue_flags(F.lit("No 5 mm left of it"))["high_risk"])


def test_hashing(spark):
    import hashlib
    import uuid

    assert one(spark, hashing.event_uuid(F.lit("x"))) == str(uuid.uuid5(uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), "x"))
    assert one(spark, hashing.canonical_digest(b=F.lit(1), a=F.lit("x"))) == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()
    v = one(spark, hashing.hashed_features(F.col("t")), t="one two one")
    assert abs(sum(x * x for x in v) - 1) < 1e-5
    assert one(spark, hashing.hashed_features(F.col("t")), t="?") is None


def test_vector(spark):
    assert one(spark, vector.problem(F.array(F.lit(3.0), F.lit(4.0)), 2)) == "norm"
    assert one(spark, vector.problem(F.array(F.lit(float("nan")), F.lit(1.0)), 2)) == "not_finite"
    assert sum(one(spark, vector.softmax(F.array(F.lit(1000.0), F.lit(1.0))))) == pytest.approx(1)


def test_relations(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", None)], "k string, v string")
    gone = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    assert sorted(tuple(r) for r in relations.revoke(rows, gone, "k", "v").collect()) == [("a", "2"), ("c", None)]
    sets = spark.createDataFrame([("i", 0, "x"), ("i", 0, "y"), ("i", 1, "x"), ("j", 0, "z")], "item string, pos int, m string")
    use = spark.createDataFrame([("x",)], "m string")
    assert [tuple(r) for r in relations.first_complete(sets, use, "item", "pos", "m").collect()] == [("i", 1, 1)]
    spans = spark.createDataFrame([("b", "p", 0, 100), ("b", "q", 10, 100), ("b", "r", 90, 200)], "b string, k string, s int, e int")
    assert [(r.k_a, r.k_b) for r in relations.span_overlaps(spans, "b", "k", "s", "e", 0.8).collect()] == [("p", "q")]
    c = spark.createDataFrame([(1, "x"), (2, None), (3, "w"), (4, "y")], "n int, p string")
    e = spark.createDataFrame([("x", True), ("y", None)], "p string, ok boolean")
    assert {r.n: r.problem for r in relations.check_citations(c, e, "p", "ok").collect()} == {1: None, 2: "missing", 3: "unknown", 4: "ineligible"}


def test_sessions_and_streaks(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", True), (1, 2, "2024-01-01 00:29:59", True), (1, 3, "2024-01-01 00:59:59", False), (1, 4, "2024-01-01 01:00:00", True)], "u int, i int, t string, ok boolean").withColumn("ts", F.to_timestamp("t"))
    assert [r.session for r in events.sessions(e, "u", "ts", "i").orderBy("i").collect()] == [1, 1, 2, 2]
    s = events.streaks(e, ["u"], "ts", "i", F.col("ok")).orderBy("i").collect()
    assert [r.streak for r in s] == [1, 2, 0, 1]
    assert [(r.due - r.ts).total_seconds() for r in s] == [86400, 3 * 86400, 600, 86400]


def test_idempotency(spark):
    r = spark.createDataFrame([(1, "o", "k", "x"), (2, "o", "k", "x"), (3, "o", "k", "y"), (4, "o", None, "x"), (5, "o", None, "z")], "i int, o string, k string, b string")
    assert [x.outcome for x in events.idempotency(r, ["o", "k"], ["i"], "b").orderBy("i").collect()] == ["first", "replay", "conflict", "first", "first"]


def test_near_links_and_components(spark):
    base = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, base), (2, base + " x"), (3, base), (4, "other words entirely here now"), (5, None)], "k long, t string")
    assert [(r.k_a, r.k_b) for r in corpus.near_links(d, "k", "t").collect()] == [(1, 2)]
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), (None, "x")], "u string, v string")
    assert {r.node: r.root for r in corpus.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_stratified_split(spark):
    d = spark.range(1000).withColumn("s", F.when(F.col("id") < 400, "a").otherwise("b"))
    n = {(r.s, r.split): r["count"] for r in corpus.stratified_split(d, "id", "s", [("x", 0.6), ("y", 0.15), ("z", 0.25)]).groupBy("s", "split").count().collect()}
    assert n == {("a", "x"): 240, ("a", "y"): 60, ("a", "z"): 100, ("b", "x"): 360, ("b", "y"): 90, ("b", "z"): 150}


def test_markdown_and_chunks(spark):
    raw = "# A\nline one\nline two\n\n- x\n- y\n\n## B {x}\n| a | b |\n\nCaption: shown {#own}\n\n# C\ntext."
    b = list(markdown.parse(raw))
    assert [(x[0], x[1], x[3]) for x in b] == [("a-b1", "paragraph", ["A"]), ("a-b2", "list", ["A"]), ("a-b-x-b1", "table", ["A", "B {x}"]), ("own", "caption", ["A", "B {x}"]), ("c-b1", "paragraph", ["C"])]
    long = " ".join(f"Sentence number {i} tells of some tissue." for i in range(60))
    df = spark.createDataFrame([("d", "# H\n" + long), ("n", None)], "k string, t string")
    assert markdown.blocks(df, "k", "t").count() == 1
    c = chunker.chunk(df, "k", "t").orderBy("chunk").collect()
    assert len(c) > 3 and all(chunker.tokens(x.text) <= chunker.MOST for x in c)
    assert all(a.spans[-1].start >= z.spans[0].start for a, z in zip(c, c[1:]))
    with pytest.raises(ValueError):
        markdown.json_blocks('{"blocks": [], "blocks": []}')
    with pytest.raises(ValueError):
        markdown.json_blocks('{"blocks": []} x')


def test_register_and_paths(spark, tmp_path):
    f = tmp_path / "r.json"
    f.write_text(json.dumps({"sources": [{"source_id": "a", "source_version": "1", "course_ids": ["c"]}, {"source_id": "b", "source_version": "1"}]}))
    r = register.read_register(spark, str(f))
    assert r.count() == 2 and len(r.columns) == 27
    f2 = tmp_path / "d.json"
    f2.write_text(json.dumps({"sources": [{"source_id": "a", "source_version": "1"}] * 2}))
    with pytest.raises(register.DuplicateKey):
        register.read_register(spark, str(f2))
    (tmp_path / "x.md").write_text("hi")
    assert register.resolve(str(tmp_path), "x.md", "markdown", 10).name == "x.md"
    for ref, why in [("../x.md", "outside_root"), ("http://a/x.md", "not_relative"), ("y.md", "no_file"), ("r.json", "format")]:
        with pytest.raises(ValueError, match=why):
            register.resolve(str(tmp_path), ref, "markdown", 10_000)


def test_snapshot(spark, tmp_path):
    root, t = str(tmp_path), {"p": spark.range(5)}
    snapshot.build(root, "v1", t)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.build(root, "v1", t)
    with pytest.raises(snapshot.SnapshotError, match="bad"):
        snapshot.build(root, "v2", t, [lambda x: "bad"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v1"]
    snapshot.activate(root, "v1")
    snapshot.build(root, "v2", {"p": spark.range(7)})
    snapshot.activate(root, "v2")
    assert snapshot.pin(spark, root)[1]["p"].count() == 7
    assert snapshot.rollback(root) == "v1" and snapshot.pin(spark, root)[0] == "v1"
    part = next((tmp_path / "v2" / "p").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.activate(root, "v2")


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.append_log(spark.range(1).withColumn("text", F.lit("x")), str(tmp_path / "l"), ["id"])
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in sinks.insert_or_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    s = sinks.revoke(str(tmp_path / "r.json"), "a", "1")
    s = sinks.revoke(str(tmp_path / "r.json"), "a", None)
    assert s == {"epoch": 2, "revoked": {"a": None}}


def test_streaming_sessions(spark, tmp_path):
    from brindle.streaming import logs

    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 00:40:00"), (2, "2024-01-01 00:00:00"), (9, "2024-01-03 00:00:00")], "u int, t string").select("u", F.to_timestamp("t").alias("ts"), F.monotonically_increasing_id().alias("i"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = logs.read(spark, str(tmp_path / "in"), e.schema)
    logs.run_all(logs.sessions(src, "u", "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.schema("user string, begin long, end long, n long").parquet(str(tmp_path / "out"))
    assert sorted((r.user, r.n) for r in got.collect())[:3] == [("1", 1), ("1", 2), ("2", 1)]
    logs.run_all(logs.first_events(src, "i", "ts"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 5
    logs.run_all(logs.daily_counts(src, "u", "ts"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).count() >= 2
    logs.append_batches(src, str(tmp_path / "o4"), str(tmp_path / "c4"), ["u"])
    assert spark.read.json(str(tmp_path / "o4")).count() == 5


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert e.entry(spark).count() > 0


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([], "query_id long, terms array<string>")
    assert lexical.bm25(d, q).count() == 0
    assert corpus.near_links(d, "doc_id", "text").count() == 0
    assert markdown.blocks(d, "doc_id", "text").count() == 0
    assert corpus.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_bm25_blocks_equal_the_join(spark, sf):
    from brindle.functions.text import match_terms
    from brindle.session import table

    docs = table(spark, sf, "documents")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), match_terms(F.col("text")).alias("terms")).where("query_id % 20 = 0")
    ok = docs.where("doc_id % 3 <> 0").select("doc_id")
    a = ranking.top_k(lexical.bm25(docs, q, eligible=ok), 7, "score", "doc_id")
    b = lexical.bm25_top_k(docs, q, 7, eligible=ok)
    key = lambda r: (r.query_id, r.rank, r.doc_id, r.score)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert lexical.bm25_top_k(docs.limit(0), q, 7).count() == 0


def test_exact_percentiles(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in r.lognormal(2, 1, 501)] + [("b", 3.0)] * 7 + [(None, 1.0), (None, 2.0), ("c", None), ("d", float("nan")), ("e", -5.0)]
    d = spark.createDataFrame(rows, "k string, x double")
    points = {"p50": (0.5, True), "p99": (0.99, True), "near": (0.95, False)}
    got = {x.k: x for x in events.exact_percentiles(d, "k", "x", points, bins=16).collect()}
    a = np.sort([x for k, x in rows if k == "a"])
    assert set(got) == {"a", "b", "e", None} and got["b"].p50 == got["b"].near == 3.0 and got[None].p50 == 1.5 and got["e"].p99 == -5.0
    assert abs(got["a"].p50 - np.quantile(a, 0.5)) < 1e-9 and abs(got["a"].p99 - np.quantile(a, 0.99)) < 1e-9 and got["a"].near == a[int(np.ceil(501 * 0.95)) - 1]
    assert events.exact_percentiles(d.limit(0), "k", "x", points).count() == 0


def test_span_overlaps_of_uneven_lengths(spark):
    import random

    r = random.Random(2)
    rows = [(r.choice("xy"), i % 40, s, s + r.choice([0, 1, 3, 9, 200])) for i, s in ((i, r.randrange(-300, 300)) for i in range(160))]
    d = spark.createDataFrame(rows, "b string, k int, s int, e int")
    shared, total = {}, {}
    for b, k, s, e in rows:
        total[k] = total.get(k, 0) + e - s
        for b2, k2, s2, e2 in rows:
            if b == b2 and k < k2 and s < e and s2 < e2 and s < e2 and s2 < e:
                shared[k, k2] = shared.get((k, k2), 0) + min(e, e2) - max(s, s2)
    want = {p: n for p, n in shared.items() if n / min(total[p[0]], total[p[1]]) >= 0.3}
    assert {(x.k_a, x.k_b): x.shared for x in relations.span_overlaps(d, "b", "k", "s", "e", 0.3).collect()} == want and want
    assert relations.span_overlaps(d.limit(0), "b", "k", "s", "e", 0.3).count() == 0


def test_sentences_and_their_spans_agree(spark):
    for t in ("See Fig. 3 here. then more. \"So?\" It is (approx. 5). 7 follow! Ünder. x", "", "One", "A.  B.\n\nC", " Lead. Tail. "):
        assert [t[a:b].strip() for a, b in chunker.sentence_spans(t)] == one(spark, text.sentences(F.lit(t)))
