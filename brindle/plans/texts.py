"""Text function and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import hashing, rules, text
from brindle.plans.registry import query
from brindle.session import table


@query("""
    WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
    e AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM w),
    f AS (SELECT item_id, t, min(pos) AS pos, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS r FROM e GROUP BY item_id, t)
    SELECT item_id, string_agg(t, ' ' ORDER BY pos) AS terms FROM f WHERE r <= 64 GROUP BY item_id""")
def query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", text.match_terms(F.col("text"))).alias("terms")).where("terms <> ''")


@query("""
    SELECT doc_id, 2 + coalesce(CAST(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]'), lambda x: greatest(1, (length(x) + 5) // 6))) AS BIGINT), 0) AS tokens
    FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def token_count(spark, sf):
    """X05 of every document, whatever its script."""
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).cast("long").alias("tokens"))


@query("""
    SELECT item_id, CASE WHEN length(text) > 200 THEN 'too_long' WHEN len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) = 0 THEN 'no_content'
           WHEN len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 25 THEN 'too_many_tokens' ELSE 'ok' END AS verdict FROM benchmark""")
def query_guard(spark, sf):
    n = F.size(text.words(F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", F.when(F.length("text") > 200, "too_long").when(n == 0, "no_content").when(n > 25, "too_many_tokens").otherwise("ok").alias("verdict"))


@query("""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\p{Cf}', '', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t\\x{A0}]+', ' ', 'g'), '(?m)^ | $', '', 'g')) AS digest FROM documents""")
def normalize_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_ws(F.col("text"))).alias("digest"))


@query("SELECT passage_id, md5(nfc_normalize(text)) AS digest FROM passages")
def normal_form(spark, sf):
    return table(spark, sf, "passages").select("passage_id", F.md5(text.normal_form(F.col("text"))).alias("digest"))


@query()
def gate_normalize(spark, sf):
    n = table(spark, sf, "synthetic").select("case_id", text.gate_normal(F.col("question")).alias("n"))
    return n.select("case_id", "n.text", "n.error")


@query("SELECT case_id, translate(lower(question), '‘’‚‛“”„‟', '''''''''\"\"\"\"') AS view FROM synthetic")
def folded_view(spark, sf):
    return table(spark, sf, "synthetic").select("case_id", text.folded(F.col("question")).alias("view"))


ABBREVIATED = "|".join(a[:-1].replace(".", r"\.") for a in text.ABBREVIATIONS)


@query(rf"""
    WITH a AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(t, '(^|\s)((?i:{ABBREVIATED}))\.(\s)', '\1\2' || chr(1) || '\3', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(t, '(^|\s)((?i:{ABBREVIATED}))\.(\s)', '\1\2' || chr(1) || '\3', 'g') AS t FROM b),
    d AS (SELECT doc_id, regexp_replace(t, '([.!?]["'')\]]{{0,9}})\s+(["''(\[\p{{Lu}}\p{{Nd}}])', '\1' || chr(2) || '\2', 'g') AS t FROM c),
    e AS (SELECT doc_id, list_filter(string_split(d.t, chr(2)), lambda x: x <> '') AS s FROM d)
    SELECT doc_id, CASE WHEN s IS NULL THEN NULL ELSE len(s) END AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM e""")
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query("""
    SELECT item_id, len(list_filter(list_transform(string_split_regex(text, '(?i)[,;:()]|\\b(?:and|or|but|whereas|while|which|although)\\b'), lambda x: trim(x)), lambda x: x <> '')) AS clauses
    FROM benchmark""")
def clause_split(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(text.clauses(F.col("text"))).cast("long").alias("clauses"))


STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""
    WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
    n AS (SELECT doc_id, CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS w FROM e WHERE length(w) > 1 AND w NOT IN ({STOPS}))
    SELECT doc_id, count(DISTINCT w) AS content FROM n GROUP BY doc_id""")
def content_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.content_tokens(F.col("text"))).cast("long").alias("content")).where("content > 0")


@query("""
    WITH t AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS t FROM benchmark),
    g AS (SELECT item_id, unnest(list_transform(range(greatest(len(t) - 2, 1)), lambda i: array_to_string(t[i + 1:i + 3], ' '))) AS s FROM t)
    SELECT item_id, count(DISTINCT s) AS shingles, min(s) AS first FROM g GROUP BY item_id""")
def shingles(spark, sf):
    s = text.shingles(F.split(text.split_key(F.col("text")), " "))
    return table(spark, sf, "benchmark").select("item_id", s.alias("s")).select("item_id", F.size("s").cast("long").alias("shingles"), F.array_min("s").alias("first"))


@query("""
    SELECT passage_id, left(CASE WHEN s = '' THEN 'section' ELSE s END, 80) AS slug
    FROM (SELECT passage_id, lower(regexp_replace(regexp_replace(heading, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM passages)""")
def slug(spark, sf):
    return table(spark, sf, "passages").select("passage_id", text.slug(F.col("heading")).alias("slug"))


@query("""
    SELECT passage_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM passages""")
def html_escape(spark, sf):
    return table(spark, sf, "passages").select("passage_id", F.md5(text.html_escape(F.col("text"))).alias("escaped"))


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)<\\s*/?\\s*[a-zA-Z][^>]*>|javascript:') THEN 'active_html'
           WHEN regexp_matches(text, '(?i)\\]\\(\\s*(?:https?:|//|ftp:|data:)') THEN 'remote_link' END AS problem FROM documents""")
def unsafe_markup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.unsafe_markup(F.col("text")).alias("problem"))


@query("""
    SELECT case_id, CASE WHEN regexp_matches(question, '[\\n\\r\\t]') THEN 'multiline' WHEN question <> trim(question) THEN 'surrounding_whitespace'
      WHEN regexp_matches(question, '<\\s*/?\\s*[a-zA-Z][^>]*>|`|^\\s*#{1,6}\\s|^\\s*(?:[-*+]\\s|\\d+[.)]\\s)|\\||\\[[^\\]]*\\]\\([^)]*\\)|(?i:\\b(?:https?://|www\\.))|\\*\\*|__') THEN 'markup'
      WHEN NOT regexp_matches(question, '[.!?]["'')\\]]*$') THEN 'no_terminal_punctuation' ELSE 'rest' END AS problem FROM synthetic""")
def sentence_problem(spark, sf):
    """X14; the checks that look around (sentence breaks) are put together as 'rest' to be comparable."""
    p = text.sentence_problem(F.col("question"))
    return table(spark, sf, "synthetic").select("case_id", F.when(p.isin("multiline", "surrounding_whitespace", "markup", "no_terminal_punctuation"), p).otherwise("rest").alias("problem"))


@query()
def sentence_checks(spark, sf):
    return table(spark, sf, "synthetic").select("case_id", text.sentence_problem(F.col("question")).alias("problem"))


CUE_SQL = ", ".join(f"regexp_matches(lower(text), '{p}') AS {k}" for k, p in rules.CUES.items())


@query(f"SELECT doc_id, {CUE_SQL}, {' OR '.join(f'''regexp_matches(lower(text), '{rules.CUES[k]}')''' for k in rules.HIGH_RISK)} AS high_risk FROM documents")
def cue_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(c.alias(k) for k, c in rules.cue_flags(F.col("text")).items()))


@query()
def pii_counts(spark, sf):
    """Spans of structured personal data in every benchmark item, by category."""
    r = table(spark, sf, "benchmark").select("item_id", F.explode(rules.span_categories(F.col("text"))).alias("category"))
    return r.groupBy("item_id", "category").agg(F.count("*").alias("spans"))


@query()
def redact(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", rules.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("digest"), "r.categories")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def doc_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.text_digest(F.col("text")).alias("digest"))


@query("""
    SELECT doc_id, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""")
def canonical_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.canonical_digest(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("digest"))


@query("""
    SELECT doc_id, 'psg-' || left(sha256('{"doc_id":' || doc_id || ',"text_sha256":"' || sha256(text) || '"}'), 40) AS passage_id FROM documents""")
def passage_id(spark, sf):
    d = hashing.canonical_digest(doc_id=F.col("doc_id"), text_sha256=F.sha2("text", 256))
    return table(spark, sf, "documents").select("doc_id", hashing.passage_id(d).alias("passage_id"))


@query("SELECT DISTINCT owner_code, left(sha256('owner:' || owner_code), 16) AS ref FROM requests WHERE owner_code IS NOT NULL")
def owner_ref(spark, sf):
    return table(spark, sf, "requests").select("owner_code").where("owner_code IS NOT NULL").distinct().select("owner_code", hashing.reference(F.col("owner_code"), "owner:").alias("ref"))


@query()
def keyed_ref(spark, sf):
    return table(spark, sf, "requests").select("owner_code").distinct().select("owner_code", hashing.keyed_reference(F.col("owner_code"), b"test key").alias("ref"), hashing.event_uuid(F.col("owner_code")).alias("event_id"))


@query("""
    SELECT count(*) AS rows, count(CASE WHEN json_valid(props) THEN 1 END) AS valid, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events""")
def json_validate(spark, sf):
    """Valid rows are those that parse (duplicate keys and NaN do not)."""
    v = F.try_parse_json("props")
    return table(spark, sf, "events").agg(F.count("*").alias("rows"), F.count(v).alias("valid"), F.sum(F.try_variant_get(v, "$.k", "bigint")).alias("total"))


@query()
def hash_embed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.hashed_features(F.col("text")).alias("vector"))


@query("""
    WITH p AS (SELECT regexp_extract_all(lower(trim(question)), '^(a|b|c|d|yes|no|skip|stop)[.)!]*$') AS m, case_id, lower(trim(question)) AS q FROM synthetic)
    SELECT case_id, CASE WHEN regexp_matches(q, '^[a-d][.)]?$') THEN 'option' WHEN q IN ('skip', 'next') THEN 'skip' WHEN q IN ('stop', 'quit', 'exit') THEN 'stop' ELSE 'text' END AS kind FROM p""")
def control_parse(spark, sf):
    """X13"""
    q = F.lower(F.trim("question"))
    kind = F.when(q.rlike(r"^[a-d][.)]?$"), "option").when(q.isin("skip", "next"), "skip").when(q.isin("stop", "quit", "exit"), "stop").otherwise("text")
    return table(spark, sf, "synthetic").select("case_id", kind.alias("kind"))


@query()
def fact_check(spark, sf):
    """Each sentence of a question's case against the passages given with it."""
    from brindle.operators import facts, units

    s = table(spark, sf, "synthetic").select("case_id", F.col("question"), F.explode("passages").alias("p")).distinct()
    pairs = s.select("case_id", F.element_at("p", 1).alias("passage_id"), F.col("question").alias("hypothesis"), F.element_at("p", 2).alias("premise"))
    return facts.check(pairs, "hypothesis", "premise", units._aliases(table(spark, sf, "units"))).select("case_id", "passage_id", "status", "reasons")


@query()
def quantities(spark, sf):
    """Every number of a passage with what is known of its unit."""
    from brindle.operators import units

    return units.quantities(table(spark, sf, "passages"), table(spark, sf, "units"))


@query()
def quantity_bind(spark, sf):
    """J12"""
    from brindle.operators import facts, units

    return facts.bind_quantities(units.quantities(table(spark, sf, "passages"), table(spark, sf, "units")))


@query("""
    SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 'answer' WHEN embedding[2] >= embedding[3] THEN 'quiz' ELSE 'explain' END AS mode FROM embeddings""")
def argmax_mode(spark, sf):
    """Ties go to the first."""
    from brindle.operators import facts

    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", facts.argmax({"answer": e[0], "quiz": e[1], "explain": e[2]}).alias("mode"))


@query("""
    SELECT request_id, coalesce(CASE WHEN state = 'failed' THEN 'retry' END, CASE WHEN content_type IS NOT NULL THEN content_type END, 'default') AS mode FROM requests""")
def mode_resolution(spark, sf):
    """The first source that speaks decides."""
    mode = F.coalesce(F.when(F.col("state") == "failed", "retry"), F.col("content_type"), F.lit("default"))
    return table(spark, sf, "requests").select("request_id", mode.alias("mode"))


@query("SELECT item_id FROM benchmark WHERE topic_id IS NULL OR topic_id NOT IN (SELECT topic_id FROM benchmark WHERE split = 'test' AND topic_id IS NOT NULL)")
def topic_block(spark, sf):
    """F09"""
    b = table(spark, sf, "benchmark")
    return b.join(b.where("split = 'test' AND topic_id IS NOT NULL").select("topic_id").distinct(), "topic_id", "left_anti").select("item_id")


@query("""
    SELECT case_id, array_to_string(list_filter([CASE WHEN question IS NULL OR trim(question) = '' THEN 'empty' END, CASE WHEN lower(trim(coalesce(partition, ''))) NOT IN ('training', 'development', 'final') THEN 'partition' END,
        CASE WHEN group_id IS NULL THEN 'group' END, CASE WHEN expected_status IS NULL OR len(expected_status) = 0 THEN 'status' END], lambda x: x IS NOT NULL), ',') AS problems FROM synthetic""")
def record_problems(spark, sf):
    """the problems of each labelled record."""
    from brindle.operators import relations

    part = F.lower(F.trim(F.coalesce("partition", F.lit(""))))
    r = relations.reasons((F.col("question").isNull() | (F.trim("question") == ""), "empty"), (~part.isin("training", "development", "final"), "partition"), (F.col("group_id").isNull(), "group"), (F.col("expected_status").isNull() | (F.size("expected_status") == 0), "status"))
    return table(spark, sf, "synthetic").select("case_id", F.array_join(r, ",").alias("problems"))


@query("""
    SELECT l_orderkey AS draft, count(*) AS claims, count(*) FILTER (l_quantity > 25) AS supported, count(*) FILTER (l_discount >= 0.09) AS contradicted, bool_or(l_quantity BETWEEN 24 AND 26) AS near_miss FROM lineitem GROUP BY l_orderkey""")
def claim_counts(spark, sf):
    """A20"""
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("draft")).agg(F.count("*").alias("claims"), F.count_if(q > 25).alias("supported"), F.count_if(F.col("l_discount") >= 0.09).alias("contradicted"), F.bool_or(q.between(24, 26)).alias("near_miss"))


@query("SELECT doc_id, regexp_matches(text, '(?i)<\\|[^<>|]{1,64}\\|>|</?think>|</?tool_call>|</?tool_response>') AS control FROM documents")
def control_screen(spark, sf):
    """X15"""
    return table(spark, sf, "documents").select("doc_id", rules.control_syntax(F.col("text")).alias("control"))
