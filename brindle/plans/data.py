"""Register, validation, duplicate, split and block queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import hashing, vector
from brindle.operators import chunker, corpus, relations, units
from brindle.plans.registry import query
from brindle.session import table
from brindle.sources import markdown


@query()
def p3_found(spark, sf):
    return units.found(table(spark, sf, "passages"), table(spark, sf, "units"))


@query()
def p3_inferred(spark, sf):
    return units.infer_units(table(spark, sf, "passages"), table(spark, sf, "units"))


@query()
def p3_masked(spark, sf):
    """What p3_inferred makes of explicit quantities whose units are hidden, by kind."""
    return units.masked(table(spark, sf, "passages"), table(spark, sf, "units"))


@query("SELECT source_id, source_version, count(*) AS copies, count(DISTINCT md5(text)) AS contents FROM passages GROUP BY ALL HAVING count(*) > 1")
def dup_key_check(spark, sf):
    return relations.duplicates(table(spark, sf, "passages"), ["source_id", "source_version"], F.md5("text"))


@query("""
    SELECT doc_id, 'left' AS side FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, 'right' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def orphan_check(spark, sf):
    return relations.orphans(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id")


@query("""
    WITH v AS (SELECT vector, len(vector) AS n, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM passages)
    SELECT coalesce(CASE WHEN vector IS NULL THEN 'missing' WHEN n <> 64 THEN 'dimension' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite'
           WHEN abs(norm - 1) > 1e-4 THEN 'norm' END, 'ok') AS problem, count(*) AS n FROM v GROUP BY ALL""")
def vector_validate(spark, sf):
    p = F.coalesce(vector.problem(F.col("vector"), 64), F.lit("ok"))
    return table(spark, sf, "passages").groupBy(p.alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT passage_id, sha256(text) = text_sha256 AS fresh FROM passages")
def hash_recheck(spark, sf):
    return table(spark, sf, "passages").select("passage_id", (hashing.text_digest(F.col("text")) == F.col("text_sha256")).alias("fresh"))


@query("""
    SELECT source_id, source_version, array_to_string(list_filter([
        CASE WHEN rights IS NULL THEN 'rights_missing' END, CASE WHEN NOT rights.allows_local_indexing THEN 'rights_no_indexing' END,
        CASE WHEN content_approval IS NULL THEN 'approval_missing' END, CASE WHEN lower(trim(coalesce(status, ''))) <> 'active' THEN 'status' END,
        CASE WHEN course_ids IS NULL OR len(course_ids) = 0 THEN 'no_course' END], lambda x: x IS NOT NULL), ',') AS problems FROM source_register""")
def build_problems(spark, sf):
    """F01 as a reason list."""
    r = relations.reasons(
        (F.col("rights").isNull(), "rights_missing"), (~F.col("rights.allows_local_indexing"), "rights_no_indexing"), (F.col("content_approval").isNull(), "approval_missing"),
        (F.lower(F.trim(F.coalesce("status", F.lit("")))) != "active", "status"), (F.col("course_ids").isNull() | (F.size("course_ids") == 0), "no_course"),
    )
    return table(spark, sf, "source_register").select("source_id", "source_version", F.array_join(r, ",").alias("problems"))


NOW = "2026-01-01 00:00:00"


@query(f"""
    SELECT source_id, source_version, coalesce(effective_from <= TIMESTAMPTZ '{NOW}+00', TRUE) AND coalesce(TIMESTAMPTZ '{NOW}+00' < effective_to, TRUE) AND coalesce(TIMESTAMPTZ '{NOW}+00' < review_due_at, TRUE) AS active
    FROM source_register""")
def eligible_sources(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return table(spark, sf, "source_register").select("source_id", "source_version", relations.active_at(now, F.col("effective_from"), F.col("effective_to"), F.col("review_due_at")).alias("active"))


@query("""
    WITH r AS (SELECT source_id, CASE WHEN source_tier = 1 THEN source_version END AS source_version FROM source_register WHERE source_tier <= 2)
    SELECT DISTINCT passage_id FROM passages p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = p.source_id AND (r.source_version IS NULL OR r.source_version = p.source_version))""")
def revocation_anti(spark, sf):
    """Tier 1 sources lose a version, tier 2 sources all of them."""
    reg = table(spark, sf, "source_register").where("source_tier <= 2").select("source_id", F.when(F.col("source_tier") == 1, F.col("source_version")).alias("source_version"))
    return relations.revoke(table(spark, sf, "passages"), reg, "source_id", "source_version").select("passage_id").distinct()


@query("""
    SELECT library_id, count(DISTINCT passage_id) AS passages FROM passages WHERE library_id IN (SELECT library_id FROM library_registry WHERE enabled AND indexed AND approved AND NOT archived) GROUP BY library_id""")
def eligible_passages(spark, sf):
    """Passages of active libraries."""
    active = table(spark, sf, "library_registry").where("enabled AND indexed AND approved AND NOT archived").select("library_id").distinct()
    return table(spark, sf, "passages").join(active, "library_id", "left_semi").groupBy("library_id").agg(F.countDistinct("passage_id").alias("passages"))


@query("""
    SELECT p.source_id, coalesce(bool_or(s.review_due_at > TIMESTAMPTZ '2026-01-01 00:00:00+00'), FALSE) AS live FROM (SELECT DISTINCT source_id FROM passages) p LEFT JOIN source_register s USING (source_id) GROUP BY p.source_id""")
def live_registry(spark, sf):
    """no row in the registry, not live."""
    ids = table(spark, sf, "passages").select("source_id").distinct().where("source_id IS NOT NULL")
    j = ids.join(table(spark, sf, "source_register"), "source_id", "left")
    return j.groupBy("source_id").agg(F.coalesce(F.bool_or(F.col("review_due_at") > F.lit("2026-01-01").cast("timestamp")), F.lit(False)).alias("live"))


@query("""
    WITH a AS (SELECT course_id, list_sort(list(DISTINCT library_id)) AS known, list_sort(list(DISTINCT library_id) FILTER (enabled)) AS on_, list_sort(list(DISTINCT library_id) FILTER (enabled AND indexed AND approved AND NOT archived)) AS active FROM library_registry GROUP BY course_id)
    SELECT course_id, CASE WHEN coalesce(len(on_), 0) = 0 THEN 'empty' WHEN len(list_intersect(on_, known)) < len(on_) THEN 'unknown' WHEN coalesce(array_to_string(active, ','), '') <> array_to_string(on_, ',') THEN 'not_active' ELSE 'ok' END AS code FROM a""")
def scope_check(spark, sf):
    """The enabled libraries of a course against the active ones."""
    flags = F.col("enabled") & F.col("indexed") & F.col("approved") & ~F.col("archived")
    a = table(spark, sf, "library_registry").groupBy("course_id").agg(F.collect_set("library_id").alias("known"), F.collect_set(F.when(F.col("enabled"), F.col("library_id"))).alias("on"), F.collect_set(F.when(flags, F.col("library_id"))).alias("active"))
    same = (F.size(F.array_except("on", "active")) == 0) & (F.size(F.array_except("active", "on")) == 0)
    code = F.when(F.size("on") == 0, "empty").when(F.size(F.array_except("on", "known")) > 0, "unknown").when(~same, "not_active").otherwise("ok")
    return a.select("course_id", code.alias("code"))


@query("""
    SELECT reason, count(*) AS n FROM (SELECT 'stale_hash' AS reason FROM passages WHERE sha256(text) <> text_sha256 UNION ALL SELECT 'no_vector' FROM passages WHERE vector IS NULL
      UNION ALL SELECT 'no_rights' FROM source_register WHERE rights IS NULL) GROUP BY reason""")
def quarantine_counts(spark, sf):
    """Reasons of several stages, put together."""
    p, r = table(spark, sf, "passages"), table(spark, sf, "source_register")
    u = p.where(F.sha2("text", 256) != F.col("text_sha256")).select(F.lit("stale_hash").alias("reason"))
    u = u.unionByName(p.where("vector IS NULL").select(F.lit("no_vector").alias("reason"))).unionByName(r.where("rights IS NULL").select(F.lit("no_rights").alias("reason")))
    return u.groupBy("reason").agg(F.count("*").alias("n"))


@query("""
    WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS digest FROM documents)
    SELECT digest, count(*) AS copies, min(doc_id) AS first FROM d GROUP BY digest HAVING count(*) > 1""")
def exact_dup(spark, sf):
    return corpus.exact_groups(table(spark, sf, "documents"), "doc_id", "text")


@query("""
    WITH t AS (SELECT min(passage_id) AS k, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS t FROM passages GROUP BY 2),
    s AS (SELECT k, list_distinct(list_transform(range(greatest(len(t) - 4, 1)), lambda i: hash(array_to_string(t[i + 1:i + 5], ' ')))) AS s FROM t),
    e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM s), f AS (SELECT x, count(*) AS f FROM e GROUP BY x HAVING count(*) > 1),
    h AS (SELECT k, n, x, row_number() OVER (PARTITION BY k ORDER BY f, x) AS r FROM e JOIN f USING (x)),
    c AS (SELECT DISTINCT a.k AS ka, b.k AS kb FROM h a JOIN h b USING (x) WHERE a.k < b.k AND a.r <= a.n - ceil(a.n * 0.8 - 1e-9) + 1 AND b.r <= b.n - ceil(b.n * 0.8 - 1e-9) + 1),
    m AS (SELECT ka, kb, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS na, len(b.s) AS nb FROM c JOIN s a ON a.k = ka JOIN s b ON b.k = kb)
    SELECT ka AS passage_id_a, kb AS passage_id_b, round(c / (na + nb - c), 6) AS jaccard FROM m WHERE c / (na + nb - c) >= 0.8""")
def near_dup(spark, sf):
    return corpus.near_links(table(spark, sf, "passages"), "passage_id", "text").withColumn("jaccard", F.round("jaccard", 6))


@query("""
    WITH i AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS t FROM benchmark),
    ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(greatest(len(t) - 4, 1)), lambda k: array_to_string(t[k + 1:k + 5], ' '))) AS s FROM i),
    d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS t FROM documents),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(t) - 4, 1)), lambda k: array_to_string(t[k + 1:k + 5], ' '))) AS s FROM d)
    SELECT item_id, count(DISTINCT doc_id) AS docs, count(DISTINCT s) AS shared FROM ig JOIN dg USING (s) GROUP BY item_id""")
def contamination(spark, sf):
    return corpus.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT case_id AS u, paired_with AS v FROM synthetic WHERE paired_with IS NOT NULL AND case_id IS NOT NULL),
    b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, reach) AS (SELECT DISTINCT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.reach = b.u)
    SELECT node, min(reach) AS root FROM r GROUP BY node""")
def components(spark, sf):
    s = table(spark, sf, "synthetic").where("case_id IS NOT NULL AND paired_with IS NOT NULL")
    return corpus.components(s.select(F.col("case_id").alias("u"), F.col("paired_with").alias("v")))


SHARES = [("train", 0.6), ("validation", 0.15), ("calibration", 0.1), ("test", 0.15)]


@query("""
    WITH d AS (SELECT doc_id, doc_kind, row_number() OVER (PARTITION BY doc_kind ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY doc_kind) AS n FROM documents)
    SELECT doc_id, doc_kind, CASE WHEN r <= round(n * 0.6) THEN 'train' WHEN r <= round(n * 0.75) THEN 'validation' WHEN r <= round(n * 0.85) THEN 'calibration' ELSE 'test' END AS split FROM d""")
def stratified_split(spark, sf):
    return corpus.stratified_split(table(spark, sf, "documents").select("doc_id", "doc_kind"), "doc_id", "doc_kind", SHARES)


@query("""
    SELECT DISTINCT source, CASE WHEN ('0x' || left(sha256(source), 12))::BIGINT / 16::DOUBLE ** 12 < 0.3 THEN 'development' ELSE 'final' END AS part FROM documents""")
def hash_split(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().select("source", corpus.hash_split(F.col("source"), 0.3).alias("part"))


@query()
def group_split(spark, sf):
    """Documents split by families of equal text, stratified by kind. A document has no group but itself."""
    d = table(spark, sf, "documents").select("doc_id", "doc_kind", "text")
    return corpus.group_split(d, "doc_id", "doc_id", "text", "doc_kind", SHARES).select("doc_id", "doc_kind", "family", "split")


@query()
def family_hash_split(spark, sf):
    """Documents split by the hash of their family, over source and equal text."""
    d = corpus.families(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")
    return d.select("doc_id", "source", "family", corpus.hash_split(F.col("family"), 0.3).alias("part"))


@query("SELECT group_id, count(DISTINCT lower(trim(partition))) AS partitions, count(*) AS rows FROM synthetic WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT lower(trim(partition))) > 1")
def group_cross(spark, sf):
    return corpus.crossing(table(spark, sf, "synthetic").withColumn("part", F.lower(F.trim("partition"))), "group_id", "part")


@query("SELECT lower(trim(partition)) AS part, kind, count(*) AS n FROM synthetic GROUP BY ALL")
def class_counts(spark, sf):
    return table(spark, sf, "synthetic").groupBy(F.lower(F.trim("partition")).alias("part"), "kind").agg(F.count("*").alias("n"))


@query("""
    WITH f AS (SELECT doc_id, source, doc_kind, 0 AS round FROM documents WHERE n_chars > 3000 ORDER BY doc_id LIMIT 25),
    r AS (SELECT doc_id, source, doc_kind, row_number() OVER (PARTITION BY source, doc_kind ORDER BY doc_id) AS round FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)),
    u AS (SELECT * FROM f UNION ALL SELECT * FROM r)
    SELECT doc_id, source, doc_kind, CAST(round AS BIGINT) AS round FROM u ORDER BY round, source, doc_kind, doc_id LIMIT 50""")
def review_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "doc_kind", "n_chars")
    s = relations.review_sample(d, ["source", "doc_kind"], "doc_id", F.col("n_chars") > 3000)
    return s.select("doc_id", "source", "doc_kind", F.col("round").cast("long").alias("round"))


@query("""
    WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY published_at NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents)
    SELECT source, count(*) AS docs, CAST(max(running) AS BIGINT) AS used FROM r WHERE running <= 20000 GROUP BY source""")
def prompt_fit(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "published_at", "n_chars")
    return relations.longest_prefix(d, "source", ["published_at", "doc_id"], "n_chars", 20_000).groupBy("source").agg(F.count("*").alias("docs"), F.max("running").alias("used"))


@query("""
    WITH l AS (SELECT source_id, passage_id, section_path_json AS s, lag(section_path_json) OVER (PARTITION BY source_id ORDER BY vector_row, passage_id) AS p, row_number() OVER (PARTITION BY passage_id ORDER BY source_id) AS n FROM passages)
    SELECT source_id, CAST(sum(CASE WHEN s IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) AS BIGINT) AS islands, count(*) AS rows FROM l GROUP BY source_id""")
def section_islands(spark, sf):
    """Consecutive passages of one section, counted per source."""
    w = Window.partitionBy("source_id").orderBy("vector_row", "passage_id")
    p = table(spark, sf, "passages").select("source_id", "section_path_json", F.lag("section_path_json").over(w).alias("p"))
    return p.groupBy("source_id").agg(F.sum((~F.col("section_path_json").eqNullSafe(F.col("p"))).cast("long")).alias("islands"), F.count("*").alias("rows"))


@query()
def md_blocks(spark, sf):
    """Documents as Markdown, in blocks."""
    return markdown.blocks(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunks(spark, sf):
    """The blocks of documents in chunks."""
    return chunker.chunk(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT passage_id, CASE WHEN coalesce(trim(heading), '') <> '' THEN md5(heading || chr(10) || text) ELSE md5(text) END AS rerank_digest FROM passages")
def rerank_document(spark, sf):
    """P03"""
    h = F.trim(F.coalesce("heading", F.lit("")))
    return table(spark, sf, "passages").select("passage_id", F.md5(F.when(h != "", F.concat_ws("\n", "heading", "text")).otherwise(F.col("text"))).alias("rerank_digest"))


@query("""
    SELECT passage_id, concat_ws(chr(10), nullif(title, ''), nullif(heading, ''), nullif(edition, '')) AS canonical, 'evidence://' || source_id || '/' || source_version || '/' || passage_id AS uri FROM passages""")
def canonical_text(spark, sf):
    """P02, P04"""
    p = table(spark, sf, "passages")
    c = F.concat_ws("\n", *(F.nullif(F.col(x), F.lit("")) for x in ("title", "heading", "edition")))
    return p.select("passage_id", c.alias("canonical"), F.concat(F.lit("evidence://"), "source_id", F.lit("/"), "source_version", F.lit("/"), "passage_id").alias("uri"))


@query("""
    SELECT passage_id, coalesce(CASE WHEN locator.kind IS NULL THEN 'kind' WHEN locator.kind IN ('pdf_page', 'slide') AND (locator.start IS NULL OR locator."end" IS NULL) THEN 'pages_missing'
      WHEN locator.start > locator."end" THEN 'order' WHEN locator.kind = 'section' AND locator.anchor IS NULL THEN 'anchor_missing' END, 'ok') AS problem FROM passages""")
def locator_check(spark, sf):
    """F10"""
    k = F.col("locator.kind")
    p = F.when(k.isNull(), "kind").when(k.isin("pdf_page", "slide") & (F.col("locator.start").isNull() | F.col("locator.end").isNull()), "pages_missing").when(F.col("locator.start") > F.col("locator.end"), "order").when((k == "section") & F.col("locator.anchor").isNull(), "anchor_missing").otherwise("ok")
    return table(spark, sf, "passages").select("passage_id", p.alias("problem"))


@query("""
    WITH c AS (SELECT DISTINCT source_id, source_version, unnest(extraction_checks) AS x FROM source_register)
    SELECT c.source_id, c.source_version, x AS missing FROM c WHERE NOT EXISTS (SELECT 1 FROM passages p WHERE p.source_id = c.source_id AND p.source_version = c.source_version AND contains(p.text, x))""")
def extraction_check(spark, sf):
    """Reviewed strings that no passage of their source holds."""
    c = table(spark, sf, "source_register").select("source_id", "source_version", F.explode("extraction_checks").alias("missing")).where("missing IS NOT NULL").distinct()
    p = table(spark, sf, "passages").select("source_id", "source_version", "text")
    hit = c.join(p, ["source_id", "source_version"]).where(F.contains("text", "missing")).select("source_id", "source_version", "missing").distinct()
    return c.join(hit, ["source_id", "source_version", "missing"], "left_anti")


LINES = """
    l0 AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n?|\\n') AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l0),
    h AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '^#\\s+\\S') THEN pos END AS p1, CASE WHEN regexp_matches(line, '^##\\s+\\S') THEN pos END AS p2 FROM l),
    c AS (SELECT doc_id, pos, line, last_value(p1 IGNORE NULLS) OVER w AS p1, last_value(p2 IGNORE NULLS) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@query(f"""
    WITH {LINES} SELECT doc_id, count(*) AS lines, CAST(count(*) FILTER (p1 IS NOT NULL) AS BIGINT) AS under_1, CAST(count(*) FILTER (p2 > coalesce(p1, -1)) AS BIGINT) AS under_2 FROM c GROUP BY doc_id""")
def heading_carry(spark, sf):
    """W06 as windows: each line's last heading of either level; one of the second level ends at the next first."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n?|\n", -1)).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda p: F.last(F.when(F.col("line").rlike(p), F.col("pos")), ignorenulls=True).over(w)
    c = docs.select("doc_id", at(r"^#\s+\S").alias("p1"), at(r"^##\s+\S").alias("p2"))
    return c.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("p1").alias("under_1"), F.count_if(F.col("p2") > F.coalesce("p1", F.lit(-1))).alias("under_2"))
