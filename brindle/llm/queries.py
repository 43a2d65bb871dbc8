"""The training-data queries, each over its whole tables with production parameters, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.session import table

from . import abuse, canonical, components, crosssplit, leaks, nearcopies, neighbours, packing, pieces


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.found(table(spark, sf_dir, "passages"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_passages(table(spark, sf_dir, "passages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.found(table(spark, sf_dir, "synthetic"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.report(table(spark, sf_dir, "synthetic"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.lookalike_pairs(table(spark, sf_dir, "passages"), "passage_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_pairs(table(spark, sf_dir, "passages"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(table(spark, sf_dir, "passages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.found(table(spark, sf_dir, "passages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.found(table(spark, sf_dir, "synthetic"))


def p7_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.assign(table(spark, sf_dir, "synthetic"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_report, p4_found, p5_found, p5_groups, p6_found, p7_found, p7_assigned, p8_packed, p8_fill, p9_found, p9_cleaned, p10_found, p10_rates)}



def _form(col: str) -> str:
    """SQL for problem 4's consistent form: what is not drawn goes, blanks are one sign, look-alikes and widths go by the
    mapping table of single characters, ligatures and numerals by name, and accents are composed."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    mapping = canonical.rules()
    one = {s: t for s, t in mapping.items() if len(s) == len(t) == 1 and t not in " \n"}
    out = f"replace(replace({col}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = f"regexp_replace({out}, '[\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    out = f"regexp_replace({out}, '[\\p{{Cf}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180D}}\\x{{3164}}\\x{{FFA0}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    out = f"regexp_replace({out}, '\\p{{Zs}}', ' ', 'g')"
    out = f"translate({out}, {quote(''.join(one))}, {quote(''.join(one.values()))})"
    for s in "ﬀﬁﬂﬃﬄ":
        out = f"replace({out}, '{s}', '{mapping[s]}')"
    return f"nfc_normalize({out})"


def _runs(table: str, key: str, text: str, where: str) -> str:
    """CTEs w (key, list of words) and r (key, run of three words), of different keys."""
    return f"""
        w AS (SELECT DISTINCT {key} AS k, regexp_extract_all(lower({_form(text)}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL AND {where}),
        r AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS run FROM w),
        n AS (SELECT k, count(*) AS n FROM r GROUP BY k),
        j AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM r x JOIN r y ON x.run = y.run AND x.k < y.k GROUP BY ALL),
        o AS (SELECT a, b FROM j JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE common >= 0.7 * (p.n + q.n - common) - 1e-9)"""


ORACLE: dict[str, str] = {
    "p2_found": f"""
        WITH {_runs("synthetic", "case_id", "question", "lower(trim(partition)) IN ('training', 'development', 'final')")},
        s AS (SELECT DISTINCT case_id AS k, lower(trim(partition)) = 'training' AS train FROM synthetic WHERE lower(trim(partition)) IN ('training', 'development', 'final'))
        SELECT DISTINCT a AS case_id_a, b AS case_id_b FROM o JOIN s p ON p.k = a JOIN s q ON q.k = b WHERE p.train <> q.train""",
    "p4_found": f"""
        WITH f AS (SELECT DISTINCT passage_id AS k, text AS t, {_form("text")} AS form FROM passages WHERE passage_id IS NOT NULL AND text IS NOT NULL)
        SELECT DISTINCT x.k AS passage_id_a, y.k AS passage_id_b FROM f x JOIN f y ON x.form = y.form AND x.t <> y.t AND x.k < y.k""",
    "p5_found": f"""
        WITH {_runs("passages", "passage_id", "text", "TRUE")} SELECT a AS passage_id_a, b AS passage_id_b FROM o""",
    "p6_found": """
        WITH v AS (SELECT DISTINCT vector_row AS k, list_transform(vector, lambda x: x::DOUBLE) AS v FROM passages
                   WHERE vector_row IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        s AS (SELECT x.k AS a, y.k AS b, row_number() OVER (PARTITION BY x.k ORDER BY round(list_cosine_similarity(x.v, y.v), 12) DESC, y.k) AS r FROM v x JOIN v y ON x.k <> y.k)
        SELECT DISTINCT least(a, b) AS vector_row_a, greatest(a, b) AS vector_row_b FROM s WHERE r <= 5""",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower({_form("text")}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower({_form("text")}), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        di AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' '))) AS run FROM d WHERE len(w) >= 10),
        ii AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' '))) AS run FROM i WHERE len(w) >= 10)
        SELECT DISTINCT doc_id, item_id FROM di JOIN ii USING (run)""",
    "p7_found": """
        WITH RECURSIVE c AS (SELECT DISTINCT case_id, lower(trim(partition)) AS part, lower(trim(group_id)) AS g, paired_with AS m FROM synthetic WHERE case_id IS NOT NULL),
        b AS (SELECT 'c:' || case_id AS u, 'g:' || g AS v FROM c WHERE g IS NOT NULL UNION SELECT 'c:' || case_id, 'c:' || m FROM c WHERE m IS NOT NULL),
        e AS (SELECT u, v FROM b UNION SELECT v, u FROM b),
        r(node, reach) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u),
        k AS (SELECT node, min(reach) AS root FROM r GROUP BY node),
        f AS (SELECT coalesce(root, 'c:' || case_id) AS root, part, case_id FROM c LEFT JOIN k ON node = 'c:' || case_id)
        SELECT DISTINCT case_id FROM f WHERE root IN (SELECT root FROM f WHERE part IN ('training', 'development', 'final') GROUP BY root HAVING count(DISTINCT part) > 1)""",
    "p1_found": """
        SELECT DISTINCT passage_id,
               CASE WHEN list_max(list_transform(string_split(text, chr(10) || chr(10)), lambda x: length(x))) <= 1200 THEN 'block' ELSE 'inside' END AS cut
        FROM passages WHERE length(text) > 1200 AND passage_id IS NOT NULL""",
}
