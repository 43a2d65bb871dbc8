"""Problem 1: oversized passages cut into pieces under a limit, at natural boundaries, with overlap.

One bounded-quantifier regular expression does the cutting inside the JVM. Its alternatives stand in the order of the
boundaries' strength (end of text, blank line, line end, sentence end, clause end, blank, any character that carries
no further mark); each consumes as much as the limit allows. Array functions turn the bodies into offsets, look back
into the preceding body for the overlap and map every piece onto the blocks it covers. Nothing is shuffled.

The work grows with the length of the text: sums run over stretches of STRETCH bodies, the blocks of a piece are found
from the number of blank lines before it, and a piece is complete before the pieces become rows, so that no row
carries the whole text.

The overlap is the last code points of the preceding body, as many as asked for or all of it, less the part of a word
or the marks it would begin with. A block that keeps the limit by itself stays whole; where the limit then leaves less
room, the overlap is as long as the room is. How much was given stands in the column overlap.

Defined results: a null text gives no piece, the empty text one empty piece; a text within the limit is one piece;
repeated rows are cut as often as they come; broken or missing spans give blocks named by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 120
STRETCH = 128


def cutting_pattern(limit: int, overlap: int) -> str:
    """Bodies are at most limit - overlap code points, so that a piece with its overlap keeps the limit; a single block
    that fits the limit alone is left whole, at the cost of its overlap."""
    b = limit - overlap
    if not 0 <= overlap < limit or b < 4:
        raise ValueError("the overlap must leave at least four characters of the limit")
    return (
        "(?s)"
        + f".{{1,{b}}}\\z"
        + f"|.{{1,{b}}}\\n\\n"
        + f"|.{{{b + 1},{limit}}}?(?:\\n\\n|\\z)" * (overlap > 0)
        + f"|.{{1,{b - 1}}}\\n"
        + f"|.{{1,{b - 3}}}(?:[.!?…][\"'”’)\\]]?\\s|[。！？])"
        + f"|.{{1,{b - 2}}}(?:[,;:]\\s|[，；：、])"
        + f"|.{{1,{b - 1}}}\\s"
        + f"|.{{1,{b - 1}}}(?!\\p{{M}})"
        + f"|.{{1,{b}}}"
    )


def bodies(text: Column, limit: int, overlap: int) -> Column:
    """Array of consecutive bodies whose concatenation is the text."""
    cut = F.regexp_extract_all(text, F.lit(cutting_pattern(limit, overlap)), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(cut)


def _running(df: DataFrame, numbers: str, out: str) -> DataFrame:
    """df with the running sums of an array of numbers, each with those before it. Arrays that a lambda looks into are
    used twice or zipped, or the optimizer would work them out anew for every element."""
    total = "aggregate({0}, 0, (s, x) -> s + x)"
    df = df.withColumn("_g", F.expr(f"transform(sequence(0, (size({numbers}) - 1) div {STRETCH}), j -> slice({numbers}, j * {STRETCH} + 1, {STRETCH}))"))
    df = df.withColumn("_s", F.expr(f"transform(_g, g -> {total.format('g')})"))
    df = df.withColumn("_b", F.expr(f"transform(_s, (x, j) -> {total.format('slice(_s, 1, j)')})"))
    inner = f"transform(z._g, (x, i) -> z._b + {total.format('slice(z._g, 1, i + 1)')})"
    return df.withColumn(out, F.expr(f"flatten(transform(arrays_zip(_g, _b), z -> {inner}))")).drop("_g", "_s", "_b")


def split_passages(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row a piece: passage_id, piece (from 1), pieces, body_start, body_end, piece_start (code points, half open),
    overlap (code points of the preceding body that are repeated), cut (block, inside, none: how the text was cut
    before this piece), blocks (id, start, end within the block), section_path_json, heading, source_id,
    source_version, text."""
    src = df.select("passage_id", "text", "section_path_json", "spans_json", "heading", "source_id", "source_version").where("text IS NOT NULL")
    b = src.withColumn("bodies", bodies(F.col("text"), limit, overlap))
    b = b.withColumn("lengths", F.expr("transform(bodies, x -> length(x))")).withColumn("gaps", F.expr("transform(bodies, x -> size(split(x, '\n\n', -1)) - 1)"))
    b = b.withColumn("raw", F.split("text", "\n\n", -1)).withColumn("spans", F.expr("transform(raw, x -> length(x) + 2)"))
    b = _running(_running(_running(b, "lengths", "ends"), "gaps", "before"), "spans", "stops")
    b = b.withColumn("ids", F.from_json("spans_json", "array<array<string>>"))
    b = b.withColumn("ids", F.expr("CASE WHEN size(ids) = size(raw) AND forall(ids, x -> x[0] IS NOT NULL) THEN transform(ids, x -> x[0]) ELSE transform(raw, (x, i) -> concat('block-', i + 1)) END"))
    b = b.withColumn("blocks", F.expr("transform(arrays_zip(ids, spans, stops), z -> struct(z.ids AS id, z.stops - z.spans AS start, z.stops - 2 AS end))"))
    # A run of blank lines that a cut parts may be counted otherwise in the bodies; then all blocks are looked through.
    b = b.withColumn("plain", F.expr("element_at(before, -1) = size(raw) - 1"))
    shown = "regexp_replace(x, '\n\n\\\\z', '')"
    tail = f"right(bodies[i - 1], least({overlap}, {limit} - length({shown})))"
    whole = "length({0}) = length(bodies[i - 1])"
    b = b.withColumn("tails", F.expr(f"transform(bodies, (x, i) -> IF(i = 0, '', {tail}))"))
    # from a word's beginning, unless the tail is all of the body, begins with one, or has no blank
    starts = "substring(bodies[i - 1], length(bodies[i - 1]) - length(x), 1) RLIKE '\\\\s'"
    trimmed = f"CASE WHEN x = '' OR {whole.format('x')} OR {starts} THEN x WHEN trim(x) RLIKE '\\\\s' THEN regexp_replace(x, '^\\\\S*\\\\s+', '') ELSE regexp_replace(x, '^[\\\\p{{M}}]+', '') END"
    b = b.withColumn("tails", F.expr(f"transform(tails, (x, i) -> {trimmed})"))
    start = "IF(i = 0, 0, ends[i - 1])"
    piece = (
        f"struct({start} AS body_start, ends[i] AS body_end, {start} - length(tails[i]) AS piece_start, length(tails[i]) AS overlap, "
        f"CASE WHEN i = 0 THEN 'none' WHEN endswith(bodies[i - 1], '\n\n') THEN 'block' ELSE 'inside' END AS cut, "
        f"IF(plain, slice(blocks, greatest(IF(i = 0, 0, before[i - 1]) - size(split(tails[i], '\n\n', -1)), 0) + 1, before[i] - IF(i = 0, 0, before[i - 1]) + size(split(tails[i], '\n\n', -1)) + 1), blocks) AS near, "
        f"concat(tails[i], {shown}) AS text)"
    )
    one = b.withColumn("made", F.expr(f"transform(bodies, (x, i) -> {piece})")).withColumn("pieces", F.size("bodies"))
    # Outer, though there is always a piece: else a filter on the array's size is inferred and everything worked out again in it.
    one = one.select("passage_id", "pieces", "section_path_json", "heading", "source_id", "source_version", F.posexplode_outer("made").alias("i", "p"))
    one = one.select(*(c for c in one.columns if c not in ("i", "p")), (F.col("i") + 1).alias("piece"), "p.*")
    covered = F.expr("transform(filter(near, x -> x.start < body_end AND (x.end > piece_start OR x.start = x.end AND x.start >= piece_start)), x -> struct(x.id AS id, greatest(piece_start - x.start, 0) AS start, least(body_end, x.end) - x.start AS end))")
    return one.select(
        "passage_id", "piece", "pieces", "body_start", "body_end", "piece_start", "overlap", "cut", covered.alias("blocks"),
        "section_path_json", "heading", "source_id", "source_version", "text",
    )


def found(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """p1_found: passages above the limit, and whether the pieces of split_passages could all be cut between blocks."""
    long = df.select("passage_id", "text").where((F.length("text") > limit) & F.col("passage_id").isNotNull())
    b = long.withColumn("bodies", bodies(F.col("text"), limit, overlap))
    inner = F.expr("exists(slice(bodies, 1, size(bodies) - 1), x -> NOT endswith(x, '\n\n'))")
    return b.select("passage_id", F.when(inner, "inside").otherwise("block").alias("cut")).distinct()
