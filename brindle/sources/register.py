"""Register, import paths, JSON lines with a fixed schema."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"markdown": {".md"}, "json": {".json"}}
SOURCE_SCHEMA = (
    "source_id STRING, source_version STRING, title STRING, owner STRING, edition STRING, publication_year INT, source_tier INT, library_id STRING, "
    "course_ids ARRAY<STRING>, tenant_id STRING, topic_ids ARRAY<STRING>, language STRING, file_ref STRING, file_sha256 STRING, format STRING, "
    "acquisition_record STRING, rights STRUCT<rights_reference:STRING, allows_local_indexing:BOOLEAN, allows_excerpt_display:BOOLEAN, "
    "allows_model_training:BOOLEAN, constraints:STRING, reviewer:STRING, reviewed_at:TIMESTAMP, supporting_document:STRING, expires_at:TIMESTAMP>, "
    "content_approval STRUCT<approver:STRING, approved_at:TIMESTAMP>, status STRING, review_due_at TIMESTAMP, effective_from TIMESTAMP, "
    "effective_to TIMESTAMP, superseded_version STRING, parser STRUCT<parser_id:STRING, parser_version:STRING, normalization_version:STRING, "
    "parsed_output_approved:BOOLEAN, verified_page_labels:BOOLEAN>, default_section STRING, extraction_checks ARRAY<STRING>, synthetic_fixture BOOLEAN"
)


class DuplicateKey(ValueError):
    """A key that must be unique occurs more than once."""


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, if no key occurs twice; the check is an aggregate of which one row reaches the driver."""
    bad = df.groupBy(*keys).count().where("count > 1").first()
    if bad:
        raise DuplicateKey(", ".join(f"{k}={bad[k]!r}" for k in keys))
    return df


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """{"sources": [...]} as typed rows; a repeated (source_id, source_version) is fatal."""
    doc = spark.read.schema(f"sources ARRAY<STRUCT<{','.join(_fields(SOURCE_SCHEMA))}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    return unique(doc.select(F.explode("sources").alias("s")).select("s.*"), "source_id", "source_version")


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [f"{n}:{t.strip()}" for n, t in (x.strip().split(" ", 1) for x in [*out, now])]


def upsert_register(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new, ["source_id", "source_version"], "left_anti").unionByName(new)


def resolve(root: str, ref: str, fmt: str, most: int) -> Path:
    """A file below root; the error's text is the reason code."""
    if not ref or "://" in ref or ":" in ref or "\\" in ref or ref.startswith("/"):
        raise ValueError("not_relative")
    base, path = Path(root).resolve(), (Path(root) / ref).resolve()
    if not path.is_relative_to(base):
        raise ValueError("outside_root")
    if not path.is_file():
        raise ValueError("no_file")
    if path.suffix.lower() not in SUFFIXES.get(fmt, ()):
        raise ValueError("format")
    if path.stat().st_size > most:
        raise ValueError("too_large")
    return path


def read_files(spark: SparkSession, root: str, pattern: str, most: int) -> DataFrame:
    """Files as (path, text, sha256, problem); too large or not UTF-8 is a problem, not a failure of the scan."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return f.select(
        "path", F.when(F.col("length") <= most, text).alias("text"), F.sha2("content", 256).alias("sha256"),
        F.when(F.col("length") > most, "too_large").when(text.isNull(), "not_utf8").alias("problem"),
    )


def read_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines of a fixed schema; a line that does not fit fails the read, a repeated key is fatal."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return unique(df, key) if key else df


def aliases(df: DataFrame, alias: str, topic: str) -> DataFrame:
    """An alias of two topics is fatal."""
    norm = df.select(F.lower(F.trim(F.regexp_replace(alias, r"\s+", " "))).alias("alias"), topic).distinct()
    return unique(norm, "alias")
