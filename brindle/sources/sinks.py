"""Append-only logs, retention, upserts, reports, idempotent queues."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str, allowed: list[str]) -> None:
    """Metadata only; a column that is not allowed is an error."""
    extra = set(df.columns) - set(allowed)
    if extra:
        raise ValueError(f"not allowed in the log: {', '.join(sorted(extra))}")
    df.write.mode("append").json(path)


def purge(df: DataFrame, ts: str, cutoff: Column, out: str) -> int:
    """The rows from the cutoff on (and those without time) go to a new folder; gives the number removed."""
    keep = F.coalesce(F.col(ts) >= cutoff, F.lit(True))
    df.where(keep).write.parquet(out)
    return df.where(~keep).count()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE without MERGE."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def enqueue(queue: DataFrame, events: DataFrame) -> DataFrame:
    """An event whose id is there already changes nothing."""
    return insert_or_ignore(queue, events, ["event_id"])


def revoke(path: str, source: str, version: str | None) -> dict:
    """Adds a revocation (no version: all of them) and counts the epoch up; the file is replaced at once."""
    p = Path(path)
    state = json.loads(p.read_text()) if p.exists() else {"epoch": 0, "revoked": {}}
    held = state["revoked"].get(source, [])
    state["revoked"][source] = None if version is None or held is None else sorted({*held, version})
    state["epoch"] += 1
    new = p.with_suffix(f".{uuid.uuid4().hex}")
    new.write_text(json.dumps(state))
    os.replace(new, p)
    return state


def report(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A bounded report as one JSON file; more rows than `most` is an error, a report is no export."""
    rows = [json.loads(x) for x in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    Path(path).write_text(json.dumps(rows, indent=1))
    return len(rows)


def schema(df: DataFrame) -> str:
    return df.schema.json()
