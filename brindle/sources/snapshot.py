"""Immutable snapshots: staged, validated, renamed, activated by a pointer file."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Check = Callable[[dict[str, DataFrame]], str | None]


class SnapshotError(RuntimeError):
    pass


def _digest(folder: Path) -> str:
    h = hashlib.sha256()
    for p in sorted(folder.rglob("*.parquet")):
        h.update(hashlib.sha256(p.read_bytes()).digest())
    return h.hexdigest()


def build(root: str, version: str, tables: dict[str, DataFrame], checks: list[Check] = [], sort: dict[str, str] | None = None) -> Path:  # noqa: B006
    """Writes the tables to a staging folder, runs the checks on what was written, and renames. A failure removes the
    staging folder and touches nothing live; an existing version is refused."""
    base = Path(root)
    final, stage = base / version, base / f".staging-{uuid.uuid4().hex}"
    if final.exists():
        raise SnapshotError(f"version {version} exists")
    try:
        manifest: dict = {"version": version, "tables": {}}
        read: dict[str, DataFrame] = {}
        for name, df in tables.items():
            out = df.sortWithinPartitions(sort[name]) if sort and name in sort else df
            out.write.parquet(str(stage / name))
            read[name] = df.sparkSession.read.parquet(str(stage / name))
            manifest["tables"][name] = {"rows": read[name].count(), "schema": read[name].schema.jsonValue(), "sha256": _digest(stage / name)}
        for check in checks:
            problem = check(read)
            if problem:
                raise SnapshotError(problem)
        (stage / "manifest.json").write_text(json.dumps(manifest, indent=1))
        os.rename(stage, final)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return final


def validate(root: str, version: str) -> dict:
    """The manifest, if the files are those that were written."""
    folder = Path(root) / version
    manifest = json.loads((folder / "manifest.json").read_text())
    for name, t in manifest["tables"].items():
        if _digest(folder / name) != t["sha256"]:
            raise SnapshotError(f"table {name} was changed")
    return manifest


def activate(root: str, version: str) -> None:
    """Points to the version after a full validation; the one before is kept for rollback."""
    validate(root, version)
    pointer = Path(root) / "ACTIVE.json"
    before = json.loads(pointer.read_text())["version"] if pointer.exists() else None
    new = pointer.with_suffix(f".{uuid.uuid4().hex}")
    new.write_text(json.dumps({"version": version, "previous": before}))
    os.replace(new, pointer)


def pin(spark: SparkSession, root: str) -> tuple[str, dict[str, DataFrame]]:
    """The active version and its tables; the pointer is read once, so that all tables are of one version."""
    version = json.loads((Path(root) / "ACTIVE.json").read_text())["version"]
    manifest = json.loads((Path(root) / version / "manifest.json").read_text())
    return version, {n: spark.read.parquet(str(Path(root) / version / n)) for n in manifest["tables"]}


def rollback(root: str) -> str:
    before = json.loads((Path(root) / "ACTIVE.json").read_text())["previous"]
    if before is None:
        raise SnapshotError("no version before")
    activate(root, before)
    return before
