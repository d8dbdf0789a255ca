"""Result packs: small tables as CSV and JSON, written whole, and a record of whether a run ended well.

Everything here is a summary of bounded size; tables that grow with the data are written by Spark.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

BUILDING, SUCCESS, FAILED = "BUILDING", "SUCCESS", "FAILED"


def write_whole(path: str | Path, text: str) -> str:
    """Writes beside the target and renames, so that a reader sees the old text or the new; returns the SHA-256."""
    path = Path(path)
    data = text.encode()
    beside = path.with_name(f".{path.name}.{os.getpid()}")
    beside.write_bytes(data)
    os.replace(beside, path)
    return hashlib.sha256(data).hexdigest()


def rows_of(table: DataFrame, order: list[str], most: int = 100_000) -> list[dict]:
    """The rows of a summary in a stated order; more than ``most`` are an error, never cut."""
    rows = table.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pack holds at most {most} rows of a table")
    return [row.asDict(recursive=True) for row in rows]


def write_csv(path: str | Path, rows: list[dict], fields: list[str]) -> str:
    """The named fields with a header; a row with other fields is an error."""
    from io import StringIO

    out = StringIO()
    writer = csv.DictWriter(out, fields, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return write_whole(path, out.getvalue())


def write_pack(path: str | Path, pack: Mapping) -> str:
    """JSON without NaN or infinity, which are errors; dates as text."""
    return write_whole(path, json.dumps(pack, indent=2, sort_keys=True, allow_nan=False, default=str) + "\n")


def read_pack(path: str | Path) -> dict:
    pack = json.loads(Path(path).read_text())
    if pack.get("status") in (BUILDING, FAILED):
        raise ValueError(f"{path} is of a run that is {pack['status']}")
    return pack


def identity(paths: Mapping[str, str | Path]) -> dict[str, str]:
    """SHA-256 of the files that a build depends on, by name."""
    return {name: hashlib.sha256(Path(path).read_bytes()).hexdigest() for name, path in paths.items()}


def gate(failures: int, checked: int) -> dict:
    """PASS only where something was checked and nothing failed."""
    return {"status": "PASS" if checked and not failures else "FAIL" if failures else "INCOMPLETE", "failures": failures, "checked": checked}


@contextmanager
def recorded_run(results: str | Path, record: str | Path, of: Mapping[str, str]) -> Iterator[dict]:
    """A pack to fill. BUILDING stands in both files until the end, then the pack and SUCCESS with its hash, or FAILED with the error."""
    started = datetime.now(timezone.utc).isoformat()
    for path in (results, record):
        write_pack(path, {"status": BUILDING, "attempt_started": started})
    pack: dict = {}
    try:
        yield pack
        done = write_pack(results, pack | {"generated_at": started, "build_identity": dict(of)})
    except Exception as error:
        for path in (results, record):
            write_pack(path, {"status": FAILED, "attempt_started": started, "error": str(error)})
        raise
    write_pack(record, {"status": SUCCESS, "built_at": started, "results_sha256": done, "identity": dict(of)})
