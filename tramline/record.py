"""Run records: what a result was made from, as a JSON document."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from datetime import UTC, datetime
from pathlib import Path

import pyspark

#: Keys that a record must have.
KEYS = {"run_id", "query", "inputs", "started", "finished", "git", "environment", "outputs"}


def git_state(root: str) -> dict:
    """Commit and whether files differ from it; null where there is no repository."""

    def ask(*args: str) -> str | None:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
        return got.stdout.strip() if got.returncode == 0 else None

    status = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "changed": None if status is None else bool(status)}


def begin(query: str, inputs: dict[str, str], root: str = ".") -> dict:
    """A record of a run that starts now. inputs: name -> path or hash; they and the query name the run."""
    started = datetime.now(UTC).isoformat(timespec="seconds")
    name = hashlib.sha256(json.dumps([query, inputs, started], sort_keys=True).encode()).hexdigest()[:12]
    return {"run_id": f"{query}-{name}", "query": query, "inputs": inputs, "started": started, "finished": None, "git": git_state(root), "environment": {"python": platform.python_version(), "spark": pyspark.__version__}, "outputs": []}


def finish(record: dict, outputs: list[str], path: str) -> dict:
    """The record with its end and outputs, written as JSON once it is complete."""
    done = record | {"finished": datetime.now(UTC).isoformat(timespec="seconds"), "outputs": outputs}
    check(done)
    Path(path).write_text(json.dumps(done, indent=2, sort_keys=True) + "\n")
    return done


def check(record: dict) -> None:
    if missing := KEYS - set(record):
        raise ValueError(f"a run record lacks {sorted(missing)}")
    if record["finished"] is not None and record["finished"] < record["started"]:
        raise ValueError("a run can't end before it starts")
