"""Tagged parameters: a tree of values, each with where it comes from, as paths and as a table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: A parameter still to be found out has this tag.
PLACEHOLDER = "placeholder"


def flat(tree: Any, at: str = "") -> Iterator[tuple[str, Any, str | None, str | None]]:
    """(path, value, tag, unit) of each parameter: a mapping with `value` and `tag`. Other mappings are levels; anything else breaks the rule."""
    if isinstance(tree, dict) and {"value", "tag"} <= set(tree):
        yield at, tree["value"], tree["tag"], tree.get("unit")
        return
    if not isinstance(tree, dict):
        raise ValueError(f"{at or 'the root'} is neither a parameter nor a level of them")
    for k, v in tree.items():
        yield from flat(v, f"{at}.{k}" if at else str(k))


class Params:
    """Parameters of a JSON file by path, with the file's hash."""

    def __init__(self, path: str):
        data = Path(path).read_bytes()
        self.sha256 = hashlib.sha256(data).hexdigest()
        self.rows = {p: (v, tag, unit) for p, v, tag, unit in flat(json.loads(data))}

    def __getitem__(self, path: str) -> Any:
        if path not in self.rows:
            raise KeyError(f"no parameter {path}")
        return self.rows[path][0]

    def placeholders(self) -> list[str]:
        return sorted(p for p, (_, tag, _) in self.rows.items() if tag == PLACEHOLDER)

    def table(self, spark: SparkSession) -> DataFrame:
        """path, value (JSON), tag, unit: a row a parameter."""
        rows = [(p, json.dumps(v), tag, unit) for p, (v, tag, unit) in sorted(self.rows.items())]
        return spark.createDataFrame(rows, "path string, value string, tag string, unit string")
