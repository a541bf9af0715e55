"""Command line: `python -m tramline queries`, `sql NAME`, `explain NAME FOLDER`, `run NAME FOLDER OUT`, `validate SCENARIO.json CATALOGUE.json`."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tramline import plans, record
from tramline.operators import scenario
from tramline.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tramline", description="Transport-network planning analytics on PySpark.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the registered queries")
    for name, more in (("sql", []), ("explain", ["folder"]), ("run", ["folder", "out"])):
        one = sub.add_parser(name)
        one.add_argument("query", choices=sorted(plans.QUERIES))
        for x in more:
            one.add_argument(x)
    v = sub.add_parser("validate", help="hold a scenario against a catalogue of routes, stops and sections")
    v.add_argument("scenario")
    v.add_argument("catalogue")
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(plans.QUERIES)))
    elif a.command == "sql":
        print(plans.SQL[a.query])
    elif a.command == "validate":
        c = json.loads(Path(a.catalogue).read_text())
        cat = scenario.Catalogue.of(c["routes"], c["stops"], c.get("sections", []))
        try:
            s, _ = scenario.load(json.loads(Path(a.scenario).read_text()), cat)
        except scenario.ScenarioError as e:
            print(e, file=sys.stderr)
            return 1
        print(f"{s.id}: {len(s.ops)} ops, {s.spec_hash[:12]}")
    else:
        spark = local_session()
        rows = plans.QUERIES[a.query](spark, a.folder)
        if a.command == "explain":
            rows.explain("formatted")
        else:
            made = record.begin(a.query, {"folder": a.folder})
            rows.write.mode("overwrite").parquet(a.out)
            record.finish(made, [a.out], f"{a.out.rstrip('/')}.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
