"""python -m meterline.cli: version, status, costs and schema export of a library. Stages are run from code (plans.stages)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans import config, schemas
from .plans.library import TOOL, Library


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meterline")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("status", "costs"):
        commands.add_parser(name).add_argument("library")
    commands.add_parser("export-schemas").add_argument("--out", default="schemas")
    told = parser.parse_args(args)
    try:
        settings = config.load(told.config)
    except (FileNotFoundError, config.ConfigError) as e:
        print(e, file=sys.stderr)
        return 2
    if told.command == "version":
        print(TOOL)
    elif told.command == "export-schemas":
        out = Path(told.out)
        out.mkdir(parents=True, exist_ok=True)
        for name, value in schemas.exported().items():
            (out / f"{name}.schema.json").write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
    else:
        from pyspark.sql import SparkSession

        library = Library(SparkSession.builder.getOrCreate(), told.library, settings)
        if told.command == "costs":
            print(json.dumps(library.costs().first().asDict()))
        else:
            for row in library.status().toLocalIterator():
                print(f"{row.track_id}  {row.title}  {row.stage}={row.shown}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
