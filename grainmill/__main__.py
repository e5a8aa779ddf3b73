"""``python -m grainmill SOURCE FOLDER``: converts a source under its suggested types, or those of a configuration file."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .config import InstanceConfig
from .plans.engine import Engine, FileStore
from .session import configure, ship
from .sources import store


def main(argv: list[str] | None = None) -> int:
    """Prints the run as one JSON line; 0 unless it is blocked."""
    parser = argparse.ArgumentParser(prog="grainmill", description=__doc__)
    parser.add_argument("source", help="a .csv, .json or .xlsx file on any file system that Spark knows")
    parser.add_argument("folder", help="where the table, the trace and the manifest go")
    parser.add_argument("--config", help="a JSON file with source_format, column_config and operation_config")
    parser.add_argument("--runs", help="a folder in which runs are kept")
    parser.add_argument("--within", action="append", default=[], help="a folder that the source must lie in; may be repeated")
    parser.add_argument("--suggest-only", action="store_true", help="print the suggested configuration and stop")
    said = parser.parse_args(argv)
    spark = ship(configure(SparkSession.builder.appName("grainmill").getOrCreate()))
    path = store.within(spark, said.source, said.within) if said.within else said.source
    engine = Engine(spark, FileStore(spark, said.runs) if said.runs else None)
    if said.config:
        run = engine.create_confirmed(path, InstanceConfig.from_dict(json.loads(store.read_text(spark, said.config))))
    else:
        run = engine.suggest(path)
        if said.suggest_only:
            print(engine.config_json(run.id))
            return 0
        engine.confirm(run.id)
    engine.profile(run.id)
    run = engine.convert(run.id, said.folder)
    print(json.dumps({"id": run.id, "status": run.status, "artifacts": run.artifacts, "quality_score": run.quality["quality_score"]}))
    return 1 if run.status == "BLOCKED" else 0


if __name__ == "__main__":
    raise SystemExit(main())
