"""python -m packspark index [ROOT]: build and store the manifest. python -m packspark serve: answer
requests on standard input, a line each (see packspark.server)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from packspark import server, settings
from packspark.api import Engines
from packspark.sources import workspace as W

def index(spark: SparkSession, root: str | None) -> int:
    """Rebuild and store a workspace's manifest; returns the number of files."""
    conf = settings.load(root)
    return W.current_manifest(spark, conf, rebuild=True).count()


def answer(engines: Engines, request: dict) -> object:
    """The result of one request {"tool": …, "args": …}, or {"error": …}."""
    return server.short(engines, request)


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in ("index", "serve"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("packspark").getOrCreate()
    if argv[0] == "index":
        print(f"{index(spark, argv[1] if len(argv) > 1 else None)} files")
        return 0
    engines = Engines(spark)
    for line in server.serve(engines, sys.stdin):
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
