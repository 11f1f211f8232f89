"""What the jobs share: the command line with its config file, and the log."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

log = logging.getLogger("docquarry.jobs")


def command(doc: str, paths: tuple[str, ...], settings: type, run, arguments: list[str] | None = None) -> None:
    """Run a job from a command line: an option for each of its paths, and --config, a JSON file with any of the settings.
    The session starts and ends here, and only here."""
    parser = argparse.ArgumentParser(description=doc)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help=f"path of the {p}")
    parser.add_argument("--config", help="JSON file with settings")
    a = parser.parse_args(arguments)
    config = settings()
    if a.config:
        with open(a.config) as f:
            config = settings(**json.load(f))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(doc.split(":")[0]).getOrCreate()
    try:
        run(spark, *(getattr(a, p) for p in paths), config)
    finally:
        spark.stop()
