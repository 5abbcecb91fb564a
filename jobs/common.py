"""Command lines and logs of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession


def config(name: str) -> dict:
    """The settings beside the jobs, as plain values."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")) as f:
        return json.load(f)


def main(name: str, text: str, paths: dict[str, str], run) -> None:
    """Reads the command line (paths, and a config file in place of the one beside the job), runs the job in a session of its own."""
    parser = argparse.ArgumentParser(description=text)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="JSON file of settings that replace the job's own")
    given = vars(parser.parse_args())
    settings = config(name)
    if given["config"]:
        with open(given["config"]) as f:
            settings |= json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[given[path] for path in paths], settings)
    finally:
        spark.stop()
