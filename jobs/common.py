"""What the jobs share: configs, logs, sessions of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def config(name: str, path: str | None = None) -> dict:
    """The job's config: the file beside it, or another one. It is small and local to the driver."""
    return json.loads(Path(path or Path(__file__).with_name(f"{name}.json")).read_text())


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def command(name: str, what: str, paths: dict[str, str]) -> argparse.Namespace:
    """Arguments of a job: paths (any that Spark reads) and the config."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    args = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=what)
    for path, says in paths.items():
        args.add_argument(f"--{path}", required=True, help=says)
    args.add_argument("--config", help="JSON; the one beside the job if not given")
    return args.parse_args()


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
