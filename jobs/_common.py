"""What both jobs' command lines share."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file of settings changes; a name that the job doesn't know is an error."""
    given = {} if path is None else json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def session(name: str) -> SparkSession:
    """The command line's own session, with logging on; spark-submit's settings hold."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def importable() -> None:
    """Lets `python jobs/name.py` find the packages beside the folder."""
    root = str(Path(__file__).resolve().parent.parent)
    if root not in sys.path:
        sys.path.insert(0, root)
