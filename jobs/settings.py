"""Command line and configuration of a job: a JSON file, whose values options replace."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def settings(default: str, names: dict[str, type], arguments: list[str] | None = None) -> dict[str, Any]:
    """The values of ``names`` from the file and the options; unknown and missing ones are refused."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--config", default=default, help="JSON file with the values below")
    for name, kind in names.items():
        parser.add_argument("--" + name.replace("_", "-"), type=kind, default=None)
    given = vars(parser.parse_args(arguments))
    with open(given.pop("config"), encoding="utf-8") as file:
        held = json.load(file)
    if unknown := sorted(held.keys() - names.keys()):
        parser.error(f"unknown in the configuration: {', '.join(unknown)}")
    held |= {name: value for name, value in given.items() if value is not None}
    if missing := sorted(names.keys() - held.keys()):
        parser.error(f"no value for: {', '.join(missing)}")
    if wrong := sorted(name for name, kind in names.items() if type(held[name]) is not kind):
        parser.error(f"of another type: {', '.join(wrong)}")
    return held


def command(name: str, work: Callable[..., dict], values: dict[str, Any]) -> None:
    """Run a job in a session of its own."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, **values)
    finally:
        spark.stop()
