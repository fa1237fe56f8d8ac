"""Command line: ``python -m codeatlas <command> [text] [--root DIR] [--limit N]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from codeatlas import __version__
from codeatlas.plans.server import serve
from codeatlas.plans.service import CodeAtlas
from codeatlas.plans.show import shown

COMMANDS = ("init", "index", "query", "symbol", "callers", "callees", "status", "doctor", "serve", "version")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeatlas")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("text", nargs="*")
    parser.add_argument("--root", default=os.environ.get("CODEATLAS_ROOT", os.getcwd()))
    parser.add_argument("--limit", type=int)
    options = parser.parse_args(arguments)
    if options.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.appName("codeatlas").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    atlas = CodeAtlas(spark, options.root)
    if options.command == "serve":
        serve(atlas)
        return 0
    run = getattr(atlas, options.command)
    if options.command in ("query", "symbol", "callers", "callees"):
        limit = {} if options.limit is None else {"limit": options.limit}
        result = run(" ".join(options.text), **limit)
    else:
        result = run()
    print(shown(options.command, result))
    return 0 if result["ok"] and result.get("summary") != "warning" else 1


if __name__ == "__main__":
    sys.exit(main())
