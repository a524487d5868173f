"""Command line: index a folder and tell what was found."""

from __future__ import annotations

import sys
from dataclasses import dataclass

HELP = """argentic FOLDER [--port PORT] [--host ADDRESS] [--no-index] [--no-open] [-h | --help]

  --no-index  use the index that is there, without a walk
  --port, --host  make up the address that is told (8080, 127.0.0.1); --no-open tells none
"""


@dataclass(frozen=True)
class Options:
    root: str
    port: int = 8080
    host: str | None = None
    no_index: bool = False
    no_open: bool = False


class UsageError(Exception):
    pass


def parse(words: list[str]) -> Options | None:
    """The options of a command line; None if it asks for help.  What is unknown is an error, never a folder."""
    found: dict = {}
    rest = list(words)
    while rest:
        word = rest.pop(0)
        if word in ("-h", "--help"):
            return None
        if word in ("--no-index", "--no-open"):
            found[word[2:].replace("-", "_")] = True
        elif word in ("--port", "--host"):
            if not rest:
                raise UsageError(f"{word} needs a value")
            found[word[2:]] = rest.pop(0)
        elif word.startswith("-"):
            raise UsageError(f"unknown option {word}")
        elif "root" in found:
            raise UsageError(f"a second folder: {word}")
        else:
            found["root"] = word
    if "root" not in found:
        raise UsageError("no folder given")
    port = found.get("port", "8080")
    if not (port.isascii() and port.isdigit() and 0 < int(port) < 1 << 16):
        raise UsageError(f"no port number: {port}")
    return Options(**found | {"port": int(port)})


def main(words: list[str]) -> int:
    try:
        options = parse(words)
    except UsageError as e:
        print(e, HELP, sep="\n", file=sys.stderr)
        return 2
    if options is None:
        print(HELP)
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from argentic.plans import catalog

    spark = SparkSession.builder.getOrCreate()
    index_at = f"{options.root.rstrip('/')}/.argentic"
    if options.no_index:
        print(catalog.serve(spark, options.root, index_at).count(), "photos in the index")
    else:
        entries, stats = catalog.build(spark, options.root, index_at)
        waste = catalog.cluster_items(entries).agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))
        for row in catalog.summary(stats.crossJoin(waste)).orderBy("line").collect():  # one row each
            print(row["text"])
    if not options.no_open:
        print(f"http://{options.host or '127.0.0.1'}:{options.port}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
