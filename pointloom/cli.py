"""Command line over the entropy source: ``spark-submit -m pointloom.cli --int --count 10 --url ...``.

--hex and --binary print a block, --int prints integers of [min, max).  The
number of values is always bounded, and errors are not swallowed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from pointloom.sources import entropy


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pointloom")
    kind = parser.add_mutually_exclusive_group(required=True)
    kind.add_argument("--hex", action="store_true")
    kind.add_argument("--binary", action="store_true")
    kind.add_argument("--int", dest="integers", action="store_true")
    parser.add_argument("--min", type=int, default=0)
    parser.add_argument("--max", type=int, default=10)
    parser.add_argument("--count", type=int, default=1)
    parser.add_argument("--url")
    parser.add_argument("--words", default="", help="recorded values instead of a service")
    chosen = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    entropy.register(spark)
    reader = spark.read.format("entropy").option("words", chosen.words).option("type", "uint16" if chosen.integers else "hex16")
    if chosen.url:
        reader = reader.option("url", chosen.url)
    if chosen.integers:
        for row in entropy.randint(reader.load(), chosen.min, chosen.max).orderBy("pos").limit(chosen.count).collect():
            print(int(row.value))
        return
    row = entropy.hex_text(reader.load()).first()
    if chosen.hex:
        print(row.hex)
    else:
        sys.stdout.buffer.write(bytes(row.bytes))


if __name__ == "__main__":
    main()
