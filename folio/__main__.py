"""python -m folio list | run NAME TABLES [OUT] | read FILES OUT: queries and container reads from a shell."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import QUERIES
from .sources import frames


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(args) >= 3 and args[0] == "run" and args[1] in QUERIES:
        df = QUERIES[args[1]](SparkSession.builder.getOrCreate(), args[2])
    elif len(args) == 3 and args[0] == "read":
        spark = SparkSession.builder.getOrCreate()
        df = frames.read_files(spark.read.format("binaryFile").load(args[1]).select("path", F.col("content")))
    else:
        print(__doc__, file=sys.stderr)
        return 2
    out = args[3] if args[0] == "run" and len(args) > 3 else args[2] if args[0] == "read" else None
    if out:
        df.write.mode("errorifexists").parquet(out)
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
