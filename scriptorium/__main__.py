"""python -m scriptorium list | run QUERY TABLES [ROWS] | explain QUERY TABLES"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from .catalogue import QUERIES

    if args[:1] == ["list"]:
        for name, f in sorted(QUERIES.items()):
            print(f"{name:32s} {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")
        return 0
    if len(args) >= 3 and args[0] in ("run", "explain") and args[1] in QUERIES:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        df = QUERIES[args[1]](spark, args[2])
        df.explain("formatted") if args[0] == "explain" else df.show(int(args[3]) if len(args) > 3 else 20, truncate=60)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
