"""Hold every registered query against its SQL in DuckDB: python tests/compare.py [sf] [id prefix...]"""

from __future__ import annotations

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return f"{float(value):.9g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in found)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for n in NAMES:
        if Path(f"{sf_dir}/{n}.parquet").exists():
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def differs(spark, con, sf_dir, key, f, sql):
    """What differs, or an empty string."""
    df = f(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    got = con.execute(sql)
    types = {d[0]: str(d[1]) for d in got.description}
    theirs = rows([d[0] for d in got.description], got.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return f"{len(ours[1])} and {len(theirs[1])} rows; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
    wide = [c for c, t in types.items() if t in ("HUGEINT", "INT128")]
    return f"wide {wide}" if wide else ""


def main(args):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = args[0] if args else "sf0.001"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "/tmp/tessera-compare").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = duck(f"{DATA}/{sf}"), e.oracle_sql(), 0
    for key, f in e.queries().items():
        if key not in sqls or args[1:] and not key.startswith(tuple(args[1:])):
            continue
        try:
            what = differs(spark, con, f"{DATA}/{sf}", key, f, sqls[key])
        except Exception as x:  # noqa: BLE001
            what = f"{type(x).__name__}: {str(x)[:300]}"
        if what:
            bad += 1
            print(key, what, flush=True)
    print(len(sqls), "queries have SQL;", bad, "differ")


if __name__ == "__main__":
    main(sys.argv[1:])
