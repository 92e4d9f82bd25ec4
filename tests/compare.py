"""Run registered queries and their SQL twins and compare the rows: python -m tests.compare [sf_dir] [names or prefixes...]"""

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def plain(x):
    import datetime
    import decimal
    import math

    if x is None or isinstance(x, (str, bool)):
        return repr(x)
    if isinstance(x, decimal.Decimal):
        return f"decimal {x}"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return repr(int(x)) if isinstance(x, int) else repr(x)


def differ(spark, sf_dir, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).upper() for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted([plain(r[i]) for i in order] for r in cur.fetchall())
    df = f(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if odd := [f"{n} {t} against {kinds[n]}" for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]]:
        return f"types: {odd}"
    got = sorted([plain(r[c]) for c in sorted(names)] for r in df.collect())
    if got == want:
        return "" if got else "no rows"
    a = [x for x in got if x not in want][:2] if len(got) < 20000 else "many"
    b = [x for x in want if x not in got][:2] if len(got) < 20000 else "many"
    return f"{len(got)} rows against {len(want)}; columns {sorted(names)}; ours {a}; theirs {b}"


def main(args):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from trendloom.plans import registry

    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    wanted = [a for a in args if not a.startswith("/")]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sqls = registry.oracle_sql()
    bad = 0
    for name, f in registry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            said = differ(spark, sf_dir, f, sqls[name]) if name in sqls else f"rows only: {f(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001  a report goes on to the next query
            said = f"{type(e).__name__}: {str(e)[:600]}"
        ok = not said or said.startswith("rows only")
        bad += not ok
        print("ok  " if ok else "BAD ", name, round(time.time() - began, 1), said, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
