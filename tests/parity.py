"""Runs queries and their SQL on one test table set and compares rows, as sets with counts. Usage: python tests/parity.py sf_dir [name...]"""

import math
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return str(v)


def difference(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]", "void": "INTEGER"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    odd = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t, t) != types[n]]
    if odd:
        return f"types differ: {odd}"
    order = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only SQL {list((theirs - ours).items())[:2]}"


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}')")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    q, s = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or sorted(s):
        try:
            print(n, difference(session, connect(sys.argv[1]), n, q[n], s[n], sys.argv[1]) or "same", flush=True)
        except Exception as e:
            print(n, "ERROR", str(e)[:700].replace("\n", " "), flush=True)
