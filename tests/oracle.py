"""Run the registered queries next to their SQL twins and compare the rows.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


FAMILIES = {"int": "int", "bigint": "int", "string": "text", "boolean": "bool", "double": "float", "timestamp_ntz": "time"}
DUCK_FAMILIES = {"BIGINT": "int", "INTEGER": "int", "VARCHAR": "text", "BOOLEAN": "bool", "DOUBLE": "float", "TIMESTAMP": "time"}


def compare(spark, con, name, build, sql, sf_dir):
    """Empty string when both sides agree, else what differs."""
    df = build(spark, sf_dir)
    columns, got = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    duck_columns = [d[0] for d in relation.description]
    duck_types = {d[0]: str(d[1]) for d in relation.description}
    want_columns, want = rows_by_name(duck_columns, relation.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    odd = [c for c in columns if FAMILIES.get(types[c]) != DUCK_FAMILIES.get(duck_types[c])]
    if odd:
        return f"types {[(c, types[c], duck_types[c]) for c in odd]}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"{sum(got.values())} vs {sum(want.values())} rows; only here {extra}; only in SQL {missing}"
    return "" if got else "no rows on either side"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from fieldlake.session import create_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = create_session(
        "oracle", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, build, oracles[name], sf_dir)
            else:
                problem = "" if build(spark, sf_dir).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - begin:6.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
