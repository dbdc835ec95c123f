"""Compare registered queries with their SQL yardstick: python tests/check_oracle.py <sf dir> [name ...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf):
    t = time.time()
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, f"{len(got)} rows, no SQL", t1 - t, 0.0
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = dict(zip(names, (str(d[1]) for d in rel.description)))
    want = rel.fetchall()
    t2 = time.time()
    same_names = sorted(names) == sorted(df.columns)
    a, b = rows_of(got, df.columns), rows_of(want, names)
    message = f"{len(a)} rows"
    if not same_names:
        message += f" COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    alike = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}
    for c, t_ in df.dtypes:
        if alike.get(kinds.get(c)) != t_:
            message += f" TYPE {c}: {t_} vs {kinds.get(c)}"
    if a != b:
        message += f" vs {len(b)}"
        only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        message += f"\n    spark only {str(only_a)[:600]}\n    sql only   {str(only_b)[:600]}"
    return same_names and a == b and "TYPE" not in message and len(a) > 0, message, t1 - t, t2 - t1


if __name__ == "__main__":
    import __spark_entry__ as entry
    from millrace.session import build_session

    sf = sys.argv[1]
    session = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    sqls = entry.oracle_sql()
    wrong = []
    for key, run in entry.queries().items():
        if sys.argv[2:] and not any(key.startswith(p) for p in sys.argv[2:]):
            continue
        try:
            ok, text, ts, td = compare(session, connection, key, run, sqls.get(key), sf)
        except Exception as e:  # noqa: BLE001
            ok, text, ts, td = False, f"{type(e).__name__}: {str(e)[:700]}", 0, 0
        if ok is False:
            wrong.append(key)
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'BAD '} {key:28s} spark {ts:6.2f}s sql {td:6.2f}s  {text}", flush=True)
    print("wrong:", wrong)
