"""Compare registered queries with their SQL twins: python tests/oracle.py [sf_dir] [key-prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = [
    "region nation customer supplier part orders lineitem events documents",
    "embeddings pages benchmark labels conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in " ".join(TABLES).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def _plain(v):
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


def differences(spark_df, con, sql: str) -> list[str]:
    """Messages on how the two results differ; none when they are equal."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(want_columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(want_columns)}"]
    got, want = _rows(spark_df.columns, got_rows), _rows(want_columns, want_rows)
    out = []
    if len(got) != len(want):
        out.append(f"{len(got)} rows, expected {len(want)}")
    out += [f"got {g}\n  expected {w}" for g, w in zip(got, want) if g != w][:3]
    if not want:
        out.append("no rows to compare")
    return out


def main() -> None:
    import __spark_entry__ as contract
    from spendlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = contract.oracle_sql()
    bad = 0
    for key, query in contract.queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if key in oracle:
                found = differences(query(spark, sf_dir), con, oracle[key])
            else:
                n = query(spark, sf_dir).count()
                found = [] if n else ["no rows"]
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        state = "ok" if not found else "FAIL"
        bad += bool(found)
        print(f"{state:5}{'' if key in oracle else '(rows only) '}{key} {time.time() - start:.2f}s", flush=True)
        for f in found:
            print("  " + f[:3000], flush=True)
    print(f"{bad} failing")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
