"""Compare registered queries with their SQL in DuckDB: `python tests/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from groundset.plans.derived import BASE_TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def _type(name: str) -> str:
    return {
        "VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int",
        "HUGEINT": "hugeint",
    }.get(name, name)


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns, types and the multiset of rows agree."""
    rel = con.sql(sql)
    theirs_types = {c: _type(str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    ours_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    if sorted(theirs_types) != sorted(ours_types):
        return f"columns {sorted(ours_types)} vs {sorted(theirs_types)}"
    types = {c: (ours_types[c], theirs_types[c]) for c in ours_types if ours_types[c] != theirs_types[c]}
    if types:
        return f"types {types}"
    columns = sorted(ours_types)
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in spark_df.collect())
    order = [rel.columns.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
    if ours != theirs:
        only, miss = list((ours - theirs).items()), list((theirs - ours).items())
        return (
            f"rows {sum(ours.values())} vs {sum(theirs.values())}, {len(only)} / {len(miss)} differ on {columns}\n"
            f"  ours {str(sorted(only, key=str)[:2])[:900]}\n  theirs {str(sorted(miss, key=str)[:2])[:900]}"
        )
    return None


def main() -> None:
    import __spark_entry__ as e
    from groundset.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                found = difference(df, con, oracles[name])
            else:
                found = None if df.count() >= 0 else "?"
        except Exception as exc:  # noqa: BLE001
            found = f"{type(exc).__name__}: {str(exc)[:700]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if found is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s", found or "", flush=True)
        if found:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
