from __future__ import annotations

import tempfile


def same_rows(df, duck, sql: str) -> None:
    """The rows of ``df`` and of ``sql`` are the same, columns by name, rows as often."""
    folder = tempfile.mkdtemp(prefix="spark-")
    df.write.mode("overwrite").parquet(folder)
    names = sorted(df.columns)
    wanted = duck.sql(sql)
    assert sorted(wanted.columns) == names
    listed = ", ".join(f'"{n}"' for n in names)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {listed} FROM ({sql})")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {listed} FROM '{folder}/*.parquet'")
    count = lambda q: duck.execute(q).fetchone()[0]
    assert count("SELECT count(*) FROM got") == count("SELECT count(*) FROM want")
    for a, b in (("got", "want"), ("want", "got")):
        extra = duck.execute(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 3").fetchall()
        assert not extra, (a, extra)
