"""Folders of awkward tables, made of the smallest ones: empty; with NULLs in every column, repeated rows, empty and very long
texts, and extra columns whose names clash with those the operators use."""

from __future__ import annotations

from pathlib import Path

SMALL = "/root/testdata/sf0.001"
EXTRA = ("score", "rank", "value", "n", "_node", "_key", "node", "key", "tokens", "size", "bucket", "kind", "chars", "unit", "space", "at", "start", "hits")


def make(folder: Path, kind: str) -> str:
    import duckdb

    con = duckdb.connect()
    folder.mkdir(parents=True, exist_ok=True)
    for p in sorted(Path(SMALL).glob("*.parquet")):
        out = folder / p.name
        columns = [c[0] for c in con.execute(f"DESCRIBE SELECT * FROM '{p}'").fetchall()]
        if kind == "empty":
            con.execute(f"COPY (SELECT * FROM '{p}' LIMIT 0) TO '{out}' (FORMAT parquet)")
            continue
        # every column is NULL in some of the rows, each at another place
        holes = ", ".join(f"CASE WHEN (rn + {i}) % 7 = 0 THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(columns))
        extra = ", ".join(f"'clash' AS {e}" for e in EXTRA if e not in columns)
        texts = ""
        if p.stem == "documents":
            sample = {c: "NULL" for c in columns}
            for i, text in enumerate(("''", "'   '", "repeat('word and token ', 6000)", "repeat('x', 60000)", "'​\U0001f469‍\U0001f4bb\r\n\u0000'".replace("\u0000", ""))):
                row = dict(sample, doc_id=str(9_000_000 + i), text=text)
                texts += " UNION ALL SELECT " + ", ".join(f"{row[c]} AS {c}" for c in columns) + ", " + extra
        rows = f"SELECT {holes}, {extra} FROM (SELECT *, row_number() OVER () AS rn FROM '{p}')"
        con.execute(f"COPY (SELECT * FROM ({rows}) UNION ALL SELECT * FROM (SELECT * FROM ({rows}) LIMIT 20){texts}) TO '{out}' (FORMAT parquet)")
    return str(folder)
