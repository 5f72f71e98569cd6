"""Tables of the driver as Python rows."""

from __future__ import annotations


def rows_of(sf_dir: str, table: str, *columns: str) -> list[tuple]:
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/{table}.parquet", columns=list(columns))
    return list(zip(*(t[c].to_pylist() for c in columns), strict=True))
