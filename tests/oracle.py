"""Run a registered query and its SQL check on the same tables and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(table: pa.Table) -> pd.DataFrame:
    """Columns by name; numbers as float64, dates and booleans as text; rows sorted."""
    columns = {}
    for name in sorted(table.column_names):
        column = table.column(name)
        kind = column.type
        if pa.types.is_decimal(kind) or pa.types.is_integer(kind) or pa.types.is_floating(kind):
            columns[name] = column.cast(pa.float64()).to_pandas()
        elif pa.types.is_timestamp(kind):
            columns[name] = column.cast(pa.date32()).cast(pa.string()).to_pandas()
        else:
            columns[name] = column.cast(pa.string()).to_pandas()
    frame = pd.DataFrame(columns)
    # text columns first, so that a last-digit difference cannot reorder the rows
    order = sorted(frame.columns, key=lambda c: (frame[c].dtype == float, c))
    return frame.sort_values(order, ignore_index=True) if order else frame


def compare(spark, con, run, sql: str, folder: str) -> str | None:
    """None when both sides agree exactly, else a description of the difference."""
    ours = _plain(run(spark, folder).toArrow())
    theirs = _plain(con.execute(sql).to_arrow_table())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} != {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    same = (ours == theirs) | (ours.isna() & theirs.isna())
    bad = ~same.all(axis=1)
    if bad.any():
        first = bad.idxmax()
        return (f"{int(bad.sum())} of {len(ours)} rows differ, e.g. {ours.loc[first].to_dict()} "
                f"!= {theirs.loc[first].to_dict()}")
    return None
