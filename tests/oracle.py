"""Runs a query's SQL on DuckDB over the same tables and compares the rows."""

import os

import duckdb


def differences(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    con.execute("create table wanted as " + sql)
    con.register("found", df.toArrow())
    names = sorted(r[0] for r in con.execute("describe wanted").fetchall())
    assert names == sorted(df.columns)
    cols = ", ".join(f'"{n}"' for n in names)
    one = con.execute(f"select count(*) from (select {cols} from found except all select {cols} from wanted)").fetchall()[0][0]
    two = con.execute(f"select count(*) from (select {cols} from wanted except all select {cols} from found)").fetchall()[0][0]
    return one, two
