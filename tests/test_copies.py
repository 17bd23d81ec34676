"""Queries on tables with rows that share their keys."""

import shutil

from revlens import catalog

from .oracle import differences, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def changed(tmp_path, **tables):
    """A folder of the smallest tables with some of them made anew by SQL over the old ones."""
    folder = tmp_path / "tables"
    shutil.copytree(FOLDER, folder)
    con = duck(FOLDER)
    for name, sql in tables.items():
        (folder / f"{name}.parquet").chmod(0o644)
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_lines_of_one_key_count_one_by_one(spark, tmp_path):
    """Two lines of an order may share part and number, with quantities of their own; an unknown one counts, too."""
    lines = "SELECT * REPLACE (l_orderkey % 40 AS l_orderkey, l_partkey % 20 AS l_partkey, CASE WHEN l_orderkey % 7 > 0 THEN l_quantity END AS l_quantity) FROM lineitem"
    folder = changed(tmp_path, lineitem=lines)
    name = "j02_offset_upper_median"
    assert differences(QUERIES[name](spark, folder), duck(folder), SQL[name]) == ""
