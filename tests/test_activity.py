"""Sessions: what is trimmed and what stays."""

import pyarrow as pa
import pyarrow.parquet as pq

from folioscan.plans import load
from tests.oracle import compare


def test_a_preview_keeps_its_line_end(spark, folder):
    import duckdb

    turns = [("user", "x" * 79 + "\nmore"), ("assistant", "\n"), ("user", "\tb\n "), ("assistant", "c"), ("user", "d"), ("assistant", " \n")]
    rows = [(1, i, r, s) for i, (r, s) in enumerate(turns)] + [(2, i, "user", "\n \n") for i in range(5)]
    names = ["conv_id", "turn", "role", "text"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))), f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    assert compare(spark, con, load()["e7_session_recent"], folder) == ""
