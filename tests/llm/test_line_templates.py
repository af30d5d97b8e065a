import duckdb
import pytest

from stowline.llm.line_templates import drop_recurring_lines, oracle
from stowline.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.data import docs_frame

SF = "/root/testdata/sf0.01"


def test_whole_table_against_sql(spark):
    assert compare(QUERIES["op6_line_templates"](spark, SF), connect(SF), ORACLES["op6_line_templates"]) is None


def body(i):
    return " ".join(chr(97 + (i * 7 + k * k) % 26) * (2 + (i + k) % 5) for k in range(5 + i % 8))


def test_fields_contexts_and_copies(spark):
    rows = [(i, f"{body(i)}\nPage {i} of 90 in all\nuser k{i} said hello there\n{body(i + 100)}") for i in range(12)]
    rows += [(100 + i, f"only copy\nhas this line\nand end{' x' * i}") for i in range(9)]
    got = {r.doc_id: (r.kept, r.n_dropped) for r in drop_recurring_lines(docs_frame(spark, rows)).collect()}
    assert got[3] == (f"{body(3)}\n{body(103)}", 2)
    assert all(got[100 + i][1] == 0 for i in range(9))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines_against_sql(spark, seed):
    import random

    rng = random.Random(seed)
    lines = ["a b c d", "a b c e", "a b c f g", "note 12 x", "note 7 x", "  pad a b", "", " ", "é à b c", "x", "a b c", "a  b c"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1]), (None, rows[1][1]), (203, "\n\n"), (204, "long " * 20_000)]
    frame = docs_frame(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    from pyspark.sql import functions as F

    out = drop_recurring_lines(frame).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))
    assert compare(out, con, oracle()) is None


def test_columns_and_empty_table(spark):
    frame = docs_frame(spark, [(1, "a")])
    assert drop_recurring_lines(frame).columns == [*frame.columns, "kept", "n_lines", "n_dropped"]
    assert drop_recurring_lines(frame.limit(0)).count() == 0
