"""Small tables for the tests of this folder."""

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    """Documents with columns whose names clash with what the operators use inside."""
    full = [(d, t, "en", "s", None if t is None else len(t), 1, "x", 2.0) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, d int, t string, score double")


def table_rows(name, columns, sf_dir=SF_DIR):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf_dir}/{name}.parquet')").fetchall()
