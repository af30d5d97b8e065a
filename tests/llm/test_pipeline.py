import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.data import SF_DIR, docs_frame, table_rows
from tests.llm.test_decontaminate import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows after each stage."""
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_DIR).write.parquet(folder)
        docs = spark.read.parquet(folder)
        found.append(docs)
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxic_documents_go(steps):
    start = dict(table_rows("documents", "doc_id, text"))
    kept = texts(steps[0])
    assert kept.items() <= start.items()
    labels = dict(table_rows("labels", "doc_id, toxic"))
    gone = set(start) - set(kept)
    assert all(labels.get(d, 1) for d in gone) and len(kept) >= 0.8 * len(start)


def test_lines_go_and_documents_stay(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert set(before) == set(after)
    for d, text in after.items():
        rest = iter(before[d].split("\n"))
        assert text == "" or all(line in rest for line in text.split("\n"))
    assert all(r.n_chars == len(r.text) for r in steps[1].collect())


def test_one_of_each_group_stays(steps):
    want = {d for d, _, _, kept in brute.near_duplicates(texts(steps[1]).items(), 5) if kept}
    assert set(texts(steps[2])) == want


def test_leaks_go(steps):
    rows = [*texts(steps[2]).items()]
    bad = {d for d, _ in plain(rows, table_rows("benchmark", "item_id, text"))}
    assert set(texts(steps[3])) == {d for d, _ in rows} - bad


def test_encoding_and_columns(steps, spark):
    assert all(df.columns == COLUMNS for df in steps[:-1])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = texts(steps[3])
    for r in steps[4].collect():
        assert r.ids == library.encode(rows.pop(r.doc_id), add_special_tokens=False).ids
    assert not rows
    assert corpus_pipeline.run(spark, SF_DIR).count() == steps[4].count()


def test_stages_take_odd_rows(spark):
    docs = docs_frame(spark, [(1, None), (2, ""), (None, "x"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "long " * 20_000)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF_DIR)
            assert out.columns == docs.columns
            assert out.count() == (0 if some is not docs else 6), name


def test_stages_carry_columns_of_any_name(spark):
    """Columns named like those that the operators add or use inside come back as they were."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "_kept", "kept", "n_lines", "n_dropped", "row", "gone", "t", "x", "margin"]
    line = "the same footer line of every page\n"
    docs = docs_frame(spark, [(i, f"{'abcdefghij'[i % 10] * 3} own words {i} here\n{line}") for i in range(30)]).drop("d", "t", "score")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names), name
