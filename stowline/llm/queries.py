"""Queries over the test tables that apply the operators of this folder, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.llm import decontaminate, line_templates, strata_search
from stowline.llm.common import checked_join, remainder, table
from stowline.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stowline.llm.bpe import bpe

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
               ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query("op4_minhash_forest")
def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.minhash_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


@query("op6_line_templates", oracle=line_templates.oracle())
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = cut_lineage(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))
    marked = checked_join(docs.select("doc_id", F.xxhash64("text").alias("t")), found.select("t").distinct(), ["t"], "left_semi")
    return marked.join(found, "t").select("doc_id", "item_id", "start", "shared", "total")


@query("op7_lattice_lm")
def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stowline.llm.lattice_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op1_posting_lists")
def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.posting_lists import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


@query("op3_role_repair")
def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.chat import repair

    return repair(table(spark, sf_dir, "conversations"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op11_strata_search", oracle=strata_search.oracle())
def op11_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the tail of each tenth text by hash set to repeat: with h = crc32(doc_id) and g = h div 10, if
    h % 10 = 0 each word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    made = docs.select("doc_id", "text", remainder("doc_id", 10).alias("h"), F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10).alias("g"))
    made = made.withColumn("words", F.when(F.col("h") == 0, words)).withColumn("n", F.size("words"))
    made = made.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    made = made.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("CAST((n - a) div p + 1 AS INT)")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return made.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowline.llm.periodic import periodic_runs

    return periodic_runs(repeated_tails(table(spark, sf_dir, "documents")),
                         ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stowline.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                         ("n_tokens", "ids_sha256", "decoded_sha256"))
