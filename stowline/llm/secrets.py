"""Operator 5: secret scan, with a random forest that removes false positives. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import WORD_SPLIT, checked_join, pick
from stowline.session import cut_lineage

SAMPLE_ROWS = 6000
DICTIONARY = 20_000
SHAPE = "[A-Za-z0-9+/_=-]{12,}"
KEYWORDS = "(?i)(token|secret|passw|pwd|api|key|auth|credential|bearer)"
#: Formats that name their issuer, and look-alikes; both give first labels where no labelled findings are supplied.
SURE = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})$"
HARMLESS = "(^[0-9]+$|^[A-Za-z]+$|@|://|^[=_/+-]+$|^[A-Za-z]+([/_-][A-Za-z]+)*$)"
FEATURES = ("length", "transitions", "distinct_share", "digit_share", "upper_share", "hex", "coverage", "path", "keyword", "assigned", "quoted")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, "^[^A-Za-z0-9+/_=-]+|[^A-Za-z0-9+/_=-]+$", "")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(t, place, word, finding, before, before2): words that hold a run of at least 12 characters of keys, with neighbours."""
    own = pick(docs, x=text).where("x IS NOT NULL").where(F.col("x").rlike(SHAPE))
    words = own.select(F.xxhash64("x").alias("t"), F.split("x", WORD_SPLIT, -1).alias("w"))
    at = F.transform("w", lambda w, i: F.when((F.length(w) >= 12) & w.rlike(SHAPE) & w.rlike("[0-9+/_=-]"), i))
    # The outer form: for the inner one Catalyst adds a filter on the array's size, which splits the text again.
    places = words.select("t", "w", F.filter(at, lambda i: i.isNotNull()).alias("at")).select("t", "w", F.explode_outer("at").alias("place")).where("place IS NOT NULL")
    near = lambda k: F.coalesce(F.when(F.col("place") >= k, F.get("w", F.col("place") - k)), F.lit(""))
    return places.select("t", "place", F.get("w", "place").alias("word"), near(1).alias("before"), near(2).alias("before2")).withColumn(
        "finding", _core(F.col("word"))).where(F.length("finding") >= 12).distinct()


def dictionary(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> DataFrame:
    """The ``most`` words of four letters or more that the corpus uses most often; the bound is what makes it a small table."""
    words = pick(docs, x=text).select(F.explode_outer(F.split(F.lower("x"), "[^a-z]+", -1)).alias("run")).where(F.length("run") >= 4)
    return words.groupBy("run").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run").limit(most).select("run")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the features of the forest."""
    c = F.col("finding")
    n = F.length(c)
    edges = F.regexp_replace(c, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])", " ")
    kinds = cut_lineage(found.select("finding").distinct())
    runs = kinds.select("finding", F.explode_outer(F.split(F.lower("finding"), "[^a-z]+", -1)).alias("run"))
    cover = runs.join(F.broadcast(words.withColumn("known", F.lit(True))), "run", "left").groupBy("finding").agg(
        F.sum(F.when(F.col("known"), F.length("run")).otherwise(0)).alias("covered"))
    both = F.concat_ws(" ", "before2", "before", "word")
    return found.join(cover, "finding").select(
        "*", n.cast("double").alias("length"), ((F.length(edges) - n) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64))).alias("distinct_share"),
        (F.length(F.regexp_replace(c, "[^0-9]", "")) / n).alias("digit_share"), (F.length(F.regexp_replace(c, "[^A-Z]", "")) / n).alias("upper_share"),
        c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"), (F.col("covered") / n).alias("coverage"),
        F.col("word").rlike("[/\\\\].*[/\\\\]|://|@").cast("double").alias("path"), both.rlike(KEYWORDS).cast("double").alias("keyword"),
        (F.col("before").rlike("[=:]$") | F.col("word").rlike("^[A-Za-z_]+[=:]")).cast("double").alias("assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"))


def first_labels(rows: DataFrame) -> DataFrame:
    """Findings labelled by their form alone: an issuer's format, or a literal assigned to a keyword, against plain look-alikes."""
    sure = F.col("finding").rlike(SURE) | ((F.col("keyword") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & ~F.col("finding").rlike(HARMLESS))
    return rows.withColumn("label", F.when(sure, 1.0).when(F.col("finding").rlike(HARMLESS) | (F.col("path") == 1), 0.0)).where("label IS NOT NULL")


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RandomForestClassificationModel | None:
    """Forest over at most ``sample_rows`` labelled findings, half of each label, by hash; None unless both labels occur."""
    parts = [labelled.where(F.col("label") == y).dropDuplicates(["finding"]).orderBy(F.xxhash64("finding"), "finding").limit(sample_rows // 2) for y in (0.0, 1.0)]
    sample = cut_lineage(parts[0].unionByName(parts[1]).select("label", *FEATURES).coalesce(1).sortWithinPartitions("label", *FEATURES))
    if sample.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=20, maxDepth=6, seed=7, subsamplingRate=1.0).fit(ready)


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, place, finding, probability, secret) of each candidate; place counts words from 0.

    ``labelled`` holds findings as :func:`described` gives them, with a label 0 or 1; by default the labels come from
    :func:`first_labels` over all candidates. With one label only, all candidates get that of the form rule. Null and
    empty texts have no candidates; null ids are kept; repeated rows have the same findings; an empty table gives an
    empty one; other columns are ignored. Texts are read whole.
    """
    rows = cut_lineage(described(cut_lineage(candidates(docs, doc_id, text)), cut_lineage(dictionary(docs, text))))
    model = fit(first_labels(rows) if labelled is None else labelled)
    if model is None:
        scored = rows.withColumn("probability", (F.col("finding").rlike(SURE) | ((F.col("keyword") == 1) & (F.col("assigned") == 1))).cast("double"))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(ready).withColumn("probability", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    found = scored.select("t", "place", "finding", "probability", (F.col("probability") >= threshold).alias("secret"))
    owners = checked_join(pick(docs, d=doc_id, x=text).select("d", F.xxhash64("x").alias("t")), found.select("t").distinct(), ["t"], "left_semi")
    return owners.join(found, "t").select(F.col("d").alias(doc_id), "place", "finding", "probability", "secret")
