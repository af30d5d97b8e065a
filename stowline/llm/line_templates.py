"""Operator 6: lines that recur across documents, by a log-template tree. DataFrame functions only.

The tree has a fixed depth: the number of tokens, then the first ``LEAD`` tokens, in which a token with a digit is a
field. In each leaf, a position is constant if over half of the leaf's different lines agree on it, else a field; a
line with constants in at least half of its positions takes the leaf's template, another one is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import checked_join
from stowline.session import cut_lineage

LEAD = 3
NEIGHBOUR = 12
FIELD = "<*>"
MIN_TEXTS = 5
MIN_CONTEXTS = 5
CONTEXT_SHARE = 5


def _neighbour(lines: Column, i: Column) -> Column:
    return F.coalesce(F.substring(F.get(lines, i), 1, NEIGHBOUR), F.lit(""))


def parsed(texts: DataFrame) -> DataFrame:
    """(t, i, leaf, own, context, masked) of each line with content of (t, x)."""
    split = texts.select("t", F.split("x", "\n", -1).alias("lines"))
    number = F.sequence(F.lit(0), F.size("lines") - 1)
    # The outer form: for the inner one Catalyst adds a filter on the array's size, which splits the text once a line.
    rows = split.select("t", F.explode_outer(F.transform(number, lambda i: F.struct(
        i.alias("i"), F.get(F.col("lines"), i).alias("line"),
        F.xxhash64(_neighbour(F.col("lines"), i - 1), _neighbour(F.col("lines"), i + 1)).alias("context")))).alias("r"))
    line = F.trim(F.col("r.line"))
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)
    named = rows.select("t", "r.i", "r.context", masked.alias("masked")).where("masked <> ''")
    tokens = named.withColumn("tokens", F.split("masked", " ", -1))
    lead = [F.coalesce(F.get("tokens", F.lit(k)), F.lit("")) for k in range(LEAD)]
    return tokens.select("t", "i", F.xxhash64(F.size("tokens"), *lead).alias("leaf"), F.xxhash64("masked").alias("own"), "context", "masked")


def templates(lines: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(t, i, template, context) of the parsed lines in leaves of ``min_texts`` lines or more; others can't recur."""
    kinds = lines.groupBy("leaf", "own").agg(F.count(F.lit(1)).alias("n"))
    busy = cut_lineage(kinds.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where(F.col("n") >= min_texts).select("leaf", "kinds"))
    placed = cut_lineage(checked_join(lines, busy.select("leaf"), ["leaf"], "left_semi"))
    shared = busy.where("kinds > 1")
    inside = checked_join(placed.select("leaf", "own", "masked"), shared.select("leaf"), ["leaf"], "left_semi")
    different = cut_lineage(inside.groupBy("leaf", "own").agg(F.first("masked").alias("masked")))
    tokens = different.select("leaf", "own", F.transform(F.split("masked", " ", -1), lambda w: F.xxhash64(w)).alias("tokens"))
    words = tokens.select("leaf", F.posexplode_outer("tokens").alias("p", "token"))
    counted = words.groupBy("leaf", "p", "token").agg(F.count(F.lit(1)).alias("n"))
    # Only the commonest token of a position can hold over half of the lines; finding it first spreads large leaves.
    leading = counted.groupBy("leaf", "p").agg(F.max_by("token", "n").alias("token"), F.max("n").alias("n"))
    constant = leading.join(shared, "leaf").where("2 * n > kinds").groupBy("leaf").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "token"))).alias("constants"))
    field = F.xxhash64(F.lit(FIELD))
    found = F.transform("tokens", lambda w, p: F.when(F.element_at("constants", p) == w, w).otherwise(field))
    known = tokens.join(constant, "leaf", "left").withColumn("found", found).withColumn(
        "held", F.size(F.filter("found", lambda w: w != field)))
    leaf_template = known.where("held * 2 >= size(tokens)").select("leaf", "own", F.xxhash64("found").alias("shared"))
    named = placed.select("t", "i", "context", "leaf", "own").join(leaf_template, ["leaf", "own"], "left")
    return named.select("t", "i", F.coalesce("shared", "own").alias("template"), "context")


def recurring(lines: DataFrame, min_texts: int = MIN_TEXTS, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """Templates of at least ``min_texts`` different texts and ``min_contexts`` different neighbourhoods.

    The neighbourhoods must also be a fifth of the texts: a template that occurs again and again between the
    same lines belongs to copies of one document, which are not boilerplate.
    """
    seen = lines.groupBy("template", "t", "context").agg(F.lit(1).alias("one"))
    texts = seen.groupBy("template", "t").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("texts"))
    around = seen.groupBy("template", "context").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("contexts"))
    return texts.where(F.col("texts") >= min_texts).join(around, "template").where(
        (F.col("contexts") >= min_contexts) & (F.col("contexts") * CONTEXT_SHARE >= F.col("texts")))


def drop_recurring_lines(docs: DataFrame, text: str = "text", out: str = "kept", min_texts: int = MIN_TEXTS,
                         min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """Every row with ``out`` added, its text without the lines of recurring templates, and n_lines and n_dropped.

    Equal texts count once. Blank lines have no template and stay. A null text stays null with no lines; the empty text
    has one blank line; repeated rows lose the same lines; an empty table gives an empty one. Columns of the input are
    kept as they are; those named like an added one are replaced.
    """
    names = [c for c in docs.columns if c not in (out, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(F.col(text)).alias("t"))
    x = F.col("row").getField(text)
    have = rows.select("t", x.alias("x")).where("x IS NOT NULL")
    lines = cut_lineage(parsed(have))
    placed = cut_lineage(templates(lines, min_texts))
    bad = cut_lineage(recurring(placed, min_texts, min_contexts).select("template"))
    dropped = cut_lineage(
        checked_join(placed, bad, ["template"], "left_semi").groupBy("t").agg(F.collect_set("i").alias("gone"))
    )
    every = F.split(x, "\n", -1)
    total = F.when(x.isNull(), 0).otherwise(F.size(every)).cast("bigint").alias("n_lines")
    keep = F.filter(F.transform(every, lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda z: ~F.array_contains("gone", z["i"]))
    cut = F.when(F.col("gone").isNull(), x).otherwise(F.array_join(F.transform(keep, lambda z: z["line"]), "\n"))
    # One shuffle of the texts, the same at every size. A text meets one row at most, so adaptive execution splits hot texts.
    return rows.join(dropped.hint("merge"), "t", "left").select(
        "row.*", cut.alias(out), total, F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL of :func:`drop_recurring_lines` over a table with doc_id and text."""
    return f"""
WITH texts AS (SELECT DISTINCT text AS t FROM {source} WHERE text IS NOT NULL),
raw AS (SELECT t, string_split(t, chr(10)) AS lines FROM texts),
numbered AS (SELECT t, lines, unnest(range(len(lines))) AS i FROM raw),
masks AS (SELECT t, i, coalesce(left(CASE WHEN i > 0 THEN lines[i] END, {NEIGHBOUR}), '') AS before,
    coalesce(left(lines[i + 2], {NEIGHBOUR}), '') AS after,
    regexp_replace(trim(lines[i + 1], ' '), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g') AS masked FROM numbered),
parsed AS (SELECT *, string_split(masked, ' ') AS tokens FROM masks WHERE masked <> ''),
leafed AS (SELECT *, [len(tokens)::VARCHAR, tokens[1], coalesce(tokens[2], ''), coalesce(tokens[3], '')] AS leaf FROM parsed),
kinds AS (SELECT DISTINCT leaf, masked, tokens FROM leafed),
sizes AS (SELECT leaf, count(*) AS kinds FROM kinds GROUP BY leaf),
places AS (SELECT leaf, unnest(tokens) AS token, unnest(range(len(tokens))) AS p FROM kinds),
constant AS (SELECT leaf, p, token FROM places JOIN sizes USING (leaf) GROUP BY leaf, p, token, kinds HAVING 2 * count(*) > kinds),
perleaf AS (SELECT leaf, list(p) AS ps, list(token) AS ts FROM constant GROUP BY leaf),
held AS (SELECT l.*, list_transform(range(len(tokens)), lambda p: CASE WHEN list_position(ps, p) IS NOT NULL
    AND ts[list_position(ps, p)] = tokens[p + 1] THEN tokens[p + 1] ELSE '{FIELD}' END) AS found
    FROM leafed l LEFT JOIN perleaf USING (leaf)),
named AS (SELECT t, i, before, after, CASE WHEN kinds = 1 THEN masked
    WHEN 2 * len(list_filter(found, lambda w: w <> '{FIELD}')) >= len(tokens) THEN array_to_string(found, ' ')
    ELSE masked END AS template FROM held JOIN sizes USING (leaf)),
bad AS (SELECT template FROM named GROUP BY template HAVING count(DISTINCT t) >= {MIN_TEXTS}
    AND count(DISTINCT [before, after]) >= {MIN_CONTEXTS} AND {CONTEXT_SHARE} * count(DISTINCT [before, after]) >= count(DISTINCT t)),
gone AS (SELECT t, list(i) AS gone FROM named WHERE template IN (SELECT template FROM bad) GROUP BY t),
cut AS (SELECT t, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_dropped, CASE WHEN gone IS NULL THEN t ELSE array_to_string(
    list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)) END AS kept
    FROM raw LEFT JOIN gone USING (t))
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_dropped, 0)::BIGINT AS n_dropped, md5(c.kept) AS kept_md5
FROM {source} d LEFT JOIN cut c ON d.text = c.t
"""
