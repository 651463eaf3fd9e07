"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame functions only.

Each document is measured once; the measures are written to the shared folder. A sketch is a
count for each logarithmic bucket of a measure (relative error ALPHA at any size), so merging is
addition: partial counts are combined before the shuffle, a source's sketch is the sum of its
tasks', a language's the sum of its sources', and the result does not depend on their order. A
document is kept if each measure lies within fences around the quartiles of its language and
source; sources of fewer than min_rows documents take their language's, and languages of fewer
take those of all.

Defined cases: a null text has no words and fails the base rules; null languages and sources
count as the empty string; rows that repeat are each judged; ties at a fence are kept. An empty
table gives an empty table. Other columns are kept, nested in `row`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.shared import SPACE_CLASS, written

#: Relative error of a sketch's quantiles, and its base.
ALPHA = 0.005
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Measures with the least width that the fences take for the quartiles' distance.
MEASURES = {"mean_word": 0.25, "symbol_share": 0.02, "dup_line_share": 0.1}
REACH = 4.0
MIN_ROWS = 100
WINDOW = 5
#: Groups, of some 300 bytes each, whose fences are few enough to be sent to every task; more are joined.
FEW_GROUPS = 20_000


def measured(docs: DataFrame, text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row.

    keep is what `row` holds; by default the whole row. Expressions that later ones use more
    than once stay in projections of their own, so each is evaluated once a row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep is None else keep
    d = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    d = d.select(
        "row",
        F.array_remove(F.split("t", SPACE_CLASS), "").alias("w"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    d = d.select(
        "row",
        "n_symbols",
        F.size("w").alias("n"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    rest = ["row", "n", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    runs = F.transform(F.slice("h", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + k) for k in range(1, WINDOW)]))
    d = d.select(*rest, runs.alias("runs"))
    order = F.sort_array(F.transform("runs", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select(*rest, F.when(F.size(F.array_distinct("runs")) < F.size("runs"), order).alias("s"))
    twice = F.filter("s", lambda x, k: x["h"].eqNullSafe(F.get(F.col("s"), k - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("s"), k + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["total"] + i + WINDOW - F.greatest(i, acc["end"])).alias("total"), (i + WINDOW).alias("end")),
        lambda acc: acc["total"],
    )
    return d.select("row", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 10, most_repeated: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _values() -> list[Column]:
    return [
        F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0).alias("mean_word"),
        F.when(F.col("n_words") > 0, F.col("n_symbols") / F.col("n_words")).otherwise(0.0).alias("symbol_share"),
        F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0).alias("dup_line_share"),
    ]


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, measure, bucket, n): the counts of each group's buckets; bucket null holds zeros."""
    long = values.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, MEASURES)), F.array(*MEASURES))).alias("measure", "value"))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.lit(math.log(GAMMA))).cast("int"))
    return long.groupBy(*keys, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(held: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the sums of finer ones."""
    return held.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(held: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, measure, rows, q25, q75); a window holds one group's buckets, of bounded number."""
    group = Window.partitionBy(*keys, "measure")
    run = held.withColumn("upto", F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(group))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * (2 / (1 + GAMMA)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("rows") * q, value))
    return run.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def fences(values: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """(lang, source, limits): for every group, a map from measure to its lowest and highest value kept."""
    fine, _ = written(sketches(values, ["lang", "source"]), "quality-sketches")
    by_source = quartiles(fine, ["lang", "source"])
    by_lang = quartiles(merged(fine, ["lang"]), ["lang"]).withColumnsRenamed({"rows": "l_rows", "q25": "l25", "q75": "l75"})
    overall = quartiles(merged(fine, []), []).withColumnsRenamed({"rows": "a_rows", "q25": "a25", "q75": "a75"})
    all_ = by_source.join(by_lang, ["lang", "measure"]).join(overall, "measure")
    pick = lambda s, l, a: F.when(F.col("rows") >= min_rows, F.col(s)).when(F.col("l_rows") >= min_rows, F.col(l)).otherwise(F.col(a))  # noqa: E731, E741
    least = F.coalesce(*[F.when(F.col("measure") == m, F.lit(w)) for m, w in MEASURES.items()])
    wide = all_.select("lang", "source", "measure", pick("q25", "l25", "a25").alias("q25"), pick("q75", "l75", "a75").alias("q75"))
    width = F.greatest(F.col("q75") - F.col("q25"), least) * reach
    limit = F.struct("measure", F.struct((F.col("q25") - width).alias("low"), (F.col("q75") + width).alias("high")).alias("limit"))
    return wide.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(limit)).alias("limits"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: Column | None = None, min_words: int = 10, most_repeated: int = 20, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """(row, the measures, base_failed, kept) for every row of docs; row holds keep, or the whole row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep is None else keep
    group = lambda c, n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
    rows, _ = written(measured(docs, text_col, F.struct(row.alias("own"), group(lang_col, "lang"), group(source_col, "source"))).withColumn("base_failed", base_failed(min_words, most_repeated)), "quality-measures")
    rows = rows.select(F.col("row.own").alias("row"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *[c for c in rows.columns if c != "row"], *_values())
    limits, _ = written(fences(rows.where(~F.col("base_failed")).select("lang", "source", *MEASURES), min_rows, reach), "quality-fences")
    if limits.count() <= FEW_GROUPS:
        limits = F.broadcast(limits)
    within = F.lit(True)
    for m in MEASURES:
        limit = F.element_at("limits", F.lit(m))
        within = within & F.col(m).between(limit["low"], limit["high"])
    judged = rows.join(limits, ["lang", "source"], "left")
    return judged.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
v AS (SELECT *, CASE WHEN len(w) < {WINDOW} THEN [] ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) END AS runs FROM w),
r AS (SELECT doc_id, row_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM (SELECT *, row_number() OVER () AS row_id FROM v)),
k AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, run) AS c FROM r) WHERE c > 1),
c AS (SELECT row_id, count(DISTINCT i + j) AS n_repeat_words FROM k, (SELECT unnest(range(0, {WINDOW})) AS j) GROUP BY row_id),
m AS (SELECT v.doc_id, v.lang, v.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, row_number() OVER () AS row_id FROM v) v LEFT JOIN c USING (row_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_share,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share FROM m),
u AS (SELECT lang, source, unnest(['mean_word', 'symbol_share', 'dup_line_share']) AS measure, unnest([mean_word::DOUBLE, symbol_share::DOUBLE, dup_line_share::DOUBLE]) AS value FROM b WHERE NOT base_failed),
s AS (SELECT lang, source, measure, CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(GAMMA)!r}) ELSE -1e9 END AS bucket, count(*) AS n FROM u GROUP BY ALL),
g AS (SELECT lang, source, measure, bucket, sum(n) AS n, 0 AS level FROM s GROUP BY ALL
      UNION ALL SELECT lang, NULL, measure, bucket, sum(n), 1 FROM s GROUP BY ALL
      UNION ALL SELECT NULL, NULL, measure, bucket, sum(n), 2 FROM s GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
             CASE WHEN bucket = -1e9 THEN 0.0::DOUBLE ELSE pow({GAMMA!r}::DOUBLE, bucket) * {2 / (1 + GAMMA)!r}::DOUBLE END AS value FROM g),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(value) FILTER (upto >= total * 0.25) AS q25, min(value) FILTER (upto >= total * 0.75) AS q75 FROM h GROUP BY ALL),
p AS (SELECT a.lang, a.source, a.measure,
             CASE WHEN a.total >= {MIN_ROWS} THEN a.q25 WHEN l.total >= {MIN_ROWS} THEN l.q25 ELSE o.q25 END AS q25,
             CASE WHEN a.total >= {MIN_ROWS} THEN a.q75 WHEN l.total >= {MIN_ROWS} THEN l.q75 ELSE o.q75 END AS q75
      FROM q a JOIN q l ON a.level = 0 AND l.level = 1 AND l.lang = a.lang AND l.measure = a.measure JOIN q o ON o.level = 2 AND o.measure = a.measure),
f AS (SELECT lang, source, measure, q25 - {REACH} * greatest(q75 - q25, CASE measure {' '.join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in MEASURES.items())} END) AS low,
             q75 + {REACH} * greatest(q75 - q25, CASE measure {' '.join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in MEASURES.items())} END) AS high FROM p)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
       NOT b.base_failed AND {' AND '.join(f"b.{m} BETWEEN f{i}.low AND f{i}.high" for i, m in enumerate(MEASURES))} AS kept
FROM b {' '.join(f"LEFT JOIN f f{i} ON f{i}.lang = b.lang AND f{i}.source = b.source AND f{i}.measure = '{m}'" for i, m in enumerate(MEASURES))}
"""
