"""Quality rules: rule failures by host, rates shrunk by an empirical beta prior, host verdicts back on documents (DataFrame and SQL only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, joined, pick, prepare, saved, table

SYMBOLS = "#*$%&|<>"
#: A host is distrusted when its shrunk failure rate of any rule reaches this; its documents must then fail no rule.
DISTRUST = 0.5
#: Rules: SQL over the statistics of a document.
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "20 * n_dup_lines > n_words",
}


def statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to rows with a column ``text``; null counts as empty.

    A word is repeated when it lies in a three-word window that occurs twice or more. Windows are compared by 64-bit
    hashes inside the row: sorted, equal neighbours mark their positions, and the marked positions' windows are united.
    """
    t = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_w", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    out = out.withColumn("_h", F.expr("slice(transform(_w, (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))), 1, greatest(0, size(_w) - 2))"))
    out = out.withColumn("_s", F.expr("""if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>),
        sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))))"""))
    out = out.withColumn("_p", F.expr("""sort_array(transform(filter(_s, (s, k) -> s.h = get(_s, k - 1).h or s.h = get(_s, k + 1).h), s -> s.i))"""))
    repeat = F.expr("aggregate(transform(_p, (p, k) -> least(3, coalesce(get(_p, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    out = out.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")))
    long = lambda c: c.cast("long")
    return out.withColumns({
        "n_words": long(F.size("_w")), "word_chars": long(F.length(F.translate(t, BLANKS, ""))),
        "n_symbols": long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
        "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))), "n_repeat_words": repeat,
    }).drop("_w", "_h", "_s", "_p", "_l")


def host_verdicts(stats: DataFrame) -> DataFrame:
    """(source, distrusted) from a written table of statistics.

    Each host's failure rate f / n of a rule is shrunk to (a + f) / (a + b + n). The beta prior (a, b) of a rule has the mean
    and variance of the hosts' rates; it never counts for less than one document nor more than 10,000. Null is a host.
    """
    fails = {f"f_{k}": F.sum(F.expr(f"int({v})")) for k, v in RULES.items()}
    hosts = saved(stats.groupBy("source").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in fails.items()]), "hosts")
    prior = hosts.agg(*[f(F.col(f"f_{k}") / F.col("n")).alias(f"{k}_{name}") for k in RULES for name, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    bad = F.lit(False)
    for k in RULES:
        mean, var = prior[f"{k}_mean"] or 0.0, prior[f"{k}_var"] or 0.0
        weight = min(10_000.0, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else 1.0
        bad = bad | ((F.col(f"f_{k}") + weight * mean) / (F.col("n") + weight) >= DISTRUST)
    return hosts.select("source", bad.alias("distrusted"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distrusted.

    Texts are read once; the rest works on a narrow written table. Null and empty texts have no words and fail the base
    rule; null sources are one host; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    stats = saved(statistics(pick(docs, "doc_id", "source", "text")).drop("text"), "rule-statistics")
    out = joined(stats, host_verdicts(stats), ["source"])
    failed, any_rule = F.expr(RULES["base"]), F.expr(" or ".join(f"({v})" for v in RULES.values()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & ~(F.col("distrusted") & any_rule)).alias("kept"), "distrusted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every whole document."""
    prepare(spark)
    return quality_rules(table(spark, sf_dir, "documents"))


_RULE_SQL = {k: v.replace("or", "OR") for k, v in RULES.items()}
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
       WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
h AS (SELECT source, count(*) AS n, {', '.join(f"sum(({v})::INT) AS f_{k}" for k, v in _RULE_SQL.items())} FROM s GROUP BY source),
p AS (SELECT {', '.join(f"avg(f_{k} / n) AS m_{k}, var_pop(f_{k} / n) AS v_{k}" for k in RULES)} FROM h),
q AS (SELECT {', '.join(f"m_{k}, CASE WHEN v_{k} > 0 THEN least(10000.0, greatest(1.0, m_{k} * (1 - m_{k}) / v_{k} - 1)) ELSE 1.0 END AS k_{k}" for k in RULES)} FROM p),
b AS (SELECT source, {' OR '.join(f"(f_{k} + k_{k} * m_{k}) / (n + k_{k}) >= {DISTRUST}" for k in RULES)} AS distrusted FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULE_SQL['base']}) AS base_failed,
       NOT ({_RULE_SQL['base']}) AND NOT (distrusted AND ({' OR '.join(f'({v})' for v in _RULE_SQL.values())})) AS kept, distrusted
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source
"""
