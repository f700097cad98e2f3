"""Driver queries over corpus R (R1-R14, J4, A3, A4) and the direct-column ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_route_path, quoted_tokens, route_group_prefix, trim_space
from ..operators import routes as R
from .corpus_routes import ORACLE_BY_PARSER, ORACLE_EVENTS, route_corpus
from .registry import query
from .tables import table

WITH = "WITH " + ORACLE_EVENTS


def _routes_query(qname: str, parser: str):
    sql = f"{WITH} SELECT DISTINCT repo_id, method, path, controller FROM ({ORACLE_BY_PARSER[parser]}) t"

    @query(qname, sql)
    def q(spark, sf_dir):
        r = R.routes(route_corpus(spark, sf_dir), [parser])
        return r.select("repo_id", "method", "path", "controller")
    q.__name__ = qname
    return q


for _p in R.PARSERS:
    _routes_query(f"routes_{_p}", _p)

ALL = " UNION ALL ".join(f"SELECT * FROM ({s}) t_{k}" for k, s in ORACLE_BY_PARSER.items())
DEDUP = f"{WITH}, allr AS (SELECT DISTINCT repo_id, method, path, controller FROM ({ALL}) a)"


@query("routes_dedup", DEDUP + " SELECT repo_id, method, path, controller FROM allr")
def routes_dedup(spark, sf_dir):
    return R.routes(route_corpus(spark, sf_dir)).select("repo_id", "method", "path", "controller")


@query("api_groups", DEDUP + """
SELECT repo_id, '/' || split_part(trim(path, '/'), '/', 1) AS prefix, count(*) AS route_count,
       string_agg(DISTINCT method, ',' ORDER BY method) AS methods
FROM allr GROUP BY repo_id, '/' || split_part(trim(path, '/'), '/', 1)
""")
def api_groups(spark, sf_dir):
    g = R.api_groups(R.routes(route_corpus(spark, sf_dir)))
    return g.select("repo_id", "prefix", "route_count", F.array_join("methods", ",").alias("methods"))


@query("route_methods", DEDUP + " SELECT repo_id, method, count(*) AS n_routes FROM allr GROUP BY repo_id, method")
def route_methods(spark, sf_dir):
    return R.route_method_counts(R.routes(route_corpus(spark, sf_dir))).select("repo_id", "method", "n_routes")


@query("route_frameworks", WITH + """
SELECT DISTINCT repo_id, framework FROM (
  SELECT repo_id, CASE fw WHEN 0 THEN 'laravel' WHEN 1 THEN 'express' WHEN 2 THEN 'fastapi' WHEN 3 THEN 'flask'
    WHEN 4 THEN 'django' WHEN 5 THEN 'gin' WHEN 6 THEN 'openapi' WHEN 7 THEN 'openapi' WHEN 8 THEN 'next.js'
    WHEN 9 THEN 'asp.net' ELSE 'spring' END AS framework
  FROM ev WHERE NOT (fw IN (0, 1, 2, 3, 4, 5) AND cancel)
  UNION ALL
  SELECT repo_id, 'fastapi' FROM ev WHERE fw = 3 AND event_id % 2 = 0 AND NOT cancel AND NOT noise) x
""")
def route_frameworks(spark, sf_dir):
    return R.route_frameworks(R.scanned_routes(route_corpus(spark, sf_dir))).select("repo_id", "framework")


# Direct columns -------------------------------------------------------------------------
@query("url_path_groups", """
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
n AS (SELECT page_id, CASE WHEN p = '' THEN '/' WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path FROM u)
SELECT page_id, path, CASE WHEN path = '/' OR trim(path, '/') = '' THEN '/' ELSE '/' || split_part(trim(path, '/'), '/', 1) END AS prefix
FROM n
""")
def url_path_groups(spark, sf_dir):
    pg = table(spark, sf_dir, "pages", "page_id", "url")
    p = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return pg.select("page_id", normalize_route_path(p).alias("path")).select(
        "page_id", "path", route_group_prefix(F.col("path")).alias("prefix"))


@query("props_json_map", """
SELECT event_id, k AS key, CAST(json_extract(props, '$."' || k || '"') AS VARCHAR) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
""")
def props_json_map(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "props")
    m = F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>")
    return e.select("event_id", F.explode(m).alias("key", "v")).select(
        "event_id", "key", F.to_json(F.col("v")).alias("value"))


@query("quoted_strings", """
SELECT page_id, substr(t, 2, length(t) - 2) AS token, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '"[^"]+"|''[^'']+''')) AS t FROM pages)
GROUP BY page_id, substr(t, 2, length(t) - 2)
""")
def quoted_strings(spark, sf_dir):
    pg = table(spark, sf_dir, "pages", "page_id", "html")
    return pg.select("page_id", F.explode(quoted_tokens("html")).alias("token")).groupBy("page_id", "token").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("text_lines", """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS n_nonblank,
       sum(length(l)) AS n_chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id
""")
def text_lines(spark, sf_dir):
    from ..sources.lines import explode_lines
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    f = d.select(F.col("doc_id").cast("string").alias("repo_id"), F.lit("s").alias("snapshot_id"),
                 F.lit("doc").alias("rel_path"), F.col("text").alias("content"), "doc_id")
    ln = explode_lines(f, keep=("doc_id",))
    return ln.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.count_if(trim_space("raw") != "").cast("bigint").alias("n_nonblank"),
        F.sum(F.length("raw")).cast("bigint").alias("n_chars"))
