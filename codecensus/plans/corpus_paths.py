"""Corpus P: repository trees derived from ``orders`` (paths only).

repo = o_custkey; directory template = o_orderkey % 10; base-name
template = (o_orderkey div 10) % 24; non-root directories get a segment
``m{o_orderkey % 7}``.  Distinct on (repo, path), keeping the smallest order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import with_path_columns
from .tables import table

DIRS = ["", "cmd/svc", "src/app", "src/tests/unit", "internal/api/v1", "k8s/base", "routes",
        ".github/workflows", "node_modules/x", "a/build/b"]
BASES = ["package.json", "go.mod", "requirements.txt", "pom.xml", "App.csproj", "openapi.yaml",
         "next.config.js", "docker-compose.yml", "Dockerfile", ".env.local", "main.tf", "deployment.yaml",
         "app.yaml", "util.go", "index.js", "view.tsx", "model.py", "web.php", "Service.java",
         "Program.cs", "handler_test.go", "test_model.py", "main.go", "README.md"]


def path_corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, snapshot_id, project_name, rel_path, content) before pruning."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    dir_t = (F.col("o_orderkey") % 10).cast("int")
    base_t = (F.expr("o_orderkey div 10") % 24).cast("int")
    d = F.element_at(F.array(*[F.lit(x) for x in DIRS]), dir_t + 1)
    b = F.element_at(F.array(*[F.lit(x) for x in BASES]), base_t + 1)
    rel = F.when(dir_t == 0, b).otherwise(F.concat_ws("/", d, F.concat(F.lit("m"), (F.col("o_orderkey") % 7).cast("string")), b))
    repo = F.concat(F.lit("r"), F.col("o_custkey").cast("string"))
    df = o.select(repo.alias("repo_id"), rel.alias("rel_path"), "o_orderkey")
    df = df.groupBy("repo_id", "rel_path").agg(F.min("o_orderkey").alias("o_orderkey"))
    return df.select(
        "repo_id", F.lit("s1").alias("snapshot_id"), F.col("repo_id").alias("project_name"), "rel_path",
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("content"),
    )


def path_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus P as an unpruned ``files`` table."""
    from .materialize import corpus
    return corpus(spark, sf_dir, "paths", lambda: with_path_columns(path_corpus_raw(spark, sf_dir)))


# ---- oracle side: the expected flags per template, written out by hand -----------
# (base, manifest_kind, is_config, language, is_test, is_entry, is_marker)
EXPECTED_BASE_FLAGS = [
    ("package.json", "dependency", False, None, False, False, True),
    ("go.mod", "dependency", False, None, False, False, True),
    ("requirements.txt", "dependency", False, None, False, False, True),
    ("pom.xml", "dependency", False, None, False, False, True),
    ("App.csproj", "dependency", False, None, False, False, True),
    ("openapi.yaml", "api", False, None, False, False, True),
    ("next.config.js", "configuration", False, "javascript", False, False, True),
    ("docker-compose.yml", "infrastructure", True, None, False, False, False),
    ("Dockerfile", "runtime", True, None, False, True, False),
    (".env.local", "runtime", True, None, False, False, False),
    ("main.tf", "infrastructure", True, None, False, False, False),
    ("deployment.yaml", "infrastructure", True, None, False, False, False),
    ("app.yaml", None, False, None, False, False, False),
    ("util.go", None, False, "go", False, False, False),
    ("index.js", None, False, "javascript", False, True, False),
    ("view.tsx", None, False, "typescript", False, False, False),
    ("model.py", None, False, "python", False, False, False),
    ("web.php", None, False, "php", False, False, False),
    ("Service.java", None, False, "java", False, False, False),
    ("Program.cs", None, False, "csharp", False, False, False),
    ("handler_test.go", None, False, "go", True, False, False),
    ("test_model.py", None, False, "python", True, False, False),
    ("main.go", None, False, "go", False, True, False),
    ("README.md", None, False, None, False, False, False),
]


def _sql_lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def oracle_files_cte() -> str:
    """DuckDB CTEs ``pf`` (every generated file) and ``pk`` (kept files with expected flags)."""
    bases = ",".join(
        f"({i},{_sql_lit(b)},{_sql_lit(k)},{_sql_lit(c)},{_sql_lit(l)},{_sql_lit(t)},{_sql_lit(e)},{_sql_lit(m)})"
        for i, (b, k, c, l, t, e, m) in enumerate(EXPECTED_BASE_FLAGS))
    dirs = ",".join(f"({i},{_sql_lit(d)})" for i, d in enumerate(DIRS))
    return f"""
pb(base_t, base, b_kind, b_config, b_lang, b_test, b_entry, b_marker) AS (VALUES {bases}),
pd(dir_t, dir) AS (VALUES {dirs}),
po AS (
  SELECT 'r' || CAST(o_custkey AS VARCHAR) AS repo_id, o_orderkey,
         CAST(o_orderkey % 10 AS INTEGER) AS dir_t, CAST((o_orderkey // 10) % 24 AS INTEGER) AS base_t,
         CAST(o_orderkey % 7 AS INTEGER) AS m
  FROM orders),
pf AS (
  SELECT repo_id, rel_path, min(dir_t) AS dir_t, min(base_t) AS base_t, min(m) AS m FROM (
    SELECT po.*, CASE WHEN po.dir_t = 0 THEN pb.base ELSE pd.dir || '/m' || CAST(po.m AS VARCHAR) || '/' || pb.base END AS rel_path
    FROM po JOIN pb ON po.base_t = pb.base_t JOIN pd ON po.dir_t = pd.dir_t) x
  GROUP BY repo_id, rel_path),
pk AS (
  SELECT pf.repo_id, pf.rel_path, pb.base,
    CASE WHEN pb.base = 'app.yaml' AND pf.dir_t = 5 THEN 'infrastructure' ELSE pb.b_kind END AS manifest_kind,
    (pb.b_config OR (pf.dir_t = 5 AND pb.base IN ('openapi.yaml', 'app.yaml'))) AS is_config,
    pb.b_lang AS source_language,
    (pb.b_test OR pf.dir_t = 3) AS is_test,
    (pb.b_entry OR (pb.base = 'web.php' AND pf.dir_t = 6)) AS is_entry,
    pb.b_marker AS is_marker,
    CASE WHEN pf.dir_t = 0 THEN 'root'
         WHEN pf.dir_t = 6 THEN 'routes/m' || CAST(pf.m AS VARCHAR)
         ELSE split_part(pd.dir, '/', 1) || '/' || split_part(pd.dir, '/', 2) END AS dir_key
  FROM pf JOIN pb ON pf.base_t = pb.base_t JOIN pd ON pf.dir_t = pd.dir_t
  WHERE pf.dir_t NOT IN (7, 8, 9)),
pkn AS (
  SELECT *, (manifest_kind IS NOT NULL OR is_entry OR base = 'README.md') AS is_notable FROM pk)
"""
