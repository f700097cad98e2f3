"""Driver queries over corpus M."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as M
from .corpus_manifests import oracle_truth_cte
from .registry import query

COLS = ["repo_id", "rel_path", "name", "version"]


def _deps(spark, sf_dir, managers):
    from .corpus_manifests import manifest_corpus
    return M.dependencies(manifest_corpus(spark, sf_dir), managers)


def _simple(qname, manager_key, out_manager, spec):
    sql = f"SELECT repo_id, rel_path, '{out_manager}' AS manager, name, version FROM ({oracle_truth_cte(spec)})"

    @query(qname, sql)
    def q(spark, sf_dir):
        d = _deps(spark, sf_dir, [manager_key]).filter(F.col("manager") == out_manager)
        return d.select("repo_id", "rel_path", "manager", "name", "version")
    q.__name__ = qname
    return q


deps_npm = _simple("deps_npm", "npm", "npm", "npm")
deps_composer = _simple("deps_composer", "composer", "composer", "composer")
deps_gomod = _simple("deps_gomod", "go", "go", "go")
deps_cargo = _simple("deps_cargo", "cargo", "cargo", "cargo")
deps_pip = _simple("deps_pip", "pip", "pip", "pip")
deps_maven = _simple("deps_maven", "maven", "maven", "maven")
deps_gradle = _simple("deps_gradle", "gradle", "gradle", "gradle")
deps_nuget = _simple("deps_nuget", "nuget", "nuget", "nuget")


@query("deps_pyproject", f"""
SELECT repo_id, rel_path, 'pip' AS manager, name, version FROM ({oracle_truth_cte('pyproject_pip')})
UNION ALL
SELECT repo_id, rel_path, 'poetry' AS manager, name, version FROM ({oracle_truth_cte('poetry')})
""")
def deps_pyproject(spark, sf_dir):
    return _deps(spark, sf_dir, ["pyproject"]).select("repo_id", "rel_path", "manager", "name", "version")


ALL_TRUTH = " UNION ALL ".join(
    f"SELECT repo_id, rel_path, '{mgr}' AS manager, name, version FROM ({oracle_truth_cte(spec)})"
    for spec, mgr in [("go", "go"), ("npm", "npm"), ("composer", "composer"), ("cargo", "cargo"), ("pip", "pip"),
                      ("pyproject_pip", "pip"), ("poetry", "poetry"), ("maven", "maven"), ("gradle", "gradle"),
                      ("nuget", "nuget")])


@query("deps_by_manager", f"""
SELECT repo_id, manager, count(*) AS n_deps FROM ({ALL_TRUTH}) t GROUP BY repo_id, manager
""")
def deps_by_manager(spark, sf_dir):
    d = _deps(spark, sf_dir, None)
    return d.groupBy("repo_id", "manager").agg(F.count(F.lit(1)).cast("bigint").alias("n_deps"))


@query("deps_rollup", f"""
SELECT repo_id, coalesce(manager, '(total)') AS manager, count(*) AS n_deps
FROM ({ALL_TRUTH}) t GROUP BY ROLLUP (repo_id, manager) HAVING repo_id IS NOT NULL
""")
def deps_rollup(spark, sf_dir):
    c = M.dependency_counts(_deps(spark, sf_dir, None))
    return c.select("repo_id", F.coalesce("manager", F.lit("(total)")).alias("manager"), "n_deps")


@query("framework_from_deps", f"""
WITH fr(manager, kind, needle, framework) AS (VALUES
  ('composer','eq','laravel/framework','laravel'), ('npm','eq','react','react'), ('npm','eq','express','express'),
  ('npm','eq','next','next.js'), ('npm','eq','@angular/core','angular'), ('npm','eq','angular','angular'),
  ('maven','suffix',':spring-boot-starter-web','spring'), ('maven','suffix',':spring-webmvc','spring'),
  ('maven','suffix',':spring-web','spring'), ('maven','suffix',':spring-boot-starter-webflux','spring'),
  ('gradle','suffix',':spring-boot-starter-web','spring'), ('gradle','suffix',':spring-webmvc','spring'),
  ('gradle','suffix',':spring-web','spring'), ('gradle','suffix',':spring-boot-starter-webflux','spring'),
  ('go','eq','github.com/gin-gonic/gin','gin'), ('go','eq','github.com/labstack/echo/v4','echo'),
  ('nuget','contains','aspnetcore','asp.net'),
  ('pip','eq','django','django'), ('pip','eq','fastapi','fastapi'), ('pip','eq','flask','flask'),
  ('poetry','eq','django','django'), ('poetry','eq','fastapi','fastapi'), ('poetry','eq','flask','flask'))
SELECT DISTINCT t.repo_id, fr.framework FROM ({ALL_TRUTH}) t JOIN fr ON t.manager = fr.manager AND (
  (fr.kind = 'eq' AND lower(t.name) = fr.needle) OR (fr.kind = 'suffix' AND ends_with(lower(t.name), fr.needle))
  OR (fr.kind = 'contains' AND contains(lower(t.name), fr.needle)))
""")
def framework_from_deps(spark, sf_dir):
    """Flagship: which frameworks each repository depends on."""
    return M.frameworks_from_dependencies(_deps(spark, sf_dir, None)).select("repo_id", "framework")
