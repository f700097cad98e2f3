"""Driver queries comparing two snapshots.

The old side of corpus M has the rows shipped before a day, the new side those of
later days too, but for suppliers that don't change, rows that go, suppliers that
only the old side has and suppliers that only the new side has. Corpus R likewise,
by users and events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import infra as I
from ..operators import manifests as M
from ..operators import routes as R
from ..operators import structure as S
from ..session import saved
from .corpus_manifests import manifest_corpus, oracle_truth_cte
from .corpus_routes import ORACLE_BY_PARSER, oracle_events, route_corpus
from .registry import query

OLD_M = "l_shipdate < TIMESTAMP '1998-07-01' AND l_suppkey % 10 <> 7"
NEW_M = ("(l_shipdate < TIMESTAMP '1998-07-01' OR l_suppkey % 5 <> 0) AND l_suppkey % 10 <> 4"
         " AND NOT (l_suppkey % 5 = 1 AND l_partkey % 4 = 1)")
OLD_R = "ts < TIMESTAMP '2024-01-15'"
NEW_R = "(ts < TIMESTAMP '2024-01-15' OR user_id % 5 <> 0) AND NOT (user_id % 5 = 1 AND event_id % 4 = 1)"
SPECS = [("go", "go"), ("npm", "npm"), ("composer", "composer"), ("cargo", "cargo"), ("pip", "pip"),
         ("pyproject_pip", "pip"), ("poetry", "poetry"), ("maven", "maven"), ("gradle", "gradle"), ("nuget", "nuget")]


def _truth(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT repo_id, rel_path, '{mgr}' AS manager, name, version FROM ({oracle_truth_cte(spec, where)})"
        for spec, mgr in SPECS)


ORACLE_DEPS = f"""
new_d AS ({_truth(NEW_M)}),
old_d AS ({_truth(OLD_M)}),
added_d AS (SELECT repo_id, 'added' AS op, manager, name, version FROM new_d n
  WHERE NOT EXISTS (SELECT 1 FROM old_d o WHERE o.repo_id = n.repo_id AND o.manager = n.manager AND o.name = n.name AND o.version = n.version)),
removed_d AS (SELECT repo_id, 'removed' AS op, manager, name, version FROM old_d o
  WHERE NOT EXISTS (SELECT 1 FROM new_d n WHERE o.repo_id = n.repo_id AND o.manager = n.manager AND o.name = n.name AND o.version = n.version)),
dchg AS (SELECT * FROM added_d UNION ALL SELECT * FROM removed_d)"""

FW_VALUES = """fr(manager, kind, needle, framework) AS (VALUES
  ('composer','eq','laravel/framework','laravel'), ('npm','eq','react','react'), ('npm','eq','express','express'),
  ('npm','eq','next','next.js'), ('npm','eq','@angular/core','angular'), ('npm','eq','angular','angular'),
  ('maven','suffix',':spring-boot-starter-web','spring'), ('maven','suffix',':spring-webmvc','spring'),
  ('maven','suffix',':spring-web','spring'), ('maven','suffix',':spring-boot-starter-webflux','spring'),
  ('gradle','suffix',':spring-boot-starter-web','spring'), ('gradle','suffix',':spring-webmvc','spring'),
  ('gradle','suffix',':spring-web','spring'), ('gradle','suffix',':spring-boot-starter-webflux','spring'),
  ('go','eq','github.com/gin-gonic/gin','gin'), ('go','eq','github.com/labstack/echo/v4','echo'),
  ('nuget','contains','aspnetcore','asp.net'),
  ('pip','eq','django','django'), ('pip','eq','fastapi','fastapi'), ('pip','eq','flask','flask'),
  ('poetry','eq','django','django'), ('poetry','eq','fastapi','fastapi'), ('poetry','eq','flask','flask'))"""


def _facet_sql(side: str) -> str:
    return f"""
  SELECT DISTINCT repo_id, 'languages' AS facet, l.v AS value FROM {side}_d,
    (VALUES ('php'), ('javascript'), ('go'), ('rust'), ('python'), ('java'), ('csharp')) l(v)
  UNION ALL SELECT DISTINCT repo_id, 'packageManagers', m.v FROM {side}_d,
    (VALUES ('composer'), ('npm'), ('go'), ('cargo'), ('pip'), ('maven'), ('gradle'), ('nuget')) m(v)
  UNION ALL SELECT DISTINCT repo_id, 'packageManagers', manager FROM {side}_d
  UNION ALL SELECT DISTINCT t.repo_id, 'frameworks', fr.framework FROM {side}_d t JOIN fr ON t.manager = fr.manager AND (
    (fr.kind = 'eq' AND lower(t.name) = fr.needle) OR (fr.kind = 'suffix' AND ends_with(lower(t.name), fr.needle))
    OR (fr.kind = 'contains' AND contains(lower(t.name), fr.needle)))"""


ORACLE_FACETS = f"""{FW_VALUES},
new_f AS (SELECT DISTINCT * FROM ({_facet_sql('new')}) x),
old_f AS (SELECT DISTINCT * FROM ({_facet_sql('old')}) x),
fchg AS (
  SELECT repo_id, facet, 'added' AS op, value FROM new_f n WHERE NOT EXISTS
    (SELECT 1 FROM old_f o WHERE o.repo_id = n.repo_id AND o.facet = n.facet AND o.value = n.value)
  UNION ALL
  SELECT repo_id, facet, 'removed' AS op, value FROM old_f o WHERE NOT EXISTS
    (SELECT 1 FROM new_f n WHERE o.repo_id = n.repo_id AND o.facet = n.facet AND o.value = n.value))"""


def _m_sides(spark, sf_dir):
    old_files = manifest_corpus(spark, sf_dir, OLD_M, "old")
    new_files = manifest_corpus(spark, sf_dir, NEW_M, "new")
    return old_files, new_files


def _m_facets(files, deps):
    facts = S.file_facts(files)
    lm = S.languages_managers(facts).select("repo_id", F.when(F.col("kind") == "language", "languages")
                                            .otherwise("packageManagers").alias("facet"), "value")
    mgr = deps.select("repo_id", F.lit("packageManagers").alias("facet"), F.col("manager").alias("value"))
    fw = M.frameworks_from_dependencies(deps).select("repo_id", F.lit("frameworks").alias("facet"), F.col("framework").alias("value"))
    infra = I.infrastructure(files).select("repo_id", F.lit("infrastructureServices").alias("facet"), F.col("service").alias("value"))
    return lm.unionByName(mgr).unionByName(fw).unionByName(infra).distinct()


def _m_changes(spark, sf_dir):
    old_files, new_files = _m_sides(spark, sf_dir)
    od, nd = saved(M.dependencies(old_files), "old-deps"), saved(M.dependencies(new_files), "new-deps")
    ch = D.changes(_m_facets(old_files, od), _m_facets(new_files, nd),
                   od.select("repo_id", "manager", "name", "version"), nd.select("repo_id", "manager", "name", "version"))
    repos = old_files.select("repo_id").union(new_files.select("repo_id"))
    return ch, repos


@query("diff_dependencies", f"WITH {ORACLE_DEPS} SELECT repo_id, op, manager, name, version, count(*) AS n FROM dchg GROUP BY ALL")
def diff_dependencies(spark, sf_dir):
    old_files, new_files = _m_sides(spark, sf_dir)
    od, nd = M.dependencies(old_files), M.dependencies(new_files)
    ch = D.compare_dependencies(od.select("repo_id", "manager", "name", "version"), nd.select("repo_id", "manager", "name", "version"))
    return ch.groupBy("repo_id", "op", "manager", F.col("key1").alias("name"), F.col("key2").alias("version")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("diff_strings", f"WITH {ORACLE_DEPS}, {ORACLE_FACETS} SELECT repo_id, facet, op, value FROM fchg")
def diff_strings(spark, sf_dir):
    old_files, new_files = _m_sides(spark, sf_dir)
    od, nd = saved(M.dependencies(old_files), "old-deps"), saved(M.dependencies(new_files), "new-deps")
    ch = D.compare_facets(_m_facets(old_files, od), _m_facets(new_files, nd))
    return ch.select("repo_id", F.col("kind").alias("facet"), "op", F.col("key1").alias("value"))


@query("diff_has_changes", f"""WITH {ORACLE_DEPS}, {ORACLE_FACETS},
repos AS (SELECT repo_id FROM new_d UNION SELECT repo_id FROM old_d),
chg AS (SELECT repo_id FROM dchg UNION SELECT repo_id FROM fchg)
SELECT r.repo_id, c.repo_id IS NOT NULL AS has_changes FROM repos r LEFT JOIN (SELECT DISTINCT repo_id FROM chg) c ON r.repo_id = c.repo_id""")
def diff_has_changes(spark, sf_dir):
    ch, repos = _m_changes(spark, sf_dir)
    return D.has_changes(repos, ch)


@query("diff_report_lines", f"""WITH {ORACLE_DEPS}, {ORACLE_FACETS},
l AS (
  SELECT repo_id, 'Dependencies' AS section, CASE WHEN op = 'added' THEN '+' ELSE '-' END || ' ' || name || ' (' || manager || ')' AS line FROM dchg
  UNION ALL
  SELECT repo_id, CASE facet WHEN 'languages' THEN 'Languages' WHEN 'packageManagers' THEN 'Package managers'
                  WHEN 'frameworks' THEN 'Frameworks' ELSE 'Infrastructure services' END,
         CASE WHEN op = 'added' THEN '+' ELSE '-' END || ' ' || value FROM fchg)
SELECT repo_id, section, line, count(*) AS n FROM l GROUP BY ALL""")
def diff_report_lines(spark, sf_dir):
    ch, _ = _m_changes(spark, sf_dir)
    return D.text_report_lines(ch).groupBy("repo_id", "section", "line").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("diff_markdown_lines", f"""WITH {ORACLE_DEPS}, {ORACLE_FACETS},
l AS (
  SELECT repo_id, '## Dependencies' AS section, '- ' || CASE WHEN op = 'added' THEN '+' ELSE '-' END || ' ' || name || ' (' || manager || ')' AS line FROM dchg
  UNION ALL
  SELECT repo_id, '## ' || CASE facet WHEN 'languages' THEN 'Languages' WHEN 'packageManagers' THEN 'Package managers'
                  WHEN 'frameworks' THEN 'Frameworks' ELSE 'Infrastructure services' END,
         '- ' || CASE WHEN op = 'added' THEN '+' ELSE '-' END || ' `' || value || '`' FROM fchg)
SELECT repo_id, section, line, count(*) AS n FROM l GROUP BY ALL""")
def diff_markdown_lines(spark, sf_dir):
    ch, _ = _m_changes(spark, sf_dir)
    return D.markdown_report_lines(ch).groupBy("repo_id", "section", "line").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


ALL_R = " UNION ALL ".join(f"SELECT * FROM ({s}) t_{k}" for k, s in ORACLE_BY_PARSER.items())


def _routes_side(name: str) -> str:
    return f"(SELECT DISTINCT repo_id, method, path, controller FROM ({ALL_R.replace('FROM ev', 'FROM ' + name)}) a)"


@query("diff_routes", f"""WITH {oracle_events(OLD_R, 'ev_old')}, {oracle_events(NEW_R, 'ev_new')},
o AS {_routes_side('ev_old')}, n AS {_routes_side('ev_new')}
SELECT repo_id, 'added' AS op, method, path, controller FROM n WHERE NOT EXISTS
  (SELECT 1 FROM o WHERE o.repo_id = n.repo_id AND o.method = n.method AND o.path = n.path AND o.controller = n.controller)
UNION ALL
SELECT repo_id, 'removed' AS op, method, path, controller FROM o WHERE NOT EXISTS
  (SELECT 1 FROM n WHERE o.repo_id = n.repo_id AND o.method = n.method AND o.path = n.path AND o.controller = n.controller)""")
def diff_routes(spark, sf_dir):
    old = R.routes(route_corpus(spark, sf_dir, OLD_R, "old")).select("repo_id", "method", "path", "controller")
    new = R.routes(route_corpus(spark, sf_dir, NEW_R, "new")).select("repo_id", "method", "path", "controller")
    ch = D.compare_routes(old, new)
    return ch.select("repo_id", "op", F.col("key1").alias("method"), F.col("key2").alias("path"), F.col("key3").alias("controller"))
