"""Driver queries over corpus P."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import pruned_by
from ..operators import structure as S
from .corpus_paths import oracle_files_cte, path_corpus
from .registry import query

CTE = "WITH " + oracle_files_cte()


def _facts(spark, sf_dir):
    files = path_corpus(spark, sf_dir).filter(~pruned_by(fixed.SKIP_DIRS_SCAN))
    return S.file_facts(files)


@query("dir_prune", CTE + """
SELECT repo_id, rel_path, dir_t NOT IN (7, 8, 9) AS kept FROM pf
""")
def dir_prune(spark, sf_dir):
    return path_corpus(spark, sf_dir).select("repo_id", "rel_path", (~pruned_by(fixed.SKIP_DIRS_SCAN)).alias("kept"))


@query("file_classes", CTE + """
SELECT repo_id, rel_path, manifest_kind, is_config, source_language, is_test, is_entry, is_notable, dir_key
FROM pkn
""")
def file_classes(spark, sf_dir):
    return _facts(spark, sf_dir).select("repo_id", "rel_path", "manifest_kind", "is_config", "source_language",
                                        "is_test", "is_entry", "is_notable", "dir_key")


@query("project_stats", CTE + """
SELECT repo_id, count(*) AS total_files,
  count(*) FILTER (WHERE source_language IS NOT NULL AND NOT is_test) AS source_files,
  count(*) FILTER (WHERE is_test) AS test_files,
  count(*) FILTER (WHERE manifest_kind IS NOT NULL) AS manifest_files,
  count(*) FILTER (WHERE is_config) AS config_files
FROM pkn GROUP BY repo_id
""")
def project_stats(spark, sf_dir):
    return S.project_stats(_facts(spark, sf_dir)).drop("snapshot_id")


@query("directory_layout", CTE + """
, nf AS (SELECT repo_id, dir_key, rel_path,
           row_number() OVER (PARTITION BY repo_id, dir_key ORDER BY rel_path) AS rn
         FROM pkn WHERE is_notable)
SELECT d.repo_id, d.dir_key AS path, d.file_count, d.source_files, d.test_files, d.manifest_files, d.config_files,
       d.languages, coalesce(n.notable_files, '') AS notable_files
FROM (SELECT repo_id, dir_key, count(*) AS file_count,
        count(*) FILTER (WHERE source_language IS NOT NULL AND NOT is_test) AS source_files,
        count(*) FILTER (WHERE is_test) AS test_files,
        count(*) FILTER (WHERE manifest_kind IS NOT NULL) AS manifest_files,
        count(*) FILTER (WHERE is_config) AS config_files,
        coalesce(string_agg(DISTINCT CASE WHEN source_language IS NOT NULL AND NOT is_test THEN source_language END, ',' ORDER BY CASE WHEN source_language IS NOT NULL AND NOT is_test THEN source_language END), '') AS languages
      FROM pkn GROUP BY repo_id, dir_key) d
LEFT JOIN (SELECT repo_id, dir_key, string_agg(rel_path, ',' ORDER BY rel_path) AS notable_files
           FROM nf GROUP BY repo_id, dir_key) n
  ON d.repo_id = n.repo_id AND d.dir_key = n.dir_key
""")
def directory_layout(spark, sf_dir):
    """Every directory with all its notable files."""
    d = S.directory_layout(_facts(spark, sf_dir), notable=None)
    return d.select("repo_id", "path", "file_count", "source_files", "test_files", "manifest_files", "config_files",
                    F.array_join("languages", ",").alias("languages"),
                    F.array_join("notable_files", ",").alias("notable_files"))


@query("entry_points", CTE + """
SELECT repo_id, rel_path AS entry_point, rn AS rank FROM (
  SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path) AS rn
  FROM pkn WHERE is_entry)
""")
def entry_points(spark, sf_dir):
    return S.entry_points(_facts(spark, sf_dir)).select("repo_id", "entry_point", "rank")


@query("entry_points_top12", CTE + """
SELECT repo_id, rel_path AS entry_point, rn AS rank FROM (
  SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path) AS rn
  FROM pkn WHERE is_entry) WHERE rn <= 12
""")
def entry_points_top12(spark, sf_dir):
    """The report's list: the first 12 of all ranked entry points."""
    return entry_points(spark, sf_dir).filter("rank <= 12")


@query("notable_top5", CTE + """
SELECT repo_id, dir_key AS path, rel_path AS notable_file, rn AS rank FROM (
  SELECT repo_id, dir_key, rel_path, row_number() OVER (PARTITION BY repo_id, dir_key ORDER BY rel_path) AS rn
  FROM pkn WHERE is_notable) WHERE rn <= 5
""")
def notable_top5(spark, sf_dir):
    """The report's list: the first 5 of all ranked notable files of a directory."""
    return notable_files(spark, sf_dir).filter("rank <= 5")


@query("notable_files", CTE + """
SELECT repo_id, dir_key AS path, rel_path AS notable_file, rn AS rank FROM (
  SELECT repo_id, dir_key, rel_path, row_number() OVER (PARTITION BY repo_id, dir_key ORDER BY rel_path) AS rn
  FROM pkn WHERE is_notable)
""")
def notable_files(spark, sf_dir):
    return S.notable_files(_facts(spark, sf_dir)).select("repo_id", "path", "notable_file", "rank")


@query("manifest_inventory", CTE + """
SELECT repo_id, rel_path AS path, manifest_kind AS kind FROM pkn WHERE manifest_kind IS NOT NULL
""")
def manifest_inventory(spark, sf_dir):
    return S.manifest_inventory(_facts(spark, sf_dir)).drop("snapshot_id")


@query("languages_managers", CTE + """
, lm(base, language, manager) AS (VALUES ('package.json','javascript','npm'), ('go.mod','go','go'),
     ('requirements.txt','python','pip'), ('pom.xml','java','maven'), ('App.csproj','csharp','nuget'))
SELECT DISTINCT repo_id, kind, value FROM (
  SELECT repo_id, 'language' AS kind, lm.language AS value FROM pkn JOIN lm ON pkn.base = lm.base
  UNION ALL
  SELECT repo_id, 'manager' AS kind, lm.manager AS value FROM pkn JOIN lm ON pkn.base = lm.base) x
""")
def languages_managers(spark, sf_dir):
    return S.languages_managers(_facts(spark, sf_dir)).drop("snapshot_id")
