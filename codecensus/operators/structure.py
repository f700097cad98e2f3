"""File classification and repository structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import paths as P
from ..functions.running import running_position
from ..session import saved
from ..sources.files import FILE_KEY, SNAP_KEY


def file_facts(files: DataFrame) -> DataFrame:
    """One row per file with every path-derived flag (narrow: no shuffle)."""
    kind = P.manifest_kind()
    return files.select(
        *FILE_KEY, "abs_path", "base", "ext",
        kind.alias("manifest_kind"),
        P.is_manifest_marker().alias("is_manifest_marker"),
        P.is_config_file().alias("is_config"),
        P.source_language().alias("source_language"),
        P.is_test_file().alias("is_test"),
        P.is_entry_point().alias("is_entry"),
        P.is_notable(kind).alias("is_notable"),
        P.directory_key().alias("dir_key"),
    )


def _counts():
    is_source = ~F.col("is_test") & F.col("source_language").isNotNull()
    return [
        F.count(F.lit(1)).cast("bigint").alias("total_files"),
        F.count_if(is_source).cast("bigint").alias("source_files"),
        F.count_if(F.col("is_test")).cast("bigint").alias("test_files"),
        F.count_if(F.col("manifest_kind").isNotNull()).cast("bigint").alias("manifest_files"),
        F.count_if(F.col("is_config")).cast("bigint").alias("config_files"),
    ]


# A1
def project_stats(facts: DataFrame) -> DataFrame:
    """Per snapshot: total, source (tests excluded), test, manifest and config file counts."""
    return facts.groupBy(*SNAP_KEY).agg(*_counts())


def _ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct ``value`` per ``keys`` with its rank; a key of any size spans many tasks."""
    d = df.select(*keys, value).distinct()
    out = running_position(d, keys, [F.col(value)], "rank", lambda x: saved(x, "ranked-paths"))
    return out.withColumn("rank", (F.col("rank") + 1).cast("bigint"))


# T2
def entry_points(facts: DataFrame) -> DataFrame:
    """(repo, snapshot, entry_point, rank): every entry point, ranked by path."""
    return _ranked(facts.filter("is_entry").select(*SNAP_KEY, F.col("rel_path").alias("entry_point")), SNAP_KEY, "entry_point")


# T3
def notable_files(facts: DataFrame) -> DataFrame:
    """(repo, snapshot, path, notable_file, rank): every notable file of a directory, ranked by path."""
    nf = facts.filter("is_notable").select(*SNAP_KEY, F.col("dir_key").alias("path"), F.col("rel_path").alias("notable_file"))
    return _ranked(nf, SNAP_KEY + ["path"], "notable_file")


def first_notable(facts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` notable files of every directory: (repo, snapshot, dir_key, rel_path).

    The rank filter becomes a group limit that runs before the exchange as well, so a task ships ``k`` names of a directory
    at most, however many it holds.
    """
    w = Window.partitionBy(*SNAP_KEY, "dir_key").orderBy("rel_path")
    nf = facts.filter("is_notable").select(*SNAP_KEY, "dir_key", "rel_path")
    return nf.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


# A2
def directory_layout(facts: DataFrame, notable: int | None = fixed.REPORTED_NOTABLE_FILES) -> DataFrame:
    """Per first-two-segment directory: counts, languages set and its first ``notable`` notable files in order (None: all).

    Files and the names to report meet in one aggregate, which needs no join and keeps no list beyond ``notable``.
    """
    if notable is None:
        is_source = ~F.col("is_test") & F.col("source_language").isNotNull()
        c = _counts()
        return facts.groupBy(*SNAP_KEY, F.col("dir_key").alias("path")).agg(
            c[0].alias("file_count"), *c[1:],
            F.array_sort(F.collect_set(F.when(is_source, F.col("source_language")))).alias("languages"),
            F.array_sort(F.collect_set(F.when(F.col("is_notable"), F.col("rel_path")))).alias("notable_files"))
    flags = ["is_test", "source_language", "manifest_kind", "is_config"]
    files = facts.select(*SNAP_KEY, "dir_key", *flags, F.lit(None).cast("string").alias("name"))
    types = {f.name: f.dataType for f in facts.schema.fields}
    names = first_notable(facts, notable).select(*SNAP_KEY, "dir_key", *[F.lit(None).cast(types[c]).alias(c) for c in flags], F.col("rel_path").alias("name"))
    is_source = ~F.col("is_test") & F.col("source_language").isNotNull()
    c = _counts()
    return files.unionByName(names).groupBy(*SNAP_KEY, F.col("dir_key").alias("path")).agg(
        F.count_if(F.col("name").isNull()).cast("bigint").alias("file_count"), c[1], c[2], c[3], c[4],
        F.array_sort(F.collect_set(F.when(is_source, F.col("source_language")))).alias("languages"),
        F.array_sort(F.collect_list("name")).alias("notable_files"))


def directory_layout_in_buckets(facts: DataFrame, notable: int = fixed.REPORTED_NOTABLE_FILES) -> DataFrame:
    """``directory_layout`` of a table bucketed by snapshot: ranks and counts in one pass over sorted buckets, without an exchange."""
    w = Window.partitionBy(*SNAP_KEY, "dir_key").orderBy(F.desc("is_notable"), "rel_path")
    first = F.when(F.col("is_notable") & (F.row_number().over(w) <= notable), F.col("rel_path"))
    is_source = ~F.col("is_test") & F.col("source_language").isNotNull()
    c = _counts()
    return facts.withColumn("name", first).groupBy(*SNAP_KEY, F.col("dir_key").alias("path")).agg(
        c[0].alias("file_count"), c[1], c[2], c[3], c[4],
        F.array_sort(F.collect_set(F.when(is_source, F.col("source_language")))).alias("languages"),
        F.array_sort(F.collect_list("name")).alias("notable_files"))


# A9
def manifest_inventory(facts: DataFrame) -> DataFrame:
    """Manifest and config files with their kind, distinct by path (sort by kind, path at the sink)."""
    return facts.filter(F.col("manifest_kind").isNotNull()).select(
        *SNAP_KEY, F.col("rel_path").alias("path"), F.col("manifest_kind").alias("kind")
    ).dropDuplicates(SNAP_KEY + ["path"])


# detected / config file lists (A8): long form
def detected_files(facts: DataFrame) -> DataFrame:
    return facts.filter("is_manifest_marker").select(*SNAP_KEY, F.col("rel_path").alias("file"))


def config_files(facts: DataFrame) -> DataFrame:
    return facts.filter("is_config").select(*SNAP_KEY, F.col("rel_path").alias("file"))


# A6
def languages_managers(facts: DataFrame) -> DataFrame:
    """Long (repo, snapshot, kind in {language, manager}, value) from manifest names (tests on rel path)."""
    rel = F.col("rel_path")
    pairs = []
    for suffix, ci, lang, mgr in fixed.MANIFEST_LANGUAGES:
        hit = F.lower(rel).endswith(suffix.lower()) if ci else rel.endswith(suffix)
        pairs.append(F.when(hit, F.array(F.struct(F.lit("language").alias("kind"), F.lit(lang).alias("value")),
                                         F.struct(F.lit("manager").alias("kind"), F.lit(mgr).alias("value")))))
    arr = F.flatten(F.filter(F.array(*pairs), lambda a: a.isNotNull()))
    return (facts.filter("is_manifest_marker")
            .select(*SNAP_KEY, F.explode(arr).alias("kv"))
            .select(*SNAP_KEY, "kv.kind", "kv.value")
            .distinct())

