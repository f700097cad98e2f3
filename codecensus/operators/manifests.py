"""Dependency extraction from manifests.

Every parser maps ``files`` -> long rows
``(repo_id, snapshot_id, rel_path, manager, name, version, ord)`` where ``ord``
is the position in the parser's reading order; ``unique_last`` (D11) then keeps
the last version per (file, manager, name).  Line parsers with state use a
window over the file's event lines (shuffle keyed by file, never by repo);
whole-text parsers are narrow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import patterns as X
from ..functions.text import WS_CLASS, quoted_tokens, strip_inline_comment, trim_chars, trim_space
from ..sources.files import FILE_KEY, SNAP_KEY
from ..sources.lines import explode_lines, nonblank

OUT = [*FILE_KEY, "manager", "name", "version", "ord"]
#: White space, and all else: a plain character is told by one comparison. A trimmed text has two fields if it holds white space.
_BLANK = f"[[^!-~]&&[{WS_CLASS}]]"
_WORD = f"[[!-~][^{WS_CLASS}]]"
#: The first two fields of a trimmed text.
_FIELDS = f"^({_WORD}+){_BLANK}+({_WORD}+)"


def _file_window(*extra):
    return Window.partitionBy(*FILE_KEY, *extra).orderBy("line_no")


def _prev_rows(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _scan_lines(files: DataFrame, cond, comments=()) -> DataFrame:
    """Lines of the selected files for a line-scanner parser."""
    return nonblank(explode_lines(files.filter(cond), raw=False), comments)


# D3
def parse_go_mod(files: DataFrame) -> DataFrame:
    ln = _scan_lines(files, F.col("base") == "go.mod", ("//",))
    line = F.col("line")
    flag = F.when(line.startswith("require ("), F.lit(True)).when(line == ")", F.lit(False))
    single = line.startswith("require ") & ~line.startswith("require (")
    text = F.when(single, trim_space(line.substr(F.lit(9), F.length(line)))).otherwise(line)
    ev = ln.select(*FILE_KEY, "line_no", flag.alias("flag"), single.alias("single"), text.alias("text"))
    ev = ev.filter(F.col("flag").isNotNull() | F.col("text").rlike(_BLANK))
    in_block = F.coalesce(F.last("flag", ignorenulls=True).over(_prev_rows(_file_window())), F.lit(False))
    ev = ev.withColumn("in_block", in_block)
    dep = ev.filter(F.col("flag").isNull() & (F.col("single") | F.col("in_block")))
    return dep.select(*FILE_KEY, F.lit("go").alias("manager"), F.regexp_extract("text", _FIELDS, 1).alias("name"),
                      F.regexp_extract("text", _FIELDS, 2).alias("version"), F.col("line_no").cast("bigint").alias("ord"))


# D4
def parse_cargo(files: DataFrame) -> DataFrame:
    ln = _scan_lines(files, F.col("base") == "Cargo.toml", ("#",))
    line = F.col("line")
    header = line.startswith("[") & line.endswith("]")
    ev = ln.select(*FILE_KEY, "line_no", "line", F.when(header, line == "[dependencies]").alias("sect"))
    ev = ev.filter(F.col("sect").isNotNull() | line.contains("="))
    ev = ev.withColumn("in_deps", F.coalesce(F.last("sect", ignorenulls=True).over(_prev_rows(_file_window())), F.lit(False)))
    dep = ev.filter(F.col("sect").isNull() & F.col("in_deps"))
    name = trim_space(F.substring_index("line", "=", 1))
    rest = F.col("line").substr(F.instr("line", "=") + 1, F.length("line"))
    return dep.select(*FILE_KEY, F.lit("cargo").alias("manager"), name.alias("name"),
                      trim_chars(trim_space(rest), '"').alias("version"),
                      F.col("line_no").cast("bigint").alias("ord")).filter(F.col("name") != "")


# D5
def parse_requirements(files: DataFrame) -> DataFrame:
    ln = _scan_lines(files, F.lower("base") == "requirements.txt", ("#", "-"))
    line = F.col("line")
    url = line.contains("://")
    egg_at = F.instr(F.lower(line), "#egg=")  # 1-based; the reference wants a 0-based index > 0
    egg = F.when((egg_at > 1) & (egg_at + 4 < F.length(line)), F.lower(trim_space(line.substr(egg_at + 5, F.length(line)))))
    # One pass: URL lines take the #egg= name, the others the comment-stripped requirement.
    st = ln.select(*FILE_KEY, "line_no", url.alias("url"), F.when(url, egg).alias("egg"),
                   F.when(~url, strip_inline_comment(line)).alias("s"))
    st = st.select("*", F.regexp_extract("s", r"^([^<>!=~\[ ]*)", 1).alias("head"))
    out = st.select(*FILE_KEY, "line_no",
                    F.when(F.col("url"), F.col("egg")).otherwise(F.lower(trim_space("head"))).alias("name"),
                    F.when(F.col("url"), F.lit("")).otherwise(
                        trim_space(F.col("s").substr(F.length("head") + 1, F.length("s")))).alias("version"))
    return out.filter(F.col("name").isNotNull() & (F.col("name") != "")).select(
        *FILE_KEY, F.lit("pip").alias("manager"), "name", "version", F.col("line_no").cast("bigint").alias("ord"))


# D6 (+ D10)
def parse_pyproject(files: DataFrame) -> DataFrame:
    ln = _scan_lines(files, F.lower("base") == "pyproject.toml", ("#",))
    ln = ln.select(*FILE_KEY, "line_no", strip_inline_comment("line").alias("line"))
    ln = ln.filter(F.col("line") != "")
    line = F.col("line")
    header = line.startswith("[") & line.endswith("]")
    starts = line.startswith("dependencies")
    ev = ln.select(
        *FILE_KEY, "line_no", "line",
        F.when(header, trim_chars(line, "[]")).alias("sect_set"),
        F.when(header, F.lit(False))
        .when(starts, line.contains("[") & ~line.contains("]"))
        .when(line.contains("]"), F.lit(False)).alias("arr_set"),
        starts.alias("starts"),
    )
    w = _prev_rows(_file_window())
    ev = (ev.withColumn("sect", F.last("sect_set", ignorenulls=True).over(w))
            .withColumn("in_arr", F.coalesce(F.last("arr_set", ignorenulls=True).over(w), F.lit(False)))
            .filter(F.col("sect_set").isNull()))
    # both sections in one pass over the lines: the requirements that a line quotes, or the line as one poetry entry
    of_project = (F.col("sect") == "project") & (F.col("starts") | F.col("in_arr"))
    of_poetry = (F.col("sect") == "tool.poetry.dependencies") & line.contains("=")
    dep = ev.filter(of_project | of_poetry).select(
        *FILE_KEY, "line_no", (F.col("sect") == "project").alias("pip"),
        F.posexplode(F.when(F.col("sect") == "project", quoted_tokens("line")).otherwise(F.array("line"))).alias("k", "dep"))
    pip, text = F.col("pip"), F.col("dep")
    dep = dep.select("*", F.when(pip, F.regexp_extract("dep", r"^([^<>!=~\[ ]*)", 1)).otherwise(F.substring_index("dep", "=", 1)).alias("head"))
    rest = trim_space(text.substr(F.length("head") + F.when(pip, 1).otherwise(2), F.length("dep")))
    number = F.col("line_no").cast("bigint")
    return dep.select(*FILE_KEY, F.when(pip, "pip").otherwise("poetry").alias("manager"), F.lower(trim_space("head")).alias("name"),
                      F.when(pip, rest).otherwise(trim_chars(rest, "\"'")).alias("version"),
                      F.when(pip, number * 100000 + F.col("k")).otherwise(number).alias("ord"),
                      ).filter((F.col("name") != "") & ((F.col("manager") == "pip") | (F.col("name") != "python")))


# D1 / D2 (+ S9)
def _parse_json_manifest(files: DataFrame, base: str, sections: tuple[str, str], manager: str) -> DataFrame:
    # A document is parsed once, inside a generator: a filter pushed through a projection would parse it again.
    found = F.transform(F.array(F.try_parse_json(F.col("content"))), lambda v: F.struct(v.isNotNull().alias("read"), F.schema_of_variant(v).alias("top"), *[
        F.try_variant_get(v, f"$.{sec}", "variant").alias(f"s{i}") for i, sec in enumerate(sections)]))
    named = files.filter((F.col("base") == base) & (F.col("ext") == ".json"))  # the extension follows; branches by extension are pruned
    secs = named.select(*FILE_KEY, F.explode(found).alias("d")).select(*FILE_KEY, "d.*")

    def section_ok(i):
        s_ = F.col(f"s{i}")
        kind = F.schema_of_variant(s_)
        vals = F.map_values(F.try_variant_get(s_, "$", "map<string,variant>"))
        obj_ok = s_.isNull() | kind.startswith("OBJECT") | (kind == "VOID")
        vals_ok = F.coalesce(F.forall(vals, lambda x: F.schema_of_variant(x).isin("STRING", "VOID")), F.lit(True))
        return obj_ok & vals_ok

    top = F.col("top")
    ok = F.col("read") & (top.startswith("OBJECT") | (top == "VOID")) & section_ok(0) & section_ok(1)
    good = secs.select(*FILE_KEY, "s0", "s1", ok.alias("ok")).filter("ok")

    def entries(i):
        m = F.coalesce(F.map_entries(F.try_variant_get(F.col(f"s{i}"), "$", "map<string,string>")),
                       F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(m, lambda e: F.struct(F.lit(i).alias("sec"), e.key.alias("name"), e.value.alias("version")))
    # One pass: both sections' entries in one generator (no second parse of the document).
    out = good.select(*FILE_KEY, F.explode(F.concat(entries(0), entries(1))).alias("e"))
    return out.select(*FILE_KEY, F.lit(manager).alias("manager"), F.col("e.name").alias("name"),
                      F.coalesce("e.version", F.lit("")).alias("version"), F.col("e.sec").cast("bigint").alias("ord")
                      ).filter(F.col("name") != "")


def parse_package_json(files: DataFrame) -> DataFrame:
    return _parse_json_manifest(files, "package.json", ("dependencies", "devDependencies"), "npm")


def parse_composer_json(files: DataFrame) -> DataFrame:
    return _parse_json_manifest(files, "composer.json", ("require", "require-dev"), "composer")


# D7 (+ S10)
POM_SCHEMA = "dependencies struct<dependency: array<struct<groupId: string, artifactId: string, version: string>>>"


def parse_pom(files: DataFrame) -> DataFrame:
    p = files.filter(F.col("base") == "pom.xml").select(
        *FILE_KEY, F.from_xml("content", POM_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("p"))
    d = p.select(*FILE_KEY, F.posexplode(F.col("p.dependencies.dependency")).alias("k", "d"))
    g, a = trim_space(F.coalesce("d.groupId", F.lit(""))), trim_space(F.coalesce("d.artifactId", F.lit("")))
    return d.filter((g != "") & (a != "")).select(
        *FILE_KEY, F.lit("maven").alias("manager"), F.concat(g, F.lit(":"), a).alias("name"),
        trim_space(F.coalesce("d.version", F.lit(""))).alias("version"), F.col("k").cast("bigint").alias("ord"))


# D8


def parse_gradle(files: DataFrame) -> DataFrame:
    ln = _scan_lines(files, F.col("base").isin("build.gradle", "build.gradle.kts"), ("//",))
    line = F.col("line")
    short = F.regexp_extract(line, X.GRADLE_SHORT, 1) != ""
    named = F.regexp_extract(line, X.GRADLE_NAMED, 1) != ""

    def grp(i):
        return F.when(short, F.regexp_extract(line, X.GRADLE_SHORT, i)).otherwise(F.regexp_extract(line, X.GRADLE_NAMED, i))
    return ln.filter(short | named).select(
        *FILE_KEY, F.lit("gradle").alias("manager"),
        F.concat(trim_space(grp(1)), F.lit(":"), trim_space(grp(2))).alias("name"),
        trim_space(grp(3)).alias("version"), F.col("line_no").cast("bigint").alias("ord"))


# D9


def parse_csproj(files: DataFrame) -> DataFrame:
    f = files.filter(F.lower("base").endswith(".csproj"))
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(X.NUGET_REF), F.lit(1)).alias("n"),
                         F.regexp_extract_all("content", F.lit(X.NUGET_REF), F.lit(2)).alias("v"))
    d = f.select(*FILE_KEY, F.posexplode(pairs).alias("k", "p"))
    return d.select(*FILE_KEY, F.lit("nuget").alias("manager"), trim_space("p.n").alias("name"),
                    trim_space("p.v").alias("version"), F.col("k").cast("bigint").alias("ord")).filter(F.col("name") != "")


PARSERS = {
    "npm": parse_package_json, "composer": parse_composer_json, "go": parse_go_mod, "cargo": parse_cargo,
    "pip": parse_requirements, "pyproject": parse_pyproject, "maven": parse_pom, "gradle": parse_gradle,
    "nuget": parse_csproj,
}


# D11
def unique_last(raw: DataFrame) -> DataFrame:
    """Within one file and manager, keep the last version seen for each name."""
    return raw.groupBy(*FILE_KEY, "manager", "name").agg(F.max_by("version", "ord").alias("version"))


def dependencies(files: DataFrame, managers=None) -> DataFrame:
    """All dependency rows ``(repo_id, snapshot_id, rel_path, manager, name, version)``."""
    # Dedupe each parser's rows before the union: the window-based parsers are already partitioned
    # by file, so their per-file "last wins" aggregate needs no second exchange.
    parts = [unique_last(PARSERS[m](files)) for m in (managers or PARSERS)]
    return reduce(DataFrame.unionByName, parts)


# A 17-row literal dictionary (bounded by construction) broadcast-joined on
# (manager, lower(name)); suffix / substring rules are theta conditions.
def framework_rules(spark) -> DataFrame:
    rows = []
    for prio, (mgrs, kind, needles, fw) in enumerate(fixed.FRAMEWORK_RULES):
        for m in mgrs:
            for n in needles:
                rows.append((m, kind, n, fw, prio))
    return spark.createDataFrame(rows, "manager string, kind string, needle string, framework string, prio int")


def frameworks_from_dependencies(deps: DataFrame) -> DataFrame:
    """(repo_id, snapshot_id, framework) with dependency evidence."""
    rules = F.broadcast(framework_rules(deps.sparkSession))
    n = F.lower(deps["name"])
    cond = (deps["manager"] == rules["manager"]) & (
        ((rules["kind"] == "eq") & (n == rules["needle"]))
        | ((rules["kind"] == "suffix") & n.endswith(rules["needle"]))
        | ((rules["kind"] == "contains") & n.contains(rules["needle"])))
    # Within one manager the rules never overlap (distinct exact names; every suffix rule names the same
    # framework), so "first matching rule" equals "any matching rule": a distinct on the small
    # (repo, snapshot, framework) output replaces a per-dependency shuffle.
    hits = deps.join(rules, cond, "inner")
    return hits.select(*SNAP_KEY, "framework").distinct()


# A5
def dependency_counts(deps: DataFrame) -> DataFrame:
    """rollup(repo, snapshot, manager) counts; manager NULL is the total."""
    return (deps.rollup(*SNAP_KEY, "manager").agg(F.count(F.lit(1)).cast("bigint").alias("n_deps"))
            .filter(F.col("snapshot_id").isNotNull()))
