"""Report rendering as ordered string assembly.

Documents are produced as *line rows* ``(repo_id, artifact, line_no, line)``:
a line's number is its running position over range partitions of (repository,
artifact, block, order), so a document of any size spans tasks.  A sink writes the lines in order
(``write_documents``), so no document is ever concatenated into one value
unless it is small by construction (the summary).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.running import running_position
from ..functions.text import display_project_name, list_text, mermaid_id, mermaid_label
from ..session import saved
from . import modules as G

DOC = ["repo_id", "artifact", "line_no", "line"]


def _lit_lines(keys: DataFrame, artifact: str, block: int, lines: list[str]) -> DataFrame:
    """Fixed lines for every repository in ``keys``."""
    arr = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("line")) for i, t in enumerate(lines)])
    return keys.select("repo_id", F.lit(artifact).alias("artifact"), F.lit(block).alias("block"), F.lit("").alias("sub"),
                       F.explode(arr).alias("x")).select("repo_id", "artifact", "block", "sub",
                                                          F.array(F.col("x.o").cast("string")).alias("ord"), "x.line")


def assemble(blocks: DataFrame) -> DataFrame:
    """(repo_id, artifact, block, sub, ord, line) -> (repo_id, artifact, line_no, line).

    ``ord`` is an array of sort keys inside a (block, sub) section.
    """
    order = [F.col(c) for c in ("block", "sub", "ord", "line")]
    out = running_position(blocks, ["repo_id", "artifact"], order, "line_no", lambda d: saved(d, "document-lines"), ("block", "sub", "ord"))
    return out.select("repo_id", "artifact", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "line")


def render_text(doc_lines: DataFrame) -> DataFrame:
    """Whole documents (for small outputs and tests): (repo_id, artifact, body)."""
    g = doc_lines.groupBy("repo_id", "artifact").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("repo_id", "artifact", F.concat(F.array_join(F.transform("l", lambda x: x.line), "\n"), F.lit("\n")).alias("body"))


def write_documents(doc_lines: DataFrame, path: str) -> None:
    """Text sink: one folder per (repo, artifact); lines range-partitioned so a large document spans tasks in order."""
    (doc_lines.repartitionByRange("repo_id", "artifact", "line_no")
     .sortWithinPartitions("repo_id", "artifact", "line_no")
     .select("repo_id", "artifact", "line")
     .write.mode("overwrite").partitionBy("repo_id", "artifact").text(path))


# O7
def artifact_names(fmt: str) -> list[str]:
    f = (fmt or "").strip().lower()
    if f in ("", "markdown", "md"):
        return list(fixed.MARKDOWN_ARTIFACTS)
    if f == "html":
        return list(fixed.HTML_ARTIFACTS)
    if f == "both":
        return list(fixed.MARKDOWN_ARTIFACTS) + list(fixed.HTML_ARTIFACTS)
    raise ValueError(f"unsupported format {fmt!r} (expected markdown, html, or both)")


def numbered_dependencies(deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dependencies (repo_id, manager, name, version) with their place ``j`` in their manager's list, and a row per list.

    A list's row holds its size ``n``, its place ``i`` among the ``k`` lists of its repository and ``before``, the
    dependencies of the lists before it: with ``j``, these give every line of a document its number. Null repositories and
    managers are lists too.
    """
    d = running_position(deps.select("repo_id", "manager", "name", "version"), ["repo_id", "manager"], [F.col("name"), F.col("version")], "j",
                         lambda x: saved(x, "numbered-deps"))
    d = d.withColumn("j", F.col("j") + 1)
    in_order = Window.partitionBy("repo_id").orderBy("manager")
    lists = d.groupBy("repo_id", "manager").agg(F.count(F.lit(1)).alias("n"))
    lists = lists.select("*", F.row_number().over(in_order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("repo_id")).alias("k"),
                         F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d, saved(lists, "dependency-lists")


def _at_list(d: DataFrame, lists: DataFrame) -> DataFrame:
    """Every dependency with its list's row."""
    x = lists.select(F.col("repo_id").alias("_r"), F.col("manager").alias("_m"), "i", "k", "before")
    return d.join(x, d["repo_id"].eqNullSafe(x["_r"]) & d["manager"].eqNullSafe(x["_m"])).drop("_r", "_m")


def _lines(df: DataFrame, artifact: str, lines: list[tuple[Column | int, Column | str]]) -> DataFrame:
    """Lines of one document by their numbers, as many per row."""
    each = F.array(*[F.struct((F.lit(n) if isinstance(n, int) else n).cast("bigint").alias("line_no"),
                              (F.lit(t) if isinstance(t, str) else t).alias("line")) for n, t in lines])
    return df.select("repo_id", F.lit(artifact).alias("artifact"), F.explode(each).alias("x")).select("repo_id", "artifact", "x.line_no", "x.line")


# O3
def dependency_graph_lines(deps: DataFrame, artifact: str = "dependency-graph.md", numbered: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Mermaid graph of managers and their (sorted) dependencies; deps: (repo_id, manager, name, version).

    Every line's number follows from its list's row. ``numbered``: ``numbered_dependencies`` of ``deps``, for several documents.
    """
    d, lists = numbered or numbered_dependencies(deps)
    named = F.col("repo_id").isNotNull() & F.col("manager").isNotNull()
    # dependencies without a repository or a manager have no lines of their own, and none stand before another list
    shown = lists.select("repo_id", "manager", F.when(named, F.col("n")).otherwise(0).alias("n"), "i", "k",
                         F.coalesce(F.sum(F.when(named, F.col("n")).otherwise(0)).over(
                             Window.partitionBy("repo_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    d = _at_list(d.filter(named), shown)
    pm = F.concat(F.lit("PM"), F.col("i").cast("string"))
    did = F.concat(F.lit("D"), F.col("i").cast("string"), F.lit("_"), F.col("j").cast("string"))
    at = 4 + 2 * F.col("i") + 2 * F.col("before")  # a list's second line
    return reduce(DataFrame.unionByName, [
        _lines(shown.filter("i = 1"), artifact, list(enumerate(["# Dependency Graph", "~~~mermaid", "graph LR", '  P["Project"]'], 1))),
        _lines(shown, artifact, [(at - 1, F.concat(F.lit("  "), pm, F.lit('["'), mermaid_label(F.col("manager")), F.lit('"]'))), (at, F.concat(F.lit("  P --> "), pm))]),
        _lines(d, artifact, [(at + 2 * F.col("j") - 1, F.concat(F.lit("  "), did, F.lit('["'), mermaid_label(F.col("name")), F.lit('"]'))),
                             (at + 2 * F.col("j"), F.concat(F.lit("  "), pm, F.lit(" --> "), did))]),
        _lines(shown.filter("i = k"), artifact, [(at + 2 * F.col("n") + 1, "~~~")]),
    ])


# O4
def module_graph_lines(overview: DataFrame, artifact: str = "module-graph.md") -> DataFrame:
    """Mermaid module graph of all ranked overview edges (repo_id, rank, src, dst).

    Nodes are numbered by first appearance, grouped by first segment, and listed before the edges. Nodes, groups and
    edges are long tables: no repository meets in one row.
    """
    e = overview.select("repo_id", "rank", "src", "dst")
    ends = e.select("repo_id", F.explode(F.array(
        F.struct((F.col("rank") * 2 - 1).alias("f"), F.col("src").alias("node")),
        F.struct((F.col("rank") * 2).alias("f"), F.col("dst").alias("node")))).alias("x")).select("repo_id", "x.f", "x.node")
    nodes = ends.groupBy("repo_id", "node").agg(F.min("f").alias("f"))
    nodes = saved(running_position(nodes, ["repo_id"], [F.col("f")], "n", lambda d: saved(d, "module-nodes")), "numbered-nodes")
    nodes = nodes.select("repo_id", "node", F.concat(F.lit("M"), (F.col("n") + 1).cast("string")).alias("id"), G.module_group("node").alias("grp"))
    keys = nodes.select("repo_id").distinct()

    def rows(df: DataFrame, block: int, sub: Column, ord_cols: list[Column], line: Column) -> DataFrame:
        return df.select("repo_id", F.lit(artifact).alias("artifact"), F.lit(block).alias("block"), sub.alias("sub"),
                         F.array(*ord_cols).alias("ord"), line.alias("line"))

    grp = F.col("grp")
    groups = nodes.select("repo_id", "grp").distinct()
    src = nodes.select("repo_id", F.col("node").alias("src"), F.col("id").alias("a"))
    dst = nodes.select("repo_id", F.col("node").alias("dst"), F.col("id").alias("b"))
    named = e.join(src, ["repo_id", "src"]).join(dst, ["repo_id", "dst"])
    return assemble(reduce(DataFrame.unionByName, [
        _lit_lines(keys, artifact, 0, ["# Module Graph", "", "Overview graph collapsed by module path for readability.", "~~~mermaid", "graph TD"]),
        rows(groups, 1, grp, [F.lit("0")], F.concat(F.lit("  subgraph "), mermaid_id(F.concat(F.lit("G_"), grp)), F.lit('["'), mermaid_label(grp), F.lit('"]'))),
        rows(nodes, 1, grp, [F.lit("1"), F.col("node")], F.concat(F.lit("    "), F.col("id"), F.lit('["'), mermaid_label(F.col("node")), F.lit('"]'))),
        rows(groups, 1, grp, [F.lit("2")], F.lit("  end")),
        rows(named, 2, F.lit(""), [F.lpad(F.col("rank").cast("string"), 16, "0")], F.concat(F.lit("  "), F.col("a"), F.lit(" --> "), F.col("b"))),
        _lit_lines(keys, artifact, 3, ["~~~"]),
    ]))


# O2 (dependencies.md)
def dependencies_doc_lines(deps: DataFrame, artifact: str = "dependencies.md", numbered: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Counts and tables of the managers' (sorted) dependencies; arguments as for ``dependency_graph_lines``."""
    d, lists = numbered or numbered_dependencies(deps)
    d = _at_list(d, lists)
    at = 5 + F.col("k") + F.col("before") + 3 * F.col("i")  # the last line above a list's table
    return reduce(DataFrame.unionByName, [
        _lines(lists.filter("i = 1"), artifact, list(enumerate(["# Dependencies", "", "## Summary", "| Manager | Count |", "|---|---|"], 1))),
        _lines(lists, artifact, [
            (5 + F.col("i"), F.concat(F.lit("| "), F.col("manager"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))),
            (at - 2, F.concat(F.lit("## "), F.col("manager"))), (at - 1, "| Name | Version |"), (at, "|---|---|")]),
        _lines(d, artifact, [(at + F.col("j"), F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("version"), F.lit(" |")))]),
    ])


# O1
def _list_section(title: str, items: Column) -> Column:
    body = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("- n/a\n\n")).otherwise(
        F.concat(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n")))
    return F.concat(F.lit(title + "\n"), body)


def summary_text(snap: DataFrame, method_counts: DataFrame | None = None) -> DataFrame:
    """The project summary per snapshot row (bounded: counts and small sets only)."""
    st = F.col("projectStats")
    shape = F.when(F.coalesce(st.totalFiles, F.lit(0)) == 0, F.lit("Repository shape\n- files: n/a\n\n")).otherwise(F.concat(
        F.lit("Repository shape\n- total files: "), st.totalFiles.cast("string"),
        F.lit("\n- source files: "), st.sourceFiles.cast("string"), F.lit("\n- test files: "), st.testFiles.cast("string"),
        F.lit("\n- manifest files: "), st.manifestFiles.cast("string"), F.lit("\n- config files: "), st.configFiles.cast("string"),
        F.lit("\n\n")))
    mk = F.array_sort(F.map_keys("dependencies"))
    total = F.aggregate(F.map_values("dependencies"), F.lit(0), lambda a, x: a + F.size(x))
    deps = F.when(F.size(mk) == 0, F.lit("Dependencies\n- n/a\n\n")).otherwise(F.concat(
        F.lit("Dependencies\n"),
        F.array_join(F.transform(mk, lambda m: F.concat(F.lit("- "), m, F.lit(": "), F.size(F.element_at("dependencies", m)).cast("string"))), "\n"),
        F.lit("\n- total: "), total.cast("string"), F.lit("\n\n")))
    methods = F.array_sort(F.array_distinct(F.transform("routes", lambda r: F.upper(F.trim(r.method)))))
    per_method = F.transform(methods, lambda m: F.concat(F.lit("- "), m, F.lit(": "), F.size(F.filter("routes", lambda r: F.upper(F.trim(r.method)) == m)).cast("string")))
    api = F.concat(F.lit("API endpoints\n- "), F.size("routes").cast("string"), F.lit(" routes detected\n"),
                   F.when(F.size(per_method) > 0, F.concat(F.array_join(per_method, "\n"), F.lit("\n"))).otherwise(F.lit("")), F.lit("\n"))
    groups = F.when(F.coalesce(F.size("apiGroups"), F.lit(0)) <= 0, F.lit("API groups\n- n/a\n\n")).otherwise(F.concat(
        F.lit("API groups\n"), F.array_join(F.transform("apiGroups", lambda g: F.concat(
            F.lit("- "), g.prefix, F.lit(": "), g.routeCount.cast("string"), F.lit(" ("), F.array_join(g.methods, ", "), F.lit(")"))), "\n"),
        F.lit("\n\n")))
    services = F.when(F.size("infrastructureServices") == 0, F.lit("Services\n- n/a\n")).otherwise(F.concat(
        F.lit("Services\n"), F.array_join(F.transform("infrastructureServices", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")))
    text = F.concat(F.lit("Project summary\n\nPath\n"), F.col("projectPath"), F.lit("\n\n"),
                    _list_section("Languages", F.col("languages")), _list_section("Frameworks", F.col("frameworks")),
                    _list_section("Package managers", F.col("packageManagers")), shape, deps, api, groups, services)
    return snap.select("repo_id", "snapshot_id", text.alias("summary"))


# ---------------------------------------------------------------- O2: the other documents
def _num_desc(c: Column) -> Column:
    return F.lpad((F.lit(10 ** 15) - c).cast("string"), 16, "0")


def _rows(df: DataFrame, artifact: str, block: int, ord_cols: list[Column], line: Column) -> DataFrame:
    return df.select("repo_id", F.lit(artifact).alias("artifact"), F.lit(block).alias("block"), F.lit("").alias("sub"),
                     F.array(F.lit("2"), *[c.cast("string") for c in ord_cols]).alias("ord"), line.alias("line"))


def _section(keys: DataFrame, rows: DataFrame, artifact: str, block: int, title: list[str], header: list[str],
             empty: str) -> DataFrame:
    """Title lines for every repository; table header when it has rows, ``empty`` otherwise."""
    has = rows.select("repo_id").distinct()
    parts = [_lit_lines(keys, artifact, block, title).withColumn("ord", F.array(F.lit("0"), F.col("ord")[0]))]
    if header:
        parts.append(_lit_lines(has, artifact, block, header).withColumn("ord", F.array(F.lit("1"), F.col("ord")[0])))
    parts.append(_lit_lines(keys.join(has, "repo_id", "left_anti"), artifact, block, [empty])
                 .withColumn("ord", F.array(F.lit("3"), F.col("ord")[0])))
    parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def _cells(*cols) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cols]), F.lit(" |"))


def endpoints_doc_lines(keys: DataFrame, routes: DataFrame, artifact: str = "endpoints.md") -> DataFrame:
    """routes: deduplicated (repo_id, method, path, controller)."""
    from . import routes as R
    by_method = R.route_method_counts(routes.withColumn("snapshot_id", F.lit("")))
    groups = R.api_groups(routes.withColumn("snapshot_id", F.lit("")))
    none = "No endpoints detected for the current project."
    blocks = [
        _lit_lines(keys, artifact, 0, ["# API Endpoints", ""]),
        _section(keys, _rows(by_method, artifact, 1, [F.col("method")], _cells(F.col("method"), F.col("n_routes"))),
                 artifact, 1, ["## Route Summary by Method"], ["| Method | Count |", "|---|---|"], none),
        _lit_lines(keys, artifact, 2, [""]),
        _section(keys, _rows(groups, artifact, 3, [_num_desc(F.col("route_count")), F.col("prefix")],
                             _cells(F.col("prefix"), F.col("route_count"), list_text(F.col("methods")))),
                 artifact, 3, ["## Route Groups"], ["| Prefix | Routes | Methods |", "|---|---|---|"], "No route groups detected."),
        _lit_lines(keys, artifact, 4, [""]),
        _section(keys, _rows(routes, artifact, 5, [F.col("method"), F.col("path"), F.col("controller")],
                             _cells(F.col("method"), F.col("path"), F.col("controller"))),
                 artifact, 5, ["## Route Inventory"], ["| Method | Path | Controller |", "|---|---|---|"], none),
    ]
    return assemble(reduce(DataFrame.unionByName, blocks))


def _dir_rows(layout: DataFrame, artifact: str, block: int, full: bool) -> DataFrame:
    cols = [F.col("path"), F.col("file_count"), F.col("source_files"), F.col("test_files")]
    if full:
        cols += [F.col("manifest_files"), F.col("config_files"), list_text(F.col("languages")), list_text(F.col("notable_files"))]
    return _rows(layout, artifact, block, [F.when(F.col("path") == "root", "0").otherwise("1"), F.col("path")], _cells(*cols))


def project_structure_doc_lines(keys: DataFrame, stats: DataFrame, manifests: DataFrame, entry: DataFrame,
                                layout: DataFrame, artifact: str = "project-structure.md") -> DataFrame:
    """stats: project_stats rows; manifests: (repo_id, path, kind); entry: (repo_id, entry_point); layout: directory rows."""
    metric = stats.select("repo_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(label).alias("k"), F.col(c).alias("v")) for i, (label, c) in enumerate(
            [("Total files", "total_files"), ("Source files", "source_files"), ("Test files", "test_files"),
             ("Manifest files", "manifest_files"), ("Config files", "config_files")])])).alias("m"))
    blocks = [
        _lit_lines(keys, artifact, 0, ["# Project Structure", "", "## Repository Footprint", "", "| Metric | Value |", "|---|---|"]),
        _rows(metric, artifact, 1, [F.col("m.i")], _cells(F.col("m.k"), F.col("m.v"))),
        _lit_lines(keys, artifact, 2, [""]),
        _section(keys, _rows(manifests, artifact, 3, [F.col("kind"), F.col("path")], _cells(F.col("kind"), F.col("path"))),
                 artifact, 3, ["## Manifest Inventory"], ["| Kind | Path |", "|---|---|"], "No manifests detected."),
        _lit_lines(keys, artifact, 4, [""]),
        _section(keys, _rows(entry, artifact, 5, [F.col("entry_point")], F.concat(F.lit("- `"), F.col("entry_point"), F.lit("`"))),
                 artifact, 5, ["## Entry Points"], [], "- n/a"),
        _lit_lines(keys, artifact, 6, [""]),
        _section(keys, _dir_rows(layout, artifact, 7, True), artifact, 7, ["## Directory Layout"],
                 ["| Path | Files | Source | Tests | Manifests | Config | Languages | Notable files |",
                  "|---|---|---|---|---|---|---|---|"], "No directory layout detected."),
    ]
    return assemble(reduce(DataFrame.unionByName, blocks))


def layer_graph_lines(layer_edges: DataFrame) -> DataFrame:
    """G7 + T6: (repo_id, line) rows of the Laravel layer graph, ordered by ``ord`` (bounded: <= 14 x 14 edges)."""
    e = layer_edges.groupBy("repo_id").agg(F.array_sort(F.collect_set(F.struct("src_layer", "dst_layer"))).alias("e"))
    layers = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x.src_layer, x.dst_layer))))
    order = F.array(*[F.lit(x) for x in fixed.LAYER_ORDER])
    ranked = F.transform(layers, lambda l_: F.struct(F.coalesce(F.nullif(F.array_position(order, l_), F.lit(0)),
                                                                F.lit(len(fixed.LAYER_ORDER) + 1)).alias("p"), l_.alias("l")))
    sorted_layers = F.transform(F.array_sort(ranked), lambda x: x.l)
    node = lambda l_: mermaid_id(F.concat(F.lit("L_"), l_))
    lines = F.concat(F.array(F.lit("~~~mermaid"), F.lit("graph LR")),
                     F.transform(sorted_layers, lambda l_: F.concat(F.lit("  "), node(l_), F.lit('["'), mermaid_label(l_), F.lit('"]'))),
                     F.transform("e", lambda x: F.concat(F.lit("  "), node(x.src_layer), F.lit(" --> "), node(x.dst_layer))),
                     F.array(F.lit("~~~")))
    return e.select("repo_id", F.posexplode(lines).alias("p", "line"))


def architecture_doc_lines(snap: DataFrame, layout: DataFrame, layer_edges: DataFrame, artifact: str = "architecture.md") -> DataFrame:
    keys = snap.select("repo_id").distinct()
    tech = snap.select("repo_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _cells(F.lit(label), list_text(F.col(c))).alias("line")) for i, (label, c) in enumerate(
            [("Languages", "languages"), ("Frameworks", "frameworks"), ("Package managers", "packageManagers"),
             ("Infrastructure", "infrastructureServices")])])).alias("t"))
    lg = layer_graph_lines(layer_edges)
    lg_keys = lg.select("repo_id").distinct()
    blocks = [
        _lit_lines(keys, artifact, 0, ["# Architecture", "", "## Technology View", "", "| Area | Signals |", "|---|---|"]),
        _rows(tech, artifact, 1, [F.col("t.i")], F.col("t.line")),
        _lit_lines(keys, artifact, 2, ["", "## Layer Diagram", "", "~~~mermaid", "graph TD", "Controllers --> Services",
                                       "Services --> Repositories", "Repositories --> Database", "~~~", ""]),
        _section(keys, _dir_rows(layout, artifact, 3, False), artifact, 3, ["## Project Structure Signals"],
                 ["| Path | Files | Source | Tests |", "|---|---|---|---|"], "No structure signals detected."),
        _lit_lines(lg_keys, artifact, 4, ["## Laravel Layer Graph", "", "Derived from PHP namespace imports inside app/*.", ""]),
        _rows(lg, artifact, 5, [F.lpad(F.col("p").cast("string"), 6, "0")], F.col("line")),
    ]
    return assemble(reduce(DataFrame.unionByName, blocks))


#: The line of the overview document that changes with every scan; comparisons of documents leave it out.
SCANNED_AT = "| Scanned at |"


def readme_doc_lines(snap: DataFrame, layout: DataFrame, artifact: str = "README.generated.md") -> DataFrame:
    """The overview document: snap are snapshot rows, layout directory rows."""
    keys = snap.select("repo_id").distinct()
    st = F.col("projectStats")
    n_deps = F.aggregate(F.map_values("dependencies"), F.lit(0), lambda a, x: a + F.size(x))

    def metric_rows(block: int, cells: list[tuple[str, Column]]) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(i).alias("i"), _cells(F.lit(k), v).alias("line")) for i, (k, v) in enumerate(cells)])
        x = snap.select("repo_id", F.explode(arr).alias("m"))
        return _rows(x, artifact, block, [F.col("m.i")], F.col("m.line"))

    name = display_project_name(F.col("projectName"), F.col("projectPath"))
    title = snap.select("repo_id", F.concat(F.lit("# "), name, F.lit(" Documentation")).alias("t"))
    entry = snap.select("repo_id", F.explode("entryPoints").alias("entry_point"))
    blocks = [
        _rows(title, artifact, 0, [F.lit(0)], F.col("t")),
        _lit_lines(keys, artifact, 1, ["", "Generated from repository manifests, source files, and detected API surface.", "",
                                       "## Repository Summary", "", "| Field | Value |", "|---|---|"]),
        metric_rows(2, [("Project", name), ("Path", F.col("projectPath")), ("Scanned at", F.col("scannedAt")),
                        ("Languages", list_text(F.col("languages"))), ("Frameworks", list_text(F.col("frameworks"))),
                        ("Package managers", list_text(F.col("packageManagers")))]),
        _lit_lines(keys, artifact, 3, ["", "## Repository Shape", "", "| Metric | Value |", "|---|---|"]),
        metric_rows(4, [("Total files", st.totalFiles), ("Source files", st.sourceFiles), ("Test files", st.testFiles),
                        ("Manifest files", st.manifestFiles), ("Config files", st.configFiles), ("Dependencies", n_deps),
                        ("API routes", F.size("routes"))]),
        _lit_lines(keys, artifact, 5, [""]),
        _section(keys, _rows(entry, artifact, 6, [F.col("entry_point")], F.concat(F.lit("- `"), F.col("entry_point"), F.lit("`"))),
                 artifact, 6, ["## Entry Points"], [], "- n/a"),
        _lit_lines(keys, artifact, 7, [""]),
        _section(keys, _dir_rows(layout, artifact, 8, True), artifact, 8, ["## Directory Highlights"],
                 ["| Path | Files | Source | Tests | Manifests | Config | Languages | Notable files |",
                  "|---|---|---|---|---|---|---|---|"], "No directory layout detected."),
        _lit_lines(keys, artifact, 9, [""] + ["## Documentation Set"] + [
            f"- [{n}]({f})" for n, f in (("Project Structure", "project-structure.md"), ("Dependencies", "dependencies.md"),
                                         ("Dependency Graph", "dependency-graph.md"), ("Module Graph", "module-graph.md"),
                                         ("API Endpoints", "endpoints.md"), ("Architecture", "architecture.md"))]),
    ]
    return assemble(reduce(DataFrame.unionByName, blocks))


def documents(census, raw_edges: DataFrame, scanned_at: str | None = None) -> DataFrame:
    """The seven markdown documents of every snapshot as line rows; a repository without dependencies or without module
    edges has no document of them. Snapshot rows and layout are written once and read by two documents each."""
    from . import modules as G
    from . import snapshot as SN
    from . import structure as S
    c = census
    keys = c.facts.select("repo_id").distinct()
    deps = c.dependencies.select("repo_id", "manager", "name", "version")
    numbered = numbered_dependencies(deps)
    routes = c.routes.select("repo_id", "method", "path", "controller")
    facts = c.facts
    layout = saved(S.directory_layout(facts), "document-layout")
    snap = saved(SN.snapshot_rows(c, scanned_at=scanned_at), "document-snapshots")
    parts = [
        readme_doc_lines(snap, layout),
        project_structure_doc_lines(keys, S.project_stats(facts), S.manifest_inventory(facts),
                                    S.entry_points(facts).select("repo_id", "entry_point"), layout),
        dependencies_doc_lines(deps, numbered=numbered), endpoints_doc_lines(keys, routes), dependency_graph_lines(deps, numbered=numbered),
        module_graph_lines(G.overview_edges(raw_edges)),
        architecture_doc_lines(snap, layout, G.layer_edges(raw_edges, c.frameworks)),
    ]
    return reduce(DataFrame.unionByName, parts)
