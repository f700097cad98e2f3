"""Plan properties that matter at scale: pushdown into the parquet scan, no repo-keyed shuffle before parsing."""

from codecensus.operators import manifests as M
from codecensus.sources.files import files_from_rows, read_files, write_files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parser_pushdown_and_partitioning(spark, tmp_path):
    path = str(tmp_path / "files")
    write_files(files_from_rows(spark, [("go.mod", "module m\nrequire (\n\ta v1\n)\n"), ("package.json", "{}")], "r"), path)
    files = read_files(spark, path)
    plan = _plan(M.dependencies(files, ["go"]))
    assert "EqualTo(base,go.mod)" in plan            # the name test reaches the scan
    assert "content" in plan and "abs_path" not in plan.split("ReadSchema")[1].split("\n")[0]
    # exactly one exchange: the file-keyed window; the last-wins aggregate reuses its partitioning
    assert plan.count("Exchange hashpartitioning(repo_id") == 1
    assert [tuple(r) for r in M.dependencies(files, ["go"]).select("name", "version").collect()] == [("a", "v1")]


def test_snapshot_assembly_needs_no_exchange(spark, files):
    """Over the bucketed tables of a census, all groupings and joins of the snapshot rows stay inside their bucket."""
    from codecensus.operators import snapshot as SN
    c = SN.census(files([("go.mod", "module m\nrequire a v1\n"), ("main.go", "package main\n")]), route_parsers=["express"], managers=["go"], materialize=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        snap = SN.snapshot_rows(c)
        plan = snap._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") >= 8
        row = snap.collect()[0]
        assert row.projectStats.totalFiles == 2 and row.directoryLayout[0].notableFiles == ["go.mod", "main.go"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables = list(c.tables)
    c.drop()
    assert tables and not any(spark.catalog.tableExists(t) for t in tables)


def _lineitem(spark, folder, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    df.withColumn("l_shipdate", F.to_timestamp(F.lit("1997-01-01"))).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_manifest_queries_move_row_keys_once(spark, tmp_path):
    """A dependency query builds the manifests it parses, and only them, behind the one exchange that its parser needs."""
    from codecensus.plans import q_manifests as Q
    sf = _lineitem(spark, tmp_path, [(1, 7, 3, 1), (1, 7, 3, 2), (2, 50, 3, 1), (2600, 8, 3, 4), (None, 9, 3, 1), (5, 9, None, 1)])
    for q in (Q.deps_gradle, Q.deps_cargo, Q.deps_npm):
        plan = _plan(q(spark, sf))
        assert plan.count("Exchange hashpartitioning") == 1 and "codecensus-" not in plan
    rows = {(r.repo_id, r.rel_path, r.name, r.version) for r in Q.deps_gradle(spark, sf).collect()}
    assert rows == {("s3", "m0/build.gradle", "g7:p7", "1.2.1"), ("s3", "m0/build.gradle", "org.springframework:spring-webmvc", "1.1.2"),
                    ("s3", "m1/build.gradle", "g8:p8", "1.4.0"), (None, "m0/build.gradle", "g9:p9", "1.1.5")}


def test_json_manifests_are_parsed_once(spark, tmp_path):
    """The checks of a document and its entries read one parse of it: no filter repeats the parse below the generator."""
    from codecensus.plans import q_manifests as Q
    sf = _lineitem(spark, tmp_path, [(1, 7, 3, 1), (1, 7, 3, 2), (2, 50, 3, 1)])
    for q in (Q.deps_npm, Q.deps_composer):
        df = q(spark, sf)
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
        assert df.count() == 2


def test_go_requirements_split_at_any_white_space(spark, files):
    rows = files([("go.mod", "module m\nrequire\ta v0\nrequire  b \u00a0\u2003v1 // x\nrequire (\n\tc\tv2\r\n d\n\u3000e\u1680v\u00e93\n)\nf v4\nrequire g\n")])
    got = sorted((r.name, r.version) for r in M.parse_go_mod(rows).collect())
    assert got == [("b", "v1"), ("c", "v2"), ("e", "v\u00e93")]


def test_pyproject_lines_are_read_once(spark, tmp_path):
    """Both dependency sections of a file come out of one window over its lines, behind the one exchange."""
    from codecensus.plans import q_manifests as Q
    sf = _lineitem(spark, tmp_path, [(1, 7, 3, 1), (1, 8, 3, 5), (2, 50, 3, 4)])
    df = Q.deps_pyproject(spark, sf)
    plan = _plan(df)
    assert plan.count("Window [") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert {(r.manager, r.name, r.version) for r in df.collect()} == {("pip", "p7", ">=1.1.1"), ("poetry", "p8", "^1.5.1"), ("pip", "django", ">=1.4.2")}


def test_manifest_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """The exchange of row keys has as many tasks as the rows need, whatever their bytes or the session's shuffle partitions."""
    from codecensus import session
    from codecensus.plans import q_manifests as Q
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    sf = _lineitem(spark, tmp_path, [(k, 7, k, 1) for k in range(41)])
    for q in (Q.deps_nuget, Q.deps_pip):
        df = q(spark, sf)
        assert ", 21), REPARTITION_BY_NUM" in _plan(df) and df.count() == 41


def test_directory_layout_names_all_notable_files(spark, tmp_path):
    from codecensus.plans import q_structure as Q
    # one customer; the base name follows from o_orderkey div 10, and o_orderkey % 10 = 0 is the root folder
    spark.createDataFrame([(10 * k, 4) for k in range(24)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    row = Q.directory_layout(spark, str(tmp_path)).collect()[0]
    assert row.path == "root" and row.file_count == 24
    named = row.notable_files.split(",")
    assert len(named) > 5 and named == sorted(named)
    assert named == [r.notable_file for r in Q.notable_files(spark, str(tmp_path)).orderBy("rank").collect()]


def test_module_edges_read_their_language_only(spark, tmp_path):
    """A language's edges come from its own files, built and made distinct behind one exchange."""
    from codecensus.operators import modules as G
    from codecensus.plans.corpus_modules import module_corpus
    sf = _lineitem(spark, tmp_path, [(2, 7, 1, 1), (3, 7, 1, 1), (2, 7, 2, 1), (None, 9, 1, 1), (5, 9, None, 1), (4, 7, 1, 7)])
    edges = G.raw_edges(module_corpus(spark, sf), ["js"])
    assert "codecensus-" not in _plan(edges)
    assert {(r.repo_id, r.src, r.dst) for r in edges.collect()} == {
        ("e1", "pkg/p7/f1_0.js", "lib/s2"), ("e1", "pkg/p7/f1_0.js", "lib/s3")}


def test_module_dictionaries_read_one_branch_once(spark, tmp_path):
    """Module paths and mappings come from the branch that holds their files, and a mapping document is parsed once."""
    from codecensus.operators import modules as G
    from codecensus.plans.corpus_modules import module_corpus
    sf = _lineitem(spark, tmp_path, [(2, 7, 1, 1), (3, 7, 4, 1), (2, 7, 3, 1), (None, 9, 1, 1), (5, 9, None, 1)])
    files = module_corpus(spark, sf)
    for df in (G.go_module_paths(files), G.psr4_mappings(files)):
        assert _plan(df).count("FileScan parquet") <= 3
    assert {(r.repo_id, r.prefix, r.dir) for r in G.psr4_mappings(files).collect()} == {
        ("e3", "App\\", "app"), ("e3", "App\\Jobs\\", "jobs"), ("e3", "Tests\\", "tests")}


def test_a_list_among_the_mappings_voids_its_snapshot(spark, files):
    """The first section wins, a list voids every mapping of the snapshot, a file of that name elsewhere maps nothing."""
    from codecensus.operators import modules as G
    good = '{"autoload": {"psr-4": {"A\\\\": "a/"}}, "autoload-dev": {"psr-4": {"A\\\\": "b/", "T\\\\": " t "}}}'
    bad = '{"autoload": {"psr-4": {"A\\\\": "a/"}}, "autoload-dev": {"psr-4": {"T\\\\": ["t"]}}}'
    rows = files([("composer.json", good), ("sub/composer.json", bad)], repo="r1").unionByName(files([("composer.json", bad)], repo="r2"))
    assert sorted((r.repo_id, r.prefix, r.dir, r.prio) for r in G.psr4_mappings(rows).collect()) == [("r1", "A\\", "a", 0), ("r1", "T\\", "t", 1)]


def test_route_tasks_follow_the_events(spark, tmp_path, monkeypatch):
    """Route files are dealt once, by as many tasks as the events need; parsers' windows by file add no exchange, a union neither."""
    import datetime

    from codecensus.plans import corpus_routes, registry
    registry.load_all()
    monkeypatch.setattr(corpus_routes, "TASK_EVENTS", 2, raising=False)
    at = datetime.datetime(2024, 1, 1)
    # event_id % 11 is the framework, 9 events or 10 each
    rows = [(k, k % 5, "view", at) for k in range(11 * 9)] + [(101, None, "view", at), (102, 1, None, at), (None, 1, "view", at)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    for name, fw in (("routes_flask", 3), ("routes_go", 5), ("routes_aspnet", 9), ("routes_spring", 10)):
        df = registry.QUERIES[name](spark, str(tmp_path))
        by_file = [line for line in _plan(df).splitlines() if "Exchange" in line and "rel_path" in line]
        assert by_file and all(", 5), REPARTITION_BY_NUM" in line for line in by_file)
        if fw == 10:
            assert {(r.repo_id, r.path) for r in df.filter("repo_id is not null").collect()} == {(f"u{k % 5}", f"/u{k % 5}/view/{k}") for k in range(fw, 99, 11)}
