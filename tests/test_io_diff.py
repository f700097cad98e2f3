"""Sources and sinks (S1, S2, S4, S5), diff (J2, J3, X1, A12, O5, O6, S8), drift (C1), streaming, driver entry."""

import json
import os

from pyspark.sql import functions as F

from codecensus.operators import diff as D
from codecensus.operators import drift as DR
from codecensus.sources.files import ingest_tree
from codecensus.sources.snapshot_io import read_snapshots, write_snapshots


def test_ingest_tree_prunes(spark, tmp_path):
    root = tmp_path / "proj"
    kept = ["go.mod", ".env", "src/app.py", "src/__init__.py", "src/_helper.py", "pkg/_private/mod.py", "a/b/_x/.keep"]
    for rel, text in [(k, "x\n") for k in kept] + [("node_modules/x/index.js", "x"), (".git/config", "x"), ("build/out.txt", "x"),
                                                    ("src/node_modules/y.js", "x"), (".github/workflows/ci.yml", "x"), ("a/.hidden/_x", "x")]:
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    f = ingest_tree(spark, str(root), "r1", "s1")
    got = {r.rel_path: (r.base, r.ext, r.abs_path) for r in f.collect()}
    walked = {os.path.relpath(os.path.join(d, n), root) for d, _, ns in os.walk(root) for n in ns}
    assert set(got) == set(kept) and set(kept) < walked
    assert got["src/app.py"] == ("app.py", ".py", "/proj/src/app.py")


def test_snapshot_json_round_trip(spark, tmp_path):
    doc = {"projectName": "x", "projectPath": "/x", "scannedAt": "2024-01-01T00:00:00Z", "languages": ["go"],
           "dependencies": {"go": [{"name": "a", "version": "v1"}]}, "routes": [{"method": "GET", "path": "/", "controller": "h"}]}
    old = tmp_path / "old.json"
    old.write_text(json.dumps(doc, indent=2))
    df = read_snapshots(spark, str(old))
    r = df.collect()[0]
    assert r.languages == ["go"] and r.frameworks == [] and r.entryPoints == [] and r.dependencies["go"][0].version == "v1"
    out = str(tmp_path / "out")
    write_snapshots(df, out)
    back = read_snapshots(spark, out).collect()[0]
    assert back.routes[0].path == "/" and back.apiGroups is None


def test_diff_reports(spark):
    of = spark.createDataFrame([("r", "languages", "go"), ("r", "frameworks", "gin")], "repo_id string, facet string, value string")
    nf = spark.createDataFrame([("r", "languages", "go"), ("r", "languages", "python")], "repo_id string, facet string, value string")
    od = spark.createDataFrame([("r", "pip", "fastapi", "==0.1")], "repo_id string, manager string, name string, version string")
    nd = spark.createDataFrame([("r", "pip", "fastapi", "==0.2"), ("r", "npm", "react", "18"), ("r", "npm", "react", "18")],
                               "repo_id string, manager string, name string, version string")
    orr = spark.createDataFrame([("r", "GET", "/a", "h")], "repo_id string, method string, path string, controller string")
    nr = spark.createDataFrame([("r", "GET", "/a", "h"), ("r", "POST", "/b", "c")], "repo_id string, method string, path string, controller string")
    ch = D.changes(of, nf, od, nd, orr, nr)
    text = D.render_text(D.text_report_lines(ch)).collect()[0].report
    assert text == ("Changes detected\n\nLanguages\n+ python\n\nDependencies\n+ react (npm)\n+ react (npm)\n+ fastapi (pip)\n"
                    "- fastapi (pip)\n\nEndpoints\n+ POST /b\n\nFrameworks\n- gin")
    md = {r.line for r in D.markdown_report_lines(ch).collect()}
    assert "- + `POST /b` (c)" in md and "- - `gin`" in md
    repos = spark.createDataFrame([("r",), ("quiet",)], "repo_id string")
    flags = {r.repo_id: r.has_changes for r in D.has_changes(repos, ch).collect()}
    assert flags == {"r": True, "quiet": False}
    js = json.loads(D.diff_result(ch).collect()[0].json)
    assert js["addedLanguages"] == ["python"] and js["removedFrameworks"] == ["gin"]
    assert js["addedDependencies"]["npm"] == [{"name": "react", "version": "18"}] * 2


def test_drift_check(spark):
    rows = lambda xs: spark.createDataFrame(xs, "repo_id string, artifact string, line_no bigint, line string")
    stored = rows([("r", "a.md", 1, "x"), ("r", "b.md", 1, "y"), ("r", "index.html", 1, "z")])
    fresh = rows([("r", "a.md", 1, "x"), ("r", "b.md", 1, "y2"), ("r", "c.md", 1, "w")])
    got = {(r.artifact, r.status) for r in DR.check(stored, fresh, ["a.md", "b.md", "c.md"]).collect()}
    assert got == {("b.md", "outdated"), ("c.md", "missing"), ("index.html", "stale")}


def test_update_removes_stale_documents(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame(xs, "repo_id string, artifact string, line_no bigint, line string")
    path = str(tmp_path / "docs")
    DR.write_update(path, rows([("r", "old.md", 1, "x"), ("r", "a.md", 1, "x"), ("s", "a.md", 1, "s")]))
    after = DR.write_update(path, rows([("r", "a.md", 1, "y"), ("r", "index.html", 1, "h")]), ["a.md"])
    assert {(r.repo_id, r.artifact, r.line) for r in after.collect()} == {("r", "a.md", "y"), ("s", "a.md", "s")}
    a = rows([("r", "README.generated.md", 1, "| Scanned at | 2024 |"), ("r", "README.generated.md", 2, "x")])
    b = rows([("r", "README.generated.md", 1, "| Scanned at | 2025 |"), ("r", "README.generated.md", 2, "x")])
    assert DR.check(a, b).count() == 0


def test_update_writes_touched_buckets_only(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame(xs, "repo_id string, artifact string, line_no bigint, line string")
    path = tmp_path / "docs"
    names = [f"r{i}" for i in range(60)]
    DR.write_update(str(path), rows([(n, "a.md", 1, "old") for n in names]))
    first = {p: p.stat().st_mtime_ns for p in path.rglob("version=*/bucket=*/*.parquet")}
    after = DR.write_update(str(path), rows([("r7", "a.md", 1, "new"), ("r7", "a.md", 2, "more")]))
    assert {(r.repo_id, r.line) for r in after.collect()} == {(n, "old") for n in names if n != "r7"} | {("r7", "new"), ("r7", "more")}
    versions = sorted(path.glob("version=*"))
    assert len(versions) == 2 and len(list(versions[1].glob("bucket=*"))) == 1
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())
    # an update that leaves nothing of a repository, one of nothing, and one that never became complete
    gone = DR.write_update(str(path), rows([("r8", "index.html", 1, "x")]), ["a.md"])
    assert "r8" not in {r.repo_id for r in gone.collect()} and gone.count() == 60
    assert DR.write_update(str(path), rows([])).count() == 60 and len(list(path.glob("version=*"))) == 3
    (sorted(path.glob("version=*"))[-1] / "_SUCCESS").unlink()
    assert "r8" in {r.repo_id for r in DR.read_documents(spark, str(path)).collect()}
    assert DR.write_update(str(path), rows([("r9", "a.md", 1, "later")])).filter("repo_id = 'r9'").collect()[0].line == "later"


def test_load_or_scan_persists(spark, tmp_path):
    wanted = spark.createDataFrame([("a", "s1"), ("b", "s1")], "repo_id string, snapshot_id string")
    path, scanned = str(tmp_path / "snaps"), []

    def scan(missing):
        scanned.append({r.repo_id for r in missing.collect()})
        return missing.withColumn("languages", F.array(F.lit("go")))
    assert DR.load_or_scan(wanted.limit(1), path, scan).count() == 1
    assert DR.load_or_scan(wanted, path, scan).count() == 2
    assert DR.load_or_scan(wanted, path, scan).count() == 2
    assert scanned == [{"a"}, {"b"}]


def test_one_repository_spans_partitions(spark):
    from codecensus.functions.running import running_total
    from codecensus.plans.materialize import write_table
    from codecensus.session import saved
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id"))).alias("repo_id"),
                                  F.concat(F.lit("f"), F.col("id")).alias("rel_path"), F.lit(".py").alias("ext"), F.lit("x.py").alias("base"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = write_table(df, spark, "hot-repository")
        files = out.filter("repo_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
        pos = running_total(df, ["repo_id"], [F.col("rel_path")], {"n": F.lit(1)}, lambda d: saved(d, "t"))
        hot = [r.n for r in pos.filter("repo_id = 'hot'").orderBy("rel_path").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert files > 1 and hot == list(range(2000))


def test_positions_need_one_exchange_of_the_rows(spark, tmp_path):
    """Positions equal running totals of ones, over groups that span partitions, null keys and batches; rows move once."""
    from codecensus.functions.running import running_position, running_total
    from codecensus.session import saved
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("r"), F.col("id") % 50)).alias("g"),
                                  F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("h"), F.concat(F.lit("f"), F.col("id")).alias("v"))
    df = df.repartition(4)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for group in ([], ["g"], ["g", "h"]):
            got = running_position(df, group, [F.col("v")], "n", lambda d: saved(d, "t"))
            want = running_total(df, group, [F.col("v")], {"n": F.lit(1)}, lambda d: saved(d, "t"))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            # the rows' own side of the join neither moves nor sorts them again
            rows = got._jdf.queryExecution().optimizedPlan().children().head().children().head().toString()
            assert "Window" not in rows and "Aggregate" not in rows
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_documents_number_dependencies_once(spark):
    """Lines of both documents follow from one numbering, also for null repositories, managers, names and rows that come twice."""
    from codecensus.functions import running
    from codecensus.operators import reports as RP
    rows = [("a", "npm", "x", "1"), ("a", "npm", "x", "1"), ("a", "go", "z", None), ("a", "go", None, "2"), ("a", None, "q", "3"), ("b", "pip", 'p"p', ""), (None, "npm", "n", "1")]
    deps = spark.createDataFrame(rows, "repo_id string, manager string, name string, version string")
    calls = []
    kept, RP.running_position = RP.running_position, lambda *a, **k: calls.append(1) or running.running_position(*a, **k)
    try:
        numbered = RP.numbered_dependencies(deps)
        doc, graph = RP.dependencies_doc_lines(deps, numbered=numbered), RP.dependency_graph_lines(deps, numbered=numbered)
        alone = RP.dependencies_doc_lines(deps).collect()
    finally:
        RP.running_position = kept
    assert len(calls) == 2 and sorted(map(str, alone)) == sorted(map(str, doc.collect()))

    def of(d, repo):
        got = d.filter(F.col("repo_id").eqNullSafe(F.lit(repo))).orderBy("line_no").collect()
        assert [r.line_no for r in got] == list(range(1, len(got) + 1))
        return [r.line for r in got]
    head, table = ["# Dependencies", "", "## Summary", "| Manager | Count |", "|---|---|"], ["| Name | Version |", "|---|---|"]
    assert of(doc, "a") == [*head, None, "| go | 2 |", "| npm | 2 |", None, *table, "| q | 3 |", "## go", *table, None, None, "## npm", *table, "| x | 1 |", "| x | 1 |"]
    assert of(doc, None) == [*head, "| npm | 1 |", "## npm", *table, "| n | 1 |"]
    assert of(graph, "b") == ["# Dependency Graph", "~~~mermaid", "graph LR", '  P["Project"]', '  PM1["pip"]', "  P --> PM1", '  D1_1["p\'p"]', "  PM1 --> D1_1", "~~~"]
    # a null manager or repository heads a list without lines of its dependencies
    assert of(graph, "a")[4:6] == [None, "  P --> PM1"] and of(graph, "a")[6:] == [
        '  PM2["go"]', "  P --> PM2", None, "  PM2 --> D2_1", '  D2_2["z"]', "  PM2 --> D2_2",
        '  PM3["npm"]', "  P --> PM3", '  D3_1["x"]', "  PM3 --> D3_1", '  D3_2["x"]', "  PM3 --> D3_2", "~~~"]
    assert of(graph, None)[4:] == ['  PM1["npm"]', "  P --> PM1", "~~~"]


def test_row_order_holds_at_large_keys(spark):
    from codecensus.plans.corpus_manifests import ORD
    rows = spark.createDataFrame([(600_000_000_000, 1, 2_000_000_000), (600_000_000_000, 1, 5), (600_000_000_000, 7, 1), (3, 9, 9)],
                                 ", ".join(f"{c} long" for c in ORD))
    got = rows.select(F.struct(*ORD).alias("o")).orderBy("o").select("o.*").collect()
    assert [tuple(r) for r in got] == sorted(tuple(r) for r in rows.collect())


def test_streaming_census(spark, tmp_path):
    from codecensus.sources.files import files_from_rows
    from codecensus.streaming.incremental import start_census_stream
    src = str(tmp_path / "files")
    files_from_rows(spark, [("requirements.txt", "flask==3\n")], "a", "s1").write.parquet(src + "/b1")
    files_from_rows(spark, [("go.mod", "module m\nrequire x v1\n")], "b", "s1").write.parquet(src + "/b2")
    q = start_census_stream(spark, src + "/*", str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    deps = {(r.repo_id, r.name) for r in spark.read.parquet(str(tmp_path / "out" / "dependencies")).collect()}
    assert deps == {("a", "flask"), ("b", "x")}


def test_entry_contract(spark):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 60
    df = E.entry(spark)
    assert df.columns == ["repo_id", "framework"]
    assert df.filter(F.col("framework").isNull()).count() == 0
    assert os.path.basename(E.SMOKE_DIR) == "sf0.001"


def test_ingest_links_shards_and_pushed_filters(spark, tmp_path, monkeypatch):
    from codecensus.sources import files as S
    root = tmp_path / "proj"
    for k in range(30):
        p = root / f"d{k % 4}" / f"f{k}.{'py' if k % 3 else 'Go'}"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (k * 100) + bytes([255]) * (k % 2))
    os.symlink("d0/f0.Go", root / "to_file.py")
    os.symlink("d1", root / "to_folder.py")
    os.symlink("nowhere", root / "to_nothing.py")
    monkeypatch.setattr(S, "SHARD_BYTES", 5000)
    monkeypatch.setattr(S, "OPEN_BYTES", 10)
    f = S.ingest_tree(spark, str(root), "r", "s1")
    assert f.rdd.getNumPartitions() >= 8
    got = {r.rel_path: r for r in f.collect()}
    assert len(got) == 33 and got["to_file.py"].content == "" and got["to_folder.py"].content is None and got["to_nothing.py"].content is None
    assert got["d1/f5.py"].content == "x" * 500 + "�" and got["d1/f5.py"].n_bytes == 501
    assert S.unreadable(f).collect()[0][2:] == (33, 2)
    some = f.filter((F.col("ext") == ".go") & F.col("base").isin("f0.Go", "f3.Go", "f4.py") & (F.col("n_bytes") > 0))
    assert {r.rel_path for r in some.collect()} == {"d3/f3.Go"}
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "EqualTo(ext,.go)" in plan and "In(base, [f0.Go,f3.Go,f4.py])" in plan


def test_lenient_snapshots(spark, tmp_path):
    from pyspark.sql import Observation

    from codecensus.sources.snapshot_io import read_snapshots_lenient
    good = {"projectName": "x", "languages": ["go"], "routes": [{"method": "GET", "path": "/", "controller": "h"}], "unknown": 1}
    (tmp_path / "pretty.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(good), json.dumps({"projectName": 5, "routes": "none", "frameworks": None}), '{"torn": ', "[1]", ""]))
    seen = Observation("snapshots")
    rows = read_snapshots_lenient(spark, str(tmp_path), seen).collect()
    assert sorted((r.projectName or "", r.corrupt, tuple(sorted(r.rescued))) for r in rows) == [
        ("", True, ("_corrupt",)), ("", True, ("_corrupt",)), ("5", False, ("routes",)), ("x", False, ()), ("x", False, ())]
    assert all(r.frameworks == [] and r.dependencies == {} for r in rows)
    assert seen.get == {"documents": 5, "corrupt": 2, "rescued_fields": 1}


def test_container_and_json_fragments(spark, tmp_path):
    from codecensus.operators import json_documents as J
    from codecensus.sources import containers as C
    # one hot document that spans shards, and small ones around it
    rows = [("hot", "a.md", i, f"line {i} é") for i in range(5000)] + [("r", "b.md", 1, ""), ("r", "b.md", 2, "x"), ("z", "b.md", 1, "only")]
    lines = spark.createDataFrame(rows, "repo_id string, artifact string, line_no long, line string").repartition(5)
    path = str(tmp_path / "c")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    index = C.write_container(lines, ["repo_id", "artifact"], ["line_no"], path)
    spark.conf.set(merge, "true")
    assert index.filter("repo_id = 'hot'").count() > 1
    assert C.read_document(spark, path, repo_id="hot", artifact="a.md") == "".join(f"line {i} é\n" for i in range(5000))
    assert C.read_document(spark, path, repo_id="r", artifact="b.md") == "\nx\n"
    ch = spark.createDataFrame([("r", "languages", "added", None, 'q"\\', None, None), ("r", "languages", "added", None, "b", None, None),
                                ("r", "dependencies", "removed", "pip", "n", "1", None), ("r", "dependencies", "removed", "go", "m", "2", None),
                                ("r", "dependencies", "removed", "go", "a", "2", None), ("r", "routes", "added", None, "GET", "/a", "h")],
                               "repo_id string, kind string, op string, manager string, key1 string, key2 string, key3 string")
    repos = spark.createDataFrame([("r",), ("quiet",)], "repo_id string")
    f = J.diff_fragments(repos, ch).orderBy("repo_id", *J.ORDER).collect()
    docs = {k: json.loads("\n".join(r.text for r in f if r.repo_id == k)) for k in ("r", "quiet")}
    assert list(docs["r"])[:2] == ["addedLanguages", "removedLanguages"] and docs["r"]["addedLanguages"] == ["b", 'q"\\']
    assert docs["r"]["removedDependencies"] == {"go": [{"name": "a", "version": "2"}, {"name": "m", "version": "2"}], "pip": [{"name": "n", "version": "1"}]}
    assert docs["r"]["addedRoutes"] == [{"method": "GET", "path": "/a", "controller": "h"}]
    assert set(map(str, docs["quiet"].values())) == {"[]", "{}"}
