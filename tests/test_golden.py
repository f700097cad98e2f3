"""Golden repository: the reference's end-to-end sample tree re-created as ``files`` rows."""

from pyspark.sql import functions as F

from codecensus.operators import infra as I
from codecensus.operators import manifests as M
from codecensus.operators import modules as G
from codecensus.operators import reports as RP
from codecensus.operators import routes as R
from codecensus.operators import snapshot as SN
from codecensus.operators import structure as S

SAMPLE = [
    ("go.mod", "module example.com/sample\n\ngo 1.25\n\nrequire github.com/gin-gonic/gin v1.10.0\n"),
    ("package.json", '{\n  "dependencies": {\n    "express": "^5.0.0",\n    "react": "^18.3.0"\n  }\n}\n'),
    ("requirements.txt", "fastapi==0.115.0\n"),
    ("docker-compose.yml", "services:\n  db:\n    image: postgres:16\n  cache:\n    image: redis:7\n"),
    (".env", "APP_MODE=local\n"),
    ("main.go", 'package main\n\nimport (\n\t"example.com/sample/internal/server"\n\t"github.com/gin-gonic/gin"\n)\n\n'
                'func main() {\n\tr := gin.Default()\n\tapi := r.Group("/api")\n\tapi.GET("/health", server.Health)\n}\n'),
    ("internal/server/server.go", 'package server\n\nimport "example.com/sample/internal/store"\n\nfunc Health(v any) {\n\t_ = store.Ready\n\t_ = v\n}\n'),
    ("internal/store/store.go", "package store\n\nconst Ready = true\n"),
    ("py/api.py", 'from fastapi import FastAPI\nfrom .service import status\n\napp = FastAPI()\n\n\n@app.get("/py/health")\n'
                  'async def health():\n    return {"ok": status()}\n'),
    ("py/service.py", "def status():\n    return True\n"),
    ("web/server.js", "const express = require('express');\nconst { healthHandler } = require('./handlers.js');\n\n"
                      "const app = express();\napp.get('/web/health', healthHandler);\n"),
    ("web/handlers.js", "function healthHandler(req, res) {\n  return { ok: true, req, res };\n}\n\nmodule.exports = { healthHandler };\n"),
    ("snapshot.json", "{}\n"),
    ("fixture-snapshot.json", "{}\n"),
]


def _sample(files):
    return files(SAMPLE, repo="sample", project="sample_repo")


def test_project_stats(files):
    st = S.project_stats(S.file_facts(_sample(files))).collect()[0]
    assert (st.total_files, st.source_files, st.test_files, st.manifest_files, st.config_files) == (14, 7, 0, 5, 2)


def test_directory_layout(files):
    d = {r.path: r for r in S.directory_layout(S.file_facts(_sample(files))).collect()}
    assert sorted(d) == ["internal/server", "internal/store", "py", "root", "web"]
    assert d["root"].file_count == 8 and d["py"].file_count == 2 and d["web"].file_count == 2
    assert d["py"].languages == ["python"]
    assert "main.go" in d["root"].notable_files


def test_entry_points_and_manifests(files):
    facts = S.file_facts(_sample(files))
    ep = [r.entry_point for r in S.entry_points(facts).orderBy("rank").collect()]
    assert ep == ["main.go", "web/server.js"]
    inv = {(r.path, r.kind) for r in S.manifest_inventory(facts).collect()}
    assert inv == {("go.mod", "dependency"), ("package.json", "dependency"), ("requirements.txt", "dependency"),
                   ("docker-compose.yml", "infrastructure"), (".env", "runtime")}


def test_dependencies(files):
    deps = {(r.manager, r.name, r.version) for r in M.dependencies(_sample(files)).collect()}
    assert deps == {("go", "github.com/gin-gonic/gin", "v1.10.0"), ("npm", "express", "^5.0.0"),
                    ("npm", "react", "^18.3.0"), ("pip", "fastapi", "==0.115.0")}


def test_routes_and_frameworks(files):
    f = _sample(files)
    routes = {(r.method, r.path, r.controller) for r in R.routes(f).collect()}
    assert routes == {("GET", "/api/health", "server.Health"), ("GET", "/py/health", "health"),
                      ("GET", "/web/health", "healthHandler")}
    c = SN.census(f, materialize=True)
    fws = {r.framework for r in c.frameworks.collect()}
    assert fws == {"express", "fastapi", "gin", "react"}
    langs = sorted(r.language for r in c.languages.collect())
    assert langs == ["go", "javascript", "python"]


def test_infrastructure(files):
    infra = {r.service for r in I.infrastructure(_sample(files)).collect()}
    assert infra == {"docker", "env-file", "postgres", "redis"}


def test_module_graph(files):
    f = _sample(files)
    raw = {(r.src, r.dst) for r in G.raw_edges(f).collect()}
    assert raw == {("main.go", "internal/server"), ("internal/server/server.go", "internal/store"),
                   ("py/api.py", "py/service"), ("web/server.js", "web/handlers.js")}
    lines = [r.line for r in RP.module_graph_lines(G.overview_edges(G.raw_edges(f))).orderBy("line_no").collect()]
    assert lines == [
        "# Module Graph", "", "Overview graph collapsed by module path for readability.", "~~~mermaid", "graph TD",
        '  subgraph G_internal["internal"]', '    M1["internal/server"]', '    M2["internal/store"]', "  end",
        '  subgraph G_py["py"]', '    M3["py/api"]', '    M4["py/service"]', "  end",
        '  subgraph G_root["root"]', '    M5["root"]', "  end",
        '  subgraph G_web["web"]', '    M7["web/handlers"]', '    M6["web/server"]', "  end",
        "  M1 --> M2", "  M3 --> M4", "  M5 --> M1", "  M6 --> M7", "~~~"]


def test_dependency_graph(files):
    deps = M.dependencies(_sample(files)).select("repo_id", "manager", "name", "version")
    lines = [r.line for r in RP.dependency_graph_lines(deps).orderBy("line_no").collect()]
    assert lines == [
        "# Dependency Graph", "~~~mermaid", "graph LR", '  P["Project"]',
        '  PM1["go"]', "  P --> PM1", '  D1_1["github.com/gin-gonic/gin"]', "  PM1 --> D1_1",
        '  PM2["npm"]', "  P --> PM2", '  D2_1["express"]', "  PM2 --> D2_1", '  D2_2["react"]', "  PM2 --> D2_2",
        '  PM3["pip"]', "  P --> PM3", '  D3_1["fastapi"]', "  PM3 --> D3_1", "~~~"]


def test_snapshot_row_and_summary(files):
    c = SN.census(_sample(files), materialize=True)
    snap = SN.snapshot_rows(c, "/work/").collect()[0]
    assert snap.projectStats.totalFiles == 14
    assert [g.prefix for g in snap.apiGroups] == ["/api", "/py", "/web"]
    assert snap.packageManagers == ["go", "npm", "pip"]
    text = RP.summary_text(SN.snapshot_rows(c, "/work/")).collect()[0].summary
    assert "API endpoints\n- 3 routes detected\n- GET: 3\n" in text
    assert "Dependencies\n- go: 1\n- npm: 2\n- pip: 1\n- total: 4\n" in text
    assert text.endswith("Services\n- docker\n- env-file\n- postgres\n- redis\n")


def test_documents(files):
    from codecensus.operators import structure as S
    f = _sample(files)
    c = SN.census(f, materialize=True)
    keys = f.select("repo_id").distinct()
    ep = RP.endpoints_doc_lines(keys, c.routes.select("repo_id", "method", "path", "controller"))
    text = RP.render_text(ep).collect()[0].body
    assert text == ("# API Endpoints\n\n## Route Summary by Method\n| Method | Count |\n|---|---|\n| GET | 3 |\n\n"
                    "## Route Groups\n| Prefix | Routes | Methods |\n|---|---|---|\n| /api | 1 | GET |\n| /py | 1 | GET |\n"
                    "| /web | 1 | GET |\n\n## Route Inventory\n| Method | Path | Controller |\n|---|---|---|\n"
                    "| GET | /api/health | server.Health |\n| GET | /py/health | health |\n| GET | /web/health | healthHandler |\n")
    facts = c.facts
    ps = RP.project_structure_doc_lines(keys, S.project_stats(facts), S.manifest_inventory(facts),
                                        S.entry_points(facts).select("repo_id", "entry_point"),
                                        S.directory_layout(facts))
    body = RP.render_text(ps).collect()[0].body
    assert "| root | 8 | 1 | 0 | 5 | 2 | go | .env, docker-compose.yml, go.mod, main.go, package.json |\n" in body
    assert "## Entry Points\n- `main.go`\n- `web/server.js`\n\n## Directory Layout\n" in body
    assert body.startswith("# Project Structure\n\n## Repository Footprint\n\n| Metric | Value |\n|---|---|\n| Total files | 14 |\n")


def test_architecture_and_layers(files):
    from codecensus.operators import structure as S
    f = _sample(files)
    c = SN.census(f, materialize=True)
    raw = G.raw_edges(f)
    doc = RP.architecture_doc_lines(SN.snapshot_rows(c), S.directory_layout(c.facts), G.layer_edges(raw, c.frameworks))
    body = RP.render_text(doc).collect()[0].body
    assert body == ("# Architecture\n\n## Technology View\n\n| Area | Signals |\n|---|---|\n| Languages | go, javascript, python |\n"
                    "| Frameworks | express, fastapi, gin, react |\n| Package managers | go, npm, pip |\n"
                    "| Infrastructure | docker, env-file, postgres, redis |\n\n## Layer Diagram\n\n~~~mermaid\ngraph TD\n"
                    "Controllers --> Services\nServices --> Repositories\nRepositories --> Database\n~~~\n\n"
                    "## Project Structure Signals\n| Path | Files | Source | Tests |\n|---|---|---|---|\n| root | 8 | 1 | 0 |\n"
                    "| internal/server | 1 | 1 | 0 |\n| internal/store | 1 | 1 | 0 |\n| py | 2 | 2 | 0 |\n| web | 2 | 2 | 0 |\n")
    # a Laravel tree: layers follow the preferred order, edges sorted
    lf = files([("composer.json", '{"require": {"laravel/framework": "^11"}, "autoload": {"psr-4": {"App\\\\": "app/"}}}'),
                ("app/Http/Controllers/OrderController.php", "<?php\nnamespace App\\Http\\Controllers;\nuse App\\Services\\OrderService;\n"),
                ("app/Services/OrderService.php", "<?php\nnamespace App\\Services;\nuse App\\Models\\{Order, Line as L};\n"),
                ("tests/Feature/OrderTest.php", "<?php\nnamespace Tests\\Feature;\nuse App\\Models\\Order;\n")], repo="lv")
    lc = SN.census(lf, materialize=True)
    lines = [r.line for r in RP.layer_graph_lines(G.layer_edges(G.raw_edges(lf), lc.frameworks)).orderBy("p").collect()]
    assert lines == ["~~~mermaid", "graph LR", '  L_Http["Http"]', '  L_Services["Services"]', '  L_Models["Models"]',
                     "  L_Http --> L_Services", "  L_Services --> L_Models", "~~~"]
