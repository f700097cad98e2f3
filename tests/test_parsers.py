"""Unit fixtures for every parser, one repository per case, parsed in a single Spark job per family."""

import pytest

from codecensus.functions import paths as P
from codecensus.operators import infra as I
from codecensus.operators import manifests as M
from codecensus.operators import routes as R
from codecensus.operators import snapshot as SN
from codecensus.operators import structure as S
from codecensus.sources.files import files_from_frame

CASES = {
    "laravel": [("routes/api.php", "<?php\nuse Illuminate\\Support\\Facades\\Route;\n"
                 "Route::get('/api/orders', [App\\Http\\Controllers\\OrderController::class, 'index']);\n"
                 "Route::POST('api/orders', 'OrderController@store');\n// Route::get('/old', 'Old@x');\n")],
    "express": [("src/server.js", "const app = express();\napp.get('/health', healthHandler);\n"
                 "router.post('/api/orders', ordersController.create);\nrouter.route('/api/users').delete(removeUser);\n"
                 "app.get('setting');\n")],
    "fastapi": [("app/main.py", 'from fastapi import FastAPI, APIRouter\napp = FastAPI()\nrouter = APIRouter(prefix="/api")\n\n'
                 '@app.get("/health")\ndef health():\n    return {}\n\n@router.post("/orders")\nasync def create_order():\n    return {}\n\n'
                 '@router.get("/cancelled")\n@requires_auth\ndef nope():\n    pass\n')],
    "flask": [("app.py", 'from flask import Flask, Blueprint\napp = Flask(__name__)\nbp = Blueprint("api", __name__, url_prefix="/api")\n\n'
               '@app.get("/health")\ndef health():\n    return "ok"\n\n@bp.route("/orders", methods=["POST", \'put\'])\n'
               '@other.route("/ignored")\ndef orders():\n    return "ok"\n')],
    "django": [("shop/urls.py", 'from django.urls import include, path\nfrom . import views\nurlpatterns = [\n'
                '    path("health/", views.health),\n    path("orders/", views.OrderView.as_view()),\n    path("api/", include("api.urls")),\n]\n')],
    "goweb": [("cmd/api/main.go", 'package main\n\nfunc main() {\n\tr := gin.Default()\n\tapi := r.Group("/api")\n'
               '\tapi.GET("/orders", listOrders)\n\te := echo.New()\n\tv1 := e.Group("/v1")\n\tadmin := v1.Group("/admin")\n'
               '\tv1.POST("/payments", createPayment)\n\tadmin.DELETE("/users/:id", dropUser)\n\tx.GET("/unknown", h)\n}\n')],
    "openapi_yaml": [("openapi.yaml", "openapi: 3.0.0\ninfo:\n  title: t\npaths:\n  /health:\n    get:\n      operationId: getHealth\n"
                      "  /orders/{id}:\n    patch:\n      operationId: 'updateOrder'\n    delete:\n      responses: {}\n"
                      "components:\n  schemas: {}\n")],
    "openapi_json": [("api/openapi.json", '{"openapi": "3.1.0", "paths": {"/items/{id}": {"parameters": [], "get": {"operationId": "getItem"},'
                      ' "post": null, "x-extra": {}}}}')],
    "nextjs": [("pages/api/users.ts", "export default function handler(req, res) {}\n"),
               ("app/api/orders/[id]/route.ts", "export async function GET() {}\nexport function DELETE() {}\n"),
               ("app/api/files/[...slug]/route.js", "export const dynamic = 1\n")],
    "aspnet": [("Program.cs", 'var app = builder.Build();\napp.MapGet("/health", () => "ok");\n'
                'app.MapMethods("/ping", new[] { "GET", "HEAD" }, Ping);\n'),
               ("Controllers/OrdersController.cs", '[ApiController]\n[Route("api/[controller]")]\npublic class OrdersController : ControllerBase\n{\n'
                '    [HttpPost]\n    public IActionResult Create(Order o) => Ok();\n    [HttpGet("{id}")]\n    [Authorize]\n'
                '    public IActionResult Get(int id) => Ok();\n}\n'),
               ("Api.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web">\n  <ItemGroup>\n'
                '    <PackageReference Include="Swashbuckle.AspNetCore" Version="6.5.0" />\n  </ItemGroup>\n</Project>\n')],
    "spring": [("src/main/java/demo/OrderController.java", '@RestController\n@RequestMapping("/api/orders")\npublic class OrderController {\n'
                '    @GetMapping("/{id}")\n    @ResponseBody\n    public Order get(@PathVariable long id) { return null; }\n'
                '    @PostMapping\n    public Order create(@RequestBody Order o) { return o; }\n'
                '    @RequestMapping(value = "/bulk", method = {RequestMethod.PUT, RequestMethod.PATCH})\n'
                '    public void bulk() {}\n}\n'),
               ("src/test/java/demo/OrderControllerTest.java", '@GetMapping("/x")\npublic void t() {}\n'),
               ("src/main/java/demo/DemoApplication.java", "public class DemoApplication {}\n")],
    "pip": [("requirements.txt", "-r base.txt\n--index-url https://pypi.example/simple\n# comment\n\n"
             "Django>=4.2  # web framework\nfastapi==0.110\nuvicorn[standard]==0.30\n-e git+https://g.example/x.git#egg=local\n"
             "git+https://g.example/y.git#egg=Extra\nname-with-hash==1 # 'quoted' \n")],
    "pyproject": [("pyproject.toml", '[project]\nname = "demo"\ndependencies = [\n  "fastapi>=0.110",  # api\n  "pydantic",\n]\n\n'
                   '[tool.poetry.dependencies]\npython = "^3.11"\nrequests = "^2.31"\n')],
    "pom": [("pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>'
             '<dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-web</artifactId><version>3.2.0</version></dependency>'
             '<dependency><groupId>com.acme</groupId><artifactId>lib</artifactId></dependency>'
             '<dependency><groupId></groupId><artifactId>blank</artifactId></dependency></dependencies></project>')],
    "gradle": [("build.gradle", "dependencies {\n    implementation 'com.google.guava:guava:33.0.0-jre'\n"
                "    testImplementation(\"org.junit.jupiter:junit-jupiter:5.10.0\")\n"
                "    api group: 'org.slf4j', name: 'slf4j-api', version: '2.0.9'\n    // implementation 'x:y:1'\n}\n")],
    "cargo": [("Cargo.toml", '[package]\nname = "x"\n\n[dependencies]\nserde = { version = "1", features = ["derive"] }\n'
               'tokio = "1.35"\n\n[dev-dependencies]\nproptest = "1"\n')],
    "npm": [("package.json", '{"dependencies": {"react": "18.0.0", "left-pad": "1.0.0", "react": "18.2.0"},'
             ' "devDependencies": {"left-pad": "1.3.0"}}'),
            ("bad/package.json", '{"dependencies": {"a": 2}}')],
    "composer": [("composer.json", '{"require": {"php": "^8.2", "ext-json": "*", "laravel/framework": "^11.0"}}')],
    "gomod": [("go.mod", "module example.com/x\n\ngo 1.22\n\nrequire (\n\tgithub.com/labstack/echo/v4 v4.11.0\n"
               "\tgolang.org/x/net v0.20.0 // indirect\n\t// comment\n)\n\nrequire github.com/gin-gonic/gin v1.9.1\n")],
    "infra": [("docker-compose.yml", "version: '3'\nservices:\n  db:\n    image: postgres:16\n  cache:\n    image: \"redis:7\"\n"
               "  queue:\n    image: rabbitmq:3-management\n    environment:\n      - image: mysql\nvolumes:\n  data: {}\n"),
              ("k8s/deployment.yaml", "apiVersion: apps/v1\nkind: Deployment\nspec:\n  containers:\n    - name: mongo\n      image: nginx:1\n"),
              (".env.production", "export REDIS_URL=redis://cache:6379\nKAFKA_BROKERS='b1'\n"),
              ("infra/main.tf", 'provider "aws" {}\nresource "aws_elasticache_cluster" "c" {}\n# resource "aws_mq_broker"\n')],
    "longline": [("go.mod", "module m\nrequire a v1\n// " + "x" * 70000 + "\n"), ("gradle/build.gradle", "implementation 'g:a:1'\n// " + "y" * 70000 + "\n")],
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(repo, "s1", repo, path, content) for repo, fs in CASES.items() for path, content in fs]
    df = spark.createDataFrame(rows, "repo_id string, snapshot_id string, project_name string, rel_path string, content string")
    return files_from_frame(df)


@pytest.fixture(scope="module")
def routes(corpus):
    rows = R.raw_routes(corpus).collect()
    out = {}
    for r in rows:
        out.setdefault(r.repo_id, set()).add((r.framework, r.method, r.path, r.controller))
    return out


@pytest.fixture(scope="module")
def deps(corpus):
    out = {}
    for r in M.dependencies(corpus).collect():
        out.setdefault(r.repo_id, set()).add((r.manager, r.name, r.version))
    return out


def _routes(routes, repo, fw=None):
    return {(m, p, c) for f, m, p, c in routes.get(repo, set()) if fw is None or f == fw}


def test_laravel(routes):
    assert _routes(routes, "laravel") == {("GET", "/api/orders", "OrderController@index"), ("POST", "/api/orders", "OrderController@store")}


def test_express(routes):
    assert _routes(routes, "express") == {("GET", "/health", "healthHandler"), ("POST", "/api/orders", "ordersController.create"),
                                          ("DELETE", "/api/users", "handler"), ("GET", "/setting", "handler")}


def test_fastapi(routes):
    assert _routes(routes, "fastapi", "fastapi") == {("GET", "/health", "health"), ("POST", "/api/orders", "create_order")}


def test_flask(routes):
    assert _routes(routes, "flask", "flask") == {("GET", "/health", "health"), ("POST", "/api/orders", "orders"), ("PUT", "/api/orders", "orders")}
    # the Flask `@app.get` is also a FastAPI-style decorator
    assert ("GET", "/health", "health") in _routes(routes, "flask", "fastapi")


def test_django(routes):
    assert _routes(routes, "django") == {("ANY", "/health/", "views.health"), ("ANY", "/orders/", "views.OrderView@as_view")}


def test_gin_echo(routes):
    assert _routes(routes, "goweb") == {("GET", "/api/orders", "listOrders"), ("POST", "/v1/payments", "createPayment"),
                                        ("DELETE", "/v1/admin/users/:id", "dropUser")}


def test_openapi(routes):
    assert _routes(routes, "openapi_yaml") == {("GET", "/health", "getHealth"), ("PATCH", "/orders/:id", "updateOrder"),
                                               ("DELETE", "/orders/:id", "openapi")}
    assert _routes(routes, "openapi_json") == {("GET", "/items/:id", "getItem"), ("POST", "/items/:id", "openapi")}


def test_nextjs(routes):
    assert _routes(routes, "nextjs") == {("ANY", "/api/users", "users.ts"), ("GET", "/api/orders/:id", "route.ts"),
                                         ("DELETE", "/api/orders/:id", "route.ts"), ("ANY", "/api/files/:slug*", "route.js")}


def test_aspnet(routes):
    assert _routes(routes, "aspnet") == {("GET", "/health", "handler"), ("GET", "/ping", "Ping"), ("HEAD", "/ping", "Ping"),
                                         ("POST", "/api/Orders", "Create")}


def test_spring(routes):
    assert _routes(routes, "spring") == {("GET", "/api/orders/{id}", "OrderController#get"), ("POST", "/api/orders", "OrderController#create"),
                                         ("PATCH", "/api/orders/bulk", "OrderController#bulk"), ("PUT", "/api/orders/bulk", "OrderController#bulk")}


def test_manifests(deps):
    assert deps["pip"] == {("pip", "django", ">=4.2"), ("pip", "fastapi", "==0.110"), ("pip", "uvicorn", "[standard]==0.30"),
                           ("pip", "extra", ""), ("pip", "name-with-hash", "==1")}
    assert deps["pyproject"] == {("pip", "fastapi", ">=0.110"), ("pip", "pydantic", ""), ("poetry", "requests", "^2.31")}
    assert deps["pom"] == {("maven", "org.springframework.boot:spring-boot-starter-web", "3.2.0"), ("maven", "com.acme:lib", "")}
    assert deps["gradle"] == {("gradle", "com.google.guava:guava", "33.0.0-jre"), ("gradle", "org.junit.jupiter:junit-jupiter", "5.10.0"),
                              ("gradle", "org.slf4j:slf4j-api", "2.0.9")}
    assert deps["cargo"] == {("cargo", "serde", '{ version = "1", features = ["derive"] }'), ("cargo", "tokio", "1.35")}
    assert deps["npm"] == {("npm", "react", "18.2.0"), ("npm", "left-pad", "1.3.0")}
    assert deps["composer"] == {("composer", "php", "^8.2"), ("composer", "ext-json", "*"), ("composer", "laravel/framework", "^11.0")}
    assert deps["gomod"] == {("go", "github.com/labstack/echo/v4", "v4.11.0"), ("go", "golang.org/x/net", "v0.20.0"),
                             ("go", "github.com/gin-gonic/gin", "v1.9.1")}
    assert deps["aspnet"] == {("nuget", "Swashbuckle.AspNetCore", "6.5.0")}
    # no line is too long to be parsed
    assert deps["longline"] == {("go", "a", "v1"), ("gradle", "g:a", "1")}


def test_frameworks_and_infra(corpus):
    c = SN.census(corpus)
    fw = {}
    for r in c.frameworks.collect():
        fw.setdefault(r.repo_id, set()).add(r.framework)
    assert fw["goweb"] == {"gin", "echo"}
    assert fw["aspnet"] == {"asp.net"}
    assert fw["spring"] == {"spring"}
    assert fw["gomod"] == {"gin", "echo"}
    assert fw["pom"] == {"spring"}
    assert fw["composer"] == {"laravel"}
    assert {"openapi"} == fw["openapi_yaml"] == fw["openapi_json"]
    assert fw["nextjs"] == {"next.js"}
    infra = {r.service for r in c.infrastructure.collect() if r.repo_id == "infra"}
    # "- name: mongo" is not a line that starts with "name:", so it names nothing
    assert infra == {"docker", "postgres", "redis", "rabbitmq", "kubernetes", "nginx", "env-file", "kafka", "terraform"}


def test_structure_quirks(spark, files):
    f = files([("src/Latest.java", "x"), ("contest.php", "x"), ("ui/a.test.jsx", "x"), ("tests/x.py", "x"),
               ("a/tests/y.py", "x"), ("node_modules/p/index.js", "x"), (".git/config", "x"), (".env", "A=1"),
               ("routes/web.php", "x"), ("app/routes/web.php", "x")])
    facts = {r.rel_path: r for r in S.file_facts(f).collect()}
    assert facts["src/Latest.java"].is_test and facts["contest.php"].is_test
    assert not facts["ui/a.test.jsx"].is_test and not facts["tests/x.py"].is_test and facts["a/tests/y.py"].is_test
    assert "node_modules/p/index.js" not in facts and ".git/config" not in facts and ".env" in facts
    assert facts["routes/web.php"].is_entry and not facts["app/routes/web.php"].is_entry


def test_scalars(spark):
    from pyspark.sql import functions as F
    from codecensus.functions import text as T
    df = spark.createDataFrame([("", "/x", "api/", "a # b", "'a # b' # c", "x\\#y # z")], "a string, b string, c string, d string, e string, g string")
    r = df.select(T.normalize_route_path("a").alias("n1"), T.join_route_paths("c", "b").alias("j1"),
                  T.join_route_paths(F.lit("/v1/"), F.lit("/")).alias("j2"), T.route_group_prefix(F.lit("//api/x")).alias("g"),
                  T.strip_inline_comment("d").alias("s1"), T.strip_inline_comment("e").alias("s2"), T.strip_inline_comment("g").alias("s3"),
                  T.normalize_openapi_path(F.lit("a/{id}")).alias("o"),
                  T.normalize_next_segments(F.lit("/api/[id]/[...rest]/[[...all]]")).alias("nx")).collect()[0]
    assert (r.n1, r.j1, r.j2, r.g) == ("/", "/api/x", "/v1/", "/api")
    assert (r.s1, r.s2, r.s3) == ("a", "'a # b'", "x\\#y")
    assert r.o == "/a/:id" and r.nx == "/api/:id/:rest*/:all*"
