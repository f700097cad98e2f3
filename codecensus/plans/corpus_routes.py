"""Corpus R: route files derived from ``events``.

repo_id = 'u' || user_id; framework = event_id % 11; one file per
(user, framework, event_id div 500) (Next.js: one file per event).  Each
event declares one route: verb = event_id % 5, path = /{event_type}/{event_id},
handler h{event_id}; every 7th event is disturbed by a line that cancels the
pending decorator where the framework cancels (or is commented out).
The oracle states the expected rows from ``events`` directly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt
from .tables import table

CHUNK = 500
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
FW = ["laravel", "express", "fastapi", "flask", "django", "go", "openapi_json", "openapi_yaml", "nextjs", "aspnet", "spring"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _of(event_id: Column) -> dict[str, Column]:
    """What follows from an event's number."""
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (event_id % 5 + 1).cast("int"))
    return {"id": _s(event_id), "verb": verb, "vl": F.lower(verb), "vc": F.initcap(verb), "cancel": event_id % 7 == 0,
            "alt": event_id % 3 == 1, "noise": event_id % 7 == 3}


def _events(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    if where is not None:
        e = e.filter(where)
    return e.select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("repo_id"),
        (F.col("event_id") % 11).cast("int").alias("fw"), F.expr(f"event_id div {CHUNK}").alias("chunk"), "event_id", "event_type")


def _c(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _snippet(fw: int, x) -> Column:
    """Text for one event (x is the row struct); may span several lines."""
    p = _c("/", x.event_type, "/", x.id)
    if fw == 0:
        line = F.when(x.alt, _c("Route::", x.verb, "('", x.event_type, "/", x.id, "', 'H", x.id, "Controller@h", x.id, "');")) \
            .otherwise(_c("Route::", x.vl, "('", p, "', [App\\Http\\Controllers\\H", x.id, "Controller::class, 'h", x.id, "']);"))
        return F.when(x.cancel, _c("// ", line)).otherwise(line)
    if fw == 1:
        line = F.when(x.alt, _c("router.route('", p, "').", x.vl, "(h", x.id, ");")) \
            .otherwise(_c("router.", x.vl, "('", p, "', h", x.id, ");"))
        return F.when(x.cancel, _c("// ", line)).otherwise(line)
    if fw == 2:
        return _c("@router.", x.vl, "(\"", p, "\")\n", F.when(x.cancel, F.lit("@requires_auth\n")).otherwise(F.lit("")),
                  "async def h", x.id, "():\n    return {}\n")
    if fw == 3:
        deco = F.when(x.event_id % 2 == 1, _c("@bp.route(\"", p, "\", methods=[\"", x.verb, "\"])")) \
            .otherwise(_c("@bp.", x.vl, "(\"", p, "\")"))
        mid = F.when(x.cancel, F.lit("@login_required\n")).when(x.noise, F.lit("@unknown.route(\"/zzz\")\n")).otherwise(F.lit(""))
        return _c(deco, "\n", mid, "def h", x.id, "():\n    return 'ok'\n")
    if fw == 4:
        return F.when(x.cancel, _c("    path(\"", x.event_type, "/", x.id, "/\", include(\"x.urls\")),")) \
            .when(x.alt, _c("    path(\"", x.event_type, "/", x.id, "/\", views.H", x.id, "View.as_view()),")) \
            .otherwise(_c("    path(\"", x.event_type, "/", x.id, "/\", views.h", x.id, ", name=\"h", x.id, "\"),"))
    if fw == 5:
        line = _c("\t", F.when(x.alt, F.lit("r")).otherwise(F.lit("v1")), ".", x.verb, "(\"", p, "\", h", x.id, ")")
        return F.when(x.cancel, _c("\t// ", line)).otherwise(line)
    if fw == 6:
        path = F.when(x.alt, _c(p, "/{item}")).otherwise(p)
        op = F.when(x.cancel, F.lit("{\"responses\": {}}")).otherwise(_c("{\"operationId\": \"h", x.id, "\"}"))
        return _c("    \"", path, "\": {\"parameters\": [], \"", x.vl, "\": ", op, "}")
    if fw == 7:
        return _c("  ", p, ":\n    ", x.vl, ":\n", F.when(x.cancel, F.lit("")).otherwise(_c("      operationId: h", x.id, "\n")),
                  "      responses: {}")
    if fw == 9:
        attr = _c("    [Http", x.vc, "(\"", x.event_type, "/", x.id, "\")]\n", F.when(x.cancel, F.lit("    [Authorize]\n")).otherwise(F.lit("")),
                  "    public IActionResult H", x.id, "() => Ok();")
        return F.when(x.alt, _c("    app.Map", x.vc, "(\"", p, "\", H", x.id, ");")).otherwise(attr)
    if fw == 10:
        ann = F.when(x.alt, _c("    @RequestMapping(value = \"", p, "\", method = RequestMethod.", x.verb, ")")) \
            .otherwise(_c("    @", x.vc, "Mapping(\"", p, "\")"))
        return _c(ann, "\n", F.when(x.cancel, F.lit("    @Deprecated\n")).otherwise(F.lit("")),
                  "    public String h", x.id, "() { return \"\"; }")
    raise ValueError(fw)


def _snippet_fn(fw: int):
    def fn(x):
        return _snippet(fw, x)
    return fn


# (file name, header, footer) per framework; "{u}" is replaced by the user id.
LAYOUT = {
    0: ("routes/api.php", "<?php\n\nuse Illuminate\\Support\\Facades\\Route;\n\n", "\n"),
    1: ("server.js", "const router = require('express').Router();\n\n", "\nmodule.exports = router;\n"),
    2: ("api.py", "from fastapi import APIRouter\n\nrouter = APIRouter(prefix=\"/u{u}\")\n\n", "\n"),
    3: ("views.py", "from flask import Blueprint\n\nbp = Blueprint(\"b\", __name__, url_prefix=\"/u{u}\")\n\n", "\n"),
    4: ("urls.py", "from django.urls import include, path\nfrom . import views\n\nurlpatterns = [\n", "\n]\n"),
    5: ("main.go", "package main\n\nimport \"github.com/gin-gonic/gin\"\n\nfunc main() {\n\tr := gin.Default()\n\tapi := r.Group(\"/u{u}\")\n\tv1 := api.Group(\"/v1\")\n", "\n\tr.Run()\n}\n"),
    6: ("openapi.json", "{\n  \"openapi\": \"3.0.0\",\n  \"info\": {\"title\": \"t\"},\n  \"paths\": {\n", "\n  }\n}\n"),
    7: ("openapi.yaml", "openapi: 3.0.0\ninfo:\n  title: t\npaths:\n", "\ncomponents:\n  schemas: {}\n"),
    9: ("Controllers/OrdersController.cs", "using Microsoft.AspNetCore.Mvc;\n\n[ApiController]\n[Route(\"u{u}/[controller]\")]\npublic class OrdersController : ControllerBase\n{\n", "\n}\n"),
    10: ("src/main/java/demo/UController.java", "package demo;\n\n@RestController\n@RequestMapping(\"/u{u}\")\npublic class UController {\n", "\n}\n"),
}
SEPARATOR = {6: ",\n"}


#: Events that one task turns into files and parses.
TASK_EVENTS = 10_000


def route_corpus(spark: SparkSession, sf_dir: str, where: str | None = None, snapshot_id: str = "s1") -> DataFrame:
    """Corpus R as a ``files`` table of the events that ``where`` (SQL) keeps.

    One branch per framework, with its file's name as a literal: a parser's filter on names leaves only the branches it reads. A
    branch deals events by file to as many tasks as the counted ones need and builds the texts behind that exchange, so what a
    parser groups by file needs no further one.
    """
    ev = _events(spark, sf_dir, where)
    # as many for every framework: a union of branches dealt alike needs no exchange either
    n = max([r["count"] for r in ev.groupBy("fw").count().collect()], default=0)
    user = F.substring(F.col("repo_id"), 2, 1 << 20)

    def files(df: DataFrame, base: Column, ext: Column) -> DataFrame:
        return df.select("repo_id", F.lit(snapshot_id).alias("snapshot_id"), F.col("repo_id").alias("project_name"), "rel_path",
                         F.concat(F.lit("/"), F.col("repo_id"), F.lit("/"), F.col("rel_path")).alias("abs_path"), base.alias("base"),
                         ext.alias("ext"), F.octet_length("content").cast("bigint").alias("n_bytes"), "content")

    parts = []
    for fw, (fname, head, foot) in LAYOUT.items():
        rel = F.concat(F.lit("c"), _s(F.col("chunk")), F.lit("/" + fname))
        rows = ev.filter(F.col("fw") == fw).select("repo_id", rel.alias("rel_path"), "event_id", "event_type")
        rows = dealt(rows, n, "repo_id", "rel_path", each=TASK_EVENTS)
        grouped = rows.groupBy("repo_id", "rel_path").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("k"))
        grouped = grouped.select("repo_id", "rel_path", F.transform("k", lambda x: F.struct(
            x.event_id.alias("event_id"), x.event_type.alias("event_type"), *[v.alias(c) for c, v in _of(x.event_id).items()])).alias("r"))
        body = F.array_join(F.transform("r", _snippet_fn(fw)), SEPARATOR.get(fw, "\n"))
        text = F.concat(F.replace(F.lit(head), F.lit("{u}"), user), body, F.lit(foot))
        base = fname.split("/")[-1]
        parts.append(files(grouped.select("repo_id", "rel_path", text.alias("content")), F.lit(base), F.lit("." + base.split(".")[-1])))
    even = F.col("event_id") % 2 == 0
    nx = ev.filter(F.col("fw") == 8).withColumns({c: v for c, v in _of(F.col("event_id")).items() if c in ("id", "verb")}).select(
        "repo_id",
        F.when(even, _c("web/pages/api/", F.col("event_type"), "/", F.col("id"), ".ts"))
        .otherwise(_c("web/app/api/", F.col("event_type"), "/[id", F.col("id"), "]/route.ts")).alias("rel_path"),
        F.when(even, F.lit("export default function handler(req, res) {}\n"))
        .otherwise(_c("export async function ", F.col("verb"), "(req) {\n  return Response.json({})\n}\n")).alias("content"))
    # an event without a type has a file without a path
    null = F.lit(None).cast("string")
    parts.append(files(nx.filter(F.col("rel_path").isNotNull()), F.element_at(F.split("rel_path", "/"), -1), F.lit(".ts")))
    parts.append(files(nx.filter(F.col("rel_path").isNull()).withColumn("rel_path", null), null, null))
    return reduce(DataFrame.unionByName, parts)


# ---- oracle: expected routes per parser, straight from events ---------------------------
def oracle_events(where: str = "TRUE", name: str = "ev") -> str:
    return ORACLE_EVENTS.replace("ev AS (", f"{name} AS (").replace("FROM events)", f"FROM events WHERE {where})")


ORACLE_EVENTS = """
ev AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS repo_id, user_id, event_id, CAST(event_id AS VARCHAR) AS id, event_type,
         event_id % 11 AS fw, event_id % 7 = 0 AS cancel, event_id % 3 = 1 AS alt, event_id % 7 = 3 AS noise,
         ['GET','POST','PUT','PATCH','DELETE'][event_id % 5 + 1] AS verb,
         '/' || event_type || '/' || CAST(event_id AS VARCHAR) AS p
  FROM events)"""

ORACLE_BY_PARSER = {
    "laravel": "SELECT repo_id, verb AS method, p AS path, 'H' || id || 'Controller@h' || id AS controller FROM ev WHERE fw = 0 AND NOT cancel",
    "express": "SELECT repo_id, verb AS method, p AS path, CASE WHEN alt THEN 'handler' ELSE 'h' || id END AS controller FROM ev WHERE fw = 1 AND NOT cancel",
    "fastapi": """SELECT repo_id, verb AS method, '/u' || CAST(user_id AS VARCHAR) || p AS path, 'h' || id AS controller FROM ev WHERE fw = 2 AND NOT cancel
                  UNION ALL
                  SELECT repo_id, verb AS method, p AS path, 'h' || id AS controller FROM ev WHERE fw = 3 AND event_id % 2 = 0 AND NOT cancel AND NOT noise""",
    "flask": "SELECT repo_id, verb AS method, '/u' || CAST(user_id AS VARCHAR) || p AS path, 'h' || id AS controller FROM ev WHERE fw = 3 AND NOT cancel",
    "django": "SELECT repo_id, 'ANY' AS method, p || '/' AS path, CASE WHEN alt THEN 'views.H' || id || 'View@as_view' ELSE 'views.h' || id END AS controller FROM ev WHERE fw = 4 AND NOT cancel",
    "go": "SELECT repo_id, verb AS method, CASE WHEN alt THEN p ELSE '/u' || CAST(user_id AS VARCHAR) || '/v1' || p END AS path, 'h' || id AS controller FROM ev WHERE fw = 5 AND NOT cancel",
    "openapi_json": "SELECT repo_id, verb AS method, CASE WHEN alt THEN p || '/:item' ELSE p END AS path, CASE WHEN cancel THEN 'openapi' ELSE 'h' || id END AS controller FROM ev WHERE fw = 6",
    "openapi_yaml": "SELECT repo_id, verb AS method, p AS path, CASE WHEN cancel THEN 'openapi' ELSE 'h' || id END AS controller FROM ev WHERE fw = 7",
    "nextjs": """SELECT repo_id, CASE WHEN event_id % 2 = 0 THEN 'ANY' ELSE verb END AS method,
                   CASE WHEN event_id % 2 = 0 THEN '/api' || p ELSE '/api/' || event_type || '/:id' || id END AS path,
                   CASE WHEN event_id % 2 = 0 THEN id || '.ts' ELSE 'route.ts' END AS controller FROM ev WHERE fw = 8""",
    "aspnet": """SELECT repo_id, verb AS method, CASE WHEN alt THEN p ELSE '/u' || CAST(user_id AS VARCHAR) || '/Orders' || p END AS path,
                   'H' || id AS controller FROM ev WHERE fw = 9 AND (alt OR NOT cancel)""",
    "spring": "SELECT repo_id, verb AS method, '/u' || CAST(user_id AS VARCHAR) || p AS path, 'UController#h' || id AS controller FROM ev WHERE fw = 10",
}
