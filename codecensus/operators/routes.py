"""HTTP route extraction.

Output of every parser: ``(repo_id, snapshot_id, rel_path, framework, method, path, controller)``; a row without a method
says that the file uses the framework, whether or not it declares a route (A7), so routes and usage come from one scan.
Line parsers with "pending" state keep only the lines that can change the
state (event lines) and read the previous event with ``lag`` over a window
keyed by file; as-of lookups (J4) are ``last(..., ignorenulls)`` over the same
file-keyed window, so one exchange on the file key serves all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import patterns as X
from ..functions import paths as P
from ..functions.text import (drop_suffix, join_attribute_paths, join_route_paths, normalize_next_segments,
                              normalize_openapi_path, normalize_route_path, quoted_tokens, route_group_prefix,
                              short_class_name, spring_controller_name, trim_space)
from ..sources.files import FILE_KEY, SNAP_KEY
from ..sources.lines import explode_lines, nonblank

ROUTE_COLS = [*FILE_KEY, "framework", "method", "path", "controller"]


def _w(*extra):
    return Window.partitionBy(*FILE_KEY, *extra).orderBy("line_no")


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _rx(c, pattern, idx=1) -> Column:
    return F.regexp_extract(c, pattern, idx)


def _has(c, pattern) -> Column:
    return F.col(c).rlike(pattern) if isinstance(c, str) else c.rlike(pattern)


def _by_file(events: DataFrame) -> DataFrame:
    """Events dealt by file, once for all windows and groupings whose keys begin with the file.

    A window by file alone comes first: files that are dealt by file already need no exchange for it, others get one.
    """
    return events.withColumn("_at", F.row_number().over(_w())).filter("_at > 0").drop("_at")


ROUTE_T = "struct<framework:string,method:string,path:string,controller:string>"


def _route(framework: str, method: Column, path: Column, controller: Column) -> Column:
    return F.struct(F.lit(framework).alias("framework"), method.alias("method"), path.alias("path"), controller.alias("controller"))


def _usage(framework: str | Column) -> Column:
    fw = F.lit(framework) if isinstance(framework, str) else framework
    null = F.lit(None).cast("string")
    return F.struct(fw.alias("framework"), null.alias("method"), null.alias("path"), null.alias("controller"))


def _rows(df: DataFrame, routes: Column) -> DataFrame:
    """A row per element of an array of routes."""
    return df.select(*FILE_KEY, F.explode(routes).alias("_x")).select(*FILE_KEY, "_x.framework", "_x.method", "_x.path", "_x.controller")


def _out(df: DataFrame, framework: str | Column, method, path, controller) -> DataFrame:
    fw = F.lit(framework) if isinstance(framework, str) else framework
    return df.select(*FILE_KEY, fw.alias("framework"), method.alias("method"), path.alias("path"),
                     controller.alias("controller"))


def _scan(files: DataFrame, cond: Column, comments=()) -> DataFrame:
    """Lines of the selected files; blank and comment lines dropped."""
    return nonblank(explode_lines(files.filter(cond)), comments)


def _split_lines(files: DataFrame, cond: Column, comments=()) -> DataFrame:
    """Whole-text input split on newlines."""
    return nonblank(explode_lines(files.filter(cond)), comments)


# ---------------------------------------------------------------- R1 Laravel


def parse_laravel(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_laravel_routes_file(), ("//", "#")).filter(F.col("line").contains("Route::"))
    line = F.col("line")
    cls = _has(line, X.LARAVEL_CLASS)
    strg = _has(line, X.LARAVEL_STRING)
    d = ln.filter(cls | strg)
    method = F.upper(F.when(cls, _rx(line, X.LARAVEL_CLASS, 1)).otherwise(_rx(line, X.LARAVEL_STRING, 1)))
    path = normalize_route_path(F.when(cls, _rx(line, X.LARAVEL_CLASS, 2)).otherwise(_rx(line, X.LARAVEL_STRING, 2)))
    ctrl = F.when(cls, F.concat(short_class_name(_rx(line, X.LARAVEL_CLASS, 3)), F.lit("@"), _rx(line, X.LARAVEL_CLASS, 4))) \
        .otherwise(_rx(line, X.LARAVEL_STRING, 3))
    return _out(d, "laravel", method, path, ctrl)


# ---------------------------------------------------------------- R2 Express


def parse_express(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_express_file(), ("//",))
    line = F.col("line")
    h = _rx(line, X.EXPRESS_ROUTE, 3)
    direct = _route("express", F.upper(_rx(line, X.EXPRESS_ROUTE, 1)), normalize_route_path(_rx(line, X.EXPRESS_ROUTE, 2)),
                    F.when(h != "", h).otherwise(F.lit("handler")))
    chain = _route("express", F.upper(_rx(line, X.EXPRESS_CHAIN, 2)), normalize_route_path(_rx(line, X.EXPRESS_CHAIN, 1)), F.lit("handler"))
    found = F.array(F.when(_has(line, X.EXPRESS_ROUTE), direct), F.when(_has(line, X.EXPRESS_CHAIN), chain))
    return _rows(ln, F.filter(found, lambda x: x.isNotNull()))


# ---------------------------------------------------------------- R3 FastAPI


def _decl_prefix(line: Column, decl_rx: str, prefix_rx: str) -> Column:
    """Normalised prefix of a declaration ('' when the declaration has none)."""
    p = _rx(_rx(line, decl_rx, 2), prefix_rx, 1)
    return F.when(p != "", normalize_route_path(p)).otherwise(F.lit(""))


def _with_prefix(events: DataFrame, routes: Column) -> DataFrame:
    """The route rows of (var, line_no, decl_prefix) events, with the prefix of var's latest declaration before them.

    Declarations are the rows with a ``decl_prefix``; rows that are neither fall away.
    """
    w = Window.partitionBy(*FILE_KEY, "var").orderBy("line_no")
    e = events.withColumn("_is_route", routes).filter(F.col("_is_route") | F.col("decl_prefix").isNotNull())
    return e.withColumn("prefix", F.last("decl_prefix", ignorenulls=True).over(w)).filter("_is_route").drop("_is_route")


def _prefixed(prefix: str, path: str) -> Column:
    return F.when(F.coalesce(F.col(prefix), F.lit("")) != "", join_route_paths(prefix, path)).otherwise(F.col(path))


def parse_fastapi(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_python_routes_file(), ("#",))
    line = F.col("line")
    deco, is_def, router = _has(line, X.FASTAPI_DECO), _has(line, X.PY_DEF), _has(line, X.FASTAPI_ROUTER)
    ev = ln.filter(deco | is_def | router | line.startswith("@")).select(
        *FILE_KEY, "line_no", router.alias("is_decl"),
        F.when(deco, "deco").when(is_def, "def").otherwise("cancel").alias("kind"),
        F.when(router, _rx(line, X.FASTAPI_ROUTER, 1)).otherwise(_rx(line, X.FASTAPI_DECO, 1)).alias("recv"),
        F.when(router, _decl_prefix(line, X.FASTAPI_ROUTER, X.FASTAPI_PREFIX)).alias("decl_prefix"),
        F.upper(_rx(line, X.FASTAPI_DECO, 2)).alias("verb"), normalize_route_path(_rx(line, X.FASTAPI_DECO, 3)).alias("rpath"),
        _rx(line, X.PY_DEF, 1).alias("fn"))
    # declarations don't come between a decorator and its function
    w = _w("is_decl")
    ev = _by_file(ev).select("*", *[F.lag(c).over(w).alias("p_" + c) for c in ("kind", "recv", "verb", "rpath")])
    hit = ~F.col("is_decl") & (F.col("kind") == "def") & F.coalesce(F.col("p_kind") == "deco", F.lit(False))
    ev = ev.withColumn("var", F.when(F.col("is_decl"), F.col("recv")).otherwise(F.col("p_recv")))
    r = _with_prefix(ev, hit)
    return _out(r, "fastapi", F.col("p_verb"), _prefixed("prefix", "p_rpath"), F.col("fn"))


# ---------------------------------------------------------------- R4 Flask


def flask_methods(value: Column) -> Column:
    """Quoted alphabetic tokens, upper-cased."""
    return F.transform(F.regexp_extract_all(value, F.lit(X.METHOD_TOKEN), F.lit(1)), lambda t: F.upper(trim_space(t)))


def parse_flask(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_python_routes_file(), ("#",))
    line = F.col("line")
    app_decl, bp_decl = _has(line, X.FLASK_APP), _has(line, X.FLASK_BP)
    is_route, is_verb = _has(line, X.FLASK_ROUTE), _has(line, X.FLASK_VERB)
    is_def = _has(line, X.PY_DEF)
    var = F.when(app_decl, _rx(line, X.FLASK_APP, 1)).when(bp_decl, _rx(line, X.FLASK_BP, 1)) \
        .when(is_route, _rx(line, X.FLASK_ROUTE, 1)).when(is_verb, _rx(line, X.FLASK_VERB, 1))
    methods = F.when(is_route, F.when(F.size(flask_methods(_rx(line, X.FLASK_ROUTE, 3))) > 0, flask_methods(_rx(line, X.FLASK_ROUTE, 3)))
                     .otherwise(F.array(F.lit("ANY")))).when(is_verb, F.array(F.upper(_rx(line, X.FLASK_VERB, 2))))
    rpath = F.when(is_route, _rx(line, X.FLASK_ROUTE, 2)).when(is_verb, _rx(line, X.FLASK_VERB, 3))
    kind = (F.when(app_decl | bp_decl, "decl").when(is_route | is_verb, "deco").when(is_def, "def")
            .when(line.startswith("@"), "cancel"))
    base = ln.select(*FILE_KEY, "line_no", kind.alias("kind"), var.alias("var"), methods.alias("methods"),
                     normalize_route_path(F.coalesce(rpath, F.lit(""))).alias("rpath"), _rx(line, X.PY_DEF, 1).alias("fn"),
                     F.when(bp_decl, _decl_prefix(line, X.FLASK_BP, X.FLASK_URL_PREFIX)).alias("bp_prefix")
                     ).filter(F.col("kind").isNotNull())
    # A decorator counts only if its receiver was declared (Flask or Blueprint) on an earlier line.
    wv = Window.partitionBy(*FILE_KEY, "var").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    known = F.max(F.when(F.col("kind") == "decl", F.lit(1))).over(wv)
    base = _by_file(base).withColumn("known", (F.col("kind") != "deco") | (F.coalesce(known, F.lit(0)) == 1)).filter("known")
    base = base.withColumn("is_decl", F.col("kind") == "decl")
    w = _w("is_decl")
    ev = base.select("*", *[F.lag(c).over(w).alias("p_" + c) for c in ("kind", "var", "methods", "rpath")])
    hit = (F.col("kind") == "def") & F.coalesce(F.col("p_kind") == "deco", F.lit(False))
    ev = ev.withColumn("var", F.when(F.col("is_decl"), F.col("var")).otherwise(F.col("p_var"))).withColumnRenamed("bp_prefix", "decl_prefix")
    r = _with_prefix(ev, hit).select("*", F.explode("p_methods").alias("m"))
    return _out(r, "flask", F.col("m"), _prefixed("prefix", "p_rpath"), F.col("fn"))


# ---------------------------------------------------------------- R6 Django


def parse_django(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_django_urls_file(), ("#",)).filter(_has("line", X.DJANGO_PATH))
    line = F.col("line")
    ctrl = drop_suffix(_rx(line, X.DJANGO_PATH, 2), ".as_view")
    ctrl = F.when(line.contains(".as_view("), F.concat(ctrl, F.lit("@as_view"))).otherwise(ctrl)
    d = ln.filter(drop_suffix(_rx(line, X.DJANGO_PATH, 2), ".as_view") != "include")
    return _out(d, "django", F.lit("ANY"), normalize_route_path(_rx(line, X.DJANGO_PATH, 1)), ctrl)


# ---------------------------------------------------------------- R7 Gin / Echo
#: Receivers whose routes count without a declaration in the file.
GO_ROUTERS = ("r", "router", "engine")


def _go_events(x: Column) -> Column:
    """Sub-events of one line, in the order the reference applies them.

    kind 0 = root (var, fwname), 1 = group (var, parent, arg=prefix), 2 = route (var=receiver,
    parent=verb, arg=path, fwname=handler).
    """
    def ev(kind, var, parent, arg, fwname):
        return F.struct(F.lit(kind).alias("kind"), var.alias("var"), parent.alias("parent"), arg.alias("arg"), fwname.alias("fwname"))
    e = F.lit("")
    gin = ev(0, _rx(x, X.GIN_ROOT, 1), e, e, F.lit("gin"))
    echo = ev(0, _rx(x, X.ECHO_ROOT, 1), e, e, F.lit("echo"))
    grp = ev(1, _rx(x, X.GO_GROUP, 1), _rx(x, X.GO_GROUP, 2), _rx(x, X.GO_GROUP, 3), e)
    rte = ev(2, _rx(x, X.GO_ROUTE, 1), _rx(x, X.GO_ROUTE, 2), _rx(x, X.GO_ROUTE, 3), _rx(x, X.GO_ROUTE, 4))
    return F.filter(F.array(gin, echo, grp, rte), lambda v: v.var != "")


def go_events(files: DataFrame) -> DataFrame:
    """(file key, pos, kind, var, parent, arg, fwname): every root, group and route of the Go files, in order of ``pos``."""
    ln = _scan(files, P.is_go_routes_file(), ("//",))
    x = F.col("line")
    ln = ln.filter(x.contains("gin.") | x.contains("echo.New") | x.contains(".Group(") | x.rlike(X.GO_ROUTE))
    ev = ln.select(*FILE_KEY, "line_no", F.posexplode(_go_events(x)).alias("k", "e"))
    return ev.select(*FILE_KEY, (F.col("line_no").cast("long") * 4 + F.col("k")).alias("pos"), "e.*")


def _solve(declared: Column) -> Column:
    """Liveness and prefix of a file's declarations, from an array of (root, arg, up, same, group) in their order.

    ``up`` and ``same`` are the declarations of its parent and of its own variable that were in force before it, ``group``
    the parent's group then (indexes; -1: none). A declaration is live when a root is among those it hangs on. Prefixes
    are put together by pointer doubling: every round joins each declaration's part to that of the one it points at and
    skips as far again, so rounds are the logarithm of the nesting and a round is linear in the declarations.
    """
    false = F.lit(False)
    live = F.aggregate(declared, F.array().cast("array<boolean>"), lambda acc, d: F.array_append(
        acc, d.root | F.coalesce(F.get(acc, d["up"]), false) | F.coalesce(F.get(acc, d["same"]), false)))
    parts = F.transform(declared, lambda d: F.struct(d["arg"].alias("prefix"), d["group"].alias("at")))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(declared) + 1)).cast("int"))

    def skip(t: Column, _: Column) -> Column:
        def one(x: Column) -> Column:
            on = F.get(t, x["at"])
            return F.struct(F.when(x["at"] < 0, x["prefix"]).otherwise(join_route_paths(on["prefix"], x["prefix"])).alias("prefix"),
                            F.coalesce(on["at"], F.lit(-1)).alias("at"))
        return F.transform(t, one)

    return F.zip_with(live, F.aggregate(rounds, parts, skip), lambda a, b: F.struct(a.alias("live"), b["prefix"].alias("prefix")))


def parse_go(files: DataFrame) -> DataFrame:
    """Routes of declared Gin and Echo receivers, with the prefixes of the groups they hang on, and the frameworks used.

    Every declaration and route looks up what was in force before it with one window by variable. Prefixes are then put
    together along those pointers over a file's declarations alone; routes read theirs by its number. One scan, one exchange.
    """
    ev = go_events(files)
    here = Window.partitionBy(*FILE_KEY).orderBy("pos")
    kind, decl = F.col("kind"), F.col("kind") < 2
    ev = ev.withColumn("idx", F.when(decl, F.count(F.when(decl, 1)).over(here).cast("int") - 1))
    # a row that declares under its variable, and a row that asks under its parent (a group) or its receiver (a route)
    roles = F.array(F.when(decl, F.struct(F.lit(1).alias("role"), F.col("var").alias("name"))),
                    F.when(kind == 1, F.struct(F.lit(0).alias("role"), F.col("parent").alias("name"))),
                    F.when(kind == 2, F.struct(F.lit(0).alias("role"), F.col("var").alias("name"))))
    both = ev.select("*", F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("r")).select("*", "r.role", "r.name")
    w = Window.partitionBy(*FILE_KEY, "name").orderBy("pos", "role").rowsBetween(Window.unboundedPreceding, -1)
    declares, asks = F.col("role") == 1, F.col("role") == 0
    both = both.withColumn("latest", F.last(F.when(declares, F.col("idx")), True).over(w)) \
               .withColumn("latest_group", F.last(F.when(declares & (kind == 1), F.col("idx")), True).over(w))
    # each event on one row again: what it asked for, and its own variable's declaration before it
    one = both.groupBy(*FILE_KEY, "pos").agg(
        *[F.first(c).alias(c) for c in ("kind", "idx", "var", "parent", "arg", "fwname")], F.max(F.when(asks, F.col("latest"))).alias("up"),
        F.max(F.when(asks, F.col("latest_group"))).alias("group"), F.max(F.when(declares, F.col("latest"))).alias("same"))
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    path = normalize_route_path("arg")
    d = F.struct("idx", (kind == 0).alias("root"), F.when(kind == 1, path).otherwise(F.lit("")).alias("arg"), none("up"), none("same"), none("group"))
    r = F.struct("pos", F.upper("parent").alias("method"), path.alias("path"), F.when(F.col("fwname") != "", F.col("fwname")).otherwise(F.lit("handler")).alias("controller"),
                 F.col("var").isin(*GO_ROUTERS).alias("known"), none("up"), none("group"))
    whole = one.groupBy(*FILE_KEY).agg(
        F.array_sort(F.collect_list(F.when(decl, d))).alias("ds"), F.array_sort(F.collect_list(F.when(kind == 2, r))).alias("rs"),
        F.array_sort(F.collect_set(F.when(kind == 0, F.col("fwname")))).alias("roots")).filter(F.size("rs") > 0)
    found = whole.select(*FILE_KEY, "roots", F.transform(F.array(_solve(F.col("ds"))), _resolved)[0].alias("found")).filter(F.size("found") > 0)
    # a framework counts in a file that has its root and any route
    out = found.select(*FILE_KEY, F.explode(F.concat("found", F.transform("roots", lambda x: F.struct(
        x.alias("framework"), *[F.lit(None).cast("string").alias(c) for c in ("method", "path", "controller", "prefix")])))).alias("x")).select(*FILE_KEY, "x.*")
    full = join_route_paths(F.coalesce("prefix", F.lit("")), "path")
    return out.select(*FILE_KEY, "framework", "method", F.when(F.col("method").isNotNull(), F.when(full == "", F.col("path")).otherwise(full)).alias("path"), "controller")


def _resolved(solved: Column) -> Column:
    """The routes of a file (column rs) whose receiver is live or known by name, and its prefix."""
    live = F.filter("rs", lambda r: r["known"] | F.coalesce(F.get(solved, r["up"])["live"], F.lit(False)))
    return F.transform(live, lambda r: F.struct(F.lit("go").alias("framework"), r["method"].alias("method"), r["path"].alias("path"),
                                                r["controller"].alias("controller"), F.get(solved, r["group"])["prefix"].alias("prefix")))


# ---------------------------------------------------------------- R8 / R9 / R10 OpenAPI
def _openapi_files(files: DataFrame, exts) -> DataFrame:
    return files.filter(P.is_openapi_file() & F.col("ext").isin(*exts) & (trim_space("content") != ""))


def _openapi_json_docs(files: DataFrame) -> DataFrame:
    v = F.try_parse_json(F.col("content"))
    d = _openapi_files(files, (".json",)).select(*FILE_KEY, v.alias("v"))
    d = d.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    keys = F.expr("map_keys(try_variant_get(v, '$', 'map<string,variant>'))")
    return d.filter(F.array_contains(keys, "openapi") | F.array_contains(keys, "swagger"))


def parse_openapi_json(files: DataFrame) -> DataFrame:
    d = _openapi_json_docs(files)
    p = d.select(*FILE_KEY, F.explode_outer(F.try_variant_get("v", "$.paths", "map<string,variant>")).alias("rpath", "item"))
    m = p.select(*FILE_KEY, "rpath", F.explode_outer(F.try_variant_get("item", "$", "map<string,variant>")).alias("verb", "body"))
    is_route = F.coalesce(P.is_http_method(F.col("verb")), F.lit(False))
    op = F.try_variant_get("body", "$.operationId", "string")
    op_ok = F.schema_of_variant(F.try_variant_get("body", "$.operationId", "variant")) == "STRING"
    ctrl = F.when(op_ok & (trim_space(op) != ""), trim_space(op)).otherwise(F.lit("openapi"))
    route = _route("openapi", F.upper(trim_space("verb")), normalize_openapi_path(F.col("rpath")), ctrl)
    return _rows(m, F.array(F.when(is_route, route).otherwise(_usage("openapi"))))


def parse_openapi_yaml(files: DataFrame) -> DataFrame:
    ln = _split_lines(_openapi_files(files, (".yaml", ".yml")), F.lit(True), ("#",))
    raw, t = F.col("raw"), F.col("line")
    indent = F.length(raw) - F.length(F.ltrim(raw))
    is_paths = t == "paths:"
    is_exit = ~is_paths & (indent == 0) & ~t.startswith("/")
    is_pathline = (indent == 2) & t.endswith(":") & t.startswith("/")
    is_method = _has(raw, X.OPENAPI_METHOD)
    is_opid = _has(raw, X.OPENAPI_OPID)
    ev = ln.select(*FILE_KEY, "line_no", is_paths.alias("is_paths"), is_exit.alias("is_exit"),
                   is_pathline.alias("is_pathline"), is_method.alias("is_method"), is_opid.alias("is_opid"),
                   (t.startswith("openapi:") | t.startswith("swagger:")).alias("is_version"),
                   F.when(is_pathline, drop_suffix(t, ":")).alias("pth"),
                   F.upper(_rx(raw, X.OPENAPI_METHOD, 1)).alias("verb"), trim_space(_rx(raw, X.OPENAPI_OPID, 1)).alias("opid"))
    ev = ev.filter("is_paths or is_exit or is_pathline or is_method or is_opid or is_version")
    w = _before(_w())
    ev = ev.withColumn("in_paths", F.coalesce(F.last(F.when(F.col("is_paths"), True).when(F.col("is_exit"), False), True).over(w), F.lit(False)))
    # Lines outside the paths section change nothing; a version line says that the file is a specification.
    inside = F.col("is_paths") | F.col("in_paths")
    path_ev = F.when(inside, F.when(F.col("is_paths") | F.col("is_exit"), F.lit("")).when(F.col("is_pathline"), F.col("pth")))
    ev = ev.withColumn("path_ev", path_ev)
    ev = ev.withColumn("cur_path", F.coalesce(F.last("path_ev", True).over(w), F.lit("")))
    live = inside & ~F.col("is_paths") & ~F.col("is_exit") & ~F.col("is_pathline") & (F.col("cur_path") != "")
    ev = ev.withColumn("live", live)
    # the block that a method line opens: up to the next method, path or section line of the paths section
    opens = F.when(inside & (F.col("is_paths") | F.col("is_exit") | F.col("is_pathline")), F.lit(-1)).when(live & F.col("is_method"), F.col("line_no"))
    ev = ev.withColumn("block", F.coalesce(F.last(opens, True).over(_w().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(-1)))
    is_op = F.col("live") & F.col("is_opid") & ~F.col("is_method") & (F.col("block") > 0)
    of_block = Window.partitionBy(*FILE_KEY, "block")
    opid = F.max_by(F.when(is_op, F.col("opid")), F.when(is_op, F.col("line_no"))).over(of_block)
    ev = ev.withColumn("op", opid)
    route = _route("openapi", F.col("verb"), normalize_openapi_path(F.col("cur_path")), F.coalesce("op", F.lit("openapi")))
    found = F.array(F.when(F.col("live") & F.col("is_method"), route), F.when(F.col("is_version"), _usage("openapi")))
    return _rows(ev, F.filter(found, lambda x: x.isNotNull()))


# ---------------------------------------------------------------- R11 Next.js
def _strip_ext(c: Column) -> Column:
    last = F.element_at(F.split(c, "/"), -1)
    ext = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    return c.substr(F.lit(1), F.length(c) - F.length(ext))


def next_route_path() -> Column:
    p, lp = F.col("abs_path"), F.lower(F.col("abs_path"))
    i_pages, i_app = F.instr(lp, "/pages/api/"), F.instr(lp, "/app/api/")
    pages = drop_suffix(_strip_ext(p.substr(i_pages + len("/pages/api"), F.length(p))), "/index")
    app = drop_suffix(_strip_ext(p.substr(i_app + len("/app"), F.length(p))), "/route")
    return (F.when(i_pages > 0, normalize_next_segments(F.concat(F.lit("/api"), pages)))
            .when(i_app > 0, normalize_next_segments(app)))


def parse_nextjs(files: DataFrame) -> DataFrame:
    f = files.filter(P.is_nextjs_api_file()).withColumn("rp", next_route_path()).filter(F.col("rp") != "")
    is_app = F.lower("abs_path").contains("/app/api/")
    found = F.filter(F.array(*[F.lit(m) for m in fixed.NEXT_APP_METHODS]),
                     lambda m: F.col("content").contains(F.concat(F.lit("export async function "), m))
                     | F.col("content").contains(F.concat(F.lit("export function "), m)))
    methods = F.when(is_app & (F.size(found) > 0), found).otherwise(F.array(F.lit("ANY")))
    r = f.select("*", F.explode(methods).alias("m"))
    return _out(r, "next.js", F.col("m"), F.col("rp"), F.col("base"))


# ---------------------------------------------------------------- R12 ASP.NET


def _dotnet_lines(files: DataFrame) -> DataFrame:
    ln = _split_lines(files, P.is_dotnet_routes_file(), ("//",))
    line = F.col("line")
    kind = (F.when(_has(line, X.DOTNET_MINIMAL), "minimal").when(_has(line, X.DOTNET_METHODS), "methods")
            .when(_has(line, X.DOTNET_ROUTE_ATTR), "route_attr").when(_has(line, X.CLASS_DECL), "class")
            .when(_has(line, X.DOTNET_HTTP_ATTR), "http").when(_has(line, X.DOTNET_METHOD), "sig")
            .when(line.startswith("["), "cancel"))
    return ln.select(*FILE_KEY, "line_no", "line", kind.alias("kind")).filter(F.col("kind").isNotNull())


def parse_aspnet(files: DataFrame) -> DataFrame:
    ev = _dotnet_lines(files)
    line, kind = F.col("line"), F.col("kind")
    h = trim_space(_rx(line, X.DOTNET_MINIMAL, 3))
    minimal = _route("asp.net", F.upper(_rx(line, X.DOTNET_MINIMAL, 1)), normalize_route_path(_rx(line, X.DOTNET_MINIMAL, 2)),
                     F.when(h != "", h).otherwise(F.lit("handler")))
    verbs = F.filter(F.transform(quoted_tokens(_rx(line, X.DOTNET_METHODS, 2)), lambda t: F.upper(trim_space(t))), lambda t: t != "")
    mapped = F.transform(verbs, lambda t: _route("asp.net", t, normalize_route_path(_rx(line, X.DOTNET_METHODS, 1)), trim_space(_rx(line, X.DOTNET_METHODS, 3))))
    # Attribute routing: prefix epochs start at each [Route] line; the first class after it fills [controller].
    st = ev.select(
        *FILE_KEY, "line_no", "kind",
        F.when(kind == "minimal", F.array(minimal)).when(kind == "methods", mapped).alias("direct"),
        F.when(kind == "route_attr", trim_space(_rx(line, X.DOTNET_ROUTE_ATTR, 1))).alias("route_val"),
        F.when(kind == "class", trim_space(_rx(line, X.CLASS_DECL, 1))).alias("cls"),
        F.upper(trim_space(_rx(line, X.DOTNET_HTTP_ATTR, 1))).alias("verb"),
        trim_space(_rx(line, X.DOTNET_HTTP_ATTR, 2)).alias("suffix"),
        trim_space(_rx(line, X.DOTNET_METHOD, 1)).alias("fn"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    st = st.withColumn("epoch", F.sum(F.when(kind == "route_attr", 1).otherwise(0)).over(_w().rowsBetween(*upto)))
    st = st.withColumn("epoch_route", F.first("route_val", ignorenulls=True).over(_w("epoch").rowsBetween(*upto)))
    st = st.withColumn("epoch_cls", F.first("cls", ignorenulls=True).over(_before(_w("epoch"))))
    prefix = F.coalesce(F.when(F.col("epoch_route").contains("[controller]") & F.col("epoch_cls").isNotNull(),
                               F.replace(F.col("epoch_route"), F.lit("[controller]"), drop_suffix(F.col("epoch_cls"), "Controller")))
                        .otherwise(F.col("epoch_route")), F.lit(""))
    # a verb waits for the next signature; only another verb or attribute comes between them
    st = st.withColumn("waits", kind.isin("http", "sig", "cancel"))
    w = _w("waits")
    st = st.select("*", prefix.alias("prefix"), F.lag("kind").over(w).alias("p_kind"), F.lag("verb").over(w).alias("p_verb"),
                   F.lag("suffix").over(w).alias("p_suffix"))
    attr = _route("asp.net", F.col("p_verb"), join_attribute_paths(F.col("prefix"), F.col("p_suffix")), F.col("fn"))
    return _rows(st, F.when(kind.isin("minimal", "methods"), F.array_append(F.col("direct"), _usage("asp.net")))
                 .when((kind == "sig") & (F.col("p_kind") == "http"), F.array(attr)).when(kind.isin("route_attr", "http"), F.array(_usage("asp.net"))))


# ---------------------------------------------------------------- R13 Spring


def spring_mapping(kind: Column, args: Column) -> tuple[Column, Column]:
    """(path, sorted methods) of a mapping annotation."""
    a = trim_space(F.coalesce(args, F.lit("")))
    path = (F.when(a == "", F.lit("/"))
            .when(_has(a, X.SPRING_PATH_ATTR), trim_space(_rx(a, X.SPRING_PATH_ATTR, 1)))
            .when(_has(a, X.SPRING_QUOTED), trim_space(_rx(a, X.SPRING_QUOTED, 1)))
            .otherwise(F.lit("/")))
    k = F.upper(trim_space(F.coalesce(kind, F.lit(""))))
    enum = F.array_sort(F.array_distinct(F.regexp_extract_all(a, F.lit(X.SPRING_METHOD_ENUM), F.lit(1))))
    methods = F.when(k != "", F.array(k)).otherwise(enum)
    return path, methods


def parse_spring(files: DataFrame) -> DataFrame:
    ln = _split_lines(files, P.is_java_routes_file(), ("//",))
    line = F.col("line")
    is_map, is_cls, is_sig = _has(line, X.SPRING_MAPPING), _has(line, X.CLASS_DECL), _has(line, X.JAVA_METHOD)
    has_args = _has(line, r"^\s*@(?:(?:Get|Post|Put|Patch|Delete|Options|Head)Mapping|RequestMapping)\(")
    mpath, mmethods = spring_mapping(_rx(line, X.SPRING_MAPPING, 1), F.when(has_args, _rx(line, X.SPRING_MAPPING, 2)))
    kind = F.when(is_map, "map").when(is_cls, "class").when(is_sig, "sig")
    ev = ln.select(*FILE_KEY, "line_no", kind.alias("kind"), mpath.alias("mpath"), mmethods.alias("mmethods"),
                   F.when(is_cls, trim_space(_rx(line, X.CLASS_DECL, 1))).alias("cls"),
                   trim_space(_rx(line, X.JAVA_METHOD, 1)).alias("fn")).filter(F.col("kind").isNotNull())
    w = _w()
    ev = ev.select("*", F.lag("kind").over(w).alias("p_kind"), F.lag("mpath").over(w).alias("p_path"),
                   F.lag("mmethods").over(w).alias("p_methods"))
    ev = ev.withColumn("cls_prefix", F.when(F.col("kind") == "class",
                                            F.when(F.col("p_kind") == "map", F.col("p_path")).otherwise(F.lit(""))))
    wb = _before(w)
    ev = ev.withColumn("class_prefix", F.coalesce(F.last("cls_prefix", True).over(wb), F.lit(""))) \
           .withColumn("cur_class", F.coalesce(F.last("cls", True).over(wb), F.lit("")))
    pending = (F.col("p_kind") == "map") & ((F.col("p_path") != "") | (F.size("p_methods") > 0))
    methods = F.when(F.size("p_methods") > 0, F.col("p_methods")).otherwise(F.array(F.lit("ANY")))
    path, controller = join_attribute_paths(F.col("class_prefix"), F.col("p_path")), spring_controller_name(F.col("cur_class"), F.col("fn"))
    found = F.transform(methods, lambda m: _route("spring", m, path, controller))
    return _rows(ev, F.when((F.col("kind") == "sig") & pending, found).when(F.col("kind") == "map", F.array(_usage("spring"))))


# ---------------------------------------------------------------- union, R14, A3, A4
PARSERS = {
    "laravel": parse_laravel, "express": parse_express, "fastapi": parse_fastapi, "flask": parse_flask,
    "django": parse_django, "go": parse_go, "openapi_json": parse_openapi_json, "openapi_yaml": parse_openapi_yaml,
    "nextjs": parse_nextjs, "aspnet": parse_aspnet, "spring": parse_spring,
}


def scanned_routes(files: DataFrame, parsers=None) -> DataFrame:
    """Routes and, without a method, signs of use: one scan of the files per family."""
    return reduce(DataFrame.unionByName, [PARSERS[p](files) for p in (parsers or PARSERS)])


def raw_routes(files: DataFrame, parsers=None) -> DataFrame:
    return scanned_routes(files, parsers).filter(F.col("method").isNotNull())


# R14
def dedupe_routes(routes: DataFrame) -> DataFrame:
    """Distinct (method, path, controller) per snapshot."""
    return routes.select(*SNAP_KEY, "method", "path", "controller").distinct()


def routes(files: DataFrame, parsers=None) -> DataFrame:
    return dedupe_routes(raw_routes(files, parsers))


def route_frameworks(scanned: DataFrame) -> DataFrame:
    """A7 route evidence from ``scanned_routes``: a route, or a sign of use where that is enough."""
    return scanned.filter(F.col("framework") != "go").select(*SNAP_KEY, "framework").distinct()


def _method_key(c="method") -> Column:
    m = F.upper(trim_space(c))
    return F.when(m == "", F.lit("UNKNOWN")).otherwise(m)


# A3
def api_groups(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy(*SNAP_KEY, route_group_prefix(F.col("path")).alias("prefix")).agg(
        F.count(F.lit(1)).cast("bigint").alias("route_count"),
        F.array_sort(F.collect_set(_method_key())).alias("methods"))


# A4
def route_method_counts(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy(*SNAP_KEY, _method_key().alias("method")).agg(F.count(F.lit(1)).cast("bigint").alias("n_routes"))
