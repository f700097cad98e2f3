"""Go import declarations as the language's own parser reads them."""

from pyspark.sql import functions as F

from codecensus.functions.golang import import_paths
from codecensus.operators import modules as G

CASES = {
    'plain': ('package p\nimport "m/x"\nfunc F(){}\nimport "m/late"\n', ["m/x"]),
    'two': ('package p; import "m/x"; import "m/y"\n', ["m/x", "m/y"]),
    'why': ('package p // c\n\nimport (\n\t"m/z" // why "m/no"\n\ta "m/a" /* b */\n\t. "m/dot"\n\t_ "m/u"; "m/v"\n)\nvar x = 1\n', ["m/z", "m/a", "m/dot", "m/u", "m/v"]),
    'block': ('/* import "m/q"\n*/ package p /* x\n "m/no" */ import /* y */ "m/x"\n', ["m/x"]),
    'raw': ('package p\nimport `m/raw`\nimport "m/x"', ["m/x"]),
    'broken': ('package p\nimport "m/x" "m/y"\n', []),
    'unterminated': ('package p\nimport "m/x"\nimport "m/y\n', []),
    'nopackage': ('import "m/x"\n', []),
    'keyword': ('package p\nimport if "m/x"\n', []),
    'under': ('package _\nimport "m/x"\n', []),
    'space': ('package p\nimport "m/x y"\n', []),
    'empty': ('', []),
    'parens': ('package p\nimport ()\nimport("m/x";)\nimport ("m/y")\ntype T struct{}\n', ["m/x", "m/y"]),
    'nl': ('package\np\nimport\n"m/x"\n', ["m/x"]),
    'namenl': ('package p\nimport a\n"m/x"\n', []),
    'dotnl': ('package p\nimport .\n"m/x"\n', ["m/x"]),
    'funcname': ('package p\nimport funcs "m/x"\nvar y = "z"\n', ["m/x"]),
    'crlf': ('package p\r\nimport "m/x"\r\n', ["m/x"]),
    'bom': ('\ufeffpackage p\nimport "m/x"\n', ["m/x"]),
    'comment_end': ('package p\nimport "m/x" // end', ["m/x"]),
    'long': ('package p\n/*'+'* a'*300000+'*/import "m/x"\n'+'// "m/no"\n'*100000+'import "m/y"\n', ["m/x", "m/y"]),
    'same_line_block': ('package p\nimport "m/x" /* a */ import "m/y"\n', []),
    'block_nl_semicolon': ('package p\nimport "m/x" /* a\n */ import "m/y"\n', ["m/x", "m/y"]),
}


def test_go_imports(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "k string, c string")
    got = {r.k: r.i for r in df.select("k", import_paths(F.col("c")).alias("i")).collect()}
    assert got == {k: v[1] for k, v in CASES.items()}


def test_go_routes_by_pointers(spark, files):
    """Groups that hang on dead, renamed and redeclared variables, and a deep chain."""
    from codecensus.operators import routes as R
    odd = ('a := x.Group("/no")\na.GET("/dead", h)\nr.GET("/byname", h)\nb := gin.New()\nb := y.Group("/still")\nb.GET("/live", h)\n'
           'c := b.Group("/c")\nc := c.Group("/d")\nc.POST("/e", h)\ne := echo.New()\nz := q.Group("/z")\nq := e.Group("/q")\nz.GET("/deadz", h)\n')
    deep = "r := gin.Default()\n" + "".join(f'g{k} := {f"g{k - 1}" if k else "r"}.Group("/p{k}")\n' for k in range(70)) + 'g69.GET("/x", h)\n'
    f = files([("odd.go", odd), ("deep.go", deep), ("none.go", "r := gin.Default()\n")])
    rows = R.scanned_routes(f, ["go"]).collect()
    got = {(r.rel_path, r.method, r.path) for r in rows if r.method}
    assert got == {("odd.go", "GET", "/byname"), ("odd.go", "GET", "/still/live"), ("odd.go", "POST", "/still/c/d/e"),
                   ("deep.go", "GET", "".join(f"/p{k}" for k in range(70)) + "/x")}
    assert {(r.rel_path, r.framework) for r in rows if not r.method} == {("odd.go", "echo"), ("odd.go", "gin"), ("deep.go", "gin")}


def test_namespaces_meet_their_longest_prefix(spark):
    maps = spark.createDataFrame([("r", "s", "App\\", "app", 0), ("r", "s", "App\\Jobs\\", "jobs", 0), ("r", "s", "Vend", "vendor-src", 1),
                                  ("q", "s", "App\\", "other", 0)], "repo_id string, snapshot_id string, prefix string, dir string, prio int")
    names = ["App\\X", "App\\Jobs\\Y", "\\App\\Z", "Vendor\\A", "Ap", "", "Other\\App\\X"]
    ns = spark.createDataFrame([("r", "s", n) for n in names] + [("q", "s", "App\\Jobs\\Y"), ("none", "s", "App\\X")], "repo_id string, snapshot_id string, ns string")
    got = {(r.repo_id, r.ns): r.path for r in G.namespace_to_path(ns, "ns", maps, "path").collect()}
    assert got == {("r", "App\\X"): "app/X", ("r", "App\\Jobs\\Y"): "jobs/Y", ("r", "\\App\\Z"): "app/Z", ("r", "Vendor\\A"): "vendor-src/or/A", ("r", "Ap"): None,
                   ("r", ""): None, ("r", "Other\\App\\X"): None, ("q", "App\\Jobs\\Y"): "other/Jobs/Y", ("none", "App\\X"): None}
