"""Path classifiers (P1-P24) as Column expressions over the ``files`` columns.

Columns used: ``rel_path`` (relative, '/'-separated), ``abs_path``
('/' + project + '/' + rel_path), ``base`` (last segment), ``ext`` (lower-case
extension of ``base`` including the dot, '' when none).  Each rule keeps the
reference's choice of relative vs absolute path and of case sensitivity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _lower_base() -> Column:
    return F.lower(F.col("base"))


def _lower_abs() -> Column:
    return F.lower(F.col("abs_path"))


# S2 / S3
def pruned_by(skip_dirs: list[str], rel="rel_path") -> Column:
    """True when any directory above the file is skipped (listed name or dot-directory)."""
    segs = F.split(F.col(rel), "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*skip_dirs) | d.startswith("."))


# P1
def is_dotnet_project() -> Column:
    return _lower_base().endswith(".csproj")


def is_manifest_marker() -> Column:
    return F.col("base").isin(*fixed.TECH_MARKERS) | is_dotnet_project()


# P2
def is_config_marker() -> Column:
    return F.col("base").isin(*fixed.CONFIG_MARKERS)


# P3
def is_env_file() -> Column:
    lb = _lower_base()
    return (lb == ".env") | lb.startswith(".env.")


# P4
def is_terraform_file() -> Column:
    return _lower_base().endswith(".tf")


# P5
def is_k8s_candidate() -> Column:
    la, lb = _lower_abs(), _lower_base()
    hints = [la.contains(h) for h in fixed.K8S_PATH_HINTS] + [lb.contains(h) for h in fixed.K8S_BASE_HINTS]
    return F.col("ext").isin(".yaml", ".yml") & _any(hints)


# P7
def is_config_file() -> Column:
    return is_config_marker() | is_env_file() | is_terraform_file() | is_k8s_candidate()


# P6
def manifest_kind() -> Column:
    """Kind of a recognised manifest or config file; NULL for every other file."""
    base = F.col("base")
    recognised = is_manifest_marker() | is_config_file()
    kind = (
        F.when(is_dotnet_project(), "dependency")
        .when(base.isin(*fixed.TECH_MARKERS) & (base.startswith("openapi.") | base.startswith("swagger.")), "api")
        .when(base.isin(*fixed.TECH_MARKERS) & base.startswith("next.config."), "configuration")
        .when(base.isin(*fixed.TECH_MARKERS), "dependency")
        .when(base.isin("docker-compose.yml", "docker-compose.yaml"), "infrastructure")
        .when(base == "Dockerfile", "runtime")
        .when(is_env_file(), "runtime")
        .when(is_terraform_file() | is_k8s_candidate(), "infrastructure")
        .when(base.isin(*fixed.CONFIG_MARKERS), "configuration")
    )
    return F.when(recognised, kind)


# P8
def source_language() -> Column:
    m = F.create_map(*[F.lit(x) for kv in fixed.SOURCE_LANGUAGES.items() for x in kv])
    return F.element_at(m, F.col("ext"))


# P9
def is_test_file() -> Column:
    lb, rel = _lower_base(), F.col("rel_path")
    rules = [lb.endswith(s) for s in fixed.TEST_SUFFIXES]
    rules.append(lb.startswith("test_") & lb.endswith(".py"))
    rules += [rel.contains("/src/test/"), rel.contains("/tests/")]
    return _any(rules)


# P10
def is_entry_point() -> Column:
    base, rel = F.col("base"), F.col("rel_path")
    return (
        base.isin(*fixed.ENTRY_POINT_NAMES)
        | (base.isin("api.php", "web.php") & rel.startswith("routes/"))
        | base.endswith("Application.java")
        | rel.endswith("/main.go")
    )


# P11
def is_notable(kind: Column | None = None) -> Column:
    kind = manifest_kind() if kind is None else kind
    return kind.isNotNull() | is_entry_point() | F.col("base").isin(*fixed.HIGHLIGHT_NAMES)


def directory_key(rel="rel_path") -> Column:
    """First two directory segments of the file, or 'root'."""
    segs = F.split(F.col(rel), "/")
    dirs = F.filter(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))), lambda s: (s != "") & (s != "."))
    return F.when(F.size(dirs) == 0, F.lit("root")).otherwise(F.array_join(F.slice(dirs, 1, 2), "/"))


# P12
def is_laravel_routes_file() -> Column:
    return F.col("base").isin("web.php", "api.php") & F.col("abs_path").contains("/routes/")


# P13
def is_express_file() -> Column:
    return F.col("ext").isin(".js", ".mjs", ".cjs", ".ts") & ~_lower_base().contains(".min.")


# P14
def is_python_routes_file() -> Column:
    lb = _lower_base()
    return (F.col("ext") == ".py") & ~lb.endswith("_test.py") & ~lb.startswith("test_")


# P15
def is_django_urls_file() -> Column:
    return is_python_routes_file() & (_lower_base() == "urls.py")


# P16
def is_go_routes_file() -> Column:
    return (F.col("ext") == ".go") & ~_lower_base().endswith("_test.go")


# P17
def is_openapi_file() -> Column:
    names = ["openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json"]
    la = _lower_abs()
    return _lower_base().isin(*names) | (
        F.col("ext").isin(".yaml", ".yml", ".json") & (la.contains("/openapi") | la.contains("/swagger"))
    )


# P18
def is_nextjs_api_file() -> Column:
    la = _lower_abs()
    pages = la.contains("/pages/api/") & F.col("ext").isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
    app = la.contains("/app/api/") & _any([la.endswith(s) for s in ("/route.js", "/route.jsx", "/route.ts", "/route.tsx")])
    return pages | app


# P19
def is_dotnet_routes_file() -> Column:
    lb = _lower_base()
    return (F.col("ext") == ".cs") & ~lb.endswith(".designer.cs") & ~lb.contains("test")


# P20
def is_java_routes_file() -> Column:
    lb = _lower_base()
    return (F.col("ext") == ".java") & ~_lower_abs().contains("/src/test/") & ~lb.endswith("test.java") & ~lb.endswith("tests.java")


# P21
def is_module_test_file() -> Column:
    lb = _lower_base()
    rules = [lb.endswith(s) for s in fixed.MODULE_TEST_SUFFIXES]
    rules.append(lb.startswith("test_") & lb.endswith(".py"))
    rules.append(F.col("abs_path").contains("/tests/"))
    return _any(rules)


# P22
def module_language() -> Column:
    ext = F.col("ext")
    return (
        F.when(ext == ".go", "go")
        .when(ext.isin(".js", ".mjs", ".cjs", ".ts"), "js")
        .when(ext == ".py", "python")
        .when(ext == ".php", "php")
    )


# P23
def is_http_method(c) -> Column:
    from .text import trim_space
    return F.upper(trim_space(c)).isin(*fixed.HTTP_METHODS)
