"""Patterns that decide what the extractors find, each whole. They must match as they are for equal results."""

# --- fixed values: patterns of routes ---
LARAVEL_CLASS = r"""Route::(?i)(get|post|put|patch|delete|options|any)\s*\(\s*['"]([^'"]+)['"]\s*,\s*\[\s*([A-Za-z0-9_\\]+)::class\s*,\s*['"]([A-Za-z0-9_]+)['"]\s*\]"""
LARAVEL_STRING = r"""Route::(?i)(get|post|put|patch|delete|options|any)\s*\(\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]+)['"]"""
EXPRESS_ROUTE = r"""\b(?:app|router)\.(get|post|put|patch|delete|options|head|all)\s*\(\s*['"\x60]([^'"\x60]+)['"\x60](?:\s*,\s*([A-Za-z0-9_$.]+))?"""
EXPRESS_CHAIN = r"""\b(?:app|router)\.route\s*\(\s*['"\x60]([^'"\x60]+)['"\x60]\s*\)\.(get|post|put|patch|delete|options|head|all)\s*\("""
FASTAPI_ROUTER = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*APIRouter\((.*)\)"
FASTAPI_PREFIX = r"""prefix\s*=\s*["']([^"']+)["']"""
FASTAPI_DECO = r"""^@([A-Za-z_][A-Za-z0-9_]*)\.(get|post|put|patch|delete|options|head)\(\s*["']([^"']+)["']"""
PY_DEF = r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
FLASK_APP = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*Flask\("
FLASK_BP = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*Blueprint\((.*)\)"
FLASK_URL_PREFIX = r"""url_prefix\s*=\s*["']([^"']+)["']"""
FLASK_ROUTE = r"""^@([A-Za-z_][A-Za-z0-9_]*)\.route\(\s*["']([^"']+)["'](?:\s*,\s*methods\s*=\s*\[([^\]]+)\])?"""
FLASK_VERB = r"""^@([A-Za-z_][A-Za-z0-9_]*)\.(get|post|put|patch|delete|options|head)\(\s*["']([^"']+)["']"""
METHOD_TOKEN = r"""["']([A-Za-z]+)["']"""
DJANGO_PATH = r"""(?:path|re_path)\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_][A-Za-z0-9_\.]*)(?:\.as_view\(\))?"""
GIN_ROOT = r"([A-Za-z_][A-Za-z0-9_]*)\s*:=\s*gin\.(Default|New)\s*\("
ECHO_ROOT = r"([A-Za-z_][A-Za-z0-9_]*)\s*:=\s*echo\.New\s*\("
GO_GROUP = r'([A-Za-z_][A-Za-z0-9_]*)\s*:=\s*([A-Za-z_][A-Za-z0-9_]*)\.Group\(\s*["\x60]([^"\x60]*)["\x60]'
GO_ROUTE = r'([A-Za-z_][A-Za-z0-9_]*)\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|Any|Match)\(\s*["\x60]([^"\x60]+)["\x60](?:\s*,\s*([A-Za-z_][A-Za-z0-9_./]*))?'
OPENAPI_METHOD = r"^\s{2,}(get|post|put|patch|delete|options|head|trace)\s*:\s*$"
OPENAPI_OPID = r"""^\s{4,}operationId\s*:\s*['"]?([^'"]+)['"]?\s*$"""
DOTNET_MINIMAL = r'\b[A-Za-z_][A-Za-z0-9_]*\.Map(Get|Post|Put|Patch|Delete|Options|Head)\(\s*"([^"]+)"(?:\s*,\s*([A-Za-z_][A-Za-z0-9_\.]*))?'
DOTNET_METHODS = r'\b[A-Za-z_][A-Za-z0-9_]*\.MapMethods\(\s*"([^"]+)"\s*,\s*(?:new\s*\[\]\s*)?\{\s*([^}]*)\}\s*,\s*([A-Za-z_][A-Za-z0-9_\.]*)'
DOTNET_ROUTE_ATTR = r'^\s*\[Route\("([^"]+)"\)\]'
DOTNET_HTTP_ATTR = r'^\s*\[Http(Get|Post|Put|Patch|Delete|Options|Head)(?:\("([^"]*)"\))?\]'
CLASS_DECL = r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)\b"
DOTNET_METHOD = r"\b(?:public|protected|internal|private)(?:\s+async)?(?:\s+[A-Za-z0-9_<>\[\],?.]+)+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
SPRING_MAPPING = r"^\s*@(?:(Get|Post|Put|Patch|Delete|Options|Head)Mapping|RequestMapping)(?:\((.*)\))?\s*$"
SPRING_PATH_ATTR = r'(?:value|path)\s*=\s*"([^"]*)"'
SPRING_METHOD_ENUM = r"RequestMethod\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)"
SPRING_QUOTED = r'"([^"]*)"'
JAVA_METHOD = r"\b(?:public|protected|private)(?:\s+static)?(?:\s+final)?(?:\s+[A-Za-z0-9_<>\[\],?.]+)+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("

# --- fixed values: patterns of manifests ---
GRADLE_SHORT = r"""^\s*(?:api|implementation|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt)\s*(?:\(\s*)?["']([^:"']+):([^:"']+)(?::([^"')]+))?["']"""
GRADLE_NAMED = r"""^\s*(?:api|implementation|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt)\s+group:\s*["']([^"']+)["']\s*,\s*name:\s*["']([^"']+)["'](?:\s*,\s*version:\s*["']([^"']+)["'])?"""
NUGET_REF = r'<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"\s*/?>'

# --- fixed values: patterns of module imports ---
JS_FROM = r"""(?m)^\s*import\s+.*?\s+from\s+['"]([^'"]+)['"]"""
JS_SIDE = r"""(?m)^\s*import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
PY_FROM = r"(?m)^\s*from\s+(\.+[A-Za-z0-9_\.]*)\s+import\s+"
PHP_NAMESPACE = r"(?m)^\s*namespace\s+([^;]+);"
PHP_USE = r"(?m)^\s*use\s+([^;]+);"
