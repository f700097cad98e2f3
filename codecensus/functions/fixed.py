"""Fixed values that must equal the reference tool's for identical results.

Everything here is plain data, listed in the reference's natural order.
"""

# --- fixed values: file markers -------------------------------------------
TECH_MARKERS = [
    "composer.json", "package.json", "go.mod", "Cargo.toml", "requirements.txt",
    "pyproject.toml", "pom.xml", "build.gradle", "build.gradle.kts",
    "openapi.yaml", "openapi.yml", "openapi.json",
    "swagger.yaml", "swagger.yml", "swagger.json",
    "next.config.js", "next.config.mjs", "next.config.ts",
]
CONFIG_MARKERS = ["docker-compose.yml", "docker-compose.yaml", "Dockerfile", ".env"]

# --- fixed values: directories skipped by the repository walk --------------
SKIP_DIRS_SCAN = [".git", "node_modules", "vendor", "target", "build", "dist", "out"]
SKIP_DIRS_MODULES = [".git", "node_modules", "vendor", "__tests__", "dist", "release", "build", "target", "out"]

# --- fixed values: Kubernetes candidate hints -----------------------------
K8S_PATH_HINTS = ["/k8s/", "/kubernetes/", "/helm/"]
K8S_BASE_HINTS = ["deployment", "statefulset", "daemonset", "service", "ingress", "kustomization", "values", "chart"]

# --- fixed values: source languages by lower-case extension ---------------
SOURCE_LANGUAGES = {
    ".go": "go",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".py": "python",
    ".php": "php",
    ".java": "java",
    ".cs": "csharp",
    ".rs": "rust",
}

# --- fixed values: test-file suffixes (lower-case base name) --------------
TEST_SUFFIXES = [
    "_test.go",
    ".test.js", ".spec.js", ".test.mjs", ".spec.mjs", ".test.cjs", ".spec.cjs",
    ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx",
    "_test.py", "test.php", "test.java", "tests.java",
]
# The module graph's test filter: same idea without tsx and java rules.
MODULE_TEST_SUFFIXES = [
    "_test.go",
    ".test.js", ".spec.js", ".test.mjs", ".spec.mjs", ".test.cjs", ".spec.cjs",
    ".test.ts", ".spec.ts",
    "_test.py", "test.php",
]

# --- fixed values: entry points -------------------------------------------
ENTRY_POINT_NAMES = [
    "main.go", "main.js", "main.ts", "index.js", "index.ts", "server.js", "server.ts",
    "app.js", "app.ts", "app.py", "server.py", "manage.py", "artisan", "Dockerfile", "Main.java",
]
HIGHLIGHT_NAMES = ["README.md", "Makefile"]

# --- fixed value: notable files that a line of a report names (the tables hold all) ---
REPORTED_NOTABLE_FILES = 5

# --- fixed values: infrastructure vocabulary (first hit wins, in order) ----
# (service, substrings that trigger it)
INFRA_VOCABULARY = [
    ("postgres", ["postgres"]),
    ("mysql", ["mysql"]),
    ("mariadb", ["mariadb"]),
    ("redis", ["redis"]),
    ("mongodb", ["mongodb", "mongo"]),
    ("rabbitmq", ["rabbitmq"]),
    ("kafka", ["kafka"]),
    ("zookeeper", ["zookeeper"]),
    ("elasticsearch", ["elasticsearch"]),
    ("opensearch", ["opensearch"]),
    ("clickhouse", ["clickhouse"]),
    ("nginx", ["nginx"]),
    ("minio", ["minio"]),
    ("memcached", ["memcached"]),
    ("sqlserver", ["sqlserver", "mssql"]),
    ("kubernetes", ["kubernetes", "k8s"]),
    ("terraform", ["terraform"]),
]
TERRAFORM_K8S_HINTS = ["aws_eks_cluster", "google_container_cluster", "azurerm_kubernetes_cluster", "kubernetes_", "helm_release"]

# --- fixed values: manifest -> (language, manager); suffix test on the path -
# (suffix, case_insensitive, language, manager)
MANIFEST_LANGUAGES = [
    ("composer.json", False, "php", "composer"),
    ("package.json", False, "javascript", "npm"),
    ("go.mod", False, "go", "go"),
    ("pom.xml", True, "java", "maven"),
    ("build.gradle", True, "java", "gradle"),
    ("build.gradle.kts", True, "java", "gradle"),
    (".csproj", True, "csharp", "nuget"),
    ("Cargo.toml", False, "rust", "cargo"),
    ("requirements.txt", True, "python", "pip"),
    ("pyproject.toml", True, "python", "pip"),
]

# --- fixed values: dependency -> framework rules (first match wins) --------
# (managers, match kind, needles, framework)
FRAMEWORK_RULES = [
    (["composer"], "eq", ["laravel/framework"], "laravel"),
    (["npm"], "eq", ["react"], "react"),
    (["npm"], "eq", ["express"], "express"),
    (["npm"], "eq", ["next"], "next.js"),
    (["npm"], "eq", ["@angular/core", "angular"], "angular"),
    (["maven", "gradle"], "suffix", [":spring-boot-starter-web", ":spring-webmvc", ":spring-web", ":spring-boot-starter-webflux"], "spring"),
    (["go"], "eq", ["github.com/gin-gonic/gin"], "gin"),
    (["go"], "eq", ["github.com/labstack/echo/v4"], "echo"),
    (["nuget"], "contains", ["aspnetcore"], "asp.net"),
    (["pip", "poetry"], "eq", ["django"], "django"),
    (["pip", "poetry"], "eq", ["fastapi"], "fastapi"),
    (["pip", "poetry"], "eq", ["flask"], "flask"),
]

# --- fixed values: HTTP verbs ------------------------------------------------
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "TRACE"]
NEXT_APP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]

# --- fixed values: Gradle configurations --------------------------------------
GRADLE_CONFIGURATIONS = ["api", "implementation", "compileOnly", "runtimeOnly", "testImplementation",
                         "testRuntimeOnly", "annotationProcessor", "kapt"]

# --- fixed values: architecture layers (module segment -> layer) ------------
LAYER_OF_SEGMENT = {
    "Http": "Http", "Actions": "Actions", "Services": "Services",
    "Repositories": "Repositories", "Repository": "Repositories",
    "Models": "Models", "Console": "Console", "Events": "Events", "Listeners": "Listeners",
    "Jobs": "Jobs", "Imports": "Imports", "Exports": "Exports", "Classes": "Classes",
    "Enums": "Enums", "Interfaces": "Interfaces",
}
LAYER_ORDER = ["Http", "Console", "Actions", "Services", "Repositories", "Models", "Events", "Listeners",
               "Jobs", "Imports", "Exports", "Classes", "Enums", "Interfaces"]

# --- fixed values: generated document names ------------------------------------
MARKDOWN_ARTIFACTS = ["README.generated.md", "project-structure.md", "dependencies.md", "endpoints.md",
                      "dependency-graph.md", "module-graph.md", "architecture.md"]
HTML_ARTIFACTS = ["index.html"]
