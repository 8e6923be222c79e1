"""Rule tables. Everything here is a fixed value of the data contract."""

# --- Fixed values: node type -> entity label ---
TYPE_LABELS = {
    "package": "Package",
    "dependency": "Package",
    "http_route": "HttpRoute",
    "kafka_topic": "KafkaTopic",
    "kafka_producer": "KafkaProducer",
    "kafka_consumer": "KafkaConsumer",
    "sql_schema": "SqlSchema",
    "sql_table": "SqlTable",
    "sql_view": "SqlView",
    "sql_procedure": "SqlProcedure",
    "sql_trigger": "SqlTrigger",
    "sql_function": "SqlFunction",
    "glue_job": "GlueJob",
    "glue_schedule": "GlueSchedule",
}

# --- Fixed values: labels given by metadata.kind ---
KIND_LABELS = {
    "file": "File",
    "bash_entrypoint": "File",
    "bash_function": "Function",
}

# --- Fixed values: labels an entity may carry ---
INFERRED_LABELS = ("File", "Function", "DocSection", "Class", "Symbol")

# --- Fixed values: relation verb -> edge type ---
RELATION_TYPES = {
    "calls": "CALLS",
    "contains": "CONTAINS",
    "references": "REFERENCES",
    "method": "HAS_METHOD",
    "embeds": "EMBEDS",
    "defines": "DECLARES",
    "depends_on": "DEPENDS_ON",
    "depends_on_repo": "DEPENDS_ON_REPO",
    "exposes_route": "EXPOSES_ROUTE",
    "handled_by": "HANDLED_BY",
    "produces": "PRODUCES",
    "consumes": "CONSUMES",
    "reads_table": "READS_TABLE",
    "writes_table": "WRITES_TABLE",
    "triggers_on": "TRIGGERS_ON",
    "depends_on_object": "DEPENDS_ON_OBJECT",
    "in_schema": "IN_SCHEMA",
    "reads_source": "READS_SOURCE",
    "writes_destination": "WRITES_DESTINATION",
    "scheduled": "SCHEDULED",
}

# --- Fixed values: edge types counted as incoming dependencies ---
DEPENDENCY_TYPES = (
    "CALLS",
    "REFERENCES",
    "EMBEDS",
    "HANDLED_BY",
    "DEPENDS_ON",
    "DEPENDS_ON_REPO",
    "PRODUCES",
    "CONSUMES",
    "READS_TABLE",
    "WRITES_TABLE",
    "TRIGGERS_ON",
    "DEPENDS_ON_OBJECT",
    "READS_SOURCE",
    "WRITES_DESTINATION",
)

# --- Fixed values: file extension -> language ---
EXTENSION_LANGUAGES = {
    ".go": "go",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".java": "java",
    ".swift": "swift",
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".svelte": "svelte",
    ".scala": "scala",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".sql": "sql",
    ".sh": "bash",
    ".bash": "bash",
    ".ps1": "powershell",
    ".dart": "dart",
    ".groovy": "groovy",
    ".proto": "protobuf",
    ".tf": "terraform",
}

# --- Fixed values: confidence tiers and their default scores ---
CONFIDENCE_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.75, "AMBIGUOUS": 0.5}

# --- Fixed values: id prefixes of nodes shared by all repositories ---
SHARED_PREFIXES = ("topic::", "pkg::", "sql::", "repo::")

# --- Fixed values: labels of SQL objects ---
SQL_LABELS = ("SqlTable", "SqlView", "SqlProcedure", "SqlTrigger", "SqlFunction", "SqlSchema")

# --- Fixed values: result and traversal limits ---
SEARCH_LIMIT = 100
SYMBOL_LIMIT = 500
ROUTE_LIMIT = 500
DEPENDENCY_LIMIT = 1000
SQL_OBJECT_LIMIT = 200
GLUE_JOB_LIMIT = 500
BLAST_DEPTH_DEFAULT = 3
BLAST_DEPTH_MAX = 10
PATH_HOPS_MAX = 15
HOTSPOT_LIMIT_DEFAULT = 25
HOTSPOT_LIMIT_MAX = 100
OVERVIEW_COMMUNITIES = 12
OVERVIEW_COMMUNITY_NAMES = 8
OVERVIEW_COMMUNITY_PATHS = 50
OVERVIEW_ENTRY_POINTS = 100
OVERVIEW_MODULES = 30
OVERVIEW_HUBS = 15
OVERVIEW_EXTERNAL_DEPS = 100
OVERVIEW_READING_ITEMS = 8
CONTEXT_MAX = 64
FRESHNESS_SECONDS = 3600
GRAPH_SCHEMA_VERSION = 11

# --- Fixed values: directories no extractor enters ---
SKIP_DIRS = (
    ".git",
    "node_modules",
    "vendor",
    "target",
    "build",
    "dist",
    "__pycache__",
    ".venv",
    "venv",
    ".tox",
    ".gradle",
    ".idea",
    ".vs",
    "bin",
    "obj",
    ".mvn",
)
# --- Fixed values: further directories skipped by the HTTP extractor ---
HTTP_SKIP_DIRS = ("tests", "test", "testdata", "mocks", "__mocks__", "__tests__")

# --- Fixed values: repository and branch name patterns ---
REPO_NAME_RE = r"^[A-Za-z0-9_][A-Za-z0-9._-]*$"
BRANCH_RE = r"^[A-Za-z0-9_][A-Za-z0-9._/-]*$"

# --- Fixed values: endpoints that are not usage, shared actor, list cap ---
UNRECORDED_ENDPOINTS = ("health", "ready", "portal", "admin", "keys")
SHARED_ACTOR = "internal"
UNATTRIBUTED_BUCKET = "-unattributed-"
MAX_REPOS_PER_SAMPLE = 8
ACCESS_RETENTION_HOURS = 48
ANOMALY_CAP = 50
ACTIVITY_CAP = 50

# --- Fixed values: overview module roles, tested in this order ---
NOISE_MODULE_KEYS = ("vendor/", "/vendor", "node_modules", "testdata")
INFRA_MODULE_KEYS = (
    "config",
    "postgres",
    "/db",
    "database",
    "kafka",
    "server",
    "middleware",
    "neo4j",
    "redis",
    "cache",
    "jwt",
    "auth",
    "queue",
    "broker",
    "transport",
)
UTILITY_MODULE_KEYS = (
    "util",
    "helper",
    "common",
    "internal/tools",
    "generated",
    "graphql_models",
    "mock",
    "testutil",
)

# --- Fixed values: reading-order steps and the reason shown for each ---
READING_STEPS = {
    "entry_points": "where each process starts - trace startup from here",
    "core_packages": "largest domain modules by node count - the bulk of the logic",
    "services": "external surface area: HTTP routes, Kafka topics, SQL objects",
    "infrastructure": "config, persistence, and transport wiring that supports the services",
    "utilities": "shared helpers and generated code - read on demand",
}

# --- Fixed values: operational route prefixes ---
INFRA_ROUTE_PREFIXES = (
    "/health",
    "/healthz",
    "/livez",
    "/readyz",
    "/ready",
    "/live",
    "/metrics",
    "/debug/",
    "/debug",
    "/actuator",
    "/swagger",
    "/openapi",
    "/ping",
    "/version",
    "/status",
    "/__",
)
