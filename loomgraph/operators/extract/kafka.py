"""Kafka topics from code and YAML configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.extract.common import (
    Fragments,
    emit_edges,
    emit_nodes,
    hub_id,
    hub_nodes,
    location,
    matches_with_lines,
    order_key,
    pattern,
    rule_rows,
    select_files,
)
from loomgraph.session import cut_lineage

EXTRACTOR = "kafka"

# --- Fixed values: client-library patterns per language, group 1 is the topic ---
GO_PRODUCES = (
    r'ProducerMessage\s*\{[^}]*Topic\s*:\s*"([^"]+)"',
    r'Writer\s*\{[^}]*Topic\s*:\s*"([^"]+)"',
)
GO_CONSUMES = (
    r'Reader(?:Config)?\s*\{[^}]*Topic\s*:\s*"([^"]+)"',
    r'ConsumeClaim\s*\([^)]*"([^"]+)"',
    r'\.Subscribe\s*\(\s*"([^"]+)"',
    r'\.SubscribeTopics\s*\(\s*\[\]string\s*\{\s*"([^"]+)"',
)
JVM_PRODUCES = (
    r'\.send\s*\(\s*new\s+ProducerRecord\s*<[^>]*>\s*\(\s*"([^"]+)"',
    r'\.send\s*\(\s*"([^"]+)"',
)
JVM_CONSUMES = (
    r'@KafkaListener\s*\(\s*topics?\s*=\s*[\{"]?([^,)}]+)',
    r'\.subscribe\s*\(\s*(?:Collections\.singletonList|Arrays\.asList|List\.of)\s*\(\s*"([^"]+)"',
    r'\.subscribe\s*\(\s*"([^"]+)"',
)
JS_PRODUCES = (r"""\.send\s*\(\s*\{[^}]*topic\s*:\s*['"]([^'"]+)['"]""",)
JS_CONSUMES = (
    r"""\.subscribe\s*\(\s*\{[^}]*topic\s*:\s*['"]([^'"]+)['"]""",
    r"""topics\s*:\s*\[\s*['"]([^'"]+)['"]""",
)
PY_PRODUCES = (
    r"""\.produce\s*\(\s*["']([^"']+)["']""",
    r"""\.send\s*\(\s*["']([^"']+)["']""",
)
PY_CONSUMES = (
    r"""KafkaConsumer\s*\(\s*["']([^"']+)["']""",
    r"""AIOKafkaConsumer\s*\(\s*["']([^"']+)["']""",
    r"""\.subscribe\s*\(\s*\[\s*["']([^"']+)["']""",
)

# --- Fixed values: extensions of each language and of configuration files ---
GO_EXTENSIONS = (".go",)
JVM_EXTENSIONS = (".java", ".kt", ".kts", ".scala")
JS_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs")
PY_EXTENSIONS = (".py",)
CONFIG_EXTENSIONS = (".yml", ".yaml")

# --- Fixed values: YAML line shape, plausible topic names, placeholders ---
YAML_LINE_RE = r"^(\s*)(?:-\s+)?([A-Za-z0-9_.-]+)\s*:\s*([^\n]*)$"
TOPIC_RE = r"^[A-Za-z0-9][A-Za-z0-9._-]{2,}$"
NOT_TOPICS = ("tbd", "true", "false", "null", "none")

LANGUAGES = (
    (GO_EXTENSIONS, GO_PRODUCES, GO_CONSUMES),
    (JVM_EXTENSIONS, JVM_PRODUCES, JVM_CONSUMES),
    (JS_EXTENSIONS, JS_PRODUCES, JS_CONSUMES),
    (PY_EXTENSIONS, PY_PRODUCES, PY_CONSUMES),
)

def _client_rules() -> Column:
    rows = []
    for extensions, produces, consumes in LANGUAGES:
        rows += [(extensions, "produces", pattern(r)) for r in produces]
        rows += [(extensions, "consumes", pattern(r)) for r in consumes]
    return rule_rows("extensions role regex", rows)


def _clean(topic: Column) -> Column:
    return F.trim(F.btrim(topic, F.lit("\"' {}")))


def code_topics(files: DataFrame) -> DataFrame:
    """Every topic named at a client call."""
    mine = F.filter(_client_rules(), lambda r: F.array_contains(r["extensions"], F.col("ext")))

    def apply(rule: Column) -> Column:
        return F.transform(
            matches_with_lines(F.col("content"), rule["regex"], 1),
            lambda h: F.struct(rule["role"].alias("role"), h["value"].alias("topic"), h["line"].alias("line")),
        )

    hits = F.flatten(F.transform(mine, apply))
    extensions = [e for language in LANGUAGES for e in language[0]]
    rows = select_files(files, None, extensions)
    return (
        rows.select("repo", "path", "walk", F.posexplode(hits).alias("pos", "hit"))
        .select("repo", "path", "walk", "pos", "hit.role", _clean(F.col("hit.topic")).alias("topic"), "hit.line")
        .where(F.col("topic") != "")
    )


def _yaml_hits(text: Column) -> Column:
    """Topic-keyed values of a YAML text with their ancestor keys: a fold over its lines."""

    def parse(line: Column, i: Column) -> Column:
        return F.struct(
            line.rlike(YAML_LINE_RE).alias("ok"),
            (i + 1).alias("line"),
            F.length(F.regexp_extract(line, YAML_LINE_RE, 1)).alias("indent"),
            F.regexp_extract(line, YAML_LINE_RE, 2).alias("key"),
            F.btrim(F.regexp_extract(line, YAML_LINE_RE, 3), F.lit(" \t\r")).alias("value"),
        )

    entries = F.filter(F.transform(F.split(text, "\n"), parse), lambda e: e["ok"])
    state = "struct<open:array<struct<indent:int,key:string>>,hits:array<struct<line:int,key:string,value:string,above:string>>>"
    start = F.struct(
        F.array().cast("array<struct<indent:int,key:string>>").alias("open"),
        F.array().cast("array<struct<line:int,key:string,value:string,above:string>>").alias("hits"),
    ).cast(state)

    def step(acc: Column, e: Column) -> Column:
        open_keys = F.filter(acc["open"], lambda f: f["indent"] < e["indent"])
        above = F.array_join(F.transform(open_keys, lambda f: f["key"]), " ")
        hit = F.struct(e["line"].alias("line"), e["key"].alias("key"), e["value"].alias("value"), above.alias("above"))
        is_topic = F.lower(e["key"]).contains("topic") & (e["value"] != "")
        frame = F.struct(e["indent"].alias("indent"), e["key"].alias("key"))
        return F.struct(
            F.when(e["value"] == "", F.concat(open_keys, F.array(frame))).otherwise(open_keys).alias("open"),
            F.when(is_topic, F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"),
        ).cast(state)

    return F.aggregate(entries, start, step)["hits"]


def config_topics(files: DataFrame) -> DataFrame:
    """Topic names in Kafka-related YAML with their role."""
    rows = select_files(files, None, CONFIG_EXTENSIONS).where(
        F.lower("path").contains("kafka") | F.lower("content").contains("kafka")
    )
    rows = rows.where(F.lower("content").contains("topic"))
    hits = rows.select("repo", "path", "walk", F.explode(_yaml_hits(F.col("content"))).alias("h"))
    value = F.col("h.value")
    flow = F.transform(F.split(F.btrim(value, F.lit("[]")), ","), lambda v: F.trim(v))
    listed = F.when(value.startswith("["), flow).otherwise(F.array(value))
    hint = F.lower(F.concat_ws(" ", "path", "h.key", "h.above"))
    prod, cons = hint.contains("produc"), hint.contains("consum")
    role = F.when(prod & ~cons, "produces").when(cons & ~prod, "consumes").otherwise("references")
    uncommented = F.regexp_replace(F.col("raw"), r"^((?:[^#]*[ \t])?)#[\s\S]*$", "$1")
    topic = F.btrim(F.btrim(uncommented, F.lit(" \t")), F.lit("\"'"))
    return (
        hits.select("repo", "path", "walk", role.alias("role"), "h.line", F.posexplode(listed).alias("i", "raw"))
        .select(
            "repo", "path", "walk", (F.col("line").cast("long") * (1 << 31) + F.col("i")).alias("pos"), "role",
            topic.alias("topic"), "line",
        )
        .where(F.col("topic").rlike(TOPIC_RE) & ~F.lower("topic").isin(*NOT_TOPICS))
        .withColumn("topic", _clean(F.col("topic")))
    )


def topic_roles(files: DataFrame) -> DataFrame:
    """First occurrence of each (repository, role, topic); vague references give way."""
    found = code_topics(files).unionByName(config_topics(files))
    first = found.groupBy("repo", "role", "topic").agg(
        F.min_by(F.struct("path", "line"), F.struct("walk", "pos")).alias("at"),
        F.min(F.struct("walk", "pos")).alias("first"),
    )
    specific = first.where("role <> 'references'").select("repo", "topic")
    vague = first.where("role = 'references'").join(specific, ["repo", "topic"], "left_anti")
    kept = first.where("role <> 'references'").unionByName(vague.select(first.columns))
    return kept.select(
        "repo", "role", "topic", "at.path", "at.line", order_key(F.col("first.walk"), F.col("first.pos")).alias("ord")
    )


def extract(files: DataFrame) -> Fragments:
    """Topic nodes and the hub's produce / consume / reference edges."""
    # Written once: nodes, hubs and edges all come from these rows.
    topics = cut_lineage(topic_roles(files))
    nodes = topics.select(
        "repo", "ord", F.concat(F.lit("topic::"), "topic").alias("id"), F.col("topic").alias("label"),
        F.lit("kafka_topic").alias("type"),
    )
    hubs = hub_nodes(topics)
    edges = topics.select(
        "repo", "ord", hub_id(F.col("repo")).alias("source"), F.concat(F.lit("topic::"), "topic").alias("target"),
        F.col("role").alias("relation"), F.lit("INFERRED").alias("confidence"),
        F.col("path").alias("source_file"), location(F.col("line")).alias("source_location"),
    )
    return Fragments(
        emit_nodes(nodes, EXTRACTOR).unionByName(emit_nodes(hubs, EXTRACTOR)), emit_edges(edges, EXTRACTOR)
    )
