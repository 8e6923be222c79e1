"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import rules


def lit_map(mapping: dict) -> Column:
    """A map literal."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blank(col: Column) -> Column:
    """Null or empty string."""
    return F.coalesce(col, F.lit("")) == ""


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def none_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, '' when there is none."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Directory part of a path, '.' for a file at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def walk_key(path: Column) -> Column:
    """Sort key that orders paths as a directory walk does: component by component."""
    return F.translate(path, "/", "\u0001")


def contains_any(col: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | col.contains(needle)
    return hit


def in_scope(repo: Column, repos) -> Column:
    """Repository scope: an empty list means all, a list drops rows without a repo."""
    return repo.isin(*repos) if repos else F.lit(True)


def entity_labels(label: Column) -> Column:
    return F.array(F.lit("Entity"), label)


def share(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def distinct_list(col: Column) -> Column:
    """Sorted distinct non-null values of a group."""
    return F.sort_array(F.collect_set(col))


# --- symbols -------------------------------------------------------------


def normalize_symbol(text: str) -> str:
    """Trim, cut a call suffix, lower-case."""
    text = text.strip()
    cut = text.find("(")
    if cut > 0:
        text = text[:cut].strip()
    return text.lower()


def symbol_spellings(text: str) -> list[str]:
    """Stored spellings a typed symbol may have: bare, called, and receiver-dotted."""
    base = normalize_symbol(text).removeprefix(".")
    if base == "":
        return [base]
    stems = [base] if base.endswith(")") else [base, base + "()"]
    return stems + ["." + s for s in stems]


def normalize_symbol_col(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.lower(F.trim(F.regexp_replace(trimmed, r"^([^(]+)\([\s\S]*$", "$1")))


def symbol_spellings_col(text: Column) -> Column:
    base = F.regexp_replace(normalize_symbol_col(text), r"^\.", "")
    dotted = F.concat(F.lit("."), base)
    return (
        F.when(base == "", F.array(base))
        .when(base.endswith(")"), F.array(base, dotted))
        .otherwise(
            F.array(base, F.concat(base, F.lit("()")), dotted, F.concat(dotted, F.lit("()")))
        )
    )


def named(entity_name: Column, norm_name: Column, symbol: str) -> Column:
    names = symbol_spellings(symbol)
    return entity_name.isin(*names) | norm_name.isin(*names)


# --- inference -----------------------------------------------------------


def infer_label(node_type: Column, kind: Column, source_file: Column, label: Column) -> Column:
    """Entity label of a raw node, first rule that matches."""
    label = or_empty(label)
    by_type = lit_map(rules.TYPE_LABELS)[or_empty(node_type)]
    by_kind = lit_map(rules.KIND_LABELS)[or_empty(kind)]
    return (
        F.when(by_type.isNotNull(), by_type)
        .when(by_kind.isNotNull(), by_kind)
        .when(F.lower(source_file).rlike(r"\.(md|mdx|rst)$"), "DocSection")
        .when(label.rlike(r"\.(go|kt|sh|py|md|ya?ml|json|toml)$"), "File")
        .when(label.endswith("()"), "Function")
        .when(label.rlike(r"^\p{Lu}[^( ]*$"), "Class")
        .otherwise("Symbol")
    )


def map_relation(verb: Column) -> Column:
    """Edge type of a relation verb, null when the verb is not allowed."""
    return lit_map(rules.RELATION_TYPES)[or_empty(verb)]


def is_shared(origin: Column, node_id: Column) -> Column:
    return (or_empty(origin) == "platform") & or_empty(node_id).rlike(
        "^(" + "|".join(rules.SHARED_PREFIXES) + ")"
    )


def stable_key(
    repo: Column, origin: Column, source_file: Column, label: Column, node_id: Column
) -> Column:
    parts = [or_empty(c) for c in (repo, source_file, label, node_id)]
    return F.when(
        or_empty(origin) == "platform", F.concat(F.lit("platform::"), or_empty(node_id))
    ).otherwise(F.sha1(F.concat_ws("::", *parts)))


def infer_language(language: Column, source_file: Column) -> Column:
    """Declared language, else by extension, null when unknown."""
    ext = F.regexp_extract(F.lower(or_empty(source_file)), r"\.[^.]*$", 0)
    return F.coalesce(none_if_empty(language), lit_map(rules.EXTENSION_LANGUAGES)[ext])


def default_confidence(confidence: Column) -> Column:
    return F.when(blank(confidence), F.lit("EXTRACTED")).otherwise(confidence)


def default_score(score: Column, confidence: Column) -> Column:
    tier = lit_map(rules.CONFIDENCE_SCORES)[default_confidence(confidence)]
    return F.when(F.coalesce(score, F.lit(0.0)) == 0.0, F.coalesce(tier, F.lit(0.0))).otherwise(
        score
    )


def default_weight(weight: Column) -> Column:
    return F.when(F.coalesce(weight, F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(weight)


def content_hash(columns: dict[str, Column]) -> Column:
    """Short hash over named values, whatever their order; JSON renders lists and nulls."""
    row = F.struct(*[value.alias(name) for name, value in sorted(columns.items())])
    return F.substring(F.sha2(F.to_json(row), 256), 1, 16)


def cap_context(context: Column) -> Column:
    return F.substring(context, 1, rules.CONTEXT_MAX)


def normalize_remote(url: Column) -> Column:
    """Comparable host/path form of a git remote."""
    text = F.lower(F.trim(or_empty(url)))
    scp = text.rlike(r"^[^@]*@[^:]*:")
    without_scheme = (
        F.when(text.contains("://"), F.regexp_replace(text, r"^[\s\S]*?://", ""))
        .when(
            scp,
            F.regexp_replace(F.regexp_replace(text, r"^[^@]*@", ""), r"^([^:]*):", "$1/"),
        )
        .otherwise(text)
    )
    without_user = F.regexp_replace(without_scheme, r"^[^/]*@(?=[^/@]*/)", "")
    for suffix in (r"/$", r"\.git$", r"/$"):
        without_user = F.regexp_replace(without_user, suffix, "")
    return without_user
