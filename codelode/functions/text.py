"""Scalar text functions as Column expressions; hashes that Spark lacks as Arrow UDFs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word: letters, digits and marks; a full stop or apostrophe inside a word does not end it.
WORD = r"[\p{L}\p{N}\p{M}_]+(?:[.'’][\p{L}\p{N}\p{M}_]+)*"
CAMEL = (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})")
MAX_EMBED_CHARS, RERANK_BYTES = 65_536, 4800


def code_tokens(text: Column) -> Column:
    """Words, split at underscores and camelCase boundaries, lower case; null gives null."""
    split_up = text
    for pattern in (CAMEL[0], CAMEL[1]):
        split_up = F.regexp_replace(split_up, pattern, "$1\x1f$2")
    words = F.regexp_extract_all(split_up, F.lit(WORD.replace(r"\p{M}_", "\\p{M}_\x1f")), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.split(w, "[_\x1f]")))
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def token_count(text: Column) -> Column:
    return F.size(code_tokens(text))


def simple_name(target: Column, strict: bool = False) -> Column:
    """Last segment of a reference without generics: `<T as Tr>::m` gives m; then `::`, then `.`.

    strict leaves the `.` alone where a name has no `::`, as stored references are read back."""
    bare = F.regexp_replace(F.regexp_replace(target, r"^.*>::", ""), r"<.*$", "")
    last = F.element_at(F.split(bare, "::"), -1)
    return last if strict else F.element_at(F.split(last, r"\."), -1)


def external_name(target: Column) -> Column:
    """Normalised name of an unresolved dependency: no leading crate:: (repeated), no generics, prefix external::."""
    return F.concat(F.lit("external::"), F.regexp_replace(F.regexp_replace(target, r"^(?:crate::)+", ""), r"<.*$", ""))


def external_package(target: Column) -> Column:
    return F.split_part(F.regexp_replace(external_name(target), "^external::", ""), F.lit("::"), F.lit(1))


def parent_scope(qualified: Column, name: Column) -> Column:
    """qualified without a trailing ::name or .name; null where there is neither."""
    cuts = []
    for sep in ("::", "."):
        tail = F.concat(F.lit(sep), name)
        cuts.append(F.when(F.endswith(qualified, tail), F.substr(qualified, F.lit(1), F.length(qualified) - F.length(tail))))
    return F.coalesce(*cuts)


def sanitize(text: Column) -> Column:
    """No control characters but tab, line feed and carriage return; nothing above U+FFFF; no symbol ranges."""
    return F.regexp_replace(text, r"[\p{Cntrl}&&[^\n\t\r]]|[\x{10000}-\x{10FFFF}]|[\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{E000}-\x{F8FF}]", "")


def truncate_utf8(text: Column, limit: int = RERANK_BYTES) -> Column:
    """At most `limit` bytes, cut between characters, with '...' where something was cut."""
    raw = text.cast("binary")
    # of the four shortest cuts, the first that ends between characters
    cuts = F.array(*[F.substring(raw, 1, limit - k).cast("string") for k in range(4)])
    whole = F.get(F.filter(cuts, lambda x: F.is_valid_utf8(x)), F.lit(0))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit("...")))


def embedding_text(kind: Column, name: Column, qualified: Column, doc: Column, parameters: Column, returns: Column, content: Column) -> Column:
    """`type name qualified[ doc][ p: t]...[ -> ret][ content]`; null parts are left out."""
    written = F.array_join(F.transform(parameters, lambda p: F.concat_ws(": ", p["name"], p["type"])), " ")
    return F.concat_ws(" ", kind, name, qualified, doc, F.nullif(written, F.lit("")), F.concat(F.lit("-> "), returns), content)


# Names of main branches.
MAIN_BRANCHES = ("main", "master", "trunk")


def is_main_branch(name: Column) -> Column:
    return F.lower(name).isin(*MAIN_BRANCHES)


def valid_entity_id(x: Column) -> Column:
    return F.rlike(x, F.lit("^entity-(anon-)?[0-9a-fA-F]{32}$"))


def visible_name(kind: Column) -> Column:
    """Entity type of a rule id: its first two parts decide."""
    rules = {
        "E-MOD": "Module", "E-FN": "Function", "E-METHOD": "Method", "E-STRUCT": "Struct", "E-ENUM-VARIANT": "EnumVariant", "E-ENUM-MEMBER": "EnumVariant", "E-ENUM": "Enum",
        "E-PROPERTY": "Property", "E-INTERFACE": "Interface", "E-TRAIT": "Trait", "E-TYPE-ALIAS": "TypeAlias", "E-IMPL": "Impl", "E-CONST": "Constant", "E-STATIC": "Static",
        "E-UNION": "Union", "E-EXTERN-BLOCK": "ExternBlock", "E-MACRO": "Macro", "E-CLASS": "Class", "E-VAR": "Variable",
    }
    out = F.lit(None).cast("string")
    for prefix in sorted(rules, key=len):
        out = F.when(F.startswith(kind, F.lit(prefix)), rules[prefix]).otherwise(out)
    return out


# How simple look-up questions begin, and phrases that make a question relational.
LOOKUP_PREFIXES = (
    "find the ", "find function ", "find struct ", "find trait ", "find class ", "find method ", "where is ", "show me the ", "what is the ", "locate the ", "get the ",
)
RELATIONAL_WORDS = (
    "calls", "called by", "who calls", "callers", "callees", "implements", "implementors", "inherits", "extends", "uses", "used by", "dependencies", "imports", "related to",
    "connected to", "hierarchy", "all functions that", "all methods that", "everything that",
)


def is_simple_lookup(query: str) -> bool:
    q = query.lower()
    return q.startswith(LOOKUP_PREFIXES) and not any(w in q for w in RELATIONAL_WORDS)


def simple_lookup(query: Column) -> Column:
    """The same of a column: null gives null."""
    q = F.lower(query)
    begins = [F.startswith(q, F.lit(p)) for p in LOOKUP_PREFIXES]
    relational = [F.contains(q, F.lit(w)) for w in RELATIONAL_WORDS]
    return reduce(lambda a, b: a | b, begins) & ~reduce(lambda a, b: a | b, relational)


def xxh3_hex(text: Column) -> Column:
    """32 hex digits of XXH3-128, for identity with stored content hashes; null gives null."""
    import pandas as pd

    def digest(x):
        import xxhash

        return x.map(lambda v: None if v is None else xxhash.xxh3_128_hexdigest(v.encode()))

    digest.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(digest, "string")(text)


def entity_id(repository: Column, path: Column, qualified: Column, kind: Column) -> Column:
    return F.concat(F.lit("entity-"), xxh3_hex(F.concat_ws(":", repository, path, qualified, kind)))


def repository_uuid(path: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, path.rstrip("/") or "/"))


def collection_name(repository_name: Column, repository_id: Column) -> Column:
    """Lower-case letters, digits and underscores of the name, cut to 50, with 8 hex digits of the id's hash."""
    clean = F.regexp_replace(F.lower(repository_name), "[^a-z0-9_]+", "_")
    return F.concat(F.substring(F.regexp_replace(clean, "^_+|_+$", ""), 1, 50), F.lit("_"), F.substring(F.md5(repository_id), 1, 8))


def splade_weight(logit: Column) -> Column:
    return F.log1p(F.greatest(logit, F.lit(0.0)))


def justification(source: Column, score: Column) -> Column:
    """Why an entity is among the results: a search hit with its score, or what the graph added."""
    return F.when(source == "semantic", F.format_string("Semantic match: %.2f", score.cast("double"))).otherwise("Graph context")


def prompt_entry(entity_id: Column, kind: Column, qualified: Column, source: Column, origin: Column, relation: Column, score: Column, content: Column) -> Column:
    """One result as text for a prompt; source: 'semantic' or 'graph' (then from `origin` by `relation`); content is cut at 200 bytes."""
    via = F.when(source == "graph", F.format_string(" [via %s from %s]", relation, origin)).otherwise("")
    head = F.concat(F.lit("["), entity_id, F.lit("] "), kind, F.lit(": "), qualified, via)
    lines = [head, F.format_string("Score: %.2f", score.cast("double")), F.concat(F.lit("Justification: "), justification(source, score))]
    return F.concat_ws("\n", *lines, F.concat(F.lit("Content: "), F.coalesce(truncate_utf8(content, 200), F.lit("N/A"))))


def line_count(location: Column) -> Column:
    return location["end_line"] - location["start_line"] + 1


def lines_overlap(a: Column, b: Column) -> Column:
    return (a["start_line"] <= b["end_line"]) & (b["start_line"] <= a["end_line"])


def lines_contain(a: Column, b: Column) -> Column:
    return (a["start_line"] <= b["start_line"]) & (b["end_line"] <= a["end_line"])


def result_content(content: Column, verbose: bool, rows: Column, total_bytes: Column) -> Column:
    """Whole content when verbose or when at most 5 results of under 8000 bytes; else the first 6 lines."""
    return F.when(F.lit(verbose) | ((rows <= 5) & (total_bytes < 8000)), content).otherwise(F.substring_index(content, "\n", 6))
