"""Table schemas of the engine; never inferred."""

from pyspark.sql import types as T


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
LIST = T.ArrayType(S)
LOCATION = struct(("start_line", L), ("end_line", L), ("start_column", L), ("end_column", L))
REFERENCE = struct(("target", S), ("simple_name", S), ("is_external", B), ("location", LOCATION), ("ref_type", S))
REFERENCES = T.ArrayType(REFERENCE)
SIGNATURE = struct(("parameters", T.ArrayType(struct(("name", S), ("type", S)))), ("return_type", S), ("is_async", B), ("generics", LIST))
METADATA = struct(
    *[(n, B) for n in ("is_async", "is_abstract", "is_static", "is_const", "is_generic")],
    ("generic_params", LIST),
    ("generic_bounds", T.MapType(S, LIST)),
    ("decorators", LIST),
    ("attributes", T.MapType(S, S)),
)
RELATIONSHIPS = struct(
    *[(n, REFERENCES) for n in ("calls", "uses_types", "imports", "reexports", "implements", "extends", "extended_types")],
    ("implements_trait", REFERENCE),
    ("for_type", REFERENCE),
    ("call_aliases", LIST),
)
ENTITIES = struct(
    *[(n, S) for n in ("entity_id", "repository_id", "name", "qualified_name", "path_entity_identifier", "parent_scope", "entity_type", "documentation_summary", "file_path")],
    ("location", LOCATION),
    ("visibility", S),
    ("language", S),
    ("signature", SIGNATURE),
    ("content", S),
    ("metadata", METADATA),
    ("relationships", RELATIONSHIPS),
    ("git_commit_hash", S),
    ("embedding_id", L),
    ("bm25_token_count", I),
    ("indexed_at", TS),
    ("updated_at", TS),
    ("deleted_at", TS),
)
REPOSITORIES = struct(
    *[(n, S) for n in ("repository_id", "repository_path", "repository_name", "collection_name", "git_remote_url", "last_indexed_commit")],
    ("bm25_avgdl", D),
    ("bm25_total_tokens", L),
    ("bm25_entity_count", L),
    ("graph_ready", B),
    ("pending_relationship_resolution", B),
    ("created_at", TS),
)
EMBEDDINGS = struct(
    ("id", L),
    ("repository_id", S),
    ("content_hash", S),
    ("embedding", T.ArrayType(T.FloatType())),
    ("sparse_indices", T.ArrayType(L)),
    ("sparse_values", T.ArrayType(T.FloatType())),
    ("model_version", S),
    ("dimension", I),
    ("created_at", TS),
)
SNAPSHOTS = struct(("repository_id", S), ("file_path", S), ("git_commit_hash", S), ("entity_ids", LIST), ("indexed_at", TS))
OUTBOX = struct(
    *[(n, S) for n in ("outbox_id", "repository_id", "entity_id", "operation", "target_store", "payload")],
    ("created_at", TS),
    ("processed_at", TS),
    ("retry_count", I),
    ("last_error", S),
    ("collection_name", S),
    ("embedding_id", L),
)
EDGES = struct(("repository_id", S), ("src", S), ("dst", S), ("rel_type", S))
EXTERNAL_NODES = struct(("id", S), ("repository_id", S), ("qualified_name", S), ("name", S), ("package", S))
FILE_CHANGES = struct(("path", S), ("change_type", S), ("new_path", S), ("ts", TS))
EVAL_QUERIES = struct(("id", S), ("query", S), ("expected_entity_id", S))
EVAL_RESULTS = struct(("query_id", S), ("rank", I), ("score", D))

# Closed sets of names in the data model.
ENTITY_TYPES = "Function Method Class Struct Interface Trait Enum EnumVariant Module Package Constant Static Variable TypeAlias Macro Impl ExternBlock Union Property".split()
RELATION_TYPES = "CALLS USES IMPLEMENTS ASSOCIATES EXTENDS_INTERFACE INHERITS_FROM IMPORTS REEXPORTS CONTAINS".split()
EXTRA_LABELS = {"Struct": "Class", "Trait": "Interface"}
RENAMED_LABELS = {"Impl": "ImplBlock"}
