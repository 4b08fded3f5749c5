"""Fixed schemas. Nothing is inferred."""

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE_FILES = _struct(repo_id=_S, rel_path=_S, content=_S)

PARAMETER = _struct(name=_S, annotation=_S, default_value=_S)

ENTITY = _struct(
    entity_type=_S,             # function | method | class
    owner_class=_S,             # nearest enclosing class, NULL outside classes
    name=_S,
    qualname=_S,
    ordinal=T.IntegerType(),    # order of definition, inner before outer
    is_latest=T.BooleanType(),  # not replaced by a later definition of the same key
    lineno=T.IntegerType(),
    end_lineno=T.IntegerType(),
    docstring=_S,
    return_annotation=_S,
    decorators=T.ArrayType(_S),
    bases=T.ArrayType(_S),
    parameters=T.ArrayType(PARAMETER),
    scope_ix=T.IntegerType(),   # position in `scopes` of the entity's relationship record, or NULL
    owner_qualname=_S,          # tells classes of one name within different owners apart
)

FACT_KINDS = ["calls", "imports", "inherits_from", "reads_from", "writes_to", "raises", "catches"]

TYPE_HINT = _struct(param=_S, annotation=_S)

SCOPE = _struct(
    scope=_S,
    defined_in=_S,
    **{kind: T.ArrayType(_S) for kind in FACT_KINDS},   # each a sorted set
    type_hints=T.ArrayType(TYPE_HINT),
)

IMPORT = _struct(import_type=_S, target=_S, ordinal=T.IntegerType())

# Definitions that count, for statistics.
COUNTS = _struct(n_classes=T.IntegerType(), n_functions=T.IntegerType(), n_methods=T.IntegerType())

NODE = _struct(node_type=_S, node_ordinal=T.IntegerType(), name=_S)

# One row per source file. Everything about a file is together in its row, so
# questions about single files need no shuffle.
MODULE_FACTS = _struct(
    repo_id=_S,
    rel_path=_S,
    raw_code=_S,
    docstring=_S,
    error=_S,
    n_lines_removed=T.IntegerType(),
    entities=T.ArrayType(ENTITY),
    scopes=T.ArrayType(SCOPE),
    imports=T.ArrayType(IMPORT),
    node_map=T.ArrayType(NODE),
)

MESSAGES = T.ArrayType(_struct(role=_S, content=_S))

CACHE_LOG = _struct(
    query_hash=_S,
    prompt_b64=_S,
    response_b64=_S,
    ts=T.TimestampNTZType(),
    metadata=_S,
    seq=T.LongType(),
    op=_S,                      # put | delete | clear (all before its ts and seq)
    hash_prefix=_S,             # first two hex digits
)
