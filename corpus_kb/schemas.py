"""Explicit schemas of the knowledge-base tables."""

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in cols.items()])


_S, _L, _D, _TS, _B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()

FILES = _struct(repo=_S, rel=_S, language=_S, size=_L)
OUTLINE = _struct(rel=_S, line=_L, kind=_S, name=_S)
PAGES = _struct(path=_S, title=_S, page_type=_S, description=_S, body_hash=_S, evidence_hash=_S, run_id=_S)
CHUNKS = _struct(
    chunk_id=_S, page_path=_S, ord=_L, title=_S, summary=_S, body=_S,
    start_line=_L, end_line=_L, source=_S,
)
POSTINGS = _struct(gram=_S, chunk_id=_S, tf=_L)
CLAIMS = _struct(page_path=_S, statement=_S, evidence=T.ArrayType(_S), status=_S, run_id=_S)
ENTITIES = _struct(
    id=_S, kind=_S, name=_S, canonical_key=_S, props=T.MapType(_S, _S), status=_S, updated_run=_S,
)
RELATIONS = _struct(src=_S, dst=_S, rel=_S, props=T.MapType(_S, _S), confidence=_D, run_id=_S)
RUNS = _struct(
    run_id=_S, mode=_S, status=_S, git_head=_S, provider=_S, model=_S, language=_S,
    prompt_tokens=_L, completion_tokens=_L, cost=T.DecimalType(18, 6), error=_S,
    created_at=_TS, finished_at=_TS,
)
CALLS = _struct(
    run_id=_S, stage=_S, provider=_S, model=_S, prompt_tokens=_L, completion_tokens=_L,
    cached_tokens=_L, latency_ms=_L, status=_S, created_at=_TS,
)
CONVERSATIONS = _struct(conv_id=_L, turn=_L, role=_S, text=_S)
EVENTS = _struct(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S)
DOCUMENTS = _struct(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L)
HIGH_WATER_MARK = _struct(updated_at=_TS, command=_S, git_head=_S, model=_S, run_id=_S, language=_S)

# one item of a model's chunking answer
MODEL_CHUNKS = T.ArrayType(_struct(title=_S, summary=_S, body=_S, start_line=_L, end_line=_L))
# one page's claims sidecar
CLAIMS_SIDECAR = T.StructType([
    T.StructField("page", _S),
    T.StructField("claims", T.ArrayType(_struct(statement=_S, evidence=T.ArrayType(_S), status=_S))),
    T.StructField("updated_at", _S),
])
