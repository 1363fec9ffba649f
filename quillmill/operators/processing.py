"""Processors: what happens to a document's chunks between chunking and publication, as a list of plugs.

A processor takes the chunks of all documents of a batch, with the columns
``CONTEXT`` beside each chunk's own, and returns them with whatever it adds or
changes; a row with an ``embedding_error`` is its document's failure, and
``error_message`` may say more.  The last one must have added ``embedding``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import DEFAULT
from . import embedding

Processor = Callable[[DataFrame], DataFrame]
#: A job's columns that a processor finds beside the chunk's.
CONTEXT = ("source_event_id", "document_id", "document_version_id", "version_no")


def embedder(provider: embedding.Provider | None = None, *, dimensions: int = DEFAULT.dimensions) -> Processor:
    """The default: a vector from ``provider`` for each chunk, checked."""
    return lambda rows: embedding.embed_and_validate(rows, provider or embedding.hash_provider(dimensions), dimensions=dimensions)


def each_document(process: Callable[[dict, list[dict]], list[dict]], *, adds: str = "embedding array<float>") -> Processor:
    """A processor from a function of one document: (context, its chunks in order) -> its chunks, as dicts.

    What the function raises is that document's failure, by its class's name and
    message, and is tried again unless the code is final; its chunks stay as they were.  A
    document's chunks, of which there is a limit, meet in one task.
    """

    def run(rows: DataFrame) -> DataFrame:
        extra = [f for f in T._parse_datatype_string(adds).fields if f.name not in rows.columns]
        errors = [T.StructField(c, T.StringType()) for c in ("embedding_error", "error_message") if c not in rows.columns]
        schema = T.StructType([*rows.schema.fields, *extra, *errors])
        arrow, given = to_arrow_schema(schema), rows.columns

        def work(table: pa.Table) -> pa.Table:
            chunks = sorted(table.to_pylist(), key=lambda c: c["chunk_no"])
            context = {c: chunks[0][c] for c in CONTEXT}
            try:
                done = [dict(c) for c in process(context, [{k: v for k, v in c.items() if k not in CONTEXT} for c in chunks])]
                code = message = None
            except Exception as error:  # whatever a processor raises is its document's
                done, code, message = [{k: c[k] for k in given} for c in chunks], embedding.error_code(error), str(error)
            for c in done:
                c |= context | {"embedding_error": code or c.get("embedding_error"), "error_message": message or c.get("error_message")}
            return pa.Table.from_pylist([{k: c.get(k) for k in arrow.names} for c in done], arrow)

        return rows.groupBy("source_event_id").applyInArrow(work, schema)

    return run


def run_all(rows: DataFrame, processors: list[Processor]) -> DataFrame:
    """``rows`` through each processor in turn, with ``embedding_error`` and ``error_message``; what failed in one goes on to the next, and its first error counts."""
    for process in processors:
        before = [c for c in ("embedding_error", "error_message") if c in rows.columns]
        rows = rows.withColumnsRenamed({c: f"__{c}" for c in before})
        rows = process(rows)
        for c in before:
            now = F.col(c) if c in rows.columns else F.lit(None).cast("string")
            rows = rows.withColumn(c, F.coalesce(F.col(f"__{c}"), now)).drop(f"__{c}")
    for c in ("embedding_error", "error_message"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows
