"""Error codes as data: name -> (permanent, place of the stage that raises it)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, permanence and stage order.
ERRORS = {
    "UNSUPPORTED_SCHEMA_VERSION": (True, 1),
    "DOCUMENT_VERSION_NOT_FOUND": (True, 2),
    "DOCUMENT_MISMATCH": (True, 3),
    "DOCUMENT_NOT_FOUND": (True, 4),
    "TENANT_MISMATCH": (True, 5),
    "FILE_TOO_LARGE": (True, 6),
    "DownloadException": (False, 7),
    "HASH_MISMATCH": (True, 8),
    "UNSUPPORTED_MIME_TYPE": (True, 9),
    "CORRUPTED_FILE": (True, 10),
    "ParseTimeoutException": (False, 11),
    "EMPTY_EXTRACTION": (True, 12),
    "CHUNK_LIMIT_EXCEEDED": (True, 13),
    "TOTAL_TOKEN_LIMIT_EXCEEDED": (True, 14),
    "INVALID_EMBEDDING": (True, 15),
    "EMBEDDING_REQUEST_REJECTED": (True, 16),
    "IllegalStateException": (False, 18),
}


def is_permanent(code: Column) -> Column:
    """Whether a code is final; unknown codes are retried."""
    return F.coalesce(code.isin([k for k, (final, _) in ERRORS.items() if final]), F.lit(False))


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first condition that holds, else null."""
    out = None
    for condition, code in checks:
        out = F.when(condition, code) if out is None else out.when(condition, code)
    return out
