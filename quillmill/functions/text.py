"""Scalar text functions as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as trim and isBlank see it; a regex's own \s is ASCII only.
BLANK = r"[\p{Z}\x09-\x0D\x1C-\x1F]"
#: One token of the word tokenizer with the white space before it.
WORD_TOKEN = r"[ \t\n\r\f]*[^ \t\n\r\f]+"


def trim(col: Column) -> Column:
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(r"[^\p{Z}\x09-\x0D\x1C-\x1F]")


def word_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD_TOKEN), F.lit(0))


def heading_prefix(path: Column) -> Column:
    """``[A > B]`` and a line end, or nothing for an empty path."""
    return F.when(F.size(path) > 0, F.concat(F.lit("["), F.array_join(path, " > "), F.lit("]\n"))).otherwise("")


def section_path(path: Column) -> Column:
    return F.nullif(F.array_join(path, " > "), F.lit(""))


def content_digest(content: Column) -> Column:
    """``sha256:`` and lower-case hex, as stored for sources."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
