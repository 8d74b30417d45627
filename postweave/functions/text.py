"""Word splitting as a column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of letters and digits, or one punctuation mark or symbol.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Lower-cased words and single punctuation marks, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
