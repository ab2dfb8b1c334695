"""Text corpora by page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import strip_whitespace

NO_TEXT = "No extractable text found"


def page_text_corpus(documents: DataFrame, key: Sequence[str], text: str = "text", page_break: str = "\f") -> DataFrame:
    """Rows ``(key, page, text)``: pages numbered from 1, stripped, empty pages left out."""
    pages = F.posexplode(F.split(F.col(text), f"\\Q{page_break}\\E", -1)).alias("place", "page_text")
    split = documents.filter(F.col(text).isNotNull()).select(*key, pages)
    return split.select(*key, (F.col("place") + 1).alias("page"), strip_whitespace(F.col("page_text")).alias("text")).filter(
        F.length("text") > 0
    )


def unreadable_documents(documents: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Rows ``(key, error)`` for documents in which no page has text."""
    blank = F.col(text).isNull() | (F.length(strip_whitespace(F.col(text))) == 0)
    return documents.filter(blank).select(*key, F.lit(NO_TEXT).alias("error"))
