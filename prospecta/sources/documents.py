"""Filing documents: index lists, supporting links and the bounded text that parsing sees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta import fixed


def cover_window(text: Column, anchors: Sequence[str] = (fixed.ANCHOR, fixed.FALLBACK_ANCHOR)) -> Column:
    """The text around the first anchor in raw lower-cased text (each anchor in turn), else its start."""
    low = F.lower(F.substring(text, 1, fixed.SCAN_CHARS))
    at = F.coalesce(*[F.nullif(F.locate(a, low), F.lit(0)) for a in anchors])
    begin = F.greatest(F.lit(1), at - fixed.WINDOW_BEFORE)
    return F.when(at.isNotNull(), F.substring(text, begin, at + fixed.WINDOW_AFTER - begin)).otherwise(F.substring(text, 1, fixed.WINDOW_FALLBACK_CHARS))
