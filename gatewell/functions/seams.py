"""Pairs of the texts of one row, as they would stand side by side, in native functions.

A seam is a text's last characters, a space and another's first; closed, the same without the space and the punctuation
around it. functions/scan.py screens the seams of a request.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewell.functions.scan import MOST


def pair(first: Column, second: Column, window: int = MOST) -> Column:
    """array<string>: the open and the closed seam of two texts."""
    tail, head = F.right(first, F.lit(window)), F.left(second, F.lit(window))
    signs = "[ \\t\\r\\n.,;:!?]+"
    closed = F.concat(F.regexp_replace(tail, f"{signs}\\z", ""), F.regexp_replace(head, f"^{signs}", ""))
    return F.array(F.concat(tail, F.lit(" "), head), closed)


def all_pairs(texts: Column, window: int = MOST) -> Column:
    """array<string>: the distinct seams of all ordered pairs of different places that hold text."""
    bounded = F.filter(texts, lambda t: F.length(t) > 0)
    beside = lambda them: lambda a, i: F.flatten(F.array_compact(F.transform(them, lambda b, j: F.when(i != j, pair(a, b, window)))))
    return F.element_at(F.transform(F.array(bounded), lambda them: F.array_distinct(F.flatten(F.transform(them, beside(them))))), 1)


