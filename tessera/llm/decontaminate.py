"""Benchmark decontamination: size-partitioned MinHash containment search.

A document is contaminated by an item if it holds at least 0.8 of the item's
distinct five-word shingles (see windows.py for the search and its bounds).
An item of one to four words is one shingle of its own width, found wherever a
document holds that run of words. Defined results: null or empty texts on either side
match nothing; repeated documents give repeated rows, repeated items (equal id and text) count once; empty tables
give no rows; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import found_in, without


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment, first_word of every leaked item."""
    out = found_in(docs, benchmark, "item_id")
    return out.select(
        "doc_id", "item_id", F.col("shingles").alias("item_shingles"), "shared", (F.col("shared") / F.col("shingles")).alias("containment"), "first_word"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item has leaked into."""
    return without(docs, benchmark, "item_id")
