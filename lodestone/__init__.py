"""Semantic code retrieval on Spark DataFrames.

Source trees or text tables become entities, entities become bounded chunks,
chunks become vectors, and batches of queries are answered, scored and
measured. Every stage takes DataFrames and returns DataFrames.
"""

from lodestone.config import SearchConfig

__all__ = ["SearchConfig"]
