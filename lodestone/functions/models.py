"""Plug points for models, and deterministic stand-ins of this engine.

A model is a factory; each Python worker calls it once and applies what it returns to Arrow
batches. The stand-ins keep queries runnable without models: hashed bag-of-words vectors,
capitalised words as entities, and a lexical reranker. They are this engine's own definitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T


def model_column(factory: Callable[[], Callable[[list], list]], kind: str) -> Callable[[Column], Column]:
    """A column function of a model that maps a list of texts to a list of results; loaded once for each task."""
    import pandas as pd

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            yield pd.Series(list(model([t or "" for t in texts])), dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Counts of words by hash, as an array of floats."""
    slots = F.transform(T.words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def capitalised_entities(text: Column) -> Column:
    """Distinct capitalised words of three letters and more."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\p{Lu}\p{L}{2,}"), F.lit(0))))


def lexical_rerank(query: Column, text: Column) -> Column:
    """Token F1 of question and text."""
    return T.lexical_overlap(query, text)
