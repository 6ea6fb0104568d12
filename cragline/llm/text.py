"""Small shared text expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words, as a character class body, and a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row (lambda variables are never inlined)."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def give_back_memory() -> None:
    """Returns what a task's Python has freed to the system, for its process goes on to other work beside new ones."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
