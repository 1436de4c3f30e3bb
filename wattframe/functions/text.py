"""Sentence assembly and answer clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences of ten characters or fewer are dropped, three are kept.
MIN_SENTENCE = 10
MAX_SENTENCES = 3
ANSWER_MARK = "\nA:"

# Fixed value: reply where nothing is left of an answer.
EMPTY_ANSWER = "I'm not sure how to answer that question based on the available market data."

_SLOT = re.compile(r"\{(\w+)\}")

# Every character that counts as white space.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def fill(template: str, **slots: Column) -> Column:
    """Template text with ``{name}`` slots filled from columns."""
    pieces = _SLOT.split(template)
    parts = [
        slots[piece] if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts)


def strip(text: Column) -> Column:
    """Trim white space on both sides."""
    return F.btrim(text, F.lit(BLANKS))


def after_last_mark(text: Column, mark: str = ANSWER_MARK, prompt: Column | None = None) -> Column:
    """What follows the last mark; without one the text, or what follows its ``prompt``."""
    whole = text
    if prompt is not None:
        whole = F.substring(text, F.char_length(F.coalesce(prompt, F.lit(""))) + 1, F.char_length(text))
    return strip(F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1)).otherwise(whole))


def clean_answer(text: Column) -> Column:
    """Keep the first three different sentences longer than ten characters."""
    sentences = F.transform(F.split(text, r"\."), strip)
    long_enough = F.filter(sentences, lambda s: F.char_length(s) > MIN_SENTENCE)
    kept = F.slice(F.array_distinct(long_enough), 1, MAX_SENTENCES)
    joined = F.array_join(kept, ". ")
    return F.when(joined == "", joined).otherwise(F.concat(joined, F.lit(".")))
