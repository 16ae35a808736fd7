"""Prompts of the reader and of the merge judge as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What the reader is told.
READER = "Answer from the context alone, with the shortest words of it that answer the question, copied as they are, and nothing else."


def reader(question: Column, context: Column) -> Column:
    """Fixed form: context, then question, then the cue that ``clean_answer`` takes off."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def _side(name: str, text: Column, article: Column, around: Column) -> Column:
    return F.concat(F.lit(f'{name}: "'), text, F.lit('"\n   in ('), article, F.lit('): "'), around, F.lit('"\n'))


def judge(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Two mentions, each (text, article, context), and the question that ``parse_label`` reads."""
    return F.concat(_side("A", *a), _side("B", *b), F.lit("\nSAME, RELATED or DIFFERENT?"))
