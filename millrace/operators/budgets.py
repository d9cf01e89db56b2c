"""Token budgets of generation requests, as Column expressions (limits are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stage_budget(prompt: Column, context: int = 40960) -> Column:
    """Tokens a stage may write: its prompt's length and 256 more, within the context, 64 at least."""
    return F.greatest(F.lit(64), F.least(F.lit(context) - prompt, prompt + 256))


def teacher_budget(prompt: Column, text: Column, context: int = 32768) -> Column:
    """Tokens a teacher may write: the text's length and 256 more, within the context; null where the prompt leaves no
    room for 64 and the page is not sent."""
    return F.when(prompt + 64 <= context, F.least(F.lit(context) - prompt, text + 256))
