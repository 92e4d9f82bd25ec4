"""Reason codes: why a row is excluded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_reasons(*rules: tuple[Column, str]) -> Column:
    """Codes of every rule that holds, sorted and comma-joined; empty for an eligible row. A null condition holds not."""
    return F.array_join(F.array_sort(F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in rules]), lambda x: x.isNotNull())), ",")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds; null for an eligible row."""
    return F.coalesce(*[F.when(c, F.lit(code)) for c, code in rules])
