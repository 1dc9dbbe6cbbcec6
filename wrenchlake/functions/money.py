"""Money as whole cents inside aggregates.

Prices turn into cents at catalogue size; line tables then multiply and add plain
longs, which stay in generated code, where wide decimals would not. Overflow of a
long fails the query under ANSI mode instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(20,2)"


def cents(amount: Column) -> Column:
    return (amount * 100).cast("long")


def from_cents(value: Column, as_type: str = AMOUNT) -> Column:
    return (value.cast("decimal(20,0)") / F.lit(100)).cast(as_type)
