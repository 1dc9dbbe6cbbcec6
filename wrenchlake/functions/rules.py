"""Small expressions for dates, lists, reasons and edges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchlake import constants as K


def since(date: Column, as_of: dt.date, days: int = K.RECENT_DAYS) -> Column:
    """True for dates not older than `days` before `as_of`.

    The bound is folded here, so that it reaches the scan as a plain literal.
    """
    return date >= F.lit(as_of - dt.timedelta(days=days))


def is_filled(values: Column) -> Column:
    """True for a list that holds at least one element; false for an empty or null list."""
    return F.coalesce(F.size(values) > 0, F.lit(False))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The code of the first failing check, or null. A check that is null does not fail."""
    return F.coalesce(*[F.when(failed, F.lit(code)) for failed, code in checks])


def own_key(column: str, usable: Column | None = None) -> Column:
    """A join key from a text column, where rows whose text is null or not usable each get one of their own.

    They match nothing, and however many there are, they are dealt over all tasks.
    """
    text = F.col(column) if usable is None else F.when(usable, F.col(column))
    return F.coalesce(text, F.concat(F.lit("\u0000"), F.col("request_id").cast("string")))


def blank(text: Column) -> Column:
    """True for a null or empty text."""
    return F.coalesce(text == "", F.lit(True))


def status_or_fail(status: Column, strict: bool) -> Column:
    """The status itself; in strict mode the first status that is not ok fails the running query."""
    if not strict:
        return status
    return F.when(status == K.OK, status).otherwise(F.raise_error(status).cast("string"))


def plain_types(df: DataFrame) -> DataFrame:
    """Money as double and whole numbers as bigint, for output to readers without decimals.

    Sums are taken in decimal before this point, so the order of addition cannot show.
    """

    def cast(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(field.name).cast("long").alias(field.name)
        return F.col(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])
