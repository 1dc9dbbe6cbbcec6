"""Phone, label and pattern expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenchlake import constants as K


def is_phone(phone: Column) -> Column:
    """True for a well-formed stored phone number, false otherwise; null stays null."""
    return phone.rlike(K.PHONE_PATTERN)


def has_mask_length(typed: Column) -> Column:
    return F.coalesce(F.length(typed) == K.MASKED_PHONE_LENGTH, F.lit(False))


def strip_mask(typed: Column) -> Column:
    """The stored form of a number typed through the entry mask."""
    return F.translate(typed, K.MASK_CHARACTERS, "")


def normalized_phone(typed: Column) -> Column:
    """The stored form, or null where the typed text does not fill the mask."""
    return F.when(has_mask_length(typed), strip_mask(typed))


def like_anywhere(column: Column, text: str) -> Column:
    """Case-sensitive LIKE '%text%'; % and _ in the text keep their wildcard meaning.

    The text is trimmed, and an empty text keeps every row.
    """
    wanted = text.strip()
    return column.like(f"%{wanted}%") if wanted else F.lit(True)


def contains_literally(column: Column, text: str) -> Column:
    """As like_anywhere, but with no wildcards."""
    wanted = text.strip()
    return column.contains(wanted) if wanted else F.lit(True)


def car_label(model: Column, color: Column, plate: Column) -> Column:
    # format_string would print "null" and concat_ws would drop the piece; keep null visible as null.
    sep = F.lit(K.LABEL_SEPARATOR)
    return F.concat(model, sep, color, sep, plate)


def priced(text: Column, price: Column) -> Column:
    return F.concat(text, F.lit(" ("), price.cast("string"), F.lit(K.CURRENCY_SIGN + ")"))


def part_label(manufacturer: Column, part_name: Column, price: Column) -> Column:
    return priced(F.concat(manufacturer, F.lit(K.LABEL_SEPARATOR), part_name), price)


def service_label(service_name: Column, price: Column) -> Column:
    return priced(service_name, price)


def label_first(label: Column) -> Column:
    return F.element_at(F.split(label, K.LABEL_SEPARATOR), 1)


def label_last(label: Column) -> Column:
    return F.element_at(F.split(label, K.LABEL_SEPARATOR), -1)
