"""Client contacts: matching, appending, changing phones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.functions.rules import blank, first_reason, own_key
from wrenchlake.functions.text import has_mask_length, is_phone, normalized_phone, strip_mask
from wrenchlake.operators.ordered import HOT_ROWS, row_numbers


class Changed(NamedTuple):
    table: DataFrame
    statuses: DataFrame


class Appended(NamedTuple):
    table: DataFrame
    added: DataFrame
    rejects: DataFrame


def match_contacts(requests: DataFrame, clients: DataFrame, mechanics: DataFrame) -> DataFrame:
    """(request_id, typed_phone, role) → the person's id in the chosen role, and a status."""
    people = (
        clients.select(F.lit("client").alias("role"), "phone", F.col("client_id").alias("person_id"))
        .unionByName(
            mechanics.select(
                F.lit("mechanic").alias("role"),
                F.col("phone_number").alias("phone"),
                F.col("mechanic_id").alias("person_id"),
            )
        )
        .groupBy("role", "phone")
        .agg(F.min("person_id").alias("person_id"))
    )
    asked = requests.withColumn("phone", normalized_phone(F.col("typed_phone")))
    status = first_reason((F.col("phone").isNull(), K.BAD_PHONE), (F.col("person_id").isNull(), K.CLIENT_NOT_FOUND))
    people = people.withColumnRenamed("phone", "__phone")
    return asked.withColumn("__phone", own_key("phone")).join(people, ["role", "__phone"], "left").select(
        "request_id", "role", "phone", "person_id", F.coalesce(status, F.lit(K.OK)).alias("status")
    )


def append_clients(requests: DataFrame, clients: DataFrame, hot_rows: int = HOT_ROWS) -> Appended:
    """(request_id, full_name, typed_phone) → clients with the new ones, ids following the highest one."""
    phone = F.col("typed_phone")
    reason = first_reason(
        (~has_mask_length(phone), K.BAD_PHONE),
        (blank(F.col("full_name")) | blank(strip_mask(phone)), K.MISSING_FIELD),
    )
    checked = requests.withColumn("reason", reason).withColumn("phone", strip_mask(phone))
    numbered = row_numbers(
        checked.filter(F.col("reason").isNull()), [], ["request_id"], "nth", hot_rows
    )
    last_id = clients.agg(F.coalesce(F.max("client_id"), F.lit(0)).alias("last_id"))
    added = numbered.select((last_id.scalar() + F.col("nth")).alias("client_id"), "full_name", "phone")
    return Appended(
        table=clients.unionByName(added),
        added=added,
        rejects=checked.filter(F.col("reason").isNotNull()).select("request_id", "reason"),
    )


def update_phones(requests: DataFrame, clients: DataFrame) -> Changed:
    """(request_id, client_id, new_phone) → clients afterwards, and a status per request.

    The number must be well formed and must not belong to any client, its own
    number included; of requests for one free number the first by request_id takes
    it. A request for an unknown client succeeds and takes nothing. Numbers given up
    by this batch are free for the next one.
    """
    taken = clients.select(F.col("phone").alias("__phone")).distinct().withColumn("held", F.lit(True))
    known = clients.select("client_id").withColumn("known", F.lit(True))
    format_ok = F.coalesce(is_phone(F.col("new_phone")), F.lit(True))
    keyed = requests.withColumn("__phone", own_key("new_phone", format_ok))
    asked = keyed.join(taken, "__phone", "left").join(known, "client_id", "left")
    eligible = format_ok & F.col("held").isNull()
    takers = (
        asked.filter(eligible & F.col("known") & F.col("new_phone").isNotNull())
        .groupBy("__phone")
        .agg(F.min("request_id").alias("taker"))
    )
    reason = first_reason(
        (~format_ok, K.BAD_PHONE),
        (F.col("held") | (F.col("taker") < F.col("request_id")), K.PHONE_TAKEN),
    )
    judged = asked.join(takers, "__phone", "left").withColumn("status", F.coalesce(reason, F.lit(K.OK)))
    last = (
        judged.filter((F.col("status") == K.OK) & F.col("known"))
        .groupBy("client_id")
        .agg(F.max(F.struct("request_id", "new_phone")).alias("change"))
    )
    phone = F.when(F.col("change").isNotNull(), F.col("change.new_phone")).otherwise(F.col("phone"))
    table = clients.join(last, "client_id", "left").withColumn("phone", phone).select(*clients.columns)
    return Changed(table=table, statuses=judged.select("request_id", "client_id", "new_phone", "status"))


def validate_phones(phones: DataFrame) -> DataFrame:
    """(…, phone) → the same with `valid`; an unknown phone is not valid."""
    return phones.withColumn("valid", F.coalesce(is_phone(F.col("phone")), F.lit(False)))


def normalize_phones(typed: DataFrame) -> DataFrame:
    """(…, typed_phone) → the same with the stored form, null where the mask is not filled."""
    return typed.withColumn("phone", normalized_phone(F.col("typed_phone")))
