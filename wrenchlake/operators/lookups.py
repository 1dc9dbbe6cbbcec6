"""Name-to-id lookups, answered for whole request tables at once.

A name may be carried by several catalogue rows; the lowest id stands for it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.functions.rules import status_or_fail
from wrenchlake.operators.references import join_references


class Resolved(NamedTuple):
    found: DataFrame
    rejects: DataFrame


def parts_by_ref(parts: DataFrame) -> DataFrame:
    """One catalogue row per (part_name, manufacturer): the one with the lowest id."""
    first = F.min(F.struct("part_id", "price", "stock_quantity")).alias("first")
    return parts.groupBy("part_name", "manufacturer").agg(first).select("part_name", "manufacturer", "first.*")


def services_by_name(services: DataFrame) -> DataFrame:
    """One catalogue row per service name: the one with the lowest id."""
    first = F.min(F.struct("service_id", "price")).alias("first")
    return services.groupBy("service_name").agg(first).select("service_name", "first.*")


def lookup_part_ids(requests: DataFrame, parts: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, part_name, manufacturer) → the same with part_id and a status."""
    refs = parts_by_ref(parts).select("part_name", "manufacturer", "part_id")
    status = F.when(F.col("part_id").isNull(), K.PART_NOT_FOUND).otherwise(K.OK)
    answered = join_references(requests, refs, ["part_name", "manufacturer"]).withColumn(
        "status", status_or_fail(status, strict)
    )
    return answered.select("request_id", "part_name", "manufacturer", "part_id", "status")


def lookup_service_ids(requests: DataFrame, services: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, service_name) → the same with service_id and a status."""
    names = services_by_name(services).select("service_name", "service_id")
    status = F.when(F.col("service_id").isNull(), K.SERVICE_NOT_FOUND).otherwise(K.OK)
    answered = requests.join(names, "service_name", "left").withColumn("status", status_or_fail(status, strict))
    return answered.select("request_id", "service_name", "service_id", "status")


def _null_lists(requests: DataFrame, column: str) -> DataFrame:
    return requests.filter(F.col(column).isNull()).select(
        "request_id", F.lit(None).cast("int").alias("pos"), F.lit(K.NULL_LIST).alias("reason")
    )


def resolve_part_list(requests: DataFrame, parts: DataFrame) -> Resolved:
    """(request_id, parts: array of (part_name, manufacturer)) → one row per element found.

    Elements keep their position, repeats are kept, misses go to the rejects.
    """
    elements = requests.select("request_id", F.posexplode("parts").alias("pos", "part")).select(
        "request_id", "pos", "part.part_name", "part.manufacturer"
    )
    refs = parts_by_ref(parts).select("part_name", "manufacturer", "part_id")
    # One name that nobody carries may be asked for by most requests.
    answered = join_references(elements, refs, ["part_name", "manufacturer"])
    missing = answered.filter(F.col("part_id").isNull()).select(
        "request_id", "pos", F.lit(K.PART_NOT_FOUND).alias("reason")
    )
    return Resolved(
        found=elements.join(refs, ["part_name", "manufacturer"]).select(
            "request_id", "pos", "part_id", "part_name", "manufacturer"
        ),
        rejects=missing.unionByName(_null_lists(requests, "parts")),
    )


def resolve_service_list(requests: DataFrame, services: DataFrame) -> Resolved:
    """(request_id, service_names: array of text) → one row per name found, misses to the rejects."""
    elements = requests.select("request_id", F.posexplode("service_names").alias("pos", "service_name"))
    names = services_by_name(services).select("service_name", "service_id")
    missing = elements.join(names, "service_name", "left_anti").select(
        "request_id", "pos", F.lit(K.SERVICE_NOT_FOUND).alias("reason")
    )
    return Resolved(
        found=elements.join(names, "service_name").select("request_id", "pos", "service_name", "service_id"),
        rejects=missing.unionByName(_null_lists(requests, "service_names")),
    )
