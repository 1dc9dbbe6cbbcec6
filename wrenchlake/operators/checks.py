"""Write checks of filtered views: which new rows a view would accept."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K


class Checked(NamedTuple):
    accepted: DataFrame
    rejects: DataFrame


def check_option(rows: DataFrame, own: Column, parents: list[Column], cascaded: bool) -> Checked:
    """Split rows written through a view by its predicate.

    Local checks the view's own predicate, cascaded also those of the views below it. A
    null predicate does not accept.
    """
    passes = F.coalesce(own, F.lit(False))
    if cascaded:
        for parent in parents:
            passes = passes & F.coalesce(parent, F.lit(False))
    return Checked(
        accepted=rows.filter(passes),
        rejects=rows.filter(~passes).withColumn("reason", F.lit(K.CHECK_FAILED)),
    )
