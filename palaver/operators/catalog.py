"""Channel catalog of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators import clean

OTHER = "Other"


def channels(catalog_raw: DataFrame) -> DataFrame:
    """Distinct channels of ``(seq, section, channels)``; the section listed first keeps a channel."""
    listed = catalog_raw.select(
        "seq",
        F.coalesce("section", F.lit(OTHER)).alias("section"),
        F.posexplode("channels").alias("pos", "channel"),
    )
    return clean.first_seen(listed, ("channel",), ("seq", "pos")).select("section", "channel")


def listing(catalog: DataFrame) -> DataFrame:
    """Sections in order, channels in order within; empty sections do not occur.

    One row per channel with the size of its section.
    """
    sizes = catalog.groupBy("section").agg(F.count(F.lit(1)).alias("n_channels"))
    return catalog.join(sizes, "section").orderBy("section", "channel")


def total(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count_distinct("channel").alias("n_channels"), F.count_distinct("section").alias("n_sections"))
