"""Distances, destination centroids and map coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import place
from freightnet.operators.tables import MISCODED_PLACE, OFF_NETWORK_STATES, on_network, widen


def clean_distances(raw: DataFrame) -> DataFrame:
    """(Orig, Dest, Miles) of on-network destinations."""
    kept = on_network(raw, "de.City", "de.State").withColumn("Dest", place("`de.City`", "`de.State`"))
    return kept.select(F.col("`or.City`").alias("Orig"), "Dest", F.col("Miles").cast("double").alias("Miles"))


def distance_drops() -> dict[str, Column]:
    """Why ``clean_distances`` leaves a row out, first reason first."""
    city, state = F.col("`de.City`"), F.col("`de.State`")
    return {
        "null_key": state.isNull(),
        "off_network_state": state.isin(*OFF_NETWORK_STATES),
        "miscoded_place": (city == MISCODED_PLACE[0]) & (state == MISCODED_PLACE[1]),
    }


def distances_wide(dist: DataFrame, sites: Sequence[str]) -> DataFrame:
    """One row per destination, one column of miles per site."""
    return widen(dist, ["Dest"], "Orig", sites, "Miles")


def dest_centroids(geocodes: DataFrame) -> DataFrame:
    """One coordinate per destination, so that later joins never fan out."""
    located = geocodes.withColumn("Dest", place("MSTCity", "MSTState"))
    return located.groupBy("Dest").agg(
        F.avg(F.col("lat").cast("double")).alias("lat"), F.avg(F.col("lon").cast("double")).alias("lon")
    )
