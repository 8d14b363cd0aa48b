"""People, units and their links from the roster; registered ORCIDs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink import schemas
from rosterlink.operators.keyed import known_only


def people(roster: DataFrame) -> DataFrame:
    """Distinct people; sorted by first name where written (see :func:`in_name_order`)."""
    created = F.to_timestamp_ntz("creation_date", F.lit(schemas.ROSTER_DATE_FORMAT))
    return roster.select(
        "sciper", "email", "lastname", "firstname", created.alias("creation_date"), "class_acc"
    ).distinct()


def in_name_order(prof: DataFrame) -> DataFrame:
    return prof.orderBy(F.asc_nulls_last("firstname"))


def units(roster: DataFrame) -> DataFrame:
    return roster.select(
        "cf", "unit_name", "unit_type", "cf_level_2", "cf_level_3", "acronym_level_2", "acronym_level_3"
    ).distinct()


def memberships(roster: DataFrame) -> DataFrame:
    return roster.select("sciper", "cf", "role").na.drop("any").distinct()


def registered_orcids(orcid_map: DataFrame, prof: DataFrame) -> DataFrame:
    return known_only(orcid_map, prof, "sciper").select("sciper", "orcid")
