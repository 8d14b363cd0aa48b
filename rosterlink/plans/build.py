"""The full build, from landed inputs to a published snapshot."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rosterlink.operators.keyed import require_rows
from rosterlink.plans import authors, embeddings, profiles, publications, publish, records, representatives, roster
from rosterlink.session import configure, staged
from rosterlink.sources import readers, tables


@dataclass
class Inputs:
    """Folders or files of the landed inputs."""

    roster: str
    orcid_map: str
    items: str
    works: str
    authors: str
    person_records: str


def build(
    spark: SparkSession, inputs: Inputs, root: str, year_min: int, year_max: int, as_of_year: int,
    provider: embeddings.Provider, model: str, corrections: DataFrame | None = None,
    timestamp: str | None = None, sample: int | None = None,
) -> str:
    """Build every table under a new snapshot, publish it, return its folder.

    Each table is written once and read back by the steps after it. A failing step raises
    and leaves the published snapshot as it was. The embedding cache lives beside the
    snapshots and only grows.
    """
    configure(spark)
    started = time.time()
    timestamp = timestamp or tables.new_timestamp()
    out = tables.snapshot_root(root, timestamp)

    def save(df: DataFrame, name: str) -> DataFrame:
        return tables.replace_table(df, out, name)

    master = staged(require_rows(readers.read_roster(spark, inputs.roster, sample), "the roster is empty"))
    prof = save(roster.people(master), "prof")
    save(roster.units(master), "lab")
    save(roster.memberships(master), "sciper_lab")
    registered = save(
        roster.registered_orcids(readers.read_orcid_map(spark, inputs.orcid_map), prof), "sciper_orcid_integration"
    )

    items = readers.select_items(readers.read_items(spark, inputs.items), f"{year_min}-01-01", f"{year_max}-12-31")
    first_pub, first_links = publications.publications(items, prof)
    first_pub, first_links = staged(first_pub), staged(first_links)
    works = readers.read_works(spark, inputs.works)
    sciper_openalex = save(
        authors.resolve_authors(
            first_links, first_pub, prof, works, readers.read_authors(spark, inputs.authors), corrections, sample=sample,
        ),
        "sciper_openalex",
    )
    merged, links = publications.merge_works(
        first_pub, first_links, publications.person_works(sciper_openalex, works, year_min, year_max)
    )
    pub, sciper_pub = save(merged, "pub"), save(links, "sciper_pub")

    found = staged(records.person_records(
        readers.read_person_records(spark, inputs.person_records), records.wanted_orcids(sciper_openalex, registered)
    ))
    save(records.profile_rows(found), "orcid")
    save(records.link_rows(found), "orcid_links")

    cache_root = root
    embedded = embeddings.embed_publications(
        pub, tables.read_table_if_any(spark, cache_root, "embedding_cache"), provider, model
    )
    vectors = save(embedded.pub_embedding, "pub_embedding")
    if embedded.computed:
        tables.append_table(embedded.added, cache_root, "embedding_cache")
    save(spark.createDataFrame([(model, embedded.texts, embedded.computed)], tables.schemas.table_schema("embedding_run")), "embedding_run")
    # people that only corrections name have no profile to be found
    of_roster = sciper_pub.join(prof.select("sciper").distinct(), "sciper", "left_semi")
    save(
        representatives.representatives(representatives.person_vectors(of_roster, pub, vectors), as_of_year),
        "representative",
    )
    save(publish.publication_view(pub, sciper_pub, vectors), "publications")
    tables.write_metadata(spark, out, timestamp, time.time() - started)
    tables.publish_snapshot(spark, root, timestamp)
    return out


PROFILE_TABLES = (
    "prof", "lab", "sciper_lab", "sciper_pub", "pub", "sciper_openalex", "sciper_orcid_integration", "orcid", "orcid_links",
)


def open_profiles(spark: SparkSession, root: str, include_centres: bool = False) -> tuple[DataFrame, str]:
    """(profiles, time of the last update) of the published snapshot."""
    snapshot = tables.latest_snapshot(spark, root)
    opened = {name: tables.read_table(spark, snapshot, name) for name in PROFILE_TABLES}
    return profiles.profiles(opened, include_centres), tables.last_update(spark, snapshot)
