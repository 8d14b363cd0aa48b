"""Schemas of the landed inputs and of the published tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- landed inputs ---------------------------------------------------------------

# The header of the roster file and the column each field becomes.
ROSTER_FIELDS = {
    "N° sciper": ("sciper", "long"),
    "email interne unique (1par ligne)": ("email", "string"),
    "Nom Sciper": ("lastname", "string"),
    "Prénom Sciper": ("firstname", "string"),
    "date création": ("creation_date", "string"),
    "classe acc.": ("class_acc", "string"),
    "CF unité": ("cf", "long"),
    "Nom unité": ("unit_name", "string"),
    "fonction acc.": ("role", "string"),
    "Type unité": ("unit_type", "string"),
    "CF niveau 2": ("cf_level_2", "long"),
    "CF niveau 3": ("cf_level_3", "long"),
    "Sigle niveau 2": ("acronym_level_2", "string"),
    "Sigle niveau 3": ("acronym_level_3", "string"),
}

# Fixed value: date layout of the roster file.
ROSTER_DATE_FORMAT = "yyyy/MM/dd HH:mm:ss"

ORCID_MAP = "map<string,struct<orcid:string>>"

REPOSITORY_ITEM = "metadata map<string,array<struct<value:string>>>"

# Metadata fields of a repository item.
ITEM_PEOPLE = "cris.virtual.sciperId"
ITEM_URI = "dc.identifier.uri"
ITEM_DOI = "dc.identifier.doi"
ITEM_TITLE = "dc.title"
ITEM_ABSTRACT = "dc.description.abstract"
ITEM_ISSUED = "dc.date.issued"
ITEM_ENTITY = "dspace.entity.type"
ITEM_ENTITY_PUBLICATION = "publication"

# Work types taken from the second source.
WORK_TYPES = ("article", "book", "book-chapter")

WORK = (
    "id string, doi string, title string, publication_year int, type string, "
    "abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<id:string,display_name:string>>>"
)

AUTHOR = "id string, display_name string, display_name_alternatives array<string>, orcid string, works_count long"

PERSON_RECORD = (
    "`orcid-identifier` struct<path:string>, "
    "history struct<claimed:boolean>, "
    "person struct<"
    "name:struct<`given-names`:struct<value:string>,`family-name`:struct<value:string>>,"
    "`other-names`:struct<`other-name`:array<struct<content:string>>>,"
    "emails:struct<email:array<struct<email:string>>>,"
    "biography:struct<content:string>,"
    "keywords:struct<keyword:array<struct<content:string>>>,"
    "`researcher-urls`:struct<`researcher-url`:array<struct<`url-name`:string,url:struct<value:string>>>>,"
    "`external-identifiers`:struct<`external-identifier`:array<struct<"
    "`external-id-type`:string,`external-id-value`:string,`external-id-url`:struct<value:string>>>>>"
)

# ---- published tables ------------------------------------------------------------

TABLES = {
    "prof": "sciper long, email string, lastname string, firstname string, creation_date timestamp_ntz, class_acc string",
    "lab": (
    "cf long, unit_name string, unit_type string, cf_level_2 long, cf_level_3 long, "
        "acronym_level_2 string, acronym_level_3 string"
    ),
    "sciper_lab": "sciper long, cf long, role string",
    "sciper_orcid_integration": "sciper long, orcid string",
    "pub": (
    "id_pub long, id_infoscience string, doi string, title string, abstract string, "
        "year_issued int, openalex_id string"
    ),
    "sciper_pub": "id_pub long, sciper long",
    "sciper_openalex": (
    "sciper long, openalex_id string, display_name string, display_name_alternatives array<string>, "
        "orcid string, works_count long"
    ),
    "orcid": (
    "orcid string, claimed boolean, firstname string, lastname string, other_names array<string>, "
        "emails array<string>, biography string, keyword string"
    ),
    "orcid_links": "orcid string, type string, id string, url string",
    "pub_embedding": "id_pub long, embedding array<double>",
    "representative": "sciper long, type string, weight double, embedding array<double>",
    "metadata": "timestamp string, total_processing_time_seconds double",
    "publications": "sciper long, title string, abstract string, id_pub long, source string, embedding array<double>",
    "embedding_run": "model string, texts long, computed long",
    "embedding_cache": "model string, text_hash string, embedding array<double>",
}

LAB_FIELDS = (
    "cf", "role", "unit_name", "unit_type", "cf_level_2", "cf_level_3", "acronym_level_2", "acronym_level_3",
)


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
