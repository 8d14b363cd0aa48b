"""Person profiles: units, counts, identifiers and names; lookups and summary.

The long forms (:func:`identifiers`, :func:`alternative_names`, :func:`person_units`) are
what searches join; the nested arrays are built last, for the people asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink import schemas
from rosterlink.functions import text
from rosterlink.operators.keyed import one_per_key, require_between

# Fixed value: units of this type are left out unless asked for.
CENTRE = "CENTRE"

# How an identifier was found.
BY_DOI = "doi_infoscience->openalex"
BY_DOI_ORCID = "doi_infoscience->openalex->orcid"
BY_DOI_ORCID_LINKS = "doi_infoscience->openalex->orcid->links"

COUNTS = ("count_infoscience_pubs", "count_openalex_pubs", "count_total_pubs")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def person_units(sciper_lab: DataFrame, lab: DataFrame, include_centres: bool = False) -> DataFrame:
    """Memberships with unit details; a unit of unknown type is no centre."""
    units = lab if include_centres else lab.where(~F.col("unit_type").eqNullSafe(F.lit(CENTRE)))
    return sciper_lab.join(units, "cf").select("sciper", *schemas.LAB_FIELDS)


def nested_units(units: DataFrame) -> DataFrame:
    """``sciper, labs, n_labs``."""
    listed = units.groupBy("sciper").agg(F.array_sort(F.collect_list(F.struct(*schemas.LAB_FIELDS))).alias("labs"))
    return listed.withColumn("n_labs", F.size("labs"))


def publication_counts(sciper_pub: DataFrame, pub: DataFrame) -> DataFrame:
    flags = pub.select(
        "id_pub", F.col("id_infoscience").isNotNull().alias("_a"), F.col("openalex_id").isNotNull().alias("_b")
    )
    return sciper_pub.select("sciper", "id_pub").join(flags, "id_pub").groupBy("sciper").agg(
        F.count_if("_a").alias(COUNTS[0]), F.count_if("_b").alias(COUNTS[1]), F.count(F.lit(1)).alias(COUNTS[2])
    )


def with_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts joined to people, zero where there are none."""
    joined = df.join(counts, "sciper", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNTS})


def people_of_records(sciper_openalex: DataFrame, registered: DataFrame) -> DataFrame:
    """``sciper, orcid`` by both ways to a record, repeats included; what hangs on records is joined to it once."""
    both = sciper_openalex.select("sciper", "orcid").unionByName(registered.select("sciper", "orcid"))
    return both.where("orcid IS NOT NULL")


def _author_identifiers(sciper_openalex: DataFrame) -> DataFrame:
    """``sciper, id, url, source, method`` of author ids and of the ORCIDs that come with them."""
    def one(url: Column, source: str, method: str) -> Column:
        return F.struct(url.alias("id"), url.alias("url"), F.lit(source).alias("source"), F.lit(method).alias("method"))

    author = one(F.col("openalex_id"), "openalex", BY_DOI)
    orcid = F.when(F.col("orcid").isNotNull(), one(text.orcid_url(F.col("orcid")), "orcid", BY_DOI_ORCID))
    return sciper_openalex.select("sciper", F.inline(F.array_compact(F.array(author, orcid))))


def identifier_routes(sciper_openalex: DataFrame, registered: DataFrame, orcid_links: DataFrame) -> DataFrame:
    """All identifiers by every route, repeats included: ``sciper, id, url, source, method``."""
    linked = orcid_links.join(people_of_records(sciper_openalex, registered), "orcid").select(
        "sciper", "id", "url", F.col("type").alias("source"), F.lit(BY_DOI_ORCID_LINKS).alias("method")
    )
    return _author_identifiers(sciper_openalex).unionByName(linked)


def first_method(routes: DataFrame) -> DataFrame:
    """Each identifier once, under the alphabetically first method that found it."""
    return routes.groupBy("sciper", "id", "url", "source").agg(F.min("method").alias("method"))


def identifiers(sciper_openalex: DataFrame, registered: DataFrame, orcid_links: DataFrame) -> DataFrame:
    return first_method(identifier_routes(sciper_openalex, registered, orcid_links))


def nested_identifiers(ids: DataFrame) -> DataFrame:
    return ids.groupBy("sciper").agg(
        F.array_sort(F.collect_list(F.struct("id", "url", "source", "method"))).alias("identifiers")
    )


def _both_orders() -> list[Column]:
    first, last = F.col("firstname"), F.col("lastname")
    return [text.full_name(first, last), text.full_name(last, first)]


def _listed(*names: Column, more: str | None = None) -> Column:
    """The names as one array, with those of an array column."""
    own = F.array(*names)
    return own if more is None else F.concat(own, F.coalesce(F.col(more), F.array().cast("array<string>")))


def name_routes(
    prof: DataFrame | None, orcid: DataFrame, registered: DataFrame, sciper_openalex: DataFrame
) -> DataFrame:
    """Every name of every person by every route, as written; without a roster, the outside routes only."""
    records = orcid.select("orcid", _listed(*_both_orders(), more="other_names").alias("names"))
    parts = [
        people_of_records(sciper_openalex, registered).join(records, "orcid").select("sciper", "names"),
        sciper_openalex.select("sciper", _listed(F.col("display_name"), more="display_name_alternatives").alias("names")),
    ]
    if prof is not None:
        parts.append(prof.select("sciper", _listed(F.col("lastname"), *_both_orders()).alias("names")))
    return _union(parts).select("sciper", F.explode("names").alias("name"))


def name_keys(names: DataFrame) -> DataFrame:
    """Distinct ``sciper, name`` with names reduced to their key."""
    return names.select("sciper", text.name_key(F.col("name")).alias("name")).distinct()


def alternative_names(prof: DataFrame | None, orcid: DataFrame, registered: DataFrame, sciper_openalex: DataFrame) -> DataFrame:
    return name_keys(name_routes(prof, orcid, registered, sciper_openalex))


def nested_names(names: DataFrame) -> DataFrame:
    return names.groupBy("sciper").agg(F.array_sort(F.collect_list("name")).alias("alternative_names"))


def visible_people(prof: DataFrame, sciper_lab: DataFrame, lab: DataFrame, include_centres: bool = False) -> DataFrame:
    """One row per person that has a unit left: base fields, ``labs``, ``n_labs``."""
    base = one_per_key(
        prof.select("sciper", "email", "lastname", "firstname", "class_acc"),
        ["sciper"], ["email", "lastname", "firstname", "class_acc"],
    )
    return base.join(nested_units(person_units(sciper_lab, lab, include_centres)), "sciper")


def _record_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """``sciper, names, link``: what hangs on records, both kinds by one join."""
    link = "struct<id:string,url:string,source:string,method:string>"
    names = tables["orcid"].select(
        "orcid", _listed(*_both_orders(), more="other_names").alias("names"), F.lit(None).cast(link).alias("link")
    )
    links = tables["orcid_links"].select("orcid", F.lit(None).cast("array<string>").alias("names"), F.struct(
        "id", "url", F.col("type").alias("source"), F.lit(BY_DOI_ORCID_LINKS).alias("method")
    ).cast(link).alias("link"))
    people = people_of_records(tables["sciper_openalex"], tables["sciper_orcid_integration"]).distinct()
    return people.join(names.unionByName(links), "orcid").select("sciper", "names", "link")


def _once(identifiers: Column) -> Column:
    """Each identifier once, under its alphabetically first method; they are in order."""
    def same(a: Column, b: Column) -> Column:
        return a["id"].eqNullSafe(b["id"]) & a["url"].eqNullSafe(b["url"]) & a["source"].eqNullSafe(b["source"])

    return F.filter(identifiers, lambda x, i: (i == 0) | ~same(x, F.get(identifiers, i - 1)))


_PERSON = ("email", "lastname", "firstname", "class_acc")


def profiles(tables: dict[str, DataFrame], include_centres: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """Full profile of every visible person, or of those in ``wanted`` (sciper).

    All that is known of people is one tagged union, gathered by one aggregate on the person.
    """
    if wanted is not None:
        asked = wanted.select("sciper").distinct()
        of_people = ("prof", "sciper_lab", "sciper_pub", "sciper_openalex", "sciper_orcid_integration")
        tables = {n: t.join(asked, "sciper", "left_semi") if n in of_people else t for n, t in tables.items()}
    unit, link = [F.struct(*schemas.LAB_FIELDS)], "struct<id:string,url:string,source:string,method:string>"
    sourced = tables["pub"].select("id_pub", F.col("id_infoscience").isNotNull().alias("_a"), F.col("openalex_id").isNotNull().alias("_b"))
    facts = {
        "person": F.struct(*[part for c in _PERSON for part in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c).alias(c))]),
        "unit": unit[0], "pub": F.struct("_a", "_b"),
    }
    author = _author_identifiers(tables["sciper_openalex"]).select("sciper", F.struct("id", "url", "source", "method").cast(link).alias("link"))
    rows = [
        (tables["prof"], {"person": facts["person"], "names": _listed(F.col("lastname"), *_both_orders())}),
        (person_units(tables["sciper_lab"], tables["lab"], include_centres), {"unit": facts["unit"]}),
        (tables["sciper_pub"].select("sciper", "id_pub").join(sourced, "id_pub"), {"pub": facts["pub"]}),
        (author, {"link": F.col("link")}),
        (tables["sciper_openalex"], {"names": _listed(F.col("display_name"), more="display_name_alternatives")}),
        (_record_facts(tables), {"names": F.col("names"), "link": F.col("link")}),
    ]
    union = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.select("sciper", *[c.alias(n) for n, c in columns.items()]) for df, columns in rows],
    )
    # a name is keyed once, where it stands
    named = union.withColumn("names", F.transform("names", lambda name: text.name_key(name)))
    gathered = named.groupBy("sciper").agg(
        F.min("person").alias("person"), F.array_sort(F.collect_list("unit")).alias("labs"),
        F.count_if(F.col("pub._a")).alias(COUNTS[0]), F.count_if(F.col("pub._b")).alias(COUNTS[1]), F.count("pub").alias(COUNTS[2]),
        F.array_sort(F.collect_set("link")).alias("links"), F.collect_list("names").alias("names"),
    )
    found = gathered.where(F.col("person").isNotNull() & (F.size("labs") > 0))
    names = F.array_sort(F.array_distinct(F.array_compact(F.flatten("names"))))
    return found.select(
        "sciper", *[F.col("person")[c].alias(c) for c in _PERSON], "labs", F.size("labs").alias("n_labs"), *COUNTS,
        _once(F.col("links")).alias("identifiers"), names.alias("alternative_names"),
    )


def unit_profiles(tables: dict[str, DataFrame], cf: int, limit: int | None = None, include_centres: bool = False) -> DataFrame:
    """Profiles of a unit's people, each once; nothing is gathered for others."""
    members = person_units(tables["sciper_lab"].where(F.col("cf") == cf), tables["lab"], include_centres).select("sciper").distinct()
    members = members.join(tables["prof"].select("sciper").distinct(), "sciper", "left_semi")
    if limit is not None:
        members = members.orderBy("sciper").limit(require_between(limit, 1, 1000, "limit"))
    return profiles(tables, include_centres, members)


def profile_by_id(all_profiles: DataFrame, sciper: int) -> DataFrame:
    """The person's profile, or no row."""
    return all_profiles.where(F.col("sciper") == sciper)


def profiles_by_unit(all_profiles: DataFrame, cf: int, limit: int | None = None) -> DataFrame:
    """People of a unit, each once; all of them unless limited."""
    found = all_profiles.where(F.exists("labs", lambda unit: unit["cf"] == cf))
    if limit is None:
        return found
    return found.orderBy("sciper").limit(require_between(limit, 1, 1000, "limit"))


def summary(found: DataFrame, updated: str | None = None) -> DataFrame:
    """Totals over the given profiles: people, counts, distinct identifiers."""
    # profiles are read once: a profile's first row (or its only one, without identifiers) carries its counts
    rows = found.select(*COUNTS, F.posexplode_outer("identifiers").alias("pos", "i"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    return rows.agg(
        F.count_if(first).alias("count"),
        F.lit(updated).cast("string").alias("last_update"),
        *[F.coalesce(F.sum(F.when(first, F.col(c))), F.lit(0)).alias("total_" + c.removeprefix("count_").removeprefix("total_")) for c in COUNTS],
        F.count_distinct(F.when(F.col("i").isNotNull(), F.struct(F.col("i.source"), F.col("i.id")))).alias("total_unique_identifiers"),
    )
