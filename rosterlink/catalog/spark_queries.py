"""Registered queries: each runs library plans over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink import schemas
from rosterlink.catalog.bindings import AS_OF_YEAR, Data
from rosterlink.functions import text
from rosterlink.operators import clusters, keyed, numbering, vectors
from rosterlink.plans import (
    audit, authors, embeddings, profiles, publications, publish, records, representatives, roster, search,
)
from rosterlink.session import scratch_folder, staged
from rosterlink.sources import readers, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Data], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Data(spark, folder))
    return fn


def joined(array, render) -> F.Column:
    return F.array_join(F.array_sort(F.transform(array, render)), ";")


def shown(col) -> F.Column:
    return F.coalesce(col.cast("string"), F.lit("-"))


def by_dimension(df: DataFrame, *keys: str) -> DataFrame:
    """Vectors as rows, for output only."""
    return df.select(*keys, F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value"), 4)
    )


# ---- roster ----------------------------------------------------------------------


@query
def roster_people(d: Data) -> DataFrame:
    return roster.people(d.roster()).withColumn("creation_date", F.date_format("creation_date", "yyyy-MM-dd HH:mm:ss"))


@query
def roster_people_in_order(d: Data) -> DataFrame:
    return roster.in_name_order(roster.people(d.roster())).select("sciper", "firstname", "lastname")


@query
def roster_units(d: Data) -> DataFrame:
    return d.lab()


@query
def roster_links(d: Data) -> DataFrame:
    return d.sciper_lab()


@query
def registered_orcids(d: Data) -> DataFrame:
    """Ids seen in events, landed as a map of one object per line, against known people."""
    entries = d.table("events").select(
        F.to_json(F.map_from_arrays(
            F.array(F.col("user_id").cast("string"), F.concat(F.lit("x"), F.col("user_id"))),
            F.transform(F.array(F.lit(0), F.lit(1)), lambda _: F.struct(d._orcid(F.col("user_id")).alias("orcid"))),
        )).alias("value")
    )
    path = scratch_folder(d.spark, "orcid-map")
    entries.write.text(path)
    return roster.registered_orcids(readers.read_orcid_map(d.spark, path).distinct(), d.prof())


@query
def known_ids_semi(d: Data) -> DataFrame:
    events = d.table("events").select(F.col("user_id").alias("sciper"), "event_id", "event_type")
    return keyed.known_only(events, d.prof(), "sciper")


@query
def override_anti_union(d: Data) -> DataFrame:
    found = d.sciper_openalex().select("sciper", "openalex_id")
    fixed = d.table("nation").select(F.col("n_nationkey").cast("long").alias("sciper"), F.col("n_name").alias("openalex_id"))
    return keyed.override(found, fixed, "sciper")


# ---- profiles --------------------------------------------------------------------


@query
def person_pub_counts(d: Data) -> DataFrame:
    people = d.prof().select("sciper")
    return profiles.with_counts(people, profiles.publication_counts(d.sciper_pub(), d.pub()))


@query
def person_units_nested(d: Data) -> DataFrame:
    nested = profiles.nested_units(profiles.person_units(d.sciper_lab(), d.lab()))
    label = lambda u: F.concat_ws("/", u["cf"], u["role"], shown(u["unit_type"]), u["acronym_level_2"], u["acronym_level_3"])
    return nested.select("sciper", F.col("n_labs").cast("long").alias("n_labs"), joined("labs", label).alias("labs"))


@query
def person_units_with_centres(d: Data) -> DataFrame:
    return profiles.person_units(d.sciper_lab(), d.lab(), include_centres=True).select("sciper", "cf", "role", "unit_name", "unit_type")


@query
def identifier_routes(d: Data) -> DataFrame:
    return profiles.identifier_routes(d.sciper_openalex(), d.registered(), d.orcid_links())


@query
def identifiers_dedup(d: Data) -> DataFrame:
    return profiles.identifiers(d.sciper_openalex(), d.registered(), d.orcid_links())


@query
def alternative_names(d: Data) -> DataFrame:
    return profiles.alternative_names(d.prof(), d.orcid(), d.registered(), d.sciper_openalex())


@query
def alternative_names_outside(d: Data) -> DataFrame:
    return profiles.nested_names(
        profiles.alternative_names(None, d.orcid(), d.registered(), d.sciper_openalex())
    ).withColumn("alternative_names", F.array_join("alternative_names", ";"))


def _flat(found: DataFrame) -> DataFrame:
    """Profiles with arrays as sorted text."""
    return found.select(
        "sciper", "email", "lastname", "firstname", "class_acc", F.col("n_labs").cast("long").alias("n_labs"),
        joined("labs", lambda u: F.concat_ws("/", u["cf"], u["role"], shown(u["unit_type"]))).alias("labs"),
        *profiles.COUNTS,
        joined("identifiers", lambda i: F.concat_ws("|", i["source"], i["id"], i["method"])).alias("identifiers"),
        F.array_join("alternative_names", ";").alias("alternative_names"),
    )


@query
def profile_list(d: Data) -> DataFrame:
    return _flat(profiles.profiles(d.profile_tables()))


@query
def profile_list_with_centres(d: Data) -> DataFrame:
    return _flat(profiles.profiles(d.profile_tables(), include_centres=True))


@query
def profile_lookup(d: Data) -> DataFrame:
    return _flat(profiles.profile_by_id(profiles.profiles(d.profile_tables()), 7))


@query
def profiles_by_unit(d: Data) -> DataFrame:
    return _flat(profiles.unit_profiles(d.profile_tables(), 7))


@query
def profiles_by_unit_limited(d: Data) -> DataFrame:
    return _flat(profiles.unit_profiles(d.profile_tables(), 7, limit=5))


@query
def response_summary(d: Data) -> DataFrame:
    return profiles.summary(profiles.profiles(d.profile_tables()), "20250101_000000")


# ---- text keys -------------------------------------------------------------------


@query
def normalize_name(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", text.name_key(F.col("text")).alias("name"))


@query
def standardize_name(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", text.name_token(F.col("text")).alias("token"))


@query
def simplify_name(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", text.name_token(F.col("text"), keep_hyphens=False).alias("token"))


@query
def fold_text(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", text.text_fold(F.col("text")).alias("folded"))


@query
def normalize_doi(d: Data) -> DataFrame:
    n = F.col("page_id")
    suffix = F.concat(F.lit("10."), F.lit(1000) + n, F.lit("/"), F.substring_index("url", "/", -1))
    raw = (
        F.when(n % 6 == 0, F.concat(F.lit(" https://doi.org/"), suffix, F.lit(". ")))
        .when(n % 6 == 1, F.concat(F.lit("DOI: "), F.upper(suffix)))
        .when(n % 6 == 2, F.concat(F.lit("http://dx.doi.org/"), suffix, F.lit(" x")))
        .when(n % 6 == 3, F.concat(F.lit(".,"), suffix, F.lit(";!?")))
        .when(n % 6 == 4, F.col("url"))
        .otherwise(F.concat(F.lit("doi:doi:"), suffix))
    )
    return d.table("pages").select("page_id", text.doi_key(raw).alias("doi"))


@query
def publication_year(d: Data) -> DataFrame:
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(n % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(n % 6 == 1, F.date_format(day, "yyyy-MM"))
        .when(n % 6 == 2, F.date_format(day, "dd.MM.yyyy"))
        .when(n % 6 == 3, F.date_format(day, "yyyy"))
        .when(n % 6 == 4, F.concat(F.lit("Spring "), F.year(day), F.lit("-2099")))
        .otherwise(F.concat(F.lit("c"), F.year(day)))
    )
    return d.table("orders").select("o_orderkey", text.publication_year(raw).cast("long").alias("year_issued"))


@query
def inverted_index_roundtrip(d: Data) -> DataFrame:
    """Every document indexed by word and put back together."""
    # texts meet by doc_id once, whole; both groupings below then stay in their task
    placed = d.table("documents").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    per_word = placed.groupBy("doc_id", "word").agg(F.collect_list("at").alias("ats"))
    index = per_word.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "ats"))).alias("index"))
    return index.select("doc_id", text.text_from_index(F.col("index")).alias("abstract"))


@query
def text_hash(d: Data) -> DataFrame:
    body = text.embedding_text(F.col("source"), F.col("text"))
    return d.table("documents").select("doc_id", text.text_hash(body).alias("text_hash"), text.text_md5(body).alias("text_md5"))


@query
def json_flatten(d: Data) -> DataFrame:
    """Property objects of events as rows with numeric values."""
    rows = d.table("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.where(text.digits_only(F.col("value"))).select("event_id", "key", text.as_id(F.col("value")).alias("value"))


def _person_records(d: Data) -> DataFrame:
    """A conversation as a landed person record: user turns are web links, others identifiers."""
    turns = d.table("conversations")
    value = lambda c: F.struct(c.alias("value"))
    link = F.struct(
        F.when(F.col("turn") % 4 != 0, F.col("role")).alias("url-name"),
        value(F.concat(F.lit("https://example.org/"), F.col("conv_id"), F.lit("/"), F.col("turn"))).alias("url"),
    )
    identifier = F.struct(
        F.col("role").alias("external-id-type"), F.col("turn").cast("string").alias("external-id-value"),
        value(F.md5("text")).alias("external-id-url"),
    )
    content = F.struct(F.col("role").alias("content"))
    # collect_list leaves nulls out
    grouped = turns.groupBy("conv_id").agg(
        F.collect_list(F.when(F.col("role") == "user", link)).alias("links"),
        F.collect_list(F.when(F.col("role") != "user", identifier)).alias("ids"),
        F.array_sort(F.collect_list(F.struct("turn", content.alias("c")))).alias("turns"),
        F.min("text").alias("bio"),
    )
    record = F.struct(
        F.struct((F.lit("https://orcid.org/0000-0000-0000-")).alias("uri"), d._orcid(F.col("conv_id")).alias("path")).alias("orcid-identifier"),
        F.struct((F.col("conv_id") % 2 == 0).alias("claimed")).alias("history"),
        F.struct(
            F.struct(value(F.concat(F.lit("conv "), F.col("conv_id"))).alias("given-names")).alias("name"),
            F.struct(F.transform("turns", lambda t: t["c"]).alias("keyword")).alias("keywords"),
            F.when(F.col("conv_id") % 3 != 0, F.struct(F.col("bio").alias("content"))).alias("biography"),
            F.struct(F.col("links").alias("researcher-url")).alias("researcher-urls"),
            F.struct(F.col("ids").alias("external-identifier")).alias("external-identifiers"),
        ).alias("person"),
    )
    landed = grouped.select(F.from_json(F.to_json(record), schemas.PERSON_RECORD).alias("r")).select("r.*")
    wanted = turns.select(d._orcid(F.col("conv_id")).alias("orcid")).distinct()
    return records.person_records(landed, wanted)


@query
def record_profiles(d: Data) -> DataFrame:
    return records.profile_rows(_person_records(d)).select(
        "orcid", "claimed", "firstname", "lastname", F.size("other_names").cast("long").alias("n_other_names"), "biography", "keyword"
    )


@query
def record_links(d: Data) -> DataFrame:
    return records.link_rows(_person_records(d))


# ---- publications and authors ----------------------------------------------------


def _items(d: Data) -> DataFrame:
    """An order as a repository item, its suppliers as people, repeats and noise included."""
    people = d.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("people"))
    value = lambda c: F.array(F.struct(c.alias("value")))
    key = F.col("o_orderkey")
    metadata = F.map_from_arrays(
        F.array(*[F.lit(f) for f in (
            schemas.ITEM_PEOPLE, schemas.ITEM_URI, schemas.ITEM_DOI, schemas.ITEM_TITLE, schemas.ITEM_ISSUED, schemas.ITEM_ENTITY,
        )]),
        F.array(
            F.transform(F.concat("people", F.array(F.lit("n/a"))), lambda p: F.struct(p.alias("value"))),
            value(F.concat(F.lit("repo/"), F.lpad(key.cast("string"), 12, "0"))),
            value(F.concat(F.lit("doi:10.1000/"), key)),
            value(F.col("o_orderpriority")),
            value(F.date_format("o_orderdate", "yyyy-MM-dd")),
            value(F.when(F.col("o_orderstatus") == "P", "Person").otherwise("Publication")),
        ),
    )
    return d.table("orders").join(people, key == F.col("l_orderkey")).select(metadata.alias("metadata"))


def _known(d: Data) -> DataFrame:
    return d.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sciper"))


@query
def item_publications(d: Data) -> DataFrame:
    return publications.publications(readers.select_items(_items(d), "1996-01-01", "1999-12-31"), _known(d))[0]


@query
def item_people(d: Data) -> DataFrame:
    return publications.publications(readers.select_items(_items(d), "1996-01-01", "1999-12-31"), _known(d))[1]


@query
def newest_k_per_person(d: Data) -> DataFrame:
    found = authors.newest_dois(d.sciper_pub(), d.pub())
    return found.select("sciper", "doi", F.col("year_issued").cast("long").alias("year_issued"), F.col("rank").cast("long").alias("rank"))


@query
def doi_lists(d: Data) -> DataFrame:
    found = authors.doi_lists(d.sciper_pub(), d.pub(), d.prof())
    return found.withColumn("dois", F.array_join("dois", ";"))


def _candidates(d: Data) -> DataFrame:
    dois = authors.newest_dois(d.part_pubs(), d.pub())
    return authors.candidate_authors(dois, readers.work_authorships(d.order_works()))


@query
def candidate_authors(d: Data) -> DataFrame:
    return _candidates(d).withColumn("rank", F.col("rank").cast("long"))


@query
def matching_authors(d: Data) -> DataFrame:
    return authors.matching_authors(_candidates(d), authors.person_names(d.part_people())).withColumn(
        "edit_distance", F.col("edit_distance").cast("long")
    )


def _existing(d: Data) -> DataFrame:
    pub, links = d.catalogued()
    return links.join(pub.select("id_pub", "doi", text.text_fold(F.col("title")).alias("title")), "id_pub")


@query
def title_match(d: Data) -> DataFrame:
    return publications.match_works(staged(d.found_works()), staged(_existing(d))).select("sciper", "work_id", "id_pub")


@query
def title_match_merge(d: Data) -> DataFrame:
    pub, links = d.catalogued()
    return publications.merge_works(pub, links, d.found_works())[0]


@query
def title_match_links(d: Data) -> DataFrame:
    pub, links = d.catalogued()
    return publications.merge_works(pub, links, d.found_works())[1]


@query
def append_with_ids(d: Data) -> DataFrame:
    """Customers appended behind suppliers under ids that go on from the highest."""
    old = d.table("supplier").select(F.col("s_suppkey").alias("id_pub"), F.col("s_name").alias("title"))
    top = old.agg(F.max("id_pub")).first()[0]
    new = numbering.assign_ids(d.table("customer").select(F.col("c_name").alias("title")), ["title"], "id_pub", after=top)
    return keyed.with_column_if_absent(old, "openalex_id", "string").unionByName(new, allowMissingColumns=True)


# ---- embeddings and representatives ----------------------------------------------

MODEL = "hashed-words"


def _cached(d: Data) -> DataFrame:
    """Cache of the labelled documents' texts, written once: its readers run the provider no more."""
    labelled = d.document_pub().join(d.table("labels").select(F.col("doc_id").alias("id_pub")), "id_pub", "left_semi")
    texts = embeddings.publication_texts(labelled).dropDuplicates(["text_hash"])
    return staged(embeddings.embed(texts.select("text_hash", "text"), embeddings.hashed_words, MODEL))


@query
def embed_cache_misses(d: Data) -> DataFrame:
    texts = embeddings.publication_texts(d.document_pub())
    return embeddings.uncached_texts(texts, _cached(d), MODEL).select("text_hash", F.length("text").cast("long").alias("n_chars"))


@query
def embed_texts(d: Data) -> DataFrame:
    found = embeddings.embed_publications(d.document_pub(), _cached(d), embeddings.hashed_words, MODEL)
    return by_dimension(found.pub_embedding, "id_pub")


@query
def mean_vectors(d: Data) -> DataFrame:
    return by_dimension(vectors.mean_vectors(d.vectors(), "sciper"), "sciper")


@query
def recency_vectors(d: Data) -> DataFrame:
    return by_dimension(vectors.recency_vectors(d.vectors(), "sciper", "year_issued", AS_OF_YEAR), "sciper")


@query
def cluster_vectors(d: Data) -> DataFrame:
    return by_dimension(clusters.cluster_vectors(d.vectors(), "sciper", "id_pub"), "sciper", "cluster", "size", "weight")


@query
def representative_vectors(d: Data) -> DataFrame:
    return by_dimension(representatives.representatives(d.vectors(), AS_OF_YEAR), "sciper", "type", "weight")


@query
def publish_view(d: Data) -> DataFrame:
    found = publish.publication_view(d.pub(), d.sciper_pub(), d.vectors().select("id_pub", "embedding"))
    return found.select("sciper", "title", "abstract", "id_pub", "source", F.size("embedding").cast("long").alias("dims"))


# ---- search ----------------------------------------------------------------------


def _representative(d: Data) -> DataFrame:
    """Means, recency means and, as clusters, the means of each person's years."""
    found = d.vectors()
    by_year = found.where("year_issued IS NOT NULL").withColumn("part", F.struct("sciper", "year_issued"))
    parts = vectors.mean_vectors(by_year, "part").select(F.col("part.sciper").alias("sciper"), "embedding")
    typed = representatives._typed
    return (
        typed(vectors.mean_vectors(found, "sciper"), "mean")
        .unionByName(typed(vectors.recency_vectors(found, "sciper", "year_issued", AS_OF_YEAR), "recency"))
        .unionByName(typed(parts, "cluster"))
    )


def _topics(d: Data, method: str, representative: DataFrame | None = None) -> DataFrame:
    queries = d.vectors().select(F.col("id_pub").alias("query_id"), "embedding")
    found = search.search_topics(queries, _representative(d) if representative is None else representative, method)
    return found.withColumn("place", F.col("place").cast("long"))


@query
def semantic_search_mean(d: Data) -> DataFrame:
    return _topics(d, "mean")


@query
def semantic_search_recency(d: Data) -> DataFrame:
    return _topics(d, "recency")


@query
def semantic_search_gaps(d: Data) -> DataFrame:
    """People by recency vector, which three of four lack: those stay, infinitely far."""
    lacking = (F.col("type") == "recency") & (F.col("sciper") % 4 != 1)
    found = _topics(d, "recency", _representative(d).where(~lacking))
    far = F.col("match_score") == float("inf")
    return found.withColumns({"missing": far, "match_score": F.when(~far, F.col("match_score"))})


@query
def semantic_search_cluster(d: Data) -> DataFrame:
    return _topics(d, "cluster")


@query
def semantic_search_mixed(d: Data) -> DataFrame:
    return _topics(d, "mixed")


@query
def semantic_search_kmeans(d: Data) -> DataFrame:
    return _topics(d, "mixed", representatives.representatives(d.vectors(), AS_OF_YEAR))


@query
def topic_search_texts(d: Data) -> DataFrame:
    """Benchmark passages as topics against the mean text vector of each document source."""
    people = d.table("documents").select(F.col("doc_id").alias("id_pub"), F.substring("source", 4, 9).cast("long").alias("sciper"))
    embedded = embeddings.embed_publications(d.document_pub(), _cached(d), embeddings.hashed_words, MODEL)
    means = vectors.mean_vectors(people.join(embedded.pub_embedding, "id_pub"), "sciper")
    # a passage is embedded as a publication without a title
    queries = embeddings.publication_texts(d.benchmark_pub()).select(F.col("id_pub").alias("query_id"), "text")
    found, _ = search.search_texts(
        queries, representatives._typed(means, "mean"), embedded.added, embeddings.hashed_words, MODEL, "mean"
    )
    return found.withColumn("place", F.col("place").cast("long"))


@query
def fuzzy_name_search(d: Data) -> DataFrame:
    """Part names turned round, looked up among all people named like parts."""
    words = F.split("p_name", " ")
    asked = d.table("part").groupBy(F.concat(words[1], F.lit(", "), words[0]).alias("query")).agg(F.min("p_partkey").alias("query_id"))
    names = d.table("part").select(F.col("p_partkey").alias("sciper"), F.col("p_name").alias("name"))
    found = search.search_names(asked, names)
    return found.withColumns({"match_score": F.round("match_score", 4), "place": F.col("place").cast("long")})


# ---- reports ---------------------------------------------------------------------


@query
def name_audit(d: Data) -> DataFrame:
    return audit.name_mismatches(audit.name_pairs(d.prof(), d.orcid(), d.registered(), d.sciper_openalex()))


def nearest(d: Data) -> DataFrame:
    found = d.vectors()
    best = audit.nearest_people(found.select("sciper"), found)
    return best.select(
        "target", "sciper", F.round("avg_dist", 4).alias("avg_dist"), F.round("closest_dist", 4).alias("closest_dist"),
        "avg_rank", "closest_rank", "final_mean_rank", F.col("place").cast("long").alias("place"),
    )


@query
def nearest_people(d: Data) -> DataFrame:
    return nearest(d)


@query
def lookup_names(d: Data) -> DataFrame:
    """Colour and thing of every part, cut to their stems, looked up among all parts."""
    words = F.split("p_name", " ")
    wanted = d.table("part").select(F.concat(
        F.upper(F.substring(words[0], F.lit(1), F.length(words[0]) - 1)), F.lit("  "), F.substring(words[1], F.lit(2), F.length(words[1]))
    ).alias("name")).unionByName(d.table("nation").select(F.col("n_name").alias("name")))
    people = d.table("part").select(F.col("p_partkey").alias("sciper"), words[0].alias("firstname"), words[1].alias("lastname"))
    return audit.lookup_names(wanted, people)


@query
def nearest_people_named(d: Data) -> DataFrame:
    return audit.with_details(nearest(d), d.prof())


# ---- landed files and published tables -------------------------------------------


@query
def landed_roster(d: Data) -> DataFrame:
    """The roster as a file with its own header, read back."""
    path = scratch_folder(d.spark, "roster")
    columns = [F.col(name).alias(header) for header, (name, _) in schemas.ROSTER_FIELDS.items()]
    d.roster().select(*columns, F.lit("more").alias("another column")).write.option("header", True).csv(path)
    return readers.read_roster(d.spark, path)


@query
def people_sample(d: Data) -> DataFrame:
    return keyed.sampled(d.prof(), ["sciper"], 20)


@query
def landed_author_details(d: Data) -> DataFrame:
    """External authors as JSON lines, some of them twice, joined to the ids that people resolved to."""
    found = d.sciper_openalex()
    landed = found.select(
        F.col("openalex_id").alias("id"), "display_name", "display_name_alternatives",
        F.concat(F.lit("https://orcid.org/"), "orcid").alias("orcid"),
        (F.substring("openalex_id", 23, 20).cast("long") % 7).alias("works_count"),
    )
    path = scratch_folder(d.spark, "authors")
    landed.unionByName(landed.where("works_count = 3")).write.json(path)
    details = authors.author_details(found.select("sciper", "openalex_id"), readers.read_authors(d.spark, path))
    return details.withColumn("display_name_alternatives", F.array_join("display_name_alternatives", ";"))


@query
def landed_works_of_authors(d: Data) -> DataFrame:
    """Orders as works of their parts, landed as JSON lines, by years and types."""
    key = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in (*schemas.WORK_TYPES, "dataset")])
    works = d.table("orders").select(
        F.concat(F.lit("W"), key).alias("id"), F.concat(F.lit("https://doi.org/10.1000/"), key).alias("doi"),
        F.concat(F.lit("order "), key).alias("title"), F.year("o_orderdate").alias("publication_year"),
        F.element_at(kinds, (key % 4 + 1).cast("int")).alias("type"),
    )
    path = scratch_folder(d.spark, "works")
    works.join(d.order_works(), "doi").write.json(path)
    found = readers.works_of_authors(readers.read_works(d.spark, path), 1994, 1996)
    return found.select("author_id", "work_id", "doi", "title", F.col("publication_year").cast("long").alias("publication_year"))


@query
def replaced_table(d: Data) -> DataFrame:
    """A table written twice under one name; the second time stays."""
    root = scratch_folder(d.spark, "tables")
    tables.replace_table(d.lab().withColumn("unit_name", F.lit("old")), root, "lab")
    tables.replace_table(d.lab(), root, "lab")
    return tables.read_table(d.spark, root, "lab", ["cf", "unit_name", "unit_type"])


@query
def published_snapshot(d: Data) -> DataFrame:
    """Two snapshots published one after the other; readers see the newest."""
    root = scratch_folder(d.spark, "snapshots")
    for timestamp, units in (("20240101_000000", d.lab().where("cf = 7")), ("20250101_000000", d.lab())):
        snapshot = tables.snapshot_root(root, timestamp)
        tables.replace_table(units, snapshot, "lab")
        tables.write_metadata(d.spark, snapshot, timestamp, 1.5)
        tables.publish_snapshot(d.spark, root, timestamp)
    latest = tables.latest_snapshot(d.spark, root)
    return tables.read_table(d.spark, latest, "lab").withColumn("last_update", F.lit(tables.last_update(d.spark, latest)))


@query
def report_file(d: Data) -> DataFrame:
    """The name report written as a sheet and read back."""
    path = scratch_folder(d.spark, "report")
    found = audit.name_mismatches(audit.name_pairs(d.prof(), d.orcid(), d.registered(), d.sciper_openalex()))
    tables.report(found, path)
    return d.spark.read.option("header", True).schema(found.schema).csv(path)


@query
def publications_of_range(d: Data) -> DataFrame:
    """Publications of a range of ids, for a run over new ones only: here those of the upper half."""
    top = d.pub().agg(F.max("id_pub")).first()[0]
    return embeddings.in_id_range(d.pub(), top // 2, top).select("id_pub", "doi", "title")


@query
def wanted_orcids(d: Data) -> DataFrame:
    return records.wanted_orcids(d.sciper_openalex(), d.registered())


@query
def resolved_authors(d: Data) -> DataFrame:
    """Parts resolved to authors, some corrected by hand, with details."""
    details = d.table("part").select(
        F.concat(F.lit("A"), "p_partkey").alias("id"), F.initcap("p_name").alias("display_name"),
        F.array("p_name", "p_brand").alias("display_name_alternatives"),
        F.when(F.col("p_partkey") % 3 != 0, d._orcid(F.col("p_partkey"))).alias("orcid"), F.col("p_size").cast("long").alias("works_count"),
    )
    corrections = d.table("nation").select(
        F.col("n_nationkey").cast("long").alias("sciper"), F.concat(F.lit("A"), F.col("n_nationkey") + 1).alias("openalex_id")
    )
    found = authors.resolve_authors(d.part_pubs(), d.pub(), d.part_people(), d.order_works(), details, corrections)
    return found.withColumn("display_name_alternatives", F.array_join("display_name_alternatives", ";"))


@query
def semantic_search_profiles(d: Data) -> DataFrame:
    """Topics among the visible people, with the full profiles of those found."""
    everybody = profiles.profiles(d.profile_tables())
    found = _topics(d, "mean", search.visible(_representative(d), everybody))
    return search.with_profiles(found, _flat(everybody))
