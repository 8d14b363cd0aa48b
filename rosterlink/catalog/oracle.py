"""The registered queries restated in DuckDB SQL, independently of the library."""

from __future__ import annotations

import re

# ---- scalar rules ----------------------------------------------------------------


def orcid(key: str) -> str:
    digits = f"lpad(CAST({key} AS VARCHAR), 16, '0')"
    return "||'-'||".join(f"substr({digits}, {at}, 4)" for at in (1, 5, 9, 13))


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def ascii_fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def name_key(x: str) -> str:
    return squeeze(f"lower(regexp_replace(strip_accents(coalesce({x}, '')), '[-,.;:''’_]', ' ', 'g'))")


def name_token(x: str, keep_hyphens: bool) -> str:
    s = strip(x)
    comma = f"position(',' IN {s})"
    swapped = (
        f"CASE WHEN {comma} > 0 THEN {strip(f'substr({s}, {comma} + 1)')} || ' ' || "
        f"{strip(f'substr({s}, 1, {comma} - 1)')} ELSE {s} END"
    )
    kept = r"'[^\w\s-]'" if keep_hyphens else r"'[^\w\s]'"
    cleaned = squeeze(f"regexp_replace({ascii_fold(swapped)}, {kept}, '', 'g')")
    return f"token_of(string_split({cleaned}, ' '))"


def token_of(words: str, keep_hyphens: bool) -> str:
    first = f"{words}[1]"
    initials = f"{first}[1]"
    if keep_hyphens:
        parts = f"list_filter(string_split({first}, '-'), lambda p: p <> '')"
        initials = f"coalesce(nullif(array_to_string(list_transform({parts}, lambda p: p[1]), ''), ''), {first}[1])"
    return f"CASE WHEN len({words}) >= 2 THEN lower({initials} || ' ' || {words}[-1]) END"


def words_of(x: str, keep_hyphens: bool) -> str:
    return name_token(x, keep_hyphens).removeprefix("token_of(").removesuffix(")")


def doi_key(x: str) -> str:
    bare = rf"regexp_replace(lower({strip(x)}), '^(https?://(dx\.)?doi\.org/|doi:)', '')"
    bare = f"trim({strip(bare)}, '.,;:!?')"
    return rf"CASE WHEN regexp_matches({bare}, '^10\.\d{{4,9}}/\S+$') THEN {bare} END"


# ---- bindings --------------------------------------------------------------------

VIEWS = {
    "roster": """
        SELECT l_suppkey AS sciper, lower(s_name) || '@example.org' AS email, s_name AS lastname,
               CASE WHEN s_nationkey > 0 THEN 'nation ' || s_nationkey END AS firstname,
               '2001/01/' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || ' 10:20:30' AS creation_date,
               'class ' || (s_nationkey % 3) AS class_acc,
               CAST(substr(p_brand, 7, 4) AS BIGINT) AS cf, p_brand AS unit_name,
               CASE WHEN p_type = 'PROMO' THEN 'CENTRE' WHEN p_type <> 'STANDARD' THEN p_type END AS unit_type,
               CAST(substr(p_brand, 7, 4) AS BIGINT) // 5 AS cf_level_2,
               CAST(substr(p_brand, 7, 4) AS BIGINT) // 10 AS cf_level_3,
               'L2-' || CAST(substr(p_brand, 7, 4) AS BIGINT) // 5 AS acronym_level_2,
               'L3-' || CAST(substr(p_brand, 7, 4) AS BIGINT) // 10 AS acronym_level_3,
               nullif(l_returnflag, 'N') AS role
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "lab": """
        SELECT DISTINCT cf, unit_name, unit_type, cf_level_2, cf_level_3, acronym_level_2, acronym_level_3 FROM roster""",
    "sciper_lab": """
        SELECT DISTINCT sciper, cf, role FROM roster WHERE sciper IS NOT NULL AND cf IS NOT NULL AND role IS NOT NULL""",
    "prof": """
        SELECT s_suppkey AS sciper, lower(s_name) AS email, split_part(p_name, ' ', 2) AS lastname,
               split_part(p_name, ' ', 1) AS firstname, 'class ' || (s_nationkey % 3) AS class_acc
        FROM supplier JOIN part ON s_suppkey = p_partkey""",
    "pub": """
        SELECT o_orderkey AS id_pub, CASE WHEN o_orderstatus <> 'O' THEN 'repo/' || o_orderkey END AS id_infoscience,
               CASE WHEN o_orderkey % 11 <> 0 THEN '10.1000/' || o_orderkey END AS doi, 'order ' || o_orderkey AS title,
               CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS abstract,
               CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS year_issued,
               CASE WHEN o_orderstatus <> 'F' THEN 'https://openalex.org/W' || o_orderkey END AS openalex_id
        FROM orders""",
    "sciper_pub": "SELECT DISTINCT l_orderkey AS id_pub, l_suppkey AS sciper FROM lineitem",
    "initcaps": """
        SELECT p_partkey, p_name, p_brand, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
               upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' ||
               upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS capital
        FROM part""",
    "sciper_openalex": f"""
        SELECT c_custkey // 15 AS sciper, 'https://openalex.org/A' || c_custkey AS openalex_id, capital AS display_name,
               [p_name, p_brand || ', ' || p_type] AS display_name_alternatives,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN {orcid('c_custkey')} END AS orcid
        FROM customer JOIN initcaps ON c_custkey = p_partkey""",
    "registered": f"SELECT s_suppkey AS sciper, {orcid('(s_suppkey * 15)')} AS orcid FROM supplier",
    "orcid_table": f"""
        SELECT {orcid('c_custkey')} AS orcid, CASE WHEN c_nationkey % 4 <> 0 THEN w1 END AS firstname, w2 AS lastname,
               [c_name, w1 || '-' || w2] AS other_names
        FROM customer JOIN initcaps ON c_custkey = p_partkey""",
    "orcid_links": f"""
        SELECT {orcid('o_custkey')} AS orcid, lower(o_orderpriority) AS type, CAST(o_orderkey AS VARCHAR) AS id,
               'https://links.example.org/' || o_orderkey AS url
        FROM orders""",
    # profile parts
    "counts": """
        SELECT sciper, count(id_infoscience) AS a, count(openalex_id) AS b, count(*) AS c
        FROM sciper_pub JOIN pub USING (id_pub) GROUP BY sciper""",
    "routes": """
        SELECT sciper, openalex_id AS id, openalex_id AS url, 'openalex' AS source, 'doi_infoscience->openalex' AS method
        FROM sciper_openalex
        UNION ALL
        SELECT sciper, 'https://orcid.org/' || orcid, 'https://orcid.org/' || orcid, 'orcid', 'doi_infoscience->openalex->orcid'
        FROM sciper_openalex WHERE orcid IS NOT NULL
        UNION ALL
        SELECT p.sciper, l.id, l.url, l.type, 'doi_infoscience->openalex->orcid->links'
        FROM (SELECT sciper, orcid FROM sciper_openalex UNION ALL SELECT sciper, orcid FROM registered) p
        JOIN orcid_links l ON p.orcid = l.orcid""",
    "found_ids": "SELECT sciper, id, url, source, min(method) AS method FROM routes GROUP BY ALL",
    "person_orcids": """
        SELECT sciper, orcid FROM registered UNION SELECT sciper, orcid FROM sciper_openalex WHERE orcid IS NOT NULL""",
    "outside_names": """
        SELECT sciper, concat(firstname, ' ', lastname) AS name FROM person_orcids JOIN orcid_table USING (orcid)
        UNION SELECT sciper, concat(lastname, ' ', firstname) FROM person_orcids JOIN orcid_table USING (orcid)
        UNION SELECT sciper, unnest(other_names) FROM person_orcids JOIN orcid_table USING (orcid)
        UNION SELECT sciper, display_name FROM sciper_openalex
        UNION SELECT sciper, unnest(display_name_alternatives) FROM sciper_openalex""",
    "raw_names": """
        SELECT sciper, lastname AS name FROM prof
        UNION SELECT sciper, concat(firstname, ' ', lastname) FROM prof
        UNION SELECT sciper, concat(lastname, ' ', firstname) FROM prof
        UNION SELECT sciper, name FROM outside_names""",
    "names": f"SELECT DISTINCT sciper, {name_key('name')} AS name FROM raw_names",
    "units": "SELECT * FROM sciper_lab JOIN lab USING (cf)",
    "unit_lists": """
        SELECT sciper, count(*) AS n_labs,
               string_agg(label, ';' ORDER BY label) AS labs, list(DISTINCT cf) AS cfs
        FROM (SELECT *, concat_ws('/', cf, role, coalesce(unit_type, '-')) AS label FROM units
              WHERE unit_type IS DISTINCT FROM 'CENTRE')
        GROUP BY sciper""",
    "all_unit_lists": """
        SELECT sciper, count(*) AS n_labs,
               string_agg(label, ';' ORDER BY label) AS labs
        FROM (SELECT *, concat_ws('/', cf, role, coalesce(unit_type, '-')) AS label FROM units) GROUP BY sciper""",
    "profile_rest": """
        SELECT p.*, coalesce(a, 0) AS count_infoscience_pubs, coalesce(b, 0) AS count_openalex_pubs,
               coalesce(c, 0) AS count_total_pubs, coalesce(i.identifiers, '') AS identifiers, n.alternative_names
        FROM prof p LEFT JOIN counts USING (sciper)
        LEFT JOIN (SELECT sciper, string_agg(label, ';' ORDER BY label) AS identifiers
                   FROM (SELECT sciper, concat_ws('|', source, id, method) AS label FROM found_ids) GROUP BY sciper) i USING (sciper)
        LEFT JOIN (SELECT sciper, string_agg(name, ';' ORDER BY name) AS alternative_names FROM names GROUP BY sciper) n USING (sciper)""",
    "profile": "SELECT r.*, u.n_labs, u.labs, u.cfs FROM profile_rest r JOIN unit_lists u USING (sciper)",
    # co-authorship
    "person_newest": """
        SELECT sciper, doi, year_issued, row_number() OVER (PARTITION BY sciper ORDER BY year_issued DESC NULLS LAST, doi) AS rank
        FROM (SELECT sciper, doi, max(year_issued) AS year_issued FROM sciper_pub JOIN pub USING (id_pub)
              WHERE doi IS NOT NULL GROUP BY ALL)
        QUALIFY rank <= 50""",
    "part_newest": """
        SELECT sciper, id_pub FROM (SELECT DISTINCT l_partkey AS sciper, l_orderkey AS id_pub FROM lineitem) JOIN pub USING (id_pub)
        WHERE doi IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY sciper ORDER BY year_issued DESC NULLS LAST, doi) <= 50""",
    "candidates": """
        SELECT sciper, 'A' || l_partkey AS author_id, min(capital) AS display_name, count(*) AS n,
               row_number() OVER (PARTITION BY sciper ORDER BY count(*) DESC, 'A' || l_partkey) AS rank
        FROM part_newest JOIN lineitem ON id_pub = l_orderkey JOIN initcaps ON l_partkey = p_partkey
        GROUP BY sciper, l_partkey
        QUALIFY rank <= 50""",
    # titles
    "docs": f"""
        SELECT doc_id, lang, source, n_chars, text, {squeeze(ascii_fold('text'))} AS folded,
               CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || n_chars END AS doi,
               doc_id IN (SELECT doc_id FROM labels) AS labelled
        FROM documents""",
    "held": "SELECT * FROM docs WHERE labelled",
    "works": "SELECT *, 'W' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS work_id FROM docs WHERE NOT labelled",
    "doi_hits": """
        SELECT w.lang AS sciper, w.work_id, min(h.doc_id) AS id_pub FROM works w JOIN held h ON w.lang = h.lang AND w.doi = h.doi
        GROUP BY ALL""",
    # a text within two edits keeps one of its three parts whole; that only spares time
    "title_hits": """
        SELECT sciper, work_id, id_pub FROM (
            SELECT w.lang AS sciper, w.work_id, h.doc_id AS id_pub,
                   CASE WHEN w.folded = h.folded THEN 0 ELSE levenshtein(w.folded, h.folded) END AS distance
            FROM works w JOIN held h ON w.lang = h.lang AND abs(length(w.folded) - length(h.folded)) <= 2
            WHERE w.folded <> '' AND h.folded <> '' AND w.work_id NOT IN (SELECT work_id FROM doi_hits)
              AND (contains(w.folded, substr(h.folded, 1, length(h.folded) // 3))
                OR contains(w.folded, substr(h.folded, length(h.folded) // 3 + 1, length(h.folded) // 3))
                OR contains(w.folded, substr(h.folded, 2 * (length(h.folded) // 3) + 1))))
        WHERE distance <= 2
        QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY distance, id_pub) = 1""",
    "hits": "SELECT * FROM doi_hits UNION ALL SELECT * FROM title_hits",
    "new_works": """
        SELECT *, (SELECT max(doc_id) FROM held) + row_number() OVER (ORDER BY work_id) AS id_pub
        FROM works WHERE work_id NOT IN (SELECT work_id FROM hits)""",
    # texts and vectors
    "texts": """
        SELECT doc_id, coalesce(source, '') || '. ' || coalesce(text, '') AS body, doc_id IN (SELECT doc_id FROM labels) AS cached
        FROM documents""",
    "text_words": "SELECT 'd' AS kind, doc_id AS id, unnest(string_split(body, ' ')) AS word FROM texts",
    "topic_words": "SELECT 'b' AS kind, item_id AS id, unnest(string_split('. ' || text, ' ')) AS word FROM benchmark",
    "vec": """
        SELECT label AS sciper, vec_id, CAST(embedding AS DOUBLE[]) AS e,
               CASE WHEN vec_id % 7 <> 0 THEN 2015 + vec_id % 10 END AS year
        FROM embeddings""",
    "cells": "SELECT sciper, vec_id, year, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM vec",
    "mean_cells": "SELECT sciper, dim, avg(x) AS value FROM cells GROUP BY ALL",
    "recency_cells": """
        SELECT sciper, dim, sum(x * pow(2, -(2025 - year) / 3.0)) / sum(pow(2, -(2025 - year) / 3.0)) AS value
        FROM cells WHERE year IS NOT NULL GROUP BY ALL""",
    "mean_lists": "SELECT sciper, list(value ORDER BY dim) AS e FROM mean_cells GROUP BY sciper",
    "recency_lists": "SELECT sciper, list(value ORDER BY dim) AS e FROM recency_cells GROUP BY sciper",
    "cluster_lists": """
        SELECT sciper, year, list(value ORDER BY dim) AS e
        FROM (SELECT sciper, year, dim, avg(x) AS value FROM cells WHERE year IS NOT NULL GROUP BY ALL) GROUP BY sciper, year""",
    "by_mean": "SELECT q.vec_id AS query_id, r.sciper, list_distance(q.e, r.e) AS d FROM vec q, mean_lists r",
    "by_recency": "SELECT q.vec_id AS query_id, r.sciper, list_distance(q.e, r.e) AS d FROM vec q, recency_lists r",
    "by_cluster": """
        SELECT q.vec_id AS query_id, r.sciper, min(list_distance(q.e, r.e)) AS d FROM vec q, cluster_lists r GROUP BY ALL""",
    "mixed": """
        SELECT query_id, sciper, (m.d + r.d + c.d) / 3 AS d
        FROM by_mean m JOIN by_recency r USING (query_id, sciper) JOIN by_cluster c USING (query_id, sciper)""",
}


VIEWS |= {
    # k-means by the stated rules: seeds far apart, then rounds until no row moves
    "kmeans_seeds": """
        SELECT sciper, 1 AS n, [first(vec_id ORDER BY vec_id)] AS ids, [first(e ORDER BY vec_id)] AS centres FROM vec GROUP BY sciper
        UNION ALL
        SELECT sciper, n + 1, list_append(ids, first(vec_id ORDER BY near DESC, vec_id)), list_append(centres, first(e ORDER BY near DESC, vec_id))
        FROM (SELECT s.*, v.vec_id, v.e, list_min(list_transform(centres, lambda c: list_distance(v.e, c))) AS near
              FROM kmeans_seeds s JOIN vec v ON s.sciper = v.sciper AND NOT list_contains(s.ids, v.vec_id) WHERE n < 5)
        GROUP BY sciper, n, ids, centres""",
    "kmeans_rounds": """
        SELECT sciper, 0 AS round, arg_max(centres, n) AS centres, '' AS labels FROM kmeans_seeds GROUP BY sciper
        UNION ALL
        SELECT sciper, round + 1, list_transform(range(CAST(len(centres) AS BIGINT)), lambda c:
                   CASE WHEN len(list_filter(members, lambda m: m.label = c + 1)) = 0 THEN centres[c + 1]
                   ELSE list_transform(range(CAST(len(centres[1]) AS BIGINT)), lambda d:
                       list_avg(list_transform(list_filter(members, lambda m: m.label = c + 1), lambda m: m.e[d + 1]))) END), now
        FROM (SELECT sciper, round, centres, labels, list(struct_pack(label := label, e := e)) AS members,
                     string_agg(CAST(label AS VARCHAR), ',' ORDER BY vec_id) AS now
              FROM (SELECT *, list_position(distances, list_min(distances)) AS label
                    FROM (SELECT r.*, v.vec_id, v.e, list_transform(r.centres, lambda c: list_distance(v.e, c)) AS distances
                          FROM kmeans_rounds r JOIN vec v USING (sciper)))
              GROUP BY sciper, round, centres, labels)
        WHERE now <> labels""",
    "kmeans_lists": """
        SELECT sciper, c AS cluster, size, CAST(size AS DOUBLE) / total AS weight, e FROM (
            SELECT sciper, c, centres[c + 1] AS e, len(list_filter(members, lambda m: m = CAST(c + 1 AS VARCHAR))) AS size, len(members) AS total
            FROM (SELECT sciper, arg_max(centres, round) AS centres, string_split(arg_max(labels, round), ',') AS members
                  FROM kmeans_rounds GROUP BY sciper), range(5) k(c)
            WHERE c < len(centres))
        WHERE size > 0""",
    "by_kmeans": """
        SELECT q.vec_id AS query_id, r.sciper, min(list_distance(q.e, r.e)) AS d FROM vec q, kmeans_lists r GROUP BY ALL""",
    # the best share of a common subsequence; bits of a number are places of the shorter name
    "asked_names": """
        SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS query, min(p_partkey) AS query_id FROM part GROUP BY query""",
    "name_pairs": "SELECT query, p_name AS name FROM asked_names, (SELECT DISTINCT p_name FROM part)",
    "name_sides": """
        SELECT query, name, CASE WHEN length(query) <= length(name) THEN query ELSE name END AS short,
               CASE WHEN length(query) <= length(name) THEN name ELSE query END AS long FROM name_pairs
        UNION ALL SELECT query, name, name, query FROM name_pairs WHERE length(query) = length(name)""",
    "name_masks": """
        SELECT *, CAST(length(short) AS BIGINT) AS m, list_transform(range(CAST(length(long) AS BIGINT)), lambda j:
            CAST(list_sum(list_transform(range(CAST(length(short) AS BIGINT)), lambda i: CASE WHEN substr(short, i + 1, 1) = substr(long, j + 1, 1)
                THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)) AS masks
        FROM name_sides""",
    "name_windows": """
        SELECT query, name, m, list_slice(masks, greatest(b, 1), least(b + m - 1, len(masks))) AS w
        FROM (SELECT *, unnest(range(2 - m, CAST(len(masks) AS BIGINT) + 1)) AS b FROM name_masks)""",
    "name_scores": """
        SELECT query, name, max(200.0::DOUBLE * (m - bit_count(list_reduce(list_prepend((CAST(1 AS BIGINT) << m) - 1, w),
            lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((CAST(1 AS BIGINT) << m) - 1)))) / (m + len(w))) AS score
        FROM name_windows GROUP BY query, name""",
}


def _vectors(words: str) -> str:
    """Unit vectors of word counts in 16 buckets, one row per bucket."""
    return f"""
        SELECT ids.kind, ids.id, dims.dim, CASE WHEN norm > 0 THEN coalesce(n, 0) / norm ELSE 0.0 END AS value
        FROM (SELECT DISTINCT kind, id FROM {words}) ids
        CROSS JOIN (SELECT unnest(range(16)) AS dim) dims
        LEFT JOIN {words}_counts c ON c.kind = ids.kind AND c.id = ids.id AND c.dim = dims.dim
        LEFT JOIN (SELECT kind, id, sqrt(sum(n * n)) AS norm FROM {words}_counts GROUP BY ALL) s
               ON s.kind = ids.kind AND s.id = ids.id"""


for _words in ("text_words", "topic_words"):
    VIEWS[f"{_words}_counts"] = f"""
        SELECT kind, id, instr('0123456789abcdef', substr(md5(word), 2, 1)) - 1 AS dim, CAST(count(*) AS DOUBLE) AS n
        FROM {_words} WHERE word <> '' GROUP BY ALL"""
    VIEWS[f"{_words}_cells"] = _vectors(_words)
VIEWS["source_means"] = """
    SELECT sciper, list(value ORDER BY dim) AS e FROM (
        SELECT CAST(substr(source, 4, 9) AS BIGINT) AS sciper, dim, avg(value) AS value
        FROM text_words_cells JOIN documents ON id = doc_id GROUP BY ALL) GROUP BY sciper"""
VIEWS["topics"] = "SELECT id AS query_id, list(value ORDER BY dim) AS e FROM topic_words_cells GROUP BY id"


def _with(select: str) -> str:
    """The select with the bindings it needs, in order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", sql):
                seen.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed) + "\n" + select


def _top(scores: str) -> str:
    return f"""
        SELECT query_id, CAST(sciper AS BIGINT) AS sciper, round(d, 4) AS match_score, place FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, sciper) AS place FROM {scores})
        WHERE place <= 5"""


_PROFILE = """sciper, email, lastname, firstname, class_acc, n_labs, labs, count_infoscience_pubs, count_openalex_pubs,
    count_total_pubs, identifiers, alternative_names"""


def _token_query(keep_hyphens: bool) -> str:
    return f"""
        SELECT doc_id, {token_of('w', keep_hyphens)} AS token
        FROM (SELECT doc_id, {words_of('text', keep_hyphens)} AS w FROM documents)"""


def _audit() -> str:
    def words(column: str) -> str:
        return words_of(f"coalesce({column}, '')", False)

    return f"""
        SELECT sciper, source1_type, source1_name, source1_id, source2_type, source2_name, source2_id,
               source1_name_norm, source2_name_norm
        FROM (SELECT *, {token_of('w1', False)} AS source1_name_norm, {token_of('w2', False)} AS source2_name_norm FROM (
            SELECT *, {words('source1_name')} AS w1, {words('source2_name')} AS w2 FROM (
                SELECT sciper, 'roster' AS source1_type, concat(firstname, ' ', lastname) AS source1_name,
                       CAST(sciper AS VARCHAR) AS source1_id, 'openalex' AS source2_type, display_name AS source2_name,
                       openalex_id AS source2_id
                FROM prof JOIN sciper_openalex USING (sciper)
                UNION ALL
                SELECT p.sciper, 'roster', concat(p.firstname, ' ', p.lastname), CAST(p.sciper AS VARCHAR),
                       'orcid integration', concat(coalesce(o.firstname, ''), ' ', o.lastname), o.orcid
                FROM prof p JOIN registered r USING (sciper) JOIN orcid_table o USING (orcid)
                UNION ALL
                SELECT sciper, 'openalex', display_name, openalex_id, 'orcid',
                       concat(coalesce(o.firstname, ''), ' ', o.lastname), o.orcid
                FROM sciper_openalex JOIN orcid_table o USING (orcid))))
        WHERE source1_name_norm IS NULL OR source2_name_norm IS NULL OR source1_name_norm <> source2_name_norm"""


_ITEMS = """
    SELECT row_number() OVER (ORDER BY o_orderkey) AS id_pub, o_orderkey, o_orderpriority, o_orderdate
    FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0)"""

_RAW_DOI = """CASE page_id % 6
    WHEN 0 THEN ' https://doi.org/' || suffix || '. ' WHEN 1 THEN 'DOI: ' || upper(suffix)
    WHEN 2 THEN 'http://dx.doi.org/' || suffix || ' x' WHEN 3 THEN '.,' || suffix || ';!?'
    WHEN 4 THEN url ELSE 'doi:doi:' || suffix END"""

_RAW_DATE = """CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
    WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 3 THEN strftime(o_orderdate, '%Y')
    WHEN 4 THEN 'Spring ' || year(o_orderdate) || '-2099' ELSE 'c' || year(o_orderdate) END"""

SELECTS = {
    "roster_people": """
        SELECT DISTINCT sciper, email, lastname, firstname,
               strftime(strptime(creation_date, '%Y/%m/%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS creation_date, class_acc
        FROM roster""",
    "roster_people_in_order": "SELECT DISTINCT sciper, firstname, lastname FROM roster ORDER BY firstname NULLS LAST",
    "roster_units": "SELECT * FROM lab",
    "roster_links": "SELECT * FROM sciper_lab",
    "registered_orcids": f"""
        SELECT DISTINCT user_id AS sciper, {orcid('user_id')} AS orcid FROM events WHERE user_id IN (SELECT sciper FROM prof)""",
    "known_ids_semi": "SELECT user_id AS sciper, event_id, event_type FROM events WHERE user_id IN (SELECT sciper FROM prof)",
    "override_anti_union": """
        SELECT sciper, openalex_id FROM sciper_openalex WHERE sciper NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation""",
    "person_pub_counts": """
        SELECT sciper, coalesce(a, 0) AS count_infoscience_pubs, coalesce(b, 0) AS count_openalex_pubs,
               coalesce(c, 0) AS count_total_pubs
        FROM prof LEFT JOIN counts USING (sciper)""",
    "person_units_nested": """
        SELECT sciper, count(*) AS n_labs, string_agg(label, ';' ORDER BY label) AS labs
        FROM (SELECT sciper, concat_ws('/', cf, role, coalesce(unit_type, '-'), acronym_level_2, acronym_level_3) AS label
              FROM units WHERE unit_type IS DISTINCT FROM 'CENTRE') GROUP BY sciper""",
    "person_units_with_centres": "SELECT sciper, cf, role, unit_name, unit_type FROM units",
    "identifier_routes": "SELECT * FROM routes",
    "identifiers_dedup": """
        SELECT sciper, id, url, source, method FROM (
            SELECT *, row_number() OVER (PARTITION BY sciper, id, url, source ORDER BY method) AS rn FROM routes) WHERE rn = 1""",
    "alternative_names": "SELECT * FROM names",
    "alternative_names_outside": f"""
        SELECT sciper, string_agg(name, ';' ORDER BY name) AS alternative_names
        FROM (SELECT DISTINCT sciper, {name_key('name')} AS name FROM outside_names) GROUP BY sciper""",
    "profile_list": f"SELECT {_PROFILE} FROM profile",
    "profile_list_with_centres": f"SELECT {_PROFILE} FROM profile_rest JOIN all_unit_lists USING (sciper)",
    "profile_lookup": f"SELECT {_PROFILE} FROM profile WHERE sciper = 7",
    "profiles_by_unit": f"SELECT {_PROFILE} FROM profile WHERE list_contains(cfs, 7)",
    "profiles_by_unit_limited": f"SELECT {_PROFILE} FROM profile WHERE list_contains(cfs, 7) ORDER BY sciper LIMIT 5",
    "response_summary": """
        SELECT count(*) AS count, '20250101_000000' AS last_update,
               CAST(sum(count_infoscience_pubs) AS BIGINT) AS total_infoscience_pubs,
               CAST(sum(count_openalex_pubs) AS BIGINT) AS total_openalex_pubs,
               CAST(sum(count_total_pubs) AS BIGINT) AS total_pubs,
               (SELECT count(DISTINCT (source, id)) FROM found_ids WHERE sciper IN (SELECT sciper FROM profile)) AS total_unique_identifiers
        FROM profile""",
    "normalize_name": f"SELECT doc_id, {name_key('text')} AS name FROM documents",
    "standardize_name": _token_query(True),
    "simplify_name": _token_query(False),
    "fold_text": f"SELECT doc_id, {squeeze(ascii_fold('text'))} AS folded FROM documents",
    "normalize_doi": f"""
        SELECT page_id, {doi_key('raw')} AS doi FROM (SELECT page_id, {_RAW_DOI} AS raw FROM (
            SELECT *, '10.' || (1000 + page_id) || '/' || string_split(url, '/')[-1] AS suffix FROM pages))""",
    "publication_year": rf"""
        SELECT o_orderkey, CAST(nullif(regexp_extract(raw, '\b(19\d\d|20\d\d)\b', 1), '') AS BIGINT) AS year_issued
        FROM (SELECT o_orderkey, {_RAW_DATE} AS raw FROM orders)""",
    "inverted_index_roundtrip": """
        SELECT doc_id, string_agg(word, ' ' ORDER BY position) AS abstract FROM (
            SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS position
            FROM documents)
        GROUP BY doc_id""",
    "text_hash": "SELECT doc_id, sha256(body) AS text_hash, md5(body) AS text_md5 FROM texts",
    "json_flatten": """
        SELECT event_id, key, CAST(value AS BIGINT) AS value FROM (
            SELECT event_id, key, json_extract_string(props, key) AS value
            FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events))
        WHERE regexp_matches(value, '^[0-9]+$')""",
    "record_profiles": f"""
        SELECT {orcid('conv_id')} AS orcid, conv_id % 2 = 0 AS claimed, 'conv ' || conv_id AS firstname,
               CAST(NULL AS VARCHAR) AS lastname, CAST(0 AS BIGINT) AS n_other_names,
               CASE WHEN conv_id % 3 <> 0 THEN min(text) END AS biography, string_agg(role, ';' ORDER BY turn) AS keyword
        FROM conversations GROUP BY conv_id""",
    "record_links": f"""
        SELECT {orcid('conv_id')} AS orcid, CASE WHEN role = 'user' THEN 'url' ELSE role END AS type,
               CASE WHEN role <> 'user' THEN CAST(turn AS VARCHAR) WHEN turn % 4 <> 0 THEN role
                    ELSE 'https://example.org/' || conv_id || '/' || turn END AS id,
               CASE WHEN role = 'user' THEN 'https://example.org/' || conv_id || '/' || turn ELSE md5(text) END AS url
        FROM conversations""",
    "item_publications": f"""
        SELECT id_pub, 'repo/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id_infoscience, '10.1000/' || o_orderkey AS doi,
               o_orderpriority AS title, CAST(NULL AS VARCHAR) AS abstract, CAST(year(o_orderdate) AS INTEGER) AS year_issued
        FROM ({_ITEMS})""",
    "item_people": f"""
        SELECT DISTINCT id_pub, l_suppkey AS sciper FROM ({_ITEMS}) JOIN lineitem ON o_orderkey = l_orderkey
        JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0""",
    "newest_k_per_person": "SELECT sciper, doi, year_issued, rank FROM person_newest",
    "doi_lists": """
        SELECT sciper, total_dois, concat(firstname, ' ', lastname) AS name, dois
        FROM (SELECT sciper, count(DISTINCT doi) AS total_dois FROM sciper_pub JOIN pub USING (id_pub) WHERE doi IS NOT NULL GROUP BY sciper)
        JOIN (SELECT sciper, string_agg(doi, ';' ORDER BY rank) AS dois FROM person_newest GROUP BY sciper) USING (sciper)
        JOIN prof USING (sciper)""",
    "candidate_authors": "SELECT sciper, author_id, display_name, n, rank FROM candidates",
    "matching_authors": """
        SELECT sciper, openalex_id, n, CASE WHEN own IS NOT NULL THEN levenshtein(token, own) END AS edit_distance FROM (
            SELECT c.sciper, author_id AS openalex_id, n, rank, lower(display_name[1]) || ' ' || lower(split_part(display_name, ' ', 2)) AS token,
                   CASE WHEN c.sciper % 5 <> 0 THEN w1[1] || ' ' || w2 END AS own
            FROM candidates c JOIN initcaps ON c.sciper = p_partkey)
        WHERE CASE WHEN own IS NULL THEN rank <= 5 ELSE levenshtein(token, own) <= 1 END""",
    "title_match": "SELECT * FROM hits",
    "title_match_merge": """
        SELECT h.doc_id AS id_pub, 'repo/' || h.doc_id AS id_infoscience, h.doi, h.text AS title,
               coalesce(nullif(CASE WHEN h.doc_id % 2 = 0 THEN h.source END, ''), u.abstract) AS abstract, 2020 AS year_issued, u.openalex_id
        FROM held h LEFT JOIN (
            SELECT id_pub, max(work_id) AS openalex_id, arg_max(source, work_id) FILTER (doc_id % 5 <> 0 AND source <> '') AS abstract
            FROM hits JOIN works USING (work_id) GROUP BY id_pub) u ON h.doc_id = u.id_pub
        UNION ALL
        SELECT id_pub, NULL, doi, folded, CASE WHEN doc_id % 5 <> 0 THEN source ELSE '' END, 2021, work_id FROM new_works""",
    "title_match_links": "SELECT doc_id AS id_pub, lang AS sciper FROM held UNION SELECT id_pub, lang FROM new_works",
    "append_with_ids": """
        SELECT s_suppkey AS id_pub, s_name AS title, CAST(NULL AS VARCHAR) AS openalex_id FROM supplier
        UNION ALL
        SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_name), c_name, NULL FROM customer""",
    "embed_cache_misses": """
        SELECT DISTINCT sha256(body) AS text_hash, length(body) AS n_chars FROM texts
        WHERE sha256(body) NOT IN (SELECT sha256(body) FROM texts WHERE cached)""",
    "embed_texts": "SELECT id AS id_pub, dim, round(value, 4) AS value FROM text_words_cells",
    "mean_vectors": "SELECT CAST(sciper AS BIGINT) AS sciper, dim, round(value, 4) + 0.0 AS value FROM mean_cells",
    "recency_vectors": "SELECT CAST(sciper AS BIGINT) AS sciper, dim, round(value, 4) + 0.0 AS value FROM recency_cells",
    "publish_view": """
        SELECT sciper, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, id_pub,
               CASE WHEN id_infoscience IS NOT NULL THEN 'infoscience' ELSE 'openalex' END AS source, len(embedding) AS dims
        FROM pub JOIN sciper_pub USING (id_pub) JOIN embeddings ON id_pub = vec_id""",
    "semantic_search_mean": _top("by_mean"),
    "semantic_search_recency": _top("by_recency"),
    "semantic_search_gaps": f"""
        SELECT query_id, sciper, CASE WHEN NOT isinf(match_score) THEN match_score END AS match_score,
               isinf(match_score) AS missing, place
        FROM ({_top("""(
            SELECT m.query_id, m.sciper, coalesce(r.d, CAST('Infinity' AS DOUBLE)) AS d
            FROM by_mean m LEFT JOIN (SELECT * FROM by_recency WHERE sciper % 4 = 1) r USING (query_id, sciper))""")})""",
    "semantic_search_cluster": _top("by_cluster"),
    "semantic_search_mixed": _top("mixed"),
    "topic_search_texts": _top("(SELECT query_id, sciper, list_distance(q.e, r.e) AS d FROM topics q, source_means r)"),
    "name_audit": _audit(),
    "nearest_people": """
        SELECT CAST(target AS BIGINT) AS target, CAST(sciper AS BIGINT) AS sciper, round(avg_dist, 4) AS avg_dist,
               round(closest_dist, 4) AS closest_dist, avg_rank, closest_rank, final_mean_rank, place
        FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY final_mean_rank, sciper) AS place
              FROM (SELECT *, (avg_rank + closest_rank) / 2 AS final_mean_rank FROM (
                  SELECT *, rank() OVER (PARTITION BY target ORDER BY avg_dist) + (count(*) OVER (PARTITION BY target, avg_dist) - 1) / 2.0 AS avg_rank,
                         rank() OVER (PARTITION BY target ORDER BY closest_dist) + (count(*) OVER (PARTITION BY target, closest_dist) - 1) / 2.0 AS closest_rank
                  FROM (SELECT a.sciper AS target, b.sciper, list_distance(a.e, b.e) AS avg_dist FROM mean_lists a, mean_lists b)
                  JOIN (SELECT target, sciper, avg(d) AS closest_dist FROM (
                            SELECT a.sciper AS target, b.sciper, list_distance(a.e, b.e) AS d FROM vec a, vec b
                            QUALIFY row_number() OVER (PARTITION BY a.sciper, b.sciper ORDER BY list_distance(a.e, b.e)) <= 3)
                        GROUP BY ALL) USING (target, sciper)))
              WHERE target <> sciper)
        WHERE place <= 20""",
    "lookup_names": """
        SELECT name, min(p.p_partkey) AS sciper, count(p.p_partkey) AS n_matches FROM (
            SELECT DISTINCT upper(substr(w1, 1, length(w1) - 1)) || '  ' || substr(w2, 2) AS name,
                   lower(substr(w1, 1, length(w1) - 1)) AS first, substr(w2, 2) AS last FROM initcaps
            UNION SELECT n_name, lower(n_name), '' FROM nation) q
        LEFT JOIN initcaps p ON contains(p.w1, q.first) AND contains(p.w2, q.last)
        GROUP BY name""",
}

SELECTS |= {
    "cluster_vectors": """
        SELECT CAST(sciper AS BIGINT) AS sciper, cluster, size, weight, CAST(unnest(range(CAST(len(e) AS BIGINT))) AS INTEGER) AS dim, round(unnest(e), 4) + 0.0 AS value
        FROM kmeans_lists""",
    "representative_vectors": """
        SELECT CAST(sciper AS BIGINT) AS sciper, 'mean' AS type, CAST(1 AS DOUBLE) AS weight, dim, round(value, 4) + 0.0 AS value FROM mean_cells
        UNION ALL SELECT sciper, 'recency', 1, dim, round(value, 4) + 0.0 FROM recency_cells
        UNION ALL SELECT sciper, 'cluster', weight, unnest(range(CAST(len(e) AS BIGINT))), round(unnest(e), 4) + 0.0 FROM kmeans_lists""",
    "semantic_search_kmeans": _top("""(
        SELECT query_id, sciper, (m.d + r.d + c.d) / 3 AS d
        FROM by_mean m JOIN by_recency r USING (query_id, sciper) JOIN by_kmeans c USING (query_id, sciper))"""),
    "fuzzy_name_search": """
        SELECT query_id, sciper, round(score, 4) AS match_score, place FROM (
            SELECT query_id, p_partkey AS sciper, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS place
            FROM name_scores JOIN asked_names USING (query) JOIN part ON name = p_name)
        WHERE place <= 5""",
    "nearest_people_named": f"""
        SELECT n.*, email, lastname, firstname, class_acc FROM ({SELECTS['nearest_people']}) n JOIN prof USING (sciper)""",
    "landed_roster": "SELECT * FROM roster",
    "people_sample": "SELECT * FROM prof ORDER BY sciper LIMIT 20",
    "landed_author_details": """
        SELECT sciper, openalex_id, display_name, array_to_string(display_name_alternatives, ';') AS display_name_alternatives, orcid,
               CAST(substr(openalex_id, 23) AS BIGINT) % 7 AS works_count
        FROM sciper_openalex""",
    "landed_works_of_authors": """
        SELECT DISTINCT 'A' || l_partkey AS author_id, 'W' || o_orderkey AS work_id, 'https://doi.org/10.1000/' || o_orderkey AS doi,
               'order ' || o_orderkey AS title, year(o_orderdate) AS publication_year
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
        WHERE o_orderkey % 4 <> 3 AND year(o_orderdate) BETWEEN 1994 AND 1996""",
    "replaced_table": "SELECT cf, unit_name, unit_type FROM lab",
    "published_snapshot": "SELECT *, '20250101_000000' AS last_update FROM lab",
    "report_file": _audit(),
    "publications_of_range": """
        SELECT id_pub, doi, title FROM pub WHERE id_pub >= (SELECT max(id_pub) // 2 FROM pub)""",
    "wanted_orcids": """
        SELECT orcid FROM sciper_openalex WHERE orcid IS NOT NULL UNION SELECT orcid FROM registered""",
    "resolved_authors": f"""
        SELECT m.sciper, openalex_id, capital AS display_name, p_name || ';' || i.p_brand AS display_name_alternatives,
               CASE WHEN i.p_partkey % 3 <> 0 THEN {orcid('i.p_partkey')} END AS orcid, CAST(p_size AS BIGINT) AS works_count
        FROM (SELECT sciper, openalex_id FROM ({SELECTS['matching_authors']}) WHERE sciper NOT IN (SELECT n_nationkey FROM nation)
              UNION ALL SELECT n_nationkey, 'A' || (n_nationkey + 1) FROM nation) m
        JOIN initcaps i ON openalex_id = 'A' || i.p_partkey JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)""",
    "semantic_search_profiles": f"""
        SELECT query_id, match_score, place, {_PROFILE}
        FROM ({_top("(SELECT * FROM by_mean WHERE sciper IN (SELECT sciper FROM profile))")}) JOIN profile USING (sciper)""",
}

ORACLES = {name: _with(select) for name, select in SELECTS.items()}
