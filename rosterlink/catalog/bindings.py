"""The given tables seen as people, units, publications, authors and texts.

Every binding reads whole tables. The oracle text states the same bindings in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.plans import roster as roster_plan
from rosterlink.session import configure, staged

AS_OF_YEAR = 2025
AUTHORS_PER_PERSON = 15  # customers per supplier in the given tables


class Data:
    """Bindings over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- roster ------------------------------------------------------------------

    def roster(self) -> DataFrame:
        cf = F.substring("p_brand", 7, 4).cast("long")
        day = F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0")
        return (
            self.table("lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
            .join(self.table("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_suppkey").alias("sciper"),
                F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
                F.col("s_name").alias("lastname"),
                F.when(F.col("s_nationkey") > 0, F.concat(F.lit("nation "), F.col("s_nationkey"))).alias("firstname"),
                F.concat(F.lit("2001/01/"), day, F.lit(" 10:20:30")).alias("creation_date"),
                F.concat(F.lit("class "), F.col("s_nationkey") % 3).alias("class_acc"),
                cf.alias("cf"),
                F.col("p_brand").alias("unit_name"),
                F.col("l_returnflag").alias("_flag"),
                F.when(F.col("p_type") == "PROMO", "CENTRE").when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("unit_type"),
                F.floor(cf / 5).alias("cf_level_2"),
                F.floor(cf / 10).alias("cf_level_3"),
                F.concat(F.lit("L2-"), F.floor(cf / 5)).alias("acronym_level_2"),
                F.concat(F.lit("L3-"), F.floor(cf / 10)).alias("acronym_level_3"),
            )
            .withColumn("role", F.when(F.col("_flag") != "N", F.col("_flag"))).drop("_flag")
        )

    @cached_property
    def _memberships(self) -> DataFrame:
        """Distinct roster rows, written once for the two tables cut from them."""
        return staged(self.roster().drop("email", "lastname", "firstname", "creation_date", "class_acc").distinct())

    def lab(self) -> DataFrame:
        return roster_plan.units(self._memberships)

    def sciper_lab(self) -> DataFrame:
        return roster_plan.memberships(self._memberships)

    # ---- people, publications, authors -------------------------------------------

    def prof(self) -> DataFrame:
        """A supplier as a person, named by the two words of the part of the same key."""
        words = F.split("p_name", " ")
        return self.table("supplier").join(
            self.table("part").select("p_partkey", "p_name"), F.col("s_suppkey") == F.col("p_partkey")
        ).select(
            F.col("s_suppkey").alias("sciper"), F.lower("s_name").alias("email"),
            words[1].alias("lastname"), words[0].alias("firstname"),
            F.concat(F.lit("class "), F.col("s_nationkey") % 3).alias("class_acc"),
        )

    def pub(self) -> DataFrame:
        status, key = F.col("o_orderstatus"), F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id_pub"),
            F.when(status != "O", F.concat(F.lit("repo/"), key)).alias("id_infoscience"),
            F.when(key % 11 != 0, F.concat(F.lit("10.1000/"), key)).alias("doi"),
            F.concat(F.lit("order "), key).alias("title"),
            F.when(status == "P", F.col("o_orderpriority")).alias("abstract"),
            F.when(key % 7 != 0, F.year("o_orderdate")).alias("year_issued"),
            F.when(status != "F", F.concat(F.lit("https://openalex.org/W"), key)).alias("openalex_id"),
        )

    def sciper_pub(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("id_pub"), F.col("l_suppkey").alias("sciper")
        ).distinct()

    @staticmethod
    def _orcid(key: Column) -> Column:
        digits = F.lpad(key.cast("string"), 16, "0")
        return F.concat_ws("-", *[F.substring(digits, at, 4) for at in (1, 5, 9, 13)])

    def _authors(self) -> DataFrame:
        return self.table("customer").join(
            self.table("part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("c_custkey") == F.col("p_partkey")
        )

    def sciper_openalex(self) -> DataFrame:
        """A customer as an external author of the supplier that has its range of keys."""
        return self._authors().select(
            F.floor(F.col("c_custkey") / AUTHORS_PER_PERSON).alias("sciper"),
            F.concat(F.lit("https://openalex.org/A"), F.col("c_custkey")).alias("openalex_id"),
            F.initcap("p_name").alias("display_name"),
            F.array("p_name", F.concat_ws(", ", "p_brand", "p_type")).alias("display_name_alternatives"),
            F.when(F.col("c_mktsegment") != "BUILDING", self._orcid(F.col("c_custkey"))).alias("orcid"),
        )

    def registered(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(key.alias("sciper"), self._orcid(key * AUTHORS_PER_PERSON).alias("orcid"))

    def orcid(self) -> DataFrame:
        words = F.split("p_name", " ")
        return self._authors().select(
            self._orcid(F.col("c_custkey")).alias("orcid"),
            F.when(F.col("c_nationkey") % 4 != 0, words[0]).alias("firstname"),
            words[1].alias("lastname"),
            F.array(F.col("c_name"), F.concat_ws("-", words[0], words[1])).alias("other_names"),
        )

    def orcid_links(self) -> DataFrame:
        return self.table("orders").select(
            self._orcid(F.col("o_custkey")).alias("orcid"), F.lower("o_orderpriority").alias("type"),
            F.col("o_orderkey").cast("string").alias("id"),
            F.concat(F.lit("https://links.example.org/"), F.col("o_orderkey")).alias("url"),
        )

    def profile_tables(self) -> dict[str, DataFrame]:
        return {
            "prof": self.prof(), "lab": self.lab(), "sciper_lab": self.sciper_lab(), "sciper_pub": self.sciper_pub(),
            "pub": self.pub(), "sciper_openalex": self.sciper_openalex(), "sciper_orcid_integration": self.registered(),
            "orcid": self.orcid(), "orcid_links": self.orcid_links(),
        }

    # ---- co-authorship -----------------------------------------------------------

    def part_people(self) -> DataFrame:
        """A part as a person; every fifth has a name of one word only."""
        words = F.split("p_name", " ")
        return self.table("part").select(
            F.col("p_partkey").alias("sciper"), words[0].alias("firstname"),
            F.when(F.col("p_partkey") % 5 != 0, words[1]).alias("lastname"),
        )

    def part_pubs(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("id_pub"), F.col("l_partkey").alias("sciper")).distinct()

    def order_works(self) -> DataFrame:
        """An order as a work whose authors are its parts."""
        author = F.struct(
            F.concat(F.lit("A"), F.col("p_partkey")).alias("id"), F.initcap("p_name").alias("display_name")
        ).alias("author")
        return (
            self.table("lineitem").select("l_orderkey", "l_partkey")
            .join(self.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_orderkey").agg(F.collect_list(F.struct(author)).alias("authorships"))
            .select(F.concat(F.lit("https://doi.org/10.1000/"), F.col("l_orderkey")).alias("doi"), "authorships")
        )

    # ---- titles ------------------------------------------------------------------

    def _titles(self, how: str) -> DataFrame:
        return self.table("documents").join(self.table("labels").select("doc_id"), "doc_id", how)

    def catalogued(self) -> tuple[DataFrame, DataFrame]:
        """Labelled documents as publications, their language as the person."""
        docs = self._titles("left_semi")
        pub = docs.select(
            F.col("doc_id").alias("id_pub"), F.concat(F.lit("repo/"), F.col("doc_id")).alias("id_infoscience"),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), F.col("n_chars"))).alias("doi"),
            F.col("text").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("abstract"),
            F.lit(2020).alias("year_issued"),
        )
        return pub, docs.select(F.col("doc_id").alias("id_pub"), F.col("lang").alias("sciper"))

    def found_works(self) -> DataFrame:
        """Unlabelled documents as works of the person their language stands for."""
        docs = self._titles("left_anti")
        return docs.select(
            F.col("lang").alias("sciper"), F.concat(F.lit("W"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("work_id"),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), F.col("n_chars"))).alias("doi"),
            text.text_fold(F.col("text")).alias("title"),
            F.when(F.col("doc_id") % 5 != 0, F.col("source")).otherwise("").alias("abstract"),
            F.lit(2021).alias("year_issued"),
        )

    # ---- texts and vectors -------------------------------------------------------

    def document_pub(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id_pub"), F.col("source").alias("title"), F.col("text").alias("abstract")
        )

    def benchmark_pub(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("id_pub"), F.lit(None).cast("string").alias("title"), F.col("text").alias("abstract")
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("label").cast("long").alias("sciper"), F.col("vec_id").alias("id_pub"),
            F.when(F.col("vec_id") % 7 != 0, (F.lit(2015) + F.col("vec_id") % 10).cast("int")).alias("year_issued"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
