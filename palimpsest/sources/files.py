"""Sources and sinks: extraction and index JSON, DOI lists, JATS XML, archives, listings, reports and CSV."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION = "doi string, paper_id string, safe_id string, category string, server string, title string, abstract string, full_text string, text string, month string, filename string, figure_count int, table_count int, figure_paths array<string>, table_paths array<string>, figure_keys array<string>, word_count int, extracted_at string"
_ENTRY = "struct<doi:string,date:string,title:string,server:string,category:string>"
INDEX = f"categories map<string,array<{_ENTRY}>>, last_updated string, total_papers bigint, servers map<string,bigint>"
RECORD = "doi string, title string, authors string, abstract string, category string, date string, version string, license string, jatsxml string, server string"


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Both shapes of extraction documents as one: full_text is either field; broken files give no row."""
    raw = spark.read.schema(EXTRACTION).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("full_text", F.coalesce("full_text", "text")).drop("text")


def read_category_index(spark: SparkSession, path: str) -> DataFrame:
    """The category index as one row per paper; titles to 200 characters, missing categories ``unknown``."""
    raw = spark.read.schema(INDEX).option("multiLine", True).json(path)
    rows = raw.select(F.explode("categories").alias("name", "papers")).select("name", F.explode("papers").alias("p")).select("name", "p.*")
    return rows.withColumns({"title": F.substring("title", 1, 200), "category": F.coalesce("category", "name", F.lit("unknown"))}).drop("name")


def write_category_index(papers: DataFrame, path: str) -> None:
    """One JSON row per category; a category's papers may be many, so rows are sharded by server."""
    papers.groupBy("category", "server").agg(F.collect_list(F.struct("doi", "date", "title")).alias("papers")).write.mode("overwrite").json(path)


def read_doi_list(spark: SparkSession, path: str) -> DataFrame:
    """DOIs of a JSON list, or of an object of lists by server."""
    text = spark.read.option("wholetext", True).text(path)
    listed = text.select(F.lit(None).cast("string").alias("server"), F.explode(F.from_json("value", "array<string>")).alias("doi"))
    keyed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("server", "dois")).select("server", F.explode("dois").alias("doi"))
    return listed.unionByName(keyed).where(F.col("doi").isNotNull())


def normalise_records(records: DataFrame) -> DataFrame:
    """Metadata rows: category lower-cased, bad dates null, abstract to 5000 characters, version 1 if missing."""
    from palimpsest.plans.catalog import with_group

    out = records.withColumns({"category": F.lower("category"), "date": F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date"), "abstract": F.substring("abstract", 1, 5000), "version": F.coalesce(F.expr("try_cast(version as int)"), F.lit(1))})
    return with_group(out)


def read_jats(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JATS XML files, one whole file each: identifiers, title, abstract, date, authors and body text."""
    x = F.col("value")
    one = lambda p: F.trim(F.xpath_string(x, F.lit(p)))
    many = lambda p: F.xpath(x, F.lit(p))
    day = "//pub-date[1]"
    part = lambda p: F.lpad(F.coalesce(F.nullif(F.trim(F.xpath_string(x, F.lit(f"{day}/{p}"))), F.lit("")), F.lit("01")), 2, "0")
    raw = spark.read.option("wholetext", True).text(path)
    doi = one("//article-id[@pub-id-type='doi']")
    return raw.select(
        doi.alias("doi"),
        one("//article-title").alias("title"),
        F.regexp_replace(one("//abstract"), r"\s+", " ").alias("abstract"),
        F.concat_ws("-", one(f"{day}/year"), part("month"), part("day")).alias("date"),
        many("//contrib[@contrib-type='author']//surname/text()").alias("authors"),
        many("//kwd/text()").alias("keywords"),
        one("//subject").alias("subject"),
        one("//body").alias("body"),
        F.when(F.lower(doi).contains("medrxiv"), "medrxiv").otherwise("biorxiv").alias("server"),
    )


def read_archives(spark: SparkSession, path: str, pattern: str = r"\.(xml|pdf)$") -> DataFrame:
    """Members of zip archives whose name matches, as (path, member, content)."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(pattern, re.I)
        for b in batches:
            for p, body in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        for name in sorted(n for n in z.namelist() if wanted.search(n)):
                            yield pd.DataFrame({"path": [p], "member": [name], "content": [z.read(name)]})
                except zipfile.BadZipFile:
                    continue  # a broken archive has no members

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, content binary")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Keys ``kind/server/month/name`` under a path: their parts, size and time, content not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    return files.select("path", "length", "modificationTime", F.element_at(parts, -3).alias("server"), F.element_at(parts, -2).alias("month"), F.element_at(parts, -1).alias("name"))


def storage_stats(objects: DataFrame) -> DataFrame:
    return objects.groupBy("server", "month").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_status_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
