"""Catalogue of documents: taxonomy, worklists, funnel counts, presence, upserts and incremental windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import constants as K

FLAGS = ("pdf_downloaded", "content_extracted", "text_embedded", "figures_embedded", "tables_embedded")


def taxonomy(spark: SparkSession) -> DataFrame:
    """category, group_id, group_name, priority, ordinal: a fixed dimension of 75 rows."""
    rows, n = [], 0
    for priority, (group, name, categories) in enumerate(K.GROUPS, 1):
        for c in categories:
            rows.append((c, group, name, priority, n))
            n += 1
    return spark.createDataFrame(rows, "category string, group_id string, group_name string, priority int, ordinal int")


def with_group(papers: DataFrame, category: str = "category") -> DataFrame:
    """Group of each category, whatever its case; unknown ones go to the default. The dimension is broadcast: it is fixed."""
    dim = F.broadcast(taxonomy(papers.sparkSession).select(F.col("category").alias("__c"), "group_id"))
    return papers.join(dim, F.lower(category) == F.col("__c"), "left").drop("__c").withColumn("group_id", F.coalesce("group_id", F.lit(K.DEFAULT_GROUP)))


def fully_embedded() -> Column:
    return F.col("text_embedded") & F.col("figures_embedded") & F.col("tables_embedded")


def funnel(papers: DataFrame) -> DataFrame:
    """All funnel counts in one pass."""
    counted = papers.agg(
        F.count("*").alias("total"),
        *[F.count_if(f).alias(f) for f in FLAGS],
        F.count_if(fully_embedded()).alias("fully_embedded"),
    )
    return counted.withColumns({"pending_download": F.expr("total - pdf_downloaded"), "pending_extract": F.expr("pdf_downloaded - content_extracted"), "pending_embed": F.expr("content_extracted - fully_embedded")})


STATUS_FILTERS: dict[str, str] = {
    "downloaded": "pdf_downloaded",
    "not_downloaded": "NOT pdf_downloaded",
    "extracted": "content_extracted",
    "not_extracted": "pdf_downloaded AND NOT content_extracted",
    "embedded": "text_embedded AND figures_embedded AND tables_embedded",
    "missing_embed": "content_extracted AND NOT (text_embedded AND figures_embedded AND tables_embedded)",
    "missing_figures": "content_extracted AND text_embedded AND NOT figures_embedded",
    "missing_tables": "content_extracted AND text_embedded AND NOT tables_embedded",
}
EMBED_MODES = {"all": "NOT (text_embedded AND figures_embedded AND tables_embedded)", "text": "NOT text_embedded", "figures": "NOT figures_embedded", "tables": "NOT tables_embedded"}


def by_status(papers: DataFrame, status: str | None) -> DataFrame:
    """Rows of a named status; any other name filters nothing."""
    return papers.where(STATUS_FILTERS[status]) if status in STATUS_FILTERS else papers


def worklist(papers: DataFrame, step: str, limit: int, mode: str = "all", date: str = "date", key: str = "doi") -> DataFrame:
    """Next rows for a step, newest first, rows without a date before them; unknown modes mean text, unknown steps no filter."""
    rule = {"download": "NOT pdf_downloaded", "extract": "pdf_downloaded AND NOT content_extracted", "embed": f"content_extracted AND {EMBED_MODES.get(mode, EMBED_MODES['text'])}"}.get(step, "true")
    return papers.where(rule).orderBy(F.desc_nulls_first(date), key).limit(limit)


def unprocessed(papers: DataFrame, step: str, category: str | None, limit: int, key: str = "doi") -> DataFrame:
    """Rows that a step has not been done for, of a category in whatever case; an unknown step filters nothing.

    The order is by key, so that the limit is the same in every run.
    """
    rule = {"download": "NOT pdf_downloaded", "extract": "NOT content_extracted", "embed": "NOT text_embedded"}.get(step, "true")
    rows = papers.where(rule)
    return (rows if category is None else rows.where(matches_category(F.col("category"), category, "equals"))).orderBy(key).limit(limit)


def id_variants(x: Column) -> Column:
    """The spellings under which an id may be stored, the likeliest first: as it is, after the slash, with _ for / and ., with _ for /, lower case."""
    return F.array(x, F.element_at(F.split(x, "/"), -1), F.regexp_replace(x, r"[./]", "_"), F.regexp_replace(x, "/", "_"), F.lower(x))


def lookup(wanted: DataFrame, stored: DataFrame, fields: list[str], most: int = 100) -> DataFrame:
    """``wanted(id)`` with the first (spelling, field) that ``stored`` has, and how many rows it has there (at most ``most``).

    Spellings are tried before fields. Ids that are nowhere are left out.
    """
    tries = wanted.select("id", F.posexplode(id_variants(F.col("id"))).alias("spelling", "value"))
    held = None
    for k, f in enumerate(fields):
        own = stored.select(F.col(f).cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("field", F.lit(k))
        held = own if held is None else held.unionByName(own)
    hit = tries.join(held, "value").groupBy("id").agg(F.min(F.struct("spelling", "field", "n")).alias("h"))
    return hit.select("id", "h.spelling", "h.field", F.least("h.n", F.lit(most)).alias("n"))


def matches_category(category: Column, wanted: str, how: str = "contains") -> Column:
    c, w = F.lower(category), wanted.lower()
    return {"exact": category == F.lit(wanted), "equals": c == F.lit(w), "contains": c.contains(w)}[how]


def counts(papers: DataFrame) -> DataFrame:
    """Counts by category, group and server and the total in one pass; a null category is a group of its own."""
    out = with_group(papers).groupingSets([["category"], ["group_id"], ["server"], []], "category", "group_id", "server").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "group").when(F.col("g") == 6, "server").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("category", "group_id", "server").alias("name"), "n")


def group_rollup(papers: DataFrame) -> DataFrame:
    """Every group with the papers of its categories, zero included, by priority."""
    per = papers.groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("n"))
    dim = taxonomy(papers.sparkSession)
    return dim.join(per, "category", "left").groupBy("group_id", "group_name", "priority").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_papers")).orderBy("priority")


def presence(text: DataFrame, image: DataFrame, key: str) -> DataFrame:
    """Keys and whether they have text, image or both; empty keys count as missing."""
    a = text.select(F.nullif(key, F.lit("")).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("t", F.lit(True))
    b = image.select(F.nullif(key, F.lit("")).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("i", F.lit(True))
    state = F.when(F.col("t") & F.col("i"), "both").when(F.col("t"), "text_only").otherwise("image_only")
    return a.join(b, key, "full").select(key, state.alias("state"))


def pending(keys: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Keys that none of ``done`` has: filter before any expensive step."""
    out = keys
    for d in done:
        out = out.join(d.select(key).distinct(), key, "left_anti")
    return out


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: str, updated: list[str]) -> DataFrame:
    """Existing rows with ``updated`` columns from the batch's last row of each key; new keys are added whole."""
    last = batch.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__rank = 1").drop("__rank")
    new = last.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in last.columns if c != key], F.lit(True).alias("__there"))
    joined = existing.withColumn("__old", F.lit(True)).join(new, key, "full")
    cols = [F.col(key)]
    for c in existing.columns:
        if c == key:
            continue
        fresh = F.col(f"__new_{c}") if c in last.columns else F.lit(None)
        cols.append((F.when(F.col("__old").isNull(), fresh).when(F.col("__there"), F.coalesce(fresh, F.col(c))).otherwise(F.col(c)) if c in updated else F.when(F.col("__old").isNull(), fresh).otherwise(F.col(c))).alias(c))
    return joined.select(*cols)


def dedupe_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__rank = 1").drop("__rank")


def recent(rows: DataFrame, date: str, days: int, reference: str) -> DataFrame:
    return rows.where(F.col(date) >= F.date_sub(F.lit(reference).cast("date"), days))


def proportional_limit(rows: DataFrame, is_old: Column, most: int, *order: str | Column) -> DataFrame:
    """At most ``most`` rows of two strata: old ones by their share (rounded down), the rest new ones."""
    sizes = rows.agg(F.count_if(is_old).alias("__old"), F.count("*").alias("__all"))
    marked = rows.withColumn("__is_old", is_old).crossJoin(F.broadcast(sizes))  # one row
    old = F.when(F.col("__all") <= most, F.col("__old")).otherwise(F.floor(F.col("__old") * most / F.col("__all")))
    quota = F.when(F.col("__is_old"), old).otherwise(F.least(F.col("__all"), F.lit(most)) - old)
    ranked = marked.withColumn("__quota", quota).withColumn("__rank", F.row_number().over(W.partitionBy("__is_old").orderBy(*order)))
    return ranked.where("__rank <= __quota").drop("__is_old", "__old", "__all", "__quota", "__rank")


def fold_results(results: DataFrame, ok: Column, skipped: Column, size: Column) -> DataFrame:
    """Counts, bytes and success rate of a batch of results."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok & skipped).alias("skipped"),
        F.count_if(~ok & ~skipped).alias("failed"),
        F.coalesce(F.sum(F.when(ok, size)), F.lit(0.0)).alias("bytes"),
    ).withColumn("success_rate", F.try_divide("success", "total"))
