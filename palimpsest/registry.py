"""All queries of the reuse engine and their SQL twins, written from the formulas on either side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import aitext, images
from palimpsest.functions import constants as K
from palimpsest.functions import papers as P
from palimpsest.functions import text as T
from palimpsest.operators import lexical as L
from palimpsest.operators import segments, vectors
from palimpsest.plans import catalog as C

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents and labels in the shape of the catalogue."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = d.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    text = good & F.coalesce(F.col("toxic") == 0, F.lit(False))
    return p.select(
        F.col("doc_id").cast("string").alias("doi"), F.col("source").alias("category"), F.col("lang").alias("server"), "n_chars",
        F.col("quality").isNotNull().alias("pdf_downloaded"), good.alias("content_extracted"), text.alias("text_embedded"),
        (text & (F.col("n_chars") > 1500)).alias("figures_embedded"), (text & (F.col("n_chars") > 3000)).alias("tables_embedded"),
    )


_PAPERS = """papers AS (SELECT CAST(d.doc_id AS VARCHAR) AS doi, source AS category, lang AS server, n_chars,
  quality IS NOT NULL AS pdf_downloaded, coalesce(quality = 1, false) AS content_extracted,
  coalesce(quality = 1 AND toxic = 0, false) AS text_embedded,
  coalesce(quality = 1 AND toxic = 0 AND n_chars > 1500, false) AS figures_embedded,
  coalesce(quality = 1 AND toxic = 0 AND n_chars > 3000, false) AS tables_embedded
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_DIM = "dim(category, group_id, group_name, priority) AS (VALUES " + ", ".join(f"('{c}', '{g}', '{n.replace(chr(39), chr(39) * 2)}', {p})" for p, (g, n, cs) in enumerate(K.GROUPS, 1) for c in cs) + ")"
_TOK_B = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_TOK_A = "list_filter(string_split_regex(trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')), '\\s+'), lambda x: length(x) > 1)"
_WORDS = "list_filter(string_split_regex({t}, '\\s+'), lambda x: length(x) > 0)"


def _grams(tokens: str, n: int) -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE [] END"


# --- catalogue -----------------------------------------------------------------------------------------------


@_query(f"""WITH {_PAPERS}, c AS (SELECT count(*) AS total, count(*) FILTER (pdf_downloaded) AS pdf_downloaded, count(*) FILTER (content_extracted) AS content_extracted,
  count(*) FILTER (text_embedded) AS text_embedded, count(*) FILTER (figures_embedded) AS figures_embedded, count(*) FILTER (tables_embedded) AS tables_embedded,
  count(*) FILTER (text_embedded AND figures_embedded AND tables_embedded) AS fully_embedded FROM papers)
  SELECT *, total - pdf_downloaded AS pending_download, pdf_downloaded - content_extracted AS pending_extract, content_extracted - fully_embedded AS pending_embed FROM c""")
def funnel_stats(spark, sf_dir):
    return C.funnel(papers(spark, sf_dir))


@_query(f"""WITH {_PAPERS} SELECT 'category' AS kind, category AS name, count(*) AS n FROM papers GROUP BY category
  UNION ALL SELECT 'group', 'other_specialties', count(*) FROM papers UNION ALL SELECT 'server', server, count(*) FROM papers GROUP BY server
  UNION ALL SELECT 'total', NULL, count(*) FROM papers""")
def catalog_counts(spark, sf_dir):
    return C.counts(papers(spark, sf_dir))


def _with_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as papers of taxonomy categories, by nation."""
    names = F.array(*[F.lit(c) for _, _, cs in K.GROUPS for c in cs])
    return _table(spark, sf_dir, "customer").select(F.upper(F.element_at(names, F.col("c_nationkey") + 1)).alias("category"), F.col("c_mktsegment").alias("server"))


_CUST = "p AS (SELECT ([" + ", ".join(f"'{c}'" for _, _, cs in K.GROUPS for c in cs) + "])[c_nationkey + 1] AS category FROM customer)"


@_query(f"""WITH {_DIM}, {_CUST}, n AS (SELECT category, count(*) AS n FROM p GROUP BY category)
  SELECT group_id, group_name, priority, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_papers FROM dim LEFT JOIN n USING (category) GROUP BY ALL""")
def taxonomy_rollup(spark, sf_dir):
    return C.group_rollup(_with_taxonomy(spark, sf_dir))


@_query(f"WITH {_DIM}, {_CUST} SELECT p.category, group_id, count(*) AS n FROM p JOIN dim USING (category) GROUP BY ALL")
def category_listing(spark, sf_dir):
    return C.with_group(_with_taxonomy(spark, sf_dir)).groupBy(F.lower("category").alias("category"), "group_id").agg(F.count("*").alias("n"))


@_query(f"WITH {_PAPERS} SELECT category, count(*) AS total, CAST(sum(CAST(pdf_downloaded AS INT)) AS BIGINT) AS downloaded FROM papers GROUP BY category ORDER BY total DESC, category LIMIT 10")
def category_breakdown(spark, sf_dir):
    return papers(spark, sf_dir).groupBy("category").agg(F.count("*").alias("total"), F.sum(F.col("pdf_downloaded").cast("int")).alias("downloaded")).orderBy(F.desc("total"), "category").limit(10)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doi"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderstatus") != "O").alias("pdf_downloaded"), (F.col("o_orderstatus") == "F").alias("content_extracted"), (F.col("o_orderpriority") == "1-URGENT").alias("text_embedded"), (F.col("o_totalprice") > 100000).alias("figures_embedded"), (F.col("o_totalprice") > 200000).alias("tables_embedded"))


_ORDERS = "o AS (SELECT o_orderkey AS doi, CAST(o_orderdate AS DATE) AS date, o_orderstatus <> 'O' AS pdf_downloaded, o_orderstatus = 'F' AS content_extracted, o_orderpriority = '1-URGENT' AS text_embedded, o_totalprice > 100000 AS figures_embedded, o_totalprice > 200000 AS tables_embedded FROM orders)"


@_query(f"WITH {_ORDERS} SELECT doi, date FROM o WHERE NOT pdf_downloaded ORDER BY date DESC NULLS FIRST, doi LIMIT 100")
def worklist_download(spark, sf_dir):
    return C.worklist(_orders(spark, sf_dir), "download", 100).select("doi", "date")


@_query(f"WITH {_ORDERS} SELECT doi, date FROM o WHERE pdf_downloaded AND NOT content_extracted ORDER BY date DESC NULLS FIRST, doi LIMIT 100")
def worklist_extract(spark, sf_dir):
    return C.worklist(_orders(spark, sf_dir), "extract", 100).select("doi", "date")


@_query(f"""WITH {_ORDERS}, r AS (SELECT 'all' AS mode, doi, row_number() OVER (ORDER BY date DESC NULLS FIRST, doi) AS k FROM o WHERE content_extracted AND NOT (text_embedded AND figures_embedded AND tables_embedded)
  UNION ALL SELECT 'text', doi, row_number() OVER (ORDER BY date DESC NULLS FIRST, doi) FROM o WHERE content_extracted AND NOT text_embedded
  UNION ALL SELECT 'figures', doi, row_number() OVER (ORDER BY date DESC NULLS FIRST, doi) FROM o WHERE content_extracted AND NOT figures_embedded
  UNION ALL SELECT 'tables', doi, row_number() OVER (ORDER BY date DESC NULLS FIRST, doi) FROM o WHERE content_extracted AND NOT tables_embedded) SELECT mode, doi FROM r WHERE k <= 50""")
def worklist_embed(spark, sf_dir):
    o = _orders(spark, sf_dir)
    parts = [C.worklist(o, "embed", 50, mode).select(F.lit(mode).alias("mode"), "doi") for mode in C.EMBED_MODES]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@_query(f"WITH {_PAPERS} " + " UNION ALL ".join(f"SELECT '{k}' AS status, count(*) AS n FROM papers WHERE {v}" for k, v in C.STATUS_FILTERS.items()))
def status_filters(spark, sf_dir):
    counted = papers(spark, sf_dir).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in C.STATUS_FILTERS.items()])
    return counted.unpivot([], list(C.STATUS_FILTERS), "status", "n")


@_query(f"WITH {_PAPERS} SELECT doi, CASE WHEN length(category) > 4 THEN substr(category, 1, 4) || '...' ELSE category END AS label, round(n_chars / 1024.0, 1) AS kb, text_embedded AND figures_embedded AND tables_embedded AS fully_embedded FROM papers")
def status_projection(spark, sf_dir):
    label = F.when(F.length("category") > 4, F.concat(F.substring("category", 1, 4), F.lit("..."))).otherwise(F.col("category"))
    return papers(spark, sf_dir).select("doi", label.alias("label"), F.round(F.col("n_chars") / 1024.0, 1).cast("double").alias("kb"), C.fully_embedded().alias("fully_embedded"))


@_query(f"WITH {_PAPERS} SELECT doi FROM papers WHERE contains(lower(category), 'src1')")
def category_search(spark, sf_dir):
    return papers(spark, sf_dir).where(C.matches_category(F.col("category"), "SRC1")).select("doi")


@_query("SELECT coalesce(t.k, i.k) AS k, CASE WHEN t.k IS NOT NULL AND i.k IS NOT NULL THEN 'both' WHEN t.k IS NOT NULL THEN 'text_only' ELSE 'image_only' END AS state FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS k FROM documents) t FULL JOIN (SELECT DISTINCT CAST(vec_id AS VARCHAR) AS k FROM embeddings) i ON t.k = i.k")
def presence_three_way(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"))
    return C.presence(d, _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("k")), "k")


@_query("SELECT doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_keys(spark, sf_dir):
    return C.pending(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")), [_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k")), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"))], "k")


@_query("WITH v AS (SELECT label AS paper, 0 AS t, 1 AS f FROM embeddings UNION ALL SELECT CAST(doc_id // 100 AS INT), 1, 0 FROM documents) SELECT paper, CAST(sum(t) AS BIGINT) AS n_text, CAST(sum(f) AS BIGINT) AS n_image FROM v GROUP BY paper HAVING sum(f) > 0")
def media_counts(spark, sf_dir):
    text = _table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).cast("int").alias("paper")).agg(F.count("*").alias("n_text"))
    image = _table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("paper")).agg(F.count("*").alias("n_image"))
    return image.join(text, "paper", "left").select("paper", F.coalesce("n_text", F.lit(0)).cast("long").alias("n_text"), "n_image")


@_query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    none = e.limit(0)
    return C.upsert(none, e, "user_id", "event_id", ["event_id", "event_type", "value"]).select("user_id", "event_type", "value")


@_query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    return C.dedupe_first(_table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")


@_query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - INTERVAL 30 DAY")
def recent_window(spark, sf_dir):
    return C.recent(_table(spark, sf_dir, "orders"), "o_orderdate", 30, "2001-08-01").select("o_orderkey")


@_query("""WITH o AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders), n AS (SELECT count(*) FILTER (old) AS a, count(*) AS b FROM o),
  r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY o_orderkey) AS k FROM o, n)
  SELECT o_orderkey FROM r WHERE k <= CASE WHEN b <= 500 THEN b WHEN old THEN floor(a * 500 / b) ELSE 500 - floor(a * 500 / b) END""")
def proportional_limit(spark, sf_dir):
    return C.proportional_limit(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), 500, "o_orderkey").select("o_orderkey")


@_query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS success, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type NOT IN ('click', 'view')) AS failed, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS bytes, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS success_rate FROM events")
def status_fold(spark, sf_dir):
    t = F.col("event_type")
    f = C.fold_results(_table(spark, sf_dir, "events"), t == "click", t == "view", F.col("value"))
    return f.withColumns({"bytes": F.round("bytes", 4), "success_rate": F.round("success_rate", 6)})


@_query("SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def processing_totals(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("long")), F.lit(0)).alias("k"))


@_query("SELECT conv_id, count(*) AS n, arg_min(text, turn) AS sample FROM conversations GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 20")
def chunk_counts(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("sample")).orderBy(F.desc("n"), "conv_id").limit(20)


@_query("SELECT doc_id AS k FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT page_id FROM pages")
def distinct_keys(spark, sf_dir):
    t = [_table(spark, sf_dir, n).select(F.col(k).alias("k")) for n, k in (("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"))]
    return t[0].union(t[1]).union(t[2]).distinct()


@_query("SELECT r_name, CAST(count(c_custkey) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def region_rollup(spark, sf_dir):
    per = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = _table(spark, sf_dir, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


# --- text ----------------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, CAST(len({_TOK_A.format(t='text')}) AS INT) AS n_a, CAST(len({_TOK_B}) AS INT) AS n_b, CAST(len(list_distinct({_TOK_B})) AS INT) AS n_distinct FROM documents")
def token_stats(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", T.tokens_a("text").alias("a"), T.tokens_b("text").alias("b"))
    return d.select("doc_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size(F.array_distinct("b")).alias("n_distinct"))


@_query(f"WITH t AS (SELECT doc_id, {_TOK_B} AS b FROM documents) SELECT doc_id, " + ", ".join(f"CAST(len(list_distinct({_grams('b', n)})) AS INT) AS n{n}" for n in (3, 4, 5, 7)) + " FROM t")
def ngram_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.ngram_numbers("text", (3, 4, 5, 7)).alias("g")).select("doc_id", "g.*")


@_query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31))) AS s FROM documents),
  t AS (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM s) SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM t WHERE length(s) > 20 GROUP BY doc_id""")
def sentence_split(spark, sf_dir):
    s = _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@_query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(translate(text, '{K.INVISIBLE}', ''), ' +', ' ', 'g'), '\r\n|\r', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean("text")).alias("digest"))


def _sql_any(text: str, patterns: list[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({text}, '{joined}')"


@_query(f"SELECT doc_id, {_sql_any('lower(text)', K.BOILERPLATE_BASE)} AS base, {_sql_any('lower(text)', K.BOILERPLATE_ENHANCED)} AS enhanced, {_sql_any('lower(text)', K.COMMON_PHRASES)} AS common FROM documents")
def pattern_flags(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.is_boilerplate("text", False).alias("base"), T.is_boilerplate("text").alias("enhanced"), T.has_common_phrase("text").alias("common"))


_CITED = ["as Smith (2023) says", "see [12] there", "Smith et al. found", "according to them", "nothing here", "(smith et al., 2020)", "[1-3] and [4, 5]", "previously shown"]


@_query("WITH t(text) AS (VALUES " + ", ".join(f"('{x}')" for x in _CITED) + ") SELECT text, CASE WHEN NOT " + _sql_any("text", ["(?i)" + "|".join(f"(?:{p})" for p in K.CITATIONS)]) + r" THEN NULL WHEN regexp_matches(text, '\[\s*\d+') THEN 'numbered' WHEN regexp_matches(text, '\(\s*\d{4}\s*\)') THEN 'author_year' WHEN regexp_matches(text, '(?i)et\s+al') THEN 'author_reference' ELSE 'contextual' END AS kind FROM t")
def citation_types(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _CITED], "text string").select("text", T.citation_type("text").alias("kind"))


_CITED_SQL = "coalesce(NOT " + _sql_any("text", ["(?i)" + "|".join(f"(?:{p})" for p in K.CITATIONS)]) + ", true)"


@_query(f"SELECT doc_id, CASE WHEN {_CITED_SQL}" + r" THEN NULL WHEN regexp_matches(text, '\[\s*\d+') THEN 'numbered' WHEN regexp_matches(text, '\(\s*\d{4}\s*\)') THEN 'author_year' WHEN regexp_matches(text, '(?i)et\s+al') THEN 'author_reference' ELSE 'contextual' END AS kind FROM documents")
def citation_types_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.citation_type("text").alias("kind"))


def _chunk_sql(size: int, step: int, least: int, short: bool) -> str:
    w = _WORDS.format(t="text")
    whole = f"SELECT doc_id, 0 AS start, CAST(len(w) AS INT) AS n_words FROM t WHERE len(w) <= {size} UNION ALL " if short else ""
    return f"WITH t AS (SELECT doc_id, {w} AS w FROM documents) {whole}SELECT doc_id, CAST(s AS INT) AS start, CAST(least({size}, len(w) - s) AS INT) AS n_words FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS s FROM t{f' WHERE len(w) > {size}' if short else ''}) WHERE least({size}, len(w) - s) >= {least}"


@_query(_chunk_sql(200, 100, 50, True))
def chunk_query(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.inline(T.chunks_query("text"))).drop("chunk")


@_query(_chunk_sql(200, 100, 100, False))
def chunk_index(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.inline(T.chunks_index("text"))).drop("chunk")


@_query(_chunk_sql(512, 462, 50, False))
def chunk_bulk(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.inline(T.chunks_bulk("text"))).drop("chunk")


@_query("SELECT doc_id, lang || '_' || '2024_01_02_' || doc_id AS paper, lang || '_2024_01_02_' || doc_id || '_chunk_7' AS chunk, '10.1101/2024.01.02.' || doc_id AS doi, '2024' AS year FROM documents")
def paper_ids(spark, sf_dir):
    doi = F.concat(F.lit("10.1101/2024.01.02."), F.col("doc_id").cast("string"))
    d = _table(spark, sf_dir, "documents").select("doc_id", T.paper_id(F.col("lang"), doi).alias("paper"), T.doi_date(doi)["year"].alias("year"))
    return d.select("doc_id", "paper", T.chunk_id(F.col("paper"), F.lit(7)).alias("chunk"), T.doi_from_paper_id(F.col("paper")).alias("doi"), "year")


@_query("SELECT doc_id, CAST(length(text) - length(replace(text, 'the', 'th')) AS INT) AS n, round(coalesce(nullif(instr(text, 'the'), 0) / length(text), 0), 6) AS at FROM documents")
def keyword_profile(spark, sf_dir):
    at = F.coalesce(F.try_divide(F.instr("text", "the"), F.length("text")), F.lit(0.0))  # an empty text has no place, as in SQL
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("the")).alias("n"), (F.round(at * 1e6) / 1e6).alias("at"))  # halves as DuckDB rounds them


@_query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:10]) AS l FROM documents), t AS (SELECT doc_id, trim(l, ' ') AS l FROM l) SELECT doc_id, max({'n': length(l), 'line': l}).line AS title FROM t WHERE length(l) > 20 AND length(l) < 300 GROUP BY doc_id")
def title_guesses(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.title_guess("text").alias("title")).where("title IS NOT NULL")


# --- reuse ---------------------------------------------------------------------------------------------------

_SHINGLES = f"""b AS (SELECT item_id, {_TOK_B} AS w FROM benchmark), d AS (SELECT doc_id, {_TOK_B} AS w FROM documents),
  bs AS (SELECT DISTINCT item_id, unnest({_grams('w', 5)}) AS s FROM b), dsh AS (SELECT DISTINCT doc_id, unnest({_grams('w', 5)}) AS s FROM d),
  pairs AS (SELECT item_id, doc_id, count(*) AS phrases FROM bs JOIN dsh USING (s) GROUP BY ALL HAVING count(*) >= 3),
  bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
  bw AS (SELECT DISTINCT item_id, unnest(w) AS t FROM b), dw AS (SELECT DISTINCT doc_id, unnest(w) AS t FROM d),
  ov AS (SELECT p.item_id, p.doc_id, count(dw.t) AS shared, count(*) AS n FROM pairs p JOIN bw ON bw.item_id = p.item_id LEFT JOIN dw ON dw.doc_id = p.doc_id AND dw.t = bw.t GROUP BY ALL),
  m AS (SELECT p.item_id, p.doc_id, p.phrases, round(p.phrases / bn.n, 6) AS containment, round(ov.shared / ov.n, 6) AS overlap, .6 * (ov.shared / ov.n) + .4 * (p.phrases / bn.n) AS lexical
    FROM pairs p JOIN bn USING (item_id) JOIN ov ON ov.item_id = p.item_id AND ov.doc_id = p.doc_id)"""


def _reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = (_table(spark, sf_dir, t).select(k, "text") for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    pairs = L.shared_shingles(items, docs, "item_id", "doc_id")
    q = items.select("item_id", T.tokens_b("text").alias("q"))
    s = docs.select("doc_id", T.tokens_b("text").alias("s"))
    m = pairs.join(q, "item_id").join(s, "doc_id")
    m = m.select("item_id", "doc_id", "phrases", (F.col("phrases") / F.size(T.ngrams(F.col("q"), 5))).alias("c"), L.set_overlap(F.col("q"), F.col("s")).alias("o"))
    return m.select("item_id", "doc_id", "phrases", F.round("c", 6).alias("containment"), F.round("o", 6).alias("overlap"), (0.6 * F.col("o") + 0.4 * F.col("c")).alias("lexical"))


@_query(f"WITH {_SHINGLES}, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical, 6) DESC, phrases DESC, doc_id) AS rank FROM m WHERE (lexical >= .25 AND phrases >= 3) OR phrases >= 10 OR (overlap >= .7 AND phrases >= 5)) SELECT item_id, doc_id, phrases, containment, overlap, round(lexical, 6) AS lexical, CAST(rank AS INT) AS rank FROM k WHERE rank <= 20")
def passage_reuse_topk(spark, sf_dir):
    kept = _reuse(spark, sf_dir).where(L.keep_rule(F.col("lexical"), F.col("overlap"), F.col("phrases"))).withColumn("lexical", F.round("lexical", 6))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("lexical"), F.desc("phrases"), "doc_id"))
    return kept.withColumn("rank", rank).where("rank <= 20")




def _pair_sql() -> str:
    sides = ", ".join(f"list_distinct({_grams(v, n)}) AS {v}{n}" for v in ("q", "s") for n in (3, 4, 5, 7))
    con = ", ".join(f"CASE WHEN len(q{n}) > 0 THEN len(list_intersect(q{n}, s{n})) / len(q{n}) ELSE 0.0 END AS c{n}" for n in (3, 4, 5, 7))
    return f"""WITH {_SHINGLES}, t AS (SELECT p.item_id, p.doc_id, bb.text AS bt, dd.text AS dt, {_TOK_A.format(t='bb.text')} AS q, {_TOK_A.format(t='dd.text')} AS s FROM pairs p JOIN benchmark bb USING (item_id) JOIN documents dd ON dd.doc_id = p.doc_id),
  g AS (SELECT *, {sides}, list_distinct(list_filter(string_split_regex(lower(bt), '\\s+'), lambda x: length(x) > 0)) AS lw, list_distinct(list_filter(string_split_regex(lower(dt), '\\s+'), lambda x: length(x) > 0)) AS rw FROM t),
  tq AS (SELECT item_id, doc_id, t, count(*) AS n FROM (SELECT item_id, doc_id, unnest(q) AS t FROM t) GROUP BY ALL), ts AS (SELECT item_id, doc_id, t, count(*) AS n FROM (SELECT item_id, doc_id, unnest(s) AS t FROM t) GROUP BY ALL),
  mo AS (SELECT tq.item_id, tq.doc_id, sum(least(tq.n, coalesce(ts.n, 0))) / sum(tq.n) AS o FROM tq LEFT JOIN ts ON tq.item_id = ts.item_id AND tq.doc_id = ts.doc_id AND tq.t = ts.t GROUP BY ALL),
  v AS (SELECT g.item_id, g.doc_id, {con}, len(list_intersect(q5, s5)) / len(list_distinct(list_concat(q5, s5))) AS j, mo.o, len(list_intersect(lw, rw)) / greatest(len(lw), len(rw)) AS ch FROM g JOIN mo ON g.item_id = mo.item_id AND g.doc_id = mo.doc_id),
  w AS (SELECT *, .4 * c5 + .3 * o + .2 * ch + .1 * j AS comb, .35 * greatest(c3, c4, c5, c7) + .35 * o + .2 * ch + .1 * j AS lex FROM v)"""


def _measured(spark: SparkSession, sf_dir: str, measure=L.pair_metrics) -> DataFrame:
    items, docs = (_table(spark, sf_dir, t).select(k, F.col("text").alias(n)) for t, k, n in (("benchmark", "item_id", "query_text"), ("documents", "doc_id", "source_text")))
    pairs = L.shared_shingles(items.withColumnRenamed("query_text", "text"), docs.withColumnRenamed("source_text", "text"), "item_id", "doc_id")
    return measure(pairs.join(items, "item_id").join(docs, "doc_id"))


@_query(_pair_sql() + " SELECT item_id, doc_id, round(c3, 6) AS containment_3, round(c5, 6) AS containment_5, round(c7, 6) AS containment_7, round(j, 6) AS jaccard, round(o, 6) AS word_overlap, round(ch, 6) AS char_similarity, round(comb, 6) AS combined, round(lex, 6) AS lexical FROM w")
def pair_metrics(spark, sf_dir):
    m = _measured(spark, sf_dir)
    return m.select("item_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("containment_3", "containment_5", "containment_7", "jaccard", "word_overlap", "char_similarity", "combined", "lexical")])


@_query(_pair_sql() + """ SELECT item_id, doc_id, CASE WHEN comb >= .95 THEN CASE WHEN ch > .95 THEN 'EXACT_COPY' ELSE 'DIRECT_COPY' END WHEN comb >= .8 THEN CASE WHEN o > .7 THEN 'DIRECT_COPY' ELSE 'PARAPHRASE' END
  WHEN comb >= .5 THEN CASE WHEN c5 > .6 AND o < .5 THEN 'MOSAIC' ELSE 'PARAPHRASE' END WHEN c5 > .2 OR o > .2 THEN 'COMMON_KNOWLEDGE' ELSE 'NO_MATCH' END AS match_type FROM w""")
def base_classify(spark, sf_dir):
    return _measured(spark, sf_dir).select("item_id", "doc_id", L.classify_base(*[F.col(c) for c in ("containment_5", "word_overlap", "char_similarity", "jaccard")]).alias("match_type"))


@_query()
def pair_metrics_difflib(spark, sf_dir):
    """As pair_metrics, with difflib where the reference has it, which SQL can't express."""
    m = _measured(spark, sf_dir, L.reference_metrics)
    return m.select("item_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("base_char_similarity", "char_similarity", "combined", "lexical")])


@_query()
def base_classify_difflib(spark, sf_dir):
    return _measured(spark, sf_dir, L.reference_metrics).select("item_id", "doc_id", L.classify_base(*[F.col(c) for c in ("containment_5", "word_overlap", "base_char_similarity", "jaccard")]).alias("match_type"))


_GRID = "g AS (SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber)) AS id, l_discount * 10 AS sem, l_quantity / 50 AS lex, l_returnflag = 'R' AS cited, l_linestatus = 'F' AS bp, l_tax > 0.05 AS common, CAST(l_linenumber AS INT) AS strong FROM lineitem)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("sem"), (F.col("l_quantity") / 50).alias("lex"), (F.col("l_returnflag") == "R").alias("cited"), (F.col("l_linestatus") == "F").alias("bp"), (F.col("l_tax") > 0.05).alias("common"), F.col("l_linenumber").cast("int").alias("strong"))


_ADJ = """a AS (SELECT *, (sem > .7 AND lex < .3) OR (sem > .85 AND lex < .5) OR sem - lex > .45 AS div FROM g),
  r AS (SELECT *, CASE WHEN sem >= .6 AND lex >= .6 THEN greatest(.3 * sem + .7 * lex, (sem + lex) / 2 * 1.1) ELSE .3 * sem + .7 * lex END AS raw FROM a),
  f AS (SELECT *, least(1.0, raw * CASE WHEN div THEN CASE WHEN lex >= .5 THEN .85 WHEN lex >= .35 THEN .7 ELSE .5 END ELSE 1 END * CASE WHEN cited THEN .85 ELSE 1 END * CASE WHEN bp THEN .5 ELSE 1 END * CASE WHEN common THEN .85 ELSE 1 END) AS score,
   least(1.0::DOUBLE, CASE WHEN div THEN CASE WHEN lex >= .5 THEN .75 WHEN lex >= .35 THEN .6 ELSE .4 END ELSE 1 END * CASE WHEN cited THEN .85 ELSE 1 END * CASE WHEN bp THEN .5 ELSE 1 END * CASE WHEN common THEN .8 ELSE 1 END)::DOUBLE AS conf FROM r)"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir).withColumn("div", L.divergent(F.col("sem"), F.col("lex")))
    score, conf = L.adjusted(*[F.col(c) for c in ("sem", "lex", "div", "cited", "bp", "common")])
    return g.withColumn("score", score).withColumn("conf", conf)


_GRID2 = _GRID.replace("(row_number() OVER (ORDER BY l_orderkey, l_linenumber)) AS id", "l_orderkey, l_linenumber")


@_query(f"WITH {_GRID2}, {_ADJ} SELECT l_orderkey, l_linenumber, div AS divergent, round(score + 1e-9, 5) AS score, round(conf + 1e-9, 5) AS confidence FROM f")
def adjusted_scores(spark, sf_dir):
    return _adjusted(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("div").alias("divergent"), F.round(F.col("score") + 1e-9, 5).alias("score"), F.round(F.col("conf") + 1e-9, 5).alias("confidence"))


@_query(f"""WITH {_GRID2}, {_ADJ}, e AS (SELECT *, greatest(score, lex) AS top FROM f) SELECT match_type, count(*) AS n FROM (SELECT CASE
  WHEN div AND lex < .3 THEN CASE WHEN sem > .75 THEN 'COMMON_TOPIC' ELSE 'NO_MATCH' END WHEN cited AND lex < .35 AND sem < .5 THEN 'PROPER_CITATION' WHEN lex >= .95 THEN 'EXACT_COPY' WHEN lex >= .85 OR top >= .95 THEN 'DIRECT_COPY'
  WHEN lex >= .7 OR top >= .8 THEN CASE WHEN lex > .75 THEN 'DIRECT_COPY' WHEN strong > 3 THEN 'MOSAIC' ELSE 'PARAPHRASE' END
  WHEN lex >= .5 OR top >= .5 THEN CASE WHEN strong > 2 THEN 'MOSAIC' WHEN conf < .4 THEN 'COMMON_KNOWLEDGE' ELSE 'PARAPHRASE' END WHEN lex > .3 OR top > .35 THEN 'COMMON_KNOWLEDGE' ELSE 'NO_MATCH' END AS match_type FROM e) GROUP BY match_type""")
def enhanced_classify(spark, sf_dir):
    kind = L.classify_enhanced(*[F.col(c) for c in ("score", "conf", "lex", "sem", "cited", "div", "strong")])
    return _adjusted(spark, sf_dir).select(kind.alias("match_type")).groupBy("match_type").agg(F.count("*").alias("n"))


@_query("""WITH m AS (SELECT l_orderkey, l_quantity / 50 AS o, CASE WHEN l_quantity > 45 THEN 'DIRECT_COPY' ELSE 'PARAPHRASE' END AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 50 DESC, CASE WHEN l_quantity > 45 THEN 'DIRECT_COPY' ELSE 'PARAPHRASE' END) AS r FROM lineitem),
  a AS (SELECT l_orderkey, count(*) AS n_matches, least(1.0, sum(o * CASE WHEN o >= .7 THEN 1.0 WHEN o >= .5 THEN .9 WHEN o >= .35 THEN .7 ELSE .4 END) FILTER (r <= 10) / least(5, least(10, count(*)))) AS s, bool_or(k = 'DIRECT_COPY') AS c FROM m GROUP BY l_orderkey)
  SELECT l_orderkey, n_matches, round(s, 5) AS text_score, CASE WHEN c OR s > .8 THEN 'CRITICAL' WHEN s > .5 THEN 'HIGH' WHEN s > .3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM a""")
def document_risk(spark, sf_dir):
    m = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 50).alias("overlap"), F.when(F.col("l_quantity") > 45, "DIRECT_COPY").otherwise("PARAPHRASE").alias("match_type"))
    return L.document_risk(m, "l_orderkey").withColumn("text_score", F.round("text_score", 5))


@_query(f"""WITH {_SHINGLES}, bp AS (SELECT item_id, unnest(range(0, greatest(len(w) - 4, 0))) AS pos, unnest({_grams('w', 5)}) AS s FROM b),
  h AS (SELECT DISTINCT p.item_id, p.doc_id, bp.pos FROM pairs p JOIN bp ON bp.item_id = p.item_id JOIN dsh ON dsh.doc_id = p.doc_id AND dsh.s = bp.s),
  i AS (SELECT *, pos - row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS isl FROM h)
  SELECT item_id, doc_id, CAST(min(pos) AS INT) AS span_start, CAST(max(pos) + 5 AS INT) AS span_end FROM i GROUP BY item_id, doc_id, isl HAVING max(pos) + 5 - min(pos) >= 4""")
def match_spans(spark, sf_dir):
    items, docs = (_table(spark, sf_dir, t).select(k, "text") for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    pairs = L.shared_shingles(items, docs, "item_id", "doc_id").select("item_id", "doc_id")
    at = items.select("item_id", T.tokens_b("text").alias("t")).select("item_id", F.posexplode(T.ngram_list(F.col("t"), 5)).alias("pos", "shingle"))
    has = docs.select("doc_id", T.tokens_b("text").alias("t")).select("doc_id", F.explode(T.ngrams(F.col("t"), 5)).alias("shingle"))
    hits = at.join(has, "shingle").join(pairs, ["item_id", "doc_id"], "left_semi").select("item_id", "doc_id", "pos")
    return L.match_spans(hits, ["item_id", "doc_id"]).select("item_id", "doc_id", F.col("span_start").cast("int"), F.col("span_end").cast("int"))


@_query()
def two_stage_detect(spark, sf_dir):
    """Shingle candidates, each verified by its best source window."""
    items, docs = (_table(spark, sf_dir, t).select(k, "text") for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    pairs = L.shared_shingles(items, docs, "item_id", "doc_id").join(items.withColumnRenamed("text", "q"), "item_id").join(docs.withColumnRenamed("text", "s"), "doc_id")
    seg = pairs.select("item_id", "doc_id", segments.verified(F.col("q"), F.col("s")).alias("g")).select("item_id", "doc_id", "g.*")
    kept = seg.where(L.keep_rule(F.col("lexical"), F.col("overlap"), F.col("phrases")))
    return kept.withColumn("effective", F.least(F.lit(1.0), 0.5 * F.col("lexical") + 0.3 * F.col("overlap") + 0.2 * F.col("lexical")))


@_query()
def section_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", segments.section_sizes("text").alias("f")).select("doc_id", "f.n_chars", "f.removed", "f.removed_percentage")


_CAPTIONED = "'see Table ' || p_partkey || ': ' || p_name || chr(10) || 'and TABLE 7.  ' || p_type"


@_query(rf"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all({_CAPTIONED}, '(?:Table|TABLE)\s*\d+[.:]?\s*[^\n]+')) AS m FROM part)
  SELECT p_partkey, CAST(regexp_extract(m, '(\d+)', 1) AS INT) AS number, trim(regexp_replace(m, '^(?:Table|TABLE)\s*\d+[.:]?\s*', '')) AS caption FROM t""")
def table_captions(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_CAPTIONED).alias("t"))
    return t.select("p_partkey", F.inline(P.table_captions("t")))


_FORMULAE = "p_name || ' $$ A_' || p_size || ' + b $$ and $x = ' || p_partkey || '$ ' || p_brand"


@_query(r"SELECT p_partkey, 'A_' || p_size || ' + b' AS display, 'a_' || p_size || '+b' AS display_normalised, 'x = ' || p_partkey AS inline FROM part")
def formula_parts(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_FORMULAE).alias("t"))
    d, i = P.formulas("t"), P.formulas("t", display=False)
    return t.select("p_partkey", d[0]["raw"].alias("display"), d[0]["normalised"].alias("display_normalised"), i[0]["raw"].alias("inline"))


@_query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(30) || '|' || chr(31), '', 'g') AS t FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)(^|\n)\s*(abstract|introduction|background|methods?|materials?\s+and\s+methods?|results?|discussion|conclusions?|references?|\d+\.?\s+\w+)[^\S\n]*(\n|$)'))
  SELECT doc_id, 'Results' AS section, md5(t) AS text_md5 FROM t UNION ALL SELECT doc_id, 'Discussion', md5('') FROM t""")
def section_parse(spark, sf_dir):
    """Texts without headings of their own, under one heading and before another."""
    own = rf"(?i)(^|\n)\s*({'|'.join(P.HEADINGS)})[^\S\n]*(\n|$)"
    d = _table(spark, sf_dir, "documents").select("doc_id", "text").where(~F.col("text").rlike(own))
    parsed = d.select("doc_id", F.inline(P.sections(F.concat(F.lit("Results\n"), "text", F.lit("\nDiscussion\n")))))
    return parsed.select("doc_id", "section", F.md5("text").alias("text_md5"))


@_query()
def section_parse_whole(spark, sf_dir):
    """Sections of every text as it is; section_parse keeps the part that its twin can express."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.sections("text")).alias("pos", "s"))
    return d.select("doc_id", "pos", "s.section", F.md5("s.text").alias("text_md5"))


# --- vectors, stylometry, images -----------------------------------------------------------------------------

_COS = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])) AS s, label FROM q, embeddings)"


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 100."""
    return _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p WHERE s >= .1) SELECT query_id, vec_id, round(s, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return vectors.search(_table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 10, 0.1).withColumn("score", F.round("score", 5))


@_query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p WHERE s >= 0 AND label IN (1, 2, 3)) SELECT query_id, vec_id, round(s, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def vector_filtered(spark, sf_dir):
    corpus = _table(spark, sf_dir, "embeddings").where(vectors.payload_filter(label=[1, 2, 3]))
    return vectors.search(corpus, _vector_queries(spark, sf_dir), 5, 0.0).withColumn("score", F.round("score", 5))


@_query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vector_counts(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@_query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10) AS s FROM documents),
  l AS (SELECT doc_id, w, s, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: length(y) > 0))) AS n FROM t)
  SELECT doc_id, round(CASE WHEN len(s) < 3 THEN .5 ELSE least(1.0, list_stddev_pop(n) / list_avg(n) / .6) END, 5) AS sentence_variation, round(CASE WHEN len(w) < 50 THEN .5 ELSE least(1.0, len(list_distinct(w)) / sqrt(len(w)) / 10) END, 5) AS vocabulary FROM l""")
def ai_indicators(spark, sf_dir):
    d = aitext.with_indicators(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.round("sentence_variation", 5).alias("sentence_variation"), F.round("vocabulary", 5).alias("vocabulary"))


@_query()
def ai_verdict(spark, sf_dir):
    d = aitext.with_verdict(aitext.with_indicators(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return aitext.rollup(d, "source", "verdict")


@_query("WITH h AS (SELECT n_nationkey AS k, md5(n_name) AS a, md5(n_name || 'x') AS b FROM nation) SELECT k, CAST(list_sum(list_transform(range(1, 33), lambda i: bit_count(xor(CAST(instr('0123456789abcdef', substr(a, i, 1)) - 1 AS INT), CAST(instr('0123456789abcdef', substr(b, i, 1)) - 1 AS INT))))) AS INT) AS d FROM h")
def hash_hamming(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.md5("n_name").alias("a"), F.md5(F.concat("n_name", F.lit("x"))).alias("b"))
    return n.select("k", images.hamming(F.col("a"), F.col("b")).cast("int").alias("d"))


@_query("WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, round((len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + len(list_intersect(a, b)) / least(len(a), len(b))) / 2, 6) AS ocr FROM t")
def ocr_overlap(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(images.ocr_similarity(F.split("p_name", " "), F.split("p_type", " ")), 6).alias("ocr"))


@_query("""WITH t AS (SELECT p_partkey, p_size / 50 AS h, p_retailprice / 2000 AS c, CASE WHEN p_size > 25 THEN p_size / 60 END AS o, p_size > 40 AS tb FROM part),
  s AS (SELECT *, CASE WHEN tb THEN (.1 * h + .15 * c + .55 * coalesce(o, 0)) / (.25 + CASE WHEN o IS NULL THEN 0 ELSE .55 END) ELSE (.25 * h + .4 * c + .15 * coalesce(o, 0)) / (.65 + CASE WHEN o IS NULL THEN 0 ELSE .15 END) END AS v FROM t)
  SELECT p_partkey, round(v + 1e-9, 5) AS score, CASE WHEN v >= .99 THEN 'EXACT_DUPLICATE' WHEN v >= .95 THEN 'NEAR_DUPLICATE' WHEN v >= .85 THEN 'HIGH_SIMILARITY' WHEN v >= .75 THEN 'MODERATE_SIMILARITY' ELSE 'LOW_SIMILARITY' END AS match_type FROM s""")
def image_combined(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("h"), (F.col("p_retailprice") / 2000).alias("c"), F.when(F.col("p_size") > 25, F.col("p_size") / 60).alias("o"), (F.col("p_size") > 40).alias("tb"))
    s = p.withColumn("v", images.combined(F.col("h"), F.col("c"), F.col("o"), F.lit(None).cast("double"), F.col("tb")))
    return s.select("p_partkey", F.round(F.col("v") + 1e-9, 5).alias("score"), images.match_type(F.col("v")).alias("match_type"))


def queries() -> dict[str, Query]:
    from palimpsest import registry_detect  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from palimpsest import registry_detect  # noqa: F401

    return dict(_SQL)
