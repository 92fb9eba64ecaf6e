"""Further queries with their SQL twins: lookups, vector upserts, sentence matches, ranking and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import constants as K
from palimpsest.functions import text as T
from palimpsest.operators import ranking as R
from palimpsest.operators import sentences, vectors
from palimpsest.plans import catalog as C
from palimpsest.registry import _PAPERS, _TOK_A, _query, _sql_any, _table, papers


@_query(f"""WITH {_PAPERS}, r AS (SELECT 'extract' AS step, doi, row_number() OVER (ORDER BY doi) AS k FROM papers WHERE NOT content_extracted AND lower(category) = 'src1'
  UNION ALL SELECT 'other', doi, row_number() OVER (ORDER BY doi) FROM papers WHERE lower(category) = 'src1') SELECT step, doi FROM r WHERE k <= 40""")
def unprocessed(spark, sf_dir):
    p = papers(spark, sf_dir)
    return C.unprocessed(p, "extract", "SRC1", 40).select(F.lit("extract").alias("step"), "doi").union(C.unprocessed(p, "none such", "SRC1", 40).select(F.lit("other"), "doi"))


@_query("""WITH w AS (SELECT CASE doc_id % 4 WHEN 0 THEN '10.1101/' || doc_id WHEN 1 THEN lang || '.' || doc_id WHEN 2 THEN lang || '/' || doc_id ELSE upper(lang) || doc_id END AS id FROM documents),
  v AS (SELECT DISTINCT id, unnest([0, 1, 2, 3, 4]) AS spelling, unnest([id, string_split(id, '/')[-1], regexp_replace(id, '[./]', '_', 'g'), replace(id, '/', '_'), lower(id)]) AS value FROM w),
  s AS (SELECT lang || '_' || doc_id AS a, CAST(doc_id AS VARCHAR) AS b FROM documents WHERE doc_id % 3 <> 0), h AS (SELECT a AS value, 0 AS field, count(*) AS n FROM s GROUP BY a UNION ALL SELECT b, 1, count(*) FROM s GROUP BY b),
  m AS (SELECT id, spelling, field, least(n, 100) AS n, row_number() OVER (PARTITION BY id ORDER BY spelling, field) AS k FROM v JOIN h USING (value)) SELECT id, spelling, field, n FROM m WHERE k = 1""")
def id_lookup(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("k"))
    kind = F.col("doc_id") % 4
    wanted = d.select(F.when(kind == 0, F.concat(F.lit("10.1101/"), "k")).when(kind == 1, F.concat("lang", F.lit("."), "k")).when(kind == 2, F.concat("lang", F.lit("/"), "k")).otherwise(F.concat(F.upper("lang"), "k")).alias("id")).where("id is not null").distinct()
    stored = d.where("doc_id % 3 <> 0").select(F.concat("lang", F.lit("_"), "k").alias("a"), F.col("k").alias("b"))
    return C.lookup(wanted, stored, ["a", "b"])


@_query("""SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, coalesce(n.label + 100, o.label) AS label, n.vec_id IS NOT NULL AND o.vec_id IS NULL AS added FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) o
  FULL JOIN (SELECT * FROM embeddings WHERE vec_id % 3 = 0) n ON o.vec_id = n.vec_id""")
def vector_upsert(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    old, new = e.where("vec_id % 2 = 0"), e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    both = vectors.upsert(old, new, "vec_id").select("vec_id", "label")
    return both.join(old.select("vec_id", F.lit(False).alias("added")), "vec_id", "left").withColumn("added", F.coalesce("added", F.lit(True)))


@_query("SELECT w.id AS vec_id, e.vec_id IS NOT NULL AS there, e.label FROM (SELECT CAST(unnest(range(0, 900, 90)) AS BIGINT) AS id) w LEFT JOIN embeddings e ON e.vec_id = w.id AND e.vec_id % 4 <> 2")
def vector_points(spark, sf_dir):
    left = vectors.delete(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 4 == 2)
    return vectors.points(left, spark.range(0, 900, 90).withColumnRenamed("id", "vec_id"), "vec_id", "label")


@_query("""WITH old AS (SELECT user_id, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY user_id HAVING user_id % 2 = 0), new AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id % 3 = 0) WHERE k = 1)
  SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_id, n.event_id) AS event_id, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON o.user_id = n.user_id""")
def upsert_existing(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    old = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))
    return C.upsert(old, e.where("user_id % 3 = 0"), "user_id", "event_id", ["value"])


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 20)"


@_query(rf"""WITH p AS (SELECT a.conv_id, a.turn, {_SENTENCES.format(t="a.text")} AS q, {_SENTENCES.format(t="b.text")} AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  q AS (SELECT conv_id, turn, i, q[i] AS qs, {_TOK_A.format(t="q[i]")} AS qt FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM p)), s AS (SELECT conv_id, turn, j, s[j] AS ss, {_TOK_A.format(t="s[j]")} AS st FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM p)),
  o AS (SELECT conv_id, turn, i, qs, j, ss, coalesce(list_sum(list_transform(list_distinct(list_intersect(qt, st)), lambda t: least(len(list_filter(qt, lambda x: x = t)), len(list_filter(st, lambda x: x = t))))), 0) / len(qt) AS overlap FROM q JOIN s USING (conv_id, turn) WHERE len(qt) >= 5 AND len(st) >= 5),
  b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, i ORDER BY overlap DESC, j) AS k FROM o)
  SELECT conv_id, turn, md5(qs) AS query_md5, md5(ss) AS source_md5, round(overlap, 6) AS overlap, {_sql_any("qs", ["(?i)" + "|".join(f"(?:{p})" for p in K.CITATIONS)])} AS is_cited FROM b WHERE k = 1 AND overlap >= 0.3""")
def sentence_matches(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    pairs = c.select("conv_id", "turn", F.col("text").alias("q")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s")), ["conv_id", "turn"])
    found = sentences.sentence_matches(pairs, "q", "s", least=0.3)
    return found.select("conv_id", "turn", F.md5("query_sentence").alias("query_md5"), F.md5("source_sentence").alias("source_md5"), F.round("overlap", 6).alias("overlap"), "is_cited")


_GRID = "g AS (SELECT CAST(l_orderkey AS BIGINT) AS chunk, CAST(l_linenumber AS BIGINT) AS source, round(CAST(l_discount AS DOUBLE) * 10, 4) AS word_overlap, round(CAST(l_tax AS DOUBLE) * 10, 4) AS containment, round(CAST(l_quantity AS DOUBLE) / 50, 4) AS similarity FROM lineitem)"


def _grid(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").cast("long").alias("chunk"), F.col("l_linenumber").cast("long").alias("source"), F.round(F.col("l_discount").cast("double") * 10, 4).alias("word_overlap"), F.round(F.col("l_tax").cast("double") * 10, 4).alias("containment"), F.round(F.col("l_quantity").cast("double") / 50, 4).alias("similarity"))


@_query(f"WITH {_GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY word_overlap DESC, containment DESC, similarity DESC, source) AS k FROM g WHERE word_overlap >= 0.3) SELECT chunk, source, word_overlap FROM r WHERE k = 1 ORDER BY word_overlap DESC, containment DESC, similarity DESC, source, chunk LIMIT 100")
def best_per_chunk(spark, sf_dir):
    return R.best_per_chunk(_grid(spark, sf_dir), "chunk", "source").select("chunk", "source", "word_overlap")


@_query(f"WITH {_GRID} SELECT chunk, source, CAST(row_number() OVER (PARTITION BY chunk ORDER BY containment DESC, CAST(round(similarity * 50) AS INT) DESC, word_overlap DESC, source) AS INT) AS rank FROM g")
def reranked(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("lexical", F.col("containment")).withColumn("phrases", F.round(F.col("similarity") * 50).cast("int"))
    return R.rerank(g, "chunk", -F.col("source")).select("chunk", "source", "rank")


@_query(f"""WITH {_GRID}, r AS (SELECT false AS enhanced, chunk, source, row_number() OVER (PARTITION BY chunk ORDER BY similarity DESC, source) AS rank FROM g WHERE similarity >= 0.2
  UNION ALL SELECT true, chunk, source, row_number() OVER (PARTITION BY chunk ORDER BY similarity DESC, source) FROM g WHERE similarity >= 0.2 AND word_overlap >= 0.3 AND source <> 2) SELECT enhanced, chunk, source, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def batch_compare(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("score", F.col("similarity")).withColumn("confidence", F.col("word_overlap")).withColumn("match_type", F.when(F.col("source") == 2, "COMMON_TOPIC").otherwise("PARAPHRASE"))
    base, strict = (R.batch_compare(g, "chunk", "source", e, k=3).select(F.lit(e).alias("enhanced"), "chunk", "source", "rank") for e in (False, True))
    return base.union(strict)


@_query("""SELECT o_orderkey, CASE WHEN i THEN greatest(t, m, 0.5) ELSE greatest(t, m) END AS full_score, t AS text_score, CASE WHEN i THEN greatest(m, 0.5) ELSE m END AS image_score,
  CASE o_custkey % 7 WHEN 0 THEN 'EXACT_COPY' WHEN 1 THEN 'DIRECT_COPY' WHEN 2 THEN 'MOSAIC' WHEN 3 THEN 'COMMON_KNOWLEDGE' WHEN 4 THEN 'NO_MATCH' ELSE 'PARAPHRASE' END AS kind FROM (SELECT *, round(CAST(o_totalprice AS DOUBLE) / 1000000, 4) AS t, round(o_custkey % 100 / 100.0, 4)::DOUBLE AS m, o_orderstatus = 'P' AS i FROM orders)""")
def report_scores(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    t, m, i = F.round(F.col("o_totalprice").cast("double") / 1000000, 4), F.round((F.col("o_custkey") % 100) / 100.0, 4).cast("double"), F.col("o_orderstatus") == "P"
    return o.select("o_orderkey", R.overall(t, m, i).alias("full_score"), R.overall(t, m, i, "text").alias("text_score"), R.overall(t, m, i, "images").alias("image_score"), R.match_kind(F.element_at(F.array(*map(F.lit, ["exact_copy", "Direct_Copy", "MOSAIC", "common_knowledge", "NO_MATCH", "paraphrase", "unknown"])), (F.col("o_custkey") % 7 + 1).cast("int"))).alias("kind"))


@_query("SELECT doc_id, substr(md5(text), 1, 8) AS digest FROM documents")
def short_digests(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.short_digest(F.col("text")).alias("digest"))
