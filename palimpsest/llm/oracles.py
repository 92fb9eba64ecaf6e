"""DuckDB twins of the queries whose results SQL can express, written from their contracts.

Language ID, toxicity and HTML extraction are trained or judged, BPE and packing follow a library's vocabulary, and
sketches and SimHash need hashes that SQL lacks; tests hold those against brute force, the library or held-out rows.
"""

ORACLES = {
    # Pairs in double precision; the smallest id reachable over links by a recursive walk.
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v
  WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS c FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.c, 0) AS n_links, m AS component_id, v.vec_id = m AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    # A word goes if the last repeated window start at or before it is at most 34 words back.
    "op9_substring_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents
), starts AS (
  SELECT r, s, array_to_string(w[s : s + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)
), again AS (
  SELECT r, s FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d
), marked AS (
  SELECT w.r, w.j, w.word, coalesce(w.j - max(a.s) OVER (PARTITION BY w.r ORDER BY w.j) <= 34, false) AS gone
  FROM words w LEFT JOIN again a ON a.r = w.r AND a.s = w.j
), kept AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS t
  FROM marked GROUP BY r
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r""",
    # Bytes as pairs of hex digits, by way of blocks as substr counts from the start; a byte goes if a repeated string starts at most 49 bytes back.
    "op10_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT r, doc_id, o, substr(h, 2 * o + 1, 698) AS x FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2, 300)) AS o FROM d)
), bytes AS (
  SELECT r, doc_id, o + i AS p, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN 2 * i + 98 <= len(x) THEN substr(x, 2 * i - 1, 100) END AS k
  FROM (SELECT *, unnest(range(1, least(300, len(x) // 2) + 1)) AS i FROM blocks)
), firsts AS (
  SELECT k, min(doc_id) AS least FROM bytes WHERE k IS NOT NULL GROUP BY k
), again AS (
  SELECT b.r, b.p FROM bytes b JOIN firsts f ON f.k = b.k WHERE f.least < b.doc_id
), marked AS (
  SELECT b.r, b.p, b.byte, coalesce(b.p - max(a.p) OVER (PARTITION BY b.r ORDER BY b.p) <= 49, false) AS gone
  FROM bytes b LEFT JOIN again a ON a.r = b.r AND a.p = b.p
), edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM marked
), kept AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, count(*) FILTER (opens) AS spans,
         string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS t
  FROM edged GROUP BY r
)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(g, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r""",
}
