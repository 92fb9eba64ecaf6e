import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from palimpsest.functions import images
from palimpsest.functions import text as T
from palimpsest.operators import lexical, segments, vectors
from palimpsest.plans import catalog
from palimpsest.sources import files
from palimpsest.streaming import incremental


def test_identifiers(spark):
    df = spark.createDataFrame([("bioRxiv", "10.1101/2024.01.15.575123")], "server string, doi string")
    r = df.select(T.paper_id(F.col("server"), F.col("doi")).alias("p"), T.doi_date(F.col("doi"))["month"].alias("m"), T.doi_from_filename(F.lit("10.1101_2024_01_15.pdf")).alias("f"), T.doi_from_filename(F.lit("uuid_12.pdf")).alias("u")).first()
    assert r.p == "biorxiv_2024_01_15_575123" and r.m == "01" and r.f == "10.1101/2024.01.15" and r.u == "uuid_12"


def test_chunkers_count_as_the_three_rules_say(spark):
    sizes = {40: (1, 0, 0), 99: (1, 0, 1), 200: (1, 2, 1), 260: (3, 2, 1), 450: (5, 4, 1), 500: (5, 5, 1), 1000: (10, 10, 3)}
    df = spark.createDataFrame([(n, " ".join(f"word{i}" for i in range(n))) for n in sizes], "n int, text string")
    for r in df.select("n", F.size(T.chunks_query("text")).alias("q"), F.size(T.chunks_index("text")).alias("s"), F.size(T.chunks_bulk("text")).alias("b")).collect():
        assert (r.q, r.s, r.b) == sizes[r.n]


def naive_segment(query, source):
    q, s = segments._WORD.findall(query.lower()), segments._WORD.findall(source.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    best = None
    spans = [(0, len(s))] if len(s) <= len(q) else [(k, k + n) for n in (len(q), min(int(1.2 * len(q)), len(s))) for k in range(0, len(s) - n + 1, max(5, len(q) // 10))]
    for a, b in spans:
        o = len(set(q) & set(s[a:b])) / len(set(q))
        p = len(grams(q) & grams(s[a:b]))
        score = 0.6 * o + 0.4 * (p / len(grams(q)) if grams(q) else 0.0)
        if best is None or score > best[0]:
            best = (score, p, o, a, b, " ".join(s[a:b]))
    return best


def test_best_segment_equals_the_direct_search():
    words = "alpha beta gamma delta eps zeta eta theta".split()
    for seed in range(30):
        q = " ".join(words[(i * seed + i * i) % 8] for i in range(8 + seed % 7))
        s = " ".join(words[(i * 3 + i * i * seed) % 8] for i in range(60)) + " " + q + " tail " * 9
        assert segments.best_segment(q, s) == naive_segment(q, s)
    assert segments.best_segment("", "a b") == (0.0, 0, 0.0, 0, 0, "")


def test_char_ratio():
    assert segments.char_ratio("Some Text", "some text") == 1.0 and segments.char_ratio("a " * 600, "a b") == 0.5
    assert segments.char_ratio("abc d", "abd c") == SequenceMatcher(None, "abc d", "abd c").ratio()


def test_section_filter():
    text = "Title\nA. Author\n\nAbstract\nWe did it. mail me@x.org now.\nMethods\nStuff.\nReferences\nSmith J. 2001\nDiscussion\nEnd."
    kept, removed, share = segments.filter_sections(text)
    assert "Smith" not in kept and "me@x.org" not in kept and kept.endswith("Discussion\nEnd.") and removed == ["header_block", "references"] and 0 < share < 100
    numbered = "Abstract\nx\nReferences\n1. Smith J, 2001\nmore"
    assert "Smith" in segments.filter_sections(numbered)[0] and "Smith" not in segments.filter_sections(numbered, numbered_resume=False)[0]


def test_boost_and_images(spark):
    r = spark.range(1).select(
        lexical.sentence_boost(F.lit(0.5), F.lit(0.4), F.lit(0.9), F.lit(2))[0].alias("s"), images.hamming(F.lit("00ff"), F.lit("ff")).alias("h"), images.hamming(F.lit("f" * 64), F.lit("0" * 64)).alias("w"),
        images.hamming(F.lit(None).cast("string"), F.lit("ff")).alias("n"), images.best_orientation(F.lit("ff"), F.create_map(F.lit("0"), F.lit("00"), F.lit("90"), F.lit("fe")))["orientation"].alias("o"),
    ).first()
    assert abs(r.s - 0.62) < 1e-9 and (r.h, r.w, r.n, r.o) == (0, 256, 64, "90")


def test_vector_search_equals_brute_force(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.search(df, df.where("vec_id in (3, 4)").withColumnRenamed("vec_id", "query_id"), 5, 0.2).collect()
    pairs = df.alias("a").join(df.alias("b"), F.col("a.vec_id").isin(3, 4)).select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("k"), vectors.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("s")).where("s >= 0.2 - 1e-12").collect()
    for q in (3, 4):
        want = sorted(((-round(p.s, 9), p.k) for p in pairs if p.q == q))[:5]
        assert [(-round(r.score, 9), r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_upsert_keeps_what_is_not_updated(spark):
    old = spark.createDataFrame([("a", "t1", "srv", 1), ("b", "t2", "srv", 1)], "doi string, title string, server string, seq int")
    new = spark.createDataFrame([("a", "t9", "other", 2), ("a", "t10", "other", 3), ("c", "t3", "new", 1)], old.schema)
    got = {r.doi: (r.title, r.server) for r in catalog.upsert(old, new, "doi", "seq", ["title", "seq"]).collect()}
    assert got == {"a": ("t10", "srv"), "b": ("t2", "srv"), "c": ("t3", "new")}


def test_sources(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text(json.dumps({"doi": "d1", "full_text": "x"}))
    (tmp_path / "e" / "2.json").write_text(json.dumps({"doi": "d2", "text": "y"}))
    (tmp_path / "e" / "3.json").write_text("{broken")
    assert {(r.doi, r.full_text) for r in files.read_extractions(spark, str(tmp_path / "e")).collect() if r.doi} == {("d1", "x"), ("d2", "y")}
    (tmp_path / "l.json").write_text(json.dumps({"srv": ["d1", "d2"]}))
    assert files.read_doi_list(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "a.xml").write_text("<article><front><article-id pub-id-type='doi'>10.1101/x</article-id><article-title>T</article-title><pub-date><year>2024</year><month>3</month></pub-date></front><body>text</body></article>")
    r = files.read_jats(spark, str(tmp_path / "a.xml")).first()
    assert (r.doi, r.title, r.date, r.server) == ("10.1101/x", "T", "2024-03-01", "biorxiv")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 5, i, f"v{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, seq long, v string")
    for part in range(3):
        df.where(F.col("seq").between(part * 10, part * 10 + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = incremental.upsert_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "t"), str(tmp_path / "c"), "k", "seq")
    q.awaitTermination(60)
    got = sorted(incremental.current(spark, str(tmp_path / "t"), 2).collect())
    assert got == sorted(incremental.latest_by_key(df, "k", "seq").collect())


def test_parts_of_papers(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import papers as P

    paper = "A title\nAbstract\n\nWe ask.\nMETHODS \nResults\nIt holds, see Table 2. Rates by age\n2. Models\nMore $$ E =\n m C $$ and $a b$.\nFunding: this was paid for by a fund of some kind. References\n1. X"
    df = spark.createDataFrame([(1, paper), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r for r in df.select("id", P.sections("t").alias("s"), P.statement("t", "funding").alias("f"), P.statement("t", "conflicts").alias("c"), P.table_captions("t").alias("tc"), P.formulas("t").alias("d"), P.formulas("t", display=False).alias("i")).collect()}
    assert [(s.section, s.text[:8]) for s in got[1].s] == [("Abstract", "We ask."), ("METHODS", ""), ("Results", "It holds"), ("2. Models", "More $$ ")]
    assert got[1].f == "this was paid for by a fund of some kind." and got[1].c is None
    assert [tuple(c) for c in got[1].tc] == [(2, "Rates by age")] and [tuple(d) for d in got[1].d] == [("E =\n m C", "e=mc")] and got[1].i[0].raw == "a b"
    assert got[2].s == [] and got[3].s == [] and got[2].f is None and got[3].f is None
    cells = spark.sql("SELECT array(array('a  b', null), array('1', ' 2 ')) AS r, array(array('x')) AS one")
    assert tuple(cells.select(P.table_text(F.col("r")), P.table_text(F.col("one"))).first()) == ("a b | \n1 | 2", None)


def reference_sections(text):
    """The reference's rule: every heading pattern's matches, by position, each up to the next."""
    import re

    names = ["Abstract", "Introduction", "Background", r"Methods?|Materials?\s+and\s+Methods?", "Results?", "Discussion", "Conclusions?", "References?", r"\d+\.?\s+\w+"]
    at = sorted((m.start(), m.group(1).strip()) for n in names for m in re.finditer(rf"(?:^|\n)\s*({n})\s*\n", text, re.I))
    ends = [a for a, _ in at[1:]] + [len(text)]
    return [(n, re.sub(rf"^{re.escape(n)}\s*", "", text[a:e].strip(), flags=re.I).strip()) for (a, n), e in zip(at, ends)]


def test_whole_texts_are_parsed_by_the_reference_rule(spark, tmp_path):
    from palimpsest import registry

    texts = ["Title\nAbstract\nWe ask.\n\nMethods \n\nWe did\nthis.\n Results\nNo results here.\nReferences\n1. Smith", "no heading at all", "Introduction\nA.\n2 Models\nB.\nMaterials and Methods\nC.\nconclusion\nD."]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    import hashlib

    got = sorted(tuple(r) for r in registry.queries()["section_parse_whole"](spark, str(tmp_path)).collect())
    want = sorted((i, k, n, hashlib.md5(t.encode()).hexdigest()) for i, x in enumerate(texts) for k, (n, t) in enumerate(reference_sections(x)))
    assert got == want and len(got) == 8


def test_difflib_metrics_of_swapped_copies(spark, tmp_path):
    from palimpsest import registry

    halves = [" ".join(f"word{i} of{i}" for i in range(k, k + n)) for k, n in ((0, 30), (100, 30), (0, 120), (300, 120))]
    pairs = {1: (f"{halves[0]} {halves[1]}", f"{halves[1]} {halves[0]}"), 2: (f"{halves[2]} {halves[3]}", f"{halves[3]} {halves[2]}")}
    spark.createDataFrame([(k, q) for k, (q, _) in pairs.items()], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, s) for k, (_, s) in pairs.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.item_id, r.doc_id): r for r in registry.queries()["pair_metrics_difflib"](spark, str(tmp_path)).collect()}
    kinds = {(r.item_id, r.doc_id): r.match_type for r in registry.queries()["base_classify_difflib"](spark, str(tmp_path)).collect()}
    for k, (q, s) in pairs.items():
        assert got[k, k].base_char_similarity == round(SequenceMatcher(None, q, s).ratio(), 6) < 0.9
        assert (got[k, k].char_similarity == 1.0) == (max(len(q), len(s)) > 1000) and kinds[k, k] != "EXACT_COPY"


def test_front_matter_without_an_abstract():
    text = "Long Title\nA. Author\nINTRODUCTION\nBody one.\nDisclosures: none here.\nBody two."
    kept, removed, _ = segments.filter_sections(text)
    assert "Author" not in kept and "Body one" not in kept and "Body two." in kept and removed[0] == "header_block"
    assert segments.filter_sections("T\nA. Author\nIntroduction\nBody.")[0] == "Introduction\nBody."
    assert "Author" in segments.filter_sections("T\nA. Author\nintroduction\nBody.")[0]
    assert segments.filter_sections("T\nA. Author\nkeywords: x\nAbstract\nBody.\nIntroduction\nEnd.")[0].startswith("Abstract")


def test_title_stop_words_and_summary(spark):
    texts = ["DOI: 10.1101/2024.01.15.575123 and a long tail of it\nhttps://example.org/a/very/long/address/of/a/page\nThe real title of the paper\nx", "T\nSummary\nWe  did\nit.\n1. First\nmore", "T\nAbstract\nWe did.\n1. First\nmore"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", T.title_guess("t").alias("title"), T.abstract("t").alias("a")).collect()}
    assert got[0].title == "The real title of the paper" and got[0].a is None and got[1].a == "We did it." and got[2].a == "We did."


def test_citations_of_documents(spark, tmp_path):
    from palimpsest import registry

    kinds = dict(registry.queries()["citation_types"](spark, "").collect())
    texts = [f"A long text. {x} And more." for x in kinds] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(registry.queries()["citation_types_documents"](spark, str(tmp_path)).collect())
    assert got == dict(enumerate([*kinds.values(), None])) and len(set(got.values())) == 5


def interpreted(df):
    return "lambdafunction" in df._jdf.queryExecution().executedPlan().toString()


def test_indicators_run_no_interpreted_folds(spark):
    from palimpsest.functions import aitext

    text = "One two three four. Aa bb cc dd ee ff gg! Moreover it ran, it ran, it ran again? Short. The fourth one is here now. And a fifth of them all.\u2028"
    df = spark.createDataFrame([(0, text), (1, ""), (2, None), (3, text * 3), (4, "\n\n".join(["word " * k for k in (11, 12, 40)]))], "i int, text string")
    d = aitext.with_indicators(df)
    assert not interpreted(d)
    got = {r.i: [getattr(r, k) for k in ("n_words", *aitext.INDICATORS)] for r in d.collect()}
    assert got[1] == [0, 0.5, 0.5, 0.0, 0.5, 0.0, 0.5] and got[2] == [None, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    sizes = (4, 7, 8, 6, 6)  # "Short" is too short
    mean = sum(sizes) / 5
    assert got[0][0] == 32 and abs(got[0][1] - (sum((n - mean) ** 2 for n in sizes) / 5) ** 0.5 / mean / 0.6) < 1e-12
    w = "it ran it ran it ran again".split()
    grams = list(zip(w, w[1:], w[2:]))
    assert aitext._repeated(w) == min(1.0, sum(grams.count(g) > 1 for g in set(grams)) / len(grams) * 10) == 1.0 and aitext._repeated(["a"] * 3) == 0.0
    assert abs(got[4][6] - (1 - ((10**2 + 9**2 + 19**2) / 3) ** 0.5 / 21)) < 1e-12 and got[3][3] == 1.0
    assert [aitext._trimmed(x) for x in (" a \n", "a \u2028", "\u2028 ", " ", "a\x1c")] == ["a", "a\u2028", "\u2028", "", "a\x1c"]


def test_ngram_numbers(spark, tmp_path):
    from palimpsest import registry

    texts = ["A b a b a b a b, A_b a B!", "", None, "x y", "\u00dcber \u6f22\u5b57 \u00bd x\u00b2 \u00fcber \u6f22\u5b57 \u00bd x\u00b2 \u2028 z", "--"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["ngram_counts"](spark, str(tmp_path))
    tokens = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", *[F.size(T.ngrams(T.tokens_b("text"), n)).alias(f"n{n}") for n in (3, 4, 5, 7)])
    assert sorted(df.collect()) == sorted(tokens.collect()) and df.schema == tokens.schema and not interpreted(df)


def test_sections_of_a_batch_never_lie_as_python_texts(spark, tmp_path):
    import tracemalloc

    import pyarrow as pa

    from palimpsest import registry
    from palimpsest.functions import pieces

    texts = pa.array([None] + [f"Abstract\nNumber {i}.\nReferences\n" + "A. Name\n" * 2000 for i in range(1000)])
    form = pa.struct([("n_chars", pa.int32()), ("removed", pa.list_(pa.string())), ("removed_percentage", pa.float64())])
    tracemalloc.start()
    got = pieces.structs(segments._section_sizes, form, texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 4 and len(got) == 1001 and got[0] == {"n_chars": 0, "removed": [], "removed_percentage": 0.0}
    assert got[7]["n_chars"] == len("Abstract\nNumber 6.") and got[7]["removed"] == ["references"]
    spark.createDataFrame([(i, texts[i].as_py()) for i in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["section_filter"](spark, str(tmp_path))
    assert "f.text" not in df._jdf.queryExecution().analyzed().toString() and sorted(map(tuple, df.collect()))[1] == (1, 18, ["references"], got[1]["removed_percentage"])
