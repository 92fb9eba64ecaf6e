"""The contract's queries on the small tables: SQL twins, or a direct computation of what the contract says."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
import zlib
from tokenizers import Tokenizer

from palimpsest.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_twin_of_vectors_finds_planted_links(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((50, 32))
    rows = [(i, (base[i % 50] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(200)]
    rows += [(300, None), (301, [0.0] * 32), (302, [float("nan")] * 32), (303, rows[0][1])]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(c.execute(queries.oracle_sql()["op6_embedding_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op6_embedding_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert sum(r[1] for r in want) > 200
    found, linked = sum(r[1] for r in got), sum(r[1] for r in want)
    assert linked * 0.99 <= found <= linked and sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_fingerprints_are_the_contracts(spark, documents):
    got = {r.doc_id: int(r.fingerprint, 16) for r in queries.op7_simhash(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for k, text in documents.items():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [w for w in lower.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert got[k] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_edited_likeness_is_near_the_true_one(spark, documents):
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF).collect()}
    ids = sorted(documents)
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    off = []
    for k, n in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b = documents[k], documents[n]
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(a)
        assert (got[k].fingerprint == got[k].edited_fingerprint) or a != edited
        for other, said in ((edited, got[k].near_edited), (b, got[k].near_next)):
            x, y = sets(a), sets(other)
            off.append(abs(said - (len(x & y) / len(x | y) if x | y else 1.0)))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_ids_and_padding(spark, documents):
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op2_bpe(spark, SF).collect():
        ids = library.encode(documents[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = queries.op4_packing(spark, SF).toPandas()
    whole = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in documents.items()}
    for p in pieces.itertuples():
        ids = whole[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert pieces.groupby("doc_id").length.sum().to_dict() == {k: len(x) for k, x in whole.items()}
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and used.sum() / (len(used) * 2048) > 0.97


def test_folds_and_scores(spark, documents):
    part = lambda k, n: zlib.crc32(str(k).encode()) % n
    langs = queries.op1_language_id(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in langs} == {k: part(k, 4) == 2 for k in documents}
    for r in langs:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in documents[r.doc_id]))
    toxic = queries.op5_toxicity(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in toxic} == {k: part(k, 3) == 1 for k in documents}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in toxic)
