"""Operators against brute force, and on nulls, ties, repeated rows and empty tables."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from archipel.functions import text as T
from archipel.operators import chunking, coreference, evaluation, extract, graph, masking, qrels, relations, retrieval, spans
from archipel.sources import tables
from archipel.streaming import incremental


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


def test_normalize_text(spark):
    assert one(spark, "a\r\nb\rc\n\n\n\nd \t e \\' ", T.normalize_text) == "a\nb\nc\n\nd e '"
    assert one(spark, None, T.normalize_text) == ""


def test_ids(spark):
    name = "archive-chunk:abc"
    assert one(spark, name, T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    import hashlib

    got = spark.range(1).select(T.stable_id(F.lit("a"), F.lit(None), F.lit(3))).head()[0]
    assert got == hashlib.sha256(b"a::3").hexdigest()[:24]


def test_surfaces(spark):
    assert one(spark, "  The O'Neil--Foundation ", T.surface) == "the o neil foundation"
    assert one(spark, "the neil foundation", T.block_key) == "neil"
    assert one(spark, "alpha", T.block_key) == "alph"
    assert one(spark, "NASA", T.is_acronym) and not one(spark, "Nasa", T.is_acronym)


def test_token_offsets(spark):
    text = " ab  c\ndé "
    got = one(spark, text, T.token_offsets)
    assert [(r["token"], r["start"], r["end"]) for r in got] == [("ab", 1, 3), ("c", 5, 6), ("dé", 7, 9)]


def test_surface_terms(spark):
    assert one(spark, 'Why did "iron gate" fail in New Holm? NASA new holm', T.surface_terms) == ["iron gate", "New Holm", "NASA"]


@pytest.mark.parametrize("n", [1, 5, 350, 351, 640, 641, 1000])
def test_windows_agree(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(F.explode(chunking.word_windows(F.col("w"))).alias("x")).select("x.words").collect()
    assert [" ".join(r[0]) for r in got] == chunking.windows(" ".join(words), 350, 60)


def test_pack_covers_all():
    rng = random.Random(1)
    for _ in range(200):
        segments = [" ".join(f"s{i}_{k}" for k in range(rng.randint(1, 30))) for i in range(rng.randint(1, 20))]
        out = chunking.pack(segments, 25, 6, "\n")
        assert all(len(x.split()) <= 25 for x in out)
        assert {w for x in out for w in x.split()} == {w for s in segments for w in s.split()}


def test_structures():
    assert len(chunking.structured("\n".join(f"Segment {i} [0.0s-1.0s]: a b c" for i in range(10)), 20, 0)) == 4
    assert chunking.structured("", 10, 2) == []
    assert all(len(x.split()) <= 10 for x in chunking.structured("word " * 55, 10, 2))


def test_documents_empty(spark):
    rows = spark.createDataFrame([], tables.DOCUMENT)
    assert chunking.chunk_documents(rows).count() == 0
    rows = spark.createDataFrame([("d", "s", None, None, None, None, None, None, None), ("e", "s", "x", "y", "a b", "t", None, None, None)] * 2, tables.DOCUMENT)
    assert [r["document_id"] for r in chunking.chunk_documents(rows).collect()] == ["e"]


def covered(sp):
    return len({i for s, e in sp for i in range(s, e)})


def test_merged_and_shared(spark):
    rng = random.Random(2)
    a, b = [], []
    for g in range(40):
        for out in (a, b):
            out += [(f"g{g}", s, s + rng.randint(1, 15)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
    schema = "g string, start_char int, end_char int"
    A, B = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for r in spans.merged_lengths(A, "g").collect():
        assert r["merged_chars"] == covered([(s, e) for g, s, e in a if g == r["g"]])
    for r in spans.intersection_lengths(A, B, "g").collect():
        x, y = ({i for g, s, e in rows if g == r["g"] for i in range(s, e)} for rows in (a, b))
        assert r["shared_chars"] == len(x & y)


def test_greedy_match(spark):
    schema = "g string, start_char int, end_char int, label string"
    p = spark.createDataFrame([("a", 0, 5, "X"), ("a", 3, 9, "X"), ("b", 0, 1, "X")], schema)
    g = spark.createDataFrame([("a", 4, 6, "X"), ("c", 0, 1, "X")], schema)
    got = {r["g"]: (r["tp"], r["fp"], r["fn"]) for r in spans.greedy_match(p, g, "g").collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 0, 1)}


def test_dense_topk_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    v[10] = v[11] = v[12]
    v[13] = 0
    rows = [(f"c{i:02d}", v[i].tolist()) for i in range(60)] + [("null", None)]
    table = spark.createDataFrame(rows, "chunk_id string, dense array<double>")
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    got = retrieval.dense_topk(table.where("chunk_id < 'c20'").withColumnRenamed("chunk_id", "query_id"), table, 5).collect()
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    for q in range(20):
        mine = [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == f"c{q:02d}"), key=lambda r: r["rank"])]
        if q == 13:
            assert mine == []
            continue
        s = np.round(u @ u[q], 6)
        want = sorted((i for i in range(60) if i != 13), key=lambda i: (-s[i], i))[:5]
        assert mine == [f"c{i:02d}" for i in want]


def test_sparse_and_fusion(spark):
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 2, 2.0), ("c", 3, 1.0)], "chunk_id string, term int, weight double")
    q = spark.createDataFrame([("q", 2, 1.0)], "query_id string, term int, weight double")
    got = retrieval.sparse_topk(q, p).collect()
    assert [(r["chunk_id"], r["rank"]) for r in got] == [("a", 1), ("b", 2)]
    lists = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1)], "query_id string, chunk_id string, rank int")
    fused = {r["chunk_id"]: r["score"] for r in retrieval.rrf(lists, 5).collect()}
    assert fused == {"a": 0.5, "b": pytest.approx(1 / 3 + 0.5, abs=1e-6)}


def test_ndcg_golden(spark):
    rows = [("s", "q1", 1, 3, True, "a"), ("s", "q1", 2, 0, False, "b"), ("s", "q1", 3, 2, False, "c"), ("s", "q2", 1, None, None, "d")]
    j = spark.createDataFrame(rows, "evaluation_strategy string, query_id string, rank bigint, relevance_score bigint, is_source_chunk boolean, chunk_id string")
    r = evaluation.retrieval_metrics(j, [3]).head()
    dcg, ideal = 7 + 3 / 2, 7 + 3 / np.log2(3)
    assert r["ndcg"] == pytest.approx(dcg / ideal / 2, abs=1e-6)
    assert (r["hit_rate"], r["mrr"], r["source_hit_rate"], r["precision"]) == (0.5, 0.5, 0.5, pytest.approx(1 / 3, abs=1e-6))


def test_linkage_and_clusters(spark):
    s = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    labels = coreference.average_linkage(s, 0.9)
    assert labels[0] == labels[1] != labels[2]
    schema = "mention_id string, mention_text string, mention_type string, dataset string, document_id string, chunk_id string"
    rows = spark.createDataFrame([("1", "Anna Holmgren", "PERSON", "d", "x", "c"), ("2", "Anna Holmgren", "PERSON", "d", "x", "c"), ("3", "the company", "ORG", "d", "x", "c"), ("4", None, "PERSON", "d", "x", "c")], schema)
    assert coreference.candidates(rows, ["PERSON", "ORG"]).count() == 2
    assert coreference.clusters(coreference.candidates(rows, ["PERSON", "ORG"])).count() == 1
    assert coreference.clusters(coreference.candidates(rows.limit(0), ["PERSON"])).count() == 0


def test_pairwise_equals_brute(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 4)}", f"g{rng.randint(0, 4)}") for _ in range(60)] + [(None, "g1")]
    r = coreference.pairwise(spark.createDataFrame(rows, "pred string, gold string")).head()
    full = rows[:-1]
    tp = sum(full[i][0] == full[j][0] and full[i][1] == full[j][1] for i in range(60) for j in range(i))
    assert r["tp"] == tp


def test_upsert_and_edges(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], "id string, s string, n int")
    new = spark.createDataFrame([("b", None, 2), ("c", "z", 3)], "id string, s string, n int")
    assert sorted(map(tuple, graph.upsert(old, new, "id").collect())) == [("a", "x", 1), ("b", "y", 2), ("c", "z", 3)]
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "q")], "type string, start_id string, end_id string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert graph.connected_edges(edges, nodes, nodes).count() == 1


def test_masking(spark):
    t = spark.createDataFrame([("1", "call Ann at 555"), ("2", None), ("3", "x")], "chunk_id string, raw_text string")
    s = spark.createDataFrame([("1", 5, 8, "NAME"), ("1", 12, 15, "PHONE"), ("1", 6, 8, "OTHER")], "chunk_id string, start_char int, end_char int, label string")
    got = dict(map(tuple, masking.mask_spans(t, s).collect()))
    assert got["2"] is None and got["3"] == "x" and got["1"].endswith("at [PHONE]")
    rows = spark.createDataFrame([(True, 0.9, 0.0), (False, 0.0, 0.9)] * 3, "gold boolean, a double, b double")
    assert masking.coordinate_search(rows, ["a", "b"])["b"] < 0.5


def test_qrel_validation(spark):
    r = qrels.reject_reasons(F.lit("short"), F.lit("too short"), F.lit(None), F.lit("a"), F.lit("b"), F.lit(False))
    got = spark.range(1).select(r).head()[0]
    assert got == ["query_too_short", "expected_information_too_short", "expected_information_not_self_contained", "missing_reference_answer"]


def test_split_shares(spark):
    rows = spark.createDataFrame([(f"d{i}", "a" if i < 10 else "b" if i < 12 else "c") for i in range(13)], "key string, stratum string")
    got = qrels.split_dev_test(rows, "stratum", "key").groupBy("stratum", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("a", "dev"): 3, ("a", "test"): 7, ("b", "dev"): 1, ("b", "test"): 1, ("c", "test"): 1}
    assert qrels.stratified_sample(rows, "stratum", "key", 6).select("stratum").distinct().count() == 3


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y"\nz', {"k": "v"}, True), ("b", None, None, False)], "id string, t string, m map<string,string>, f boolean")
    tables.write_csv(rows, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "id string, t string, m string, f boolean, extra int", {"m": "map<string,string>"}, ["id", "t", "m", "f", "extra"])
    got = {r["id"]: r for r in back.collect()}
    assert got["a"]["t"] == 'x "y"\nz' and got["a"]["m"] == {"k": "v"} and got["a"]["f"] and got["b"]["t"] is None and got["b"]["extra"] is None


def test_jsonl_and_append(spark, tmp_path):
    rows = spark.createDataFrame([("a", float("nan")), ("b", 1.5)], "id string, x double")
    tables.write_jsonl(rows, str(tmp_path / "j"))
    assert {r["id"]: r["x"] for r in tables.read_jsonl(spark, str(tmp_path / "j"), "id string, x double").collect()} == {"a": None, "b": 1.5}
    assert tables.read_jsonl(spark, str(tmp_path / "none"), "id string").count() == 0
    out = str(tmp_path / "t")
    assert tables.append_new(rows, out, ["id"]) == 2 and tables.append_new(rows, out, ["id"]) == 0
    assert tables.read_record(spark, str(tmp_path / "r.json")) == {}


def test_stream_is_idempotent(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(src)
    go = lambda: incremental.run_stream(spark, src, "id bigint, v bigint", sink, ["id"], ck, lambda b: b.where("id % 2 = 0"))
    assert go() == 5
    spark.range(5, 15).withColumn("v", F.col("id") * 2).write.mode("append").parquet(src)
    assert go() == 8


def test_models(spark):
    rows = spark.createDataFrame([("1", "Ann Lee wrote to ann@x.org"), ("2", None)], "id string, text string")
    assert len(extract.embed(rows, "text").head()["dense"]) == 64
    assert {r["label"] for r in extract.extract_spans(rows, "text").collect()} == {"EMAIL", "NAME"}
    assert [r["relevance_score"] for r in extract.judge(rows.withColumn("want", F.lit("ann wrote")), "want", "text").collect()] == [3, 0]


def test_relation_schema():
    rows = relations.schema_rows()
    assert len({r[0] for r in rows}) == 18 and ("WORKS_FOR", "actor_affiliation", "PERSON", "ORGANIZATION") in rows


def test_nearest_pairs_of_crowded_chunks(spark):
    rng = random.Random(8)
    far = [("far", "p", "PERSON", 0, 5), *(("far", f"m{i}", "MISC", 10 + 10 * i, 15 + 10 * i) for i in range(8)), ("far", "o", "ORGANIZATION", 100, 105)]
    nested = [("nested", "p", "PERSON", 0, 900), *(("nested", f"q{i}", "PERSON", 10 + 10 * i, 15 + 10 * i) for i in range(9)), ("nested", "o", "ORGANIZATION", 800, 805)]
    rows = far + nested
    for c in range(25):
        for _ in range(rng.choice((5, 60))):
            s = rng.choice((None, rng.randrange(200), rng.randrange(6000)))
            e = None if rng.random() < 0.05 else (s or 0) + rng.choice((0, 5, 400, 3000))
            rows.append((f"c{c}", f"e{rng.randrange(rng.choice((3, 30)))}", rng.choice(("PERSON", "ORGANIZATION", "LOCATION", "MISC")), s, e))
    rows = list(dict.fromkeys(rows))
    allowed = {(h, t) for _, _, h, t in relations.schema_rows()}
    want, low, high = [], float("-inf"), float("inf")
    for chunk in {r[0] for r in rows}:
        m = [(e, k, low if s is None else s, high if t is None else t) for c, e, k, s, t in rows if c == chunk]
        pairs = sorted((max(0, max(a[2], b[2]) - min(a[3], b[3])), a[2], b[2], a[0], b[0]) for a in m for b in m if a[0] != b[0] and (a[1], b[1]) in allowed)
        want += [(chunk, p[3], p[4], p[0], r) for r, p in enumerate(pairs[:8], 1) if p[0] <= 2000]
    got = relations.pair_candidates(spark.createDataFrame(rows, "chunk_id string, entity_id string, kind string, start_char int, end_char int"), relations.relation_schema(spark))
    got = sorted(map(tuple, got.select("chunk_id", "head", "tail", "gap", "rank").collect()))
    assert got == sorted(want) and ("far", "p", "o", 95, 1) in got and ("nested", "p", "o", 0, 1) in got
