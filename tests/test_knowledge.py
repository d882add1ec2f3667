"""Mappers, matches, relation inputs, samplers and drivers: worked examples, brute force, nulls, empties, repeats."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from archipel.functions import text as T
from archipel.operators import chunking, coreference, drivers, evaluation, extract, graph, masking, qrels, records, relations, retrieval, spans
from archipel.session import ranked
from archipel.sources import tables


def value(spark, x, column, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x"))).head()[0]


# chunking on both sides of every limit
@pytest.mark.parametrize(
    ("line", "test", "want"),
    [
        ("Segment 3 [1.5s-2s]: a man", chunking.CAPTION.match, True), ("[0.0-1.25s] : x", chunking.CAPTION.match, True), ("Segment 3 [1.5s - 2s]: a man", chunking.CAPTION.match, False), ("Segment 3 [1.5s-2s] a man", chunking.CAPTION.match, False), ("Segment3 [1s-2s]: a", chunking.CAPTION.match, False),
        ("OCR Line 1 [1,2,3,4]: x", chunking.LAYOUT.match, True), ("line 4: x", chunking.LAYOUT.match, True), ("Region 2 [a]: x", chunking.LAYOUT.match, True), ("Block 2 []: x", chunking.LAYOUT.match, False), ("OCR Line 1[1]: x", chunking.LAYOUT.match, False), ("paragraph 1: x", chunking.LAYOUT.match, False),
        ("Dr. Anna B. Holm, host of the show: hello", chunking.is_turn, True), ("a b c d e f g h: x", chunking.is_turn, True), ("a b c d e f g h i: x", chunking.is_turn, False), ("Anna:", chunking.is_turn, False), ("--: x", chunking.is_turn, False), ("no colon here", chunking.is_turn, False), ("x" * 200 + ": said", chunking.is_turn, True),
    ],
)
def test_structure_limits(line, test, want):
    assert bool(test(line)) == want


def test_structures_need_half_of_the_lines():
    turns = ["A: one two", "plain words here", "B: three four", "more plain words"]
    assert chunking.structured("\n".join(turns), 5, 0) == ["A: one two", "plain words here", "B: three four", "more plain words"]
    assert chunking.structured("\n".join(turns[:1] + turns[1:2] * 3), 5, 0)[0] == "A: one two plain words"


def test_document_chunks_golden(spark):
    text = "Anna: " + "word " * 200 + "\nBo: " + "word " * 200 + "\nAnna: bye"
    rows = spark.createDataFrame([("t", "s", "mediasum", "transcript", text, "Talk", None, {"a": "1", "raw_text": "x", "b": None}, None), ("p", "s", "docvqa", "OCR document", "word " * 300, None, "", None, None), ("n", "s", "x", "y", None, None, None, None, None)], tables.DOCUMENT)
    got = sorted(chunking.chunk_documents(rows, mask=lambda c: F.replace(c, F.lit("Anna"), F.lit("[NAME]"))).collect(), key=lambda r: (r["document_id"], r["chunk_index"]))
    assert [(r["document_id"], r["chunk_index"], len(r["raw_text"].split())) for r in got] == [("p", 0, 250), ("p", 1, 90), ("t", 0, 201), ("t", 1, 203)]
    assert got[2]["embedding_text"].split("\n")[:4] == ["Dataset: mediasum", "Modality: transcript", "Title: Talk", 'Metadata: {"a":"1"}'] and "Content: [NAME]: word" in got[2]["embedding_text"]
    assert got[0]["embedding_text"].startswith("Dataset: docvqa\nModality: OCR document\nContent: word")


def test_rebased_windows(spark):
    text = "  ab cd\nef gh ij "
    w = spark.createDataFrame([(text,)], "x string").withColumn("o", T.token_offsets(F.col("x"))).select(F.explode(chunking.rebased_windows(F.col("o"), 3, 9)).alias("w")).select("w.*").collect()
    assert [(r["start_token"], r["end_token"], text[r["char_start"] : r["char_end"]]) for r in w] == [(0, 3, "ab cd\nef"), (1, 4, "cd\nef gh"), (2, 5, "ef gh ij")]
    assert [(o["start"], o["end"]) for o in w[1]["offsets"]] == [(0, 2), (3, 5), (6, 8)]


# text
def test_token_spans_and_gaps(spark):
    o = spark.createDataFrame([("ab cd ef",)], "x string").withColumn("o", T.token_offsets(F.col("x")))
    ask = lambda f, s, e: o.select(f(F.col("o"), F.lit(s), F.lit(e))).head()[0]
    for s, e, want in ((0, 2, (0, 0)), (1, 4, (0, 1)), (2, 3, None), (6, 8, (2, 2)), (3, 3, None), (9, 12, None)):
        for f in (T.token_span, T.token_span_sorted):
            assert (tuple(ask(f, s, e)) if ask(f, s, e) else None) == want, (s, e)
    assert [spark.range(1).select(T.token_gap(*map(F.lit, x))).head()[0] for x in ((0, 1, 4, 5), (4, 5, 0, 1), (0, 4, 2, 3))] == [2, 2, 0]


def test_json_of_free_text(spark):
    assert json.loads(value(spark, 'Sure {not json} then {"a": {"b": 1}} and {"c": 2}', T.first_json)) == {"a": {"b": 1}}
    assert value(spark, "nothing {", T.first_json) is None and value(spark, None, T.first_json) is None
    whole = lambda c: F.to_json(T.whole_json(c))
    assert value(spark, 'x {"a":1} y', whole) == '{"a":1}' and value(spark, "[1]", whole) is None


def test_labels_and_coercions(spark):
    assert value(spark, "Law or regulation", T.mention_label) == "LAW" and value(spark, "a-b/c, d", T.mention_label) == "A_B_C_D" and value(spark, None, T.mention_label) == ""
    assert value(spark, "DATETIME", T.semantic_label) == "date/time" and value(spark, "no mask person", T.policy_type) == "person"
    assert value(spark, "Quasi location", T.policy_is_sensitive) and not value(spark, "no_mask person", T.policy_is_sensitive)
    assert value(spark, "3.0", T.as_int) == 3 and value(spark, "x", T.as_int) is None and value(spark, " YES ", T.as_bool) is True
    assert value(spark, '["a","b"]', T.as_list) == ["a", "b"] and value(spark, "a", T.as_list) == ["a"] and value(spark, None, T.as_list) == []
    assert value(spark, "org/Model v1.5!", T.model_slug) == "org__Model__v1.5" and value(spark, "..", T.model_slug) == "judge" and value(spark, "é", T.gold_slug) == "UNSPECIFIED"


# mappers
def test_mappers(spark):
    t = spark.createDataFrame([("7", "T", "S", None, ["A", None], ["hello  there", "bye", ""]), (None, None, None, "whole\r\ntext", None, None), ("8", None, None, None, None, None)], "id string, title string, summary string, document string, speaker array<string>, utt array<string>")
    got = {r["title"]: r for r in records.transcripts(t).collect()}
    assert got["T"]["raw_text"] == "A: hello there\nbye" and got["mediasum 8"]["raw_text"] == "" and any(r["raw_text"] == "whole\ntext" for r in got.values())
    v = spark.createDataFrame([("v", 2, "second", 5.0, 6.5), ("v", 1, "first", 1.0, 2.0), ("v", 3, " ", 7.0, 8.0), ("v", 4, "late", None, None)], "video_id string, sen_id int, caption string, start_time double, end_time double")
    assert records.videos(v).head()["raw_text"] == "Segment 0 [1.00s-2.00s]: first\nSegment 1 [5.00s-6.50s]: second\nSegment 3 [unknown-unknown]: late"
    w = spark.createDataFrame([("p", "b", 90.0, 1, 1, 1, 50, 10, 8, 9), ("p", "a", 35.0, 1, 1, 1, 10, 12, 8, 9), ("p", "bad", 34.9, 1, 1, 1, 5, 1, 8, 9), ("p", "odd", -1.0, 1, 1, 2, 5, 30, 8, 9), ("p", " ", 99.0, 1, 1, 3, 5, 30, 8, 9)], "page_key string, text string, conf double, block int, par int, line_no int, left int, top int, width int, height int")
    assert [r["projected"] for r in records.ocr_lines(w).orderBy("line").collect()] == ["OCR Line 0 [10,10,58,21]: a b", "OCR Line 1 [5,30,13,39]: odd"]
    assert records.videos(v.limit(0)).count() == 0 and records.ocr_lines(w.limit(0)).count() == 0


def test_benchmark_records(spark):
    m = "array<struct<entity_type:string,identifier_type:string,text:string,start:int,end:int>>"
    rows = spark.createDataFrame([("a", "Ann met Bob.", "train", [("PERSON", "DIRECT", "Ann", 0, 3), ("PERSON", "no_mask", "Bob", 9, 12)]), ("a", "Ann met Bob.", "train", None), ("b", " ", "dev", None), ("c", "x", "test", [("PERSON", "QUASI", "zzz", 0, 3)])], f"chunk_id string, raw_text string, split string, mentions {m}")
    got = {r["chunk_id"]: r for r in records.benchmark_records(rows).collect()}
    assert set(got) == {"a", "c"} and got["c"]["mismatches"] == 1 and not got["c"]["usable"]
    t = records.training_records(records.benchmark_records(rows.where("mentions is not null"))).collect()
    assert [(r["chunk_id"], r["tokens"], [tuple(x) for x in r["ner"]]) for r in t] == [("a", ["Ann", "met", "Bob."], [(0, 0, "person"), (2, 2, "person")])]
    with pytest.raises(ValueError):
        qrels.split_by_label(rows.where("split = 'train'"), "split")


# spans
def brute_mismatches(ps, gs):
    ps, gs, free, rows = sorted(set(ps)), sorted(set(gs)), set(range(len(set(gs)))), []
    for labelled in (True, False):
        left = []
        for p in ps:
            best, score = None, (0, 0)
            for k, g in enumerate(gs):
                if k in free and (not labelled or g[2] == p[2]):
                    s = (max(0, min(p[1], g[1]) - max(p[0], g[0])), int(p[:2] == g[:2]))
                    if s > score and s[0] > 0:
                        best, score = k, s
            if best is None:
                left.append(p)
            else:
                free.discard(best)
                if not labelled:
                    rows.append(("LABEL_MISMATCH", gs[best][0], p[0]))
        ps = left
    return sorted(rows + [("UNMATCHED_PREDICTION", -1, p[0]) for p in ps] + [("MISSING_GOLD", gs[k][0], -1) for k in free])


def test_mismatches_equal_brute(spark):
    rng, pred, gold = random.Random(1), [], []
    for c in range(60):
        for out in (pred, gold):
            for _ in range(rng.randint(0, 6)):
                s = rng.randint(0, 20)
                out.append((f"c{c}", s, s + rng.randint(1, 8), rng.choice("XY")))
    schema = "g string, start_char int, end_char int, label string"
    got = {}
    for r in spans.mismatches(spark.createDataFrame(pred + [("c0", None, 2, "X")], schema), spark.createDataFrame(gold, schema), "g").collect():
        got.setdefault(r["g"], []).append((r["kind"], -1 if r["gold_start"] is None else r["gold_start"], -1 if r["predicted_start"] is None else r["predicted_start"]))
    for c in {r[0] for r in pred + gold}:
        assert sorted(got.get(c, [])) == brute_mismatches([r[1:] for r in pred if r[0] == c], [r[1:] for r in gold if r[0] == c])


def test_targets_and_detection(spark):
    p = spark.createDataFrame([("c", "m", 0, 10, 0.9), ("c", "n", 50, 60, 0.2)], "chunk_id string, mention_id string, start_char int, end_char int, score double")
    g = spark.createDataFrame([("c", 0, 5, 1, 0), ("c", 5, 10, 0, 1), ("d", 0, 9, 1, 2)], "chunk_id string, start_char int, end_char int, target int, ord int")
    assert {r["mention_id"]: r["gold_target"] for r in spans.best_target(p, g, "chunk_id", "mention_id").collect()} == {"m": 0, "n": None}
    d = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in spans.detection(p, g, "chunk_id", [0.1, 0.5, 0.95]).collect()}
    assert d == {0.1: (1, 1, 2), 0.5: (1, 0, 2), 0.95: (0, 0, 3)}


# graph
def test_canonicalisation(spark):
    rows = spark.createDataFrame([("1", "Ann", "PERSON", "Q1", "Ann X", 0.9, 0), ("2", "ann", "ORG", "Q1", None, None, 1), ("3", "Bo", "PERSON", " nil ", None, 0.9, 2), ("4", "Cy", "PERSON", "Q2", None, 0.1, 3), ("5", "Di", "PERSON", None, None, None, 4)], "mention_id string, mention_text string, mention_type string, external_id string, title string, link_score double, ord int")
    t = graph.canonicalized(rows, least=0.5)
    assert {r["mention_id"]: r["status"] for r in t["audit"].collect()} == {"1": "LINKED", "2": "LINKED", "3": "NIL", "4": "NIL", "5": "NIL"}
    e = t["entities"].collect()
    assert [(r["canonical_name"], r["entity_type"], r["external_kb_id"]) for r in e] == [("Ann X", "PERSON", "Q1")] and t["edges"].count() == 2
    assert graph.canonicalized(rows, t["entities"], 0.5)["entities"].count() == 0 and graph.canonicalized(rows.limit(0))["audit"].count() == 0


def test_containment_equals_brute(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    got = {tuple(r) for r in graph.containing(df.select(F.col("x").alias("needle")), df.select(F.col("x").alias("haystack"))).collect()}
    assert got == {(a, b) for a in words for b in words if len(a) >= 2 and a in b}


def test_query_expansion(spark):
    e = spark.createDataFrame([("1", "Holm Bank", "ORG"), ("2", "Anna Holm", "PERSON"), ("3", "Kelbury", "LOC")], "entity_id string, canonical_name string, entity_type string")
    links = spark.createDataFrame([("1", "holm bank"), ("1", "H. Bank"), ("1", None)], "entity_id string, mention_text string")
    edges = spark.createDataFrame([("1", "3", "LOCATED_IN"), ("2", "1", "WORKS_FOR")], "start_id string, end_id string, relation_type string")
    q = spark.createDataFrame([("a", "Where is Holm Bank located?"), ("b", "what is nothing"), ("c", None)], "query_id string, query string")
    got = {r["query_id"]: r for r in graph.expanded_queries(q, e, links, edges).collect()}
    assert got["a"]["hint_terms"] == ["Holm Bank", "H. Bank", "Anna Holm", "Kelbury"] and got["a"]["relation_phrases"] == ["Holm Bank works for Anna Holm", "Holm Bank located in Kelbury"]
    assert got["a"]["expanded_queries"][2] == "Where is Holm Bank located? Graph relation hints: Holm Bank works for Anna Holm; Holm Bank located in Kelbury" and got["b"]["expanded_queries"] == ["what is nothing"]
    known = spark.createDataFrame([("b", "3")], "query_id string, entity_id string")
    assert {r["query_id"]: r["hint_terms"] for r in graph.expanded_queries(q, e, links, edges, known).collect()}["b"] == ["Kelbury", "Holm Bank"]


# relations
def test_pair_windows_and_endpoints(spark):
    m = [("c", f"e{i}", f"m{i}", "PERSON" if i % 2 == 0 else "ORGANIZATION", 10 * i, 10 * i + 1) for i in range(12)]
    mentions = spark.createDataFrame(m, "chunk_id string, entity_id string, mention_id string, mention_type string, token_start int, token_end int")
    schema = relations.relation_schema(spark)
    near = relations.pair_candidates(mentions.select("chunk_id", "entity_id", F.col("mention_type").alias("kind"), F.col("token_start").alias("start_char"), (F.col("token_end") + 1).alias("end_char")), schema, 80, 96)
    n = spark.createDataFrame([("c", 115)], "chunk_id string, n_tokens int")
    w = relations.pair_windows(near, mentions, n, relations.allowed_by_pair(spark)).collect()
    assert sum(r["n_pairs"] for r in w) == near.count() and all(len(r["mentions"]) <= 8 and 0 <= r["window_start"] <= r["window_end"] <= 114 for r in w)
    records_ = mentions.select(F.col("chunk_id").alias("input_id"), (F.col("token_start") / 10).cast("int").alias("ner_index"), "mention_id", "entity_id", "mention_type", "token_start", "token_end")
    p = spark.createDataFrame([("c", 0, "works for", 0.9, 0, 1, 10, 12), ("c", 1, "works for", 0.9, 0, 5, 10, 11), ("c", 2, "works  for", 0.95, 0, 2, 10, 11), ("c", 3, "works for", 0.9, 10, 11, 0, 1)], "input_id string, ord int, label string, score double, head_start int, head_end int, tail_start int, tail_end int")
    ends = relations.endpoints(p, records_)
    assert sorted(r["ord"] for r in ends.collect()) == [0, 2, 3]
    assert [(r["head"], r["tail"], r["score"]) for r in relations.validated(ends, schema).collect()] == [("e0", "e1", 0.95)]


def test_chunk_inputs_limits(spark):
    rows = [("one", "m", "e", "PERSON", "x", 0, 1, 0, 0), *(("same", f"m{i}", "e", t, "x", i, i + 1, i, i) for i, t in enumerate(("PERSON", "ORGANIZATION"))), *(("ok", f"m{i}", f"e{i}", t, "x", i, i + 1, i, i) for i, t in enumerate(("PERSON", "ORGANIZATION"))), *(("big", f"m{i}", f"e{i}", "ORGANIZATION", "x", i, i + 1, i, i) for i in range(41)), *(("none", f"m{i}", f"e{i}", "PERSON", "x", i, i + 1, i, i) for i in range(3))]
    df = spark.createDataFrame(rows + rows, "chunk_id string, mention_id string, entity_id string, mention_type string, mention_text string, start_char int, end_char int, token_start int, token_end int")
    got = relations.chunk_inputs(df, relations.relation_schema(spark)).collect()
    assert [(r["chunk_id"], r["n_entities"]) for r in got] == [("ok", 2)]


def test_offsets_of_long_texts_stay_small():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["lorem ipsum dolor " * 400, None, ""] * 300)
    tracemalloc.start()
    n = [len(x) for out in T.token_lists(iter([texts, texts.slice(0, 0)])) for x in out]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == [1200, 0, 0] * 300 and peak < 40e6  # 360,000 words as one list of records take over 100 MB


def test_relation_plans_read_mentions_once(spark, small):
    """No plan on mentions with tokens cuts texts into words again, however often it reads them."""
    from archipel.plans import knowledge as K

    for name in ("relation_chunk_inputs", "relation_pair_windows", "relation_endpoints", "relation_edges", "relation_annotations"):
        plan = K.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == (name == "relation_pair_windows"), name  # the one that bundles pairs


def test_input_records_follow_chunk_inputs(spark):
    rows = [(f"c{i % 7}", f"m{i}", f"e{i % 11}", "PERSON" if i % 3 else "ORGANIZATION", "x", 5 * (i % 13), 5 * (i % 13) + 4, i % 13, i % 13) for i in range(150)]
    df = spark.createDataFrame(rows, "chunk_id string, mention_id string, entity_id string, mention_type string, mention_text string, start_char int, end_char int, token_start int, token_end int")
    schema = relations.relation_schema(spark)
    want = {(r["chunk_id"], i, m["mention_id"]) for r in relations.chunk_inputs(df, schema).collect() for i, m in enumerate(r["ner"])}
    assert want and {(r["input_id"], r["ner_index"], r["mention_id"]) for r in relations.input_records(df, schema).collect()} == want


def test_edges_of_crowded_chunks(spark, tmp_path):
    """A chunk of 60 entities, more than a model's input holds, gives all its edges, and so does the SQL."""
    import duckdb

    from archipel.plans import knowledge as K

    names = [f"Name{i:02d}" for i in range(60)]
    kinds = ["PERSON", "ORG"] * 30
    tables_ = {
        "archive_chunks": ([("c", " ".join(names))], "chunk_id string, raw_text string"),
        "local_entities": ([(f"e{i:02d}", n, k) for i, (n, k) in enumerate(zip(names, kinds))], "entity_id string, canonical_name string, entity_type string"),
        "nil_mentions": ([(f"m{i:02d}", "c", "d", "x", "text", n, k, 7 * i, 7 * i + 6) for i, (n, k) in enumerate(zip(names, kinds))], "mention_id string, chunk_id string, document_id string, dataset string, modality string, mention_text string, mention_type string, start_char bigint, end_char bigint"),
    }
    c = duckdb.connect()
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, K.relation_edges(spark, str(tmp_path)).select("head", "relation", "tail", "score").collect()))
    assert [(h, t) for h, _, t, _ in got] == [(f"e{i:02d}", f"e{i + 1:02d}") for i in range(0, 60, 2)]
    assert got == sorted(c.execute(f"select head, relation, tail, score from ({K.SQL['relation_edges']})").fetchall())


def test_masking_strategies(spark):
    rng = random.Random(4)
    rows = [(f"c{i // 4}", f"m{i}", "A" if i % 4 < 2 else "B", 10 * (i % 4), 10 * (i % 4) + 5, 0.9 if i % 4 < 2 else rng.random() * 0.4, int(i % 4 < 2)) for i in range(80)]
    m = spark.createDataFrame(rows, "chunk_id string, mention_id string, mention_type string, start_char int, end_char int, policy double, gold_target int")
    g = m.where("gold_target = 1").select("chunk_id", "start_char", "end_char")
    r = m.select(F.lit("r").alias("relation"), F.col("mention_id").alias("head_id"), F.col("mention_type").alias("head_type"), F.col("mention_id").alias("tail_id"), F.col("mention_type").alias("tail_type"))
    for name in ("policy", "semantic", "both"):
        model = masking.fitted(m, r, g, name, [0.1, 0.5, 0.8])
        masked = masking.applied(m, r, model).where(F.col("sensitivity") >= model["threshold"])
        assert masked.count() == 40 and masked.where("gold_target = 0").count() == 0


# coreference
def slow_linkage(s, threshold):
    clusters = [[i] for i in range(len(s))]
    while len(clusters) > 1:
        d, i, j = min(((1 - s[np.ix_(a, b)]).mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if d >= 1 - threshold:
            break
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def test_linkage_equals_plain_agglomeration():
    rng = np.random.default_rng(3)
    for _ in range(40):
        x = rng.standard_normal((rng.integers(1, 14), 5)) + 1.5
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        t = float(rng.uniform(0.6, 0.98))
        labels = coreference.average_linkage(x @ x.T, t)
        got = {frozenset(np.flatnonzero(np.array(labels) == k)) for k in set(labels)}
        assert got == slow_linkage(x @ x.T, t)


def test_coreference_context(spark):
    row = spark.createDataFrame([("the long text about Anna here", 20, 24)], "t string, s int, e int")
    made = row.select(coreference.context(F.col("t"), F.col("s"), F.col("e"), F.lit("Anna"), F.lit("d"), F.lit("m"), F.lit("PERSON"), 6)).head()[0]
    assert made == "Dataset: d\nModality: m\nMention type: PERSON\nMention: Anna\nContext: about [MENTION] Anna [/MENTION] here"
    none = row.select(coreference.context(F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("Anna"), F.lit("d"), F.lit("m"), F.lit("PERSON"))).head()[0]
    assert none.endswith("Context:  [MENTION] Anna [/MENTION] ")


# samples
def test_ranked_without_hot_groups(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2800, "hot").when(F.col("id") < 2990, "b").alias("g"))
    got = ranked(rows, ["g"], qrels.dice(1, "id"), "id", size=64).collect()
    for g in ("hot", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["_rank"])
        assert [r["_rank"] for r in own] == list(range(1, len(own) + 1))
    want = [r["id"] for r in rows.where("g = 'hot'").orderBy(qrels.dice(1, "id"), "id").collect()]
    assert [r["id"] for r in sorted((r for r in got if r["g"] == "hot"), key=lambda r: r["_rank"])] == want


def test_document_splits_and_groups(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", f"d{i % 9}" if i % 10 else None, f"f{i % 3}", i) for i in range(90)], "chunk_id string, document_id string, primary_family string, promising_score int")
    s = qrels.sample_chunks(rows, 12, 15)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"dev": 12, "test": 15}
    assert s.groupBy(F.coalesce("document_id", F.lit(""))).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    m = spark.createDataFrame([(f"m{i}", "P", f"s{i % 20}" if i < 60 else f"only{i}", "d") for i in range(100)] + [("m0", "P", "s0", "d")], "mention_id string, kind string, surface string, dataset string")
    g = qrels.sample_groups(m, ["kind", "surface"], 40, strata=["dataset"]).collect()
    assert len(g) == 40 and len({r["mention_id"] for r in g}) == 40 and sum(r["split"] == "dev" for r in g) == 20
    assert sum(r["surface"].startswith("s") for r in g) >= 28 and qrels.sample_groups(m.limit(0), ["kind", "surface"], 10).count() == 0


# stores and drivers
def test_splits_and_archives(spark, tmp_path):
    (tmp_path / "dev.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n')
    with zipfile.ZipFile(tmp_path / "train.zip", "w") as z:
        z.writestr("x.json", '[{"id": "c"}, {"id": "d"}]')
        z.writestr("readme.txt", "no")
    got = tables.read_splits(spark, {"train": str(tmp_path / "train.zip"), "dev": str(tmp_path / "dev"), "test": str(tmp_path / "none")}, "id string")
    assert {tuple(r) for r in got.collect()} == {("c", "train"), ("d", "train"), ("a", "dev"), ("b", "dev")}


def test_logs_and_records(spark, tmp_path):
    schema = "query_id string, chunk_id string, rank int, judge_model string, relevance_score int"
    (tmp_path / "j1").mkdir()
    line = lambda **k: json.dumps({"query_id": "q", "chunk_id": "c", "rank": 1, "judge_model": "j"} | k)
    (tmp_path / "j1" / "dense_judgments.jsonl").write_text("\n".join([line(relevance_score=2), line(relevance_score=3), line(relevance_score=9), line(rank=2)]))
    got = tables.read_judgments(spark, str(tmp_path / "*" / "*_judgments.jsonl"), schema).orderBy("rank").collect()
    assert [(r["strategy"], r["relevance_score"]) for r in got] == [("dense", 3), ("dense", None)]
    (tmp_path / "j1" / "sparse_judgments.jsonl").write_text(line() + "\n" + line(judge_model="k"))
    with pytest.raises(ValueError):
        tables.read_judgments(spark, str(tmp_path / "*" / "*_judgments.jsonl"), schema)
    tables.write_record(spark, {"a": 1, "b": ["ä"]}, str(tmp_path / "r"))
    assert tables.read_record(spark, str(tmp_path / "r")) == {"a": 1, "b": ["ä"]}
    r = spark.createDataFrame([("q", "c", 1, 0.5), ("q", "d", 2, 0.4)], "query_id string, chunk_id string, rank int, score double")
    tables.append_result(r, str(tmp_path / "cache"), "k=2")
    back = tables.cached_result(spark.read.parquet(str(tmp_path / "cache")), 1).head()
    assert [x["chunk_id"] for x in back["results"]] == ["c"]
    assert {x["name"] for x in tables.manifest(spark, str(tmp_path)).where("not present").collect()} == set(tables.GRAPH_INPUTS)


def test_resumed_driver(spark, tmp_path):
    units, calls = spark.range(20).withColumn("block", F.col("id") % 5), []

    def work(part):
        calls.append(part.count())
        return {"out": part.select("block", (F.col("id") * 2).alias("twice"))}

    go = lambda u: drivers.resumed(u, ["block"], work, str(tmp_path), {"out": ["twice"]}, 2)
    assert go(units.where("block < 3")) == 3 and go(units) == 2 and sum(calls) == 20 and go(units) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_judging_and_generation(spark):
    r = spark.createDataFrame([("s", "q", "c", 1, "the answer is here"), ("t", "q", "c", 3, "the answer is here"), ("s", "x", "d", 1, None)], "strategy string, query_id string, chunk_id string, rank int, text string")
    q = spark.createDataFrame([("q", "the answer", "c"), ("q", "the answer", "c")], "query_id string, expected_relevant_information string, source_chunk_id string")
    out = drivers.judged(r, q, {"a": extract.overlap_judge, "bad": lambda f: [7] * len(f)})
    got = {(x["judge_model"], x["strategy"], x["query_id"]): (x["relevance_score"], x["judgment_status"], x["is_source_chunk"]) for x in out.collect()}
    assert got["a", "s", "q"] == got["a", "t", "q"] == (3, "completed", True) and got["a", "s", "x"] == (0, "completed", False) and got["bad", "s", "q"][:2] == (None, "failed")
    assert drivers.judged(r, q, {"a": extract.overlap_judge}, out).count() == 0
    c = spark.createDataFrame([(f"c{i}", "The committee of the harbour met on Monday to discuss the new plan. More." if i < 3 else "Short." if i == 3 else None, i) for i in range(5)], "chunk_id string, text string, candidate_rank int")
    made = drivers.generated_qrels(c, extract.lead_query, 5)
    assert [x["source_chunk_id"] for x in made["accepted"].collect()] == ["c0"]
    assert {x["source_chunk_id"]: x["reasons"][0] for x in made["rejected"].collect()} == {"c1": "duplicate_query", "c2": "duplicate_query", "c3": "model_rejected", "c4": "model_rejected"}
    assert qrels.valid_only(made["accepted"].withColumn("is_valid", F.lit(None).cast("boolean"))).count() == 1


def test_embedding_and_judgment(spark):
    rows = spark.createDataFrame([("a", "x y x"), ("a", "x y x"), ("b", None), (None, "z")], "chunk_id string, embedding_text string")
    got = {r["chunk_id"]: r for r in extract.embedded_new(rows, rows.where("chunk_id = 'b'")).collect()}
    assert set(got) == {"a"} and sum(w * w for w in got["a"]["sparse_values"]) == pytest.approx(1, abs=1e-6)
    j = extract.judgment(spark.createDataFrame([("a b", "a b c")], "e string, t string"), "e", "t").head()["judgment"]
    assert tuple(j) == (3, "perfectly_relevant", True)


def test_metrics_at_largest_rank(spark):
    rows = spark.createDataFrame([("j", "dense", "q", 1, 3, False, "a"), ("j", "dense", "q", 4, 0, True, "b"), ("k", "new", "q", 1, 0, False, "a")], "judge_model string, evaluation_strategy string, query_id string, rank bigint, relevance_score bigint, is_source_chunk boolean, chunk_id string")
    got = {r["judge_model"]: r for r in evaluation.metrics_by_judge(rows).collect()}
    assert (got["j"]["k"], got["j"]["precision"], got["j"]["strategy_order"], got["k"]["k"], got["k"]["strategy_order"]) == (4, 0.25, 2, 1, 6)


def test_results_without_chunks(spark):
    hits = spark.createDataFrame([("q", "a", 1, 0.5), ("q", "z", 2, 0.4)], "query_id string, chunk_id string, rank int, score double")
    chunks = spark.createDataFrame([("a", "d", "s", "m", None, "", "masked", "sum")], "chunk_id string, document_id string, dataset string, modality string, title string, embedding_text string, masked_text string, summary string")
    assert [(r["chunk_id"], r["retrieval_text"]) for r in retrieval.results(hits, chunks, "dense").orderBy("rank").collect()] == [("a", "masked"), ("z", "")]
