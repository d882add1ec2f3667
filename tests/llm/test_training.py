"""Training-data operators: brute force, properties, and nulls, empties, long texts, ties, repeats, extra columns."""

import json
import random
import re
import unicodedata as ud
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archipel.llm import automata, consensus, homoglyphs, mixing, names, neighbours, packing, personal, responses, scans, splitting, tokens

JUDGMENT = "record_id bigint, query_id string, chunk_id string, query string, expected_relevant_information string, judge_model string, judgment_status string, judge_error string, raw_judge_response string, relevance_score bigint, relevance_label string, n int, label string, k int, response string"
CHUNK = "chunk_id string, document_id string, dataset string, raw_text string, sensitive_entities array<struct<entity_type:string,text:string,start:int,end:int>>, n int, word string, repeated string, label string"
DOC = "doc_id bigint, text string, source string, n bigint, part int, shard bigint, start int, k string"


def frame(spark, schema, *rows):
    width = len(schema.split(", "))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


# problem 1
Q, E = "Why did the village clinic audit forty thousand seedlings?", "The village clinic audited forty thousand seedlings because the deadline could not be moved."
GOOD = '{"relevance_score": 2, "relevance_label": "highly_relevant", "contains_expected_information": true, "missing_information": "Everything.", "supporting_evidence": "", "rationale": "The chunk explains what the clinic did but leaves out the reason."}'
LINES = "Relevance score: 2\nRelevance label: related\nRationale: The chunk and this material explain what the clinic did but leave out the reason."
CASES = [
    (GOOD, None), ('{"relevance_score": 3}', None), ("Score: 3", None), ("3", None),
    (None, "empty"), ("", "empty"), ("...", "empty"), ("<|endoftext|>", "empty"), ("​", "empty"), ('{"relevance_score": null, "rationale": ""}', "empty"),
    *((GOOD[:k], "truncated") for k in range(100, 220, 10)), ("Relevance score: 3\nRelevance label: related\nRationale: The chunk explains what the cli", "truncated"),
    ("I'm sorry, but I can't assign a score here.", "refusal"), ("Unfortunately my guidelines do not permit me to rate this material.", "refusal"),
    (Q, "copy"), (Q.upper(), "copy"), (E, "copy"), ("Query: " + Q, "copy"),
    ("Der Text behandelt ein anderes Thema, deshalb passt er nicht zur Anfrage.", "other_language"), ("評価は2です。理由が述べられていません。", "other_language"),
    (GOOD.replace("The chunk explains", "An official says she is unable to help with the survey; still, the chunk explains"), None),
]


def test_defects(spark):
    good = [(i, "q", "c", Q, E, "j", "completed", None, GOOD.replace("2,", f"{i % 4},", 1)) for i in range(100, 400)]
    good += [(i, "q", "c", Q, E, "j", "completed", None, LINES if i % 3 else LINES[:-1]) for i in range(400, 700)]
    rows = [(i, "q", "c", Q, E, "j", "failed", "x", r) for i, (r, _) in enumerate(CASES)]
    df = frame(spark, JUDGMENT, *good, *rows, rows[4], (None, "q", "c", Q, E, "j", "failed", None, ""))
    found = {}
    for r in responses.defects(df).collect():
        found.setdefault(r["record_id"], []).append(r["defect_type"])
    assert found == {i: [d] for i, (_, d) in enumerate(CASES) if d}, [(CASES[i], found.get(i)) for i in range(len(CASES)) if found.get(i) != ([CASES[i][1]] if CASES[i][1] else None)]


def test_defects_edges(spark):
    assert responses.defects(frame(spark, JUDGMENT)).count() == 0
    df = frame(spark, JUDGMENT, (1,), (2, None, None, None, None, None, None, None, "word " * 50_000))
    assert {(r["record_id"], r["defect_type"]) for r in responses.defects(df).collect()} >= {(1, "empty")}


def test_defects_are_learnt_from_all_records(spark):
    german = ("Warum hat die Klinik im Dorf die Setzlinge nicht gezählt und wer war dabei?", "Die Klinik im Dorf hat die Setzlinge gezählt, weil der Termin nicht verschoben werden konnte.")
    n = 2600
    given = [(Q, E) if i % 3 else german for i in range(n)]
    df = frame(spark, JUDGMENT, *[(i, "q", "c", *given[i], "j", "completed", None, GOOD.replace("2,", f"{i % 4},", 1)) for i in range(n)])
    _, cases = responses.patterns(df)
    assert {r["defect_type"]: r["n"] for r in cases.groupBy("defect_type").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(responses.DEFECTS, n)
    trigrams, _ = responses.learnt(df.select(F.col("raw_judge_response").alias("response"), "query", F.col("expected_relevant_information").alias("expected")))
    languages, runs = responses.Languages(), responses.Runs()
    for i in range(n):
        for words in (responses.parts(GOOD)[3], responses.WORD.findall(" ".join(given[i]).lower())):
            if lang := responses.spoken(words, languages):
                runs.add(lang, words)
    counts = {}
    for lang, run, k in runs.rows():
        counts.setdefault(lang, {})[run] = k
    assert set(trigrams.langs) == {"en", "de"} == set(counts)
    want = responses.Trigrams({x: sum(c.values()) for x, c in counts.items()}, counts)
    text = "the village clinic die setzlinge"
    assert trigrams.gains(text) == pytest.approx(want.gains(text))


def test_runs_equal_those_of_the_text():
    words = "the clinic audited the seedlings a b".split()
    runs = responses.Runs()
    runs.add("en", words)
    runs.add("en", words, 2)
    text = " ".join(words)
    want = {}
    for run in responses.Trigrams.runs(text):
        want[run] = want.get(run, 0) + 3
    got = {run: n for _, run, n in runs.rows()}
    assert got == want and not list(runs.rows())


def test_evidence_of_a_word_is_looked_up_once(monkeypatch):
    """However many answers are held against however many queries: before, every answer was looked up run by run, twice."""
    german = "Die Klinik im Dorf hat die Setzlinge gezählt, weil der Termin nicht verschoben werden konnte."
    counts = {lang: Counter(responses.Trigrams.runs(" ".join(responses.WORD.findall((text * 9).lower())))) for lang, text in (("en", E), ("de", german))}
    trigrams = responses.Trigrams({lang: sum(c.values()) for lang, c in counts.items()}, counts)
    looked_up = []
    places = responses.Trigrams.places
    monkeypatch.setattr(responses.Trigrams, "places", lambda self, text: looked_up.append(text) or places(self, text))
    voter = responses.Voter(trigrams)
    words = responses.WORD.findall(GOOD.split('"')[-2].lower())
    for i in range(len(words)):
        told = " ".join(words[i:] + words[:i]) + "."
        answer = json.dumps({"relevance_score": 2, "rationale": told})
        _, _, _, _, heard = voter(answer, Q, E, None)
        cases = {d: x for d, x, *_ in voter.planted(answer, heard, voter.about(Q, E), voter.about(german, german), 12345 * i)}
        gain = trigrams.gains(told[:-1])["de"]
        assert set(cases) == set(responses.DEFECTS) and cases["other_language"][2] == ("y" if gain > 0.3 else "n" if gain < -0.3 else "0")
        assert heard.gains == pytest.approx(trigrams.gains(told[:-1]))
    known = {*words, *responses.WORD.findall(f"{Q} {E} {german}".lower())}
    assert len([x for x in looked_up if " " not in x]) <= len(known)


def test_runs_of_many_texts_equal_those_of_each():
    texts = [t.lower().split() for t in (Q, E, "die klinik hat die setzlinge nicht gezählt und der termin war da", "", "a", "x y z", "評価は2です", Q)]
    languages, one, all_ = responses.Languages(), responses.Runs(), responses.Runs()
    for words in texts:
        if lang := responses.spoken(words, languages):
            one.add(lang, words)
    all_.add_spoken(texts, languages)
    got = {(lang, run): n for lang, run, n in all_.rows()}
    assert got == {(lang, run): n for lang, run, n in one.rows()} and {lang for lang, _ in got} == {"en", "de"}


def test_short_cuts_miss_nothing():
    texts = ["", "a", "it's 3_x y2z", "l'été d’abord", "don't 'quote' this", "ｆｕｌｌ Ünï", "a\x1cb\x85c\u00a0d", "評価は2です。理由"]
    for text in texts:
        assert responses.words_of(text) == responses.WORD.findall(text)
    declined = ["i can't say", "nie mogę tego ocenić", "não posso avaliar", "я не могу оценить", "評価できません", "je ne peux pas évaluer", "das kann ich leider nicht", "no me es posible evaluar", "the chunk says so", "el texto está bien"]
    for text in declined:
        assert responses.unable(text, responses.WORD.findall(text)) == bool(responses.INABLE.search(text))
    polite = ["i'm very sorry", "i apologise", "my apologies", "unfortunately", "regrettably", "i regret", "thanks", "désolé", "je regrette", "malheureusement", "lo siento", "lamentablemente", "tut mir leid", "leider", "entschuldigung", "mi dispiace", "purtroppo", "desculpe", "lamento", "infelizmente", "helaas", "przepraszam", "niestety", "tyvärr", "извините", "к сожалению", "申し訳", "抱歉", "죄송", "anything else", "something else", "further help", "further assistance", "let me know"]
    for text in polite:
        assert responses.SORRY.match(text) or responses.OFFER.search(text)
        assert any(responses.POLITE.search(w) for w in responses.WORD.findall(text)), text
    for text, body in (("```json\n{}\n```", "{}"), ("Sure: ```\nHere is the judgement: x ```", "x"), ("``` a ``` b", "a ``` b"), ("```", ""), ("Okay. 3", "3")):
        assert responses.parsed(text)["body"] == body


def test_label_model_separates():
    counts = {"yyy": 30, "yy0": 5, "nnn": 900, "nn0": 60, "ynn": 5}
    p = responses.label_model(counts)
    assert p["yyy"] > 0.99 and p["yy0"] > 0.9 and p["nnn"] < 0.01 and p["ynn"] < 0.5
    assert 0 < responses.cutoff(p, counts, [])[0] < 1 and responses.label_model({}) == {}


def test_label_model_beats_a_majority():
    """A function that is often wrong, two that are not: the model learns whom to trust, a majority can't."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.05
    rates = ((0.9, 0.01), (0.7, 0.01), (0.6, 0.3), (0.6, 0.3), (0.6, 0.3))  # votes for, on defective and on fine records
    votes = np.stack([rng.random(len(truth)) < np.where(truth, a, b) for a, b in rates], 1)
    patterns = ["".join("y" if v else "n" for v in row) for row in votes]
    counts = {x: patterns.count(x) for x in set(patterns)}
    cases = [x for x, t in zip(patterns, truth) if t][:200]
    p = responses.label_model(counts, cases[::2])
    at = responses.cutoff(p, counts, cases[1::2])[0]

    def f1(flag):
        got = np.array([flag(x) for x in patterns])
        return 2 * (got & truth).sum() / (got.sum() + truth.sum())

    assert f1(lambda x: p[x] >= at) > f1(responses.majority) + 0.15


def test_defects_may_be_several(spark):
    foreign = "Der Text behandelt ein anderes Thema und nennt keinen Grund, deshalb passt er nicht zu der"
    rows = [(i, "q", "c", Q, E, "j", "completed", None, GOOD.replace("2,", f"{i % 4},", 1)) for i in range(100, 400)]
    df = frame(spark, JUDGMENT, *rows, (1, "q", "c", Q, E, "j", "completed", None, '{"relevance_score": 1, "rationale": "' + foreign))
    assert {r["defect_type"] for r in responses.defects(df).where("record_id = 1").collect()} == {"truncated", "other_language"}


# problem 2
def test_consensus_recovers_scores(spark):
    rng = np.random.default_rng(1)
    rows, truth, rid = [], {}, 0
    for i in range(400):
        z = truth[f"c{i}"] = int(rng.integers(4))
        for judge, skill in (("a/Good-1", 0.9), ("a/good_2", 0.85), (" fair ", 0.7), ("RANDOM", 0.25)):
            rid += 1
            label = z if rng.random() < skill else int(rng.integers(4))
            rows.append((rid, "q", f"c{i}", None, None, judge, "completed", None, None, label, None))
        rid += 1  # an inverted judge
        rows.append((rid, "q", f"c{i}", None, None, "liar", "completed", None, None, 3 - z, None))
    df = frame(spark, JUDGMENT, *rows, rows[0], (9999, "q", "c0", None, None, "x", "failed", None, None, 3, None), (9998, "q", None, None, None, "x", "completed", None, None, 3, None))
    got = {r["chunk_id"]: r["relevance_score"] for r in consensus.consensus(df)[0].collect()}
    assert np.mean([got[c] == z for c, z in truth.items()]) > 0.95
    report = {r["judge"]: r for r in consensus.judge_report(df).collect()}
    assert report["good-1"]["accuracy"] > 0.8 and report["liar"]["accuracy"] < 0.2 and report["liar"]["skill_bits"] > 1


def test_consensus_edges(spark):
    assert consensus.consensus(frame(spark, JUDGMENT))[0].count() == 0
    labels = ["irrelevant", " Perfectly-Relevant", "highly relevnt", "unknown", None]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select(consensus.level(F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 3, 2, None, None]
    names_ = ["LUMEN/ARBITER-8B", "lumen__arbiter-8b", "lumen/arbiter_8b", " arbiter-8b ", ""]
    got = spark.createDataFrame([(x,) for x in names_], "x string").select(consensus.judge_name(F.col("x"))).collect()
    assert [r[0] for r in got] == ["arbiter-8b"] * 4 + [None]


def test_alpha_perfect(spark):
    rows = [(i, "q", f"c{i // 2}", None, None, f"j{i % 2}", "completed", None, None, (i // 2) % 4, None) for i in range(16)]
    assert consensus.alpha(frame(spark, JUDGMENT, *rows)).head()["alpha"] == 1.0
    assert consensus.alpha(frame(spark, JUDGMENT)).count() == 1


# problem 3
BACKGROUND = "The village clinic audited the harbor in Kelmouth. They said that the reason was the contract, and the chairman thanked the board for the report. " * 40


def test_personal_spans(spark):
    text = "Contact Goran Szavanth (goran.szavanth at mail dot example) or call +1 248 555 0138 ext. 12. Applicant Dr. Tamiszko, SSN: 947 69 6272, lives at 2235 Foxcrest St., Apt. 31. Invoice 912-44-5834 was settled. The Ursula Quarry Company lost. Szavanth: told us."
    rows = [("a", "d", "x", text), ("b", "d", "x", BACKGROUND), ("n", "d", "x", None), ("e", "d", "x", ""), ("a", "d", "x", text)]
    got = {r["chunk_id"]: r for r in personal.detect(frame(spark, CHUNK, *rows)).collect()}
    found = {(e["entity_type"], e["text"]) for e in got["a"]["entities"]}
    assert {("PERSON_NAME", "Goran Szavanth"), ("EMAIL", "goran.szavanth at mail dot example"), ("PHONE", "+1 248 555 0138 ext. 12"), ("PERSON_NAME", "Tamiszko"), ("ID_NUMBER", "947 69 6272"), ("STREET_ADDRESS", "2235 Foxcrest St., Apt. 31")} <= found
    assert not any("912-44" in t or "Quarry" in t for _, t in found)
    assert all(text[e["start_char"] : e["end_char"]] == e["text"] for e in got["a"]["entities"])
    assert got["a"]["masked_text"].startswith("Contact [PERSON_NAME] ([EMAIL]) or call [PHONE].")
    assert got["n"]["masked_text"] is None and got["e"]["masked_text"] == "" and got["b"]["entities"] == []
    assert personal.detect(frame(spark, CHUNK)).count() == 0


def test_belief_propagation_is_exact_on_chains():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((4, 6))
    p = personal.beliefs(u, np.zeros(4, int), [], 1.5)[0]
    total = np.zeros((4, 6))
    for y in np.ndindex(6, 6, 6, 6):
        w = np.exp(sum(u[i, y[i]] for i in range(4)) + 1.5 * sum(y[i] == y[i + 1] for i in range(3)))
        for i in range(4):
            total[i, y[i]] += w
    assert np.allclose(p, total / total.sum(1, keepdims=True))


def test_skip_factors_spread_a_name():
    u = np.full((2, 6), 0.0)
    u[0, 1] = 5
    apart = personal.beliefs(u, np.array([0, 1]), [(np.array([-1, -1]), np.zeros(0), 1.2)], 1.5)[0]
    tied = personal.beliefs(u, np.array([0, 1]), [(np.array([0, 0]), np.zeros(1), 1.2)], 1.5)[0]
    told = personal.beliefs(u, np.array([0, 1]), [(np.array([-1, 0]), np.array([4.0]), 1.2)], 1.5)[0]
    assert tied[1, 1] > apart[1, 1] and told[1, 1] > apart[1, 1]
    assert personal.skeleton("szavanth") == personal.skeleton("szaavantth") != personal.skeleton("kelmorin") and personal.skeleton("lee") is None


def test_skip_factors_find_what_the_chain_misses(spark, monkeypatch):
    """A name plain in one chunk is found in another chunk of its document, as spelt and nearly so, not in another document."""
    plain_ = "My name is Goran Szavanthor. Contact Goran Szavanthor, told us Mr. Szavanthor. " + BACKGROUND[:300]
    vague = "They waited until Szavanthor came and Szavantthor left the harbor again, and the board agreed."
    rows = [("a", "d", "x", plain_), ("b", "d", "x", vague), ("c", "other", "x", vague), ("z", "e", "x", BACKGROUND), ("n", None, "x", vague)]

    def names():
        return {c: {e["text"] for e in r} for c, r in ((r["chunk_id"], r["entities"]) for r in personal.detect(frame(spark, CHUNK, *rows)).collect())}

    with_skips = names()
    monkeypatch.setattr(personal, "FACTORS", {"chain": 1.5, "equal": 0.0, "similar": 0.0})
    without = names()
    assert {"Szavanthor", "Szavantthor"} <= with_skips["b"] and not without["b"] and not with_skips["c"] and not with_skips["n"]


# problem 4
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_equals_brute():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    trie = automata.Trie(words)

    for w in rng.sample(words, 40) + ["", "zzz"]:
        for k in (0, 1, 2):
            assert sorted(trie.near(w, k)) == [x for x in words if levenshtein(w, x) <= k]
            assert sorted(trie.near(w, k, True)) == [x for x in words if automata.edit_distance(w, x) <= k]
    assert automata.edit_distance("abcd", "abdc") == 1 and automata.edit_distance("abc", "xyz", 1) == 2


def test_scans(spark):
    page = "OCR Line 1 [1,1,2,2]: KELBURY ANNUAL REPORT\nOCR Line 2 [1,1,2,2]: The committee thanked the well-\nOCR Line 3 [1,1,2,2]: known laboratory for the recom-\nOCR Line 4 [1,1,2,2]: mended plan. The cornmittee and the lab0ratory agreed on the matter\nOCR Line 5 [1,1,2,2]: - 12 -\nOCR Line 6 [1,1,2,2]: of the well-known plan."
    clean = "The committee thanked the well-known laboratory for the recommended plan. They agreed on the matter of the plan and the laboratory. "
    rows = [("p", "d", "DocVQA ", page), ("p", "d", "docvqa", page), ("n", "d", "docvqa", None), ("e", "d", "docvqa", ""), *((f"x{i}", "d", "cnn", clean * 5) for i in range(8))]
    work = scans.worked(frame(spark, CHUNK, *rows))
    got = {(r["start_char"], r["noise_type"]) for r in scans.noise_rows(work).where("chunk_id = 'p'").collect()}
    at = page.index
    assert {(at("recom-") + 5, "hyphen"), (at("cornmittee"), "char"), (at("lab0ratory"), "char"), (at("- 12 -"), "page_number")} <= got
    assert not any(t == "hyphen" and a == at("well-\n") + 4 for a, t in got)
    text = next(r["clean_text"] for r in work.collect() if r["chunk_id"] == "p")
    assert "well-known laboratory for the recommended plan" in text and "committee and the laboratory agreed" in text and "12" not in text
    assert scans.worked(frame(spark, CHUNK)).count() == 0


def test_scans_of_any_size(spark):
    good = "The committee thanked the laboratory. " * 30
    rows = [("p", "d", "docvqa", "Then the commiftee thanked the laboratory and had a bead there."), ("q", "d", "cnn", good + "He had a bead. "), *((f"g{i}", "d", "docvqa", good) for i in range(3))]
    found = []
    for times in (1, 30):  # the misreading itself becomes as frequent as a word
        work = scans.worked(frame(spark, CHUNK, *((f"{c}-{k}", *r) for k in range(times) for c, *r in rows)))
        found.append({(r["start_char"], r["noise_type"], r["reading"]) for r in scans.noise_rows(work).where("chunk_id like 'p-%'").collect()})
    assert found[0] == found[1] and (rows[0][3].index("commiftee"), "char", "committee") in found[1]


# problem 5
def test_names(spark):
    e = spark.createDataFrame([("1", "Robert Stravithusterby", "PERSON"), ("2", "Margaret H. Dorithoppel", "PERSON"), ("3", "Naskaillard Broadcasting Network", "ORG"), ("4", "Technical University of Brinaromar", "ORG"), ("5", None, "ORG"), ("6", "Halvarick Broadcasting Network", "ORG"), ("7", "Technical University of Kreloban", "ORG")], "entity_id string, canonical_name string, entity_type string")
    cases = {"Bob Stravithusterby (guest)": "1", "STRAVITHUSTERBY, R.": "1", "stravithustebry": "1", "BobStravithusterby": "1", "William Stravithusterby": None, "Maggie Dorithopel's": "2", "Dr. Dorithoppel": "2", "Naskaillard Brodcasting": "3", "Network - Naskaillard": "3", "Naskaillard Insurance Group": None, "N.B.N.": "3", "Tech. Univ. of Brinaromar": "4", "Somebody Else": None, "": None}
    m = spark.createDataFrame([(str(i), t, None, 0, "s") for i, t in enumerate(cases)] + [("0", next(iter(cases)), None, 0, "s"), ("n", None, None, 0, "s"), ("f", None, "bob stravithusterby", 1, "s"), (None, "x", None, 1, "s")], "mention_id string, mention_text string, normalized_mention_text string, cost int, shard string")
    got = {r["mention_id"]: r["entity_id"] for r in names.links(m, e).collect()}
    assert got == {str(i): x for i, x in enumerate(cases.values()) if x} | {"f": "1"}
    assert names.links(m.limit(0), e).count() == 0 and names.links(m, e.limit(0)).count() == 0


def test_trie_join_is_complete(spark):
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(6, 9))) for _ in range(60)})
    words = sorted({"".join(c for c in k if rng.random() > 0.1) for k in keys} | set(keys))
    got = {(r["word"], r["key"]) for r in names.trie_join(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    for w in words:
        for k in keys:
            assert ((w, k) in got) == (automata.edit_distance(w, k, 2) <= names.reach(len(k))), (w, k)


def test_short_and_long_names(spark):
    e = spark.createDataFrame([("1", "Bruce Lee", "PERSON"), ("2", "Andrew Ng", "PERSON"), ("3", "IBM", "ORG"), ("4", "Jet Li", "PERSON"), ("5", "Central Northern Provincial Mutual Agricultural Fire Insurance Savings Verlomian Bank", "ORG"), ("6", "Anna Maria Quendolane", "PERSON")], "entity_id string, canonical_name string, entity_type string")
    cases = {"Bruce Lee": "1", "Lee, Bruce": "1", "B. Lee": "1", "Bruce Leek": None, "Andy Ng": "2", "IBM": "3", "JET LI": "4", "Bruce Li": None, "Verlomian Savings Ins. Fire Agricultural Mutual Provincial Northern Central Bank": "5", "Quendolane Maria Anna": "6", "Maria Quendolane, Anna": "6", "Anna Anna Quendolane": None, "word " * 3000: None}
    m = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(cases)], "mention_id string, mention_text string, normalized_mention_text string")
    got = {r["mention_id"]: r["entity_id"] for r in names.links(m, e).collect()}
    assert got == {str(i): x for i, x in enumerate(cases.values()) if x}


def test_cheapest_order_equals_all_orders():
    from itertools import permutations

    rng = random.Random(12)
    for _ in range(300):
        rows, cols = rng.randint(1, 4), rng.randint(1, 5)
        table = [[rng.choice([None, rng.randint(0, 9) / 2]) for _ in range(cols)] for _ in range(rows)]
        sums = [sum(table[i][j] for i, j in enumerate(p)) for p in permutations(range(cols), rows) if all(table[i][j] is not None for i, j in enumerate(p))] if rows <= cols else []
        got = names.cheapest_order(table)
        assert (got is None) == (not sums) and (not sums or sum(table[i][j] for i, j in enumerate(got)) == min(sums) and len(set(got)) == rows)


def test_a_shared_surname_is_not_paired_with_everybody(spark):
    rng = random.Random(3)
    given = sorted({"".join(rng.choice("bcdfglmnprstaeiou") for _ in range(9)) for _ in range(200)})
    e = spark.createDataFrame([(f"e{i:03d}", f"{g.title()} Morvandale", "PERSON") for i, g in enumerate(given)], "entity_id string, canonical_name string, entity_type string")
    forms = spark.createDataFrame([(f"{g} morvandale",) for g in given] + [("morvandale",)], "form string").withColumn("words", F.split("form", " "))
    assert names.candidates(forms, names.entity_keys(e)).count() < 3 * len(given)


# problem 6
def walk(text, limit, overlap):
    """The greedy cut, one piece after the other."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    n = len(words)
    nat = [k for k in range(1, n) if "\n" in text[words[k - 1][1] : words[k][0]] or splitting.SENTENCE_END.search(text[slice(*words[k - 1])])] + [n]
    s, out = 0, []
    while n:
        if s + limit >= n:
            out.append((s, n, False))
            return out
        soft = [k for k in nat if s < k <= s + limit]
        e, hard = (soft[-1], False) if soft else (s + limit, True)
        out.append((s, e, hard))
        if hard:
            s = max(e - overlap, s + 1)
        else:
            after = next((k for k in nat if k > e), n)
            s = min(e, next(k for k in nat if k >= max(e - overlap, s + 1, after - limit)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_splitting_equals_walk(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["w ", "w ", "w ", "word. ", "x\n", "y? "]) for _ in range(rng.randint(0, 300))) for _ in range(30)] + ["", "   ", "w " * 500]
    got = splitting.cut_batch(texts, 20, 6)
    for i, t in enumerate(texts):
        assert [(s, e, h) for j, s, e, _, _, h in got if j == i] == walk(t, 20, 6)


def test_splitting_frame(spark):
    long = "one two three. " * 200
    df = spark.createDataFrame([("document", "a", long, 1, "p"), ("document", "a", long, 1, "p"), ("chunk", "b", None, 1, "p"), ("chunk", "c", "", 1, "p"), ("chunk", "d", "word " * 800, 1, "p"), ("chunk", "e", "short", 1, "p")], "item_type string, item_id string, raw_text string, chunk_index int, piece_text string")
    p = splitting.split_items(df, ["item_type", "item_id"])
    assert p.agg(F.max("n_words"), F.max("overlap_words")).head()[0] <= 350
    assert p.where("overlap_words > 60 or overlap_words < 0").count() == 0
    assert {(r["item_id"], r["cut"]) for r in splitting.oversized(p, ["item_type", "item_id"]).collect()} == {("a", "boundary"), ("d", "hard")}
    assert splitting.split_items(df.limit(0), ["item_type", "item_id"]).count() == 0
    with pytest.raises(ValueError):
        splitting.split_items(df, ["item_id"], limit=10, overlap=10)


# problem 7
def test_neighbours_recall_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((15, 64))
    v = centres[rng.integers(15, size=600)] + 0.7 * rng.standard_normal((600, 64))
    v[100:140] = v[100]  # copies
    v[140] = 2 * v[100]
    rows = [(f"c{i:04d}", [float(x) for x in v[i]], 1.0, i) for i in range(600)] + [("zero", [0.0] * 64, 0.0, 0), ("null", None, 0.0, 0), ("c0000", [float(x) for x in v[0]], 1.0, 0), ("short", [1.0], 0.0, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, dense array<float>, cos double, cls int")
    near = neighbours.nearest(df)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    w = v.astype(np.float32).astype(float)
    u = w / np.linalg.norm(w, axis=1, keepdims=True)
    hits = 0
    for i in range(600):
        s = np.round(u @ u[i], 12)
        want = sorted((j for j in range(600) if j != i), key=lambda j: (-s[j], j))[:10]
        mine = [x for _, x in sorted(got[f"c{i:04d}"])]
        assert len(mine) == 10 and f"c{i:04d}" not in mine
        hits += len({f"c{j:04d}" for j in want} & set(mine))
        if 100 <= i <= 140:
            assert mine == [f"c{j:04d}" for j in want]
    assert hits / 6000 >= 0.95 and set(got) == {f"c{i:04d}" for i in range(600)}
    assert neighbours.neighbour_pairs(near).where("chunk_id_a >= chunk_id_b").count() == 0


def test_neighbours_recall_does_not_fall_with_projections(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "projections", lambda n: 18)  # as for two million vectors
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((40, 64))[rng.integers(40, size=1500)] + 0.7 * rng.standard_normal((1500, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"c{i:04d}", [float(x) for x in v[i]]) for i in range(1500)], "chunk_id string, dense array<float>")
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df).collect()}
    u = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"c{i:04d}", f"c{j:04d}") for i, row in enumerate(np.argsort(-s, 1)[:, :10]) for j in row}
    assert len(got & want) / len(want) >= 0.93


def test_neighbours_edges(spark):
    schema = "chunk_id string, dense array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([("a", [1.0] * 64), ("b", [1.0] * 64), ("c", [float("nan")] * 64)], schema)
    assert {(r["id"], r["neighbour"]) for r in neighbours.nearest(two).collect()} == {("a", "b"), ("b", "a")}


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours.cells, "__defaults__", (8,))
    rng = np.random.default_rng(3)
    v = np.ones((60, 64)) + 1e-3 * rng.standard_normal((60, 64))
    df = spark.createDataFrame([(f"c{i:02d}", [float(x) for x in v[i]]) for i in range(60)], "chunk_id string, dense array<float>")
    assert neighbours.nearest(df).groupBy("id").count().where("count = 10").count() == 60


def test_lists_are_merged_not_rows():
    """What a batch met leaves it as one list for each class, and lists keep the best of all pairs."""
    rng = np.random.default_rng(6)
    a, b, cos = rng.integers(20, size=5000), rng.integers(90, size=5000), np.round(rng.random(5000), 2)
    got = neighbours.lists(a, b, cos, 10).to_pylist()
    assert [r["cls"] for r in got] == sorted(set(a))
    for r in got:
        most = {}
        for y, c in zip(b[a == r["cls"]], cos[a == r["cls"]]):
            most[y] = max(most.get(y, -1), c)
        want = sorted(most.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert list(zip(r["top"], r["score"])) == want and r["bound"] == want[-1][1]
    none = np.zeros(0, np.int64)
    assert neighbours.lists(none, none, np.zeros(0), 10).num_rows == 0
    assert neighbours.lists(np.array([4, 4]), np.array([1, 2]), np.array([0.5, 0.5]), 3).to_pylist() == [{"cls": 4, "bound": None, "top": [1, 2], "score": [0.5, 0.5]}]


def test_vectors_move_in_slices(spark, monkeypatch):
    moved, whole, n = [], neighbours.cell_pairs, 300
    monkeypatch.setattr(neighbours, "cell_pairs", lambda rows, k: moved.append(rows.count()) or whole(rows, k))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((n, 64)))], "chunk_id string, dense array<float>")
    lists = lambda: {tuple(r) for r in neighbours.nearest(df, tables=4).collect()}
    at_once = lists()
    moved.clear()
    monkeypatch.setattr(neighbours, "ROOM", 0, raising=False)  # as for a large table
    assert lists() == at_once and len(at_once) == 10 * n
    assert max(moved) <= 2 * n < sum(moved)


# problem 8
def budgets(spark):
    return spark.createDataFrame([("s", 64), ("m", 200), (None, 5)], "container string, capacity_tokens int")


def test_packing(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randint(1, 150)) for i in range(300)] + [(900, None), (901, ""), (0, "word")]
    p = packing.pack(frame(spark, DOC, *docs), budgets(spark), shard_items=64)
    bins = p.groupBy("container", "capacity", "container_id").agg(F.sum("n_tokens").alias("t")).collect()
    assert all(r["t"] <= r["capacity"] for r in bins)
    sizes = {i: t for i, t in frame(spark, DOC, *docs).select("doc_id", tokens.token_count("text").alias("n")).groupBy("doc_id").agg(F.max("n")).collect()}
    for c, cap in (("s", 64), ("m", 200)):
        rows = p.where(F.col("container") == c).collect()
        assert len(rows) == len({(r["doc_id"], r["part"]) for r in rows})
        total = {}
        for r in rows:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert total == sizes
        parts = {d: sum(r["doc_id"] == d for r in rows) for d in sizes}
        assert all(parts[d] == max(1, -(-n // cap)) for d, n in sizes.items())
    assert all(r["fill_rate"] > 0.95 for r in packing.fills(p).collect())


def test_packing_edges(spark):
    assert packing.pack(frame(spark, DOC), budgets(spark)).count() == 0
    assert packing.pack(frame(spark, DOC, (1, "word")), budgets(spark).limit(0)).count() == 0


def test_packing_ends_where_nothing_fits_together(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("word " * 30).alias("text"))
    n = docs.limit(1).select(tokens.token_count("text").alias("n")).head()["n"]
    kinds = spark.createDataFrame([("s", n * 10 // 6), ("m", n * 10)], "container string, capacity_tokens int")
    p = packing.pack(docs, kinds, epochs=1, offspring=1)
    assert {tuple(r) for r in p.groupBy("container").agg(F.count("*"), F.count_distinct("doc_id"), F.count_distinct("container_id")).collect()} == {("s", 5000, 5000, 5000), ("m", 5000, 5000, 500)}


def test_genetic_steps_beat_best_fit():
    """Triples that fill a container exactly, which best fit decreasing misses."""
    rng = np.random.default_rng(11)
    sizes = []
    for _ in range(40):
        a, b = rng.integers(380, 490), rng.integers(250, 300)
        sizes += [a, b, 1000 - a - b]
    sizes = rng.permutation(np.array(sizes))
    bins = []
    packing.best_fit(np.argsort(-sizes, kind="stable"), sizes.tolist(), 1000, bins, [])
    best = packing.evolve(sizes, 1000, [], np.random.default_rng(1), 400)[0]
    assert np.bincount(best, sizes).max() <= 1000
    print(len(bins), best.max() + 1)
    assert best.max() + 1 < len(bins)


def test_genetic_steps_keep_items():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 60, 200)
    best = packing.evolve(sizes, 100, [], rng, 10)
    for labels in best:
        assert np.bincount(labels, sizes).max() <= 100 and len(labels) == 200


# problem 9
def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, "word " * rng.randint(1, 30), ["news", "NEWS ", "News"][i % 3]) for i in range(300)] + [(1000 + i, "word " * rng.randint(1, 30), "small-talk") for i in range(20)] + [(2000, None, "news"), (2001, "x", None), (2002, "x", "other"), (0, "word", "news")]
    targets = spark.createDataFrame([("news", 0.6, 1), ("Small talk", 0.3, 4), ("missing", 0.1, 9)], "source string, target_share double, max_repeats int")
    drawn, quotas = mixing.mix(frame(spark, DOC, *docs), targets, block=64, shard_tokens=400)
    rows = drawn.collect()
    assert len({(r["shard"], r["position"]) for r in rows}) == len(rows) and len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    got = {r["source"]: r for r in mixing.shares(drawn, quotas).collect()}
    assert got["small talk"]["most_uses"] <= 4 and got["news"]["most_uses"] <= 1 and got["missing"]["drawn_tokens"] == 0
    assert got["news"]["drawn_tokens"] / got["small talk"]["drawn_tokens"] == pytest.approx(2, rel=0.02)
    assert {r["shard"] for r in rows} == set(range(max(r["shard"] for r in rows) + 1))


def test_mixing_edges(spark):
    t = spark.createDataFrame([("news", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn, quotas = mixing.mix(frame(spark, DOC), t)
    assert drawn.count() == 0 and mixing.shares(drawn, quotas).count() == 1
    assert mixing.mix(frame(spark, DOC, (1, "word", "news")), t.limit(0))[0].count() == 0


def test_splitting_tree_is_exact():
    blocks = np.array([17, 5, 0, 40])
    ranges = [mixing.leaf(s, 7, blocks, 3) for s in range(7)]
    for k in range(4):
        spans = sorted((int(lo[k]), int(hi[k])) for lo, hi in ranges if hi[k] > lo[k])
        assert sum(b - a for a, b in spans) == blocks[k] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_splitting_tree_beyond_a_billion_blocks():
    blocks = np.array([3_000_000_000, 1_999_999_999, 7, 0])
    known = {}
    ranges = [mixing.leaf(s, 5, blocks, 3, known) for s in range(5)]
    assert [tuple(map(tuple, r)) for r in ranges] == [tuple(map(tuple, mixing.leaf(s, 5, blocks, 3))) for s in range(5)]
    for k in range(4):
        spans = sorted((int(lo[k]), int(hi[k])) for lo, hi in ranges if hi[k] > lo[k])
        assert sum(b - a for a, b in spans) == blocks[k] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    sizes = [int((hi - lo).sum()) for lo, hi in ranges]
    assert max(sizes) - min(sizes) <= 3
    shares = [(hi - lo)[0] / (hi - lo).sum() for lo, hi in ranges]
    assert all(abs(x - 0.6) < 1e-4 for x in shares)


def test_hypergeometric_draws_have_the_right_distribution():
    from math import comb

    rng = np.random.default_rng(5)
    for good, bad, take in ((5, 7, 4), (3, 40, 20), (30, 2, 9), (1, 1, 1), (0, 4, 2)):
        got = np.bincount([mixing.hypergeometric(good, bad, take, rng) for _ in range(20_000)], minlength=take + 1) / 20_000
        want = [comb(good, k) * comb(bad, take - k) / comb(good + bad, take) if take - k <= bad else 0 for k in range(take + 1)]
        assert np.abs(got - want).max() < 0.015


@pytest.mark.parametrize("seed", range(5))
def test_closest_subset(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(12)]
    target = rng.randint(0, 300)
    best = max(sum(s for i, s in enumerate(sizes) if m >> i & 1) for m in range(4096) if sum(s for i, s in enumerate(sizes) if m >> i & 1) <= target)
    assert sum(sizes[i] for i in mixing.closest_subset(sizes, target)) == best


# problem 10
def test_forms():
    t = homoglyphs.Transducer()
    same = ["The café is open 24.", "Thе саfе́ iѕ οpеn 24.", "Ｔｈｅ ｃａｆｅ́　ｉｓ ｏｐｅｎ ２４.", "T​he ca­fé is open 24.﻿"]
    assert len({t(x) for x in same}) == 1
    for a, b in (("cafe", "café"), ("A", "a"), ("10²", "102"), ("①", "1"), ("½", "1/2"), ("👨‍🌾", "👨🌾"), ("a b", "ab")):
        assert t(a) != t(b)
    assert t("Привет, он рад.") == "Привет, он рад." and t("Пpивeт, oн paд.") == "Привет, он рад."
    for a, b in (("PAYPAL", "РАУРАL"), ("PAYPAL now", "РАYРАL now"), ("OPEN", "ՕPEN"), ("Welcome HOME", "Welcome ᎻOᎷE".replace("Ꮇ", "M")), ("STOP here", "ꓢꓔꓳꓑ here"), ("bank", "bɑnk"), ("bank", "𝐛𝐚𝐧𝐤"), ("café", "cafe\u200b\u0301"), ("ﬁ", "ﬁ\u2060")):
        assert t(a) == t(b), (a, b)
    assert t("Утро, Ереван") == "Утро, Ереван" and t("Ελλάδα και Όλα") == "Ελλάδα και Όλα" and t("Երեվան Օր") == "Երեվան Օր" and t("𝟏") != "1" and t("ℝ") != "R"
    assert t("a\r\nb\u2028c\u00a0d\u3000e") == "a\nb\nc d e"
    assert t("ｶﾞｷﾞ") == "ガギ" and t(None) is None and t("") == ""
    rng = random.Random(9)
    pool = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x370, 0x530), 0x301, 0x308, 0x200B, 0x200D, 0x3000, *range(0xFF01, 0xFFA0), 0x1F468)]
    for _ in range(300):
        x = "".join(rng.choice(pool) for _ in range(30))
        assert t(t(x)) == t(x) and ud.normalize("NFC", t(x)) == t(x)


def test_alike_pairs(spark):
    docs = [(1, "open"), (2, "оpen"), (3, "open"), (4, "opеn"), (5, "Open"), (6, None), (7, ""), (8, " "), (9, " "), (None, "open"), (1, "open")]
    got = {tuple(r) for r in homoglyphs.alike_pairs(frame(spark, DOC, *docs)).collect()}
    assert got >= {(1, 2), (2, 3), (2, 4), (1, 4), (3, 4), (8, 9)} and not any(5 in p or 6 in p for p in got)
    assert homoglyphs.alike_pairs(frame(spark, DOC)).count() == 0
    classes = {r["doc_id"]: (r["class_id"], r["n_alike"]) for r in homoglyphs.classes(frame(spark, DOC, *docs)).collect()}
    assert classes == {1: (1, 2), 2: (1, 3), 3: (1, 2), 4: (1, 3), 5: (5, 0), 7: (7, 0), 8: (8, 1), 9: (8, 1)}
    assert homoglyphs.canonical(frame(spark, DOC, (1, "x" * 200_000 + "​"))).head()["canonical_text"] == "x" * 200_000
