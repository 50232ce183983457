"""Extraction, corpus reading, retrieval pieces and helpers against literals or brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from claimweave.functions import text as X
from claimweave.operators import evaluate as V, evidence as E, extract, flat, retrieve as RV
from claimweave.plans.ordered import numbered, with_previous
from claimweave.plans.substring import contains_join
from claimweave.sources import corpus as S


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("sentence, expected", [
    ("Alice moved to Busan in March 2026.", ("Alice", "lives_in", "Busan", dt.date(2026, 3, 1))),
    ("The office says Alice lives in Seoul.", ("Alice", "lives_in", "Seoul", None)),
    ("During the fair, Bob will stay in Rome!", ("Bob", "stays_in", "Rome", None)),
    ("Élodie resides in Saint-Malo.", None),
    ("Where does Alice live?", None),
])
def test_extract(spark, sentence, expected):
    rows = extract.extract_claims(spark.createDataFrame([(1, sentence)], "id int, text string")).collect()
    got = [(r.subject, r.predicate, r.object_value, r.valid_from) for r in rows]
    assert got == ([expected] if expected else [])


def test_scalars(spark):
    assert one(spark, X.normalize_predicate(F.col("a")), a="Current_Residence!") == "lives_in"
    assert one(spark, X.canonical_text(F.col("a")), a="  \"Hello   World\"? ") == "hello world"
    assert one(spark, X.safe_branch_name(F.col("a")), a="__Trip Plan__2!") == "tripplan-2"
    assert sorted(one(spark, X.tokens(F.col("a")), a="Created parties and running walks in Rome")) == ["create", "party", "rome", "runn", "walk"]
    assert one(spark, X.find_date(F.col("a")), a="2023/03/25 (Sat) 18:26") == dt.date(2023, 3, 25)
    assert one(spark, X.find_date(F.col("a")), a="2023-02-31") is None


def test_corpus_shapes(spark, tmp_path):
    record = {"question_id": "q1_abs", "question": "Who?", "haystack_dates": ["2026-03-01"],
              "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}, "noise", {"content": "x"}], "not a list", []]}
    for name, payload in (("list", [record]), ("data", {"data": [record]}), ("examples", {"examples": [record]})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(payload, indent=1))
        records = S.read_corpus(spark, str(path))
        assert records.count() == 1
        turns = [(r.session_index, r.session_date, r.turn_index, r.role, r.content) for r in S.session_turns(records).orderBy("turn_index").collect()]
        assert turns == [(0, "2026-03-01", 0, "user", "hi"), (0, "2026-03-01", 1, "unknown", "x")]
        stats = {r["item"]: r["value"] for r in S.corpus_stats(records, S.session_turns(records)).collect()}
        assert (stats["abstention_count"], stats["avg_sessions"], stats["avg_turns"]) == (1.0, 3.0, 2.0)
        prompt = S.prompt_rows(records, S.session_turns(records), history_format="json").first().prompt
        assert "has_answer" not in prompt and '"turns":[]' in prompt


def test_empty_logs_and_sample(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("")
    assert S.read_hypotheses(spark, str(path)).count() == 0
    ids = spark.range(100).withColumnRenamed("id", "k")
    a, b = [[r.k for r in S.select_sample(ids, "k", 10, seed).collect()] for seed in (1, 1)]
    with pytest.raises(ValueError):
        S.select_records(ids, "k", limit=3, sample_size=2)
    assert [r.k for r in S.select_records(ids, "k", start_index=98, limit=5).orderBy("k").collect()] == [98, 99]
    assert a == b == sorted(a) and len(a) == 10 and S.select_sample(ids, "k", 500).count() == 100


def test_shards_true_false_true(spark):
    records = spark.createDataFrame([("a", "multi-session"), ("b", "multi-session"), ("c", "multi-session")], "question_id string, question_type string")
    logs = spark.createDataFrame([("a", 0, 0, True), ("b", 1, 0, False), ("c", 2, 0, True)], "question_id string, shard int, row_no int, label boolean")
    s = {r["item"]: (r.accuracy, r.n) for r in V.eval_summary(records, V.first_log_rows(records, logs)).collect()}
    assert s["overall"] == (0.6667, 3) and s["task:knowledge-update"] == (0.0, 0) and s["abstention"] == (None, 0)
    assert V.shard_coverage(records, logs).where("kind = 'observed'").first().n == 3
    with pytest.raises(ValueError):
        V.shard_coverage(records, logs.where("question_id <> 'b'"))


def test_substring_join_is_exact(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [w + "x" for w in words[:10]]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame(sorted({w: None for w in words}.items()), "n string, z string").drop("z")
    got = {(r.i, r.n) for r in contains_join(t, "t", n, "n").collect()}
    assert got == {(i, w) for i, x in enumerate(texts) for w in set(words) if w in x}


def test_order_helpers_with_a_dominant_group(spark):
    rows = [("hot", i) for i in range(700)] + [(f"g{i % 50}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long").repartition(7)
    got = {(r.g, r.o): (r.position, r.prev) for r in with_previous(numbered(df, ["g"], ["o"]), ["g"], ["o"], F.col("o"), "prev").collect()}
    last, count = {}, {}
    for g, o in sorted(rows):
        count[g] = count.get(g, 0) + 1
        assert got[(g, o)] == (count[g], last.get(g))
        last[g] = o
    assert {r.position for r in numbered(df.where("g = 'hot'"), [], ["o"]).collect()} == set(range(1, 701))


def test_tfidf_prunes_without_losing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["common", "usual", "plain", f"w{rng.randrange(12)}", f"z{i}"]) for _ in range(6))) for i in range(80)]
    facts = spark.createDataFrame(docs, "fact_id long, document string")
    q = spark.createDataFrame([(i, f"common usual w{i} unseen{i}") for i in range(10)] + [(99, "plain plain"), (100, "nothing known")], "question_id long, query string")
    full = {(r.question_id, r["rank"]): (r.fact_id, r.score) for r in flat.tfidf_topk(facts, q, 5).collect()}
    for df, block in ((3, 4), (20, 100)):
        part = {(r.question_id, r["rank"]): (r.fact_id, r.score) for r in flat.tfidf_topk(facts, q, 5, common_df=df, block=block).collect()}
        assert part == full
    assert len(full) == 60 and full[(100, 1)] == (0, 0.0)


def test_tfidf_takes_documents_alike_in_asked_terms_together(spark, monkeypatch):
    facts = spark.createDataFrame([(i, f"apple g{i % 3} z{i}") for i in range(60)], "fact_id long, document string")
    q = spark.createDataFrame([(1, "apple g1"), (2, "g2 apple apple")], "question_id long, query string")
    seen, write = {}, flat.materialise
    monkeypatch.setattr(flat, "materialise", lambda df, name: seen.setdefault(name, write(df, name)))
    rows = flat.tfidf_topk(facts, q, 4, common_df=30).orderBy("question_id", "rank").collect()
    assert [r.fact_id for r in rows] == [1, 4, 7, 10, 2, 5, 8, 11] and len({r.score for r in rows[:4]}) == 1
    assert seen["alike"].count() == 3 * 4 and seen["alike"].where("profile IS NOT NULL").count() == 3  # of 60 documents


def test_tfidf_of_few_questions_writes_no_document_tables(spark, monkeypatch):
    import math
    from collections import Counter
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(["common", "usual", "x9", f"w{rng.randrange(12)}", f"z{i}"]) for _ in range(rng.randrange(1, 30))) for i in range(60)}
    texts.update({60: "", 61: None, 62: "...", 63: "Common COMMON common"})
    asked = {0: "common w1 w1 unseen", 1: "x9 w2 z5", 2: "nothing known"}
    written, write = [], flat.materialise
    monkeypatch.setattr(flat, "materialise", lambda df, name: written.append(name) or write(df, name))
    facts = spark.createDataFrame(list(texts.items()), "fact_id long, document string")
    got = {(r.question_id, r["rank"]): (r.fact_id, r.score) for r in flat.tfidf_topk(facts, spark.createDataFrame(list(asked.items()), "question_id long, query string"), 5).collect()}
    assert set(written) == {"idf", "query-vectors", "topk"}  # not the documents' vectors

    counts = {i: Counter(t.lower().split()) if t and t != "..." else Counter() for i, t in texts.items()}
    df, n = Counter(w for c in counts.values() for w in c), len(texts)

    def vector(c):
        w = {t: f * (math.log((1 + n) / (1 + df[t])) + 1 if t in df else math.log(1 + n) + 1) for t, f in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    docs = {i: vector(c) for i, c in counts.items()}
    for q, text in asked.items():
        v = vector(Counter(text.split()))
        want = sorted((-round(sum(x * d.get(t, 0) for t, x in v.items()), 9), i) for i, d in docs.items())[:5]
        assert [(i, -s) for s, i in want] == [got[(q, r)] for r in range(1, 6)]


def test_versions_are_found_once_for_questions_alike(spark, monkeypatch):
    d = spark.createDataFrame([(f"user_{u}::p", i, f"User_{u}", "p", "obj", "obj") for u in (1, 2) for i in range(4)],
                              "claim_key string, version_id long, subject string, predicate string, object_value string, normalized_object string")
    q = spark.createDataFrame([(i, "so User_1" + (" why" if i % 2 else "")) for i in range(20)] + [(20, "so User_1 or User_2"), (21, None)], "question_id long, question string")
    seen, write = {}, RV.materialise
    monkeypatch.setattr(RV, "materialise", lambda df, name: seen.setdefault(name, write(df, name)))
    got = {}
    for r in RV.retrieve_versions(q, d, d.where("version_id = 3"), per_term=3, limit=2).collect():
        got.setdefault(r.question_id, set()).add((r.claim_key, r.version_id))
    assert got == {**{i: {("user_1::p", 3)} | ({("user_1::p", 2)} if i % 2 else set()) for i in range(20)}, 20: {("user_1::p", 3), ("user_2::p", 3)}}
    assert seen["asks"].count() == 4 and seen["ask-versions"].count() == 5


def test_focus_excerpt(spark):
    text = "Intro line.\nI bought apples.\nNothing here at all.\nApples and pears were bought today.\n" + "filler " * 100
    got = one(spark, RV.focus_excerpt(F.col("t"), F.lit("Which apples and pears?"), 200), t=text)
    assert got == "Apples and pears were bought today.\n...\nI bought apples."
    assert one(spark, RV.focus_excerpt(F.col("t"), F.lit("zebra"), 50), t=text) == X_compact(text, 50)
    assert one(spark, RV.focus_excerpt(F.col("t"), F.lit("zebra"), 50), t=" short ") == "short"
    long = "x " * 300 + "needle " + "y " * 400
    cut = one(spark, RV.focus_excerpt(F.col("t"), F.lit("the needle"), 1000), t=long + "\nother")
    assert "needle" in cut and cut.startswith("...") and cut.endswith("...") and len(cut) <= 906


def X_compact(text, n):
    flat_text = " ".join(text.split())
    return flat_text if len(flat_text) <= n else flat_text[: n - 3] + "..."


def test_focus_session(spark):
    turns = [("user", "I bought 3 albums."), ("assistant", "Nice albums!"), ("user", "The sky is blue.")]
    df = spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], "turns array<struct<role:string,content:string>>")
    def ask(q):
        return df.select(RV.focus_session(F.col("turns"), F.lit("[Session 0]"), F.lit(q), 500).alias("x")).first().x
    assert ask("How many albums did I get?") == "[Session 0]\nuser: I bought 3 albums."
    assert ask("Tell me something") == "[Session 0]\nuser: I bought 3 albums.\nuser: The sky is blue."


def test_count_before_anchor(spark):
    rows = [("q", i, "target", f"2023-10-{i + 1:02d}", f"gala {i}") for i in range(4)] + [("q", 9, "target", "2023-11-01", "late"), ("q", 10, "anchor", "2023-10-15", "anchor")]
    c = spark.createDataFrame([(q, p, r, d, None, n, None, None) for q, p, r, d, n in rows],
                              "question_id string, place int, role string, event_date string, session_date string, event_name string, object_value string, evidence string")
    rel = spark.createDataFrame([("q", "before")], "question_id string, temporal_relation string")
    assert E.reduce_count_bounded(c, rel).first().n == 4


def test_session_choice_prefers_acquisition(spark):
    q = spark.createDataFrame([("q", "What did I buy 10 days ago?", "2023/03/25 (Sat) 18:26")], "question_id string, question string, question_date string")
    s = spark.createDataFrame([("q", 0, "2023/03/01", "smalltalk"), ("q", 1, "2023/03/15", "I got a kettle"), ("q", 2, "2023/03/15", "weather talk")],
                              "question_id string, session_index int, session_date string, text string")
    assert [r.session_index for r in RV.select_sessions(q, s, 1).collect()] == [1]
