"""Collocations against counting every phrase."""

import collections
import os
import random
import re

import duckdb
import pytest

from claimweave.llm import collocations

MORE = "/root/testdata/sf0.01"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def expected(rows, top=2000, longest=3, least=10):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, n in found.items():
            for k in range(2, len(p)):
                covered |= {q for q in (p[i:i + k] for i in range(len(p) - k + 1)) if 100 * n >= 50 * found[q]}
        kept = []
        for p, a in found.items():
            if p not in covered:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def answers(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(MORE), reason="test tables not present")
def test_given_documents(spark):
    rows = duckdb.sql(f"SELECT lang, text FROM '{MORE}/documents.parquet'").fetchall()
    got = answers(collocations.mined(spark.read.parquet(f"{MORE}/documents.parquet")))
    assert len(got) > 100 and got == expected(rows)


def test_small_words_and_edges(spark):
    rnd = random.Random(3)
    words = ["A", "b", "the", "É", "中", "x\xa0y", "c"]
    rows = [(rnd.choice(["en", None, ""]), "".join(rnd.choice(words) + rnd.choice("  \t\t.\n,") for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    rows += [("fr", "un deux trois quatre cinq six sept huit neuf.")] * 12 + [("en", None), (None, None), ("en", ""), ("de", "no candidates here"), ("en", "b " * 30_000)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS words", "'x' AS gram").repartition(5)
    assert answers(collocations.mined(df)) == expected(rows)
    assert answers(collocations.mined(df, top=3, longest=4, least=5)) == expected(rows, 3, 4, 5)
    assert collocations.mined(df.where("false")).count() == 0


def test_words_as_numbers_and_as_text_give_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice("abcdefghij") + rnd.choice(["", "", "."]) for _ in range(50))) for _ in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    numbered = answers(collocations.mined(df))
    monkeypatch.setattr(collocations, "MOST_KNOWN", 3)
    assert answers(collocations.mined(df)) == numbered == expected(rows)


def test_repeated_passages_are_compacted(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [("en", f"{passage}.")] * 11 + [("en", f"w{i} one two.") for i in range(5)]
    graph = collocations.PhraseGraph(spark.createDataFrame(rows, "lang string, text string"))
    found = collections.defaultdict(list)
    for r in graph.passages(graph.compacted()).orderBy("place").collect():
        found[(r.first, r.n)].append(r.word)
    # "one two" also occurs elsewhere, so the path starts behind it
    assert {k: " ".join(v) for k, v in found.items()} == {("two three", 11): passage.removeprefix("one ")}
