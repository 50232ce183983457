"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing extra columns, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from claimweave.llm import chat, decontaminate, html_text, mixture, ngram_join, quality, syncmers, token_count, token_files, toxicity

LONG = "lorem ipsum dolor " * 20_000
ITEM = "one two three four five six seven eight nine ten"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until evening comes", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", None, 4),
    (5, LONG, "en", "b", 7),
    (6, "The quick brown fox jumps over the lazy dog again and again until evening comes", "en", "b", 1),
    (6, "The quick brown fox jumps over the lazy dog again and again until evening comes", "en", "b", 1),
    (None, f"before {ITEM} after", "en", "c", 2),
    (None, "null id, other text", None, "c", 2),
    (7, f"x y z {ITEM} and more text behind it", None, "c", 3),
    (8, "two words", "en", "d", 2),
    (9, "'s <|endoftext|> don't  stoṕ 中文 \x85 tail  ", "en", "d", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 10)] + [(1, 1, 0), (None, 1, 1), (2, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.selectExpr(
        "*", "1 AS size", "'k' AS `key`", "2 AS n", "3 AS label", "4 AS `row`", "5 AS target", "6 AS t", "'w' AS words", "0.5D AS score", "7 AS k1", "8 AS `a.b`")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is None, x) for x in r)


def texts():
    return [(r[0], r[1] or "") for r in ROWS]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM, 0), (2, ITEM, 0), (3, None, 0), (4, "", 0), (5, "two words", 0), (6, "not in any text at all today", 0)], "item_id long, text string, n int")
    got = rows(decontaminate.matches(docs, items).select("doc_id", "item_id", "n_items"))
    assert sorted(got, key=key) == sorted([(None, 1, 2), (7, 1, 2), (8, 5, 1)], key=key)
    assert rows(decontaminate.matches(none, items)) == [] and rows(decontaminate.matches(docs, items.where("false"))) == []
    left = decontaminate.without_benchmark(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontaminate.without_benchmark(none, items).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([
        (1, "u", None, 0), (2, "u", "", 0), (3, None, "<p>a  b<p>c", 0), (None, "u", "plain &amp; &eacute;", 0), (5, "u", "<html><body></body></html>", 0),
        (5, "u", "<div" * 3, 0), (6, "u", "<article>" + "<p>w</p>" * 5000, 0), (7, "u", "<div>" * 3000 + "deep", 0)], "page_id long, url string, html string, text int")
    got = {(r[0], r[1], len(r[2])): (r[2], r[3]) for r in rows(html_text.extracted(pages))}
    assert got[(1, "u", 0)] == ("", 0) and (3, None, 5) in got and got[(None, "u", 9)][0] == "plain & é"
    assert got[(6, "u", 9999)][0] == " ".join("w" * 5000) and (7, "u", 4) in got
    assert html_text.extracted(pages.where("false")).count() == 0


PROSE = "".join(f"<p>Sentence {i} of the story tells what happened next, in so many words.</p>" for i in range(12))
STORY = " ".join(f"Sentence {i} of the story tells what happened next, in so many words." for i in range(12))


@pytest.mark.parametrize("name", ["page-with-sidebar", "content-with-sidebar", "layout-no-sidebar", "header-fixed", "menu-open", "cookie-accepted", "social-science", "legal-text"])
def test_html_wrappers_named_after_other_parts(name):
    side = "<div class='sidebar'><p>About the author of this site.</p></div><div class='share-bar'><a href='x'>Share</a> this</div>"
    foot = "<div class='site-footer'>All rights reserved by somebody.</div>"
    for inner in (f"<article>{PROSE}</article>", f"<div class='text'>{PROSE}</div>"):
        for outer in (f"class='{name}'", f"id='wrapper' class='{name}'", f"id='{name}'"):
            assert html_text.main_text(f"<html><body><div {outer}>{inner}{side}</div>{foot}</body></html>") == STORY
    assert html_text.main_text(f"<body><div class='{name}'><div class='{name}'>{PROSE}</div></div></body>") == STORY


def test_html_articles_and_comments():
    comments = "".join(f"<article id='div-comment-{i}' class='comment-body'><p>I {i} do not agree with any of this at all, and here is why I think so.</p></article>" for i in range(40))
    post = f"<article class='post comments-open'>{PROSE}</article>"
    for page in (post, f"{post}<div class='comments-area'>{comments}</div>", f"{post}<div id='comments'>{comments}</div>", f"<div class='page-with-sidebar'>{post}<ol class='comment-list'>{comments}</ol></div>"):
        assert html_text.main_text(f"<body>{page}</body>") == STORY
    assert html_text.main_text(f"<body><article>{PROSE}</article><div class='related-posts'>{'<article><p>Another story, told in a teaser of a few words only.</p></article>' * 15}</div></body>") == STORY
    assert html_text.main_text(f"<body><div class='header'><h1>Site</h1></div><div>{PROSE}</div></body>") == STORY
    assert html_text.main_text("<div class='menu-open'>" * 3000 + "deep") == "deep"


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted(((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts()), key=key)
    got = rows(token_count.counted(docs, path))
    assert sorted((r[:3] for r in got), key=key) == want and all(r[3] == (r[2] > 512) for r in got)
    assert rows(token_count.counted(none, path)) == []


def test_token_files(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(rows(token_files.encoded(docs, path)), key=lambda r: r[1])
    assert [r[0] for r in got if r[0] is not None] == sorted(r[0] for r in ROWS if r[0] is not None)
    start, pool = 0, [(i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")) for i, t in texts()]
    for r in got:
        assert r[1] == start
        start += r[2]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == sorted(((i, len(a), zlib.crc32(a.tobytes())) for i, a in pool), key=key)
    assert rows(token_files.encoded(none, path)) == []


def test_ngram_join(docs, none):
    got = sorted(rows(ngram_join.linked_documents(docs)), key=key)
    by = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == len(ROWS) and by[6][2] == by[1][2] == 1 and by[8] == (8, 1, 8) and by[2] == (2, 0, 2) and by[4] == (4, 0, 4)
    assert rows(ngram_join.linked_documents(none)) == []
    left = ngram_join.one_of_each_group(docs)
    assert left.columns == docs.columns and left.where("doc_id = 6").count() == 0 and left.count() == len(ROWS) - 2
    twins = docs.where("doc_id = 6")
    assert ngram_join.one_of_each_group(twins).count() == 1
    assert ngram_join.one_of_each_group(none).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores(spark, docs, none, module):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS label")
    got = rows(module.scored(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= module.THRESHOLD) for r in got)
    assert {r[0]: r[1] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % module.MODULUS == module.HELD for i, _ in texts()}
    assert rows(module.scored(none, labels)) == []
    assert len({r[2] for r in rows(module.scored(docs, labels.where("false")))}) == 1  # nothing to learn from
    if module is toxicity:
        kept = module.without_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() <= len(ROWS)


def test_fingerprints(docs, none):
    got = rows(syncmers.fingerprints(docs))
    assert len(got) == len(ROWS)
    order = sorted(set(texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    # ids that tie (null here) follow each other in either order
    for first in (order, [order[1], order[0], *order[2:]]):
        want = set()
        for at, (i, t) in enumerate(first):
            nxt = first[(at + 1) % len(first)][1]
            q = len(t) // 4
            want.add((i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
        if {(r[0], r[2], r[3]) for r in got} == want:
            break
    else:
        raise AssertionError("edited texts differ")
    assert all(0 <= r[6] <= 1 and 0 <= r[7] <= 1 for r in got)
    prints = {}
    for (i, t), r in ((x, r) for x in texts() for r in got if r[0] == x[0] and r[2] == len(x[1])):
        prints.setdefault(t, set()).add(r[4])
    assert all(len(p) == 1 for t, p in prints.items() if t) and prints[""] == {""}
    assert rows(syncmers.fingerprints(none)) == []
    one = rows(syncmers.fingerprints(docs.where("doc_id = 5")))
    assert one[0][7] == 1.0


def test_fingerprints_around_a_window(spark):
    """Texts of 0 to 14 words against brute force over the hashes of their pairs."""
    texts = [" ".join(f"w{i * 31 + j * 7}" for j in range(n)) for n in range(15) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("w", F.split("text", " "))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    hashed = df.select("text", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<long>")).alias("pairs"), F.hash("text").alias("only"))
    got = {r.text: r.a for r in syncmers.with_anchors(df, F.col("text"), "a").collect()}
    windows, want, short, unchosen = set(), {}, {}, 0
    for text, p, only in hashed.collect():
        chosen = [tuple(p[i:i + 5]) for i in range(len(p) - 4) if min(p[i], p[i + 4]) <= min(p[i + 1:i + 4])]
        want[text] = chosen or [(h,) for h in p]
        short[text] = [] if not text else [only]
        windows.update(want[text])
        unchosen += len(p) > 4 and not chosen
    assert unchosen > 5
    value = {}
    for n in (1, 5):
        of = [w for w in windows if len(w) == n]
        rows_ = spark.createDataFrame(of, ", ".join(f"h{i} long" for i in range(n))).select("*", F.hash(*[f"h{i}" for i in range(n)]).alias("a")).collect()
        value.update({tuple(r[:n]): r[n] for r in rows_})
    for text in texts:
        assert got[text] == ([value[w] for w in want[text]] or short[text]), text
    assert [t for t in got if not got[t]] == [""]


def test_chat(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, 3, None, "who?", 9), (1, 3, None, "who?", 9),
        (2, 0, "system", "alone", 9), (None, 0, "ann", "x<|im_end|>y", 9), (3, None, "ann", "", 9)], "conv_id long, turn int, role string, text string, start int")
    got = chat.rotations(turns).collect()
    sides = {(r.conv_id, r.perspective) for r in got}
    assert sides == {(1, "ann"), (1, "bob"), (1, None), (None, "ann"), (3, "ann")}
    for side in sides:
        mine = sorted((r for r in got if (r.conv_id, r.perspective) == side), key=lambda r: r.position)
        whole = "".join(r.segment for r in mine)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        for r in mine:
            assert whole[r.start:r.end] == r.segment
            if r.role == "assistant":
                assert whole[r.mask_start:r.mask_end].endswith("<|im_end|>") and r.name is None
            else:
                assert r.mask_start is None and r.name is not None
    assert [r.segment for r in got if r.conv_id is None] == ["<|im_start|>assistant\nx<\\|im_end|>y<|im_end|>\n"]
    assert chat.rotations(turns.where("false")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return {**share, **capped}
        capped.update({s: 3 * sizes[s] for s in above})


def test_mixture(docs, none):
    got = rows(mixture.mix(docs))
    assert len(got) == len(ROWS)
    words = {}
    for (i, t, _, s, _) in ROWS:
        words[s] = words.get(s, 0) + len((t or "").replace("\x85", "x").split())
    want = brute_targets(words)
    targets = {}
    for r in got:
        assert 0 <= r[4] <= 3 * r[1]
        targets.setdefault(round(r[3], 6), [0, r[2]])[0] += r[4]
    assert {round(v, 6) for v in want.values()} == set(targets)
    assert sum(t[0] for t in targets.values()) <= sum(words.values())
    assert sorted(got, key=key) == sorted(rows(mixture.mix(docs.repartition(3))), key=key)
    assert rows(mixture.mix(none)) == []
    whole = mixture.mixed_documents(docs)
    assert whole.columns == docs.columns and 0 < whole.count() <= 3 * len(ROWS) and mixture.mixed_documents(none).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == start.columns, name
                now = after
        assert after.count() == now.count()
