"""Packing: every id once, sequences without padding, the linear program against its bound; token ids against the library."""

import collections
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimweave.llm import cutting_stock, packing, token_count, token_files

MORE = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, texts, capacity):
    """``texts``: id -> list of texts with that id. Returns padding and the number of cut documents."""
    tok = Tokenizer.from_file(PATH)
    ids = {k: [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for t in v] for k, v in texts.items()}
    seq, doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append(p)
        doc[p.doc_id].append(p)
    padding = 0
    for rows in seq.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    assert set(doc) == set(ids)
    cut = 0
    for k, rows in doc.items():
        # each copy's pieces cover its ids: as many pieces begin or go on at a place as end there
        need = collections.Counter()
        for p in rows:
            own = [i for i in ids[k] if len(i) == p.doc_tokens and zlib.crc32(i[p.start:p.start + p.length].tobytes()) == p.ids_crc32]
            assert own
            need[p.start] += 1
            need[p.start + p.length] -= 1
        want = collections.Counter()
        for i in ids[k]:
            want[0] += 1
            want[len(i)] -= 1
        assert {a: n for a, n in need.items() if n} == {a: n for a, n in want.items() if n}
        cut += len(rows) > sum(-(-len(i) // capacity) for i in ids[k])
    return padding, cut


@pytest.mark.skipif(not os.path.isdir(MORE), reason="test tables not present")
def test_given_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{MORE}/documents.parquet'").fetchall()
    got = packing.packed(spark.read.parquet(f"{MORE}/documents.parquet"), PATH).collect()
    padding, cut = check(got, {i: [t] for i, t in rows}, 4096)
    assert padding == 0 and cut < 0.05 * len(rows)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_edges(spark, capacity):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "some words here"), (4, "some words here"), (4, "other"), (None, "null id"), (5, " \t\n"), (6, "É 中文 Əli"), *((i, "a b " * (i % 37)) for i in range(10, 150))]
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cls", "3 AS rank", "4 AS tie").repartition(4)
    assert check(packing.packed(df, PATH, capacity=capacity).collect(), texts, capacity)[0] == 0
    assert packing.packed(df.where("false"), PATH).count() == 0


def test_linear_program_is_near_its_bound():
    rnd = random.Random(2)
    for units, n in ((128, 128), (128, 40), (30, 12)):
        counts = {s: rnd.randint(0, 5000) for s in rnd.sample(range(1, units + 1), n)}
        found = cutting_stock.bins(counts, units)
        used = collections.Counter()
        for pattern, times in found:
            assert times > 0 and sum(s * k for s, k in pattern.items()) <= units
            used.update({s: k * times for s, k in pattern.items()})
        assert used == {s: c for s, c in counts.items() if c}
        # no packing needs fewer than the volume, or than the items above half a sequence
        bound = max(-(-sum(s * c for s, c in counts.items()) // units), sum(c for s, c in counts.items() if 2 * s > units))
        assert bound <= sum(t for _, t in found) <= 1.12 * bound + n
    assert cutting_stock.bins({}, 8) == [] and cutting_stock.bins({3: 0}, 8) == []


def strings(n):
    rnd = random.Random(11)
    narrow = [chr(c) for c in range(0x20, 0x250) if not 0x7F <= c < 0xA0]
    capitals = [chr(c) for c in range(0x180, 0x250)]
    wide = list("中文ไทยهذا한글Ωß́̇​\x85 🙂ẞΣσς")
    marks = ["'s", "'LL", "n't", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", "  ", "12", "3,4", "--", "_"]
    pools = [narrow, capitals, capitals + list("ab "), wide + narrow, marks + list("abcé"), wide + marks]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 24))) for pool in (rnd.choice(pools) for _ in range(n))] + ["Əli Bakıda yaşayır."]


def test_ids_of_random_strings_and_given_texts():
    tok, own = Tokenizer.from_file(PATH), token_files.WordEncoder(PATH)
    texts = strings(10_000)
    if os.path.isdir(MORE):
        texts += [t for (t,) in duckdb.sql(f"SELECT text FROM '{MORE}/documents.parquet'").fetchall()]
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        ids, sizes = own.encode(some, 2)
        want = [e.ids + [2] for e in tok.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want]
        assert np.frombuffer(ids, dtype=np.int32).tolist() == [i for w in want for i in w]


def test_counts_of_random_strings_and_given_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = strings(10_000)
    if os.path.isdir(MORE):
        texts += [t for (t,) in duckdb.sql(f"SELECT text FROM '{MORE}/documents.parquet'").fetchall()]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.counted(df, path).collect()}
    assert [got[i] for i in range(len(texts))] == want
