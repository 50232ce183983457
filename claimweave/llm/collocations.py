"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of ``k - 1`` words, an edge joins two that overlap in all but one word, so an edge is a run of ``k`` words, the longest
grams counted. One aggregation counts edges; at the end of a piece (where fewer than ``k`` words follow) the shorter
runs are counted as its ends. Words too rare for any phrase end pieces as well. Everything shorter follows without another look at the text: a node's flow is the weight of
its outgoing edges and of the pieces that end in it, and so on down to words.

Of this graph the part with enough weight is kept, and its unary paths are compacted: an edge that carries the whole flow of
both its nodes has no other way in or out, so chains of such edges (passages that repeat) become one path each, found by
pointer doubling in as many rounds as the logarithm of the longest. All grams of a path have one count, and each is part of a longer
one with the same count but for the longest. Collocations are read from the nodes and edges of the compacted graph.

Everything is per language. Counts are exact: products go through 38-digit decimals.

Defined results: null and empty texts have no words; a null language is ``und``; rows that repeat count as often as they occur; ties go
to the phrase in byte order; an empty table gives no rows; further columns are ignored; a text of any length is one
row's work.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.llm.common import kept, small, text_of, workers
from claimweave.plans.session import materialise

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2_000
SMALL_LANGS = 10_000
#: Different words or runs a worker counts before it hands their counts on.
MOST_HELD = 1_000_000
#: Frequent words are numbered and sent to all workers up to this number and these bytes; beyond, runs are counted as text.
MOST_KNOWN, MOST_KNOWN_BYTES = 1_000_000, 32 << 20
#: Bits of a word's number in a run of up to three.
BITS = 20
MASK = (1 << BITS) - 1
COUNTS = "lang string, gram string, n long"
# bytes: lower case for A-Z only, one blank for both, one break for all ends of pieces
_SAME = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else 32 if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def head(gram: Column, words: int) -> Column:
    """The first words of a gram."""
    return F.substring_index(gram, " ", words)


def tail(gram: Column, words: int) -> Column:
    """The last words of a gram."""
    return F.substring_index(gram, " ", -words)


def _tokens(text: bytes) -> list[bytes]:
    """Words in order, with breaks (a new line) between pieces and empty strings between blanks."""
    return text.translate(_SAME).replace(b"\n", b" \n ").split(b" ")


def _summed(counts: dict[str, Counter]) -> pa.RecordBatch:
    for c in counts.values():
        c.pop(b"", None)
        c.pop(b"\n", None)
    columns = [[k for k, c in counts.items() for _ in c], [g for c in counts.values() for g in c], [n for c in counts.values() for n in c.values()]]
    arrays = [pa.array(columns[0], type=pa.string()), pa.array(columns[1], type=pa.binary()).cast(pa.string()), pa.array(columns[2], type=pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "gram", "n"])


def _counting(grams):
    """Batches of ``lang, text`` to ``lang, gram, n``, summed per ``MOST_HELD`` different grams; ``grams`` lists those of a text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts.setdefault(lang, Counter()).update(grams(_tokens(text)))
                if sum(map(len, counts.values())) > MOST_HELD:
                    yield _summed(counts)
                    counts.clear()
        yield _summed(counts)

    return run


def _text_runs(longest: int):
    """Every run of ``longest`` words of a text's tokens, and the shorter ones at the end of a piece."""

    def runs(tokens: list[bytes]) -> Iterator[bytes]:
        for whole, piece in groupby((t for t in tokens if t), lambda t: t != b"\n"):
            if whole:
                words = list(piece)
                yield from (b" ".join(words[i:i + longest]) for i in range(len(words)))

    return runs


class _Numbers(dict):
    """Numbers of words; a word without one has 0, which ends pieces."""

    def __missing__(self, word: bytes) -> int:
        return 0


_known: dict[str, tuple[dict[str, _Numbers], list[tuple[str, str]]]] = {}


def _numbers(job: str, shared) -> tuple[dict[str, _Numbers], list[tuple[str, str]]]:
    """A worker's numbers of words per language, and the words by number; workers are used again, so they are told by ``job``."""
    if job not in _known:
        _known.clear()
        by_lang: dict[str, _Numbers] = {}
        for i, (lang, word) in enumerate(shared.value, 1):
            by_lang.setdefault(lang, _Numbers({b"": -1}))[word.encode()] = i
        _known[job] = by_lang, [("", ""), *shared.value]
    return _known[job]


def _number_runs(job: str, shared):
    """Batches of ``lang, text`` to ``node, gram, n``: runs of three numbered words (0 behind a piece's end), summed per ``MOST_HELD`` words."""

    def packed(ids: list[int]) -> pa.RecordBatch:
        a = np.array([*ids, 0, 0], dtype=np.int64)
        a = np.concatenate([a[a >= 0], [0, 0]])
        first, second, third = a[:-2], a[1:-1], a[2:]
        grams = ((first << 2 * BITS) | (second << BITS) | np.where(second > 0, third, 0))[first > 0]
        grams, n = np.unique(grams, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams >> BITS), pa.array(grams), pa.array(n.astype(np.int64))], names=["node", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang, _ = _numbers(job, shared)
        none, ids = _Numbers({b"": -1}), []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.extend(map(by_lang.get(lang, none).__getitem__, _tokens(text)))
                ids.append(0)
                if len(ids) > MOST_HELD:
                    yield packed(ids)
                    ids = []
        yield packed(ids)

    return run


def _flows(job: str, shared, least: int):
    """Runs in ascending order, all of a node together, to counts: edges and nodes with ``least`` and more, and each word's share here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words = _numbers(job, shared)
        open_: dict[int, tuple[int, int]] = {}  # per number of words: the run that the last batch ended in, and its count so far

        def told(size: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            use = (keys & MASK > 0) & ((n >= least) | (size == 1))
            keys, n = keys[use], n[use]
            parts = [[(k >> shift) & MASK for k in keys.tolist()] for shift in range((size - 1) * BITS, -1, -BITS)]
            grams = [" ".join([words[i][1] for i in g]) for g in zip(*parts)]
            langs = [words[i][0] for i in parts[0]]
            return pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(grams, type=pa.string()), pa.array(n), pa.array(np.full(len(keys), size, dtype=np.int32))],
                                              names=["lang", "gram", "n", "words"])

        for batch in batches:
            grams, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(grams):
                continue
            for size in (3, 2, 1):
                runs = grams >> (3 - size) * BITS
                at = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
                keys, n = runs[at], np.add.reduceat(counts, at)
                if size in open_:
                    if open_[size][0] == keys[0]:
                        n[0] += open_[size][1]
                    else:
                        keys, n = np.concatenate([[open_[size][0]], keys]), np.concatenate([[open_[size][1]], n])
                open_[size] = int(keys[-1]), int(n[-1])
                yield told(size, keys[:-1], n[:-1])
        for size, (key, n) in open_.items():
            yield told(size, np.array([key]), np.array([n]))

    return run


class PhraseGraph:
    """The graph of one table of documents (``text``, ``lang``)."""

    def __init__(self, docs: DataFrame, longest: int = LONGEST, least: int = LEAST):
        self.k, self.least = longest, least
        texts = workers(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
        words = texts.mapInArrow(_counting(list), COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        words = materialise(words, "words")
        #: Occurrences of words per language.
        self.totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
        often = words.where(F.col("n") >= least)
        size = often.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
        if longest == 3 and size.n <= MOST_KNOWN and size.bytes <= MOST_KNOWN_BYTES:
            counts = self._numbered(texts, often)
        else:
            counts = self._spelled(texts)
        counts = materialise(counts, "counts")
        #: Counts of runs of each number of words, those of ``least`` and more.
        self.counts = {w: counts.where(F.col("words") == w).select("lang", "gram", "n") for w in range(1, longest + 1)}

    def _numbered(self, texts: DataFrame, often: DataFrame) -> DataFrame:
        """Counts through numbers of the frequent words: a phrase is no more frequent than its words, so rarer ones end pieces.

        Runs are shuffled once, by their node and already summed per worker; edges, flows and words follow from one sorted pass.
        """
        ordered = sorted((r.lang, r.gram) for r in often.select("lang", "gram").toLocalIterator())
        job, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(ordered)
        runs = texts.mapInArrow(_number_runs(job, shared), "node long, gram long, n long")
        runs = runs.repartition("node").sortWithinPartitions("gram").select("gram", "n")
        found = runs.mapInArrow(_flows(job, shared, self.least), "lang string, gram string, n long, words int")
        found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.max("words").alias("words"))
        return found.where(F.col("n") >= self.least)

    def _spelled(self, texts: DataFrame) -> DataFrame:
        """Counts of runs of any length, of words of any number, as text."""
        level = texts.mapInArrow(_counting(_text_runs(self.k)), COUNTS).withColumn("words", F.size(F.split("gram", " ")))
        found = None
        for words in range(self.k, 0, -1):
            # weight of outgoing edges plus ends, one word down at a time; the number of words is no key, so that a filter on it stays above the
            # shuffle, and every level hands on all columns, so that the branches below have the same shuffles and share them
            level = level.select("lang", head(F.col("gram"), words).alias("gram"), "n", F.least("words", F.lit(words)).alias("words"))
            level = level.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.max("words").alias("words"))
            part = level.where((F.col("words") == words) & (F.col("n") >= self.least))
            found = part if found is None else found.union(part)
        return found

    def edges(self) -> DataFrame:
        """``lang, gram, n, from, to, inner``: edges between nodes; ``inner`` edges carry all of both nodes' flow."""
        k = self.k
        flow = self.counts[k - 1]
        ends = self.counts[k].withColumn("from", head(F.col("gram"), k - 1)).withColumn("to", tail(F.col("gram"), k - 1))
        for side in ("from", "to"):
            ends = ends.join(flow.select("lang", F.col("gram").alias(side), F.col("n").alias(f"n_{side}")), ["lang", side])
        return ends.select("lang", "gram", "n", "from", "to", "n_from", "n_to", ((F.col("n") == F.col("n_from")) & (F.col("n") == F.col("n_to"))).alias("inner"))

    def paths(self, edges: DataFrame) -> DataFrame:
        """``lang, node, first, place``: nodes on unary paths, with their path's first node and their place in it (from 1).

        A path has an end on both sides (a piece starts and ends somewhere), so doubling the step of every node settles it.
        """
        inner = edges.where("inner").select("lang", F.col("to").alias("node"), F.col("from").alias("back"), F.lit(1).cast("long").alias("place"))
        steps = kept(inner)
        while True:
            further = steps.select(F.col("lang").alias("l"), F.col("node").alias("at"), F.col("back").alias("further"), F.col("place").alias("more"))
            both = steps.join(further, (F.col("lang") == F.col("l")) & (F.col("back") == F.col("at")), "left")
            moved = kept(both.select(
                "lang", "node", F.coalesce("further", "back").alias("back"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("further").isNotNull().alias("moved")))
            steps = moved.drop("moved")
            if moved.where("moved").isEmpty():
                return steps.withColumnRenamed("back", "first")

    def compacted(self) -> DataFrame:
        """``lang, gram, n, first, place, path_words``: all edges; those on a unary path with its first node, their place and its words."""
        edges = materialise(self.edges(), "edges-between")
        steps = materialise(self.paths(edges), "paths")
        size = steps.groupBy("lang", "first").agg((F.max("place") + (self.k - 1)).alias("path_words"))
        on_path = steps.join(size, ["lang", "first"]).withColumnRenamed("node", "to").withColumn("inner", F.lit(True))
        return materialise(edges.select("lang", "gram", "n", "to", "inner").join(on_path, ["lang", "to", "inner"], "left"), "graph")

    def passages(self, graph: DataFrame) -> DataFrame:
        """``lang, first, n, place, word``: the repeated passages (unary paths), a row per word, as a passage has no bound."""
        on_path = graph.where("inner")
        start = on_path.where("place = 1").select("lang", "first", "n", F.posexplode(F.split("first", " ")).alias("place", "word"))
        rest = on_path.select("lang", "first", "n", (F.col("place") + (self.k - 2)).alias("place"), tail(F.col("to"), 1).alias("word"))
        return start.select("lang", "first", "n", F.col("place").cast("long").alias("place"), "word").union(rest)

    def candidates(self, words: int, graph: DataFrame) -> DataFrame:
        """``lang, phrase, a, path_words``: runs of a number of words below ``k`` that no longer run covers."""
        phrases = self.counts[words].select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
        for longer in range(words + 1, self.k + 1):
            over = graph if longer == self.k else self.counts[longer]
            parts = F.array_distinct(F.array(*[tail(head(F.col("gram"), i + words), words) for i in range(longer - words + 1)]))
            most = over.select("lang", "n", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
            phrases = phrases.join(most, ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * COVERED, F.lit(True))).drop("most")
        # runs on a compacted path are covered by its edges, so what is left lies on none
        return phrases.withColumn("path_words", F.lit(None).cast("long"))

    def scored(self, words: int, phrases: DataFrame) -> DataFrame:
        """``lang, phrase, a, l, r, score, path_words`` by the lowest-scoring cut."""
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        cuts = []
        for cut in range(1, words):
            for side, n, part in (("l", cut, head), ("r", words - cut, tail)):
                counts = self.counts[n].select("lang", F.col("gram").alias("part"), F.col("n").alias(f"{side}{cut}"))
                phrases = phrases.withColumn("part", part(F.col("phrase"), n)).join(counts, ["lang", "part"]).drop("part")
            over = (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
            phrases = phrases.withColumn(f"__num{cut}", over.cast("decimal(38,0)")).withColumn(f"__den{cut}", (wide(f"l{cut}") * wide(f"r{cut}")).cast("decimal(38,0)"))
            cuts.append(F.struct(F.expr(f"__num{cut} div __den{cut}").cast("long").alias("score"), F.lit(cut).alias("k"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        low = F.array_min(F.array(*cuts))
        return phrases.withColumn("cut", low).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "path_words")


def mined(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score, path_words``.

    ``path_words``: words of the repeated passage in which all occurrences of the phrase lie, if they do.
    """
    graph = PhraseGraph(docs, longest, least)
    compacted = graph.compacted()
    found = graph.scored(longest, compacted.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "path_words"))
    for words in range(2, longest):
        found = found.union(graph.scored(words, graph.candidates(words, compacted)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(small(graph.totals, SMALL_LANGS), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "path_words")
