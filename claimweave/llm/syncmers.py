"""Document fingerprints: closed syncmers over words.

A window of ``K`` consecutive words is an anchor if the smallest of its inner ``S``-word hashes stands at
the window's first or last place. Whether a window is chosen depends on its own words alone, so an edit moves only
the anchors that touch it and unchanged passages keep theirs at the same distances. The fingerprint lists the
32-bit hashes of the anchors in text order, as hexadecimal words; two fingerprints' likeness is the Jaccard
similarity of their sets of anchors.

Words are runs without white space. In scripts written without blanks each letter is a word; a run longer than ``LONGEST``
characters (a web address, data) is cut behind vowels, digits and marks, so that it too is cut by its own content and an
insertion moves only the words beside it.
Defined results: where no window is chosen (texts shorter than one, and many a text of 6 to 9 words) every pair of words (or
the only word) is an anchor, which never equals the anchor of a window; only a text without words has an empty
fingerprint; two empty fingerprints are alike (1), an empty and another are not (0). Null texts are empty;
rows with null ids and repeated rows have theirs; a very long text is one row's work; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.llm.common import RUN, ordered_runs, text_of

K, S, LONGEST = 6, 2, 24
_SPAN = K - S + 1
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{_ALONE}]|[^\s{_ALONE}]{{1,{LONGEST}}}+(?![^\s{_ALONE}])|[^\s{_ALONE}]*?[aeiouAEIOU0-9\p{{P}}\p{{S}}]|[^\s{_ALONE}]+"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _inner(words: str) -> Column:
    """Hash of the ``S`` words from each place; as many as full places exist."""
    starts = F.slice(F.col(words), 1, F.greatest(F.size(words) - (S - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, S)]))


def _closed(inner: str) -> Column:
    """Hashes of the windows whose smallest inner hash is the first or last, in order."""
    places = F.slice(F.col(inner), 1, F.greatest(F.size(inner) - (_SPAN - 1), F.lit(0)))

    def anchor(h: Column, i: Column) -> Column:
        last = F.get(F.col(inner), i + (_SPAN - 1))
        middle = [F.get(F.col(inner), i + j) for j in range(1, _SPAN - 1)]
        return F.when(F.least(h, last) <= F.least(*middle), F.hash(h, *middle, last))

    return F.filter(F.transform(places, anchor), lambda a: a.isNotNull())


def with_anchors(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the array of anchors of ``text``."""
    words, inner = f"{name}__w", f"{name}__h"
    staged = df.withColumn(words, word_list(text)).withColumn(inner, _inner(words))
    short = F.when(F.size(inner) > 0, F.transform(F.col(inner), lambda h: F.hash(h))).otherwise(F.transform(F.col(words), lambda w: F.hash(w)))
    chosen = staged.withColumn(name, _closed(inner))
    return chosen.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(short)).drop(words, inner)


def spelled(anchors: str) -> Column:
    """Eight hexadecimal digits an anchor."""
    return F.array_join(F.transform(F.col(anchors), lambda a: F.lpad(F.hex(a.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), " ")


def likeness(a: str, b: str) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``) its fingerprint and that of its edited text.

    Next in order of id is the next different document (id, text); rows that repeat both have the same next. The
    last one's is the first, a single document's is itself. Null ids come first.
    """
    # both joins below move the same four columns by the same key, so the texts are shuffled once
    keyed = docs.select("doc_id", text_of().alias("text")).withColumns({"k0": F.xxhash64("doc_id"), "k1": F.xxhash64("text")})
    slim = keyed.select("doc_id", "k0", "k1", F.length("text").cast("long").alias("n_chars")).distinct()
    runs = ordered_runs(slim, ["doc_id", "k0", "k1"])
    local = W.partitionBy(RUN).orderBy("doc_id", "k0", "k1")
    here = F.struct("doc_id", "k0", "k1", "n_chars")
    before = runs.select("*", F.lag(here).over(local).alias("prev"))
    last = runs.groupBy(RUN).agg(F.max(here).alias("last"))
    ends = last.select(RUN, F.coalesce(F.lag("last").over(W.orderBy(RUN)), F.max("last").over(W.partitionBy(F.lit(1)))).alias("carried"))
    linked = before.join(ends.withColumnRenamed(RUN, "__r"), F.col(RUN) == F.col("__r"))
    linked = linked.select("k0", "k1", F.coalesce("prev", "carried").alias("p"))
    # what each document gives to the one before it: the head it lends and its own anchors
    need = F.floor(F.col("p.n_chars") / 4).cast("int")
    lend = with_anchors(keyed.join(linked, ["k0", "k1"]), F.col("text"), "next_anchors").select(
        F.col("p.k0").alias("k0"), F.col("p.k1").alias("k1"), F.substring(F.col("text"), F.lit(1), need).alias("head"), "next_anchors", F.col("doc_id").alias("next_doc_id"))
    lend = lend.groupBy("k0", "k1").agg(*[F.first(c).alias(c) for c in ("head", "next_anchors", "next_doc_id")])
    met = keyed.join(lend, ["k0", "k1"]).withColumn("n_chars", F.length("text").cast("long"))
    stay = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    met = met.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), stay), F.col("head")))
    met = with_anchors(with_anchors(met, F.col("text"), "anchors"), F.col("edited"), "edited_anchors")
    return met.select(
        "doc_id", "next_doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled("anchors").alias("fingerprint"), spelled("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"), likeness("anchors", "next_anchors").alias("near_next"))
