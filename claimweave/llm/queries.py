"""The registered queries of this package and, where SQL can say them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import (
    chat, collocations, conversations, decontaminate, html_text, mixture, ngram_join, packing, quality, syncmers, token_count, token_files, toxicity)
from claimweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:15] AS BIGINT) AS key
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM src),
lv AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER up, 0)::DOUBLE AS rest_all, sum(w) OVER dn AS open_w
  FROM w WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                dn AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT rest_all, open_w FROM lv WHERE rest_all * w / open_w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
goal AS (SELECT w.source, source_size, least((SELECT rest_all FROM level) * w.w / (SELECT open_w FROM level), cap::DOUBLE) AS target FROM w),
cum AS (SELECT s.*, source_size, target, round(target)::BIGINT % greatest(source_size, 1) AS rest, round(target)::BIGINT // greatest(source_size, 1) AS passes,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM cum
"""


@register("op10_mixture", MIX_SQL)
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


LEAK_SQL = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS words FROM documents),
iw AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS words FROM benchmark),
ds AS (SELECT id, unnest(list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])) AS s FROM w WHERE len(words) >= 5),
isets AS (SELECT id, list_sort(list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])) AS l FROM iw WHERE len(words) >= 5),
one AS (SELECT min(id) AS item_id, count(*) AS n_items, l FROM isets GROUP BY l),
its AS (SELECT item_id, n_items, CAST(len(l) AS BIGINT) AS item_shingles, unnest(l) AS s FROM one)
SELECT ds.id AS doc_id, item_id, n_items, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
FROM ds JOIN its USING (s) GROUP BY ds.id, item_id, n_items, item_shingles HAVING count(*) * 100 >= 80 * item_shingles
"""


@register("op1_decontamination", LEAK_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, role AS speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') AS content, coalesce(text, '') AS raw FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, CASE WHEN role <> 'assistant' THEN coalesce(speaker, '') END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || coalesce(speaker, '') ELSE '' END || chr(10) AS head FROM r),
g AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, row_number() OVER w AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS "end" FROM g
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, raw ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, role, name, segment, "end" - length(segment) AS start, "end",
  CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN "end" - 1 END AS mask_end
FROM o
"""


@register("op9_chat_rotation", CHAT_SQL)
def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


@register("op7_syncmers")
def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 2], ' ') FOR i IN range(1, len(words) - 1)]) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS s FROM l),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n
"""


@register("op5_ngram_join", JACCARD_SQL)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_collocations")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


@register("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
