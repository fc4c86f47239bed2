"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.bpe import bpe
from pairloom.llm.decontam import contamination
from pairloom.llm.langid import identify, train as train_languages
from pairloom.llm.minhash import near_duplicates
from pairloom.llm.pii import find_pii
from pairloom.llm.quality import quality
from pairloom.llm.records import read_records, write_records
from pairloom.llm.sharding import assign_shards
from pairloom.llm.suffixes import repeated_passages
from pairloom.llm.toxicity import score, train as train_toxicity
from pairloom.storage import table

#: The environment may name another tokenizer file.
TOKENIZER = "PAIRLOOM_TOKENIZER"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path() -> str:
    if TOKENIZER in os.environ:
        return os.environ[TOKENIZER]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op6_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train_languages(docs))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("rule")


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_array, op2_hyperminhash, op3_pii_crf, op4_template_decontamination, op5_ordinal_toxicity, op6_language_ftrl, op7_quality_cascade, op8_binary_records, op9_lookup_sharding, op10_bpe_transducer]
    return {f.__name__: f for f in found}


#: The words of a text, as the contracts define them.
_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_SQL_REPEATS = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
r AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM r),
c AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words FROM g GROUP BY doc_id, g.g
"""

_SQL_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE a.g IN (SELECT g FROM f) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c(node, lab) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, c.lab FROM c JOIN u ON u.a = c.node WHERE c.lab < u.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.lab AS component_id, s.doc_id = m.lab AS kept
FROM s JOIN (SELECT node, min(lab) AS lab FROM c GROUP BY node) m ON m.node = s.doc_id
"""


_SQL_QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
r AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS h FROM r),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, sum(CASE WHEN gap < 8 THEN gap ELSE 8 END) AS n FROM
      (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8) AS gap FROM d) GROUP BY doc_id),
f AS (SELECT w.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN g ON g.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * (length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g'))) > 3 * word_chars
            OR 5 * (length(text) - length(regexp_replace(text, '[0-9]+', '', 'g'))) > word_chars
            OR 10 * (length(text) - length(replace(text, '!!', ''))) > n_words OR 5 * (length(text) - length(replace(text, 'hahaha', ''))) > word_chars) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array": _SQL_REPEATS, "op2_hyperminhash": _SQL_NEAR, "op7_quality_cascade": _SQL_QUALITY}
