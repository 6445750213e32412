"""The named queries of this folder and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import bpe, chat_format, code_compression, exact_topk, html_extract, language, nearest, ngram_join, packing, periodic_runs, repeats, simhash, token_counts
from profilum.llm.settings import prepare
from profilum.sources.model import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


@query
def op2_chat_format(spark, folder):
    quoted = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), quoted.alias("text"))
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.examples(turns))


ORACLES["op2_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)
), sized AS (
    SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        sum(length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) OVER (w ROWS UNBOUNDED PRECEDING) AS chars
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars,
    count(*) FILTER (role = 'assistant' OR place = n) AS n_examples
FROM sized GROUP BY conv_id
"""


@query
def op3_simhash(spark, folder):
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


@query
def op8_packing(spark, folder):
    pieces = packing.cut(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


@query
def op10_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, path)).withColumnRenamed("id", "doc_id")


@query
def op4_suffix_dedup(spark, folder):
    return repeats.digests(repeats.remove(read_table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


@query
def op5_language(spark, folder):
    return language.identify(read_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_exact_topk(spark, folder):
    found = exact_topk.of_table(read_table(spark, folder, "embeddings"), every=20, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op7_exact_topk"] = """
WITH usable AS (
    SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), common AS (SELECT len(v) AS n FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), scaled AS (SELECT vec_id, list_transform(v, lambda x: floor(64 * x)) AS v FROM usable, common WHERE len(v) = n
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM scaled q JOIN scaled c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op9_nearest(spark, folder):
    found = nearest.of_table(read_table(spark, folder, "embeddings"), every=50, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op1_token_counts(spark, folder):
    counted = token_counts.count_tokens(read_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


@query
def op6_html_extract(spark, folder):
    return html_extract.extract(read_table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query
def op11_code_compression(spark, folder):
    found = code_compression.with_label_error(code_compression.compress(read_table(spark, folder, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


# Every round measures all parts against all entries: (distance * 16 + entry) is smallest at the nearest, ties to the lower index.
_PARTS_SQL = """
WITH usable AS (
    SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(4096 * x)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM usable
), parts AS (SELECT r, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM numbered CROSS JOIN range(8) t(p)
), book0 AS (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 16
"""
_ROUND_SQL = """
), near{after} AS (
    SELECT r, p, min(16 * (list_inner_product(parts.x, parts.x) - 2 * list_inner_product(parts.x, b.x) + list_inner_product(b.x, b.x))::BIGINT + e) AS least
    FROM parts JOIN book{before} b USING (p) GROUP BY r, p
"""
_UPDATE_SQL = """
), mean{after} AS (
    SELECT p, e, list(m ORDER BY i) AS x FROM (
        SELECT n.p, n.least % 16 AS e, i, floor(sum(x[i]) / count(*)) AS m
        FROM near{after} n JOIN parts USING (r, p) CROSS JOIN range(1, 4097) t(i) WHERE i <= len(x) GROUP BY ALL
    ) GROUP BY p, e
), book{after} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{before} b LEFT JOIN mean{after} m USING (p, e)
"""
_CODES_SQL = """
), coded AS (SELECT r, string_agg(format('{:02x}', least % 16), '' ORDER BY p) AS code, sum(least // 16)::BIGINT AS error FROM near7 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256
FROM coded JOIN numbered USING (r)
"""
_ROUNDS_SQL = "".join((_ROUND_SQL + _UPDATE_SQL).format(before=number, after=number + 1) for number in range(6))
ORACLES["op11_code_compression"] = _PARTS_SQL + _ROUNDS_SQL + _ROUND_SQL.format(before=6, after=7) + _CODES_SQL


@query
def op12_periodic_runs(spark, folder):
    documents = periodic_runs.repeated_on_purpose(read_table(spark, folder, "documents"))
    return periodic_runs.digests(periodic_runs.find(documents)).withColumnRenamed("id", "doc_id")


@query
def op13_ngram_join(spark, folder):
    return ngram_join.join(read_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
