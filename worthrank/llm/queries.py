"""The queries of this subpackage: ``opN_<name>`` applies operator N with its production parameters to
its whole table and derives the columns of the result. ``LLM_QUERIES`` maps names to callables,
``LLM_SQL`` the names that SQL can express to DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthrank.llm.ann import build_index, search
from worthrank.llm.common import held_out, table
from worthrank.llm.exact_dedup import dedup_exact
from worthrank.llm.html_text import extract
from worthrank.llm.jaccard_join import link_documents
from worthrank.llm.langid import identify, learn_references
from worthrank.llm.lexical_search import rank_documents
from worthrank.llm.line_dedup import dedup_lines
from worthrank.llm.mixing import mix
from worthrank.llm.packing import pack_pieces, token_pieces
from worthrank.llm.quality import judge
from worthrank.llm.substring_dedup import dedup_passages
from worthrank.llm.token_align import Vocabularies, align_tokenizers
from worthrank.llm.toxicity import fit, score

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}

#: Where the ranks of the byte-pair vocabulary and its pre-tokenizer's pattern come from.
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: The same vocabulary with its added tokens.
TOKENIZER_PATH = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE_LENGTH = 2048
#: Both vocabularies that operator 12 aligns.
ALIGNED = Vocabularies(RANKS_PATH, PATTERN, TOKENIZER_PATH, public_tokenizers.path("piece_bpe_32k.model"))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), RANKS_PATH, PATTERN, SEQUENCE_LENGTH, tokenizer_path=TOKENIZER_PATH)
    return pack_pieces(pieces, SEQUENCE_LENGTH)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    references = learn_references(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), references).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "em_rounds", "em_converged")


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


LLM_SQL["op4_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sr
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE (sr - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most,
         CAST(sum(source_size) OVER () * 1.5 AS DOUBLE) AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own_level
  FROM w WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / weight, sr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, least(CAST(most AS DOUBLE), weight * (SELECT arg_min(own_level, CAST(most AS DOUBLE) / weight) FROM l
         WHERE own_level * weight < most)) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, d.k, t.source_size, t.target, t.sr, t.weight, t.budget, p.again,
         (CAST(sum(d.size) OVER (PARTITION BY t.sr, p.again ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING)
               + p.again * t.source_size AS DOUBLE)) / t.weight AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) p(again)),
r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, sr, again, k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, size, source_size, target
"""


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index, centre = build_index(vectors, k=20)
    return search(index, centre, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


LLM_SQL["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.*, f.first IS NOT NULL AND f.first < k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


LLM_SQL["op11_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
o AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, s GROUP BY term),
i AS (SELECT o.r, o.term, w.w * ((1000000000 * o.tf) // (1000 * o.tf + 20 * (50 + (50 * CAST(len(d.t) AS BIGINT) * s.nd) // s.nt))) AS part
      FROM o JOIN w USING (term) JOIN d USING (r) CROSS JOIN s),
f AS (SELECT q.item_id, d.doc_id, i.r, CAST(sum(i.part) AS BIGINT) AS score FROM q JOIN i USING (term) JOIN d USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents").select("doc_id", "text"))


LLM_SQL["op13_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER (PARTITION BY plain ORDER BY doc_id) = 1 AS kept, sha256(plain) AS text_sha256
FROM t
"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), ALIGNED)
