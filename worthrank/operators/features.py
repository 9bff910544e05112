"""M2: word n-gram features by an exact index instead of hash slots.

Every distinct term of the training texts gets a number of its own, by falling document frequency: the index is a table,
ranked in range partitions, and its length is the number of features. Texts meet it in a join whose most frequent terms
are answered from a broadcast of bounded length; a text becomes sorted numbers and TF-IDF values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthrank.operators.encode import HEAVY_TOKENS, split_join, tokens
from worthrank.operators.ranking import rank_within
from worthrank.session import checkpoint_dir


def ngram_terms(text: str | Column, n: int = 2) -> Column:
    """The words of a text and its runs of ``n`` words joined by a space, with repeats."""
    def with_runs(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.concat(words, F.when(F.size(words) >= n, runs).otherwise(F.array()))

    # an array of one, so that the text is split once and not once for each of its words
    return F.get(F.transform(F.array(tokens(text)), with_runs), 0)


def term_counts(df: DataFrame, id_col: str, text_col: str, n: int = 2) -> DataFrame:
    """(id, term, tf): a row per text and distinct term."""
    return df.select(id_col, F.explode(ngram_terms(text_col, n)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def feature_index(df: DataFrame, id_col: str, text_col: str, n: int = 2, min_docs: int = 1) -> DataFrame:
    """(term, docs, feature): every term that ``min_docs`` texts hold, numbered from 1 by falling document frequency, ties by
    term. The counts are checkpointed before they are ranked."""
    checkpoint_dir(df.sparkSession)
    counts = df.select(F.explode(F.array_distinct(ngram_terms(text_col, n))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    held = counts.where(F.col("docs") >= min_docs).checkpoint(eager=True)
    return rank_within(held, [], [("docs", "desc"), ("term", "asc")]).withColumnRenamed("row_number", "feature")


def indexed_texts(df: DataFrame, id_col: str, text_col: str, index: DataFrame, n_docs: int, n: int = 2) -> DataFrame:
    """``df`` without its text, with ``index`` (rising feature numbers from 0) and ``features`` (tf * ln((N + 1) / (docs + 1))). Terms outside
    the index have no feature; a text without any has empty arrays. ``id_col`` must name a row."""
    # texts are shuffled once, so that their terms, which take several times the room, are counted where they are
    met = split_join(term_counts(df.select(id_col, text_col).repartition(id_col), id_col, text_col, n), index, "term", "feature", ["docs"], HEAVY_TOKENS)
    value = F.col("tf") * F.log((F.lit(n_docs) + 1.0) / (F.col("docs") + 1.0))
    pairs = met.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((F.col("feature") - 1).alias("f"), value.alias("v")))).alias("_p"))
    joined = df.drop(text_col).join(pairs, id_col, "left")
    return joined.select(*[c for c in df.columns if c != text_col], F.coalesce(F.col("_p.f"), F.array().cast("array<bigint>")).alias("index"),
                         F.coalesce(F.col("_p.v"), F.array().cast("array<double>")).alias("features"))
