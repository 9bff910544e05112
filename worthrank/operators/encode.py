"""Text encoding (T5, T6, F13) and vector features (T7, F9, F10) as DataFrame jobs.

T5 is re-aimed: instead of a pretrained byte-pair vocabulary, the vocabulary is learned from the
corpus (ids by descending frequency, ties by token), which a Spark job can build and apply at
scale: explode -> partial count -> global rank -> equi-join back -> regroup per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthrank.functions.scalar import binarize, dot, linear, word_count
from worthrank.operators.ranking import rank_within
from worthrank.session import checkpoint_dir

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
PAD_ID = 0


def tokens(text: str | Column) -> Column:
    """Lower-cased letter/digit runs of a text; empty pieces dropped."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: x != "")


def word_count_expr(text: str | Column) -> Column:
    """F13 word count (see ``functions.scalar.word_count``)."""
    return word_count(text)


def build_vocabulary(df: DataFrame, text_col: str, strategy: str = "two_level") -> DataFrame:
    """(token, count, id): id 1 is the most frequent token; 0 is reserved for padding.

    The token counts (one row per distinct token) are checkpointed once, so the sampling of the range
    partitioning reads them instead of exploding and counting the whole corpus twice."""
    checkpoint_dir(df.sparkSession)
    counts = (df.select(F.explode(tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count"))).checkpoint(eager=True)
    ranked = rank_within(counts, [], [("count", "desc"), ("token", "asc")], strategy=strategy)
    return ranked.withColumnRenamed("row_number", "id")


#: Tokens that are answered from a broadcast table of this many rows, instead of being shuffled to meet their id.
HEAVY_TOKENS = 2_000


def split_join(exploded: DataFrame, table: DataFrame, key: str, rank: str, values: list[str], heavy: int) -> DataFrame:
    """``exploded`` joined to ``table`` on ``key``, with ``rank`` and ``values``. ``rank`` numbers the keys by falling frequency, so the
    keys up to ``heavy`` are those that would make hot tasks: they meet a broadcast of ``heavy`` rows where they are, and
    only the others, of which none is frequent, are shuffled by key."""
    cols = [key, rank, *values]
    frequent = F.broadcast(table.where(F.col(rank) <= heavy).select(*cols))
    easy = exploded.join(frequent, key)
    rest = exploded.join(frequent.select(key), key, "left_anti").join(table.where(F.col(rank) > heavy).select(*cols), key)
    return easy.unionByName(rest)


def encode(df: DataFrame, keys: list[str], text_col: str, vocab: DataFrame, heavy: int = HEAVY_TOKENS) -> DataFrame:
    """Token ids per text, in text order: ``keys..., ids ARRAY<BIGINT>``.

    ``vocab`` numbers the tokens by falling frequency (``build_vocabulary``). Tokens are exploded with their position; the
    ``heavy`` most frequent get their ids from a broadcast of as many rows, the others by a join (``split_join``). Then
    they are regrouped per text. A group is one text, bounded by that text's own length.
    """
    exploded = df.select(*keys, F.posexplode(tokens(text_col)).alias("pos", "token"))
    ided = split_join(exploded, vocab.select("token", F.col("id").alias("_id")), "token", "_id", [], heavy)
    grouped = ided.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_id").alias("id")))).alias("_p"))
    enc = grouped.select(*keys, F.transform("_p", lambda s: s["id"]).alias("ids"))
    # texts without any token still get an (empty) row
    return df.select(*keys).join(enc, keys, "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def truncate_and_pad(enc: DataFrame, max_len: int | None = None) -> DataFrame:
    """Truncate to ``max_len`` ids (None keeps all), pad with 0 to the longest row of the whole set, and build
    the attention mask. The encoded rows are checkpointed once (shared checkpoint directory), so
    the longest-length scalar subquery and the padding read them instead of encoding twice."""
    checkpoint_dir(enc.sparkSession)
    trunc = enc.withColumn("input_ids", F.col("ids") if max_len is None else F.slice("ids", 1, max_len)).checkpoint(eager=True)
    pad_len = trunc.select(F.max(F.size("input_ids"))).scalar()
    missing = pad_len - F.size("input_ids")
    return (trunc.withColumn("pad_len", pad_len.cast("int"))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("input_ids")),
                                                   F.array_repeat(F.lit(0), missing)))
            .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD_ID).cast("bigint"), missing))))


def class_centroids(emb: DataFrame, vec_col: str = "embedding", class_col: str = "cls") -> DataFrame:
    """Per-class mean vector, ``class_col, centroid ARRAY<DOUBLE>`` (posexplode + partial avg;
    the regrouped arrays are bounded by the vector dimension)."""
    x = emb.select(class_col, F.posexplode(vec_col).alias("dim", "v"))
    per_dim = x.groupBy(class_col, "dim").agg(F.avg("v").alias("m"))
    return per_dim.groupBy(class_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def centroid_head(emb: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """A linear head learned from the data, one row ``w ARRAY<DOUBLE>, b DOUBLE``:
    w = mean(positive) - mean(negative), b = -w . (mean(positive) + mean(negative)) / 2."""
    c = class_centroids(emb.withColumn("cls", binarize(label_col)), vec_col, "cls")
    pair = c.agg(F.first(F.when(F.col("cls") == 1, F.col("centroid")), ignorenulls=True).alias("m1"),
                 F.first(F.when(F.col("cls") == 0, F.col("centroid")), ignorenulls=True).alias("m0"))
    w = F.zip_with("m1", "m0", lambda a, b: a - b)
    mid = F.zip_with("m1", "m0", lambda a, b: (a + b) / 2.0)
    return pair.select(w.alias("w"), (-dot(w, mid)).alias("b"))


def apply_linear_head(df: DataFrame, head: DataFrame, vec_col: str = "embedding", out: str = "z") -> DataFrame:
    """F9 on every row: the one-row head is attached as scalar-subquery columns, then
    ``z = w . x + b`` runs as a JVM higher-order expression."""
    h = head.select(F.struct("w", "b").alias("h")).scalar()
    with_head = df.withColumn("_w", h["w"]).withColumn("_b", h["b"])
    return with_head.withColumn(out, linear(vec_col, "_w", "_b")).drop("_w", "_b")
