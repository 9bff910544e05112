"""Validation operators (V1-V5, J2-J4, J6, A16, U3, U4) returning violations as tables.

Every check reports *all* violations as rows ``(doc_id, pos, rule, line)`` instead of stopping at
the first; a file is valid exactly when it has no violation row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.functions.scalar import LINE_PATTERN_2019, LINE_PATTERN_2020, strip, tab_field, to_int

VIOLATION_COLS = ("doc_id", "pos", "rule", "line")


def _content_bounds(lines: DataFrame, doc_col: str, pos_col: str, line_col: str) -> DataFrame:
    """Lines between the first and last non-blank line of each file (the file is stripped as a
    whole before it is split), with ``i`` = 1-based line index from the first non-blank line.
    A file holding only blank lines keeps its first line (an empty line, which fails the check)."""
    s = strip(line_col)
    bounds = lines.groupBy(doc_col).agg(
        F.min(F.when(s != "", F.col(pos_col))).alias("_first"),
        F.max(F.when(s != "", F.col(pos_col))).alias("_last"),
        F.min(pos_col).alias("_min_pos"))
    j = lines.join(bounds, doc_col)
    keep = (F.col("_first").isNull() & (F.col(pos_col) == F.col("_min_pos"))) | \
           ((F.col(pos_col) >= F.col("_first")) & (F.col(pos_col) <= F.col("_last")))
    return (j.filter(keep)
            .withColumn("_i", F.coalesce(F.col(pos_col) - F.col("_first"), F.lit(0)) + 1)
            .withColumn("_s", F.when(F.col("_first").isNull(), F.lit("")).otherwise(strip(line_col))))


def line_violations_2019(lines: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos",
                         line_col: str = "line") -> DataFrame:
    """V1 (+P5, W4): each line must match ``<line_number> TAB <score>`` and line i must hold
    line number i, counted from 1."""
    c = _content_bounds(lines, doc_col, pos_col, line_col)
    rule = (F.when(~F.col("_s").rlike(LINE_PATTERN_2019), F.lit("bad_format"))
            .when(to_int(tab_field(F.col("_s"), 0)) != F.col("_i"), F.lit("not_consecutive")))
    return (c.select(F.col(doc_col).alias("doc_id"), F.col(pos_col).cast("bigint").alias("pos"),
                     rule.alias("rule"), F.col(line_col).alias("line"))
            .filter(F.col("rule").isNotNull()))


def line_violations_2020(lines: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos",
                         line_col: str = "line") -> DataFrame:
    """V2 (+P6): exactly four tab-separated fields, and ``<tweet_id> TAB <score>`` must match the
    2020 grammar. No ordering or duplicate check (the 2020 checker has none)."""
    c = _content_bounds(lines, doc_col, pos_col, line_col)
    fields = F.split(F.col("_s"), "\t")
    pair = F.concat(F.get(fields, 1), F.lit("\t"), F.get(fields, 2))
    rule = (F.when(F.size(fields) != 4, F.lit("field_count"))
            .when(~pair.rlike(LINE_PATTERN_2020), F.lit("bad_format")))
    return (c.select(F.col(doc_col).alias("doc_id"), F.col(pos_col).cast("bigint").alias("pos"),
                     rule.alias("rule"), F.col(line_col).alias("line"))
            .filter(F.col("rule").isNotNull()))


def file_validity(files: DataFrame, violations: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Boolean per file: valid when it has no violation (``check_format``)."""
    bad = violations.groupBy(F.col("doc_id").alias(doc_col)).agg(F.count(F.lit(1)).alias("n_violations"))
    return (files.join(bad, doc_col, "left")
            .select(*files.columns, F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"),
                    F.coalesce(F.col("n_violations") == 0, F.lit(True)).alias("valid")))


def coverage_violations(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V4 (J2 + J3 + U3): predictions without a gold row, gold rows without a prediction and
    repeated predictions - one full outer join of the two key-count tables (each side is
    pre-aggregated, so a hot key reaches the join as a single row)."""
    keys = list(keys)
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gold"))
    p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    j = g.join(p, keys, "full")
    rule = (F.when(F.col("n_pred").isNull(), F.lit("missing_prediction"))
            .when(F.col("n_gold").isNull(), F.lit("unknown_prediction"))
            .when(F.col("n_pred") > 1, F.lit("duplicate_prediction")))
    return (j.select(*keys, rule.alias("rule"),
                     F.coalesce("n_gold", F.lit(0)).cast("bigint").alias("n_gold"),
                     F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred"))
            .filter(F.col("rule").isNotNull()))


def check_coverage(gold: DataFrame, pred: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """V4 with the reference's failure mode: raise when any prediction or gold row is unmatched."""
    v = coverage_violations(gold, pred, keys)
    if strict:
        first = v.filter(F.col("rule") != "duplicate_prediction").first()
        if first is not None:
            raise ValueError(f"predictions do not match the gold lines: {first.asDict()}")
    return v


def gold_violations(gold: DataFrame, fields: int, id_col: str) -> DataFrame:
    """Gold lines (as ``parse_gold_2019`` / ``parse_gold_2020`` give them) that aren't ``fields`` fields with an
    integer id and label: ``doc_id, pos, rule``, the first rule that a line breaks."""
    rule = (F.when(F.col("n_fields") != fields, "fields").when(F.col(id_col).isNull(), id_col)
            .when(F.col("label").isNull(), "label"))
    return gold.select("doc_id", "pos", rule.alias("rule")).where("rule is not null")


def check_gold(gold: DataFrame, fields: int, id_col: str) -> DataFrame:
    """``gold`` itself; raises, as the reference's scorers do, when a line has a wrong shape."""
    bad = gold_violations(gold, fields, id_col).first()
    if bad is not None:
        raise ValueError(f"bad gold line: {bad.asDict()}")
    return gold


def manifest_check(manifest: DataFrame, validity: DataFrame) -> DataFrame:
    """V3 (+J4, A16, U4): equal numbers of gold and prediction files, no prediction file twice,
    and every prediction file well formed. ``manifest`` has ``pos, gold_path, pred_path``;
    ``validity`` has ``pred_path, valid``. One row."""
    m = manifest.join(validity.select(F.col("pred_path"), F.col("valid")), "pred_path", "left")
    out = m.agg(
        F.count("gold_path").alias("n_gold"),
        F.count("pred_path").alias("n_pred"),
        F.countDistinct("pred_path").alias("n_distinct_pred"),
        F.sum(F.when(F.col("valid") == False, 1).otherwise(0)).cast("bigint").alias("n_bad_files"),  # noqa: E712
    )
    ok = ((F.col("n_gold") == F.col("n_pred")) & (F.col("n_distinct_pred") == F.col("n_pred"))
          & (F.col("n_bad_files") == 0))
    return out.withColumn("valid", ok)


def repeated_files(manifest: DataFrame, col: str = "pred_path") -> DataFrame:
    """Paths listed more than once."""
    return manifest.groupBy(col).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)


def split_output_check(original: DataFrame, produced: DataFrame, key: str = "doc_no") -> DataFrame:
    """V5 + J6: per document, row counts of the original and the produced split agree and the
    produced split starts with id 1. ``original``: ``key, n_original``; ``produced``:
    ``key, n_produced, first_id``. Full outer join, so missing documents on either side show."""
    j = original.join(produced, key, "full")
    ok = (F.coalesce(F.col("n_original") == F.col("n_produced"), F.lit(False))
          & F.coalesce(F.col("first_id") == 1, F.lit(False)))
    return j.withColumn("ok", ok)
