"""Column-level scalar helpers (F1-F13, P2, P3, P7) - all built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values. These must equal the task's published conventions for results to agree:
# the rank cut-offs of the scorer, the two ranking-line grammars of the format checkers, the
# run id written into 2020 rankings, the number of decimals written, the suffix of split files.
MAIN_THRESHOLDS = (1, 3, 5, 10, 20, 50)
LINE_PATTERN_2019 = r"^[1-9][0-9]{0,3}\t([-+]?\d*\.\d+|\d+)$"
LINE_PATTERN_2020 = r"^[1-9][0-9]{16,22}\t([-+]?\d*\.\d+|\d+)$"
DEFAULT_RUN_ID = "Model_1"
SCORE_DECIMALS = 5
SPLIT_SUFFIX = "_out.tsv"
# ---------------------------------------------------------------------------------------------

# Multiplier, increment and modulus of the classic C-library linear congruential generator;
# a keyed pseudo-random number both Spark and SQL engines compute identically in BIGINT.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Remove leading/trailing whitespace (tabs, CR, LF, spaces), like Python's ``str.strip``."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def strip_cr(x: str | Column) -> Column:
    """Drop a trailing carriage return left by CRLF files (F1)."""
    return F.regexp_replace(_c(x), "\r$", "")


def tab_field(x: str | Column, i: int) -> Column:
    """The i-th (0-based) tab-separated field, NULL when absent (F1)."""
    return F.get(F.split(_c(x), "\t"), i)


def to_int(x: str | Column) -> Column:
    """Lenient integer cast: NULL instead of an ANSI error (F2)."""
    return strip(x).try_cast("int")


def to_double(x: str | Column) -> Column:
    return strip(x).try_cast("double")


def base_name(path: str | Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def split_file_name(path: str | Column) -> Column:
    """``dir/x.tsv`` -> ``x_out.tsv``."""
    return F.concat(F.regexp_replace(base_name(path), r"\.tsv$", ""), F.lit(SPLIT_SUFFIX))


def round_half_even(x: str | Column, decimals: int = SCORE_DECIMALS) -> Column:
    """Round half to even, as numpy/pandas ``round`` does."""
    return F.bround(_c(x), decimals)


def fixed(x: str | Column, decimals: int) -> Column:
    """``%.Nf`` text."""
    return F.format_string(f"%.{decimals}f", _c(x))


def softmax2(z0: str | Column, z1: str | Column) -> tuple[Column, Column]:
    """Two-class softmax with max subtraction."""
    m = F.greatest(_c(z0), _c(z1))
    e0 = F.exp(_c(z0) - m)
    e1 = F.exp(_c(z1) - m)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def margin(p0: str | Column, p1: str | Column) -> Column:
    """Check-worthiness score p1 - p0 in [-1, 1] (F8)."""
    return _c(p1) - _c(p0)


def argmax2(p0: str | Column, p1: str | Column) -> Column:
    """Predicted class of two probabilities; a tie goes to class 0 (L4)."""
    return F.when(_c(p1) > _c(p0), F.lit(1)).otherwise(F.lit(0))


def dot(x: str | Column, w: str | Column) -> Column:
    """Dot product of two equal-length arrays as DOUBLE (F9 without bias)."""
    return F.aggregate(F.zip_with(_c(x), _c(w), lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, y: acc + y)


def linear(x: str | Column, w: str | Column, b: str | Column | float) -> Column:
    """Linear head ``z = w . x + b``."""
    bias = b if isinstance(b, Column) else (F.col(b) if isinstance(b, str) else F.lit(float(b)))
    return dot(x, w) + bias


def vector_mean(a: str | Column, b: str | Column) -> Column:
    """Element-wise mean of two equal-length arrays."""
    return F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") + y.cast("double")) / 2.0)


def binarize(x: str | Column) -> Column:
    """1 when the value is exactly 1, otherwise 0; NULL counts as 0."""
    return F.when(_c(x) == 1, F.lit(1)).otherwise(F.lit(0))


def is_positive(x: str | Column) -> Column:
    """The positive-label predicate ``label = 1`` (P3); NULL is not positive."""
    return F.coalesce(_c(x) == 1, F.lit(False))


def class_weight(label: str | Column, w0: Column, w1: Column) -> Column:
    """Per-row class weight."""
    return F.when(_c(label) == 1, w1).otherwise(w0)


def hms(seconds: str | Column) -> Column:
    """Elapsed seconds as ``H:MM:SS`` (``N day[s], H:MM:SS`` past a day), after rounding
    half-to-even to whole seconds (F12)."""
    s = F.bround(_c(seconds), 0).cast("bigint")
    days = F.floor(s / 86400).cast("bigint")
    rest = s - days * 86400
    clock = F.format_string("%d:%02d:%02d", (rest / 3600).cast("bigint"),
                            ((rest % 3600) / 60).cast("bigint"), rest % 60)
    day_word = F.when(F.abs(days) == 1, F.lit("day")).otherwise(F.lit("days"))
    return F.when(days == 0, clock).otherwise(F.format_string("%d %s, %s", days, day_word, clock))


def word_count(text: str | Column) -> Column:
    """Word count with Python ``str.split()`` semantics: runs of any whitespace separate words,
    blank text has 0 words (F13)."""
    t = strip(text)
    return F.when(t.isNull(), F.lit(None)).when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def lcg_key(x: str | Column) -> Column:
    """Deterministic pseudo-random BIGINT in [0, 2^31) from an integer key.

    Statistically weak but computable by any SQL engine; used where an oracle must agree.
    """
    return (_c(x).cast("bigint") * F.lit(LCG_A) + F.lit(LCG_C)) % F.lit(LCG_M)


def hash_key(x: str | Column, seed: int = 42) -> Column:
    """Production-grade keyed hash (xxhash64) for splits and sampling."""
    return F.xxhash64(F.lit(seed), _c(x))


def unit_interval(key: Column) -> Column:
    """Map an ``lcg_key`` to a DOUBLE in [0, 1)."""
    return key.cast("double") / F.lit(float(LCG_M))
