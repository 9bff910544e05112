"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns, of which there are at most 3 to the power of the number of rules whatever the corpus, finds
how often each rule votes either way or abstains on good and on bad documents; a document is kept if it is
more likely good than bad given its votes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Collection, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthrank.llm.common import WORD_GAP, materialise

#: ASCII white space, for trimming and for counting what is not white space.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŒ"
WINDOW = 8


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _next(values: Column, size: Column, by: int) -> Column:
    """The array moved ``by`` places to the front; null where it ends."""
    return F.slice(values, F.lit(by + 1), F.greatest(size - by, F.lit(0)))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over whole texts, a row per row of ``docs``: doc_id, n_words, word_chars (code points in
    words), n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier one), n_repeat_words
    (words in windows of eight that occur twice or more in the text), n_distinct (different words),
    n_upper, n_shouts (exclamation marks) and n_stops (full stops, question marks). Null or empty texts
    count zero everywhere; other columns are ignored.

    Repeated windows are found in the row: hashes of eight words are combined from pairs, sorted with
    their places, and equal neighbours mark the places whose windows cover words. Only texts in which a
    hash repeats are sorted."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    base = base.select("doc_id", "t", F.btrim("t", F.lit(SPACES)).alias("s"))
    words = base.select("doc_id", "t", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", WORD_GAP)).alias("words"),
                        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    n = F.size("words")
    hashed = words.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - F.length(_without(F.col("t"), UPPER))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        (F.length("t") - F.length(_without(F.col("t"), ".?"))).cast("long").alias("n_stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    size = F.col("n_words").cast("int")
    for name, of, by in (("h2", "h1", 1), ("h4", "h2", 2), ("h8", "h4", 4)):
        hashed = hashed.withColumn(name, F.zip_with(of, _next(F.col(of), size, by), lambda a, b: F.xxhash64(a, b)))
    windows = F.greatest(size - (WINDOW - 1), F.lit(0))
    kept = [c for c in hashed.columns if not c.startswith("h")]
    placed = hashed.select(*kept, F.size(F.array_distinct("h1")).cast("long").alias("n_distinct"), F.slice("h8", F.lit(1), windows).alias("w"))
    kept.append("n_distinct")
    repeats = F.size(F.array_distinct("w")) < F.size("w")
    by_hash = placed.select(*kept, F.when(repeats, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("p"))
    m = F.size("p")
    equal = by_hash.withColumn("e", F.zip_with("p", _next(F.col("p"), m, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    starts = equal.select(*kept, F.sort_array(F.filter(
        F.zip_with("p", F.zip_with("e", F.concat(F.array(F.lit(False)), F.slice("e", F.lit(1), F.greatest(m - 1, F.lit(0)))), lambda a, b: a | b),
                   lambda p, twice: F.when(twice, p["i"])), lambda i: i.isNotNull())).alias("at"))
    covered = F.aggregate(F.zip_with("at", _next(F.col("at"), F.size("at"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                          F.lit(0), lambda total, x: total + x)
    return starts.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(good: Column | bool, bad: Column | bool) -> Column:
    """-1 if ``bad`` holds, else 1 if ``good`` holds, else 0; a condition that is null doesn't hold."""
    return F.when(F.lit(bad), -1).when(F.lit(good), 1).otherwise(0).cast("int")


#: The rules that know one defect and never vote good.
DEFECTS = ("symbols", "upper", "shouts", "word_length", "copied_lines", "repeats", "variety", "stops")


def votes() -> dict[str, Column]:
    """The rules, by name, over the columns of ``signals``.

    Most rules know one defect and abstain where they don't see it: its absence says little. Two rules
    vote both ways, on whether the characters and whether the sentences look like prose."""
    chars = F.nullif(F.col("word_chars"), F.lit(0)).cast("double")
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    lines = F.nullif(F.col("n_lines"), F.lit(0)).cast("double")
    symbols, upper, shouts = F.col("n_symbols") / chars, F.col("n_upper") / chars, F.col("n_shouts") / words
    stops, length, repeated = F.col("n_stops") / words, chars / words, F.col("n_repeat_words") / words
    copied, variety = F.col("n_dup_lines") / lines, F.when(words >= 50, F.col("n_distinct") / F.sqrt(words))
    return {
        "symbols": _vote(False, symbols > 0.05),
        "upper": _vote(False, upper > 0.3),
        "shouts": _vote(False, shouts > 0.2),
        "word_length": _vote(False, (length < 2.0) | (length > 15.0)),
        "copied_lines": _vote(False, (copied > 0.5) & (lines >= 3)),
        "repeats": _vote(False, repeated > 0.25),
        "variety": _vote(False, variety < 1.5),
        "stops": _vote(False, ((stops < 0.002) & (words >= 100)) | (stops > 0.7)),
        "characters": _vote((symbols < 0.02) & (upper < 0.12) & (shouts < 0.05) & length.between(2.5, 12.0),
                            (symbols > 0.04) | (upper > 0.25) | (shouts > 0.15)),
        "sentences": _vote(stops.between(0.01, 0.4) & (repeated < 0.2), (repeated > 0.25) | (copied > 0.6)),
    }


#: Where expectation-maximisation starts, which is also its prior, worth PRIOR_DOCS documents in each
#: class: the share of good documents, and how often a rule votes bad, abstains and votes good.
START_SHARE = 0.8
START = {"good": {-1: 0.05, 0: 0.45, 1: 0.5}, "bad": {-1: 0.4, 0: 0.45, 1: 0.15}}
#: The same of rules that never vote good. Each knows one defect of several, and most bad documents have one or two.
START_DEFECT = {"good": {-1: 0.01, 0: 0.99, 1: 0.0}, "bad": {-1: 0.15, 0: 0.85, 1: 0.0}}
PRIOR_DOCS = 20.0
CLASSES = ("good", "bad")
#: Stands for probability 0 of a vote that never came.
LEAST = 1e-300
VOTES = (-1, 0, 1)


class Accuracies(NamedTuple):
    """share: of good documents. accuracy: {rule: {class: {vote: probability}}}. objective: logarithm of likelihood times
    prior at the beginning of every round, which never falls. converged: whether the last round moved no
    probability by the tolerance."""

    share: float
    accuracy: dict[str, dict[str, dict[int, float]]]
    rounds: int
    converged: bool
    objective: list[float]


def _in_order(low: tuple[float, float], high: tuple[float, float]) -> tuple[float, float]:
    """The most likely two rates of which the second is at least the first, from (count, of how many) of either."""
    a, b = low[0] / low[1], high[0] / high[1]
    return (a, b) if a <= b else ((low[0] + high[0]) / (low[1] + high[1]),) * 2


def fit_rule(counts: dict[str, dict[int, float]], start: dict[str, dict[int, float]]) -> dict[str, dict[int, float]]:
    """The most likely vote probabilities of a rule given (expected) counts of its votes by class, under its
    prior and two conditions: bad documents get a vote for bad at least as often as good ones, and of the documents
    without one, good ones get a vote for good at least as often as bad ones."""
    of = {c: {v: counts[c][v] + PRIOR_DOCS * start[c][v] for v in VOTES} for c in CLASSES}
    total = {c: sum(of[c].values()) for c in CLASSES}
    fires_good, fires_bad = _in_order((of["good"][-1], total["good"]), (of["bad"][-1], total["bad"]))
    praise_bad, praise_good = _in_order((of["bad"][1], of["bad"][0] + of["bad"][1]), (of["good"][1], of["good"][0] + of["good"][1]))
    rates = {"good": (fires_good, praise_good), "bad": (fires_bad, praise_bad)}
    return {c: {-1: fires, 0: (1 - fires) * (1 - praise), 1: (1 - fires) * praise} for c, (fires, praise) in rates.items()}


def _log_joint(share: float, accuracy: dict, cls: str) -> Column:
    """Logarithm of the probability of a class together with the votes. The probabilities are one array literal, so every
    round runs the same compiled code."""
    rules = list(accuracy)
    table = F.array(*[F.lit(math.log(accuracy[r][cls][v] or LEAST)) for r in rules for v in VOTES])
    first = F.array(F.lit(math.log(share if cls == "good" else 1 - share)))
    return functools.reduce(lambda total, k: total + F.get(table, F.col(rules[k]) + F.lit(3 * k + 1)), range(len(rules)), F.get(first, F.lit(0)))


def learn_accuracies(voted: DataFrame, rules: Sequence[str], defects: Collection[str] = (), rounds: int = 200,
                     tolerance: float = 1e-4) -> Accuracies:
    """Expectation-maximisation over the votes: a rule votes bad, abstains or votes good at rates of its own on
    good and on bad documents, abstaining counts like any other vote, and ``fit_rule`` states what the rates must meet.

    ``voted`` has a column per rule; ``defects`` names those that never vote good. Its distinct rows, 3 to the power of the number of rules at most, are counted
    once and written to shared storage in order, so reruns agree; a round is one aggregation over them. Ends when no
    probability moves by ``tolerance``, or after ``rounds``. Without rows the starting values remain."""
    counted = voted.groupBy(*rules).agg(F.count("*").alias("__n"))
    patterns = materialise(counted.repartition(1).sortWithinPartitions(*rules), "vote-patterns")
    start = {r: START_DEFECT if r in defects else START for r in rules}
    share, accuracy = START_SHARE, start
    good, bad = F.col("__n") * F.col("__p"), F.col("__n") * (1 - F.col("__p"))
    sums = [F.sum("__n").alias("n"), F.sum(good).alias("good"), F.sum(F.col("__n") * F.col("__ll")).alias("ll")]
    sums += [F.sum(F.when(F.col(r) == v, w).otherwise(0.0)).alias(f"{r}|{v}|{c}") for r in rules for v in VOTES for c, w in (("good", good), ("bad", bad))]
    objective: list[float] = []
    for done in range(1, rounds + 1):
        joint = patterns.select("*", _log_joint(share, accuracy, "good").alias("__good"), _log_joint(share, accuracy, "bad").alias("__bad"))
        apart = F.col("__bad") - F.col("__good")
        likely = joint.select("*", (1 / (1 + F.exp(apart))).alias("__p"), (F.greatest("__good", "__bad") + F.log1p(F.exp(-F.abs(apart)))).alias("__ll"))
        row = likely.agg(*sums).first()
        if not row["n"]:
            return Accuracies(share, accuracy, 0, True, [])
        prior = START_SHARE * math.log(share) + (1 - START_SHARE) * math.log(1 - share)
        prior += sum(start[r][c][v] * math.log(accuracy[r][c][v]) for r in rules for c in CLASSES for v in VOTES if start[r][c][v])
        objective.append(row["ll"] + PRIOR_DOCS * prior)
        new_share = (row["good"] + PRIOR_DOCS * START_SHARE) / (row["n"] + PRIOR_DOCS)
        new = {r: fit_rule({c: {v: row[f"{r}|{v}|{c}"] for v in VOTES} for c in CLASSES}, start[r]) for r in rules}
        moved = max(abs(new_share - share), *(abs(new[r][c][v] - accuracy[r][c][v]) for r in rules for c in CLASSES for v in VOTES))
        share, accuracy = new_share, new
        if moved < tolerance:
            return Accuracies(share, accuracy, done, True, objective)
    return Accuracies(share, accuracy, rounds, False, objective)


def posterior(share: float, accuracy: dict) -> Column:
    """Probability that a document is good, given the columns of its votes."""
    return 1 / (1 + F.exp(_log_joint(share, accuracy, "bad") - _log_joint(share, accuracy, "good")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of ``signals`` with base_failed, a column per rule, quality (the posterior), kept, and em_rounds
    and em_converged, which say how learning ended and are the same in all rows.

    base_failed: fewer than 20 words, or more than 30 of 100 words in repeated windows. Documents that fail
    take no part in learning the accuracies and are never kept; so a null or empty text is not kept.
    Signals are computed once and written to shared storage, as learning and judging both read them."""
    rows = signals(docs, id_col, text_col)
    rules = votes()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = materialise(rows.select("*", failed.alias("base_failed"), *[c.alias(f"vote_{r}") for r, c in rules.items()]), "votes")
    names = [f"vote_{r}" for r in rules]
    learned = learn_accuracies(voted.where(~F.col("base_failed")), names, [f"vote_{r}" for r in DEFECTS])
    return (voted.withColumn("quality", posterior(learned.share, learned.accuracy))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
            .withColumns({"em_rounds": F.lit(learned.rounds), "em_converged": F.lit(learned.converged)}))
