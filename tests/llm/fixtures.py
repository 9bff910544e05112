"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

WORDS = {"en": "the of and ing ther ation with house river stone", "de": "der die und ung lich keit haus fluss stein schaft",
         "fr": "le la les que eux ment maison fleuve pierre tion", "es": "el los que ción mente casa río piedra ado dad"}
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, lang: str, n: int) -> str:
    own = WORDS[lang].split()
    words = ["".join(rng.choice(own) for _ in range(rng.choice((1, 1, 2)))) for _ in range(n)]
    return (" ".join(words)).capitalize() + "."


def text(rng: random.Random, lang: str, lines: int = 4, n: int = 12) -> str:
    return "\n".join(sentence(rng, lang, rng.randint(n // 2, n)) for _ in range(lines))


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    """Rows of DOC_SCHEMA: prose, then copies, near copies, shared passages and lines, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        rows.append([i, text(rng, lang, rng.randint(2, 6)), lang, f"s{i % 3}" if i % 7 else "hot"])
    passage = sentence(rng, "en", 40)
    for i in range(5, n, 9):
        rows[i][1] += "\n" + passage
    long_text = text(rng, "en", 400, 14)
    extra = [rows[3][1], rows[3][1], rows[4][1].replace("der", "das", 1), rows[8][1] + " Fin.", "  " + rows[9][1].upper(), "", None, "   \n\t ", "one two three",
             "One two\tthree", "!!! ??? 123", "a" * 3000, long_text, long_text + "\nEnd of it.", "\n".join(["same line of words"] * 6), "x y " * 40]
    for k, t in enumerate(extra):
        rows.append([n + k, t, "en" if k % 3 else None, "hot" if k % 2 else None])
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def spark_documents(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC_SCHEMA)
