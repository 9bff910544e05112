"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text is
parsed greedily into the longest phrases that occur in that sample; the fewer phrases it takes, scaled
to bits per symbol, the closer the text is to the language. Texts are parsed whole; those of a batch advance
together, one symbol a step in all languages, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow

#: Code points beyond this count as no letters (the last assigned letters lie below it).
CODE_LIMIT = 0x33400
NO_LANGUAGE = "und"


def learn_references(labelled: DataFrame, sample_rows: int = 160, row_chars: int = 4000,
                     reference_symbols: int = 20_000, text_col: str = "text", lang_col: str = "lang",
                     id_col: str = "doc_id") -> dict[str, str]:
    """Reference text per language from ``labelled`` rows with letters and a language.

    The model is fitted on a bounded sample: of every language the ``sample_rows`` rows with the lowest hash of the
    id, and of each a piece of its letters and gaps from a place that the hash chooses. The pieces are equally
    long, but for rows that have less, and ``reference_symbols`` together at most. The driver gets up to
    ``row_chars`` characters of a row. Languages without letters are left out."""
    rows = (labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("place"))
            .where("lang is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.pmod("place", F.lit(1_000_000))))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    # a threshold on the hash thins each language out before the exact choice of the lowest hashes
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 8.0 * sample_rows / n))])
    thinned = rows.where(F.col("h") < share[F.col("lang")] * 1_000_000)
    lowest = Window.partitionBy("lang").orderBy("h", "text")
    letters = F.trim(F.regexp_replace(F.col("text"), r"\P{L}+", " "))
    start = F.pmod(F.shiftright("place", 20), F.greatest(F.lit(1), F.length("letters") - row_chars + 1)).cast("int") + 1
    sample = (thinned.withColumn("k", F.row_number().over(lowest)).where(F.col("k") <= sample_rows)
              .withColumn("letters", letters).select("lang", "k", F.substring(F.col("letters"), start, F.lit(row_chars)).alias("text")))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append((r["k"], r["text"]))
    found = {}
    for lang, own in texts.items():
        symbols = " ".join(_equal_pieces([" ".join(_letters_only(t).split()) for _, t in sorted(own)], reference_symbols))
        if symbols.strip():
            found[lang] = symbols
    return found


def _equal_pieces(texts: list[str], most: int) -> list[str]:
    """Beginnings of the texts, equally long but for shorter texts, that joined by a gap have ``most`` symbols at most."""
    left, lengths = most + 1, [0] * len(texts)
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        lengths[i] = max(0, min(len(texts[i]), left // (len(texts) - done) - 1))
        left -= lengths[i] + 1
    return [t[:n] for t, n in zip(texts, lengths, strict=True) if n]


def _letters_only(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The automaton of all substrings: by state, the next state by symbol. State 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Transitions:
    """The transitions of several automata in three flat arrays: symbol c leads from state s to ``to[base[s] + c]``
    if ``owner[base[s] + c]`` is s, and nowhere otherwise. Rows of states are laid over each other where they leave
    gaps, so memory follows the number of transitions, not states times symbols. States are numbered through; those
    of the roots are ``roots``, and their transitions are the rows of ``from_root`` (-1: none)."""

    def __init__(self, automata: list[list[dict[int, int]]], alphabet: int):
        first = np.concatenate([[0], np.cumsum([len(a) for a in automata])]).astype(np.int32)
        self.roots = first[:-1]
        self.from_root = np.full((len(automata), alphabet), -1, np.int32)
        rows: list[tuple[int, dict[int, int], int]] = []
        for k, own in enumerate(automata):
            for c, to in own[0].items():
                self.from_root[k, c] = first[k] + to
            rows += [(int(first[k]) + state, moves, int(first[k])) for state, moves in enumerate(own) if state and moves]
        rows.sort(key=lambda r: -len(r[1]))
        taken = bytearray(3 * alphabet + sum(len(r[1]) for r in rows))
        self.base = np.full(int(first[-1]), 0, np.int32)
        slots, owners, targets = [], [], []
        at = lowest = alphabet  # so that no place is negative
        for state, moves, offset in rows:
            symbols = sorted(moves)
            if len(symbols) == 1:  # fills the gaps that longer rows left
                at = lowest = taken.find(0, lowest)
            else:
                at = taken.find(0, max(alphabet, at - alphabet))
                while at >= 0 and any(taken[at - symbols[0] + c : at - symbols[0] + c + 1] == b"\1" for c in symbols[1:]):
                    at = taken.find(0, at + 1)
            if at < 0:
                at = len(taken)
            start = at - symbols[0]
            if start + symbols[-1] >= len(taken):
                taken.extend(bytes(start + symbols[-1] + alphabet - len(taken)))
            self.base[state] = start
            for c in symbols:
                taken[start + c] = 1
                slots.append(start + c)
                owners.append(state)
                targets.append(offset + moves[c])
        self.owner, self.to = np.full(len(taken) + alphabet, -1, np.int32), np.zeros(len(taken) + alphabet, np.int32)
        self.owner[slots], self.to[slots] = owners, targets


class CrossParser:
    """Counts the phrases that each of many texts needs in each language."""

    def __init__(self, references: dict[str, str], few_lanes: int = 128):
        self.langs = sorted(references)
        self.few_lanes = few_lanes
        letters = sorted({c for r in references.values() for c in r if c != " "})
        # symbol 0: a letter that no reference has; 1: the gap between words; then the letters
        self.is_letter = np.zeros(CODE_LIMIT, bool)
        self.is_letter[[i for i in range(CODE_LIMIT) if chr(i).isalpha()]] = True
        self.symbol = np.where(self.is_letter, 0, 1).astype(np.int32)
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + 2
        own = [self.symbol[[ord(c) for c in references[lang]]].tolist() for lang in self.langs]
        self.moves = Transitions([suffix_automaton(o) for o in own], len(letters) + 2)
        self.bits = [np.log2(len(o) + 1) for o in own]

    def symbols(self, text: str) -> tuple[np.ndarray, int]:
        """The symbols of a text, runs of other characters than letters as one gap; its letter count."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.minimum(codes, CODE_LIMIT - 1)
        letters = self.is_letter[codes]
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        return self.symbol[codes[keep]], int(letters.sum())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language. All texts advance together, one symbol a step; the last and longest ones
        go on alone from where they are once few are left."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order].tolist()
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        start = (np.cumsum(lengths) - lengths)[order]
        base, owner, to, roots, width = self.moves.base, self.moves.owner, self.moves.to, self.moves.roots, len(self.langs)
        state = np.tile(roots, (len(texts), 1))
        count = np.zeros(state.shape, np.int64)
        n, step = len(texts), 0
        while True:
            while n and size[n - 1] <= step:
                n -= 1
            if n * width <= self.few_lanes:
                break
            c = flat[start[:n] + step]
            now = state[:n]
            place = base[now] + c[:, None]
            new = to[place]
            stuck = np.flatnonzero(owner[place] != now)
            if len(stuck):
                row, lang = np.divmod(stuck, width)
                root = roots[lang]
                fresh = self.moves.from_root[lang, c[row]]
                # the phrase so far ends; a symbol that the reference lacks is a phrase
                count[row, lang] += (now[row, lang] != root).astype(np.int64) + (fresh < 0)
                new[row, lang] = np.where(fresh < 0, root, fresh)
            state[:n] = new
            step += 1
        for row in range(n):
            rest = flat[start[row] + step : start[row] + size[row]].tolist()
            for lang in range(width):
                count[row, lang] += self._go_on(rest, state, row, lang)
        out = np.zeros(state.shape)
        out[order] = count + (state != roots)
        return out

    def _go_on(self, symbols: list[int], state: np.ndarray, row: int, lang: int) -> int:
        """Phrases that end in ``symbols`` from the state of a text in a language, which is moved on."""
        base, owner, to = memoryview(self.moves.base), memoryview(self.moves.owner), memoryview(self.moves.to)
        fresh, root, now, ended = memoryview(self.moves.from_root[lang]), int(self.moves.roots[lang]), int(state[row, lang]), 0
        for c in symbols:
            place = base[now] + c
            if owner[place] == now:
                now = to[place]
                continue
            ended += now != root
            now = fresh[c]
            if now < 0:
                ended += 1
                now = root
        state[row, lang] = now
        return ended


_PARSERS: dict[int, CrossParser] = {}


def _parser(references: dict[str, str]) -> CrossParser:
    """Automata are built once in each Python worker."""
    key = hash(tuple(sorted(references.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(references)
    return _PARSERS[key]


def _slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches where the text column passes multiples of ``most_bytes``; a longer text may stand alone."""
    for batch in batches:
        upto = np.cumsum(np.array(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // most_bytes)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(i, j - i)


def identify(docs: DataFrame, references: dict[str, str], text_col: str = "text", batch_bytes: int = 4_000_000) -> DataFrame:
    """Add lang_pred and score to every row of ``docs``, in place of columns of those names; the other
    columns pass unchanged.

    lang_pred is the language whose reference needs the fewest bits a symbol (phrases times the
    logarithm of the reference's length, over the text's symbols); ties go to the smaller code. A text
    that is null or has no letter, or any text when there is no reference, is ``und`` with score 0.
    score is 1 minus the ratio of the best language's bits to the second's (1 if there is only one)."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(references) if references else None
        for batch in _slices(batches, at, batch_bytes):
            langs, scores = [NO_LANGUAGE] * batch.num_rows, [0.0] * batch.num_rows
            if parser:
                rows, texts = [], []
                for i, text in enumerate(batch.column(at).to_pylist()):
                    symbols, letters = parser.symbols(text or "")
                    if letters:
                        rows.append(i)
                        texts.append(symbols)
                bits = parser.phrases(texts) * np.array(parser.bits)
                for i, own, n in zip(rows, bits, map(len, texts), strict=True):
                    best = int(own.argmin())
                    langs[i] = parser.langs[best]
                    rest = np.delete(own, best)
                    scores[i] = 1.0 - own[best] / rest.min() if len(rest) else 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[f.name for f in schema.fields])

    return map_arrow(docs, run, schema)
