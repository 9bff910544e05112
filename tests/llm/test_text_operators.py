"""Packing, language identification, quality rules, mixing, toxicity, and main text against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import DOC_SCHEMA, documents, sentence, spark_documents, text
from worthrank.llm.common import held_out
from worthrank.llm.html_text import extract, main_text
from worthrank.llm.langid import CrossParser, Transitions, identify, learn_references, suffix_automaton
from worthrank.llm.mixing import mix
from worthrank.llm.packing import OpenBins, cut, pack, pack_pieces, token_pieces
from worthrank.llm.quality import judge, signals
from worthrank.llm.queries import LLM_QUERIES, PATTERN, RANKS_PATH
from worthrank.llm.toxicity import fit, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_packing_round_trip(spark):
    rows = documents()
    found = pack_pieces(token_pieces(spark_documents(spark, rows), RANKS_PATH, PATTERN, 256), 256, open_bins=8, window=16, bucket_pieces=40).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) and (len(own) == 1 or len(ids) > 256)
        assert all(r["length"] == 256 for r in own[1:])
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r["length"] for r in found) // 256)
    assert len(sequences) <= 1.15 * least + 3


@pytest.mark.parametrize("kind", ["literal", "gap"])
def test_packed_ids_are_those_of_the_tokenizer_as_loaded(spark, tmp_path, kind):
    """By the query itself: the literal of the added token, and runs of white space that end tiktoken."""
    if kind == "literal":
        texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|", "a  <|endoftext|>\n\n c"]
    else:
        texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "a <|endoftext|>" + "\t \xa0" * 400_000 + "x <|endoftext|> y", " " * 99_999 + "x" + " " * 99_999]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = defaultdict(list)
    for r in LLM_QUERIES["op1_best_fit_packing"](spark, str(tmp_path)).collect():
        found[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert 50256 in tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        parts = [(s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + n]))) for s, n in cut(len(ids), 2048)]
        assert sorted(found[i]) == parts


def test_packing_empty_and_repeated_rows(spark):
    empty = token_pieces(spark.createDataFrame([], DOC_SCHEMA), RANKS_PATH, PATTERN)
    assert pack_pieces(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 2 + [(None, None, None, None, None)], DOC_SCHEMA).withColumn("offset", F.lit("clash"))
    assert sorted(r["length"] for r in pack_pieces(token_pieces(twice, RANKS_PATH, PATTERN)).collect()) == [1, 3, 3]


def test_best_fit_fills_the_fullest_bin_and_closes_it_first():
    state = OpenBins(10, 2)
    assert [state.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    state = OpenBins(10, 2)
    assert [state.place(n) for n in (6, 7, 8, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6)]  # bin 1 was the fullest, and closed
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)]
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(2000)]
    bins, _ = pack(lengths, 100, 1000, 500)
    load = Counter()
    for b, n in zip(bins, lengths, strict=True):
        load[b] += n
    assert max(load.values()) <= 100 and len(load) <= 1.03 * sum(lengths) / 100


def test_suffix_automaton_has_all_substrings():
    rng = random.Random(5)
    symbols = [rng.randint(0, 2) for _ in range(60)]
    table = suffix_automaton(symbols)
    have = {tuple(symbols[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 8))}
    for _ in range(500):
        word = tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 7)))
        state = 0
        for c in word:
            state = table[state].get(c, -1) if state >= 0 else -1
        assert (state >= 0) == (word in have)


@pytest.mark.parametrize("few_lanes", [0, 6, 1000])
def test_phrases_equal_greedy_parsing(few_lanes):
    rng = random.Random(6)
    references = {"de": text(rng, "de", 30).lower().replace(".", "").replace("\n", " "), "fr": text(rng, "fr", 30).lower().replace(".", "").replace("\n", " "),
                  "zh": "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(1500)), "gap": " "}
    parser = CrossParser(references, few_lanes)
    texts = [text(rng, "de"), references["fr"] + " " + text(rng, "fr", 40), "Zzz qq \u00dcbel", "x", references["zh"][100:700] + references["zh"][:90], ""]
    symbols = [parser.symbols(t)[0] for t in texts]
    counts = parser.phrases(symbols)
    for k, lang in enumerate(parser.langs):
        reference = "".join(chr(int(parser.symbol[ord(c)])) for c in references[lang])
        for row, own in enumerate(symbols):
            whole, i, expected = "".join(map(chr, own.tolist())), 0, 0
            while i < len(whole):  # the longest phrase, over the whole text
                n = 1
                while i + n < len(whole) and whole[i : i + n + 1] in reference:
                    n += 1
                i += n
                expected += 1
            assert counts[row, k] == expected, (lang, row)
    assert parser.phrases([]).shape == (0, 4)


def test_transitions_are_those_of_the_automata():
    rng = random.Random(7)
    automata = [suffix_automaton([rng.randint(0, top) for _ in range(700)]) for top in (1, 40, 400)] + [suffix_automaton([])]
    moves, first = Transitions(automata, 401), 0
    for k, own in enumerate(automata):
        assert moves.roots[k] == first
        for state, out in enumerate(own):
            for c in range(401):
                place = moves.base[first + state] + c
                found = moves.from_root[k, c] if state == 0 else moves.to[place] if moves.owner[place] == first + state else -1
                assert found == (first + out[c] if c in out else -1)
        first += len(own)
    assert len(moves.to) < 3 * sum(len(out) for own in automata for out in own)


def test_references_have_a_piece_of_every_sampled_row_with_letters(spark):
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(40)]
    rows = [(i, "12 " * 2000 + (n + " ") * 2000, "xx", "s", 1) for i, n in enumerate(names)]
    rows += [(1000 + i, None if i % 3 else "1 2 3 !", "yy", "s", 1) for i in range(3000)] + [(5000 + i, "hallo welt", "yy", "s", 1) for i in range(3)]
    found = learn_references(spark.createDataFrame(rows, DOC_SCHEMA))
    assert set(names) <= set(found["xx"].split()) and 19_000 <= len(found["xx"]) <= 20_000
    assert found["yy"] == "hallo welt hallo welt hallo welt"


def test_language_identification(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang), lang, "s", 1) for i, lang in enumerate(("en", "de", "fr", "es") * 30)] + [(900, None, "en", "s", 0), (901, "12 !!", "en", "s", 0), (902, "", None, "s", 0)]
    docs = spark_documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("ho", held_out(F.col("doc_id")))
    references = learn_references(docs.where("not ho"))
    assert set(references) == {"en", "de", "fr", "es"}
    found = identify(docs, references).collect()
    told = [r for r in found if r["doc_id"] < 900 and r["ho"]]
    assert told and sum(r["lang_pred"] == r["lang"] for r in told) >= 0.95 * len(told)
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(rows)
    assert {r["lang_pred"] for r in found if r["doc_id"] >= 900} == {"und"}
    assert {r["lang_pred"] for r in identify(docs, {}).collect()} == {"und"}
    assert learn_references(docs.limit(0)) == {}


def _signals(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    count, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
    for k in range(len(w) - 7):
        if count[tuple(w[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_signals_and_verdicts(spark):
    rng = random.Random(2)
    rows = documents() + [(500, "a b c d e f g h " * 3 + "z", "en", "s", 0), (501, "<b> *x* | y\n\n<b> *x* | y\n\x0b", "en", "s", 0)]
    rows += [(600 + i, re.sub(r" ", "### ", text(rng, "en", 6)), "en", "s", 0) for i in range(12)]
    docs = spark_documents(spark, rows).withColumn("kept", F.lit("clash"))
    for r in signals(docs).collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _signals(t), r["doc_id"]
    verdict = {r["doc_id"]: r for r in judge(docs).collect()}
    assert len(verdict) == len(rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in verdict.values())
    assert not any(r["kept"] and r["base_failed"] for r in verdict.values())
    assert not any(verdict[600 + i]["kept"] for i in range(12))
    assert all(verdict[i]["kept"] for i in range(60) if not verdict[i]["base_failed"])
    assert judge(docs.limit(0)).collect() == []


def _targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    rows = documents(120)
    docs = spark_documents(spark, rows).withColumn("size", F.lit("clash"))
    found = mix(docs, bucket_rows=16).collect()
    assert sorted(r["doc_id"] for r in found) == [r[0] for r in rows]
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    target, taken = _targets(totals), Counter()
    for r in found:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], totals[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    # fair queueing keeps within the largest document of any source: what one can't take, others may
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in totals)
    assert 1.5 * sum(totals.values()) - max(size.values()) <= sum(taken.values()) <= 1.5 * sum(totals.values())
    again = mix(docs.repartition(7), bucket_rows=1000)
    assert sorted(again.select("doc_id", "taken").collect()) == sorted((r["doc_id"], r["taken"]) for r in found)
    assert mix(docs.limit(0)).collect() == []
    blank = spark_documents(spark, [(1, None, "en", None, 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0)])
    assert [(r["size"], r["taken"]) for r in mix(blank).collect()] == [(0, 0)] * 3


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        t = text(rng, "en")
        if toxic:
            t = t.replace(" ", f" {rng.choice(('scumbag', 'vermin', 'lowlife'))} ", 2)
            if i % 8 == 0:
                t += " The women spoke."
        elif i % 11 == 0:
            t += " The women spoke."
        rows.append((i, t, "en", "s", 1))
        labels.append((i, int(toxic)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "women", "en", "s", 0), (903, "muslims", "en", "s", 0)]
    docs = spark_documents(spark, rows).withColumn("score", F.lit("clash"))
    marked = spark.createDataFrame(labels + [(0, None), (12345, 1), (4, 1)], "doc_id long, toxic int")
    model = fit(docs, marked.where(~held_out(F.col("doc_id"))))
    found = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    told = [(found[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    assert sum((s >= 0.5) == bool(t) for s, t in told) >= 0.97 * len(told)
    assert max(found[i] for i in (900, 901, 902, 903)) < 0.5
    plain = fit(docs, marked.where(~held_out(F.col("doc_id"))), pair_weight=0.0)
    gap = lambda m: abs(m.scorer()("The women spoke") - m.scorer()("The men spoke"))
    assert gap(model) <= gap(plain) + 1e-9
    assert all(s == pytest.approx(0.5) for s in (r["score"] for r in score(docs, fit(docs, marked.limit(0))).collect()))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h2>Site, with, commas, many</h2></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="sidebar widget"><p>Side, bar, text, that, is, long, enough, to, score, well, if, it, were, kept.</p></div>
<div id="cookie-notice">We use cookies, really.</div><article><h1>A &amp; B</h1><p>First, a   paragraph
with <b>bold<br>text</b> &lt;here&gt;.<p>Second <a href="x">link</a>, of it.</p><form><p>Mail, us</p></form><ul><li>One<li>Two</ul><div class="ad">Buy, now</div></article>
<section class="comments"><p>I, a reader, think, that, this, is, a, long, comment, with, commas.</p></section><footer>&copy; us, 2020</footer>"""


def test_main_text(spark):
    expected = "A & B\nFirst, a paragraph with bold text <here>.\nSecond link, of it.\nOne\nTwo"
    assert main_text(PAGE) == expected
    assert main_text("<div><div class=menu>a, b, c</div><div><p>Words, of one.</p><p>Words of two.</p></div></div>") == "Words, of one.\nWords of two."
    assert main_text("plain &eacute; text") == "plain é text"
    assert main_text("<p>open <!-- no end") == "open"
    assert main_text("<script>x") == "" and main_text("<nav>a</nav>") == ""
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (3, "v", "", "x"), (4, "w", "<p>" + "word, " * 30000 + "</p>", "x")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    texts = [(r["page_id"], r["text"]) for r in found.collect()]
    assert sorted(texts) == sorted([(1, expected), (1, expected), (2, ""), (3, ""), (4, ("word, " * 30000).strip())])
    assert extract(found.limit(0)).count() == 0


def test_main_text_of_sections_without_an_article():
    long = ("word " * 69 + "words.").strip()
    page = (f"<div id=page><div><h1>Title</h1><section>{f'<p>{long}</p>' * 30}</section><h2><a href=#s>Second</a></h2><section><p>{long}</p></section><p>Short one.</p>"
            f"<blockquote>Said so.</blockquote><pre>a = 1</pre><ul><li>One<li>Two, <a href=x>2</a></ul><section><p>Brief but text.</p><p><a href=y>Linked</a></p></section>"
            '<ul><li><a href="/">Home</a><li><a href="/b">About</a></ul>' "<div><a href=/c>Here</a> | <a href=/d>There</a></div><div class=related><p>Other</p></div></div>"
            "<div><table><tr><td>Cell</table></div></div><p>Last.<nav>Menu</nav><footer>End</footer>")
    assert main_text(page).split("\n") == ["Title", *[long] * 30, "Second", long, "Short one.", "Said so.", "a = 1", "One", "Two, 2", "Brief but text.", "Linked", "Cell", "Last."]


def test_sentences_of_fixture_are_stable():
    assert sentence(random.Random(0), "en", 3) == sentence(random.Random(0), "en", 3)
