"""Nearest neighbours, Jaccard join, passage and line removal, and the pipeline against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOC_SCHEMA, documents, sentence, spark_documents, text
from worthrank.llm.ann import build_index, search
from worthrank.llm.jaccard_join import band_parts, bands, components, link_documents
from worthrank.llm.line_dedup import dedup_lines
from worthrank.llm.queries import LLM_QUERIES, LLM_SQL
from worthrank.llm.shingles import packed6, unpacked6
from worthrank.llm.substring_dedup import dedup_passages

SF = "/root/testdata/sf0.001"


def _near(rows, ids, query, k):
    scores = sorted(((-float(np.dot(v, rows[query])), i) for i, v in rows.items() if i != query))
    return [i for _, i in scores[:k]]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.standard_normal(24).astype(np.float32).astype(float) for i in range(400)}
    for i in range(40, 80):
        rows[i] = rows[40]  # copies: ties go to smaller ids
    bad = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [None] + [1.0] * 23), (1080, [float("inf")] + [1.0] * 23), (1100, [])]
    data = [(i, v.tolist(), "x") for i, v in rows.items()] + [(i, v, "x") for i, v in bad]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    index, centre = build_index(vectors, k=10)
    found = search(index, centre, vectors.where("vec_id % 20 = 0"), k=10, block_rows=64, block_queries=8).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == set(range(0, 400, 20))
    hits = 0
    for q, own in by_query.items():
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(float(np.dot(rows[q], rows[r["vec_id"]])), abs=1e-12) and r["vec_id"] != q for r in own)
        hits += len(set(_near(rows, None, q, 10)) & {r["vec_id"] for r in own})
    assert hits >= 0.97 * 10 * len(by_query)
    assert [r["vec_id"] for r in by_query[40]][:9] == list(range(41, 50))


def test_nearest_neighbours_of_few_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    index, centre = build_index(vectors, k=20)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(index, centre, vectors.where("vec_id % 20 = 0")).collect())
    assert found == [(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)]
    index, centre = build_index(vectors.limit(0))
    assert search(index, centre, vectors).collect() == []


def test_nearest_neighbours_leave_out_vectors_of_another_length(spark):
    data = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [5.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index, centre = build_index(vectors, k=20)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(index, centre, vectors.where("vec_id % 20 = 0")).collect())
    assert found == [(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)]


def _sets(rows):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(fold).split()
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


def _components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def _near_copies(rng, base, n, edits, first):
    words = base.split()
    rows = []
    for k in range(n):
        own = list(words)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(own), "en", "s", 1))
    return rows


@pytest.mark.parametrize("small_group", [1, 8])
def test_jaccard_join_finds_every_link(spark, small_group):
    """Also with groups so small that nearly all links must come from representatives and open groups."""
    rng = random.Random(9)
    rows = documents()
    rows += _near_copies(rng, text(rng, "en", 8), 40, 2, 200)  # similarities on both sides of the limit
    rows += _near_copies(rng, text(rng, "de", 3), 30, 1, 300) + _near_copies(rng, text(rng, "fr", 30), 20, 9, 400)
    rows += [(600 + k, text(rng, "es", 2) + " " + rows[0][1], "es", "s", 1) for k in range(20)]
    sets = _sets(rows)
    root = _components(sets)
    docs = spark_documents(spark, rows).repartition(5).withColumn("n", F.lit("clash"))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_documents(docs, bucket_keys=2000, small_group=small_group).collect()}
    assert found == {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("bucket_keys", [1_500_000, 1000])
def test_jaccard_join_links_across_slices_past_the_representatives(spark, bucket_keys):
    """All words that the two linked documents share are the template's, frequent in one slice and rare in the other."""
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    template = own(84)
    rows = [(i, f"{template} {own(40)}", "en", "s", 1) for i in range(120)]  # too unlike one another for a link
    here, there = [(500, f"{template} {own(6)}", "en", "s", 1)], [(700, f"{template} {own(6)}", "en", "s", 1)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([rows + here, there], 2).flatMap(lambda part: part), DOC_SCHEMA)
    sets = _sets(rows + here + there)
    root = _components(sets)
    assert root[700] == 500 and len(set(root.values())) == 121
    found = {r["doc_id"]: r["component_id"] for r in link_documents(docs, bucket_keys=bucket_keys).collect()}
    assert found == root


def test_jaccard_join_of_copies_and_shared_ids(spark):
    rng = random.Random(29)
    base = sentence(rng, "en", 120)
    rows = [(i, base, "en", "s", 1) for i in range(100, 140)] + _near_copies(rng, base, 30, 2, 200)
    rows += [(7, sentence(rng, "en", 40), "en", "s", 1), (7, base, "en", "s", 1), (9, sentence(rng, "en", 50), "en", "s", 1)]
    sets = _sets([r for r in rows if r[0] != 7] + [rows[-2]])  # of rows that share an id the largest set counts
    docs = spark_documents(spark, rows).repartition(6)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in link_documents(docs, bucket_keys=100, small_group=4).collect()}
    assert found == {(i, len(sets[i]), c) for i, c in _components(sets).items()}


def test_jaccard_join_of_odd_tables(spark):
    assert link_documents(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (8, None, "en", "s", 1), (9, "A B\tC d  e f", "en", "s", 1)]
    found = sorted(tuple(r) for r in link_documents(spark_documents(spark, rows)).where("doc_id is not null").collect())
    assert found == [(7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 2, 7)]


def test_parts_exceed_differences_and_bands_meet():
    for size in range(1, 400):
        for other in range(size, 400):
            if 4 * size >= 3 * other:
                shared = {b[:2]: b[2] for b in bands(size)}.keys() & {b[:2]: b[2] for b in bands(other)}.keys()
                assert shared and all(p > (size + other) // 7 for _, p in shared), (size, other)
    assert band_parts(512, 292) > 292


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(50, k) for k in range(51, 70)] + [(100, 100), (70, 69)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 21)} | {i: 50 for i in range(50, 71)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_packed_numbers_round_trip():
    keys = np.array([0, 1, 2**48 - 1, 12345678901], np.uint64)
    assert unpacked6(packed6(keys)).tolist() == keys.tolist()


def _passages(rows, window=13):
    first, out = {}, {}
    rows = [r for r in rows if r[0] is not None]
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def test_passage_removal(spark):
    rng = random.Random(12)
    rows = documents()
    shared = [text(rng, "fr", 3) for _ in range(4)]
    for k in range(30):  # passages at shifted places, also shorter ones than a window
        words = shared[k % 4].split()
        at = rng.randrange(5)
        rows.append((100 + k, text(rng, "de", 1) + " " + " ".join(words[at : at + rng.randint(10, 18)]) + " " + text(rng, "es", 1), "de", "s", 1))
    docs = spark_documents(spark, rows).repartition(5).withColumn("n_words", F.lit("clash"))
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_passages(docs, bucket_keys=500).collect()}
    assert found == _passages(rows) and any(x[1] for x in found.values())


def test_passage_removal_over_many_buckets(spark):
    rng = random.Random(23)
    rows = [(i * 5 - 40, sentence(rng, "en", rng.randrange(5, 60)), "en", "s", 1) for i in range(60)]
    passage = sentence(rng, "en", 30)
    rows += [(1000 + i, f"{sentence(rng, "en", i % 9)} {passage} {sentence(rng, "en", 7)}", "en", "s", 1) for i in range(40)]
    docs = spark_documents(spark, rows).repartition(5)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_passages(docs, bucket_keys=100, bucket_bytes=700).collect()}
    assert found == _passages(rows) and any(x[1] for x in found.values())


def test_passage_removal_of_odd_tables(spark):
    assert dedup_passages(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    t = " ".join(f"w{k}" for k in range(20))
    rows = [(None, t, "en", "s", 1), (5, t, "en", "s", 1), (5, t, "en", "s", 1), (6, t + " tail", "en", "s", 1), (7, None, "en", "s", 1)]
    found = sorted(dedup_passages(spark_documents(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed", "kept_text").collect())
    assert [tuple(r) for r in found] == [(-1, 20, 0, t), (5, 20, 0, t), (5, 20, 0, t), (6, 21, 20, "tail"), (7, 0, 0, "")]
    with pytest.raises(ValueError):
        dedup_passages(spark_documents(spark, rows), window=12)


def _lines(rows):
    spaces, fold = " \t\n\x0b\x0c\r", str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    key = lambda x: x.strip(spaces).translate(fold)
    first = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) >= i]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(spark, batches):
    rng = random.Random(13)
    rows = documents()
    line = "Répété ligne commune"
    rows += [(100 + k, text(rng, "fr", 2) + f"\n  {line.upper() if k % 2 else line}\t\n" + "ÀÉÎ ÕÜß ça\nshort", "fr", "s", 1) for k in range(25)]
    rows += [(None, line, "fr", "s", 1), (130, line, "fr", "s", 1), (130, line + "\n" + line, "fr", "s", 1)]
    docs = spark_documents(spark, rows).repartition(5).withColumn("lost", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    found = dedup_lines(docs, batches=batches, fan_out=2, bucket_keys=50).select(F.coalesce("doc_id", F.lit(-1)), "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(tuple(r) for r in found) == _lines(rows)


def test_line_dedup_of_an_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in LLM_SQL.items():
        rel = con.execute(sql)
        columns = [d[0] for d in rel.description]
        expected = sorted(map(repr, rel.fetchall()))
        assert sorted(repr(tuple(r)) for r in LLM_QUERIES[name](spark, SF).select(*columns).collect()) == expected, name


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(21)
    rows = [(i, text(rng, "en", 5), "en", f"s{i % 2}", 1) for i in range(80)]
    rows += [(200 + i, text(rng, "en", 3).replace(" ", " scumbag vermin ", 3), "en", "s0", 1) for i in range(40)]
    rows += _near_copies(rng, rows[0][1].replace("\n", " "), 6, 1, 300) + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    docs = spark_documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int("scumbag" in (r[1] or ""))) for r in rows[:120]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "source_mixing", "packing"]
    at = docs
    for name, stage in p.STAGES:
        before = at
        at = stage(spark, before, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns and dict(at.dtypes) == dict(docs.dtypes)
        got = sorted((tuple(r) for r in at.collect()), key=repr)
        if name == "toxicity":
            assert {r[0] for r in got} == {r[0] for r in rows if "scumbag" not in (r[1] or "")}
            at = spark_documents(spark, got)
        elif name == "line_dedup":
            expected = _lines([tuple(r) for r in before.collect()])
            assert sorted((r[0], r[1] or "") for r in got) == [(i, t) for i, _, _, t in expected]
            at = spark_documents(spark, got)
        elif name == "near_duplicates":
            root = _components(_sets([tuple(r) for r in before.collect()]))
            assert {r[0] for r in got} == {i for i, x in root.items() if i == x}
            at = spark_documents(spark, got)
        elif name == "source_mixing":
            words = sum(len((r[1] or "").split()) for r in got)
            total = sum(len((r["text"] or "").split()) for r in before.collect())
            assert 1.4 * total <= words <= 1.5 * total
            at = spark_documents(spark, got)
    assert p.run(spark, str(tmp_path)).count() >= 1
