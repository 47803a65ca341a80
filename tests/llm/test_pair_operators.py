"""SimHash, embeddings, components and the pipeline: brute force on small tables, awkward rows, whole results."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, simhash
from plumbline.llm.common import Labels, components


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + int(a), 100 + int(b)) for a, b in r.integers(0, 80, (60, 2))] + [(500, i) for i in range(501, 540)]
    frame = spark.createDataFrame(edges, "a long, b long")
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = components(frame, "test")
    assert {r.node: r.component for r in got.collect()} == closure(nodes, edges) and got.count() == len(nodes)
    assert components(frame.limit(0), "test").count() == 0


def test_labels():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (60, 40), (300, 280)):
        labels, edges = Labels(n), []
        for _ in range(3):
            i, j = r.integers(0, n, m), r.integers(0, n, m)
            labels.join(i, j)
            edges += zip(i.tolist(), j.tolist())
        assert dict(enumerate(labels.label.tolist())) == closure(range(n), edges)
        a, b = labels.stars()
        assert dict(zip(a.tolist(), b.tolist())) == {x: y for x, y in closure(range(n), edges).items() if x != y}


def test_written_tables_go_when_asked(spark, tmp_path):
    from plumbline.llm import common

    frame = common.written(spark.range(5).toDF("x"), "test")
    assert frame.count() == 5 and common.application_dir(spark) in frame.inputFiles()[0].replace("file://", "")
    common.remove_written(spark)
    with pytest.raises(Exception, match="does not exist|NOT_EXIST"):
        frame.count()


def brute_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    some = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "one two three", "One TWO three four", "a b c d e f a b c d e f É é", "x\x0by\x0cz\x1cw   v u", "w " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 3, 4, 9])
@pytest.mark.parametrize("n", [1, 2, 65, 300])
def test_bit_sliced_comparison(n, radius):
    r = np.random.default_rng(n + radius)
    values = r.integers(0, 2**64, max(1, n // 5), dtype=np.uint64)[r.integers(0, max(1, n // 5), n)]
    for i in range(n):
        for b in r.integers(0, 64, r.integers(0, 9)):
            values[i] ^= np.uint64(1 << int(b))
    group = np.sort(r.integers(0, max(1, n // 40), n))
    got = {p for i, j in simhash.near_pairs(values, group, radius) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= radius}
    assert got == want


def check_groups(frame, rows):
    fingerprints = [brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    edges = [(ids[i], ids[j]) for i in range(len(rows)) for j in range(i) if ids[i] is not None and ids[j] is not None and (fingerprints[i] ^ fingerprints[j]).bit_count() <= 4]
    want = closure({i for i in ids if i is not None}, edges)
    got = sorted((r.fingerprint, str(r.doc_id), str(r.component_id)) for r in simhash.group_near(frame).collect())
    assert got == sorted((f"{f:016x}", str(i), str(want.get(i))) for f, i in zip(fingerprints, ids))


def test_groups(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 400").collect()]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    # values with more fingerprints than a part are compared part by part
    monkeypatch.setattr(simhash, "PART", 7)
    monkeypatch.setattr(simhash, "LANES", 64)
    base = " ".join(f"w{i}" for i in range(300)).split()
    near = [(1000 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(40)]
    more = [(7, rows[0][1]), (2000, rows[-1][1])]  # a doc_id with two texts joins what they join
    rows = rows[:60] + near + more
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    # more blocks, and choices of several, find the same groups
    monkeypatch.setattr(simhash, "choose_blocks", lambda n, radius: radius + 3)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.choose_blocks(n, 4) for n in (0, 1000, 250_000, 14_000_000, 50_000_000_000)] == [5, 5, 5, 6, 8]
    assert [embedding_dedup.choose_grid(n) for n in (0, 5000, 10**4, 10**6, 10**8, 10**12)] == [0, 0, 1, 2, 4, 4]
    assert embedding_dedup.half_steps(1) == [[0], [1]] and len(embedding_dedup.half_steps(2)) == 5


def test_awkward_groups(awkward, empty):
    got = simhash.group_near(awkward).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and all(r.component_id is None for r in got if r.doc_id is None)
    kept = simhash.drop_near(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "5", "6", "7", "None", "None"]
    assert simhash.group_near(empty).count() == 0 and simhash.drop_near(empty).count() == 0


def brute_links(rows):
    n, edges = [0] * len(rows), []
    unit = []
    for vec_id, label, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        ok = vec_id is not None and label is not None and x is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0
        unit.append(x / np.linalg.norm(x) if ok else None)
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b >= 0.93:
                n[i] += 1
                n[j] += 1
                edges.append((rows[i][0], rows[j][0]))
    return n, closure({r[0] for r in rows if r[0] is not None}, edges)


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 64))
    rows = [(i, int(i % 3), (centres[i % 12] + r.standard_normal(64) * r.choice([0.1, 0.25, 0.3])).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300 + i, 0, rows[3][2]) for i in range(9)] + [(310, 1, rows[3][2]), (311, None, rows[3][2]), (312, 0, None), (313, 0, [0.0] * 64), (314, 0, [float("nan")] * 64)]
    rows += [(315, 0, [float("inf")] + [0.0] * 63), (316, 0, [None] + [1.0] * 63), (317, 0, []), (318, 0, [1.0, 2.0]), (319, 0, [2.0, 4.0]), (320, 0, [-1.0, -2.0]), (None, 0, rows[3][2]), (321, 0, [3.0]), (322, 0, [5.0])]
    rows += [(323, 0, (np.array(rows[3][2]) * 2).tolist())]
    # ids on several rows: of other labels, of the same vector, of a vector that links with nothing
    rows += [(330, 0, rows[4][2]), (330, 1, rows[5][2]), (330, 1, rows[5][2]), (7, 2, rows[0][2]), (9, None, rows[0][2]), (9, 0, None)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("component", F.lit(1))
    links, parts = brute_links(rows)
    want = sorted((str(i), n, str(parts.get(i)), i == parts.get(i)) for (i, *_), n in zip(rows, links))
    for part, grid in ((embedding_dedup.PART, None), (11, 1), (11, 0), (embedding_dedup.PART, 3), (40, 2)):
        monkeypatch.setattr(embedding_dedup, "PART", part)
        got = embedding_dedup.link_near(frame, grid=grid).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want, (part, grid)
    doubles = frame.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.link_near(doubles).collect()) == want
    assert embedding_dedup.link_near(frame.limit(0)).count() == 0


def brute_shingles(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_pipeline_stages(spark, sf, awkward, empty, tmp_path):
    """Each stage against its brute-force version, on documents that hold a case for each."""
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_hits, brute_secrets, packed_well  # noqa: F401

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 300")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = stages["toxicity"](spark, docs, sf)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert sum(labels.get(i) == 0 and i not in left for i in range(300)) == 0 and any(labels.get(i) == 1 and i not in left for i in range(300))
    sets = {r.doc_id: brute_shingles(r.text) for r in kept.collect()}
    want = closure(set(sets), [(a, b) for a in sets for b in sets if b < a and alike(sets[a], sets[b])])
    one = stages["simhash"](spark, kept, sf)
    assert {r.doc_id for r in one.collect()} == set(want.values())
    clean = stages["decontamination"](spark, one, sf)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not brute_hits(r.text, items)[-1]}
    safe = stages["secrets"](spark, clean, sf)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert not brute_secrets(r.text) and (r.text == before[r.doc_id]) == (not brute_secrets(before[r.doc_id])) and r.n_chars == len(r.text)
    for stage in ("toxicity", "simhash", "decontamination", "secrets"):
        for frame in (awkward, empty):
            assert stages[stage](spark, frame, sf).columns == frame.columns
    pieces = stages["packing"](spark, safe, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in safe.collect()} and stages["packing"](spark, empty, sf).count() == 0


def test_whole_pipeline(spark, sf, tmp_path):
    """`run` over tables with null and repeated labels, ids and texts."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    more = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, "token = 'abcdef123456'", "en", "s", 1), (901, "token = 'abcdef123456'", "en", "s", 1)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    gaps = spark.createDataFrame([(None, None, 1), (3, 1, None), (3, 0, 1), (3, 1, 0), (900, None, None)], labels.schema)
    labels.unionByName(gaps).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept.collect()} and {None, 900, 901} <= {p.doc_id for p in pieces}
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert all(sum(p.length for p in some) >= some[0].doc_tokens for some in by_doc.values())
