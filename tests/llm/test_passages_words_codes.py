"""Repeated passages, spelling variants and vector codes: brute force, SQL, awkward rows."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline.llm import queries, spelling, suffix_dedup, vector_codes
from plumbline.llm.vector_codes import compress, decoded


def brute_repeats(rows, length=suffix_dedup.LENGTH):
    met, out = collections.defaultdict(list), []
    texts = [(suffix_dedup.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    for i, (r, b) in enumerate(texts):
        for s in range(len(b) - length + 1):
            met[b[s : s + length]].append((r, i, s))
    for i, (r, b) in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if any(x < r or (j == i and p < s) for x, j, p in met[b[s : s + length]]):
                gone[s : s + length] = True
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1]))))
        out.append((rows[i][0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    base, rows = [letters(400) for _ in range(4)], []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 300)
            parts.append(rng.choice([rng.choice(base)[a : a + rng.randint(20, 400)], letters(rng.randint(0, 150)), "a" * a, "ab c" * (a // 5), rng.choice(base)[:150] * 2]))
        rows.append((rng.choice([None, i, i, i, i % 7]), "".join(parts) if rng.random() > 0.05 else None))
    return rows + rows[:5] + [(100, ""), (101, "a" * 3000), (102, "xy" * 1500)]


DIGEST = ["doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256"]


@pytest.mark.parametrize("seed,part", [(1, suffix_dedup.PART), (2, 2)])
def test_repeats(spark, monkeypatch, seed, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).select(*DIGEST).collect()), key=str) == brute_repeats(rows)


def test_runs_hold_every_window_once(monkeypatch):
    texts = [t.encode() for _, t in passages(3) if t]
    whole = suffix_dedup.runs(texts)
    for step in (100, 333, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "STEP", step)
        _, _, text, start, end = suffix_dedup.runs(texts)
        got = sorted((i, s) for i, a, b in zip(text.tolist(), start.tolist(), end.tolist()) for s in range(a, b - 99))
        assert got == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]
    # equal windows are in equal buckets
    of = {(i, s): k for k, i, a, b in zip(*(c.tolist() for c in (whole[0], *whole[2:]))) for s in range(a, b - 99)}
    buckets = collections.defaultdict(set)
    for (i, s), k in of.items():
        buckets[texts[i][s : s + 100]].add(k)
    assert all(len(k) == 1 for k in buckets.values())


def test_repeats_awkward(awkward, empty):
    found = suffix_dedup.remove_repeats(awkward)
    assert found.count() == awkward.count() and set(awkward.columns) < set(found.columns)
    short = awkward.filter("doc_id is null or doc_id <> 6")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(short).select(*DIGEST).collect()), key=str) == brute_repeats(rows)
    long_ = {r.doc_id: r.cut for r in found.collect()}[6]
    assert (long_.n_bytes, long_.n_removed, long_.n_spans, len(long_.kept)) == (60_000, 59_998, 1, 2)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeats(awkward, 40)


def brute_words(rows):
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            run = run if h % 199 else run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n, out = brute_words(rows), {}
    for a in n:
        near = [b for b in n if edits(a, b)]
        form = min(near, key=lambda b: (-n[b], b), default=None)
        form = form if form is not None and n[form] >= 5 * n[a] else None
        out[a] = (n[a], len(near), form, n.get(form))
    root = lambda w: root(out[w][2]) if out[w][2] else w
    return sorted((w, *v, root(w)) for w, v in out.items())


def spelled(seed):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abÉé") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    known += [w[:i] + rng.choice("abé") + w[i + 1 :] for w in known[:60] for i in (0, 2, len(w) - 1)]
    draw = lambda: known[min(len(known) - 1, int(rng.expovariate(1 / 90)))]
    return [(rng.choice([None, *range(30)]), " ".join(draw().upper() if rng.random() < 0.1 else draw() for _ in range(rng.randint(0, 700)))) for _ in range(50)]


@pytest.mark.parametrize("part", [spelling.PART, 40])
def test_variants(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)
    rows = [*spelled(4), (1, None), (2, "")]
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect())
    want = brute_variants(rows)
    assert got == want and any(r[3] for r in want)


def test_one_edit_and_rests():
    rng = random.Random(5)
    for _ in range(300):
        read, held = (["".join(rng.choice("ab") for _ in range(k)) for _ in range(rng.randint(1, 9))] for k in (rng.choice([3, 4]), rng.choice([3, 4])))
        want = sorted((i, j) for i, a in enumerate(read) for j, b in enumerate(held) if edits(a, b))
        assert sorted(spelling.near_rests(read, held)) == want
        assert want == sorted((i, j) for i, a in enumerate(read) for j, b in enumerate(held) if spelling.one_edit(a, b))


def test_paths_of_forms(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(7)]
    found = spelling.roots(spark.createDataFrame(rows, "word string, form string"), 5, 5**8)
    assert {r.word: r.root for r in found.collect()} == {f"w{i}": "w7" for i in range(7)}


def test_variants_awkward(awkward, empty):
    found = {r.word: r for r in spelling.variants(awkward, occurrences=2).collect()}
    assert found["little"].n == 2 and found["little"].root == "little" and spelling.variants(empty).count() == 0


def brute_codes(rows, parts=16):
    """rows: (vec_id, label, vector), sorted by id. Plain integers of Python throughout."""
    kept = [(i, lb, [int(np.floor(256 * float(x))) for x in v]) for i, lb, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in kept[:64]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, _, v in kept:
                groups[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, lb, v in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, lb, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(seed, n=150, size=32):
    rng = np.random.default_rng(seed)
    rows = [(int(i), None if i % 11 == 0 else int(i % 3), (rng.integers(-3, 4, size) / 300 + rng.standard_normal(size) * (i % 2)).astype(np.float32).tolist()) for i in rng.permutation(n)]
    return rows + rows[:9] + [(500, 1, None), (501, 1, [None] * size), (502, 1, [float("nan")] * size), (503, 1, [float("inf")] * size), (None, 2, [0.0] * size), (None, 2, [0.0] * size)]


@pytest.mark.parametrize("n", [150, 20])
def test_vector_codes(spark, tmp_path, n):
    rows = vectors(6, n)
    schema = "vec_id long, label int, embedding array<float>"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    want, digest = brute_codes(rows)
    sums = collections.Counter()
    for _, lb, _, e in want:
        sums[lb] += e
    assert sorted((tuple(r) for r in found), key=str) == sorted(((i, c, e, sums[lb], digest) for i, lb, c, e in want), key=str)


def test_codes_are_read_back(spark):
    coded, books = compress(spark.createDataFrame(vectors(7), "vec_id long, label int, embedding array<float>"))
    for r in coded.select("embedding", "error", decoded(coded["entries"], books).alias("back")).collect():
        whole, back = np.floor(256 * np.array(r.embedding, np.float64)), np.array(r.back) * 256 - 0.5
        assert np.sum((whole - back) ** 2) == pytest.approx(r.error)


def test_codes_of_awkward_vectors(spark):
    rows = [(1, 0, [1e30] * 16), (1, 0, [-1e30] * 16), (2, 0, [0.5] * 17), (3, 0, [0.5] * 32), (4, None, []), (5, 0, [0.25] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "7 as whole_", "1 as part", "2 as position", "3 as n")
    coded, books = compress(df)
    assert sorted(r.vec_id for r in coded.collect()) == [1, 1, 5] and all(r.error == 0 for r in coded.collect()) and set(df.columns) < set(coded.columns)
    none, books = compress(df.limit(0))
    assert none.count() == 0 and books == [] and set(none.columns) == set(coded.columns)


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_spelling", "op13_vector_codes"])
def test_same_as_sql(name, spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf).toPandas()
    plain = lambda f: sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
