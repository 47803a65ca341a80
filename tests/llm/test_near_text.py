"""Near copies by text: the pipeline's stage against all pairs, also with crowded keys, and on awkward rows."""

import numpy as np
import pytest

from plumbline.llm import near_text
from tests.llm.test_pair_operators import closure


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [(i, brute_shingles(t)) for i, t in rows if i is not None]
    alike = lambda a, b: not (a | b) or len(a & b) / len(a | b) >= 0.8
    return set(closure({i for i, _ in sets}, [(i, j) for i, a in sets for j, b in sets if j < i and alike(a, b)]).values())


def near_rows():
    """Texts with copies of which one to ten words in 250 are other ones: similarities around 0.8."""
    r = np.random.default_rng(5)
    word = lambda: f"w{r.integers(0, 5000)}"
    rows = []
    for base in range(12):
        words = [word() for _ in range(250)]
        rows.append(words)
        for n in range(10):
            other = list(words)
            for at in r.choice(250, n + 1, replace=False):
                other[at] = word()
            rows.append(other)
    # one chain: each text is alike only to the next ones
    words = [word() for _ in range(300)]
    rows += [words[i * 12 : i * 12 + 150] for i in range(12)]
    ids = r.permutation(len(rows)).tolist()
    return [(i, " ".join(w)) for i, w in zip(ids, rows)] + [(900, " ".join(rows[0]).upper()), (901, "one two"), (902, "One  two"), (903, "two one"), (904, None), (905, " "), (906, " ".join(rows[40])), (906, "one two")]


@pytest.mark.parametrize("part", [near_text.PART, 4])
def test_stage_drops_all_of_similarity(spark, sf, monkeypatch, part):
    import corpus_pipeline

    monkeypatch.setattr(near_text, "PART", part)
    rows = near_rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf).collect()
    assert {r.doc_id for r in kept} == brute_kept(rows) | {None}


def test_stage_on_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 400").select("doc_id", "text")
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf).collect()} == want


def test_awkward_rows(spark, awkward, empty):
    kept = near_text.drop_near_text(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 5, 6, 7} and kept.count() == 8
    assert near_text.drop_near_text(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 254, 255, 256, 700])
def test_fingerprints_are_majorities(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64))
    mixed = [[int(x) for x in row] for row in near_text._mixed(hashes)]
    ones = [sum(x >> b & 1 for x in row) for row in mixed for b in range(64)]
    got = near_text.fingerprint(hashes)
    assert len(got) == near_text.WORDS
    bits = [int(w) >> b & 1 for w in got for b in range(64)]
    assert all(2 * k == n or b == (2 * k > n) for k, b in zip(ones, bits))


def similar(r, a, b, shared, n=200):
    """Fingerprints of n pairs of sets of a and b hashes, `shared` of them in both."""
    sets = [r.integers(0, 1 << 64, a + b - shared, np.uint64) for _ in range(n)]
    return np.array([near_text.fingerprint(s[:a]) for s in sets]), np.array([near_text.fingerprint(s[a - shared :]) for s in sets])


@pytest.mark.parametrize("bits", [10, 12, 14])
@pytest.mark.parametrize(("a", "b", "shared"), [(4, 5, 4), (5, 6, 5), (9, 9, 8), (80, 100, 80), (90, 90, 80)])
def test_pairs_at_the_similarity_share_keys_and_are_near(bits, a, b, shared):
    one, other = similar(np.random.default_rng(7), a, b, shared)
    keys = [near_text.keys_of(x, np.full(len(x), size), bits) for x, size in ((one, a), (other, b))]
    assert all(len(x) in (near_text.n_keys(bits), 2 * near_text.n_keys(bits)) for x in keys[0] + keys[1])
    assert all(np.intersect1d(x, y).size for x, y in zip(*keys))
    c = near_text.COMPARED
    pairs = np.stack([one[:, :c], other[:, :c]], 1).reshape(-1, c)
    found = near_text.near_fingerprints(pairs, np.repeat(np.arange(len(one)), 2))
    assert sorted(p for i, j in found for p in zip(i.tolist(), j.tolist())) == [(2 * k, 2 * k + 1) for k in range(len(one))]


def test_unrelated_texts_of_any_length_are_not_near():
    r = np.random.default_rng(8)
    for size in (1, 2, 3, 5, 6, 7, 50, 333):
        values = similar(r, size, size, 0)[0][:, : near_text.COMPARED]
        # sets of two lean to equal bits; they have no key but a whole word
        distance = np.bitwise_count(values[1:] ^ values[:-1]).sum(axis=1, dtype=int)
        assert size == 2 or distance.min() > near_text.RADIUS
    assert [len(k) for k in near_text.keys_of(np.zeros((5, near_text.WORDS), np.uint64), np.arange(5), 10)] == [0, 1, 1, 1, 2 * near_text.n_keys(10)]


@pytest.mark.parametrize("dense", [near_text.DENSE, 20])
def test_fingerprints_reached_within_the_radius(monkeypatch, dense):
    """Groups of random fingerprints and of chains of changed ones, compared in bit planes or one against all."""
    monkeypatch.setattr(near_text, "DENSE", dense)
    r = np.random.default_rng(9)
    rows, group = [], []
    for g, size in enumerate((1, 2, 30, 7, 90)):
        now = r.integers(0, 2, 64 * near_text.COMPARED)
        for _ in range(size):
            now = now ^ (r.random(len(now)) < r.choice([0.05, 0.25, 0.35]))
            rows.append(np.packbits(now, bitorder="little").view("<u8"))
            group.append(g)
    values, group = np.array(rows), np.array(group)
    near = [(i, j) for j in range(len(rows)) for i in range(j) if group[i] == group[j] and sum((int(x) ^ int(y)).bit_count() for x, y in zip(rows[i], rows[j])) <= near_text.RADIUS]
    got = [p for i, j in near_text.near_fingerprints(values, group) for p in zip(i.tolist(), j.tolist())]
    ids = set(range(len(rows)))
    assert closure(ids, got) == closure(ids, near) and len(set(closure(ids, near).values())) > 5


def test_edges_of_a_dense_group_do_not_grow_with_its_keys(spark, monkeypatch):
    """300 near copies meet at some 90 keys each; what joins them must not be a star for each key."""
    r, found, plain = np.random.default_rng(11), [], near_text.components
    words = [f"w{x}" for x in r.integers(0, 5000, 250)]
    rows = [(i, " ".join(f"v{r.integers(0, 5000)}" if r.random() < 0.015 else w for w in words)) for i in range(300)]

    def counted(edges, tag):
        found.append(edges.selectExpr("greatest(a, b)", "least(a, b)").distinct().count())
        return plain(edges, tag)

    monkeypatch.setattr(near_text, "components", counted)
    kept = near_text.drop_near_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {k.doc_id for k in kept} == brute_kept(rows)
    # a star for each key that is compared first at most, then what those have left apart, then the texts' forest
    assert sum(found) < (near_text.n_keys(near_text.SHORTEST) / 8 + 2) * len(rows)


@pytest.mark.parametrize("others", [0, 3, 40])
def test_parts_of_a_crowded_key_meet_but_for_what_is_joined(spark, monkeypatch, others):
    """A chain through all of a key's labels is found whole, and a joined group is not dealt part by part to itself."""
    monkeypatch.setattr(near_text, "PART", 10)
    dealt, plain = [], near_text._compared
    monkeypatch.setattr(near_text, "_compared", lambda rows, *a: dealt.append(rows.count()) or plain(rows, *a))
    r, n = np.random.default_rng(12), 200
    now, rows = r.integers(0, 2, 64 * near_text.COMPARED), []
    for i in range(n + others):
        now = now ^ (r.random(len(now)) < 0.22)
        rows.append((0, i, 0 if i < n else i, near_text.PART_BYTES // 10, *np.packbits(now, bitorder="little").view("<i8").tolist()))
    compared = [f"f{i}" for i in range(near_text.COMPARED)]
    frame = spark.createDataFrame(rows, "key long, cid long, label long, w long, " + ", ".join(f"{f} long" for f in compared))
    edges = near_text._across(frame, near_text._crowded(frame, "crowded"), "cid", compared, near_text.near_fingerprints, "cut").collect()
    values = np.array([x[4:] for x in rows]).view(np.uint64)
    near = [(rows[i][2], rows[j][2]) for j in range(len(rows)) for i in range(j) if np.bitwise_count(values[i] ^ values[j]).sum(dtype=int) <= near_text.RADIUS]
    ids = {x[2] for x in rows}
    assert closure(ids, [(e.a, e.b) for e in edges]) == closure(ids, near) and (len(near) > 200 or not others)
    assert dealt == [n * -(-others // 10) + others * (20 + max(0, -(-others // 10) - 1))]


def test_a_dense_crowded_group_is_dealt_in_proportion(spark, monkeypatch):
    """Near copies that fill many parts are joined by two cuts; none of them then meets all the other parts."""
    monkeypatch.setattr(near_text, "PART", 20)
    dealt, plain = [], near_text._compared
    monkeypatch.setattr(near_text, "_compared", lambda rows, *a: dealt.append(rows.count()) or plain(rows, *a))
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[: i % 100], f"v{i}", *words[i % 100 + 1 :]])) for i in range(300)]
    kept = near_text.drop_near_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [k.doc_id for k in kept] == [0]
    # the last two dealings are of texts: each twice, then only what isn't joined
    assert dealt[-2] <= 2 * len(rows) and dealt[-1] <= len(rows)
