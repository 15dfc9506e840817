"""SimHash, embedding classes and components against brute force, and odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvengine.llm import embedding_dedup, simhash_dedup
from cvengine.llm.components import connected_components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def lowest(ids, roots):
    best = {}
    for i, r in zip(ids, roots):
        best[r] = min(best.get(r, i), i)
    return [best[r] for r in roots]


def plain_fingerprint(text, k=4):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_simhash(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    return sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], lowest([r[0] for r in rows], union(len(rows), pairs))))


def test_simhash_equals_brute_force(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = simhash_dedup.op5_simhash_dedup(spark, sf).collect()
    assert sorted(map(tuple, got)) == expected_simhash(rows)


def test_simhash_odd_inputs(spark):
    long_text = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (2, "One"), (4, "one"), (4, "one"), (7, long_text), (8, long_text), (1, "zwölf ÄÖ x y z")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("mine")).withColumn("component_id", F.lit(0))
    got = simhash_dedup.near_duplicates(documents).collect()
    assert sorted(map(tuple, got)) == expected_simhash(rows)
    kept = simhash_dedup.keep_first(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected_simhash(rows)})
    unnamed = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (6, "a b c d e"), (None, "other words here now")], "doc_id long, text string")
    assert sorted(r.component_id or 0 for r in simhash_dedup.near_duplicates(unnamed).collect()) == [0, 6, 6, 6]
    assert simhash_dedup.keep_first(unnamed).count() == 2
    assert simhash_dedup.near_duplicates(documents.limit(0)).count() == 0


def test_fingerprint_pairs_in_hot_buckets(spark, monkeypatch):
    """All pairs at 4 bits are linked, also where many fingerprints share a half and blocks are small."""
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 16)
    order = np.random.default_rng(0)
    half = 0x1234567
    values = {half << 32 | int(x) for x in order.integers(0, 64, 60)}
    for base in order.integers(0, 2**62, 40).tolist():
        values.add(base)
        for _ in range(3):
            values.add(base ^ sum(1 << int(b) for b in order.choice(62, int(order.integers(1, 7)), replace=False)))
    values = sorted(values)
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    at = {v: i for i, v in enumerate(values)}
    pairs = [(at[r.a], at[r.b]) for r in links.collect()]
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert lowest(values, union(len(values), pairs)) == lowest(values, union(len(values), want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    odd = [(7, 7), (None, 3), (201, 200), (200, 201)]
    found = connected_components(spark.createDataFrame(chain + star + odd, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_vectors(rows, threshold=0.95):
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [i for i, (_, v) in enumerate(rows) if sound(v)]
    units = np.array([np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good]) if good else np.zeros((0, 1))
    near = units @ units.T >= threshold
    np.fill_diagonal(near, False)
    pairs = [(good[a], good[b]) for a, b in zip(*np.nonzero(near))]
    links = {g: int(n) for g, n in zip(good, near.sum(axis=1))}
    ids = [r[0] for r in rows]
    component = lowest(ids, union(len(rows), pairs))
    return sorted((i, links.get(k, 0), c, i == c) for k, (i, c) in enumerate(zip(ids, component)))


def test_embeddings_equal_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, embedding_dedup.op1_embedding_dedup(spark, sf).collect())) == expected_vectors(rows)


def test_embeddings_odd_inputs_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 32)
    order = np.random.default_rng(1)
    centre = order.standard_normal(16)
    near = [(i, (centre + 0.05 * order.standard_normal(16)).tolist()) for i in range(100, 220)]
    copies = [(i, centre.tolist()) for i in range(300, 420)]
    apart = [(i, order.standard_normal(16).tolist()) for i in range(500, 600)]
    odd = [(1, None), (2, [0.0] * 16), (3, [math.nan] + [1.0] * 15), (4, [math.inf] + [1.0] * 15), (5, [None] + [1.0] * 15), (6, []), (7, (3 * centre).tolist())]
    rows = near + copies + apart + odd
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit(9)).withColumn("label", F.lit(None).cast("int"))
    assert sorted(map(tuple, embedding_dedup.near_duplicates(table).collect())) == expected_vectors(rows)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0
    nothing = embedding_dedup.near_duplicates(spark.createDataFrame(odd[:2], table.schema[:2]))
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("few", [1000, 3])
def test_embeddings_of_several_lengths(spark, monkeypatch, few):
    """Each length is compared with itself, with tables of its own where it has many vectors."""
    monkeypatch.setattr(embedding_dedup, "FEW_ROWS", few)
    monkeypatch.setattr(embedding_dedup, "SMALL_BUCKET", 8 if few == 3 else 256)
    order = np.random.default_rng(8)
    rows = []
    for width, count in ((16, 60), (5, 40), (2, 2), (70, 30)):
        centres = order.standard_normal((count, width))
        for k in range(2 * count):
            rows.append((len(rows), (centres[k % count] + 0.03 * (k >= count) * order.standard_normal(width)).tolist()))
        rows += [(len(rows) + i, centres[0].tolist()) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()))
    want = []
    for width in (16, 5, 2, 70):
        want += expected_vectors([r for r in rows if len(r[1]) == width])
    assert got == sorted(want)


def test_tables_meet_pairs_once_and_grow_slowly():
    order = np.random.default_rng(12)
    sample = order.standard_normal((3000, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for rows in (1000, 10**6):
        tables = embedding_dedup.learn_tables(sample, rows, 0.95, 1)
        left, right = embedding_dedup.planted_pairs(sample, 0.95, 99)[0]
        a, b = tables.codes(left), tables.codes(right)
        shared = tables.keys(a) == tables.keys(b)
        firsts = np.stack([shared[:, at] & tables.first_meeting(a, b, np.full(len(a), at)) for at in range(shared.shape[1])], axis=1)
        assert (firsts.sum(axis=1) == shared.any(axis=1)).all()
        found = shared.any(axis=1) & (np.bitwise_count(a ^ b).sum(axis=1) <= tables.reach)
        assert found.mean() >= 0.99 and tables.tables <= 40


def test_pairs_around_a_common_direction(spark, monkeypatch):
    """Links of pair-sized groups are found where all vectors have a large common mean and the fitted sample holds no link."""
    monkeypatch.setattr(embedding_dedup, "FIT_ROWS", 200)
    order = np.random.default_rng(4)

    def units(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    own = units(np.c_[np.zeros(4000), order.standard_normal((4000, 31))])
    rows = math.sqrt(0.8) * np.eye(32)[0] + math.sqrt(0.2) * own
    near = order.standard_normal((100, 32))
    near = units(near - (near * rows[:100]).sum(axis=1, keepdims=True) * rows[:100])
    rows[100:200] = 0.952 * rows[:100] + math.sqrt(1 - 0.952**2) * near
    table = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(table).collect()}
    assert sum(got[100 + i] != got[i] for i in range(100)) <= 1
