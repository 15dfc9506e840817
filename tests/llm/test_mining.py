"""The language model, collocations and hard negatives against brute force, and odd inputs."""

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvengine.llm import collocations, hard_negatives, hidden_markov
from cvengine.llm.common import held_out

# ---- language model ----


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def is_held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def base_scores(rows):
    counts = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    total = math.log10(n + 0.5 * (v + 1))
    return n, [(i, is_held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(math.log10(counts[t] + 0.5) - total for t in tokens(x))) for i, x in rows]


@pytest.fixture(scope="module")
def modelled(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return rows, hidden_markov.op11_hidden_markov(spark, sf).collect()


def test_counts_and_base_score(modelled):
    rows, got = modelled
    n, want = base_scores(rows)
    assert {r.train_tokens for r in got} == {n} and len(got) == len(rows)
    found = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got)
    for a, b in zip(found, sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_model_beats_single_words(modelled):
    held = [r for r in modelled[1] if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in modelled[1])


def plain_model(sequences, emit, start, move):
    """Likelihood and expected counts by the textbook recursions, one sequence at a time."""
    states = len(start)
    words, moves, starts, scores = np.zeros_like(emit), np.zeros((states, states)), np.zeros(states), []
    for s in sequences:
        alpha = [start * emit[s[0]]]
        for w in s[1:]:
            alpha.append(alpha[-1] @ move * emit[w])
        beta = [np.ones(states)]
        for w in s[:0:-1]:
            beta.append(move @ (emit[w] * beta[-1]))
        beta.reverse()
        p = alpha[-1].sum()
        scores.append(math.log(p))
        for t, w in enumerate(s):
            words[w] += alpha[t] * beta[t] / p
            if t + 1 < len(s):
                moves += alpha[t][:, None] * move * emit[s[t + 1]] * beta[t + 1] / p
        starts += alpha[0] * beta[0] / p
    return scores, words, moves, starts


@pytest.mark.parametrize("strip", [1, 7, 1000])
def test_passes_equal_the_textbook(monkeypatch, strip):
    monkeypatch.setattr(hidden_markov, "STRIP_TOKENS", strip)
    order = np.random.default_rng(2)
    sequences = [order.integers(0, 9, n) for n in (1, 4, 4, 11, 2, 1, 6)]
    emit = order.dirichlet(np.ones(9), 3).T
    model = hidden_markov.blank(3)
    model.start, model.move = order.dirichlet(np.ones(3)), order.dirichlet(np.ones(3), 3)
    sizes = np.array([s.size for s in sequences])
    got = hidden_markov.passes(np.concatenate(sequences), sizes, emit, model, True)
    for a, b in zip(got, plain_model(sequences, emit, model.start, model.move)):
        assert np.allclose(a, b)


def test_model_is_a_distribution_over_words():
    order = np.random.default_rng(3)
    counts, own = np.array([7, 9, 5, 1, 2, 1]), np.array([1, 1, 1, 0, 0, 0], bool)
    model = hidden_markov.blank(4)
    model.rare = order.dirichlet(np.ones(4), hidden_markov.OWN - 1)
    shares = hidden_markov._shares(order.random((3, 4)) * counts[:3, None], counts[:3], model.occupied)
    few = np.array([2, 1, 0, 0]) * np.arange(1, hidden_markov.OWN)
    model.mass = (counts[:3, None] * shares.astype(float)).sum(axis=0) + few @ model.rare
    model.unseen = np.array([0.1, 0.2, 0.3, 0.05])
    emit = model.emissions(counts, own, shares)
    assert np.allclose(emit.sum(axis=0) + model.unseen, 1)
    assert np.allclose(model.emissions(np.zeros(1, int), np.zeros(1, bool), np.zeros((0, 4)))[0], model.unseen)


def test_more_rounds_fit_better(spark, monkeypatch):
    """Blocks and shards of a few words; each pass over all documents raises the likelihood of the training ones."""
    monkeypatch.setattr(hidden_markov, "BLOCK_TOKENS", 300)
    monkeypatch.setattr("cvengine.llm.shards.SHARD_ENTRIES", 50)
    order = np.random.default_rng(6)
    worlds = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = [(i, " ".join(order.choice(worlds[i % 3], 20))) for i in range(150)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    totals = []
    for rounds in (1, 3):
        got = hidden_markov.score_texts(documents, F.lit(False), states=3, rounds=rounds).collect()
        totals.append(sum(r.score for r in got))
    assert totals[1] >= totals[0] - 1e-6
    assert totals[1] > sum(r.base_score for r in got) * 0.8  # three worlds: log10(3) less a word


def test_start_learns_from_every_document(spark, monkeypatch):
    """Baum-Welch starts from the neighbours of all training tokens: of long documents too, and of none that are held out."""
    monkeypatch.setattr(hidden_markov, "START_WORDS", 40)
    order = np.random.default_rng(8)
    worlds = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = [(i, " ".join(order.choice(worlds[i % 3], 2000))) for i in range(9)] + [(100, "x y")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(hidden_markov, "started", lambda n, *a, f=hidden_markov.started: seen.append(n) or f(n, *a))
    got = hidden_markov.score_texts(documents, F.col("doc_id") == 100, states=3).collect()
    assert seen[0].sum() == 9 * 2001 and seen[0][-1].sum() == 9
    taught = [r for r in got if r.doc_id < 100]
    assert sum(r.score for r in taught) > sum(r.base_score for r in taught) * 0.8


def test_shares_are_kept_once_a_word(spark, monkeypatch, tmp_path):
    """What a pass learns is staged once a word, however many blocks have it; shuffle files of a pass go with it."""
    monkeypatch.setattr(hidden_markov, "BLOCK_TOKENS", 60)
    monkeypatch.setattr("cvengine.llm.shards.SHARD_ENTRIES", 200)
    for module in ("cvengine.session", "cvengine.llm.common"):
        monkeypatch.setattr(f"{module}.new_path", lambda _, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, was = [], spark.conf.get(cleanup)
    monkeypatch.setattr(hidden_markov, "summed", lambda *a, f=hidden_markov.summed: seen.append(spark.conf.get(cleanup)) or f(*a))
    rows = [(i, " ".join(f"w{k}" for k in range(19))) for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = hidden_markov.score_texts(documents, F.lit(False), states=3).collect()
    assert {r.n_tokens for r in got} == {20} and len(got) == 60
    folders = [p for p in tmp_path.iterdir() if p.name.startswith("word-shares")]
    assert len(folders) == hidden_markov.ROUNDS
    for folder in folders:
        learned = spark.read.parquet(str(folder)).where("shares is not null").collect()
        # 20 blocks, each with all 20 words
        assert len(learned) == len({r["shard"] for r in learned}) > 1
        assert sum(r["size"] for r in learned) == 20
    assert set(seen) == {"true"} and spark.conf.get(cleanup) == was


def test_language_model_odd_inputs(spark):
    long_text = "word " * 70_000
    rows = [(None, "a b"), (10**17, None), (2, ""), (2, ""), (3, " \t\n"), (4, "A a Ä ä"), (5, long_text), (6, "a\x85b a\x1fb")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = hidden_markov.score_texts(documents, held_out("doc_id", 5, 1)).collect()
    n, want = base_scores(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    for a, b in zip(found, sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score <= 0 and r.train_tokens == n for r in got)
    assert hidden_markov.score_texts(documents.limit(0), F.lit(False)).count() == 0
    unlearned = hidden_markov.score_texts(documents, F.lit(True)).collect()
    assert {(abs(round(r.score, 9)), r.base_score, r.train_tokens, r.n_known) for r in unlearned} == {(0.0, 0.0, 0, 0)}


# ---- collocations ----


def pieces(text):
    out, piece, word = [], [], ""
    for c in "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "") + "\n":
        if c in ".,;:!?\n\x0b\x0c\r \t":
            if word:
                piece.append(word)
            word = ""
            if c not in " \t":
                out.append(piece)
                piece = []
        else:
            word += c
    return out


def plain_phrases(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in pieces(text):
            n[lang or "und"] += len(piece)
            for m in (1, 2, 3, 4):
                f.update((lang or "und", tuple(piece[i : i + m])) for i in range(len(piece) - m + 1))
    often = {k: c for k, c in f.items() if c >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        covered = any(
            (g == lang and len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))) for (g, q), c in often.items()
        )
        if not covered:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    result = []
    for lang, found in out.items():
        for r, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.append((lang, r, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


TEXTS = [
    ("en", "New York City is big. new york, city\tNEW YORK city! Ä ä new york\x0bcity " * 9),
    ("en", "a a a a a a a b; " * 12),
    (None, "x y " * 40),
    ("und", "x y z. " * 31),
    ("en", None),
    ("fr", ""),
    ("de", "wort " * 20_000),
    ("de", "so\xa0ist es \xff ja " * 35),
    ("en", "New York City is big. new york, city\tNEW YORK city! Ä ä new york\x0bcity " * 9),
]


@pytest.mark.parametrize("block, shard", [(1 << 21, 500_000), (40, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr("cvengine.llm.shards.SHARD_ENTRIES", shard)
    documents = spark.createDataFrame(TEXTS, "lang string, text string").withColumn("n", F.lit("x")).withColumn("f", F.lit(1)).repartition(3)
    got = collocations.ranked(collocations.collocations(documents)).collect()
    assert sorted(map(tuple, got)) == plain_phrases(TEXTS)
    assert collocations.ranked(collocations.collocations(documents), top=3).count() == sum(r[1] <= 3 for r in plain_phrases(TEXTS))


def test_collocations_of_nothing(spark):
    documents = spark.createDataFrame([("en", "only once here"), ("fr", None)], "lang string, text string")
    assert collocations.ranked(collocations.collocations(documents)).count() == 0
    assert collocations.ranked(collocations.collocations(documents.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_extensions_count_all_phrases(seed):
    """Intervals extended to the left and to the right hold as many suffixes as the phrase occurs."""
    order = np.random.default_rng(seed)
    text = np.r_[np.zeros(4, np.int32), order.integers(0, 4, 300).astype(np.int32)]
    index, mirror = collocations.Index(text, 4), collocations.Index(text[::-1].copy(), 4)
    want = {m: Counter(tuple(text[i : i + m]) for i in range(text.size - m + 1) if text[i : i + m].all()) for m in (1, 2, 3, 4)}
    found = collocations.single_words(text, 4)
    for side in ("left", "right", "left"):
        found = found.extended(*((index, 4, True) if side == "left" else (mirror, 4, False)))
        got = {tuple(map(int, w)): int(n) for w, n in zip(found.words, found.size)}
        assert got == want[found.words.shape[1]]
    for first, then in ((True, False), (False, True)):
        both = collocations.single_words(text, 4)
        for left in (first, then, then):
            both = both.extended(index if left else mirror, 4, left)
        assert {tuple(map(int, w)): int(n) for w, n in zip(both.words, both.size)} == want[4]


# ---- hard negatives ----


def plain_negatives(rows, anchors, top=5):
    good = [(n, i, g, [math.floor(256 * float(x)) for x in v]) for n, (i, g, v) in enumerate(rows) if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, g, v in good:
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, h == g) for m, j, h, w in good if m != n and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2])[:top]:
            fits = sorted(s for s in scored if not s[2] and 80 * p >= 100 * s[0] >= 100 * p)[:top]
            out += [(i, j, r, k, -p, -q) for r, (q, k, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors_of(order, n, width=12, labels=4):
    centres = order.standard_normal((labels, width))
    return [(i, int(order.integers(labels)), (centres[i % labels] + order.standard_normal(width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block, sample", [(16_384, 4096), (40, 30)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, sample):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", sample)
    order = np.random.default_rng(9)
    rows = vectors_of(order, 300)
    hot = [float(x) for x in order.standard_normal(12)]
    rows += [(1000 + i, 1, hot) for i in range(60)] + [(2000 + i, 2, [0.9 * x for x in hot]) for i in range(60)]
    rows += [(10, 1, hot), (10, 1, hot), (None, 1, hot), (3000, None, hot), (3010, 1, None), (3020, 1, [math.nan] * 12), (3030, 1, [None] * 12), (3040, 0, [])]
    rows += [(4000 + i, i % 2, [1.0 + i / 64, 2.0]) for i in range(20)] + [(5000, 7, hot), (5010, 8, [0.0] * 12), (5011, 8, [0.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit("x")).withColumn("window", F.lit(1)).repartition(5)
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_numbers(spark):
    rows = [(0, 0, [3e6, -2e6]), (1, 0, [2.9e6, -2e6]), (2, 1, [2.8e6, -1.9e6]), (3, 1, [2.7e6 + 0.3, -2e6]), (4, 1, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(table, F.col("vec_id") == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i == 0) and len(got) == 2


def test_negatives_of_nothing(spark):
    table = spark.createDataFrame([(0, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    for some in (table, table.limit(0)):
        assert hard_negatives.mine(some, F.lit(True), F.col("label")).count() == 0
    assert hard_negatives.mine(table, F.lit(False), F.col("label")).count() == 0


def test_threshold_join_loses_no_pair():
    order = np.random.default_rng(11)
    for width in (1, 5, 64):
        anchors, rows = np.floor(256 * order.standard_normal((30, width))), np.floor(256 * order.standard_normal((500, width)))
        scores = (anchors @ rows.T).astype(np.int64)
        for share in (0.5, 0.95, 0.999):
            floors = np.quantile(scores, share, axis=1).astype(np.int64)
            at, to, found = hard_negatives.threshold_join(anchors, floors, rows, lambda strip, order: np.ones((len(anchors[strip]), len(order)), bool))
            assert {(a, b): s for a, b, s in zip(at, to, found)} == {(a, b): scores[a, b] for a, b in zip(*np.nonzero(scores >= floors[:, None]))}
