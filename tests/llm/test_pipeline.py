"""The stages against brute force, on a small table with every awkward case."""

import hashlib
from collections import Counter

import sentencepiece

import corpus_pipeline
from cvengine.llm import sentence_pieces, source_mix, toxicity
from cvengine.llm.common import stage

from test_groups import expected_simhash
from test_texts import plain_dedup, poisson_count


def test_stages_equal_brute_force(spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000").select(*columns)
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "", "en", "src0", 0), (10**6 + 2, "", "en", "src0", 0), (None, "a b", "en", "src1", 3)], docs.schema)
    docs = stage(docs.unionAll(extra))
    names = [name for name, _ in corpus_pipeline.STAGES]
    out, frames = docs, []
    for _, function in corpus_pipeline.STAGES:
        out = stage(function(spark, out, sf))
        frames.append(out)
    assert all(f.columns == columns for f in frames[:-1]) and len(names) == 5

    score = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    rows = [tuple(r) for r in docs.collect()]
    clean = [r for r in rows if score(r[1]) < 0.5]
    assert Counter(map(tuple, frames[0].collect())) == Counter(clean)

    clean.sort(key=lambda r: (r[0] is None, r[0] or 0))
    texts = plain_dedup([r[1] for r in clean], 50)
    lines = [(r[0], t, *r[2:4], r[4] if t == r[1] else len(t)) for r, t in zip(clean, texts)]
    assert Counter(map(tuple, frames[1].collect())) == Counter(lines)

    spread = [((r[0] is None, r[0] or 0, i), r[1]) for i, r in enumerate(lines)]
    kept = {i for i, _, component in expected_simhash(spread) if i == component}
    single = [r for (place, _), r in zip(spread, lines) if place in kept]
    assert Counter(map(tuple, frames[2].collect())) == Counter(single)

    sizes = Counter(r[3] for r in single)
    mass = sum(n**0.5 for n in sizes.values())
    mixed = Counter()
    for r in single:
        rate = len(single) * (sizes[r[3]] ** 0.5 / mass) / sizes[r[3]]
        parts = max(1, -int(-rate // source_mix.PART_RATE))
        own = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"17|count|{own}|{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            mixed[r] += poisson_count(rate / parts, u)
    assert Counter(map(tuple, frames[3].collect())) == +mixed

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    want = Counter()
    for r, n in mixed.items():
        ids = None if r[1] is None else tuple(model.encode(r[1]))
        want[(r[0], r[3], r[2], -1 if ids is None else len(ids), ids)] += n
    got = Counter((r.doc_id, r.source, r.lang, -1 if r.ids is None else r.n_tokens, None if r.ids is None else tuple(r.ids)) for r in frames[4].collect())
    assert got == +want


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf))
        assert docs.count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
