"""Toxicity scores from subword-bag embeddings that are averaged into a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.common import held_out, labelled_texts, map_texts, stage, table

#: Rows of each label that are fitted at most, and entries of their bags (of 4 bytes), which bounds what reaches the driver.
ROWS_PER_CLASS = 3000
ENTRIES_PER_CLASS = 12_000_000
BUCKETS = 1 << 16
DIMENSION = 12
GRAMS = (3, 4, 5)
EPOCHS = 6
BATCH = 50
RATE = 0.03
#: A word that occurs n times weighs n to this power, so that one repeated word does not make the bag.
POWER = 0.5
#: The mean of a bag is multiplied by this before the softmax, so that a few words in a hundred can decide.
SCALE = 100.0
#: Shares of a bag are kept in units of one in so many, as 16-bit floats.
SHARE_UNIT = 1024.0
#: Words whose subwords a worker remembers.
MEMORY = 400_000
FOLDS, FOLD = 5, 0

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, ends marked."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in [marked, *grams]]


@dataclass
class SubwordModel:
    """``logit`` is the difference of the two softmax logits that each bucket adds; ``bias`` that of an empty bag."""

    logit: np.ndarray
    bias: float

    def make(self) -> Callable[[list], list[pa.Array]]:
        one = self.scorer()
        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    def scorer(self) -> Callable[[str | None], float]:
        known: dict[str, tuple[float, int]] = {}

        def score(text: str | None) -> float:
            total, size = 0.0, 0
            for word, times in Counter(words(text)).items():
                n = times**POWER
                found = known.get(word)
                if found is None:
                    if len(known) >= MEMORY:
                        known.clear()
                    ids = subwords(word)
                    found = known[word] = (float(self.logit[ids].sum()), len(ids))
                total += n * found[0]
                size += n * found[1]
            x = self.bias + (total / size if size else 0.0)
            return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))

        return score


def _bag_of_texts() -> Callable[[list], list[pa.Array]]:
    known: dict[str, np.ndarray] = {}

    def work(texts: list) -> list[pa.Array]:
        ids, shares = [], []
        for text in texts:
            counted = Counter(words(text))
            if len(known) >= MEMORY // 8:
                known.clear()
            found = [known[w] if w in known else known.setdefault(w, np.array(subwords(w), np.int32)) for w in counted]
            bag = np.zeros(BUCKETS)
            if found:
                times = np.repeat(np.array(list(counted.values())) ** POWER, [f.size for f in found])
                bag = np.bincount(np.concatenate(found), times, BUCKETS)
            kept = np.flatnonzero(bag)
            ids.append(kept.astype(np.uint16).tobytes())
            # times SHARE_UNIT, so that the share of one word in a million still has all digits of a half
            shares.append((bag[kept] * (SHARE_UNIT / max(1.0, bag.sum()))).astype(np.float16).tobytes())
        return [pa.array(ids, pa.binary()), pa.array(shares, pa.binary())]

    return work


def _views(bags: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels, ids and shares of the rows in order of doc_id; the lists are views, so the bags lie in memory once."""
    ids, shares = [], []
    for name, kind, out in (("ids", np.uint16, ids), ("shares", np.float16, shares)):
        for chunk in bags[name].chunks:
            out += [np.frombuffer(value.as_buffer(), kind) for value in chunk]
    order = np.argsort(bags["doc_id"].to_numpy(), kind="stable")
    return bags["y"].to_numpy().astype(np.int64)[order], [ids[i] for i in order], [shares[i] for i in order]


def learn(bags: pa.Table, seed: int = 3) -> SubwordModel:
    """Embeddings and softmax, trained together by Adam on the cross entropy of shuffled small batches."""
    y, ids, shares = _views(bags)
    if len(set(y.tolist())) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), 3.0 if y.any() else -3.0)
    order = np.random.default_rng(seed)
    state = {
        "embedding": order.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION,
        "weight": order.uniform(-1, 1, (DIMENSION, 2)).astype(np.float32),
        "bias": np.zeros(2, np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in state.items()}
    second = {k: np.zeros_like(v) for k, v in state.items()}
    step = 0
    steps = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(len(y)), -(-len(y) // BATCH)):
            step += 1
            flat = np.concatenate([ids[r] for r in rows]).astype(np.int64)
            part = np.concatenate([shares[r] for r in rows]).astype(np.float32) * np.float32(SCALE / SHARE_UNIT)
            owner = np.repeat(np.arange(len(rows)), [ids[r].size for r in rows])
            weighted = state["embedding"][flat] * part[:, None]
            pooled = np.stack([np.bincount(owner, weighted[:, d], len(rows)) for d in range(DIMENSION)], axis=1)
            logits = pooled @ state["weight"] + state["bias"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ state["weight"].T)[owner] * part[:, None]
            gradient = {
                "embedding": np.stack([np.bincount(flat, back[:, d], BUCKETS) for d in range(DIMENSION)], axis=1).astype(np.float32),
                "weight": (pooled.T @ p).astype(np.float32),
                "bias": p.sum(axis=0).astype(np.float32),
            }
            rate = RATE * (1 - step / (steps + 1))
            for k, g in gradient.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                state[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    along = state["weight"][:, 1] - state["weight"][:, 0]
    return SubwordModel((state["embedding"] @ along * SCALE).astype(np.float32), float(state["bias"][1] - state["bias"][0]))


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, entries_per_class: int = ENTRIES_PER_CLASS) -> SubwordModel:
    """A model of ``labels.toxic`` from labelled documents outside the held-out fold, at most ``rows_per_class`` of each label.

    An id counts once, however many rows have it. Only the bags of that bounded sample reach the driver: of each label, in order of an
    id hash, as many as have ``entries_per_class`` entries together. Scores are probabilities at the sample's mix of labels, where
    toxic documents are as many as the bound allows. Without labels of both kinds scores are constant.
    """
    texts = labelled_texts(documents, labels, "toxic", FOLDS, FOLD, rows_per_class)
    bags = stage(map_texts(texts, "text", _bag_of_texts, "ids binary, shares binary"), "bags")
    order = ["y", F.xxhash64("doc_id").alias("hash"), "doc_id"]
    sizes = sorted(tuple(r) for r in bags.select(*order, (F.octet_length("ids") / 2).cast("int").alias("size")).collect())
    total, kept = {0: 0, 1: 0}, []
    for y, _, doc_id, size in sizes:
        total[y] += size
        if total[y] <= entries_per_class:
            kept.append((doc_id,))
    if len(kept) < len(sizes):
        bags = bags.join(F.broadcast(bags.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id", "left_semi")
    return learn(bags.toArrow())


def score(documents: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score) per row, over the whole text; NULL and empty texts get the score of an empty bag.

    Repeated rows come back as often as they occur, NULL ids as NULL, an empty table as an empty result.
    """
    return map_texts(documents.select("doc_id", "text"), "text", model.make, "score double")


def keep_clean(documents: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below ``threshold``."""
    scored = map_texts(documents.withColumn("__text", F.col("text")), "__text", model.make, "__score double")
    return scored.where(F.col("__score") < threshold).select(*documents.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from those whose crc32(doc_id as text) mod 5 is not 0."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, fit(documents, labels))
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
