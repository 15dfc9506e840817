"""A hidden Markov language model: Baum-Welch counts added up over all partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.common import held_out, table
from cvengine.llm.shards import BlockNumbers, Vocabulary, binary_batch, from_planes, planes, shard_count, shard_edges, summed
from cvengine.session import shuffles_dropped, stage_bucketed

STATES = 8
#: Passes of Baum-Welch over all training tokens.
ROUNDS = 2
#: Tokens after which a block of documents is closed; a longer document is a block of its own.
BLOCK_TOKENS = 2 << 20
#: Tokens whose forward variables are held at once, unless one document has more.
STRIP_TOKENS = 1 << 18
#: A word seen less often has no state shares of its own, but those of all words seen as often.
OWN = 5
#: Occurrences, spread like all tokens over the states, that are added to a word's own.
PRIOR = 1.0
LEAST_SHARE = 1e-6
#: Classes of words whose neighbours say where Baum-Welch starts: the most frequent words, each its own, and all others by hash.
START_WORDS, START_REST = 256, 128
#: Places from which the fit of neighbouring classes sets out, the likeliest of which counts, and its rounds.
START_TRIES, START_ROUNDS = 6, 150
#: Part of a word's shares at the start that is as of all tokens: neighbours alone say less than whole documents.
START_EVEN = 0.2
FOLDS, FOLD = 5, 1

_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, keys binary, counts binary"
_COUNTED = "shard int, block long, counts binary, index binary, n binary, totals array<double>, top array<long>, top_counts array<long>"
_SENT = "shard int, block long, shares binary, totals array<double>"
_LEARNED = "shard int, size int, shares binary, totals array<double>"
_ANSWERED = "shard int, block long, shares binary"


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, held, text in UTF-8) as blocks of local word numbers, frequent words first, with the words' hashes."""
    numbers = BlockNumbers()

    def close() -> pa.RecordBatch:
        lengths = np.array(sizes, np.int64)
        ids, size = np.concatenate(found), len(words)
        order = np.argsort(-np.bincount(ids, minlength=size), kind="stable")
        renamed = np.empty(size, np.int32)
        renamed[order] = np.arange(size, dtype=np.int32)
        ids = renamed[ids]
        learned = np.bincount(ids[np.repeat(~np.array(held, bool), lengths)], minlength=size)
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, size)[order]
        row = (numbers.take(), doc_ids, held, sizes, planes(ids), keys.tobytes(), planes(learned.astype(np.int32)))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return binary_batch([row], ["block", "doc_ids", "held", "sizes", "ids", "keys", "counts"], kinds)

    doc_ids, held, sizes, found, words, total = [], [], [], [], Vocabulary({b"": 0}), 0
    for batch in batches:
        for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns)):
            # of bytes, lower() changes A-Z and split() cuts at \x20 and \x09-\x0D only; the empty word is the end
            tokens = (text or b"").lower().split()
            tokens.append(b"")
            doc_ids.append(doc_id)
            held.append(out)
            sizes.append(len(tokens))
            found.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
            total += len(tokens)
            if total >= BLOCK_TOKENS:
                yield close()
                doc_ids, held, sizes, found, words, total = [], [], [], [], Vocabulary({b"": 0}), 0
    if sizes:
        yield close()


@dataclass
class Model:
    """All parameters but the words' own shares, which stay distributed.

    A token w that was seen c times has P(w | s) = (1 - unseen[s]) c share(w, s) / mass[s]; all unseen ones together have unseen[s].
    """

    start: np.ndarray
    move: np.ndarray
    occupied: np.ndarray
    rare: np.ndarray
    mass: np.ndarray
    unseen: np.ndarray
    tokens: int = 0
    types: int = 0
    start_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    start_shares: np.ndarray = field(default_factory=lambda: np.zeros((0, STATES), np.float32))

    def emissions(self, counts: np.ndarray, own: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """P(word | state) of words seen ``counts`` times; ``shares`` are those of the words ``own``."""
        of = np.zeros((counts.size, self.start.size))
        of[own] = shares
        few = (counts > 0) & ~own
        of[few] = self.rare[np.minimum(counts[few], len(self.rare)) - 1]
        of *= counts[:, None] * ((1 - self.unseen) / np.maximum(self.mass, 1e-300))
        of[counts == 0] = self.unseen
        return of


def passes(ids: np.ndarray, sizes: np.ndarray, emit: np.ndarray, model: Model, learn: bool):
    """(natural log likelihood of each sequence, and if ``learn`` expected counts of words by state, moves and starts).

    Sequences of a strip advance together: at step t the first n rows of a layer are those with more than t tokens.
    """
    states = model.start.size
    score, words = np.zeros(sizes.size), np.zeros((emit.shape[0], states)) if learn else None
    moves, starts = np.zeros((states, states)), np.zeros(states)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    until = np.cumsum(sizes[order])
    first = 0
    while first < order.size:
        base = until[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(until, base + STRIP_TOKENS, "right")))
        docs = order[first:last]
        first = last
        lengths = sizes[docs]
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        layer = np.r_[0, np.cumsum(alive)]
        rank = np.repeat(np.arange(docs.size), lengths)
        step = np.arange(rank.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = layer[step] + rank
        tokens = np.empty(rank.size, ids.dtype)
        tokens[place] = ids[np.repeat(begins[docs], lengths) + step]
        e = emit[tokens]
        alpha, scale = np.empty_like(e), np.empty(rank.size)
        before = None
        for t, n in enumerate(alive):
            here = slice(layer[t], layer[t + 1])
            now = e[here] * (model.start if before is None else before[:n] @ model.move)
            total = now.sum(axis=1)
            now /= total[:, None]
            alpha[here], scale[here] = now, total
            before = now
        score[docs] = np.bincount(rank, np.log(scale)[place], docs.size)
        if not learn:
            continue
        # alpha becomes the state probabilities of each token, as the backward variables pass
        e /= scale[:, None]
        after = np.ones((alive[-1], states))
        for t in range(alive.size - 2, -1, -1):
            n, ahead = alive[t], slice(layer[t + 1], layer[t + 2])
            weighted = e[ahead] * after
            moves += alpha[layer[t] : layer[t] + alive[t + 1]].T @ weighted
            alpha[ahead] *= after
            after = np.ones((n, states))
            after[: alive[t + 1]] = weighted @ model.move.T
        alpha[: alive[0]] *= after
        starts += alpha[: alive[0]].sum(axis=0)
        for k in range(states):
            words[:, k] += np.bincount(tokens, alpha[:, k], len(words))
    return score, words, moves * model.move, starts


def _shares(found: np.ndarray, counts: np.ndarray, occupied: np.ndarray) -> np.ndarray:
    """State shares of words from their expected counts, drawn towards those of all tokens and rounded to 16 bits."""
    mixed = (found + PRIOR * occupied) / (counts + PRIOR)[:, None]
    return np.maximum(mixed, LEAST_SHARE).astype(np.float16)


def _moved(model: Model, moves: np.ndarray, starts: np.ndarray, occupied: np.ndarray, rare: np.ndarray) -> Model:
    """The model with new transitions, starts, shares of rare words and share of unseen words; ``rare`` are expected counts."""
    move = moves + 0.1
    start = starts + 0.1
    ones = rare[0] if len(rare) else np.zeros_like(occupied)
    rare = rare + PRIOR * occupied / max(occupied.sum(), 1e-300) + 1e-9
    return replace(
        model,
        start=start / start.sum(),
        move=move / move.sum(axis=1, keepdims=True),
        occupied=occupied / max(occupied.sum(), 1e-300),
        rare=rare / rare.sum(axis=1, keepdims=True),
        unseen=(ones + 0.5) / (occupied + 1.0) if model.types else np.ones_like(occupied),
    )


def blank(states: int = STATES) -> Model:
    even = np.full(states, 1 / states)
    stay = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(even, stay, even, np.tile(even, (OWN - 1, 1)), np.ones(states), even)


def _packed(shares: np.ndarray) -> bytes:
    """16-bit shares by word and state, compressed: those of a state lie together, low bytes apart from high ones."""
    return pa.compress(planes(shares.astype(np.float16).T.ravel()), "zstd", asbytes=True)


def _unpacked(data: bytes, words: int, states: int) -> np.ndarray:
    return from_planes(pa.decompress(data, words * states * 2, "zstd"), "f2").reshape(states, words).T


def _frequent(counted: DataFrame) -> np.ndarray:
    """Ascending hashes of the START_WORDS words that occur most often in training documents, those of equal counts by hash."""
    each = counted.where("top is not null").select(F.explode(F.arrays_zip("top", "top_counts")).alias("w")).select("w.*")
    chosen = each.orderBy(F.desc("top_counts"), "top").limit(START_WORDS).collect()
    return np.sort(np.array([r["top"] for r in chosen], np.int64).view(np.uint64))


def _classes(frequent: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The class of each word: its place among the frequent ones, or one of START_REST by its hash."""
    found = frequent.size + (keys % np.uint64(START_REST)).astype(np.int64)
    if frequent.size:
        at = np.minimum(np.searchsorted(frequent, keys), frequent.size - 1)
        own = frequent[at] == keys
        found[own] = at[own]
    return found


def _neighbours(blocks: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """How often each class (column) follows each class (row) in all training documents; in the last row, how often it begins one."""
    classes = frequent.size + START_REST

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 1) * classes, np.int64)
        for batch in batches:
            for held, sizes, ids, keys in zip(*batch.columns):
                held, sizes = np.array(held.as_py(), bool), np.array(sizes.as_py(), np.int64)
                words = _classes(frequent, np.frombuffer(keys.as_buffer(), np.uint64))[from_planes(ids.as_buffer(), "i4")]
                before = np.r_[classes, words[:-1]]
                before[np.cumsum(sizes) - sizes] = classes
                total += np.bincount((before * classes + words)[np.repeat(~held, sizes)], minlength=total.size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    each = blocks.select("held", "sizes", "ids", "keys").mapInArrow(count, "cell long, n long")
    found = each.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((classes + 1) * classes)
    total[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return total.reshape(classes + 1, classes)


def _fitted(pairs: np.ndarray, states: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, expected counts of states and classes, of moves) after EM on pairs of neighbours: two states, each with its class."""
    each, seen = pairs.sum(axis=0) + pairs.sum(axis=1), pairs > 0
    words = each * np.random.default_rng(seed).gamma(1.0, size=(states, each.size)) + 1e-9
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    for _ in range(START_ROUNDS):
        emit, joint = words / words.sum(axis=1, keepdims=True), moves / moves.sum()
        likely = emit.T @ joint @ emit
        ratio = np.divide(pairs, likely, out=np.zeros_like(pairs), where=seen)
        words = emit * (joint @ (emit @ ratio.T) + joint.T @ (emit @ ratio)) + 1e-3 * each / states + 1e-9
        moves = joint * (emit @ ratio @ emit.T) + 1e-3
    return float((pairs[seen] * np.log(likely[seen])).sum()), words, moves


def started(neighbours: np.ndarray, frequent: np.ndarray, states: int = STATES) -> Model:
    """Where the passes over all documents start: the model under which the neighbouring classes of all training tokens are likeliest."""
    model, pairs, starts = blank(states), neighbours[:-1], neighbours[-1]
    if not pairs.any():
        return model
    _, words, moves = max((_fitted(pairs, states, k) for k in range(START_TRIES)), key=lambda fit: fit[0])
    occupied = words.sum(axis=1) / words.sum()
    some = (pairs.sum(axis=0) + pairs.sum(axis=1) + starts) > 0
    shares = np.where(some[:, None], (words / words.sum(axis=0)).T, occupied)
    start = starts @ shares + 0.1
    return replace(
        model,
        start=start / start.sum(),
        move=(moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True),
        occupied=occupied,
        rare=np.tile(occupied, (OWN - 1, 1)),
        unseen=np.full(states, 1e-9),
        start_words=frequent,
        start_shares=np.maximum((1 - START_EVEN) * shares + START_EVEN * occupied, LEAST_SHARE).astype(np.float32),
    )


def _counted(blocks: DataFrame, shards: int) -> DataFrame:
    """Per block and shard the corpus counts of the block's words, the numbers in the shard of those seen OWN times or more, and
    how often the block's training documents have them.

    Rows without a block hold a shard's totals: training tokens, words seen, and words seen 1 to OWN - 1 times; and its most
    frequent words with their counts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = np.frombuffer(keys, np.uint64), from_planes(counts, "i4")
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                edges = shard_edges(keys, shards)
                rows += [(s, block, planes(keys[a:b]), planes(counts[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield binary_batch(rows, ["shard", "block", "keys", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        parts = [from_planes(k, "u8") for k in rows["keys"]]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.zeros(keys.size, np.int64)
        np.add.at(counts, at, np.concatenate([from_planes(c, "i4") for c in rows["counts"]]))
        own = counts >= OWN
        index = np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)
        ends = np.cumsum([p.size for p in parts])
        places = np.split(at, ends[:-1])
        totals = [counts.sum(), (counts > 0).sum(), *np.bincount(counts[~own], minlength=OWN)[1:OWN]]
        most = np.lexsort((keys.view(np.int64), -counts))[:START_WORDS]
        most = most[counts[most] > 0]
        shard, nothing = int(rows["shard"].iat[0]), (None, None, None)
        out = [(shard, int(b), planes(counts[p]), planes(index[p]), n, *nothing) for b, p, n in zip(rows["block"], places, rows["counts"])]
        out.append((shard, None, *nothing, [float(x) for x in totals], keys[most].view(np.int64), counts[most]))
        frame = pd.DataFrame(out, columns=["shard", "block", "counts", "index", "n", "totals", "top", "top_counts"])
        return frame.astype({"block": "Int64"})

    sent = blocks.select("block", "keys", "counts").mapInArrow(send, "shard int, block long, keys binary, counts binary")
    return sent.groupBy("shard").applyInPandas(add, _COUNTED)


class _Block:
    """A block in a task: its sequences, the corpus counts of its words, and which of them have shares of their own."""

    def __init__(self, row) -> None:
        self.number, self.sizes = int(row["block"]), np.asarray(row["sizes"], np.int64)
        self.ids, self.keys = from_planes(row["ids"], "i4"), np.frombuffer(row["keys"], np.uint64)
        self.learned = from_planes(row["counts"], "i4")
        self.order = np.argsort(self.keys)
        self.counts, self.shard = np.zeros(self.keys.size, np.int64), []
        at = 0
        for reply in row["replies"]:
            counts = from_planes(reply["counts"], "i8")
            here = self.order[at : at + counts.size]
            self.counts[here] = counts
            self.shard.append((int(reply["shard"]), here[counts >= OWN]))
            at += counts.size
        self.own = self.counts >= OWN

    def emissions(self, model: Model, replies: pd.DataFrame) -> np.ndarray:
        shares = np.zeros((self.keys.size, model.start.size), np.float32)
        if len(replies):
            by_shard = dict(zip(replies["shard"], replies["shares"]))
            for shard, words in self.shard:
                if words.size:
                    shares[words] = _unpacked(by_shard[shard], words.size, model.start.size)
        elif model.start_shares.size:
            shares[:] = model.start_shares[_classes(model.start_words, self.keys)]
        else:
            shares[:] = model.occupied
        return model.emissions(self.counts, self.own, shares[self.own])


def _expected(model: Model):
    """Per block one row per shard with the state shares of its words there, the first of which also holds the block's totals."""

    def expect(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({c: [] for c in ["shard", "block", "shares", "totals"]})
        block = _Block(blocks.iloc[0])
        learn = ~np.asarray(blocks["held"].iat[0], bool)
        tokens = np.repeat(learn, block.sizes)
        score, words, moves, starts = passes(block.ids[tokens], block.sizes[learn], block.emissions(model, replies), model, True)
        few = np.stack([words[block.counts == c].sum(axis=0) for c in range(1, OWN)])
        totals = np.concatenate([moves.ravel(), starts, words.sum(axis=0), few.ravel(), [score.sum()]])
        rows = []
        for shard, here in block.shard:
            here = here[block.learned[here] > 0]
            rows.append((shard, block.number, _packed(words[here] / block.learned[here][:, None]), totals if not rows else None))
        return pd.DataFrame(rows, columns=["shard", "block", "shares", "totals"])

    return expect


def _maximised(model: Model):
    """Per shard one row with the new shares of its words and its totals."""
    states = model.start.size

    def maximise(sent: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        sent = sent.sort_values("block", ignore_index=True)
        # which words each block has, and how often, is known from the counting pass
        size, taught = 0, {}
        for block, index, n in zip(replies["block"], replies["index"], replies["n"]):
            index, n = from_planes(index, "i4"), from_planes(n, "i4")
            size = max(size, int(index.max(initial=-1)) + 1)
            some = (index >= 0) & (n > 0)
            taught[int(block)] = index[some], n[some].astype(np.int64)
        counts, words, mass = np.zeros(size, np.int64), np.zeros((size, states)), np.zeros(states)
        totals = np.zeros(2 * states + states * states + (OWN - 1) * states + 1)
        for block, shares, extra in zip(sent["block"], sent["shares"], sent["totals"]):
            index, n = taught[int(block)]
            counts[index] += n
            shares = _unpacked(shares, index.size, states).astype(np.float64)
            words[index] += shares * (n / np.maximum(shares.sum(axis=1), 1e-9))[:, None]
            if extra is not None:
                totals += extra
        shares = _shares(words, counts, model.occupied)
        mass += (counts[:, None] * shares.astype(np.float64)).sum(axis=0)
        shard = int(replies["shard"].iat[0]) if len(replies) else int(sent["shard"].iat[0])
        return pd.DataFrame([(shard, size, _packed(shares), [*totals, *mass])], columns=["shard", "size", "shares", "totals"])

    return maximise


def _answered(states: int):
    """Per shard one row for each block that has words of its own there, with their shares."""

    def answer(asked: pd.DataFrame, learned: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for shard, size, shares in zip(learned["shard"], learned["size"], learned["shares"]):
            shares = _unpacked(shares, int(size), states)
            for block, index in zip(asked["block"], asked["index"]):
                index = from_planes(index, "i4")
                index = index[index >= 0]
                if index.size:
                    rows.append((int(shard), int(block), _packed(shares[index])))
        return pd.DataFrame(rows, columns=["shard", "block", "shares"])

    return answer


def _scored(model: Model):
    """Per document its tokens, known tokens, the score of smoothed counts and the model's score, in base 10."""
    unit = np.log10(model.tokens + 0.5 * (model.types + 1))

    def score(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({c: [] for c in ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]})
        block = _Block(blocks.iloc[0])
        found = passes(block.ids, block.sizes, block.emissions(model, replies), model, False)[0]
        of = np.repeat(np.arange(block.sizes.size), block.sizes)
        base = (np.log10(block.counts + 0.5) - unit)[block.ids]
        known = block.counts[block.ids] > 0
        row = blocks.iloc[0]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if i is None or i != i else int(i) for i in row["doc_ids"]], "Int64"),
                "held_out": np.asarray(row["held"], bool),
                "n_tokens": block.sizes,
                "n_known": np.bincount(of[known], minlength=block.sizes.size),
                "base_score": np.bincount(of, base, block.sizes.size),
                "score": found / np.log(10),
            }
        )

    return score


def score_texts(documents: DataFrame, held: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``documents`` (doc_id, text); other columns are ignored.

    Tokens are words, A-Z lower-cased, cut at blanks and \\t \\n \\v \\f \\r, and one end. ``held`` says which rows teach nothing. ``score`` is
    log10 of the text's probability under the model, summed over all state sequences; ``base_score`` adds log10 of the
    token's smoothed share of the training tokens, (c + 0.5) / (N + 0.5 (V + 1)), where all unseen words count as one.

    Documents become blocks with local word numbers, staged and bucketed once. Word counts and, in each of ``rounds`` Baum-Welch
    passes, expected counts go from the blocks to shards of words and back, and only transitions and totals of a fixed size to the driver.
    They start from a fit of how often words of START_WORDS + START_REST classes follow each other, counted over all training
    tokens; so all that is counted or learned covers every one of them. Words seen fewer than OWN times share the state shares of all words seen as often, and
    unseen words together get the share that words seen once have in each state. Words are told apart by 64-bit hashes.

    NULL texts are empty: one token, the end. Rows come back as often as they occur, NULL ids as NULL. Without training
    rows every token is unseen and both scores are 0. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    with shuffles_dropped(spark):
        source = documents.select("doc_id", F.coalesce(held, F.lit(True)).alias("held"), F.col("text").cast("binary").alias("text"))
        blocks = stage_bucketed(source.mapInArrow(_read_blocks, _BLOCKS), "block", "word-blocks")
        shards = shard_count(blocks.agg(F.sum(F.octet_length("keys") / 8)).first()[0])
        counted = stage_bucketed(_counted(blocks, shards), "shard", "word-counts")
        totals = summed(counted, "totals")
        replies = counted.where("block is not null")
        gathered = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("replies"))
        known = stage_bucketed(gathered, "block", "block-counts")
        ready = blocks.join(known.hint("merge"), "block")
        asked, wanted = replies.select("shard", "block", "index", "n"), replies.select("shard", "block", "index")
        frequent = _frequent(counted)
        model = started(_neighbours(blocks, frequent), frequent, states)
        if totals.size:
            model.tokens, model.types = int(totals[0]), int(totals[1])
            few = totals[2:] * np.arange(1, OWN)
        else:
            few = np.zeros(OWN - 1)
        model = replace(model, mass=np.maximum(model.occupied * model.tokens, 1e-9), unseen=model.unseen if model.types else np.ones(states))

        shares = spark.createDataFrame([], _ANSWERED)
        for _ in range(rounds if model.types else 0):
            sent = ready.groupBy("block").cogroup(shares.groupBy("block")).applyInPandas(_expected(model), _SENT)
            maximised = sent.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_maximised(model), _LEARNED)
            # a word's shares are kept once, not once for each block that has it; blocks get theirs from here in the next pass
            maximised = stage_bucketed(maximised, "shard", "word-shares")
            numbers = summed(maximised, "totals")
            moves, starts, occupied, rare, _, mass = np.split(numbers, np.cumsum([states * states, states, states, (OWN - 1) * states, 1]))
            model = _moved(model, moves.reshape(states, states), starts, occupied, rare.reshape(OWN - 1, states))
            model = replace(model, mass=mass + few @ model.rare, start_words=model.start_words[:0], start_shares=model.start_shares[:0])
            learned = maximised.select("shard", "size", "shares")
            shares = wanted.groupBy("shard").cogroup(learned.groupBy("shard")).applyInPandas(_answered(states), _ANSWERED)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = ready.groupBy("block").cogroup(shares.groupBy("block")).applyInPandas(_scored(model), schema)
    names = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"]
    return scored.select(*names)


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32(doc_id as text) leaves another remainder than 1 when divided by 5."""
    return score_texts(table(spark, sf_dir, "documents"), held_out("doc_id", FOLDS, FOLD))
