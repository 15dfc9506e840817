"""Phrases whose words belong together: n-grams counted in an FM-index per block of documents, summed over all blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cvengine.llm.common import stage, table
from cvengine.llm.shards import BlockNumbers, Vocabulary, binary_batch, from_planes, mixed, planes, shard_count, shard_edges
from cvengine.session import stage_bucketed

#: Words after which a block of one language is closed; a longer document is a block of its own.
BLOCK_WORDS = 2 << 20
MOST_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: A phrase goes if a longer one occurs at least so many times in a hundred of its own.
COVERED = 80
#: First-round groups of a language in the final ranking.
SALTS = 64

_BREAK = b"\xff"  # in no UTF-8 text
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + 10 * _BREAK + b" ")


def sequence(text: bytes) -> list[bytes]:
    """Words, with a break between pieces."""
    # only blanks are left for split() to cut at: tabs became blanks and the other white space breaks
    return text.translate(_BYTES).replace(_BREAK, b" \xff ").split()


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, text in UTF-8) as blocks of one language: local word numbers with 0 for a break, frequent words first."""
    numbers = BlockNumbers()
    open_: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
    held: dict[str, int] = {}

    def close(lang: str) -> pa.RecordBatch:
        words, parts = open_.pop(lang)
        del held[lang]
        ids, size = np.concatenate(parts), len(words)
        counts = np.bincount(ids, minlength=size)
        order = np.r_[0, 1 + np.argsort(-counts[1:], kind="stable")]
        renamed = np.empty(size, np.int32)
        renamed[order] = np.arange(size, dtype=np.int32)
        names = list(words)
        row = (numbers.take(), lang, int(counts[1:].sum()), planes(renamed[ids]), b" ".join(names[i] for i in order[1:]), planes(counts[order[1:]].astype(np.int32)), size - 1)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return binary_batch([row], ["block", "lang", "n_words", "ids", "words", "counts", "size"], kinds)

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = sequence(text or b"")
            found.append(_BREAK)
            words, parts = open_.setdefault(lang, (Vocabulary({_BREAK: 0}), []))
            parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            held[lang] = held.get(lang, 0) + len(found)
            if held[lang] >= BLOCK_WORDS:
                yield close(lang)
            elif sum(held.values()) >= 2 * BLOCK_WORDS:
                yield close(max(held, key=held.get))
    for lang in list(open_):
        yield close(lang)


def stable_order(values: np.ndarray) -> np.ndarray:
    """Positions in order of ``values`` (below 2**31), equal ones in order of position."""
    packed = (values.astype(np.int64) << 32) | np.arange(values.size)
    packed.sort()
    return packed & 0xFFFFFFFF


class Index:
    """FM-index of a sequence of word numbers for patterns of up to ``depth`` words; 0 is a break and belongs to no pattern.

    Suffixes are in order of their first ``depth`` words. ``last`` is the word before each suffix (the transform), and
    ``back`` leads from a place in it to that word's own place (its number among equal words, after all smaller words).
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        order = stable_order(text)
        for _ in range(depth - 1):
            # sorted by k words, put the word before in front and sort by it: sorted by k + 1 words
            before = order - 1
            order = before[stable_order(text[before])]
            order = np.where(order < 0, text.size - 1, order)
        self.last = text[order - 1]
        self.back = np.empty(text.size, np.int64)
        self.back[stable_order(self.last)] = np.arange(text.size)


class Patterns:
    """Patterns of equal length: words (columns), and their intervals in the index of the text and in that of the reversed text."""

    def __init__(self, words: np.ndarray, low: np.ndarray, mirror: np.ndarray, size: np.ndarray) -> None:
        self.words, self.low, self.mirror, self.size = words, low, mirror, size

    def only(self, which: np.ndarray) -> Patterns:
        return Patterns(self.words[which], self.low[which], self.mirror[which], self.size[which])

    def extended(self, index: Index, symbols: int, left: bool) -> Patterns:
        """All patterns with one word more, to the left by the text's index or to the right by that of the reversed text.

        The words before an interval's suffixes are its extensions. The new interval starts where the first of them leads; in the other
        index it lies within the old one, behind the extensions by smaller words.
        """
        low, other = (self.low, self.mirror) if left else (self.mirror, self.low)
        total = int(self.size.sum())
        begin = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(low.size), self.size)
        place = np.arange(total) + np.repeat(low - begin, self.size)
        key = owner * symbols + index.last[place]
        bits = max(1, total.bit_length())
        if (low.size * symbols).bit_length() + bits < 63:
            packed = (key << bits) | np.arange(total)
            packed.sort()
            at, key = packed & ((1 << bits) - 1), packed >> bits
        else:
            at = np.argsort(key, kind="stable")
            key = key[at]
        starts = np.flatnonzero(np.r_[total > 0, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, total])
        of, word = np.divmod(key[starts], symbols)
        new, within = index.back[place[at[starts]]], other[of] + starts - begin[of]
        columns = [word[:, None], self.words[of]] if left else [self.words[of], word[:, None]]
        found = Patterns(np.hstack(columns), new if left else within, within if left else new, size)
        return found.only(word > 0)


def single_words(text: np.ndarray, symbols: int) -> Patterns:
    counts = np.bincount(text, minlength=symbols)
    low = np.cumsum(counts) - counts
    return Patterns(np.arange(symbols)[:, None], low, low, counts).only(np.arange(symbols) > 0)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by their hash, where the stretch of each shard begins in it)."""
    spread = mixed(keys)
    order = np.argsort(spread)
    return order, shard_edges(spread[order], shards)


class _Block:
    """A block in a task, as a sequence of numbers of the words that are frequent in the corpus; all others are breaks."""

    def __init__(self, row: dict, shards: int) -> None:
        words = row["words"].split(b" ") if row["words"] else []
        ids = np.zeros(len(words) + 1, np.int64)
        order, _ = word_order(row["lang"], words, shards)
        ids[1 + order] = np.concatenate([np.zeros(0, np.int64), *(from_planes(r["ids"], "u4") for r in row["replies"])])
        self.ids = np.unique(ids[ids > 0])
        number = np.where(ids > 0, 1 + np.searchsorted(self.ids, ids), 0).astype(np.int32)
        self.text = np.r_[np.zeros(MOST_WORDS, np.int32), number[from_planes(row["ids"], "i4")]]
        # runs of breaks say no more than one
        self.text = self.text[np.r_[True, (self.text[1:] > 0) | (self.text[:-1] > 0)]]
        self.symbols = self.ids.size + 1
        self.ids = np.r_[0, self.ids]

    def pairs(self, depth: int = 1) -> tuple[Index, Patterns, np.ndarray]:
        """(index, patterns of two words, their keys)."""
        index = Index(self.text, depth)
        found = single_words(self.text, self.symbols).extended(index, self.symbols, left=True)
        return index, found, _paired(self.ids[found.words[:, 0]], self.ids[found.words[:, 1]])


def word_order(lang: str, words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_by_shard`` for words of a language."""
    head = lang.encode() + b" "
    keys = np.fromiter((xxhash.xxh64_intdigest(head + w) for w in words), np.uint64, len(words))
    order = np.lexsort((np.arange(len(words)), keys))
    return order, shard_edges(keys[order], shards)


def _count_words(blocks: DataFrame, shards: int, min_count: int) -> DataFrame:
    """Per block and shard the numbers of the block's words (0: too rare), and a row (id, lang, word, f) for each frequent word."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, lang, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = words.split(b" ") if words else [], from_planes(counts, "i4")
                order, edges = word_order(lang, words, shards)
                for s, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        rows.append((s, block, lang, b" ".join(words[i] for i in order[a:b]), planes(counts[order[a:b]])))
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            yield binary_batch(rows, ["shard", "block", "lang", "words", "counts"], kinds)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iat[0])
        rows = rows.sort_values("block", ignore_index=True)
        known: dict[str, Vocabulary] = {}
        base, places = {}, []
        for lang, words in zip(rows["lang"], rows["words"]):
            held = known.setdefault(lang, Vocabulary())
            words = words.split(b" ")
            places.append(np.fromiter(map(held.__getitem__, words), np.int64, len(words)))
        at = 0
        for lang, held in known.items():
            base[lang], at = at, at + len(held)
        counts = np.zeros(at, np.int64)
        for lang, place, n in zip(rows["lang"], places, rows["counts"]):
            counts[base[lang] + place] += from_planes(n, "i4")
        often = counts >= min_count
        ids = np.where(often, 1 + shard + shards * (np.cumsum(often) - 1), 0)
        if ids.size and ids.max() >= 1 << 32:
            raise ValueError("more than 2**32 frequent words")
        out = [(int(b), shard, planes(ids[base[g] + p].astype(np.uint32)), None, None, None, None) for b, g, p in zip(rows["block"], rows["lang"], places)]
        for lang, held in known.items():
            out += [(None, shard, None, int(ids[base[lang] + i]), lang, w.decode(), int(counts[base[lang] + i])) for i, w in enumerate(held) if often[base[lang] + i]]
        frame = pd.DataFrame(out, columns=["block", "shard", "ids", "id", "lang", "word", "f"])
        return frame.astype({"block": "Int64", "id": "Int64", "f": "Int64"})

    sent = blocks.select("block", "lang", "words", "counts").mapInArrow(send, "shard int, block long, lang string, words binary, counts binary")
    return sent.groupBy("shard").applyInPandas(add, "block long, shard int, ids binary, id long, lang string, word string, f long")


_TALLY = ["size", "shard", "block", "keys", "counts"]
_TALLY_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_TALLY_SCHEMA = "size int, shard int, block long, keys binary, counts binary"


def _messages(size: int, block: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    order, edges = _by_shard(keys, shards)
    keys, counts = keys[order], counts[order].astype(np.int32)
    return [(size, s, block, keys[a:b].tobytes(), planes(counts[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _summed(sent: DataFrame, shards: int, min_count: int, reply: bool) -> DataFrame:
    """Rows (size, id, key, f) for the phrases that are frequent, and to the blocks that sent them their ids (0: too rare)."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        size, shard = int(rows["size"].iat[0]), int(rows["shard"].iat[0])
        parts = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.zeros(keys.size, np.int64)
        np.add.at(counts, at, np.concatenate([from_planes(c, "i4") for c in rows["counts"]]))
        often = counts >= min_count
        ids = np.where(often, 1 + shard + shards * (np.cumsum(often) - 1), 0)
        if ids.size and ids.max() >= 1 << 32:
            raise ValueError("more than 2**32 frequent phrases")
        found = pd.DataFrame({"size": size, "id": ids[often], "key": keys[often].view(np.int64), "f": counts[often]})
        if not reply:
            return found.assign(block=pd.NA, shard=shard, ids=None).astype({"block": "Int64"})
        places = np.split(at, np.cumsum([p.size for p in parts])[:-1])
        back = pd.DataFrame({"block": rows["block"], "ids": [planes(ids[p].astype(np.uint32)) for p in places], "shard": shard, "size": size})
        both = pd.concat([found, back], ignore_index=True)
        return both.astype({"block": "Int64", "id": "Int64", "key": "Int64", "f": "Int64"}).assign(shard=shard)

    summed = sent.groupBy("size", "shard").applyInPandas(
        lambda rows: add(rows)[["size", "block", "shard", "ids", "id", "key", "f"]],
        "size int, block long, shard int, ids binary, id long, key long, f long",
    )
    return stage(summed, "phrase-counts")


def _send_pairs(shards: int, word_shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, found, keys = _Block(row, word_shards).pairs()
                yield binary_batch(_messages(2, row["block"], keys, found.size, shards), _TALLY, _TALLY_KINDS)

    return send


def _send_longer(shards: int, word_shards: int):
    """Patterns of three words, by an extension to the left, and of four, from these by one to the right, all of whose pairs are frequent."""

    def found_in(row: dict, replies: list[tuple[int, bytes]]) -> list[tuple]:
        block = _Block(row, word_shards)
        index, pairs, keys = block.pairs(MOST_WORDS)
        order, _ = _by_shard(keys, shards)
        ids = np.zeros(keys.size, np.int64)
        ids[order] = np.concatenate([np.zeros(0, np.int64), *(from_planes(d, "u4") for _, d in sorted(replies))])
        often = ids > 0
        pairs, ids = pairs.only(often), ids[often]
        if not ids.size:
            return []
        codes = pairs.words[:, 0] * block.symbols + pairs.words[:, 1]
        ranked = np.argsort(codes)
        codes, ids = codes[ranked], ids[ranked]

        def pair_ids(patterns: Patterns, first: int) -> np.ndarray:
            code = patterns.words[:, first] * block.symbols + patterns.words[:, first + 1]
            at = np.minimum(np.searchsorted(codes, code), codes.size - 1)
            return np.where(codes[at] == code, ids[at], 0)

        mirror = Index(block.text[::-1].copy(), MOST_WORDS)
        three = pairs.extended(index, block.symbols, left=True)
        three = three.only(pair_ids(three, 0) > 0)
        four = three.extended(mirror, block.symbols, left=False)
        last = pair_ids(four, 2)
        four, last = four.only(last > 0), last[last > 0]
        out = _messages(3, row["block"], _paired(pair_ids(three, 0), block.ids[three.words[:, 2]]), three.size, shards)
        return out + _messages(4, row["block"], _paired(pair_ids(four, 0), last), four.size, shards)

    def send(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = found_in(rows.iloc[0].to_dict(), list(zip(replies["shard"], replies["ids"]))) if len(rows) else []
        return pd.DataFrame(out, columns=_TALLY)

    return send


def frequent_phrases(documents: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """((lang, p, phrase, f), (lang, n)): all phrases of 1 to 4 words with ``min_count`` occurrences or more, and the words of each language.

    ``documents`` has the columns lang (NULL: ``und``) and text (NULL: empty); others are ignored. A-Z are lower-cased, texts are cut
    at ``. , ; : ! ?`` and line ends into pieces, these at blanks and tabs into words; phrases lie in one piece and occurrences may
    overlap. ``p`` is the list of the words' numbers. Each block of documents has an FM-index over the numbers of its frequent
    words. Its intervals are extended word by word, and of each pattern its words and count go to the shard of
    its key, where those of all blocks are summed; only what is frequent there goes on. An empty table gives empty results.
    """
    source = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    schema = "block long, lang string, n_words long, ids binary, words binary, counts binary, size long"
    blocks = stage_bucketed(source.mapInArrow(_read_blocks, schema), "block", "phrase-blocks")
    size = blocks.agg(F.sum("size").alias("words"), F.sum("n_words").alias("n")).first()
    word_shards, shards = shard_count(size["words"]), shard_count(size["n"])

    counted = stage(_count_words(blocks, word_shards, min_count), "words")
    replies = counted.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "ids"))).alias("replies"))
    numbered = stage_bucketed(replies, "block", "block-words")
    ready = blocks.select("block", "lang", "ids", "words").join(numbered.hint("merge"), "block")

    pairs = _summed(ready.mapInArrow(_send_pairs(shards, word_shards), _TALLY_SCHEMA), shards, min_count, reply=True)
    told = pairs.where("block is not null").select("block", "shard", "ids")
    longer = ready.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_send_longer(shards, word_shards), _TALLY_SCHEMA)
    longer = _summed(longer, shards, min_count, reply=False)

    words = counted.where("block is null").select("lang", F.array("id").alias("p"), F.col("word").alias("phrase"), "f", "id")
    left, right = F.shiftrightunsigned("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right")

    def composed(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
        """Phrases whose key holds the id of a phrase in ``first`` and that of the rest in ``second``."""
        a = first.select(F.col("id").alias("left"), "lang", F.col("p").alias("p1"), F.col("phrase").alias("phrase1"))
        b = second.select(F.col("id").alias("right"), F.col("p").alias("p2"), F.col("phrase").alias("phrase2"))
        met = rows.select("id", "f", left, right).join(a, "left").join(b, "right")
        return met.select("lang", F.concat("p1", "p2").alias("p"), F.concat_ws(" ", "phrase1", "phrase2").alias("phrase"), "f", "id")

    twos = stage(composed(pairs.where("block is null"), words, words), "pairs")
    threes = composed(longer.where("size = 3"), twos, words)
    fours = composed(longer.where("size = 4"), twos, twos)
    parts = [d.select("lang", "p", "phrase", "f") for d in (words, twos, threes, fours)]
    phrases = stage(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]), "phrases")
    return phrases, blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of 2 to 4 words that occur ``min_count`` times or more, as longs.

    Of the cuts into a first part and a rest the one of the lowest floor(2000000 a / (l + r)) counts, the earlier of equal ones;
    products are decimals, so nothing passes 64 bits. A phrase goes if a longer frequent one that holds it has ``covered`` hundredths
    of its count or more; as counts only fall with each word added, it is enough to look at those with one word more.
    """
    phrases, words = frequent_phrases(documents, min_count)
    candidates = phrases.where(F.size("p") > 1)
    f = phrases.select(F.col("p").alias("part"), F.col("f").alias("count"))
    cuts = candidates.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("rest"))
    cuts = cuts.join(f.withColumnsRenamed({"part": "first", "count": "l"}), "first").join(f.withColumnsRenamed({"part": "rest", "count": "r"}), "rest")
    exact = F.expr("cast((cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0)) as long)")
    best = cuts.select("p", F.struct(exact.alias("score"), "k", "l", "r").alias("cut")).groupBy("p").agg(F.min("cut").alias("cut"))

    longer = candidates.where(F.size("p") > 2)
    ends = F.array(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1))
    within = longer.select(F.explode(ends).alias("p"), "f").groupBy("p").agg(F.max("f").alias("holder"))
    kept = candidates.join(within, "p", "left").where("holder is null or 100 * holder < %d * f" % covered)
    chosen = kept.join(best, "p").join(words, "lang")
    return chosen.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score and count, both falling, and phrase; ``rank`` counts from 1.

    A language's rows are first ranked in SALTS groups, so no task sorts all of a large one.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.drop("__salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language in all documents."""
    return ranked(collocations(table(spark, sf_dir, "documents")))


CHECK_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, rowid_ AS doc, unnest(list_zip(parts, range(len(parts)))) AS piece
    FROM (SELECT lang, row_number() OVER () AS rowid_,
                 regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[.,;:!?\x0A-\x0D]') AS parts
          FROM documents)
), split AS (
    SELECT lang, regexp_extract_all(piece[1], '[^\x20\x09]+') AS w FROM pieces
), counted AS (
    SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
    GROUP BY ALL
), total AS (
    SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang
), frequent AS (
    SELECT * FROM counted WHERE f >= 30
), cuts AS (
    SELECT c.lang, c.p, c.f AS a, k, a.f AS l, b.f AS r, (2000000::HUGEINT * c.f) // (a.f + b.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM frequent WHERE m > 1) c
    JOIN frequent a ON a.lang = c.lang AND a.p = c.p[1:k]
    JOIN frequent b ON b.lang = c.lang AND b.p = c.p[k + 1:c.m]
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), holders AS (
    SELECT lang, p, max(f) AS holder FROM (
        SELECT lang, p[1:m - 1] AS p, f FROM frequent WHERE m > 2 UNION ALL
        SELECT lang, p[2:m] AS p, f FROM frequent WHERE m > 2 UNION ALL
        SELECT lang, p[1:2] AS p, f FROM frequent WHERE m = 4 UNION ALL
        SELECT lang, p[2:3] AS p, f FROM frequent WHERE m = 4 UNION ALL
        SELECT lang, p[3:4] AS p, f FROM frequent WHERE m = 4)
    GROUP BY ALL
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score,
             row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank
      FROM best b JOIN total USING (lang) LEFT JOIN holders h ON h.lang = b.lang AND h.p = b.p
      WHERE h.holder IS NULL OR 100 * h.holder < 80 * a)
WHERE rank <= 2000
"""
