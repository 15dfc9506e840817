"""Encoding texts to the ids of a SentencePiece model and back, word by word in batched numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine.llm.common import small_text_batches, table

#: Where the query's model lies; only the driver reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are encoded together until they have this many characters.
CHARACTERS = 6_000_000
#: Cells (words x positions x lengths) that one group of words may have.
CELLS = 2_000_000
#: Words that a task remembers.
MEMORY = 600_000
#: Words longer than this are cut where no piece reaches across, and their parts advance with other words.
CUT_FROM = 48
INFINITE = np.int32(2**31 - 1)
LEADING_SHIFT = np.uint64(43)


@dataclass
class PieceTable:
    """What a worker needs of a model, as arrays over piece ids; the last entry stands for an unknown character."""

    text: list[bytes]
    keys: np.ndarray
    key_ids: np.ndarray
    leading: np.ndarray
    hash: np.ndarray
    length: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bytes_first: int
    longest: int
    dummy_prefix: bool
    lines_apart: bool
    pairs: np.ndarray  # of characters that stand next to each other in a piece, sorted

    @property
    def unknown(self) -> int:
        return len(self.hash) - 1


def _hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def _merged(text: str, rank: dict[str, int]) -> list[tuple[str, tuple | None]]:
    """The pieces that merging in rank order, leftmost first, makes of a text, each with the pair it came from."""
    parts: list = [(c, None) for c in text]
    while True:
        best = min(((rank.get(a[0] + b[0], INFINITE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(INFINITE, 0))
        if best[0] == INFINITE:
            return parts
        i = best[1]
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], (parts[i][0], parts[i + 1][0]))]


def load_pieces(path: str) -> PieceTable:
    """The tables of a merge-ranked (BPE) SentencePiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    pieces = {model.id_to_piece(i): i for i in range(size) if i not in special}
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    if len(byte_ids) != 256 or byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError("the model needs 256 byte pieces in a row")
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("pieces that span words are not supported")
    scores = sorted({model.get_score(i) for p, i in pieces.items() if len(p) > 1}, reverse=True)
    by_score = {s: r for r, s in enumerate(scores)}
    rank = {p: by_score[model.get_score(i)] for p, i in pieces.items() if len(p) > 1}

    ranks, left, right = np.full(size + 1, -1, np.int32), np.arange(size + 1, dtype=np.int32), np.arange(size + 1, dtype=np.int32)
    reachable = []
    for piece, i in pieces.items():
        made = _merged(piece, rank)
        if len(made) > 1 or made[0][1] and not all(x in pieces for x in made[0][1]):
            continue  # no text is ever encoded to it
        reachable.append((_hash(piece), i))
        if made[0][1]:
            ranks[i] = rank[piece]
            left[i], right[i] = (pieces[x] for x in made[0][1])
    reachable.sort()
    every, lengths = np.zeros(size + 1, np.uint64), np.ones(size + 1, np.int64)
    leading = np.zeros(1 << (64 - int(LEADING_SHIFT)), bool)
    leading[[h >> int(LEADING_SHIFT) for h, _ in reachable]] = True
    text = [b""] * (size + 1)
    for piece, i in pieces.items():
        every[i], lengths[i], text[i] = _hash(piece), len(piece), piece.encode()
    for value, i in enumerate(byte_ids):
        text[i] = bytes([value])
    return PieceTable(
        text=text,
        keys=np.array([h for h, _ in reachable], np.uint64),
        key_ids=np.array([i for _, i in reachable], np.int32),
        leading=leading,
        hash=every,
        length=lengths,
        rank=ranks,
        left=left,
        right=right,
        bytes_first=byte_ids[0],
        longest=max(map(len, pieces)),
        dummy_prefix=model.id_to_piece(model.encode("a")[0]).startswith(SPACE),
        lines_apart=not any("\n" in p for p in pieces),
        pairs=np.unique(np.concatenate([_pairs(p) for p in pieces])),
    )


def _pairs(word: str) -> np.ndarray:
    """Each character and the next one as a number."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return (codes[:-1] << np.uint64(32)) | codes[1:]


def _cut(t: PieceTable, word: str) -> list[str]:
    """The word in parts whose encodings follow each other in the word's: no merge makes a piece that no piece contains."""
    pairs = _pairs(word)
    at = np.minimum(np.searchsorted(t.pairs, pairs), t.pairs.size - 1)
    ends = [*(np.flatnonzero(t.pairs[at] != pairs) + 1).tolist(), len(word)]
    return [word[a:b] for a, b in zip([0, *ends], ends)]


def _find(t: PieceTable, hashes: np.ndarray) -> np.ndarray:
    """Piece ids of substring hashes, -1 where there is none: a probe of the sorted keys.

    Only hashes whose leading bits some key has are searched for.
    """
    found = np.full(hashes.shape, -1, np.int32)
    likely = np.nonzero(t.leading[(hashes >> LEADING_SHIFT).astype(np.int64)])
    wanted = hashes[likely]
    at = np.minimum(np.searchsorted(t.keys, wanted), t.keys.size - 1)
    found[likely] = np.where(t.keys[at] == wanted, t.key_ids[at], -1)
    return found


def _may_follow(t: PieceTable, powers: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pieces a, b next to each other are what merging makes of their joint text.

    Undoes the merges of both, latest first; at no time may the two parts at the border have had a merge of their
    own that came before the one undone.
    """
    answer = np.ones(a.size, bool)
    active, limit = np.arange(a.size), np.full(a.size, INFINITE, np.int32)
    while active.size:
        joint = _find(t, t.hash[a] * powers[t.length[b]] + t.hash[b])
        joint[(a == t.unknown) | (b == t.unknown)] = -1
        early = (joint >= 0) & (t.rank[joint] < limit)
        answer[active[early]] = False
        rank_a, rank_b = t.rank[a], t.rank[b]
        open_ = ~early & (np.maximum(rank_a, rank_b) >= 0)
        undo_a = rank_a > rank_b
        limit = np.where(undo_a, rank_a, rank_b + 1)[open_]
        a, b = np.where(undo_a, t.right[a], a)[open_], np.where(undo_a, b, t.left[b])[open_]
        active = active[open_]
    return answer


def encode_words(t: PieceTable, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes): the piece ids of word i are ``ids[starts[i] : starts[i] + sizes[i]]``; long words are encoded in parts."""
    parts = {i: _cut(t, w) for i, w in enumerate(words) if len(w) > CUT_FROM}
    if not parts:
        return _encode_whole(t, words)
    whole = [i for i, w in enumerate(words) if len(w) <= CUT_FROM]
    number = {p: len(whole) + k for k, p in enumerate(dict.fromkeys(p for cut in parts.values() for p in cut))}
    ids, first, size = _encode_whole(t, [*(words[i] for i in whole), *number])
    starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    starts[whole], sizes[whole] = first[: len(whole)], size[: len(whole)]
    found, total = [ids], ids.size
    for i, cut in parts.items():
        at = [number[p] for p in cut]
        found += [ids[first[k] : first[k] + size[k]] for k in at]
        starts[i], sizes[i] = total, size[at].sum()
        total += int(sizes[i])
    return np.concatenate(found), starts, sizes


def _encode_whole(t: PieceTable, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``encode_words``.

    Words of equal length advance together. Viterbi over positions: the candidates that end at a position are the
    substrings that are pieces; a candidate counts only if it may follow the best piece that ends where it starts, and
    the longest that counts is the maximum whose length is stored as backpointer. For a merge-ranked model exactly one
    candidate counts at each position, so the path is the model's own encoding.
    """
    ids, starts, sizes, total = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(t.longest, BASE)])  # modulo 2^64, as all hashes
    for length, members in by_length.items():
        group = max(1, CELLS // (length * t.longest))
        for first in range(0, len(members), group):
            chosen = members[first : first + group]
            flat, counts, unknown = _encode_equal(t, powers, [words[i] for i in chosen], length)
            ends = np.cumsum(counts)
            starts[chosen], sizes[chosen] = total + ends - counts, counts
            ids.append(flat)
            total += flat.size
            for k in unknown:
                made = _with_bytes(t, flat[ends[k] - counts[k] : ends[k]], words[chosen[k]])
                starts[chosen[k]], sizes[chosen[k]] = total, made.size
                ids.append(made)
                total += made.size
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), starts, sizes


def _encode_equal(t: PieceTable, powers: np.ndarray, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of words of ``n`` characters, one after the other, how many each has, and which have unknown characters."""
    count = len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(count, n)
    prefix = np.zeros((count, n + 1), np.uint64)
    for i in range(n):
        prefix[:, i + 1] = prefix[:, i] * BASE + codes[:, i] + np.uint64(1)
    last = np.full((count, n + 1), -1, np.int32)
    back = np.zeros((count, n + 1), np.int32)
    for end in range(1, n + 1):
        widths = np.arange(1, min(end, t.longest) + 1)
        piece = _find(t, prefix[:, end, None] - prefix[:, end - widths] * powers[widths])
        piece[:, 0] = np.where(piece[:, 0] < 0, t.unknown, piece[:, 0])
        row, column = np.nonzero(piece >= 0)
        before = last[row, end - widths[column]]
        counts = before < 0
        inner = np.flatnonzero(~counts)
        counts[inner] = _may_follow(t, powers, before[inner], piece[row[inner], column[inner]])
        width = np.zeros(piece.shape, np.int32)
        width[row, column] = np.where(counts, widths[column], 0)
        best = width.argmax(axis=1)
        back[:, end] = width[np.arange(count), best]
        last[:, end] = piece[np.arange(count), best]
    if (back[:, 1:] == 0).any():
        raise ValueError("the pieces of this model are not closed under merging")
    path = np.full((count, n), -1, np.int32)
    at, slot = np.full(count, n), n
    every = np.arange(count)
    while (at > 0).any():
        slot -= 1
        path[:, slot] = np.where(at > 0, last[every, at], -1)
        at = at - back[every, at]
    used = path >= 0
    return path[used], used.sum(axis=1), np.flatnonzero((path == t.unknown).any(axis=1))


def _with_bytes(t: PieceTable, ids: np.ndarray, word: str) -> np.ndarray:
    """Unknown characters replaced by the pieces of their bytes."""
    out, at = [], 0
    for i in ids.tolist():
        if i == t.unknown:
            out += [t.bytes_first + b for b in word[at].encode("utf-8", "surrogatepass")]
        else:
            out.append(i)
        at += int(t.length[i])
    return np.array(out, np.int32)


class _Words(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes lists of texts; remembers the ids of words until MEMORY words are known."""

    def __init__(self, pieces: PieceTable):
        self.pieces = pieces
        self.pattern = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if pieces.lines_apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._forget()

    def _forget(self) -> None:
        self.known = _Words()
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list) -> pa.ListArray:
        """One list of ids per text; NULL for NULL, an empty list for an empty text."""
        if len(self.known) > MEMORY:
            self._forget()
        number, occurrences, sizes = self.known.__getitem__, [], []
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            found = self.pattern.findall((SPACE if self.pieces.dummy_prefix else "") + text.replace(" ", SPACE))
            sizes.append(len(found))
            occurrences.append(np.fromiter(map(number, found), np.int64, len(found)))
        self._learn()
        at = np.concatenate(occurrences) if occurrences else np.zeros(0, np.int64)
        lengths, starts = self.size[at], self.start[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if ends.size else 0
        values = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        words_before = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        offsets = np.r_[0, ends][words_before].astype(np.int32)
        missing = pa.array([text is None for text in texts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)

    def _learn(self) -> None:
        new = list(self.known)[self.size.size :]
        if new:
            ids, starts, sizes = encode_words(self.pieces, new)
            self.start = np.r_[self.start, self.flat.size + starts]
            self.size = np.r_[self.size, sizes]
            self.flat = np.r_[self.flat, ids]


def encode(documents: DataFrame, pieces: PieceTable, text: str = "text", ids: str = "ids") -> DataFrame:
    """``documents`` with the column ``ids`` (array of int, as the model itself encodes the whole text).

    NULL texts give NULL, empty ones an empty array; other columns pass through, ``ids`` replaces one of that name.
    Unknown characters become byte pieces. Texts of any length are encoded whole, together with others until
    CHARACTERS are gathered.
    """
    small_text_batches(documents.sparkSession)
    passed = [f for f in documents.schema.fields if f.name != ids]
    names = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        held, texts, characters = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            made, at = encoder(texts), 0
            for batch in held:
                column = made.slice(at, batch.num_rows)
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, ids])

        for batch in batches:
            new = batch.column(text).to_pylist()
            held.append(batch)
            texts += new
            characters += sum(map(len, filter(None, new)))
            if characters >= CHARACTERS:
                yield from flush()
                held, texts, characters = [], [], 0
        if texts:
            yield from flush()

    return documents.select(*names).mapInArrow(run, T.StructType([*passed, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_lists(pieces: PieceTable, table: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The text of each list of ids, NULL for NULL; ``table`` has ``pieces.text`` as large binaries.

    Taken one after the other, the bytes of all pieces lie in one buffer, of which each text is a stretch.
    """
    taken = table.take(ids.flatten())
    begins = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
    data = taken.buffers()[2].to_pybytes() if len(taken) else b""
    ends = begins[np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))].tolist()
    texts = []
    for first, last, some in zip([int(begins[0]), *ends], ends, ids.is_valid().to_pylist()):
        text = data[first:last].decode("utf-8", "replace").replace(SPACE, " ") if some else None
        texts.append(text[1:] if text and pieces.dummy_prefix and text[0] == " " else text)
    return pa.array(texts, pa.string())


def decode(encoded: DataFrame, pieces: PieceTable, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``: exactly the encoded text, but that U+2581 comes back as a blank."""
    small_text_batches(encoded.sparkSession)
    passed = [f for f in encoded.schema.fields if f.name != ids]
    names = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.text, pa.large_binary())
        for batch in batches:
            if batch.num_rows:
                made = decode_lists(pieces, table, batch.column(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], names=[*names, text])

    return encoded.select(*names, ids).mapInArrow(run, T.StructType([*passed, T.StructField(text, T.StringType())]))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and a digest of its ids, and whether decoding gives the text back."""
    pieces = load_pieces(MODEL)
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    digest = encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_digest": F.xxhash64("ids")})
    back = decode(digest, pieces)
    expected = F.replace("text", F.lit(SPACE), F.lit(" "))
    return back.select("doc_id", "n_tokens", "ids_digest", F.col("decoded").eqNullSafe(expected).alias("round_trip"))
