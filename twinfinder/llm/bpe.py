"""Byte-level BPE encoding and decoding with a given table of ranks.

Texts are cut into pieces by the public pattern of byte-level vocabularies. Every piece is merged on its own: a
segment tree over its byte positions stores the leftmost minimum pair rank; a merge takes the root, joins the two
parts, and updates the tree at the live neighbours, so a piece of n bytes costs O(n log n). Short pieces are merged
many at a time, as rows of one array of trees.

Pieces repeat, so a worker keeps the ids of those it has seen, up to a fixed number of bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfinder.llm.common import slices

NONE = np.int32(2**31 - 1)
SHORT = 64  # pieces of up to so many bytes are merged together
CACHE_BYTES = 24_000_000
UNMERGED = 1 << 62  # above every rank * size + position of a piece, however long
MERGED_TOGETHER = 4_000

WS, LETTER, NUMBER, OTHER, END = range(5)


class Ranks:
    """A vocabulary: the bytes of every id, and which pairs of ids merge into which id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_pairs = np.full(1 << 16, NONE)
        for token, rank in self.ids.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, NONE where it does not."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], NONE)


def load_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks; a file of lines of base64 text and rank, without gaps."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(rows)
    for text, rank in rows:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


# --- pieces ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: white space, letter, number, or other."""
    found = np.full(0x110000, OTHER, dtype=np.uint8)
    for start in range(0, 0x110000, 0x800):  # in slices, of which the surrogates are one
        if start == 0xD800:
            continue
        points = "".join(map(chr, range(start, start + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WS, r"\s+")):
            for match in regex.finditer(pattern, points):
                found[start + match.start() : start + match.end()] = kind
    return found


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts one after the other, and the number of pieces of each text.

    Works like the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`, but
    on whole arrays: runs of one class, a space joined to the run after it, and the contractions.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    whole = "".join(t + "\0" for t in texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    kind = _classes()[codes]
    kind[ends] = END  # stops every run at the end of its text
    widths = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
    widths[ends] = 0
    before = np.empty_like(kind)
    before[0], before[1:] = END, kind[:-1]
    start = kind != before
    # The last white space before something else is on its own, or part of what follows if it is a space.
    after = np.empty_like(kind)
    after[-1], after[:-1] = END, kind[1:]
    last = np.flatnonzero((kind == WS) & (after != WS) & (after != END))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # Contractions begin where a piece of one apostrophe would.
    quotes = np.flatnonzero((codes == 39) & start & (kind == OTHER))
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(3, dtype=np.uint32)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), dtype=np.uint32))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for found, length in ((quotes[short], 2), (quotes[long], 3)):
            start[found + 1] = False
            start[found + length] = True
    start[ends] = True
    at = np.flatnonzero(start)
    edges = np.cumsum(widths, dtype=np.int64)[at] - widths[at]  # byte where each piece starts
    raw = "".join(texts).encode("utf-8", "surrogatepass")
    cuts = edges.tolist()
    found = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
    marks = np.searchsorted(at, ends)  # the empty piece that stands for the end of each text
    counts = np.diff(np.concatenate([[-1], marks]))
    return found, counts


# --- merging -----------------------------------------------------------------------------------------------------


def merge_together(short: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of pieces of at most SHORT bytes, each as little-endian unsigned 32-bit integers."""
    size = 2
    while size < max(map(len, short)):
        size *= 2
    n = len(short)
    lengths = np.array([len(p) for p in short])[:, None]
    chars = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in short), dtype=np.uint8).reshape(n, size)
    place = np.arange(size, dtype=np.int32)
    ids = np.where(place < lengths, ranks.byte_ids[chars], -1).ravel()
    after = np.where(place + 1 < lengths, place + 1, size).astype(np.int32).ravel()
    before = np.tile(place - 1, n)
    # Leaves hold rank * size + position, so that the minimum is the leftmost of the lowest rank.
    leaves = np.full((n, size), NONE)
    rank = ranks.byte_pairs[chars[:, :-1].astype(np.int32) << 8 | chars[:, 1:]]
    leaves[:, :-1] = np.where((place[:-1] < lengths - 1) & (rank < NONE), rank * size + place[:-1], NONE)
    tree = np.full((n, 2 * size), NONE)
    tree[:, size:] = leaves
    node = size
    while node > 1:
        tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
        node //= 2
    roots = np.arange(n, dtype=np.int64) * (2 * size)
    tree = tree.ravel()

    def update(rows: np.ndarray, places: np.ndarray, values: np.ndarray | np.int32) -> None:
        base, node = roots[rows], places + size
        tree[base + node] = values
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            child = base + 2 * node
            tree[base + node] = np.minimum(tree[child], tree[child + 1])

    def refresh(rows: np.ndarray, left: np.ndarray) -> None:
        """Write the rank of the pair that starts at each live position."""
        cell = rows * size
        right = after[cell + left]
        inside = right < size
        rank = ranks.merged(ids[cell + left], ids[cell + np.where(inside, right, left)])
        update(rows, left, np.where(inside & (rank < NONE), rank * size + left, NONE))

    live = np.flatnonzero(tree[roots + 1] < NONE)
    while len(live):
        best = tree[roots[live] + 1]
        cell, left = live * size, best % size
        right = after[cell + left]
        ids[cell + left] = best // size
        ids[cell + right] = -1
        beyond = after[cell + right]
        after[cell + left] = beyond
        inside = beyond < size
        before[(cell + beyond)[inside]] = left[inside]
        update(live, right, NONE)
        refresh(live, left)
        earlier = before[cell + left]
        inside = earlier >= 0
        refresh(live[inside], earlier[inside])
        live = live[tree[roots[live] + 1] < NONE]
    kept = ids >= 0
    packed = ids[kept].astype("<u4").tobytes()
    cuts = np.concatenate([[0], np.cumsum(kept.reshape(n, size).sum(axis=1)) * 4]).tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def merge_one(piece: bytes, ranks: Ranks) -> bytes:
    """The ids of one long piece, by the same tree in plain lists."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none, pairs = UNMERGED, ranks.pairs
    ids = ranks.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(left: int, right: int) -> int:
        rank = pairs.get(ids[left] << 32 | ids[right]) if right < n else None
        return none if rank is None else rank * size + left

    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = key(i, i + 1)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def update(at: int, value: int) -> None:
        at += size
        tree[at] = value
        while at > 1:
            at >>= 1
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low

    while tree[1] < none:
        rank, left = divmod(tree[1], size)
        right = after[left]
        beyond = after[right]
        ids[left], ids[right], after[left] = rank, -1, beyond
        if beyond < n:
            before[beyond] = left
        update(right, none)
        update(left, key(left, beyond))
        if before[left] >= 0:
            update(before[left], key(before[left], left))
    return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


class Encoder:
    """Encodes texts, remembering the pieces it has met until they take CACHE_BYTES."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.known: dict[bytes, bytes] = {b"": b""}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        found, counts = pieces(texts)
        ids = list(map(self.known.get, found))
        new = [at for at, known in enumerate(ids) if known is None]
        if new:
            self._learn({found[at] for at in new})
            for at in new:
                ids[at] = self.known[found[at]]
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        result = [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        if self.held > CACHE_BYTES:
            self.known, self.held = {b"": b""}, 0
        return result

    def _learn(self, new: set[bytes]) -> None:
        whole = self.ranks.ids
        open_pieces = []
        for piece in new:
            rank = whole.get(piece)
            if rank is not None:  # a piece that is a token needs no merges
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(piece) > SHORT:
                self.known[piece] = merge_one(piece, self.ranks)
            else:
                open_pieces.append(piece)
        open_pieces.sort(key=len)  # pieces of like length share a group
        for a in range(0, len(open_pieces), MERGED_TOGETHER):
            group = open_pieces[a : a + MERGED_TOGETHER]
            self.known.update(zip(group, merge_together(group, self.ranks)))
        self.held += sum(len(p) + len(self.known[p]) + 120 for p in new)


@lru_cache(maxsize=2)
def _encoder(path: str, tokens: tuple[bytes, ...]) -> Encoder:
    """One encoder for all tasks of a worker process, so that pieces met by one are known to the next."""
    return Encoder(Ranks(list(tokens)))


def decode_ids(packed: bytes, ranks: Ranks) -> bytes:
    """The bytes of ids packed as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
    lengths = ranks.lengths[ids]
    total = int(lengths.sum())
    shift = ranks.starts[ids] - (np.cumsum(lengths) - lengths)
    return ranks.flat[np.arange(total) + np.repeat(shift, lengths)].tobytes()


# --- columns -----------------------------------------------------------------------------------------------------


class ByteBpe:
    """A vocabulary on a session: `encode` and `decode` turn columns of texts and ids into each other.

    The token list is broadcast once; it is the vocabulary, whose size does not depend on the data. `encode` gives
    the ids as a binary column of little-endian unsigned 32-bit integers, the format of a token file; a null text
    counts as empty and gives no ids. `decode` gives the bytes of such a column; null gives null. `round_trip` is a
    struct of both (`ids`, and `decoded` from these ids) from one pass, so that a task holds one worker with one
    vocabulary. Texts of any length are encoded whole. Other columns are not touched, so their names cannot clash.
    """

    def __init__(self, spark: SparkSession, path: str):
        tokens = spark.sparkContext.broadcast(tuple(load_ranks(path)))

        def ids_of(batch: pa.Array, encoder: Encoder) -> list[bytes]:
            texts = [t or "" for t in batch.to_pylist()]
            return [ids for a, b in slices(texts) for ids in encoder.encode(texts[a:b])]

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(path, tokens.value)
            for batch in batches:
                yield pa.array(ids_of(batch, encoder), pa.binary())

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ranks = _encoder(path, tokens.value).ranks
            for batch in batches:
                yield pa.array([None if x is None else decode_ids(x, ranks) for x in batch.to_pylist()], pa.binary())

        def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(path, tokens.value)
            for batch in batches:
                ids = ids_of(batch, encoder)
                decoded = pa.array((decode_ids(x, encoder.ranks) for x in ids), pa.binary())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

        self._encode = F.arrow_udf(encode, "binary")
        self._round_trip = F.arrow_udf(round_trip, "struct<ids: binary, decoded: binary>")
        self._decode = F.arrow_udf(decode, "binary")

    def encode(self, text: Column | str) -> Column:
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        return self._decode(ids)

    def round_trip(self, text: Column | str) -> Column:
        return self._round_trip(text)


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the ids of every text and the bytes that they decode to; columns of these names are replaced."""
    both = ByteBpe(docs.sparkSession, path).round_trip(F.col(text))
    return docs.withColumns({ids: both["ids"], decoded: both["decoded"]})
