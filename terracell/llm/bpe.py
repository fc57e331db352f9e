"""Byte-level BPE encoding and decoding as tree reductions over a monoid.

The elements of the monoid are texts cut into pieces (matches of the split pattern) with each piece's
tokens; the product of two neighbours is the element of their joined text. A document is halved until
its parts are short, the parts are encoded, and neighbours are joined on the way up, on two levels:

* *Pieces.* A cut may have fallen inside a piece, or have hidden from the pattern what comes next. A
  join drops the left side's last pieces, as far back as the pattern looks ahead (LOOK characters),
  and splits a window from there into the right side anew. It doubles the window until a new
  boundary falls on one of the right side's, so far before the window's end that nothing behind can
  matter. What the pattern matches hangs on the text from the match's start on only, so from that
  boundary on the right side's pieces stand, and before the window the left side's do.
* *Tokens of a piece.* A new piece is halved itself, and neighbouring token sequences are joined: a
  window around the boundary is encoded anew and doubled until its outermost tokens are those that
  stood there before. Every adjacent pair of the joined sequence then occurs in a sequence that
  the merges made, which is what fixes a token sequence of a vocabulary whose tokens all encode to
  themselves (a test checks the rank file); so the tokens outside the window keep their places. A
  long piece that is made of pieces of both sides is the product of their token sequences.

Decoding turns short blocks of ids into bytes and concatenates neighbours up the tree.

Defined results: null text is empty text and has no ids; the pieces of a text never share tokens;
special tokens' strings are ordinary text; a text of any length is encoded whole; repeated rows and
rows without an id have results of their own; an empty table gives an empty one. Extra columns of
the input are kept out of the way: an operator reads the columns it is told and adds its own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, slices

#: Bytes up to which a part is encoded directly.
LEAF = 12
#: Characters up to which a part of a document is encoded directly, and tokens that a block decodes directly.
PART, BLOCK = 1_024, 256
#: Characters behind a match, at most, that the split pattern looks at.
LOOK = 8
#: Tokens on each side of a boundary that the first window holds.
WINDOW = 3
#: Outermost tokens of a window that must be the old ones before the join stops.
MARGIN = 2
#: Rank of a pair that is no token.
NEVER = 1 << 40
#: Pieces that a worker remembers (up to twice as many for a while), and the longest of them in characters.
REMEMBERED, LONGEST = 150_000, 48


def reduce_tree(parts: list, join: Callable, empty):
    """Combine neighbours, then neighbours of the results, until one is left."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else empty


class ByteBpe:
    """Encoder and decoder for a file of ``base64(token) rank`` lines."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.packed = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.pieces = _Pieces(self)

    def self_encoding(self) -> bool:
        """Whether each token is what its own bytes encode to, as the joins need."""
        return all(self._merge_heap(t) == [t] for t in self.ranks)

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of a few bytes: merge the adjacent pair of lowest rank, the leftmost first."""
        if data in self.ranks:
            return [data]
        if len(data) > 2 * LEAF:
            return self._merge_heap(data)
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merge_heap(self, data: bytes) -> list[bytes]:
        """The same for a long window, in n log n: a heap of pairs over a linked list."""
        n, ranks = len(data), self.ranks
        part, nxt, prv = [data[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] is not a or j >= n or part[j] is not b:
                continue
            part[i], part[j] = a + b, None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            h = prv[i]
            if h >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [p for p in part if p is not None]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Product of two token sequences."""
        if not left or not right:
            return left or right
        width = WINDOW
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merge(b"".join(left[a:]) + b"".join(right[:b]))
            if (a == 0 or middle[:MARGIN] == left[a : a + MARGIN]) and (b == len(right) or middle[-MARGIN:] == right[b - MARGIN : b]):
                return left[:a] + middle + right[b:]
            width *= 2

    def encode_piece(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF or piece in self.ranks:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def element(self, text: str) -> tuple[list[str], list[bytes]]:
        """Pieces of a text, and each one's packed ids."""
        if len(text) <= PART:
            found = self.pattern.findall(text)
            return found, list(map(self.pieces.__getitem__, found))
        half = len(text) // 2
        return self.product(self.element(text[:half]), self.element(text[half:]))

    def product(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """The element of two neighbouring texts from theirs."""
        pieces, after = left[0], right[0]
        at, dropped = len(pieces), 0
        while at and dropped < LOOK:
            at -= 1
            dropped += len(pieces[at])
        tail, width = "".join(pieces[at:]), 4
        while True:
            window = tail + "".join(after[:width])
            found = self.pattern.findall(window)
            whole = width >= len(after)
            sure = len(window) if whole else len(window) - LOOK
            # Walk along the new boundaries and the right side's until two meet.
            i, j, here, there = 0, 0, 0, len(tail)
            while i < len(found) and (here < there or here < len(tail)):
                here += len(found[i])
                i += 1
                while there < here and j < width and j < len(after):
                    there += len(after[j])
                    j += 1
            if here == there and here <= sure:
                break
            width *= 2
        parts = list(zip((*pieces[at:], *after[:j]), (*left[1][at:], *right[1][:j])))
        return pieces[:at] + found[:i] + after[j:], left[1][:at] + self._coded(found[:i], parts) + right[1][j:]

    def _coded(self, found: list[str], parts: list[tuple[str, bytes]]) -> list[bytes]:
        """Packed ids of new pieces; long ones are products of old ones, where these make them up."""
        out, k, ahead = [], 0, 0
        for piece in found:
            began = ahead == 0
            first = k
            ahead += len(piece)
            while k < len(parts) and ahead >= len(parts[k][0]):
                ahead -= len(parts[k][0])
                k += 1
            if len(piece) > LONGEST and began and ahead == 0:
                out.append(self._packed(reduce_tree([self._tokens(c) for _, c in parts[first:k]], self.join, [])))
            else:
                out.append(self.pieces[piece])
        return out

    def _tokens(self, packed: bytes) -> list[bytes]:
        return list(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def _packed(self, tokens: list[bytes]) -> bytes:
        return b"".join(map(self.packed.__getitem__, tokens))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > REMEMBERED:
            self.pieces = _Pieces(self, self.pieces)
        return b"".join(self.element(text)[1])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a whole sequence of ids: blocks of tokens, concatenated up the tree."""
        all_, tokens = np.frombuffer(ids, "<u4").tolist(), self.tokens.__getitem__
        blocks = [b"".join(map(tokens, all_[i : i + BLOCK])) for i in range(0, len(all_), BLOCK)]
        return reduce_tree(blocks, bytes.__add__, b"")


class _Pieces(dict):
    """Packed ids of the pieces met lately, and in ``old`` of those met before them."""

    def __init__(self, bpe: ByteBpe, old: _Pieces | None = None) -> None:
        super().__init__()
        self.bpe, self.old = bpe, old if old is not None else {}
        if old is not None:
            old.old = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.bpe._packed(self.bpe.encode_piece(piece.encode()))
        if len(piece) <= LONGEST:
            self[piece] = packed
        return packed


_ready: dict[int, ByteBpe] = {}


def _bpe(shared, pattern: str) -> ByteBpe:
    """The worker's own encoder, built once from the broadcast rank file."""
    key = hash((shared.value, pattern))
    if key not in _ready:
        _ready.clear()
        _ready[key] = ByteBpe(shared.value, pattern)
    return _ready[key]


def encode_documents(df: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary, 4 bytes a token) of every row.

    The rank file is a fixed vocabulary of about a megabyte, so it is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [bpe.encode(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, the ids and ``decoded`` (binary): the bytes that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [bpe.decode(x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(df[id_col].alias("id"), df[ids_col].alias("ids")), run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def round_trip_documents(df: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` of every row: both directions in one pass over the texts.

    The same as decoding the result of encoding, with one Python worker a task instead of two.
    """
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [bpe.encode(x or "") for x in part.column("text").to_pylist()]
                out = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)
