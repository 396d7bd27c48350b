"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is split in halves down to leaves; a leaf is encoded directly; two neighbours are joined by encoding anew a
window round their seam. Two facts say when tokens outside the window are final:

* Pieces. A position where a character that isn't white space is followed by a space or a newline is a border of pieces
  in every text (see borders.py). The window grows until both its ends are such borders, or ends of the joined span.
* Tokens within one long piece. A token sequence is the encoding of its bytes if and only if every two neighbours are
  the encoding of theirs. So the window of tokens doubles until the pairs at both its ends hold.

Decoding concatenates the bytes of the tokens, up the same tree. Ids are held as packed 32-bit integers.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .borders import BORDER, COMMON, PIECE, PieceCache, left_border, right_border
from .common import process_cache, slices

LEAF_CHARS = 2048
LEAF_BYTES = 256
#: Windows longer than this hold some very long piece; they're split into pieces one by one.
DIRECT_CHARS = 8192
#: White space as the tokenizers' regular expressions define it (fixed: Unicode White_Space).
UNICODE_SPACE = r"\t-\r \x85\xa0  -     　"


def packed(ids) -> bytes:
    return np.asarray(ids, dtype=np.int32).tobytes()


class TreeCodec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, direct_chars: int = DIRECT_CHARS):
        import regex
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # takes any text for one piece
        self.whole = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.table[i] = piece
        self.leaf_chars, self.leaf_bytes, self.direct_chars = max(2, leaf_chars), max(2, leaf_bytes), direct_chars
        exact = pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(r"\S", f"[^{UNICODE_SPACE}]").replace(r"\s", f"[{UNICODE_SPACE}]")
        self.pieces = regex.compile(exact)
        self.cache = PieceCache(self._one)

    @classmethod
    def load(cls, path: str, pattern: str, **options) -> TreeCodec:
        cache, key = process_cache(), ("codec", path, pattern, *sorted(options.items()))
        if key not in cache:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            cache[key] = cls(ranks, pattern, **options)
        return cache[key]

    # one long piece, as bytes

    def _pair_holds(self, left: int, right: int) -> bool:
        return self._leaf(self.table[left] + self.table[right]) == [left, right]

    def _leaf(self, piece: bytes) -> list[int]:
        """Ids of a piece: by the library if the bytes are a text; parts cut within a character are merged here."""
        try:
            return self.whole.encode_ordinary(piece.decode())
        except UnicodeDecodeError:
            return self.merged(piece)

    def merged(self, piece: bytes) -> list[int]:
        """The pair of the lowest rank, the leftmost of equals, is joined until none has a rank."""
        n, rank = len(piece), self.ranks.get
        end, before = [*range(1, n + 1)], [*range(-1, n)]
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(queue)

        def offer(i: int, stop: int) -> None:
            if (r := rank(piece[i:stop])) is not None:
                heapq.heappush(queue, (r, i, stop))

        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            # a token that was joined to one before it ends nowhere
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            before[stop] = i
            if i:
                offer(before[i], stop)
            if stop < n:
                offer(i, end[stop])
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 8
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = b"".join(map(self.table.__getitem__, left[i:] + right[:j]))
            whole = i == 0 and j == len(right)
            middle = self._leaf(window) if whole or len(window) <= 16 * self.leaf_bytes else self.piece(window)
            if (not i or self._pair_holds(left[i - 1], middle[0])) and (j == len(right) or self._pair_holds(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: leaves of some bytes, joined pair by pair."""
        level = [self._leaf(piece[i : i + self.leaf_bytes]) for i in range(0, len(piece), self.leaf_bytes)]
        while len(level) > 1:
            level = [self._join_tokens(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    # texts

    def _one(self, piece: str) -> bytes:
        data = piece.encode()
        return packed(self._leaf(data) if len(data) <= self.direct_chars else self.piece(data))

    def _direct(self, text: str) -> bytes:
        if COMMON.fullmatch(text):
            return b"".join(map(self.cache.__getitem__, PIECE.findall(text)))
        if len(text) <= self.direct_chars:
            return packed(self.library.encode_ordinary(text))
        return b"".join(self._one(x.group()) for x in self.pieces.finditer(text))

    def _join(self, text: str, low: int, middle: int, high: int, left: bytes, right: bytes) -> bytes:
        a, b = left_border(text, low, middle), right_border(text, middle, high)
        ids, drop = memoryview(left).cast("i"), len(text[a:middle].encode())
        i = len(ids)
        while drop > 0:
            i -= 1
            drop -= len(self.table[ids[i]])
        ids, drop, j = memoryview(right).cast("i"), len(text[middle:b].encode()), 0
        while drop > 0:
            drop -= len(self.table[ids[j]])
            j += 1
        return left[: 4 * i] + self._direct(text[a:b]) + right[4 * j :]

    def _span(self, text: str, low: int, high: int) -> bytes:
        if high - low <= self.leaf_chars:
            return self._direct(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._span(text, low, middle), self._span(text, middle, high))

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids of the whole text; a null text has none."""
        if not text:
            return np.empty(0, dtype=np.int32)
        # the halves of a text without any border would be encoded for nothing
        return np.frombuffer(self._span(text, 0, len(text)) if len(text) <= self.leaf_chars or BORDER.search(text) else self._direct(text), dtype=np.int32)

    def decode(self, ids) -> bytes:
        level = [b"".join(map(self.table.__getitem__, np.asarray(ids[i : i + 65536], dtype=np.int64).tolist())) for i in range(0, len(ids), 65536)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids; null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = TreeCodec.load(path, pattern)
        return pd.Series([codec.encode(x) for x in texts], dtype=object)

    return ids(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes of the ids; null gives null."""

    @F.pandas_udf("binary")
    def data(rows: pd.Series) -> pd.Series:
        codec = TreeCodec.load(path, pattern)
        return pd.Series([None if x is None else codec.decode(x) for x in rows], dtype=object)

    return data(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `ids` array<int> and `decoded` binary (the round trip).

    Null and empty texts have no ids and decode to zero bytes. Rows aren't compared, so repeated rows, ties and null ids
    stay as they are; other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    def both(batches):
        codec = TreeCodec.load(path, pattern)
        for rows in slices(batches):
            ids = [codec.encode(x) for x in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], "ids": pd.Series(ids, dtype=object), "decoded": pd.Series([codec.decode(x) for x in ids], dtype=object)})

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(both, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_column)
