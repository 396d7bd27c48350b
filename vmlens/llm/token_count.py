"""Token counts by overlap resynchronisation.

A huge document (more than CHUNK_CHARS) is cut into overlapping chunks. Every chunk is encoded whole by the library, with offsets. Two neighbours
are spliced at a position of their overlap where a token starts in both and which is proven to be a token boundary of the
whole text: tokens before it come from the left chunk, tokens from it on from the right one. Where there is none, the
overlap is widened, and when it has reached the last splice, the left chunk is made longer, up to the rest of the text.

Proofs of a boundary, for byte-level vocabularies:

* A character that isn't white space, followed by a space or newline, ends a piece in every text (borders.py), and so does
  a letter, digit or mark followed by another of these classes, if it's no apostrophe.
* Within a run of letters, digits or marks, some characters off its ends in both chunks, there is one piece in every view.
  A sequence of tokens is a piece's encoding if and only if every two neighbours are the encoding of theirs; so the two
  sides join where the pair of tokens at the position holds. This is what cuts long texts without any white space.

For sentencepiece models whose pieces hold no space but in front (checked on the vocabulary and by trials), a space between
two ASCII letters or digits is a boundary. Texts for other libraries' pipelines are encoded whole.

Documents that fit a chunk are counted whole. For byte-level vocabularies, those of common characters are split into pieces
as the library's pattern does (borders.py), and each distinct piece is encoded once by the library.
"""

from __future__ import annotations

import bisect
import os
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .borders import COMMON, MARK, PIECE, PieceCache
from .common import process_cache, slices

CHUNK_CHARS = 16384
OVERLAP_CHARS = 256
OVER_LIMIT = 512
#: Characters of a run that must stand on both sides of a splice within it: no alternative of the pattern is longer there.
INSIDE = 4
#: Runs of one class in every Unicode version: letters (Latin, Greek, Cyrillic, Hebrew, Arabic, kana, Han, Hangul), digits, marks.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яא-תء-غぁ-ゖァ-ヺ一-龥가-힣"
RUN = re.compile(f"[{LETTER}]+|[0-9]+|[{MARK}]+")
BORDER = re.compile(r"(?<=\S)[ \n]")
CHANGE = re.compile(f"(?<=[{LETTER}])[0-9{MARK}]|(?<=[0-9])[{LETTER}{MARK}]|(?<=[{MARK}])(?<!')[0-9{LETTER}]")
MODEL_BORDER = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Encoded:
    """A chunk text[low:high]: the first character of every token, in the text, and the tokens."""

    def __init__(self, low: int, high: int, starts: list[int], ids: list[int]):
        self.low, self.high, self.starts, self.ids = low, high, starts, ids

    def before(self, at: int) -> int:
        """Tokens that start before a position."""
        return bisect.bisect_left(self.starts, at)

    def starts_at(self, at: int) -> bool:
        k = self.before(at)
        return k < len(self.starts) and self.starts[k] == at


class ByteLevel:
    """A tokenizers file of byte-level BPE: offsets are characters of the text."""

    def __init__(self, model):
        self.model = model
        added = model.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        self.reach = max([0, *map(len, self.special)])
        self.cache = PieceCache(lambda piece: len(model.encode(piece, add_special_tokens=False)))

    def lengths(self, texts: list[str]) -> list[int]:
        out = [sum(map(self.cache.__getitem__, PIECE.findall(x))) if self._common(x) else -1 for x in texts]
        rest = iter(self.model.encode_batch_fast([x for x, n in zip(texts, out) if n < 0], add_special_tokens=False))
        return [len(next(rest)) if n < 0 else n for n in out]

    def _common(self, text: str) -> bool:
        return bool(COMMON.fullmatch(text)) and not any(x in text for x in self.special)

    def encode(self, text: str, low: int, high: int) -> Encoded:
        got = self.model.encode(text[low:high], add_special_tokens=False)
        # the tokens of one character's bytes all have its offset
        return Encoded(low, high, [low + a for a, _ in got.offsets], got.ids)

    def splice(self, text: str, left: Encoded, right: Encoded, after: int) -> int | None:
        """The last proven boundary of the overlap beyond `after`."""
        low = max(after, right.low) + 1
        for border in (BORDER, CHANGE):
            for m in reversed(list(border.finditer(text, low, left.high))):
                at = m.start()
                if left.starts_at(at) and right.starts_at(at) and (border is BORDER or not self._special(text, at)):
                    return at
        for run in reversed(list(RUN.finditer(text, low, left.high))):
            for at in range(run.end() - INSIDE, run.start() + INSIDE - 1, -1):
                if left.starts_at(at) and right.starts_at(at) and self._joins(text, left, right, at):
                    return at
        return None

    def _special(self, text: str, at: int) -> bool:
        """Is the position near a special string? None has a space or newline inside."""
        around = text[max(0, at - self.reach) : at + self.reach]
        return any(x in around for x in self.special)

    def _joins(self, text: str, left: Encoded, right: Encoded, at: int) -> bool:
        """Are the last token before `at` and the first one from it on neighbours in some encoding? Then they are the encoding of theirs.

        What is encoded is the characters that these tokens are of, with all tokens of these.
        """
        i, j = left.before(at), right.before(at)
        low, high = left.starts[i - 1], right.starts[right.before(at + 1)] if right.before(at + 1) < len(right.starts) else right.high
        around = text[low:high]
        if not RUN.fullmatch(around) or self._special(text, at):
            return False
        return self.model.encode(around, add_special_tokens=False).ids == left.ids[left.before(low) : i] + right.ids[j : right.before(high)]


class Pieces:
    """A sentencepiece model. It gives texts a space in front, so what follows a border's space is encoded as if a text began there."""

    def __init__(self, model):
        self.model = model
        inner = any("▁" in model.id_to_piece(i)[1:].lstrip("▁") for i in range(model.get_piece_size()))
        trials = ["a b", "a1 2b c", "Zx yz", "end of the text"]
        self.cuts = not inner and all(self._ids(x[:k]) + self._ids(x[k + 1 :]) == self._ids(x) for x in trials for k in [m.start() for m in MODEL_BORDER.finditer(x)])

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(self._ids(x)) for x in texts]

    def encode(self, text: str, low: int, high: int) -> Encoded:
        got = self.model.encode(text[low:high], return_type="offset_mapping")
        return Encoded(low, high, [low + a for a, _ in got["offsets"]], got["ids"])

    def splice(self, text: str, left: Encoded, right: Encoded, after: int) -> int | None:
        for m in reversed(list(MODEL_BORDER.finditer(text, max(after, right.low) + 1, left.high))):
            if m.end() < left.high and left.starts_at(m.start()) and right.starts_at(m.start()):
                return m.start()
        return None


class Whole:
    """Any other tokenizers file: what it does to a text's ends isn't known, so texts aren't cut."""

    def __init__(self, model):
        self.model = model

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Counter:
    """Tokens as a library gives them, without special tokens added; special strings as is the library's default."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap = max(1, chunk), max(1, overlap)
        #: chunks that were made longer and overlaps that were widened, for tests and figures
        self.widened = 0
        if path.endswith(".model"):
            import sentencepiece

            self.library = Pieces(sentencepiece.SentencePieceProcessor(model_file=path))
            self.cuts = self.library.cuts
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.cuts = type(model.pre_tokenizer).__name__ == "ByteLevel" and model.normalizer is None and not model.pre_tokenizer.add_prefix_space
            self.library = ByteLevel(model) if self.cuts else Whole(model)

    @classmethod
    def load(cls, path: str, **options) -> Counter:
        cache, key = process_cache(), ("counter", path, *sorted(options.items()))
        if key not in cache:
            cache[key] = cls(path, **options)
        return cache[key]

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def counts(self, texts) -> list[int]:
        """Tokens of each whole text; null and empty ones have none."""
        out = [0] * len(texts)
        short = [i for i, x in enumerate(texts) if x and not (self.cuts and len(x) > self.chunk)]
        for i, n in zip(short, self.library.lengths([texts[i] for i in short])):
            out[i] = n
        for i in set(range(len(texts))) - set(short):
            out[i] = self._spliced(texts[i]) if texts[i] else 0
        return out

    def _spliced(self, text: str) -> int:
        encode, overlap = self.library.encode, self.overlap
        # tokens of `left` before `at`, the last splice, are counted already
        total, at, left = 0, 0, encode(text, 0, self.chunk)
        while left.high < len(text):
            start = max(at, left.high - overlap)
            right = encode(text, start, min(len(text), left.high + self.chunk))
            found = self.library.splice(text, left, right, at)
            if found is not None:
                total += left.before(found) - left.before(at)
                at, left, overlap = found, right, self.overlap
                continue
            self.widened += 1
            overlap *= 2
            if start == at:  # the overlap is all there is
                left = encode(text, left.low, min(len(text), left.high + max(self.chunk, left.high - left.low)))
        return total + len(left.ids) - left.before(at)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = OVER_LIMIT) -> DataFrame:
    """One row per row of `docs`: its id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`).

    Null and empty texts have 0 bytes and 0 tokens. Rows aren't compared, so repeated rows, ties and null ids stay as they
    are; other columns, whatever their names, are not read. An empty table gives an empty result. Memory is bounded by a
    chunk where the text has a provable boundary in its overlaps; a text that has none is encoded in longer chunks, at
    worst whole.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        counter = Counter.load(path)
        return pd.Series([n for part in slices([texts]) for n in counter.counts(part.tolist())], dtype="int64")

    text = F.col(text_column)
    counted = docs.select(F.col(id_column), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
