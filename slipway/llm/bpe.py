"""Byte-level BPE by prefix tables.

For every prefix of a piece of text there is one token that ends its encoding. The table of
these last tokens holds the encodings of all prefixes at once: it grows to the right when
text is appended, and after an edit it is filled again only until it agrees with the old one.
Whether a token may follow another is decided from the pair alone, by undoing the merges at
their border, so no merge queue is kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import Remembered, bounded_batches

#: Entries of a generation of a worker's memory of words, and of its memories of prefixes and of pairs.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 1 << 17, 1 << 16
#: Longer words are encoded without being remembered.
REMEMBERED_CHARS = 40

#: Bytes up to which the prefixes of a piece are remembered, and up to which it is worked from its end.
REMEMBERED_BYTES, SHORT = 64, 256
#: Ids are kept as bytes, four each.
ID = np.dtype("<i4")
#: Fixed value: the pattern of the public ranks. None of its matches joins a space to what stands
#: before it if that is no white space, and a space with letters after it is one match.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> bytes:
    """The rank file as it is: a line per token, base64 of its bytes and its rank."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Tokens, the two tokens each was merged from, and which may follow which."""

    def __init__(self, rank_file: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=0)
        self.never = max(self.token_bytes, default=0) + 1
        self.parts: dict[int, tuple[int, int] | None] = {}
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            self._find_parts(token)
        self.pairs: dict[int, bool] = {}
        self.packed = {token: _packed([rank]) for token, rank in self.ranks.items() if rank in self.parts}
        self.reach: dict[bytes, int] = {}
        for token in self.packed:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 1))
        self.prefixes: dict[bytes, bytes] = {}
        self.borders: dict[bytes, bool] = {}

    def forget(self) -> None:
        for memory in (self.pairs, self.prefixes, self.borders):
            memory.clear()

    def _find_parts(self, token: bytes) -> None:
        """A token whose own bytes are not merged to it never occurs and gets no entry."""
        rank = self.ranks[token]
        if len(token) == 1:
            self.parts[rank] = None
            return
        pieces = [token[place : place + 1] for place in range(len(token))]
        while len(pieces) > 2:
            best, place = None, -1
            for at in range(len(pieces) - 1):
                found = self.ranks.get(pieces[at] + pieces[at + 1])
                if found is not None and (best is None or found < best):
                    best, place = found, at
            if best is None:
                return
            pieces[place : place + 2] = [pieces[place] + pieces[place + 1]]
        if all(piece in self.ranks for piece in pieces):
            self.parts[rank] = (self.ranks[pieces[0]], self.ranks[pieces[1]])

    def border_holds(self, left: int, right: int) -> bool:
        """Undo the merges beside the border, latest first; at no time may one cross it.

        The tokens at the border stand side by side until the first of them is merged
        further. A merge of the two would come before that if its rank is lower, or equal
        to that of the right one's next merge, since equal merges go from left to right.
        """
        left_until = right_until = self.never
        while True:
            joined = self.ranks.get(self.token_bytes[left] + self.token_bytes[right])
            if joined is not None and joined < left_until and joined <= right_until:
                return False
            left_parts, right_parts = self.parts[left], self.parts[right]
            if left_parts is None and right_parts is None:
                return True
            if right_parts is not None and (left_parts is None or right >= left):
                right_until, right = right, right_parts[0]
            else:
                left_until, left = left, left_parts[1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of ``data``, which is one piece: merges cross all of it."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int | None] = [None]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is known of shorter prefixes stays as it is."""
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(None)
            token_ending(self.vocabulary, self.data, end, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[start:stop]``; returns how many entries were filled.

        An entry depends on the bytes of one longest token and on the entries at their
        borders. Once that many entries past the edit agree with the old ones, so does
        everything after them.
        """
        old_last, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[: start + 1]
        agreeing = filled = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(None)
            token = token_ending(self.vocabulary, self.data, end, self.last)
            filled += 1
            if end > start + len(new):
                agreeing = agreeing + 1 if old_last[end - shift] == token else 0
                if agreeing >= self.vocabulary.longest:
                    self.last.extend(old_last[end - shift + 1 :])
                    break
        return filled

    def ids(self) -> list[int]:
        return _walk_back(self.vocabulary, self.last, len(self.data))


def _walk_back(vocabulary: Vocabulary, last: list, end: int) -> list[int]:
    found = []
    while end:
        found.append(last[end])
        end -= len(vocabulary.token_bytes[last[end]])
    return found[::-1]


def token_ending(vocabulary: Vocabulary, data: bytes, end: int, last: list[int | None]) -> int:
    """The one token that can end the encoding of the first ``end`` bytes, noted in ``last``.

    Entries of shorter prefixes are filled when a token needs to know what it would follow.
    """
    pairs, ranks = vocabulary.pairs, vocabulary.ranks
    for start in range(max(0, end - vocabulary.reach.get(data[max(0, end - 2) : end], 1)), end):
        token = ranks.get(data[start:end])
        if token not in vocabulary.parts:
            continue
        if start:
            before = last[start]
            if before is None:
                before = token_ending(vocabulary, data, start, last)
            pair = before << 32 | token
            holds = pairs.get(pair)
            if holds is None:
                holds = pairs[pair] = vocabulary.border_holds(before, token)
            if not holds:
                continue
        last[end] = token
        return token
    raise ValueError(f"no token for byte {data[end - 1]}")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype=ID).tobytes()


def _prefix_ids(vocabulary: Vocabulary, data: bytes) -> bytes:
    """Ids of a prefix: those of what its last token follows, which is a shorter prefix, and the token.

    Prefixes are shared: what one word worked out holds for all words that begin alike.
    """
    found = vocabulary.prefixes.get(data)
    if found is not None:
        return found
    for start in range(max(0, len(data) - vocabulary.reach.get(data[-2:], 1)), len(data)):
        token = vocabulary.packed.get(data[start:])
        if token is None:
            continue
        if not start:
            found = token
            break
        before = _prefix_ids(vocabulary, data[:start])
        border = before[-ID.itemsize :] + token
        holds = vocabulary.borders.get(border)
        if holds is None:
            holds = vocabulary.borders[border] = vocabulary.border_holds(*np.frombuffer(border, ID).tolist())
        if holds:
            found = before + token
            break
    if found is None:
        raise ValueError(f"no token for byte {data[-1]}")
    vocabulary.prefixes[data] = found
    return found


def pack_piece(vocabulary: Vocabulary, data: bytes) -> bytes:
    """Ids of one piece, four bytes each. Short ones fill only the entries they need, long ones all in order."""
    whole = vocabulary.packed.get(data)
    if whole is not None:
        return whole
    for memory in (vocabulary.pairs, vocabulary.prefixes, vocabulary.borders):
        if len(memory) > REMEMBERED_PAIRS:
            memory.clear()
    size = len(data)
    if 0 < size <= REMEMBERED_BYTES:
        return _prefix_ids(vocabulary, data)
    last: list[int | None] = [None] * (size + 1)
    for end in range(1 if size > SHORT else max(1, size), size + 1):
        token_ending(vocabulary, data, end, last)
    return _packed(_walk_back(vocabulary, last, size))


def encode_piece(vocabulary: Vocabulary, data: bytes) -> list[int]:
    return np.frombuffer(pack_piece(vocabulary, data), ID).tolist()


class Encoder:
    """Texts to ids.

    With ``SPACED_PATTERN`` a text falls apart at every single space between other
    characters. The ids of short words, with the space before them, are remembered; what is
    new is cut by the pattern. Any other pattern cuts the whole text.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.pieces = regex.compile(pattern).findall
        self.spaced = pattern == SPACED_PATTERN
        self.words = Remembered(self._word, REMEMBERED_WORDS)

    def _by_pattern(self, text: str) -> bytes:
        vocabulary = self.vocabulary
        return b"".join([pack_piece(vocabulary, piece.encode("utf-8", "surrogatepass")) for piece in self.pieces(text)])

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return pack_piece(self.vocabulary, b" " + word.encode())
        return self._by_pattern(" " + word)

    def _other(self, word: str) -> bytes:
        return self.words.other(word) if len(word) <= REMEMBERED_CHARS else self._word(word)

    def forget(self) -> None:
        """Empty the memories: a worker is kept for tasks of other operators."""
        self.words.clear()
        self.vocabulary.forget()

    def packed(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        if not self.spaced:
            return self._by_pattern(text)
        words = text.split(" ")
        if "" in words or list(map(str.strip, words)) != words:
            words = _SINGLE_SPACE.split(text)
        known, other = self.words.young.get, self._other
        ids = [self._by_pattern(words[0])]
        ids += [known(word) or other(word) for word in words[1:]]
        return b"".join(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), ID).tolist()


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in the array column ``out``.

    A null text counts as empty and has no ids. Rows are independent: nothing is shuffled,
    repeated rows come out repeated, other columns pass through, and a column that already
    has the name ``out`` is replaced. ``rank_file`` goes to the tasks as one broadcast of
    fixed size, the file's.
    """
    return _per_text(docs, rank_file, F.coalesce(F.col(text), F.lit("")), pattern, out)


def _per_text(docs: DataFrame, rank_file: bytes, texts: Column, pattern: str, out: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            lists = [encoder.packed(value.as_py()) for value in batch]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(ids) // ID.itemsize for ids in lists], out=offsets[1:])
            values = np.frombuffer(b"".join(lists), ID)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        encoder.forget()

    return docs.withColumn(out, ids_of(texts))


def decode(tokens: DataFrame, rank_file: bytes, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that its ids stand for in the binary column ``out``.

    Null and empty lists give no bytes. An id outside the vocabulary is an error.
    """
    bounded_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(rank_file)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens_of = _token_array(shared.value)
        for batch in batches:
            pieces = tokens_of.take(batch.values)
            if pieces.null_count:
                raise ValueError("an id outside the vocabulary")
            yield pc.binary_join(pa.ListArray.from_arrays(batch.offsets, pieces), b"")

    return tokens.withColumn(out, bytes_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


@lru_cache(maxsize=2)
def _token_array(rank_file: bytes) -> pa.Array:
    """The bytes of every id, at its place; null where no token has that id."""
    lines = (line.split() for line in rank_file.splitlines() if line.strip())
    token_bytes = {int(rank): base64.b64decode(token) for token, rank in lines}
    return pa.array([token_bytes.get(rank) for rank in range(max(token_bytes, default=-1) + 1)], pa.binary())


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of all documents through the multilingual ranks."""
    import public_tokenizers

    from slipway.llm.common import read_table

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
