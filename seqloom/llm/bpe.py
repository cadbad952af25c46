"""Byte-level BPE: exact encoding in linear time, and decoding.

A text is cut by the tokenizer's pattern, and each piece is encoded by itself. Bytes are mapped to Latin-1 characters, so
that a pyahocorasick automaton over the vocabulary finds all tokens at all places of a piece in one pass, of which the longest
at each place is noted. From the left the longest token is tried first; it stands if it is compatible with the token before
it, that is, if merging by rank would leave the boundary between the two alone. If it is not, the next shorter token is tried,
and without one the token before is taken back; places from which no encoding goes on are marked and never tried again.
Compatibility of two adjacent tokens depends on nothing else and is memoised. Frequent pieces are kept with their ids.

Defined cases: null and empty texts have no ids and decode to no bytes; texts with unpaired surrogates can't be stored in
Parquet and don't arise; long runs without white space are one piece, encoded in linear time; repeated rows encode alike;
empty tables give empty results; other columns are not read. Decoding joins the tokens' bytes; unknown ids raise.
Encoding is a map over rows: no shuffle. The vocabulary, whose size is fixed, is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common

_CACHE = 200_000
#: Under this pattern a text may be cut before each space, provided that no space is followed by white space: a piece has a
#: space at its start only, and of a run of white space before a word just the last space goes to the word.
_CUT_AT_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_DOUBLE = regex.compile(r" \s")


class Recent(dict):
    """A cache of two generations: when one is full it becomes the old one, from which what is used comes back. Keys of
    over `most` characters aren't kept."""

    def __init__(self, make: Callable[[str], object], most: int, size: int = _CACHE) -> None:
        self.make, self.most, self.size, self.old = make, most, size, {}

    def __missing__(self, key: str) -> object:
        if len(key) > self.most:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Token bytes by rank, from a file of lines of base64 and rank that lies beside the driver."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are expected to be 0, 1, 2, ...")
    return [ranks[k] for k in range(len(ranks))]


def splits(tokens: list[bytes]) -> list[tuple[int, int]]:
    """The last merge that makes each token; bytes, and tokens that no merge makes, are their own halves."""
    rank = {t: k for k, t in enumerate(tokens)}
    out = []
    for k, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((rank.get(a + b, k), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(k, 0))
            if best[0] >= k:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out.append((rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (k, k))
    return out


class Encoder:
    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int]], pattern: str) -> None:
        self.tokens, self.halves, self.pattern = tokens, halves, regex.compile(pattern)
        self.lengths = [len(t) for t in tokens]
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.pair = {h: k for k, h in enumerate(halves) if h[0] != k}
        self.by_text = {t.decode("latin-1"): k for k, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for text, k in self.by_text.items():
            self.automaton.add_word(text, k)
        self.automaton.make_automaton()
        #: Of each token, the longest token that it starts with, other than itself; -1 without one.
        self.shorter = [next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1) for t in tokens]
        self.memo: dict[int, bool] = {}  # by left * len(tokens) + right
        self.names = [str(k) for k in range(len(tokens))]
        self.pieces, self.runs = Recent(self.piece, 32), Recent(self.run, 40)

    def compatible(self, left: int, right: int) -> bool:
        """Would merging the bytes of both by rank end in these two tokens?"""
        key = left * len(self.tokens) + right
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= 400_000:
                self.memo.clear()
            found = self.memo[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges of both sides, latest first; at each step a merge across the boundary must not come earlier
        # than the merges already undone.
        limit = len(self.tokens)
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, undone = left, self.halves[left][1]
                if undone == left:
                    limit, undone = right + 1, self.halves[right][0]
                    if undone == right:
                        return True
                    right = undone
                else:
                    left = undone
            else:
                limit, undone = right + 1, self.halves[right][0]
                if undone == right:
                    limit, undone = left, self.halves[left][1]
                    if undone == left:
                        return True
                    left = undone
                else:
                    right = undone

    def encode_piece(self, data: bytes) -> list[int]:
        return self._encode(data.decode("latin-1"))

    def _encode(self, text: str) -> list[int]:
        """Of a piece's bytes as Latin-1."""
        whole = self.by_text.get(text)
        if whole is not None:
            return [whole]
        n, size, lengths, shorter, memo, compatible = len(text), len(self.tokens), self.lengths, self.shorter, self.memo, self.compatible
        longest = [-1] * n  # the longest token at each place: of those that begin there it ends last
        for end, token in self.automaton.iter(text):
            longest[end + 1 - lengths[token]] = token
        out: list[int] = []
        dead: set[int] = set()  # places from which no encoding goes on
        at, token = 0, longest[0] if n else -1
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + lengths[token]
                if end not in dead:
                    fits = last < 0 or memo.get(last * size + token)
                    if fits is None:
                        fits = compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif last < 0:
                raise ValueError("no encoding: the vocabulary lacks a byte")
            else:
                dead.add(at)
                out.pop()
                at -= lengths[last]
                token = shorter[last]

    def piece(self, text: str) -> tuple[int, str, bytes]:
        """Of a piece: how many ids, the ids as text, and the bytes that they decode to."""
        ids = self._encode(text if text.isascii() else text.encode().decode("latin-1"))
        return len(ids), " ".join([self.names[k] for k in ids]), self.decode(ids)

    def run(self, text: str) -> tuple[int, str, bytes]:
        """The same of the pieces of a stretch of text."""
        parts = [self.pieces[p] for p in self.pattern.findall(text)]
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def encode(self, text: str | None) -> list[int]:
        return [k for piece in self.pattern.findall(text or "") for k in self.encode_piece(piece.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.tokens[k] for k in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        n, ids, raw, between = 0, sha256(), sha256(), ""
        for parts in self._parts(text or ""):
            n += sum([p[0] for p in parts])
            ids.update((between + " ".join([p[1] for p in parts])).encode())
            raw.update(b"".join([p[2] for p in parts]))
            between = " "
        return n, ids.hexdigest(), raw.hexdigest()

    def _parts(self, text: str) -> Iterator[list[tuple[int, str, bytes]]]:
        if self.pattern.pattern == _CUT_AT_SPACES and not _DOUBLE.search(text):
            stretches = text.split(" ")
            stretches[1:] = [" " + x for x in stretches[1:]]
            stretches = stretches if stretches[0] else stretches[1:]
            kept = self.runs
        else:
            stretches, kept = self.pattern.findall(text), self.pieces
        for k in range(0, len(stretches), 8192):
            yield [kept[x] for x in stretches[k : k + 8192]]


_made: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:  # noqa: ANN001
    """One encoder a worker and vocabulary."""
    common.working("bpe", _made.clear)
    key = hash((shared.value[2], len(shared.value[0]), shared.value[0][-1]))
    if key not in _made:
        _made[key] = Encoder(*shared.value)
    return _made[key]


def _share(spark: SparkSession, path: str, pattern: str):  # noqa: ANN202
    tokens = read_ranks(spark, path)
    return spark.sparkContext.broadcast((tokens, splits(tokens), pattern))


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    common.prepare(spark)
    shared = _share(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            rows = [encoder.digests(t.as_py()) for t in batch.column(1)]
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the ids themselves and the text that they decode to."""
    common.prepare(spark)
    shared = _share(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
            texts = [encoder.decode(x).decode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
