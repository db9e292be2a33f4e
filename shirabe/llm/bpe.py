"""Byte-level BPE by backtracking over longest matches.

A trie over all token byte strings (the automaton of longest matches, anchored at a position)
gives the longest token at a place; ``shorter`` gives the next shorter token with the same start.
A token may follow another only if merging their bytes would give exactly these two tokens; that
compatibility is decided by undoing merges on both sides of the seam and kept in a table.  The
encoder walks forward with the longest match and backtracks when the pair table says no; a bit
per position marks places already proven dead, so each place is tried once and time is linear.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCAB = os.environ.get("SHIRABE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 200_000
CACHE_PIECE = 64
_NONE = 1 << 62


class Codec:
    """Encoder and decoder of one vocabulary file (base64 token, rank per line)."""

    def __init__(self, path: str):
        import regex

        self.words: list[bytes] = []
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    word, rank = line.split()
                    ranks[base64.b64decode(word)] = int(rank)
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.ranks = ranks
        self._find = regex.compile(SPLIT).findall
        self._trie = self._build_trie()
        self._shorter = self._build_shorter()
        self._parts: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], int] = {}
        self._build_merges()
        self._fits: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}
        # offset table for decoding: all bytes in a row, and where each id starts
        self.blob = b"".join(self.words)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)

    def _build_trie(self) -> dict:
        root: dict = {}
        for word, rank in self.ranks.items():
            node = root
            for byte in word:
                node = node.setdefault(byte, {})
            node[-1] = rank
        return root

    def _build_shorter(self) -> list[int]:
        out = [-1] * len(self.words)
        for word, rank in self.ranks.items():
            for end in range(len(word) - 1, 0, -1):
                if (hit := self.ranks.get(word[:end])) is not None:
                    out[rank] = hit
                    break
        return out

    def _build_merges(self) -> None:
        """The pair each token is merged from, by lowest rank first over its own bytes."""
        for rank in sorted(self.ranks.values()):
            word = self.words[rank]
            if len(word) == 1:
                self._parts[rank] = (rank, rank)
                continue
            seq = [self.ranks[word[i : i + 1]] for i in range(len(word))]
            while len(seq) > 2:
                best, at = _NONE, -1
                for i in range(len(seq) - 1):
                    got = self._merge.get((seq[i], seq[i + 1]), _NONE)
                    if got < best:
                        best, at = got, i
                if at < 0:
                    break
                seq[at : at + 2] = [best]
            if len(seq) == 2:
                self._parts[rank] = (seq[0], seq[1])
                self._merge[(seq[0], seq[1])] = rank
            else:  # never merged from others: stands for itself
                self._parts[rank] = (rank, rank)

    def _compatible(self, a: int, b: int) -> bool:
        """Do the bytes of a and b, merged together, come out as a then b?"""
        merge, parts, limit = self._merge, self._parts, _NONE
        while True:
            if merge.get((a, b), _NONE) < limit:
                return False
            if a > b:
                limit = a
                left, right = parts[a]
                a = right
                if left == a and right == limit:  # a token of one byte
                    limit, was = b + 1, b
                    b, _ = parts[b]
                    if b == was:
                        return True
            else:
                limit = b + 1
                left, right = parts[b]
                was, b = b, left
                if b == was:
                    limit, last = a, a
                    a = parts[a][1]
                    if a == last:
                        return True

    def _longest(self, data: bytes, at: int) -> int:
        node, best = self._trie, -1
        for i in range(at, len(data)):
            node = node.get(data[i])
            if node is None:
                break
            best = node.get(-1, best)
        return best

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        words, shorter, fits, n = self.words, self._shorter, self._fits, len(data)
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at = 0
        token = self._longest(data, 0)
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + len(words[token])
                if alive[end]:
                    if last < 0:
                        good = True
                    else:
                        good = fits.get((last, token))
                        if good is None:
                            if len(fits) > 2_000_000:
                                fits.clear()
                            good = fits[(last, token)] = self._compatible(last, token)
                    if good:
                        out.append(token)
                        at = end
                        token = self._longest(data, at) if at < n else -1
                        break
                nxt = shorter[token]
                if nxt >= 0:
                    token = nxt
                else:
                    alive[at] = 0
                    if not out:
                        raise ValueError("bytes that no token covers")
                    token = out.pop()
                    at -= len(words[token])
                    break
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty text give the empty list; every string is ordinary text."""
        if not text:
            return []
        out: list[int] = []
        cache = self._cache
        for piece in self._find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
                if len(piece) <= CACHE_PIECE:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out

    def decode_bytes(self, ids) -> bytes:
        off, blob = self.offsets, self.blob
        return b"".join(blob[off[i] : off[i + 1]] for i in ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str = DEFAULT_VOCAB) -> Codec:
    return Codec(path)


_shipped: dict[str, str] = {}


def _ship(df: DataFrame, vocab: str) -> Callable[[], str]:
    """Sends the vocabulary file to the executors with the job, once; gives the path it has on a worker."""
    sc, name = df.sparkSession.sparkContext, os.path.basename(vocab)
    if os.path.exists(vocab) and _shipped.setdefault(f"{sc.applicationId}/{name}", vocab) == vocab:
        sc.addFile(vocab)

    def local() -> str:
        path = SparkFiles.get(name)
        return path if os.path.exists(path) and not os.path.exists(vocab) else vocab

    return local


def _typed(df: DataFrame, key: str) -> T.DataType:
    return df.schema[key].dataType


def encode_column(df: DataFrame, key: str, text: str, vocab: str = DEFAULT_VOCAB, out: str = "ids") -> DataFrame:
    """``key`` and the token ids of ``text`` (array of int), one row per input row.

    Null and empty texts give the empty list.  No shuffle: texts are encoded where they lie; the
    ids leave in slices of about a million so that very long texts do not pile up in one batch.
    """
    local = _ship(df, vocab)

    def run(batches):
        enc = codec(local()).encode
        for batch in batches:
            keys = batch.column(0)
            start, flat, ends = 0, array("i"), [0]
            for i, value in enumerate(batch.column(1)):
                flat.extend(enc(value.as_py()))
                ends.append(len(flat))
                if len(flat) > 1_000_000:
                    yield _slice(keys, start, i + 1, flat, ends)
                    start, flat, ends = i + 1, array("i"), [0]
            if len(ends) > 1:
                yield _slice(keys, start, batch.num_rows, flat, ends)

    def _slice(keys, start, stop, flat, ends):
        ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))
        return pa.RecordBatch.from_arrays([keys.slice(start, stop - start), ids], ["k", "ids"])

    schema = T.StructType([T.StructField("k", _typed(df, key)), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).select(F.col("k").alias(key), F.col("ids").alias(out))


def count_column(df: DataFrame, key: str, text: str, vocab: str = DEFAULT_VOCAB, out: str = "n_tokens") -> DataFrame:
    """``key`` and the number of tokens of ``text`` (bigint; 0 for null and empty texts)."""
    local = _ship(df, vocab)

    def run(batches):
        enc = codec(local()).encode
        for batch in batches:
            sizes = np.fromiter((len(enc(v.as_py())) for v in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["k", "n"])

    schema = T.StructType([T.StructField("k", _typed(df, key)), T.StructField("n", T.LongType())])
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).select(F.col("k").alias(key), F.col("n").alias(out))


def decode_column(df: DataFrame, key: str, ids: str, vocab: str = DEFAULT_VOCAB, out: str = "text") -> DataFrame:
    """``key`` and the text of the ids; a null list gives null, the empty list the empty text."""
    local = _ship(df, vocab)

    def run(batches):
        dec = codec(local()).decode
        for batch in batches:
            texts = [None if (v := x.as_py()) is None else dec(v) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    schema = T.StructType([T.StructField("k", _typed(df, key)), T.StructField("t", T.StringType())])
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, schema).select(F.col("k").alias(key), F.col("t").alias(out))
