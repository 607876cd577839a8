"""Best-fit decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table

END = b"\0\0\0\0"  # id 0 after each document
ADDED = "<|endoftext|>"  # the vocabulary's added token; its id follows the ranks
REMEMBERED = 300_000  # words whose ids a Python worker keeps at a time
BUCKET_TOKENS = 1 << 24  # tokens that one task packs


@functools.lru_cache(maxsize=2)
def _encoder(path: str | None):
    """The byte-level BPE of ``byte_bpe_50k.json``; its ranks file gives the same ids faster."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens={})


class WordIds(dict):
    """Word → its ids as little-endian 32-bit numbers; unseen words are encoded."""

    def __init__(self, path: str | None):
        encoder = _encoder(path)
        self.encode = encoder.encode_ordinary
        self.added = np.asarray(encoder.max_token_value + 1, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = np.asarray(self.encode(word), dtype="<u4").tobytes()
        return ids

    def document(self, text: str) -> bytes:
        """Ids of a text and the end; the added token stands for itself wherever it occurs."""
        return self.added.join(map(self.ordinary, text.split(ADDED))) + END

    def ordinary(self, text: str) -> bytes:
        """Ids of a text. A cut before a space that a visible character follows is a token border."""
        head, *rest = text.split(" ")
        words = [head]
        for part in rest:
            if part and not part[0].isspace():
                words.append(" " + part)
            else:
                words[-1] += " " + part
        return b"".join(map(self.__getitem__, words))


@functools.lru_cache(maxsize=2)
def _words(path: str | None) -> WordIds:
    return WordIds(path)


def pieces_of(ids: bytes, size: int):
    """(piece, start, length, crc32) of a document; of a long one only the first may be shorter."""
    n = len(ids) // 4
    first = n if n <= size else n % size or size
    at, piece = 0, 0
    while at < n:
        length = first if piece == 0 else size
        yield piece, at, length, zlib.crc32(ids[4 * at: 4 * (at + length)])
        at, piece = at + length, piece + 1


def tokenised(df: DataFrame, id_col: str, text_col: str, size: int, path: str | None = None):
    """``_id, piece, start, length, ids_crc32`` of all documents; the tokens of whole texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        words = _words(path)
        for pdf in batches:
            out = [(i, *p) for i, t in zip(pdf["_id"], pdf["_text"], strict=True)
                   for p in pieces_of(words.document(t), size)]
            yield pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"_id": pdf["_id"].dtype})

    rows = df.select(q(id_col).alias("_id"), F.coalesce(q(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(
        cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by remaining room, under a segment tree over the rooms 0 … size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list] = [[] for _ in range(size + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        if len(self.bins[room]) == 1:
            self._mark(room, 1)

    def _mark(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least ``length``: (room, bin)."""
        i, count = length + self.leaves, self.count
        if not count[i]:
            # Up to the first right-hand sibling that holds a bin, then down to its leftmost.
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, -1)
        return room, bin_


def best_fit(lengths, size: int):
    """Bin and offset of each length, in the order given (longest first for best-fit decreasing)."""
    open_, used = OpenBins(size), 0
    bins, offsets = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    for k, n in enumerate(map(int, lengths)):
        found = open_.tightest(n)
        if found is None:
            found, used = (size, used), used + 1
        room, bin_ = found
        bins[k], offsets[k] = bin_, size - room
        if room > n:
            open_.put(room - n, bin_)
    return bins, offsets


def pack_documents(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then id 0; longer ones than ``size`` are cut, the remainder first.
    Pieces are dealt by hash to tasks of about 16 million tokens; each task packs its pieces
    longest first into the open sequence with least room left that still fits (best-fit
    decreasing), so at most a few sequences per task stay partly filled. Repeated rows are
    packed as often as they come, with the same piece numbers. NULL texts count as empty: one
    piece that is only the end id. An empty table gives an empty result; other columns are not
    read. ``tokenizer`` names a ranks file; its default is that of the public byte-level BPE.
    """
    pieces = stored(tokenised(df, id_col, text_col, size, tokenizer), "pack-pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    buckets = 1 + total // BUCKET_TOKENS

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_id", "piece"], ascending=[False, True, True],
                              kind="stable", ignore_index=True)
        bins, offsets = best_fit(pdf["length"], size)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(
            columns="_bucket")

    kind = df.schema[id_col].dataType.simpleString()
    packed = pieces.withColumn(
        "_bucket", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(buckets))
    ).groupBy("_bucket").applyInPandas(fill, (
        f"_id {kind}, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long"))
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32",
                         "sequence_id", "offset")


def op9_best_fit_packing(spark, sf: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf, "documents"))
