"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

Each id is cut into ``chunk_bits``-wide chunks from the low end. Level 0 holds the lowest chunk of
every id; a continuation bitmap beside it says which ids go on. Level k+1 holds the next chunk of
exactly the ids whose bit is set in level k, in the same order, so the place of an id's next chunk
is the rank of its bit (ones before it). A rank directory per level (ones before every block of
``BLOCK_BITS`` bits) makes that rank a lookup plus one popcount, so any token can be read without
decoding the ones before it, and small ids (most of a vocabulary) take one chunk and one bit.

Texts are encoded by the tokenizers library piece by piece: the byte-level pattern cuts a text into
pieces that BPE never merges across. The cuts of a batch are found as arrays (:class:`Cutter`; which
kind a character is, the library's own pre-tokenizer says), the pieces are a second Arrow array over
the same text bytes, and only distinct ones that the worker has not met go to the library's model
(``memo_pieces`` bounds what it remembers). Tests hold the ids against whole-text encoding.

Spark does the work: documents are range-partitioned by ``doc_id``, each partition is one shard
that tokenizes its documents in ascending order and encodes their ids as one code; the codes are a
table of binary values in a given folder (one row per shard, written by Spark, so any store works).
Reading back decodes each shard in its own task; the start of every shard comes from the shard
sizes alone (one small number per shard), so no document, id list or link passes the driver.

Rows: a null text is read as empty; every document gets the end id appended, so an empty text has
one token. Documents are ordered by ``doc_id`` (nulls first), then by text and then by the row's
place in the input, so repeated and tied rows each keep their own entry. Very long texts are
tokenized whole in one task (a document is the unit). An empty table gives no shards and no rows.
Input columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.session import shared_folder

MAGIC = b"DAC1"
BLOCK_BITS = 512

_TOKENIZERS: dict[str, object] = {}
_MEMOS: dict[str, "Memo"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Codes:
    """``chunk_bits`` per level; ``end_id`` appended to every document; ``shard_chars`` of text per shard."""

    vocabulary: str | None = None
    end_id: int = 2
    chunk_bits: int = 8
    shard_chars: int = 8 << 20
    memo_pieces: int = 1_000_000


def _tokenizer(path: str):
    found = _TOKENIZERS.get(path)
    if found is None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core; no threads besides
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True  # a special token's string inside a text stays text
        _TOKENIZERS[path] = found
    return found


# ---------------------------------------------------------------------------------------------
# Texts to ids
# ---------------------------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER, _UNMET = range(5)
_CUT_BYTES = 4 << 20


class Cutter:
    """Where the byte-level pattern cuts texts: ``'s|'t|'re|'ve|'m|'ll|'d`` and runs of one kind of
    character, each with one blank before it; of other white space the last character stands alone."""

    def __init__(self, tokenizer):
        self._pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        self._kinds = np.full(0x110000, _UNMET, np.uint8)

    def _kind(self, char: str) -> int:
        for kind, mate in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
            if len(self._pieces(mate + char)) == 1:
                return kind
        return _SPACE

    def starts(self, points: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each code point; ``heads`` are the places where texts start."""
        kind = self._kinds[points]
        if (kind == _UNMET).any():
            for point in np.unique(points[kind == _UNMET]).tolist():
                self._kinds[point] = self._kind(chr(point))
            kind = self._kinds[points]
        head = np.zeros(len(points) + 1, bool)
        head[heads] = True
        head[-1] = True
        space = kind == _SPACE
        out = np.empty(len(points), bool)
        out[1:] = np.where(space[1:] | space[:-1], ~space[:-1], kind[1:] != kind[:-1])
        # A run of white space leaves its last character to what follows, which takes it in if it is a blank.
        last = np.flatnonzero(space & ~head[1:])
        last = last[~space[last + 1]]
        out[last] = True
        out[last + 1] = points[last] != 32
        out[head[:-1]] = True
        self._contractions(points, head, kind, out)
        return out

    @staticmethod
    def _contractions(points: np.ndarray, head: np.ndarray, kind: np.ndarray, out: np.ndarray) -> None:
        marks = np.flatnonzero((points == 39) & out)
        marks = marks[~head[marks + 1]]
        one = points[marks + 1]
        beyond = np.minimum(marks + 2, len(points) - 1)
        two = np.where(head[marks + 2], 0, points[beyond])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[marks[short | long] + 1] = False
        for ends in (marks[short] + 2, marks[long] + 3):
            out[ends[ends < len(out)]] = True

    def pieces(self, texts: pa.LargeStringArray) -> tuple[list[pa.LargeStringArray], np.ndarray]:
        """The pieces of non-null texts, over the same bytes, and how many pieces each text has."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        found, counts = [], []
        row = 0
        while row < len(texts):
            until = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CUT_BYTES, "right")) - 1)
            low, high = int(bounds[row]), int(bounds[until])
            part = raw[low:high]
            places = np.flatnonzero((part & 0xC0) != 0x80)
            points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            heads = np.searchsorted(places, bounds[row:until] - low)
            cuts = np.concatenate([places[self.starts(points, heads)] + low, [high]]) if high > low else np.array([low])
            counts.append(np.diff(np.searchsorted(cuts, bounds[row : until + 1])))
            if len(cuts) > 1:
                found.append(pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), data))
            row = until
        return found, np.concatenate(counts) if counts else np.empty(0, np.int64)


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memo:
    """Ids of the pieces a worker has met, as arrays; lives as long as the worker."""

    def __init__(self, tokenizer):
        self.cutter = Cutter(tokenizer)
        self._tokenize = tokenizer.model.tokenize
        self._names = dict(enumerate(_byte_names()))
        self._clear()

    def _clear(self) -> None:
        self._known = pa.array([], pa.large_string())
        self._ids = np.empty(0, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def _named(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():  # all of these but the blank are their own names
            return piece.replace(" ", self._names[32])
        return piece.encode().decode("latin-1").translate(self._names)

    def _learn(self, pieces: pa.LargeStringArray) -> None:
        got = [[t.id for t in self._tokenize(self._named(piece))] for piece in pieces.to_pylist()]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self._known = pa.concat_arrays([self._known, pieces])
        self._ids = np.concatenate([self._ids, np.fromiter((i for ids in got for i in ids), np.uint32, sizes.sum())])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])

    def _places(self, distinct: pa.LargeStringArray, most: int) -> np.ndarray:
        """The place of each distinct piece among the known ones; new ones are added, all others go if they get too many."""
        found = pc.index_in(distinct, value_set=self._known)
        if len(self._known) + found.null_count > most:
            self._clear()
            found = pa.nulls(len(distinct), pa.int32())
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self._known) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)))
        return at

    def encode(self, texts: pa.LargeStringArray, end_id: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` after each, and how many each has with it."""
        pieces, counts = self.cutter.pieces(texts)
        flat, ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        if pieces:
            coded = pa.chunked_array(pieces).dictionary_encode().unify_dictionaries()
            places = self._places(coded.chunk(0).dictionary, most)
            at = places[np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])]
            sizes = np.diff(self._ends)[at]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = self._ids[np.repeat(self._ends[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        amounts = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]) + 1
        out = np.empty(len(flat) + len(amounts), np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(amounts) - 1] = False
        out[inner] = flat
        out[~inner] = end_id
        return out, amounts


# ---------------------------------------------------------------------------------------------
# The code of one shard
# ---------------------------------------------------------------------------------------------


def _ranks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap words (little-endian bit order) and ones before each block of BLOCK_BITS bits."""
    words = np.packbits(bits.astype(np.uint8), bitorder="little")
    words = np.concatenate([words, np.zeros((-len(words)) % 8, np.uint8)]).view("<u8")
    per_word = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=1)
    per_block = np.add.reduceat(per_word, np.arange(0, len(per_word), BLOCK_BITS // 64)) if len(per_word) else per_word
    directory = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
    return words, directory


def encode(ids: np.ndarray, chunk_bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap words, rank directory) for unsigned 32-bit ids."""
    if chunk_bits not in (8, 16):
        raise ValueError("chunk_bits is 8 or 16")
    dtype = np.uint8 if chunk_bits == 8 else np.dtype("<u2")
    rest = np.asarray(ids, dtype=np.uint64)
    levels = []
    while True:
        more = rest >> np.uint64(chunk_bits)
        go_on = more > 0
        chunks = (rest & np.uint64((1 << chunk_bits) - 1)).astype(dtype)
        levels.append((chunks, *_ranks(go_on)))
        rest = more[go_on]
        if not len(rest):
            return levels


def pack_shard(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The bytes of one shard: header, levels, then the documents with their local starts."""
    levels = encode(ids, chunk_bits)
    out = [MAGIC, struct.pack("<IIQ", chunk_bits, len(levels), len(ids))]
    for chunks, words, directory in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        out += [struct.pack("<Q", len(words)), words.tobytes(), struct.pack("<Q", len(directory)), directory.tobytes()]
    present = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    out += [struct.pack("<Q", len(doc_ids)), keys.tobytes(), present.tobytes(), starts.tobytes()]
    return b"".join(out)


class Shard:
    """A shard's code read from its bytes; ``at(i)`` reads one id, ``ids()`` all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token codes")
        self.chunk_bits, n_levels, self.n = struct.unpack_from("<IIQ", data, 4)
        dtype = np.uint8 if self.chunk_bits == 8 else np.dtype("<u2")
        at, self.levels = 20, []
        for _ in range(n_levels):
            (count,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, dtype, count, at + 8)
            at += 8 + chunks.nbytes
            (n_words,) = struct.unpack_from("<Q", data, at)
            words = np.frombuffer(data, "<u8", n_words, at + 8)
            at += 8 + words.nbytes
            (n_dir,) = struct.unpack_from("<Q", data, at)
            directory = np.frombuffer(data, "<u8", n_dir, at + 8)
            at += 8 + directory.nbytes
            self.levels.append((chunks, words, directory))
        (n_docs,) = struct.unpack_from("<Q", data, at)
        keys = np.frombuffer(data, "<i8", n_docs, at + 8)
        present = np.frombuffer(data, np.uint8, n_docs, at + 8 + 8 * n_docs)
        self.doc_ids = [int(k) if p else None for k, p in zip(keys, present)]
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at + 8 + 9 * n_docs).astype(np.int64)

    @staticmethod
    def _bit(words: np.ndarray, i: int) -> bool:
        return bool((int(words[i >> 6]) >> (i & 63)) & 1)

    @staticmethod
    def _rank(words: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before place ``i``: the block's count, whole words of the block, part of a word."""
        block, word = i // BLOCK_BITS, i >> 6
        ones = int(directory[block])
        for w in range(block * (BLOCK_BITS // 64), word):
            ones += int(words[w]).bit_count()
        return ones + (int(words[word]) & ((1 << (i & 63)) - 1)).bit_count()

    def at(self, i: int) -> int:
        """The id at place ``i`` of the shard, read through the levels it reaches."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, words, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not self._bit(words, i):
                return value
            i = self._rank(words, directory, i)
            shift += self.chunk_bits
        return value

    def ids(self) -> np.ndarray:
        """All ids, one level at a time: level k+1 fills the places whose bit is set in level k."""
        chunks, words, _ = self.levels[0]
        values = chunks.astype(np.uint64)
        places = np.arange(self.n)
        shift = 0
        for k in range(len(self.levels) - 1):
            bits = np.unpackbits(self.levels[k][1].view(np.uint8), bitorder="little")[: len(self.levels[k][0])]
            places = places[bits.astype(bool)]
            shift += self.chunk_bits
            values[places] |= self.levels[k + 1][0].astype(np.uint64) << np.uint64(shift)
        return values.astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        return np.array([self.at(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


# ---------------------------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------------------------

SHARDS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("code", T.BinaryType()),
    ]
)


def write_codes(docs: DataFrame, path: str, codes: Codes = Codes()) -> None:
    """Tokenizes every document and writes one code per shard to ``path`` (a Parquet table)."""
    vocabulary = codes.vocabulary or default_vocabulary()
    rows = docs.select(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    # Ranges are drawn on doc_id alone, so that no text is among the sampled keys the driver gets; only the
    # rows of a doc_id with more text than a shard may hold are ranged by their text and place too.
    sizes = rows.groupBy("no_id", "doc_id").agg(F.sum(F.length("text") + 1).alias("c"))
    total = sizes.agg(F.sum("c").alias("chars"), F.max("c").alias("most")).first()
    shards = max(1, math.ceil((total.chars or 0) / codes.shard_chars))
    rows = rows.withColumn("tie", F.lit(None).cast("struct<text:string,place:long>"))
    if (total.most or 0) > codes.shard_chars:
        many = sizes.where(F.col("c") > codes.shard_chars).select("no_id", "doc_id", F.lit(True).alias("many"))
        rows = rows.join(many, ["no_id", "doc_id"], "left").withColumn("tie", F.when(F.col("many"), F.struct("text", "place")))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard, batch by batch in the order Spark sorted it: only ids are kept, as arrays."""
        from pyspark import TaskContext

        memo = _MEMOS.get(vocabulary)
        if memo is None:
            memo = _MEMOS[vocabulary] = Memo(_tokenizer(vocabulary))
        parts, keys, lengths = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, amounts = memo.encode(batch.column("text").cast(pa.large_string()), codes.end_id, codes.memo_pieces)
            parts.append(ids)
            lengths.append(amounts)
            keys += [None if gone else d for gone, d in zip(batch.column("no_id").to_pylist(), batch.column("doc_id").to_pylist())]
        if not keys:
            return
        ids = np.concatenate(parts)
        del parts
        blob = pack_shard(ids, keys, np.concatenate(lengths), codes.chunk_bits)
        row = ([TaskContext.get().partitionId()], [len(keys)], [len(ids)], [blob])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=SHARDS.names)

    key = [F.col("no_id").desc(), "doc_id"]
    ordered = rows.repartitionByRange(shards, *key, "tie").sortWithinPartitions(*key, "text", "place")
    ordered.select("no_id", "doc_id", "text").mapInArrow(shard, SHARDS).write.mode("overwrite").parquet(path)


def read_codes(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32 of its ids as little-endian u32."""
    table = spark.read.schema(SHARDS).parquet(path)
    sizes = sorted((r.shard, r.n_ids) for r in table.select("shard", "n_ids").collect())  # one row a shard
    offsets, total = {}, 0
    for number, n_ids in sizes:
        offsets[number] = total
        total += n_ids
    out = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, blob in zip(batch["shard"], batch["code"]):
                shard = Shard(blob)
                ids = shard.ids()
                base = offsets[int(number)]
                starts = shard.starts
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(shard.doc_ids, dtype="Int64"),
                        "start": starts[:-1] + base,
                        "n_tokens": np.diff(starts),
                        "ids_crc32": np.array(crcs, np.int64),
                    }
                )

    return table.mapInPandas(decode, out)


def token_codes(docs: DataFrame, codes: Codes = Codes(), path: str | None = None) -> DataFrame:
    """Writes the codes of all documents (to ``path`` or a new table in the shared folder) and reads them back."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/gleanframe-codes-{uuid.uuid4().hex}"
    write_codes(docs, path, codes)
    return read_codes(spark, path)
