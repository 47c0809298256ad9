"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file is a table of shards in ascending document order. A shard holds the ids of its documents end to end
(16 bits each where the vocabulary allows, else 32), and Elias-Fano codes with a sampled select structure of the
boundaries, about 2 + log2(ids / documents) bits for each document instead of a 64-bit offset, and of the document ids.
Beside each shard stands the number of ids before it in its range of documents, so only a number a range is added on
reading.

Defined results: a null text counts as empty; a null document id sorts before all others; rows that share an id are
ordered by their text; an empty table gives no shard and no row; columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch_path, shuffle_partitions
from .word_cache import WordCache

END_ID = 2
SHARD_IDS = 1_000_000
#: A select sample for every so many documents.
SAMPLE = 256
MAGIC = b"EFTOKEN1"
HEADER, CODE = struct.Struct("<8sHHIQq"), struct.Struct("<IIIII")
#: Bytes of text to a range of documents; ranges up to which what lies before each is broadcast.
RANGE_BYTES, BROADCAST_RANGES = 128 << 20, 500_000


class EliasFano:
    """A non-decreasing sequence of n values below 2**32: low bits packed, high bits in unary, select by samples."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        low_values = values & np.uint64((1 << low_bits) - 1)
        bits = (low_values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high_bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high_bits[ones] = 1
        high = np.packbits(high_bits, bitorder="little").tobytes()
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : -(-last // 8)], "little")
        return chunk >> (first % 8) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    @property
    def n_bytes(self) -> int:
        return len(self.low) + len(self.high) + self.samples.nbytes

    def to_bytes(self) -> bytes:
        samples = self.samples.astype("<u4").tobytes()
        return CODE.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + samples

    @classmethod
    def read(cls, blob: bytes, at: int) -> tuple[EliasFano, int]:
        """The code that begins at a place, and the place behind it."""
        n, low_bits, low, high, samples = CODE.unpack_from(blob, at)
        at += CODE.size
        end = at + low + high + 4 * samples
        return cls(n, low_bits, blob[at : at + low], blob[at + low : at + low + high], np.frombuffer(blob, "<u4", samples, at + low + high)), end


def pack_shard(doc_ids: list[int | None], pieces: list[bytes], width: int) -> bytes:
    """One shard: header, document ids (nulls first, then ascending), boundaries, ids."""
    sizes = np.array([len(p) // width for p in pieces], dtype=np.int64)
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    keys = EliasFano.build(np.array([d - first for d in known], dtype=np.uint64))
    ends = EliasFano.build(np.cumsum(sizes))
    head = HEADER.pack(MAGIC, width, 0, len(doc_ids) - len(known), int(sizes.sum()), first)
    return b"".join([head, keys.to_bytes(), ends.to_bytes(), *pieces])


class Shard:
    """A shard read back from its bytes."""

    def __init__(self, blob: bytes):
        magic, width, _, self.n_null, self.n_ids, self.first = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.keys, at = EliasFano.read(blob, HEADER.size)
        self.ends, at = EliasFano.read(blob, at)
        self.ids = np.frombuffer(blob, f"<u{width}", self.n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.keys.select(i - self.n_null)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class BpeEncoder:
    """Byte-level BPE by the tokenizers library; a word met before is not encoded again.

    The pre-tokenizer always breaks before a lone space that has other than white space on both sides, and at a newline
    between two such lines, and merges never cross a break. So a line's words can be encoded one by one. Texts with
    any other white space are encoded in one piece. A word of letters alone, with at most a full stop or comma after
    it, is one piece of the pre-tokenizer (and one for the mark), so the model can take it directly."""

    OTHER_SPACE = re.compile(r"[^\S \n]")
    #: Letters below this code point have two bytes at most.
    LIMIT = "\u0800"

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.model = self.tokenizer.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {}
        for code in (*range(0x80), *range(0x80, ord(self.LIMIT))):
            shown = letters.pre_tokenize_str(chr(code))[0][0]
            self.shown.update(zip(chr(code).encode().decode("latin-1"), shown, strict=True))
        self.shown = str.maketrans(self.shown)
        self.space = letters.pre_tokenize_str(" ")[0][0]
        self.bytes_of = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.first = WordCache(lambda w: self.word("", w), 8 << 20)
        self.later = WordCache(lambda w: self.word(self.space, w), 160 << 20)
        self.newline = self.encode("\n")

    def join(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> bytes:
        return self.join(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, space: str, word: str) -> bytes:
        """A word, after a space or at the start of a line."""
        plain = word.isascii()
        if word.isalpha() and (plain or max(word) < self.LIMIT):
            shown = word if plain else word.encode().decode("latin-1").translate(self.shown)
            return self.join([t.id for t in self.model.tokenize(space + shown)])
        if len(word) > 1 and word[-1] in ".," and word[:-1].isalpha():
            return (self.later if space else self.first)[word[:-1]] + self.first[word[-1]]
        return self.encode(" " * bool(space) + word)

    def plain(self, text: str) -> bool:
        around = f"\n{text}\n"
        return not ("  " in text or "\n\n" in around or " \n" in around or "\n " in around or self.OTHER_SPACE.search(text))

    def __call__(self, text: str) -> bytes:
        if not self.plain(text):
            return self.encode(text)
        later, out = self.later, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += (self.newline, self.first[head], *[later[w] for w in rest])
        return b"".join(out[1:])


_encoders: dict[tuple[str, int], BpeEncoder] = {}


def encoder(path: str, width: int) -> BpeEncoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = BpeEncoder(path, width)
    return _encoders[path, width]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, width: int = 2, shard_ids: int = SHARD_IDS, buckets: int | None = None) -> None:
    """Encode (doc_id, text) and write shards to ``path`` in ascending order of doc_id.

    Ranges of document ids are shuffled, sorted and encoded each on its own; a range becomes one or more shards. There are as many as the bytes
    of the texts ask for, which are counted; a range is a partition, so no bound of it stands in the plan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(4 * shuffle_partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    first = F.asc_nulls_first("doc_id")
    # The text's beginning divides rows that share an id, such as none.
    ordered = rows.repartitionByRange(buckets, first, F.substring("text", 1, 32)).sortWithinPartitions(first, "text").select(F.spark_partition_id().alias("bucket"), "doc_id", "text")
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, width)
        bucket, seq, before, ids, pieces, size = None, 0, 0, [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"bucket": [bucket], "seq": [seq], "n_docs": [len(ids)], "n_ids": [size // width], "before": [before], "blob": [pack_shard(ids, pieces, width)]})

        for batch in batches:
            for b, known, doc_id, text in zip(batch["bucket"], batch["doc_id"].notna(), batch["doc_id"], batch["text"], strict=True):
                if ids and (b != bucket or size >= shard_ids * width):
                    yield flush()
                    seq, before = (seq + 1, before + size // width) if b == bucket else (0, 0)
                    ids, pieces, size = [], [], 0
                bucket = b
                ids.append(int(doc_id) if known else None)
                pieces.append(encode(text) + end)
                size += len(pieces[-1])
        if ids:
            yield flush()

    ordered.mapInPandas(shards, "bucket int, seq int, n_docs long, n_ids long, before long, blob binary").write.option("compression", "snappy").parquet(path)


def range_index(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, base): for each range the count of all ids before it. One row a range, so this table is small."""
    from pyspark.sql import Window

    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spark.read.parquet(path).groupBy("bucket").agg(F.sum("n_ids").alias("n_ids"))
    return ranges.select("bucket", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the stored shards: each boundary by a select."""
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, blob in zip(batch["base"], batch["blob"], strict=True):
                shard = Shard(blob)
                ends = [shard.ends.select(i) for i in range(shard.ends.n)]
                starts = [0, *ends[:-1]] if ends else []
                wide = memoryview(shard.ids.astype("<u4").tobytes())
                out = {
                    "doc_id": pd.array([shard.doc_id(i) for i in range(len(ends))], dtype="Int64"),
                    "start": [base + a for a in starts],
                    "n_tokens": [b - a for a, b in zip(starts, ends, strict=True)],
                    "ids_crc32": [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)],
                }
                if with_ids:
                    out["ids"] = [shard.ids[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame(out)

    index = range_index(spark, path)
    side = F.broadcast(index) if index.count() <= BROADCAST_RANGES else index
    shards = spark.read.parquet(path).select("bucket", "before", "blob").join(side, "bucket")
    return shards.select((F.col("base") + F.col("before")).alias("base"), "blob").mapInPandas(read, columns)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
