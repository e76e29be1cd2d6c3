"""Token ids in binary files, with document boundaries in Elias-Fano form.

A folder holds, for each shard of documents in ascending ``doc_id``,

* ``NNNNNN.ids``: the ids of its documents one after another, little-endian unsigned,
  two bytes each if the vocabulary allows it, else four;
* ``NNNNNN.idx``: a JSON header line, then two Elias-Fano sequences: where each document
  ends in the ids, and the doc_ids.

and ``manifest`` (Parquet), one row a shard with its first id's place among all ids. A
boundary costs about 2 + log2(ids / documents) bits; ``EliasFano.select`` reads one by
looking at a sampled position and a few bytes.

Null texts are empty, so such a document has the end id alone. Rows with the same doc_id
are documents of their own, ordered by their text; null doc_ids come first. Other columns
are ignored. An empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, batches_of
from .words import in_pieces

END_ID = 2
SAMPLE = 256
#: Values that are encoded at a time (a multiple of 8 and of ``SAMPLE``).
PIECE = 4096
#: Bytes of text a shard, about.
SHARD_BYTES = 32 << 20
#: Words that an encoder remembers in each of two generations.
MOST_WORDS = 150_000


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Of all values at once; they are written in pieces, so that only a piece is held in wide numbers."""
        values = np.asarray(values, dtype=np.uint64)
        return cls.of_pieces(lambda: (values[a : a + PIECE] for a in range(0, len(values), PIECE)), len(values), int(values[-1]) if len(values) else 0)

    @classmethod
    def of_lengths(cls, lengths: array) -> EliasFano:
        """Of the running sums of ``lengths``."""

        def pieces():
            base = 0
            for a in range(0, len(lengths), PIECE):
                ends = base + np.cumsum(np.frombuffer(lengths[a : a + PIECE], lengths.typecode), dtype=np.uint64)
                base = ends[-1]
                yield ends

        return cls.of_pieces(pieces, len(lengths), sum(lengths))

    @classmethod
    def of_pieces(cls, pieces, n: int, last: int) -> EliasFano:
        low_bits = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        high = np.zeros(((last >> low_bits) + n + 7) // 8 if n else 0, np.uint8)
        low, samples, at = [], [], 0
        for values in pieces():
            parts = values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
            low.append(np.packbits(parts.astype(np.uint8).ravel(), bitorder="little").tobytes())
            ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(at, at + len(values))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            samples.append(ones[-at % SAMPLE :: SAMPLE])
            at += len(values)
        samples = np.concatenate(samples) if samples else np.zeros(0, np.int64)
        return cls(n, low_bits, b"".join(low), high.tobytes(), samples.astype("<u8" if 8 * len(high) >> 32 else "<u4"))

    def select(self, i: int) -> int:
        """The i-th value, without reading the sequence."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(at, 8)
        now = self.high[byte] >> bit << bit
        while (ones := now.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            now = self.high[byte]
        for _ in range(left):
            now &= now - 1
        place = byte * 8 + (now & -now).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return (place - i) << self.low_bits | chunk >> first % 8 & (1 << self.low_bits) - 1

    def parts(self) -> tuple[dict, list[bytes]]:
        sizes = {"n": self.n, "low_bits": self.low_bits, "low": len(self.low), "high": len(self.high), "samples": len(self.samples), "sample_type": self.samples.dtype.str}
        return sizes, [self.low, self.high, self.samples.tobytes()]

    @classmethod
    def read(cls, sizes: dict, f) -> EliasFano:
        kind = np.dtype(sizes["sample_type"])
        return cls(sizes["n"], sizes["low_bits"], f.read(sizes["low"]), f.read(sizes["high"]), np.frombuffer(f.read(sizes["samples"] * kind.itemsize), kind))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def resolved(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI: a path without a scheme is in Spark's default file system, for the tasks as for Spark's own tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


#: Characters that texts cut here are made of; texts with any other are encoded whole.
UNSURE = re.compile("[^\t-\r -~\xa1-\u024f\u2010-\u2027]")
# How byte-level BPE cuts a text into words before it merges within them, for those characters.
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^\t-\r {LETTER}{NUMBER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


#: What the start-up check of a tokenizer file found, once a process.
AGREES: dict[str, bool] = {}


def start_up_texts() -> list[str]:
    """Every character that words are cut at or made of, in each kind of neighbourhood."""
    every = [c for c in map(chr, range(0x2028)) if not UNSURE.match(c)]
    around = ["a", "Z", "7", " ", "\n", "'", "s", ".", "\u00e9", "\u00b2"]
    return ["".join(f"{x}{c}{y} {c}{c}" for x in around for y in around[::3]) for c in every]


class Encoder:
    """The tokenizer's ids of whole texts as bytes, with a store of the words met lately.

    Byte-level BPE merges inside words only, so a text's ids are those of its words one
    after another: each distinct word is given to the tokenizer once, and again if it has not
    been met for ``most`` others. Texts with special tokens or with rare characters are encoded whole. So are all texts with another kind of
    tokenizer, or if the start-up check finds that words and whole texts give other ids.
    """

    def __init__(self, path: str, end_id: int, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.known, self.earlier = Tokenizer.from_file(path), most, {}, {}
        self.kind = np.dtype("<u2" if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        with open(path) as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("truncation") and not spec.get("padding")
        self.words, self.code = WORDS.findall, "H" if self.kind.itemsize == 2 else "I"
        self.width = np.zeros(max(self.tok.get_vocab(True).values(), default=0) + 1, np.int64)
        for name, i in self.tok.get_vocab(True).items():
            self.width[i] = len(name)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        if self.by_word:
            if path not in AGREES:
                texts = start_up_texts()
                AGREES[path] = self(texts) == self._whole(texts)
                self.known.clear()
            self.by_word = AGREES[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], together: int = 500) -> None:
        """Words of a space and letters go to the tokenizer many at a time, as a text that is cut at its spaces."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        rest = list(words.difference(plain))
        self.known.update(zip(rest, self._whole(rest)))
        groups = [plain[k : k + together] for k in range(0, len(plain), together)]
        texts = ["".join(g) for g in groups]
        for group, text, data in zip(groups, texts, self._whole(texts)):
            # a token stands for as many bytes as its name has characters
            ends = np.cumsum(self.width[np.frombuffer(data, self.kind)])
            raw = np.frombuffer(text.encode(), np.uint8)
            stop = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            cut = np.searchsorted(ends, stop) + 1
            if not np.array_equal(ends[cut - 1], stop):
                self.known.update(zip(group, self._whole(group)))
                continue
            cut = [0, *(cut * self.kind.itemsize).tolist()]
            self.known.update(zip(group, [data[a:b] for a, b in zip(cut, cut[1:])]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        each = [None if UNSURE.search(t) or self.special and self.special.search(t) else self.words(t) for t in texts]
        if len(self.known) > self.most:
            # words that are still met come over from the earlier generation, the others go with it
            self.earlier, self.known = self.known, {}
        new = set().union(*[words for words in each if words]).difference(self.known)
        met = [w for w in new if w in self.earlier]
        self.known.update(zip(met, map(self.earlier.__getitem__, met)))
        self._learn(new.difference(met))
        of = self.known.__getitem__
        return [self._whole([t])[0] if words is None else b"".join(map(of, words)) for t, words in zip(texts, each)]


@lru_cache(maxsize=1)
def kept_encoder(path: str, end_id: int) -> Encoder:
    """The process's encoder with the words it has met: Spark gives a process many tasks, and each would meet most words again."""
    return Encoder(path, end_id)


def _write_shard(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, store = TaskContext.get().partitionId(), None
        # 32 bits a length will do: a text has less than 2**31 bytes
        lengths, ids, crc, out = array("I"), [], 0, None
        for piece in in_pieces(batches, limit=1 << 20):
            if out is None:
                store, path = _store(folder)
                encode = kept_encoder(tokenizer, end_id)
                kind, end = encode.kind, np.array([end_id], encode.kind).tobytes()
                # each attempt writes files of its own; the last step puts them in place
                name, mark = f"{path}/{shard:06d}", uuid.uuid4().hex
                out = store.open_output_stream(f"{name}.ids.{mark}")
            texts = [t or "" for t in piece.column("text").to_pylist()]
            parts = [x + end for x in encode(texts)]
            lengths.extend(len(x) // kind.itemsize for x in parts)
            data = b"".join(parts)
            crc = zlib.crc32(data, crc)
            out.write(data)
            ids.append(piece.column("doc_id").to_numpy(zero_copy_only=False) if not piece.column("doc_id").null_count else piece.column("doc_id"))
        if out is None:
            return
        out.close()
        ids = pa.chunked_array([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x for x in ids])
        nulls = ids.null_count
        known = ids.drop_null().to_numpy()
        least = int(known[0]) if len(known) else 0
        (a, bytes_a), (b, bytes_b) = EliasFano.of_lengths(lengths).parts(), EliasFano.of((known - least).astype(np.uint64)).parts()
        header = {"kind": "ids with Elias-Fano ends", "version": 1, "id_type": kind.str, "nulls": nulls, "least": least, "ends": a, "doc_ids": b}
        with store.open_output_stream(f"{name}.idx.{mark}") as f:
            f.write(json.dumps(header).encode() + b"\n")
            for x in (*bytes_a, *bytes_b):
                f.write(x)
        for kept in ("ids", "idx"):
            store.move(f"{name}.{kept}.{mark}", f"{name}.{kept}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(lengths)], "n_tokens": [sum(lengths)], "file_crc32": [crc]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ``folder`` (which all tasks can write); return the manifest.

    One shuffle by ranges of doc_id (equal ones: of the text's first characters, since Spark
    samples what it cuts ranges by) orders the documents, in shards of about ``SHARD_BYTES``.
    No task holds more than a piece of text and its shard's lengths and doc_ids.
    """
    spark = docs.sparkSession
    batches_of(spark)
    folder = resolved(spark, folder)
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(1 + int(size) // SHARD_BYTES, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_write_shard(folder, tokenizer, end_id), "shard long, n_docs long, n_tokens long, file_crc32 long")
    written.write.mode("overwrite").parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    # one row a shard, so a single window over them stays small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def open_shard(folder: str, shard: int):
    """(id type, ends, doc_id of the i-th document, stream of the ids) of one shard."""
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{shard:06d}.idx") as f:
        raw = f.read()
    line, _, rest = raw.partition(b"\n")
    h = json.loads(line)
    import io

    body = io.BytesIO(rest)
    ends, known = EliasFano.read(h["ends"], body), EliasFano.read(h["doc_ids"], body)
    doc_id = lambda i: None if i < h["nulls"] else known.select(i - h["nulls"]) + h["least"]
    return np.dtype(h["id_type"]), ends, doc_id, store.open_input_stream(f"{path}/{shard:06d}.ids")


def _read_shards(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "base"))):
                kind, ends, doc_id, f = open_shard(folder, shard)
                stop = 0
                for a in range(0, ends.n, 2000):
                    rows = []
                    for i in range(a, min(a + 2000, ends.n)):
                        start, stop = stop, ends.select(i)
                        ids = np.frombuffer(f.read((stop - start) * kind.itemsize), kind)
                        rows.append((doc_id(i), base + start, stop - start, zlib.crc32(ids.astype("<u4"))))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    folder = resolved(spark, folder)
    shards = spark.read.parquet(f"{folder}/manifest")
    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(_read_shards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder, where they stay until the session ends, and read them back."""
    spark = docs.sparkSession
    folder = f"{Workspace(spark, 'tokens').root}/files"
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder)
