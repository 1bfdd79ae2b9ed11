"""Token ids as length-delimited binary records with an offset index.

Each record is framed as

    length u64 | masked crc32 of the length u32 | payload | masked crc32 of the payload u32

little-endian, where masking rotates the checksum right by 15 bits and adds 0xA282EAD8, so a checksum of
bytes that hold checksums stays useful. The checksum is CRC-32 (zlib). A payload is one serialized
sequence: flags u8 (bit 0: the document has an id), bytes per id u8 (2 or 4), document id i64, ids. Beside
each shard `x.rec` lies `x.idx`, an (offset u64, length u64) pair per record, for reads in any order.

Documents are range-partitioned and sorted by id, tokenized and written by the same task; shards have
names no other attempt uses, and only those in the committed manifest are read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_dir, staged

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
SEQUENCE = struct.Struct("<BBq")
INDEX = struct.Struct("<QQ")
#: Words and other chunks whose ids a task remembers, so that frequent words are encoded once.
MEMO = 600_000
#: Latin letters, and ASCII marks after them.
PLAIN = r"^(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: A shard is closed beyond this many bytes.
SHARD_BYTES = 256_000_000

MANIFEST = "shard bigint, part int, path string, records bigint, tokens bigint"
MANIFEST_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])


class BadRecord(ValueError):
    """A record whose length or checksum doesn't hold."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + FOOT.pack(masked(size)) + payload + FOOT.pack(masked(payload))


def serialized(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return SEQUENCE.pack(doc_id is not None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, width, doc_id = SEQUENCE.unpack_from(payload)
    if width not in (2, 4) or (len(payload) - SEQUENCE.size) % width:
        raise BadRecord("the sequence's width or length is wrong")
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=SEQUENCE.size).astype("<u4")


def index_of(stream) -> list[tuple[int, int]]:
    """The (offset, length) pairs of an index."""
    return list(INDEX.iter_unpack(stream.read()))


def unframed(stream, offset: int | None = None) -> bytes | None:
    """The next payload of a stream (or the one at `offset`); None at the end; BadRecord if it doesn't hold."""
    if offset is not None:
        stream.seek(offset)
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise BadRecord("the shard ends inside a length")
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise BadRecord("a length's checksum differs")
    payload, foot = stream.read(size), stream.read(FOOT.size)
    if len(payload) < size or len(foot) < FOOT.size:
        raise BadRecord("the shard ends inside a record")
    if masked(payload) != FOOT.unpack(foot)[0]:
        raise BadRecord("a payload's checksum differs")
    return payload


class ChunkEncoder:
    """Encodes whole texts chunk by chunk with a `tokenizers` file whose words never cross a blank.

    The vocabulary's normalizer and pre-tokenizer treat what stands between blanks and line feeds alone,
    so a text's ids are those of its chunks in a row. The distinct chunks of a batch are found by Arrow, and their ids
    dealt to all places at once. A chunk of Latin letters and, after them, ASCII marks is, for a lower-casing vocabulary,
    the lower-case word and the marks, both of which are remembered by the task; words go
    straight to the model. All other chunks go through the whole tokenizer. The test suite compares with encoding whole texts.
    """

    def __init__(self, path: str, end_id: int | None):
        self.path, self.end_id, self.tokenizer = path, end_id, None

    def __getstate__(self):
        return {"path": self.path, "end_id": self.end_id, "tokenizer": None}

    def load(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's core is the one that it has
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.forget()
        letters = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
        self.plain = self.lower_cases() and self.shown(letters)

    def forget(self) -> None:
        """Entry 0 of the table of known ids is that of an empty text."""
        self.words, self.marks = pa.array([], pa.large_string()), pa.array([""], pa.large_string())
        self.word_at, self.mark_at = np.empty(0, np.int32), np.zeros(1, np.int32)
        self.flat, self.sizes = np.empty(0, self.dtype), np.zeros(1, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lower_cases(self) -> bool:
        """Whether case is ignored, letters part from marks, and words stand alone, as far as a probe tells."""
        whole, *parts = self.whole(["Éa Bß.;! b**", "éa", "bß", ".;!", "b", "**"])
        return whole == sum(parts, [])

    def shown(self, letters: str) -> dict[int, str]:
        """How the pre-tokenizer shows each letter to the model."""
        pre = self.tokenizer.pre_tokenizer
        return {ord(c): pre.pre_tokenize_str(c)[0][0] for c in letters}

    def spelled(self, words: list[str]) -> list[list[int]]:
        """The ids of lower-case words, from the model itself."""
        tokenize, plain = self.model.tokenize, self.plain
        return [[t.id for t in tokenize(w if w.isascii() else w.translate(plain))] for w in words]

    def enter(self, ids: list[list[int]]) -> np.ndarray:
        """Adds these ids to the table; returns their entries."""
        first = len(self.sizes)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.dtype)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int32, len(ids))])
        return np.arange(first, len(self.sizes), dtype=np.int32)

    def found(self, wanted: pa.Array, known: pa.Array, at: np.ndarray, read) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is known, its entries, and those of the wanted texts; new ones are read and added."""
        distinct = wanted.dictionary_encode()
        place = pc.index_in(distinct.dictionary, known)
        new = distinct.dictionary.filter(place.is_null())
        if len(new):
            known, at = pa.concat_arrays([known, new]), np.concatenate([at, self.enter(read(new.to_pylist()))])
            place = pc.index_in(distinct.dictionary, known)
        return known, at, at[place.to_numpy()][distinct.indices.to_numpy()]

    def entries(self, chunks: pa.Array) -> np.ndarray:
        """Of each distinct chunk the entries of its word and of its marks; a chunk that isn't plain is an entry of its own."""
        if len(self.sizes) > MEMO:
            self.forget()
        out, plain = np.zeros((len(chunks), 2), np.int32), np.zeros(len(chunks), bool)
        if self.plain:
            parts = pc.extract_regex(chunks, PLAIN)
            plain = parts.is_valid().to_numpy(zero_copy_only=False)
            parts = parts.drop_null()
            word, marks = pc.utf8_lower(pc.struct_field(parts, "word")), pc.struct_field(parts, "marks")
            self.words, self.word_at, out[plain, 0] = self.found(word, self.words, self.word_at, self.spelled)
            self.marks, self.mark_at, out[plain, 1] = self.found(marks, self.marks, self.mark_at, self.whole)
        rest = np.flatnonzero(~plain)
        out[rest, 0] = self.enter(self.whole(chunks.take(pa.array(rest)).to_pylist()))
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a batch, the end id added."""
        if self.tokenizer is None:
            self.load()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        at = self.entries(coded.dictionary)[coded.indices.to_numpy()].ravel()  # word, marks, word, marks ...
        size = self.sizes[at]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        start = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        every = self.flat[np.repeat(start[at] - (ends - size), size) + np.arange(total)]
        bounds = np.append(0, ends[1::2])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        end = np.array([] if self.end_id is None else [self.end_id], self.dtype)
        return [np.concatenate([every[i:j], end]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


class Shard:
    """Writes one shard and its index."""

    def __init__(self, folder: str):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.path, self.records, self.tokens, self.at = f"{folder}/{name}.rec", 0, 0, 0
        self.out, self.index = fs.open_output_stream(f"{base}/{name}.rec"), fs.open_output_stream(f"{base}/{name}.idx")

    def add(self, payload: bytes, tokens: int) -> None:
        raw = framed(payload)
        self.out.write(raw)
        self.index.write(INDEX.pack(self.at, len(raw)))
        self.at += len(raw)
        self.records += 1
        self.tokens += tokens

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.index.close()
        return self.path, self.records, self.tokens


def write_records(docs: DataFrame, folder: str, encoder: ChunkEncoder, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all texts in ascending id order below `folder`; returns the committed manifest.

    Null texts count as empty; null ids come first; equal ids follow the order of their texts' hashes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(ids, encoder.encode(batch.column(1)), strict=True):
                shard = shard or Shard(folder)
                shard.add(serialized(doc_id, tokens, encoder.width), len(tokens))
                if shard.at >= shard_bytes:
                    done.append(shard.close())
                    shard = None
        if shard:
            done.append(shard.close())
        yield pa.RecordBatch.from_pydict(
            {"shard": [(part << 20) + i for i in range(len(done))], "part": [part] * len(done)}
            | {k: [x[i] for x in done] for i, k in enumerate(("path", "records", "tokens"))},
            MANIFEST_ARROW,
        )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one id, or of none, are many partitions' work if they are many: their hashes and places part them.
    narrow = narrow.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ["doc_id", "hash", "place"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each shard. It has one row per shard, some 256 MB of data."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("bigint")))


def read_records(spark: SparkSession, manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """One row per record: doc_id, start, n_tokens, ids_crc32, ids; in shard order, or with `seed` shuffled.

    With `seed`, each task takes its shard's records in random order through the offset index.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"
    return _read(spark, manifest, schema, seed, keep_ids=True)


def read_facts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Like read_records(), without the ids themselves."""
    return _read(spark, manifest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", None, keep_ids=False)


def _read(spark: SparkSession, manifest: DataFrame, schema: str, seed: int | None, keep_ids: bool) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                if seed is None:
                    with fs.open_input_stream(at, buffer_size=1 << 20) as stream:
                        yield from rows(iter(lambda s=stream: unframed(s), None), base)
                else:
                    with fs.open_input_stream(at.removesuffix(".rec") + ".idx") as stream:
                        index = index_of(stream)
                    order = np.random.default_rng([seed, zlib.crc32(path.encode())]).permutation(len(index))
                    with fs.open_input_file(at) as stream:
                        yield from rows((unframed(stream, index[i][0]) for i in order), None)

    def rows(payloads: Iterator[bytes], base: int | None) -> Iterator[pa.RecordBatch]:
        names, got, size = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids, [], 0
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * keep_ids

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate(types)], names)

        for payload in payloads:
            doc_id, ids = parsed(payload)
            got.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes()), ids.astype("<i8") if keep_ids else None))
            base = None if base is None else base + len(ids)
            size += len(ids)
            if len(got) >= 2000 or keep_ids and size > 500_000:
                yield batch()
                got, size = [], 0
        if got:
            yield batch()

    listed = with_starts(manifest).select("path", "base")
    return listed.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """Tokenizes `docs`, writes the records and returns what is read back: doc_id, start, n_tokens, ids_crc32.

    Every row gets a record, repeated rows too; an empty text has only the end id. Extra columns take no part.
    """
    spark = docs.sparkSession
    manifest = write_records(docs, new_dir(spark, "tokens"), ChunkEncoder(tokenizer_path, end_id))
    return read_facts(spark, manifest)
