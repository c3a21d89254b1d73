"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in this order,
  * frames: each is an independent zstandard frame of little-endian unsigned
    32-bit ids of whole documents (a long document fills frames of its own);
  * an index: a skippable frame with the key, first id and number of ids of each
    document of the file, itself compressed;
  * the seek table: a skippable frame as in the public seekable format, for each
    frame its compressed size, its raw size and the low 32 bits of the XXH64 of
    its raw bytes, then the number of frames, a descriptor and a magic number.
A reader takes the last bytes of a file, then the index, then only the frames
that hold the documents it was asked for, and checks each frame's checksum.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, load
from .textkit import pieces

SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FRAME_IDS = 1 << 16
LEVEL = 3
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
HEADER = struct.Struct("<II")
#: Stands in the index for a null key.
NO_KEY = -(1 << 63)
INDEX_ROW = np.dtype([("key", "<i8"), ("first", "<u8"), ("count", "<u8")])

CACHED_WORDS = 1_000_000
CACHED_CHUNKS = 300_000
#: Texts that the quick path takes: letters whose lower case and composed form are plain, then ASCII punctuation.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=>?@\[\]^_`{|}~*]*)")
#: White space is what the tokenizer's \s matches; Python's also has U+001C to U+001F, which have ids.
SEPARATORS = re.compile("[\x1c-\x1f]")
CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordEncoder:
    """Ids of a text under a tokenizer that drops white space, one white-space-free chunk at a time.

    The tokenizer's normalizer and pre-tokenizer never look across white space, so
    the ids of a text are those of its chunks. Chunks of plain letters and
    punctuation go to the library's merging alone, once per lower-cased word; all
    others to the library's whole encoding. Both are kept in a bounded cache.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _word(self, word: str) -> bytes:
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        shown = "".join([self.letter[b] for b in word.encode()])
        got = self.words[word] = _pack([t.id for t in self.tokenizer.model.tokenize(shown)] if word else [])
        return got

    def chunk(self, chunk: str) -> bytes:
        match = PLAIN.fullmatch(chunk)
        if match:
            word, marks = match[1].lower(), match[2]
            got = self.words.get(word) or self._word(word)
            if marks:
                got += self.words.get(marks) or self._word(marks)
        else:
            got = _pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(self.chunks) >= CACHED_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = got
        return got

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        seen, make = self.chunks.get, self.chunk
        chunks = CHUNK.findall(text) if SEPARATORS.search(text) else text.split()
        return b"".join([seen(chunk) or make(chunk) for chunk in chunks])

    def text(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(config: str) -> WordEncoder:
    """One encoder a worker process and configuration, kept over its tasks."""
    known = zlib.crc32(config.encode())
    if known not in _ENCODERS:
        _ENCODERS[known] = WordEncoder(config)
    return _ENCODERS[known]


class FrameWriter:
    """Writes documents' ids to a binary stream in the format above."""

    def __init__(self, out):
        self.out = out
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, key: int, ids: bytes | list[int]) -> None:
        array = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else np.array(ids, dtype="<u4")
        self.index.append((key, self.total, len(array)))
        self.total += len(array)
        if self.waiting and self.waiting + len(array) > FRAME_IDS:
            self._flush()
        for at in range(0, len(array), FRAME_IDS):
            self.held.append(array[at : at + FRAME_IDS])
            self.waiting += len(self.held[-1])
            if self.waiting >= FRAME_IDS:
                self._flush()

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.held).tobytes())
        self.held, self.waiting = [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack.compress(np.array(self.index, dtype=INDEX_ROW).tobytes())
        self.out.write(HEADER.pack(SKIPPABLE_INDEX, len(index)) + index)
        self.entries.append((HEADER.size + len(index), 0, 0))
        body = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(HEADER.pack(SKIPPABLE_SEEK, len(body)) + body)


class FrameReader:
    """Reads chosen documents from a file of the format above."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flag, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("the file has no seek table")
        table = self._read(size - FOOTER.size - frames * ENTRY.size, frames * ENTRY.size)
        entries = np.frombuffer(table, dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.checks = entries[:-1, 2]
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(entries[:-1, 1])]) // 4
        packed = self._read(int(self.starts[-2]) + HEADER.size, int(entries[-1, 0]) - HEADER.size)
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=INDEX_ROW) if packed else np.zeros(0, INDEX_ROW)
        self.opened = 0
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _frame(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            packed = self._read(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.raw[i + 1] - self.raw[i]) * 4)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[i]:
                raise ValueError(f"frame {i} is damaged")
            self.opened += 1
            self.last = (i, np.frombuffer(raw, dtype="<u4"))
        return self.last[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the file's document number ``row``; only frames that hold them are decompressed."""
        first, count = int(self.index["first"][row]), int(self.index["count"][row])
        found, at = [], first
        i = int(np.searchsorted(self.raw, first, side="right")) - 1
        while at < first + count:
            frame = self._frame(i)
            part = frame[at - self.raw[i] : first + count - self.raw[i]]
            found.append(part)
            at += len(part)
            i += 1
        return np.concatenate(found) if found else np.zeros(0, "<u4")


def store(docs: DataFrame, config: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts, in ascending order of key, to files in ``folder``; returns the manifest.

    The manifest, written as a table, has a row for each file that counts: a task
    that is repeated or speculated writes another file, and only the manifest rows
    of the tasks that Spark committed name their files. ``start`` numbers the ids of
    the whole table. Null and empty texts have the end id alone, repeated keys are
    stored in the order of their texts, and an empty table has an empty manifest. Rows
    with a null key come first; the files hold NO_KEY for it, so that isn't a key.
    """
    shared = docs.sparkSession.sparkContext.broadcast(config)  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end = encoder(shared.value), _pack([end_id])
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/ids-{uuid.uuid4().hex}.zst"
        out, writer = None, None
        for batch in pieces(batches, text):
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if writer is None:
                    out = fs.open_output_stream(name, compression=None)
                    writer = FrameWriter(out)
                writer.add(k, made.packed(t or "") + end)
        if writer is not None:
            writer.close()
            out.close()
            row = {"file": [name.rpartition("/")[2]], "low": [writer.index[0][0]], "high": [writer.index[-1][0]], "docs": [len(writer.index)], "ids": [writer.total]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias(key), text).repartitionByRange(parts, key).sortWithinPartitions(key, text)
    return ordered.mapInArrow(run, "file string, low bigint, high bigint, docs bigint, ids bigint")


def read_back(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """One row per stored document, from the files: key, start, n_tokens, ids_crc32; a key that was null is null again."""
    # one row a file, some hundred bytes for each part of the table: a sort of the manifest alone
    before = Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    parts = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = FrameReader(source)
                    for a in range(0, len(reader.index), 1 << 14):
                        part = reader.index[a : a + (1 << 14)]
                        crc = [zlib.crc32(reader.ids(a + i).tobytes()) for i in range(len(part))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["key"].copy()), pa.array(part["first"].astype(np.int64) + start), pa.array(part["count"].astype(np.int64)), pa.array(crc, pa.int64())],
                            [key, "start", "n_tokens", "ids_crc32"],
                        )

    found = files.select("file", "start").repartition(parts, "file").mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumn(key, F.nullif(F.col(key), F.lit(NO_KEY)))


def configuration(name: str = "word_bpe_49k.json") -> str:
    """The file of a public tokenizer, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op2")
    folder = space.path("ids")
    manifest = space.table(store(load(spark, sf_dir, "documents"), configuration(), 1, folder), "manifest")
    return read_back(manifest, folder)
