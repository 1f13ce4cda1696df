"""Operator 10, token ids in independent zstandard frames with a trailing seek table.

A file is a run of frames, one per document, each compressed alone, then a
skippable frame with the document ids and a skippable frame with the seek table
of the zstandard seekable format: per frame the compressed size, the size and a
checksum. A reader maps a document to its frame, seeks, and decompresses that
frame only.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import cut, map_arrow, shared_path

# Fixed values of the zstandard frame format and of its seekable format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

END_ID = 2
#: Words kept per Python worker; the store is emptied when it is full.
WORD_STORE = 800_000
#: Documents encoded together.
ENCODE_DOCS = 1024
#: ASCII marks that the tokenizer splits from letters before them.
MARKS = ".,;:!?#$%&*|-+=/)]}"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LETTERS = _byte_letters()


#: Texts by which a vocabulary file shows whether it takes texts apart as ``word_bpe_49k.json`` does.
PROBES = (
    "a b", " A  b\nc\n", "C'mon don't-- x_y a1b2 I'll", "ab.,c \t\x1c q", "end)]} #%&*|-+=/ $5.00?", "<|endoftext|>a<|endoftext|> <s> </s> [INST]", "É été über ÿþß µm ª º ñandú",
    "İ ΟΔΟΣ. x\u0301. 梦 语", "Hello!! WORLD;: (see [it]", "x" * 300, "", "  \n\n ", "1234567 12 a1", "\u00a0a\u00a0b\u2003c",
)


class WordEncoder:
    """Whole-text ids from ids of the pieces between spaces and line feeds.

    ``word_bpe_49k.json`` drops white space, splits at it before any merge, and
    its special strings hold none, so a text's ids are those of its pieces in a
    row. It also splits letters from marks and lower-cases, so a piece of Latin-1
    letters and trailing marks is the lower-cased letters and then the marks, and
    the letters are one pretoken, given to the model as byte letters.
    Ids are kept as little-endian bytes, of pieces and of such cores. A file by
    which the probes come out otherwise is used for whole texts instead.
    """

    def __init__(self, path: str, store: int = WORD_STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.store = Tokenizer.from_file(path), store
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}
        self.by_words = True
        try:
            self.by_words = self.encode(list(PROBES)) == self._whole(list(PROBES))
        except Exception:  # noqa: BLE001 - a model of another kind may raise anything; whole texts need nothing of it
            self.by_words = False

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _core(self, core: str) -> bytes:
        """Ids of a lower-case core of Latin-1 letters: one pretoken, so the model alone is asked."""
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = array("I", [t.id for t in self.model.tokenize(core)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, missing: set[str]) -> None:
        if len(self.cores) > self.store:
            self.cores = {"": b""}
        cores, known, rest = self.cores, self.known, {}
        for w in missing:
            core = w.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                low = core.lower()
                ids = cores.get(low)
                if ids is None:
                    ids = cores[low] = self._core(low)
                tail = w[len(core) :]
                if tail in cores:
                    known[w] = ids + cores[tail]
                else:
                    rest[w] = (ids, tail)
            else:
                rest[w] = (b"", w)
        new = list({tail for _, tail in rest.values() if tail not in cores})
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            cores[x] = np.array(e.ids, "<u4").tobytes()
        for w, (ids, tail) in rest.items():
            known[w] = ids + cores[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self._whole(texts)
        if len(self.known) > self.store:
            self.known.clear()
        words = [t.replace("\n", " ").split(" ") for t in texts]
        ids = [list(map(self.known.get, w)) for w in words]
        short = [k for k, own in enumerate(ids) if None in own]
        if short:
            self._learn({w for k in short for w, i in zip(words[k], ids[k]) if i is None})
            for k in short:
                ids[k] = map(self.known.__getitem__, words[k])
        return [b"".join(own) for own in ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, kept from task to task."""
    return WordEncoder(path)


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes frames to ``sink`` and, on close, the document ids and the seek table."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.coder = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[bytes] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.coder.compress(data)
        self.sink.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(data), checksum(data)))
        self.ids.append(doc_id)

    def close(self) -> None:
        known = b"".join(struct.pack("<?q", i is not None, i or 0) for i in self.ids)
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(known)) + known)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads a frame file from a seekable ``source``, only the frames asked for."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        table_at = size - 9 - 12 * n
        table = np.frombuffer(self._read(table_at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        if struct.unpack("<II", self._read(table_at - 8, 8)) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("broken seek table")
        self.sizes, self.checks = table[:, 0], table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes))) if n else np.zeros(1, np.int64)
        ids_at = int(self.starts[-1])
        if struct.unpack("<II", self._read(ids_at, 8)) != (SKIPPABLE_IDS, 9 * n):
            raise ValueError("broken id table")
        known = self._read(ids_at + 8, 9 * n)
        self.ids = [i if has else None for has, i in struct.iter_unpack("<?q", known)]
        self.coder = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("file ends early")
        return data

    def frame(self, k: int) -> bytes:
        """The bytes of frame ``k``, checked."""
        data = self.coder.decompress(self._read(int(self.starts[k]), int(self.sizes[k])))
        if checksum(data) != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the wanted documents, or of all, in file order."""
        keep = None if wanted is None else set(wanted)
        for k, i in enumerate(self.ids):
            if keep is None or i in keep:
                yield i, np.frombuffer(self.frame(k), "<u4")


def open_store(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_frames(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all of ``docs`` in ascending id order; returns the manifest (part, path, n_docs, n_tokens).

    One file per sorted range. Ties of an id are ordered by text, null ids come
    first, null texts are empty. A file is written under an attempt's own name
    and then moved, so a repeated task leaves whole files with equal content.
    """

    def run(batches):
        ctx = TaskContext.get()
        part, writer, n_tokens = ctx.partitionId(), None, 0
        words = encoder(tokenizer_path)
        end = struct.pack("<I", END_ID)
        store, folder = open_store(out)
        store.create_dir(folder, recursive=True)
        path, trial = f"{folder}/part-{part:06d}.zst", f"{folder}/.part-{part:06d}-{ctx.taskAttemptId()}"
        with store.open_output_stream(trial) as sink:
            writer = FrameWriter(sink)
            for b in batches:
                for at in range(0, b.num_rows, ENCODE_DOCS):
                    own = b.slice(at, ENCODE_DOCS)
                    for i, data in zip(own.column(0).to_pylist(), words.encode([t or "" for t in own.column(1).to_pylist()])):
                        data += end
                        n_tokens += len(data) // 4
                        writer.add(i, data)
            writer.close()
        store.move(trial, path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.ids)], pa.int64()), pa.array([n_tokens], pa.int64())],
            ["part", "path", "n_docs", "n_tokens"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return cut(map_arrow(ordered, run, "part int, path string, n_docs long, n_tokens long"))


def read_frames(manifest: DataFrame, out: str) -> DataFrame:
    """One row (doc_id, start, n_tokens, ids_crc32) per document, read back from the files of ``manifest``."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", before.cast("long").alias("base"))

    def run(batches):
        store = open_store(out)[0]
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(path) as source:
                    ids, starts, counts, sums = [], [], [], []
                    for i, tokens in FrameReader(source).documents():
                        ids.append(i)
                        starts.append(base)
                        counts.append(len(tokens))
                        sums.append(zlib.crc32(tokens.tobytes()))
                        base += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(files.repartition(tasks, "part").select("path", "base"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    """Writes ``docs`` and reads them back: per document doc_id, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts hold the end id only; repeated rows come out as often
    as they come in; no rows give no rows.
    """
    out = out or shared_path(docs.sparkSession, "tokens")
    return read_frames(write_frames(docs, tokenizer_path, out), out)
