"""Token-id files: bit planes, each compressed by zstandard, with chunk and document indexes.

A file holds the ids of a run of documents in ascending id order. Its ids are cut into chunks of
``CHUNK`` ids; a chunk's ids (unsigned, 32 bits) are transposed into bit planes, of which those
above the highest bit in use are not stored. Layout, little-endian:

    "GLBP0001" | planes of chunk 0, lowest first | planes of chunk 1 | ... | documents | chunk index | trailer

``documents`` is a zstandard frame of the document ids (int64) and token counts (int64), the
chunk index one of rows (offset, ids, 32 plane sizes) of int64, and the trailer five int64: offset
and size of the two frames and the number of documents, then "GLBP0001" again. Any chunk can be
read alone by the index.

Files are written by the tasks to the shared folder under a name of the attempt, then moved to
their final name: a task that runs again writes the same file. Memory is bounded by a chunk, a
slice of texts and the document index of one file. Paths may have any scheme that pyarrow's file
systems know.

Nulls count as empty texts; each document ends with the id ``END``. Rows of equal id are ordered
by text, repeated rows are written as often as they come, rows without an id come first. An empty
table writes no file. A text of any length is one row of one file; columns besides the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import partitions, shared_dir, stored, table, text_bytes
from gridloom.llm._units import encoded, gather, slices, totals

MAGIC, CHUNK, END, LEVEL = b"GLBP0001", 1 << 16, 0, 3
_CUT = "\ue000"
_WS = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: No safe cuts: a space before white space or at the end, a line feed beside white space or at an end, a
#: comma or stop after anything but a letter or digit.
_ODD = f"(?:^|[^\\pL\\pN])[.,]|[ ](?:[{_WS}]|$)|\n(?:[{_WS}]|$)|(?:^|[{_WS}])\n"
#: Between a letter or digit and a space before another, any text may be cut. Units that end visibly, and begin so or with one space, may be joined.
_SURE, _JOINABLE = ("([\\pL\\pN])( [\\pL\\pN])", f"\\1{_CUT}\\2"), f"^ ?[^{_WS}](?:(?s:.*)[^{_WS}])?$"
#: Bytes of joined units that the library gets at once, and bytes of text a file should hold.
_JOIN, FILE_BYTES = 1 << 14, 256 << 20


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of ids up to the highest bit in use."""
    ids = ids.astype(np.uint32)
    top = int(ids.max(initial=0)).bit_length()
    byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return [np.packbits(byte[b >> 3] & np.uint8(1 << (b & 7))).tobytes() for b in range(top)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    byte = np.zeros((4, n), np.uint8)
    for b, plane in enumerate(planes):
        byte[b >> 3] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(b & 7)
    return np.ascontiguousarray(byte.T).view("<u4").ravel().astype(np.uint32)


class Writer:
    def __init__(self, sink, chunk: int = CHUNK):
        self.sink, self.chunk, self.at = sink, chunk, 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.n_waiting = [], 0
        self.docs, self.sizes, self.index = [], [], []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> int:
        self.sink.write(raw)
        self.at += len(raw)
        return len(raw)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.astype("<i8"))
        self.sizes.append(sizes.astype("<i8"))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk:
            whole = np.concatenate(self.waiting)
            upto = len(whole) - len(whole) % self.chunk
            for at in range(0, upto, self.chunk):
                self._chunk(whole[at : at + self.chunk])
            self.waiting, self.n_waiting = [whole[upto:].copy()], len(whole) - upto

    def _chunk(self, ids: np.ndarray) -> None:
        start, sizes = self.at, [0] * 32
        for b, plane in enumerate(to_planes(ids)):
            sizes[b] = self._put(self.pack.compress(plane))
        self.index.append([start, len(ids), *sizes])

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        docs = np.concatenate([np.zeros(0, "<i8"), *self.docs])
        a, x = self.at, self._put(self.pack.compress(docs.tobytes() + np.concatenate([np.zeros(0, "<i8"), *self.sizes]).tobytes()))
        b, y = self.at, self._put(self.pack.compress(np.array(self.index, "<i8").tobytes()))
        self._put(np.array([a, x, b, y, len(docs)], "<i8").tobytes() + MAGIC)
        return len(docs), sum(r[1] for r in self.index)


class Reader:
    def __init__(self, source):
        """source: a random access file."""
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        if self._get(0, len(MAGIC)) != MAGIC or self._get(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a token-id file")
        a, x, b, y, n = np.frombuffer(self._get(size - len(MAGIC) - 40, 40), "<i8").tolist()
        raw = np.frombuffer(self._frame(a, x), "<i8")
        self.docs, self.sizes = raw[:n], raw[n:]
        self.index = np.frombuffer(self._frame(b, y), "<i8").reshape(-1, 34)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, at: int, n: int) -> bytes:
        return self.unpack.decompress(self._get(at, n)) if n else b""

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        planes = []
        for s in sizes:
            if not s:
                break
            planes.append(self._frame(at, s))
            at += s
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc ids, sizes, ids of them all), a group of whole documents at a time."""
        done, parts, have = 0, [], 0
        for k in range(len(self.index)):
            parts.append(self.chunk(k))
            have += len(parts[-1])
            if have < self.sizes[done]:
                continue
            rest = np.concatenate(parts)
            ends = np.cumsum(self.sizes[done : done + len(rest) + 1])
            n = int(np.searchsorted(ends, len(rest), side="right"))
            if n:
                yield self.docs[done : done + n], self.sizes[done : done + n], rest[: ends[n - 1]]
                done, parts = done + n, [rest[ends[n - 1] :].copy()]
                have = len(parts[0])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Known:
    """Ids of the first ``most`` distinct units met, as Arrow and NumPy arrays: looked up for all units of
    a slice at once. Frequent units come early; later ones are encoded when they come."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.units, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def of(self, units: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, and how many each has; encode(list) gives (ids, sizes) of those not known."""
        at = pc.index_in(units, value_set=self.units)
        lost = at.is_null().to_numpy(zero_copy_only=False)
        new = units.filter(pa.array(lost))
        found, n = encode(new)
        ids, sizes = np.concatenate([self.ids, found]), np.concatenate([self.sizes, n])
        where = np.zeros(len(units), np.int64)
        where[~lost] = at.drop_null().to_numpy()
        where[lost] = np.arange(len(self.sizes), len(sizes))
        if len(self.units) < self.most:
            self.units, self.ids, self.sizes = pa.concat_arrays([self.units, new.cast(pa.string())]), ids, sizes
        return gather(ids, sizes, where)


class Coder:
    """The ids of texts by the tokenizers library, each distinct unit once. A unit begins at a space
    before a visible character, at a comma or full stop after a letter or digit, or is a line feed between
    visible characters: pre-tokens never cross those places. In texts where these signs stand otherwise too (``_ODD``), units begin only at a
    space between letters or digits, so such a place stays inside its unit; texts with special tokens
    go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [_CUT, *(t.content for t in self.lib.get_added_tokens_decoder().values())]
        # a byte-level token has a character for each of its bytes
        self.width = np.array([len(self.lib.id_to_token(i) or "") for i in range(self.lib.get_vocab_size())], np.int64)
        self.known = Known()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes

    def _joined(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Units that may stand one after another are encoded as a few long strings, those without a space
        in front after a line feed; their ids are told apart by the bytes that tokens stand for. Where
        these don't add up, one by one."""
        names = units.to_pylist()
        bare = ~pc.starts_with(units, " ").to_numpy(zero_copy_only=False).astype(bool)
        ends = np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64) + bare)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(_JOIN, ends[-1], _JOIN)), len(ends))).tolist()
        marked = [f"\n{u}" if b else u for u, b in zip(names, bare.tolist())]
        ids, _ = self._library(["".join(marked[a:b]) for a, b in zip([0, *cuts], cuts) if a < b])
        upto = np.cumsum(self.width[ids])
        last = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or not (upto[last] == ends).all():
            return self._library(names)
        first = np.concatenate([[0], last[:-1] + 1])
        if (self.width[ids[first[bare]]] != 1).any():
            return self._library(names)
        own = np.ones(len(ids), bool)
        own[first[bare]] = False
        return ids[own], last - first + 1 - bare

    def _encode(self, units: pa.Array, most: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes, some units at a time: the library's encodings take far more room than their ids."""
        joinable = pc.match_substring_regex(units, _JOINABLE).to_numpy(zero_copy_only=False).astype(bool)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for which, solve in ((joinable, self._joined), (~joinable, lambda u: self._library(u.to_pylist()))):
            part = units.filter(pa.array(which))
            for k in range(0, len(part), most):
                found, n = solve(part.slice(k, most))
                ids.append(found)
                sizes.append(n)
        order = np.argsort(np.concatenate([np.flatnonzero(joinable), np.flatnonzero(~joinable)]), kind="stable")
        return gather(np.concatenate(ids), np.concatenate(sizes), order)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring(texts, self.special[0])
        for s in self.special[1:]:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        odd = pc.and_not(pc.match_substring_regex(texts, _ODD), whole)
        marked = pc.if_else(pc.or_(odd, whole), pa.scalar("", texts.type), texts)
        for cut in " ,.":
            marked = pc.replace_substring(marked, cut, _CUT + cut)
        marked = pc.replace_substring(marked, "\n", f"{_CUT}\n{_CUT}")
        if pc.any(odd).as_py():
            marked = pc.if_else(odd, pc.replace_substring_regex(pc.if_else(odd, texts, pa.scalar("", texts.type)), *_SURE), marked)
        sizes, units, index = encoded(pc.split_pattern(marked, _CUT))
        ids, n = gather(*self.known.of(units, self._encode), index)
        lengths = totals(n, sizes)
        whole = whole.to_numpy(zero_copy_only=False).astype(bool)
        if whole.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(whole):
                parts[i] = np.array(self.lib.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype="<u4")
            ids, lengths = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, lengths


_CODERS: dict[str, Coder] = {}


def write(docs: DataFrame, path: str, folder: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the files and returns their list (file, part, n_docs, n_ids), itself a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.setdefault(path, None) or Coder(path)
        _CODERS[path] = coder
        files, root = _fs(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        writer = sink = None
        for batch in batches:
            for piece in slices(batch, 1, 8 << 20):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/_part-{part:06d}-{attempt}")
                    writer = Writer(sink)
                ids, n = coder.ids(piece.column(1))
                ends = np.cumsum(n + 1)
                out = np.full(ends[-1], END, np.uint32)
                where = np.ones(ends[-1], bool)
                where[ends - 1] = False
                out[where] = ids
                writer.add(pc.fill_null(piece.column(0), -(1 << 63)).to_numpy(), n + 1, out)
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            name = f"part-{part:06d}.bits"
            files.move(f"{root}/_part-{part:06d}-{attempt}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(max(partitions(docs.sparkSession), -(-text_bytes(rows) // FILE_BYTES)), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return stored(dealt.mapInArrow(run, "file string, part int, n_docs bigint, n_ids bigint"), "manifest")


def digests(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files. The list of files is a
    row a partition; their starts are summed on the driver."""
    found, start, rows = sorted(manifest.collect(), key=lambda r: r["part"]), 0, []
    for r in found:
        rows.append((r["file"], start))
        start += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["start"]
                with files.open_input_file(f"{root}/{row['file']}") as source:
                    for docs, sizes, ids in Reader(source).documents():
                        ends = np.cumsum(sizes)
                        raw = ids.astype("<u4")
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                        ids_of = pa.array(docs, pa.int64(), mask=docs == -(1 << 63))
                        yield pa.RecordBatch.from_arrays([ids_of, pa.array(at + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1])

    listed = spark.createDataFrame(rows, "file string, start bigint")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/gridloom/tokens-{uuid.uuid4().hex}"
    return digests(spark, write(table(spark, sf_dir, "documents"), tokenizer_path(), folder), folder)
