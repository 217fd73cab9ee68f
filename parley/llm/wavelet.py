"""Token ids in a binary file format of their own: one compressed wavelet matrix per shard.

A shard's ids are stored as bit planes, the highest bit first; each plane is stably sorted by the bits before it.
A directory of ones before every block makes rank and select need one block per plane, so one file answers which
token stands at a place, how often a token occurs and where, without being unpacked. Blocks are compressed one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import tokens
from parley.llm.text import whole
from parley.plans.joins import join_small, running_total
from parley.plans.shared import materialize

MAGIC = b"PWM1"
#: Bytes of a block of a bit plane, and ids of a shard at most (a longer document has a shard of its own).
BLOCK, SHARD_IDS = 1 << 15, 1 << 22
#: Unpacked blocks that a reader keeps.
RECENT = 64


def write_shard(ids: np.ndarray, sizes: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of one shard: ``ids`` of its documents one after another, their ``sizes`` and their doc_ids."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    n, levels = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    held = np.bincount(seq, minlength=1 << levels) if levels <= 16 else None
    zeros, ones, blocks = [], [], []
    span = BLOCK * 8
    for level in range(levels - 1, -1, -1):
        flag = seq.dtype.type(1 << level)
        with_bit = int(held.reshape(-1, 2, 1 << level)[:, 1].sum()) if levels <= 16 else int(np.count_nonzero(seq & flag))
        low, high, before = 0, n - with_bit, 0
        after = np.empty_like(seq)
        # A block at a time stays in the cache; places and a gather move ids faster than boolean masks.
        for k in range(0, n, span):
            part = seq[k : k + span]
            bit = (part & flag) != 0
            blocks.append(squeeze(np.packbits(bit).tobytes()))
            ones.append(before)
            at = np.flatnonzero(bit)
            np.take(part, at, out=after[high : high + len(at)], mode="clip")
            high, before = high + len(at), before + len(at)
            at = np.flatnonzero(np.logical_not(bit, out=bit))
            np.take(part, at, out=after[low : low + len(at)], mode="clip")
            low += len(at)
        zeros.append(n - with_bit)
        seq = after
    docs = squeeze(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + sizes.astype("<i8").tobytes())
    head = struct.pack("<4sQIQQ", MAGIC, n, levels, len(doc_ids), len(docs))
    return b"".join((head, np.array(zeros, "<u8").tobytes(), np.array(ones, "<u8").tobytes(), np.array([len(b) for b in blocks], "<u4").tobytes(), docs, *blocks))


class Shard:
    """Reads a file of ``write_shard``; blocks are unpacked as they are needed."""

    def __init__(self, data: bytes):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        magic, self.n, self.levels, n_docs, n_bytes = struct.unpack_from("<4sQIQQ", data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.per = -(-(-(-self.n // 8)) // BLOCK)
        at = struct.calcsize("<4sQIQQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.zeros = take("<u8", self.levels).astype(np.int64)
        self.ones = take("<u8", self.levels * self.per).astype(np.int64).reshape(self.levels, self.per)
        sizes = take("<u4", self.levels * self.per).astype(np.int64)
        docs = self.unpack(data[at : at + n_bytes])
        at += n_bytes
        self.doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "u1", n_docs, 8 * n_docs), strict=True)]
        self.sizes = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        self.ends = at + np.cumsum(sizes).reshape(self.levels, self.per)
        self.starts = self.ends - sizes.reshape(self.levels, self.per)
        self.data = data
        self.recent: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        """The bytes of one block of a plane; the blocks used last are kept unpacked."""
        got = self.recent.pop((level, k), None)
        if got is None:
            got = np.frombuffer(self.unpack(self.data[self.starts[level, k] : self.ends[level, k]]), np.uint8)
            if len(self.recent) >= RECENT:
                self.recent.pop(next(iter(self.recent)))
        self.recent[level, k] = got
        return got

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, rest = divmod(i, BLOCK * 8)
        if k == self.per:
            return self.n - int(self.zeros[level])
        if not rest:
            return int(self.ones[level, k])
        block, (full, bits) = self._block(level, k), divmod(rest, 8)
        last = (int(block[full]) >> (8 - bits)).bit_count() if bits else 0
        return int(self.ones[level, k]) + int(np.bitwise_count(block[:full]).sum()) + last

    def token(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            k, rest = divmod(i, BLOCK * 8)
            one, before = int(self._block(level, k)[rest >> 3]) >> (7 - rest % 8) & 1, self._ones(level, i)
            out = out << 1 | one
            i = int(self.zeros[level]) + before if one else i - before
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the first ``end`` places' occurrences of ``token`` stand in the order below the last plane."""
        lo, hi = 0, end
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """How often ``token`` occurs among the first ``end`` places (all of them)."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _select(self, level: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """The places of the ``ks``-th (from 0, ascending) bits of this kind in a plane; each block is unpacked once."""
        before = self.ones[level] if bit else np.arange(self.per) * BLOCK * 8 - self.ones[level]
        of = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), dtype=np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(ks)]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            b = int(of[a])
            bits = np.unpackbits(self._block(level, b), count=min(BLOCK * 8, self.n - b * BLOCK * 8))
            out[a:z] = b * BLOCK * 8 + np.flatnonzero(bits == bit)[ks[a:z] - before[b]]
        return out

    def places(self, token: int) -> list[int]:
        """All places at which ``token`` stands, ascending: all occurrences go up the planes together."""
        if token >> self.levels:
            return []
        at = np.arange(*self._range(token, self.n))
        for level in range(self.levels - 1, -1, -1):
            if not len(at):
                break
            one = token >> (self.levels - 1 - level) & 1
            at = self._select(level, one, at - int(self.zeros[level]) if one else at)
        return at.tolist()

    def tokens(self) -> np.ndarray:
        """All ids, plane by plane."""
        out = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            up = np.empty_like(out)
            low, high, flag = 0, int(self.zeros[level]), out.dtype.type(1 << (self.levels - 1 - level))
            out[high:] |= flag
            for k in range(self.per):
                part = up[k * BLOCK * 8 : (k + 1) * BLOCK * 8]
                plane = self.unpack(self.data[self.starts[level, k] : self.ends[level, k]])
                bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=len(part)).view(bool)
                at = np.flatnonzero(bit)
                part[at] = out[high : high + len(at)]
                high += len(at)
                at = np.flatnonzero(~bit)
                part[at] = out[low : low + len(at)]
                low += len(at)
            out = up
        return out


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents, in ascending doc_id order (null first), as shards under ``folder``.

    Every row of the Parquet table written is one shard: task, part, first_id, n_ids and ``file``, the shard's bytes.
    Spark's own commit makes a shard appear once however often its task runs. Rows with one doc_id, or without one,
    stand in the order of a hash of their texts, by which they are also dealt out, so many such rows are many tasks'
    work. A null text is empty and has the end id alone; other columns are ignored; an empty table gives no shard.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    ordered = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, part = tokens.encoder(path), TaskContext.get().partitionId(), 0
        held, sizes, names, total = [], [], [], 0

        def file() -> pa.RecordBatch:
            data = write_shard(np.concatenate(held), np.array(sizes), names)
            return pa.RecordBatch.from_pylist([{"task": task, "part": part, "first_id": names[0], "n_ids": total, "file": data}], schema=_SCHEMA)

        for b in tokens.slices(batches):
            ids, counts = encoder.encode(b.column(1).to_pylist())
            whole_ = np.insert(ids, np.cumsum(counts), end_id)
            ends = np.cumsum(counts + 1)
            own = b.column(0).to_pylist()
            k = 0
            while k < len(own):
                begin = int(ends[k - 1]) if k else 0
                fit = int(np.searchsorted(ends, begin + shard_ids - total, side="right"))
                if fit <= k and total:
                    yield file()
                    part, held, sizes, names, total = part + 1, [], [], [], 0
                    continue
                fit = max(fit, k + 1)
                held.append(whole_[begin : int(ends[fit - 1])])
                sizes += (counts[k:fit] + 1).tolist()
                names += own[k:fit]
                total += len(held[-1])
                k = fit
        if names:
            yield file()

    ordered.mapInArrow(run, "task int, part int, first_id long, n_ids long, file binary").write.option("compression", "uncompressed").parquet(folder)


_SCHEMA = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("file", pa.binary())])


def read(spark, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null doc_ids come first and rows with one doc_id each have a row of their own; no shard gives no rows.
    """
    files = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task, part, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data)
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.sizes), pa.array(crc, pa.int64())],
                    names=["task", "part", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("task", "part", "file").mapInArrow(run, "task int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    base = running_total(files.select("task", "part", "n_ids"), ["task", "part"], F.col("n_ids"), "base").drop("n_ids")
    base = materialize(base)
    placed = join_small(rows, base.withColumnsRenamed({"task": "__task", "part": "__part"}), (F.col("task") == F.col("__task")) & (F.col("part") == F.col("__part")))
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
