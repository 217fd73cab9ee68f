"""BPE encoding and decoding of whole texts through a table of distinct words.

A word is a run of anything but ASCII white space. Where a tokenizer drops white space before it merges, a text's ids
are its words' ids one after another, so every distinct word is encoded once and its ids are joined back by position.

A task splits its texts into blocks of BLOCK bytes. A block keeps its distinct words, dealt over SLOTS parts by a hash,
and for every place in its texts the number of the word that stands there. Equal words of all blocks meet in their
slot, where each is encoded once; their ids return to the blocks and are gathered in the order of the places. Words
move once a block and not once an occurrence, so common words are no hot keys, and no text is shuffled.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.text import whole

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 12 << 20
#: Parts of the word table. A task holds the words of one part at a time.
SLOTS = 2048
#: Rows decoded at a time.
ROWS = 256


def _small(text: str) -> bytes:
    """A text as zstd behind its length in bytes."""
    data = text.encode()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _large(data: bytes) -> str:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as zstd over their byte planes, behind their count."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _check(path: str) -> None:
    """Raise unless the tokenizer surely drops white space, so that words encode apart, and joins pieces by spaces."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    dropped = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    known = {"NFC", "NFD", "Replace", "Lowercase"} >= {n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])}
    whole_words = all(not any(c.isspace() for c in t["content"]) and not t["single_word"] for t in kind["added_tokens"])
    if not (dropped and known and whole_words and kind.get("decoder") is None):
        raise ValueError(f"{path}: not a tokenizer whose words encode apart")


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _block(texts: pa.Array, slots: int) -> tuple[np.ndarray, bytes, bytes]:
    """Words of each text, the numbers of the words at all places, and the distinct words: a line for each slot."""
    cut = pc.ascii_split_whitespace(texts)
    begin, words = cut.offsets.to_numpy(), cut.flatten()
    real = pc.not_equal(words, "")  # white space at the ends of a text gives empty strings
    upto = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    words = words.filter(real).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    slot = np.fromiter((zlib.crc32(w.encode()) % slots for w in distinct), dtype=np.int64, count=len(distinct))
    order = np.argsort(slot, kind="stable")
    number = np.empty(len(distinct), dtype=np.int64)
    number[order] = np.arange(len(distinct))
    ends = np.searchsorted(slot[order], np.arange(slots + 1))
    dealt = [distinct[i] for i in order.tolist()]
    parts = "\n".join(" ".join(dealt[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    places = number[words.indices.to_numpy()]
    return np.diff(upto[begin]), _packed(places), _small(parts)


def _split(batches: Iterator[pa.RecordBatch], names: list[str], slots: int, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        length = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < batch.num_rows:
            upto = max(begin + 1, begin + int(np.searchsorted(np.cumsum(length[begin:]), size, side="right")))
            rows = batch.slice(begin, upto - begin)
            begin = upto
            sizes, places, parts = _block(rows.column(rows.num_columns - 1).cast(pa.large_string()), slots)
            one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
            kept = [one(c) for c in rows.columns[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *kept, one(pa.array(sizes, pa.int64())), pa.array([places], pa.binary()), pa.array([parts], pa.binary())], names=names)
            at += 1


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, slot, words) for the slots of a block that hold words."""
    for batch in batches:
        for block, parts in zip(batch.column("block"), batch.column("words"), strict=True):
            some = [(i, _small(words)) for i, words in enumerate(_large(parts.as_py()).split("\n")) if words]
            yield pa.RecordBatch.from_arrays([pa.repeat(block, len(some)), pa.array([i for i, _ in some], pa.int32()), pa.array([w for _, w in some], pa.binary())], names=["block", "slot", "words"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The ids of each slot's words; rows come sorted by slot, and a slot's table of words lasts for all its rows."""
    encode, current, known = _tokenizer(path).encode_batch_fast, -1, {}
    for batch in batches:
        sizes, flat = [], []
        slots, bundles = batch.column(1).to_pylist(), [_large(w).split(" ") for w in batch.column(2).to_pylist()]
        at = 0
        while at < len(slots):
            upto = at
            while upto < len(slots) and slots[upto] == slots[at]:
                upto += 1
            if slots[at] != current:
                current, known = slots[at], {}
            new = list(dict.fromkeys(w for words in bundles[at:upto] for w in words if w not in known))
            known.update(zip(new, (np.array(e.ids, dtype="<u4").tobytes() for e in encode(new, add_special_tokens=False)), strict=True))
            for words in bundles[at:upto]:
                ids = [known[w] for w in words]
                sizes.append(_packed(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4))
                flat.append(_packed(np.frombuffer(b"".join(ids), dtype="<u4")))
            at = upto
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())], names=["block", "slot", "sizes", "ids"])


def _gathered(left: pa.Table, right: pa.Table, keep: list[str]) -> pa.Table:
    """The documents of one block with their ids, gathered by the numbers of the words at their places."""
    left, right = left.combine_chunks(), right.sort_by("slot")
    size = np.concatenate([np.empty(0, np.uint32), *map(_unpacked, right.column("sizes").to_pylist())]).astype(np.int64)
    flat = np.concatenate([np.empty(0, np.uint32), *map(_unpacked, right.column("ids").to_pylist())])
    start = np.cumsum(size) - size
    places = _unpacked(left.column("places")[0].as_py())
    n = size[places]
    ends = np.cumsum(n)
    ids = flat[np.repeat(start[places] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    words = left.column("sizes")[0].values.to_numpy()
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(words)]]
    found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.Table.from_arrays([*[left.column(c)[0].values for c in keep], found], names=[*keep, "ids"])


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every whole text: the library's ids, without added special tokens.

    Strings of special tokens inside a text become their ids, as the library has it. A null or blank text has no
    ids; null keys, equal rows and other columns are no special case; an empty table gives no rows. ``slots`` bounds
    what a task holds: the distinct words of the corpus divided by it.
    """
    _check(path)
    slim = docs.select(*[F.col(c) for c in keep], whole(text).alias("__text"))
    names = [f"__k{i}" for i in range(len(keep))]
    kept = [T.StructField(n, T.ArrayType(slim.schema[c].dataType)) for n, c in zip(names, keep, strict=True)]
    schema = T.StructType([T.StructField("block", T.LongType()), *kept, T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("places", T.BinaryType()), T.StructField("words", T.BinaryType())])
    # Both readers of the blocks take every column, so they share one exchange and texts are split once.
    blocks = slim.mapInArrow(partial(_split, names=schema.names, slots=slots, size=block), schema).repartition("block")
    words = blocks.mapInArrow(_spread, "block long, slot int, words binary").repartition("slot").sortWithinPartitions("slot")
    ids = words.mapInArrow(partial(_encode, path=path), "block long, slot int, sizes binary, ids binary")
    found = T.StructType([*[T.StructField(n, slim.schema[c].dataType) for n, c in zip(names, keep, strict=True)], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lambda left, right: _gathered(left, right, names), found)
    return joined.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the library decodes from ``ids``, special tokens included: their pieces, joined by spaces.

    The table of pieces, of fixed size, goes to every task and is joined by position, as ids number it without gaps.
    Null ids give null, no ids the empty text; an id beyond the vocabulary is left out.
    """
    _check(path)
    tokenizer = _tokenizer(path)
    pieces = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces, pa.large_string())
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lists = part.column(names.index(ids))
                flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                bounds = np.r_[0, np.cumsum(sizes)]
                known = pc.fill_null(pc.and_(pc.less(flat, len(pieces)), pc.greater_equal(flat, 0)), False)
                at = np.r_[0, np.cumsum(known.to_numpy(zero_copy_only=False))]
                texts = table.take(flat.filter(known))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(at[bounds], texts), pa.scalar(" ", pa.large_string()))
                joined = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), joined)
                yield pa.RecordBatch.from_arrays([*part.columns, joined.cast(pa.string())], names=[*names, out])

    return rows.mapInArrow(run, schema)
