"""Token ids of whole texts by the tokenizers library, with every distinct word encoded once per task.

A byte-level BPE splits a text into pretokens first, and a pretoken's ids depend on nothing else. A space between
two other characters always starts a pretoken, so the pieces of ``text.split(" ")`` encode apart; their ids are kept
in a bounded table. Texts that hold a special token's string, or white space of which no such cut is certain, and
all texts of other kinds of tokenizers, are encoded whole by the library.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept in the table; when there are more, those seen only once go. An encoder of fewer keeps less of all below in proportion.
PIECES = 700_000
#: Characters of all pieces in the table; text without spaces makes long ones.
CHARACTERS = 14_000_000
#: Pretokens kept with their ids.
PRETOKENS = 400_000
#: Longer pretokens are encoded anew for each piece that holds them.
LONG = 32
#: Characters of text that are looked up in one go.
AT_ONCE = 1_000_000
#: Rows of a batch that are held as Python strings at a time.
ROWS = 256

_UNSURE = re.compile(r"\s (?:\s|\Z)")
#: Letters whose pretokens are the same under any version of Unicode, as ranges of code points.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SAFE = re.compile(rf"[{_LETTERS}{_MARKS}0-9\n]*").fullmatch
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[\n ]+(?![^\n ])|[\n ]+").findall


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _letters(piece: str | tuple[str]) -> int:
    return len(piece[0]) if isinstance(piece, tuple) else len(piece)


class WordEncoder:
    """``encode`` gives the ids that ``Tokenizer.from_file(path)`` gives for whole texts without added special tokens."""

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = kind["model"]["type"] == "BPE" and not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.letters = _byte_letters()
        self.pieces = pieces
        self.characters, self.most_pretokens = (x * pieces // PIECES for x in (CHARACTERS, PRETOKENS))
        self._empty()

    def _empty(self) -> None:
        self.of: dict = defaultdict(count().__next__)
        self.pretokens: dict = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.start = np.empty(1 << 14, dtype=np.int64)
        self.size = np.empty(1 << 14, dtype=np.int32)
        self.hits = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0
        self.chars = 0

    def _thin_out(self) -> None:
        """Keep the pieces seen most often: twice or more, then four times or more, until half of the table is free."""
        least, n = 2, len(self.of)
        chars = np.fromiter(map(_letters, self.of), dtype=np.int64, count=n)
        while (keep := self.hits[:n] >= least).sum() > self.pieces // 2 or chars[keep].sum() > self.characters // 2:
            least *= 2
        self.chars = int(chars[keep].sum())
        size = self.size[:n][keep].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        self.flat[:total] = self.flat[np.repeat(self.start[:n][keep] - (ends - size), size) + np.arange(total)]
        hits = self.hits[:n][keep] // 2
        self.of = defaultdict(count(len(size)).__next__, zip(compress(self.of, keep.tolist()), range(len(size)), strict=True))
        self.size[: len(size)], self.start[: len(size)] = size, ends - size
        self.hits[:] = 0
        self.hits[: len(size)] = hits
        self.used = total

    def _ids(self, pretoken: str | tuple[str]) -> bytes:
        """Ids of one pretoken: as it stands in a text, or (a 1-tuple) in the byte-level alphabet."""
        if isinstance(pretoken, tuple):
            shown = pretoken[0]
        elif pretoken.isascii() and pretoken.isprintable():
            shown = pretoken.replace(" ", self.letters[32])
        else:
            shown = pretoken.encode().decode("latin-1").translate(self.letters)
        found = array("I", [t.id for t in self.tokenize(shown)]).tobytes()  # a third of the array's memory
        if _letters(pretoken) <= LONG:
            self.pretokens[pretoken] = found
        return found

    def _learn(self, new: list) -> None:
        """The ids of the pieces numbered last: a string stands for itself behind a space, a 1-tuple for the start of a text."""
        known, ids_of, cut, sure, size, flat = self.pretokens.get, self._ids, _PRETOKENS, _SAFE, [], bytearray()
        for p in new:
            text, at = (p[0], 0) if isinstance(p, tuple) else (" " + p, 1)
            before = len(flat)
            for x in cut(text) if sure(text, at) else [(x,) for x, _ in self.split(text)]:
                flat += known(x) or ids_of(x)
            size.append((len(flat) - before) // 4)
        at, used = len(self.of) - len(new), self.used
        self.chars += sum(map(len, new)) + sum(len(p[0]) for p in new if isinstance(p, tuple))
        while len(self.of) > len(self.start):
            self.start, self.size, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.hits))
        size = np.array(size, dtype=np.int32)
        self.size[at : at + len(new)] = size
        self.start[at : at + len(new)] = used + np.cumsum(size) - size
        self.used += len(flat) // 4
        while self.used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        if flat:
            self.flat[used : self.used] = np.frombuffer(flat, dtype=np.uint32)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of) > self.pieces or self.chars > self.characters:
            self._thin_out()
        if len(self.pretokens) > self.most_pretokens:
            self.pretokens = {}
        # Every distinct word of these texts is looked up once; a word not yet known gets the next number.
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        distinct, index = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        old, of = len(self.of), self.of.__getitem__
        number = np.fromiter(map(of, distinct), dtype=np.int64, count=len(distinct))
        at = number[index]
        at[begin[:-1]] = [of((distinct[i],)) for i in index[begin[:-1]].tolist()]
        if len(self.of) > old:
            self._learn(list(islice(reversed(self.of), len(self.of) - old))[::-1])
        self.hits[: len(self.of)] += np.bincount(at, minlength=len(self.of)).astype(np.int32)
        size = self.size[at].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.diff(np.r_[0, ends[begin[1:] - 1]]) if len(texts) else np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32), and the number of ids of each text. A null text has none."""
        gc.disable()  # many small lists are made and none in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        some: list[int] = []
        chars = 0

        def flush() -> None:
            flat, sizes = self._words([texts[i] for i in some])
            for i, part in zip(some, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                found[i] = part

        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_word or _UNSURE.search(t) or any(s in t for s in self.specials):
                found[i] = np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, dtype=np.uint32)
                continue
            some.append(i)
            chars += len(t)
            if chars > AT_ONCE:
                flush()
                some, chars = [], 0
        if some:
            flush()
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), sizes


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows, so a worker's memory does not follow the session's batch size."""
    _release()  # what other stages left in the worker
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)
    _release()  # the worker stays and waits beside other stages


def _release() -> None:
    """Unused memory goes back to the system: Arrow's and, by Arrow's pool over malloc, what numpy freed."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


@lru_cache(maxsize=1)
def encoder(path: str, pieces: int = PIECES) -> WordEncoder:
    """The worker's encoder: Python workers serve many tasks, and what one has learnt serves the next."""
    return WordEncoder(path, pieces)
