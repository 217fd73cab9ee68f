"""Token counts by a finite-state transducer compiled from a SentencePiece BPE model.

Text is read character by character; the state remembers, for every place at which a piece that is still possible
could begin, which piece ends there and how many tokens ago. That is all the best segmentation of any continuation
depends on, so a transition can carry the number of tokens that it emits (or takes back), and counting is a walk.
States are compiled as texts need them: a new transition is taken once from the library, on the shortest text that
is known to lead to its state, and serves every later text.

Between two characters that stand side by side in no piece nothing can merge: there the state is the start state
again. So the map from a chunk's entry state to its exit state and count is constant past its first such break. Only
the chunk's head, before that, depends on the entry state. Heads of chunks that follow a break are entered in a known
state; those that follow a chunk without any break are entered in the state that the last characters before them lead
to, a guess that is nearly always right. All heads are walked side by side, which gives each chunk a map of the entry
states looked at; a parallel prefix scan composes the maps of neighbouring chunks, and where a composed map leads to
an entry state that a chunk's map lacks, that map is extended and the scan done again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.text import whole
from parley.llm.tokens import slices

#: Characters of a chunk, and characters of text walked side by side.
CHUNK, AT_ONCE = 1 << 12, 1 << 20
#: Characters before a chunk from which its entry state is guessed.
WARM = 64
#: Compiled states above which a task starts its automaton anew.
MOST_STATES = 400_000
SPACE = "▁"


class Transducer:
    """The token-counting automaton of one SentencePiece model, compiled lazily."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        chars = sorted({c for p in pieces for c in p})
        self.chars = chars
        # Character classes: 1.. for characters of pieces, and four classes of others by their UTF-8 bytes.
        self.klass = np.zeros(0x110000, dtype=np.int32)
        n = len(chars)
        for lo, hi, k in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.klass[lo:hi] = n + k
        self.klass[[ord(c) for c in chars]] = np.arange(1, n + 1)
        self.n_klass = n + 5
        if "\n" in chars:
            raise ValueError("the model has pieces with line feeds, which separate texts here")
        self.lead = len(self.model.encode("\n"))
        self.bytes = any(self.model.is_byte(i) for i in range(self.model.vocab_size()))
        of = {c: i + 1 for i, c in enumerate(chars)}
        pairs = {(of[a], of[b]) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        #: inside[a * n_klass + b]: characters a and b stand side by side in some piece.
        self.inside = np.zeros(self.n_klass * self.n_klass, dtype=bool)
        self.inside[[a * self.n_klass + b for a, b in pairs]] = True
        self.reset()

    def reset(self) -> None:
        #: Of each state: the text that led to it, its tokens, and its key: the open suffix, then for every place at
        #: which a piece could begin its distance from the end, the piece that ends there, and the tokens since.
        start = ("", 0, -1, 0)
        self.texts: list[str] = [""]
        self.counts: list[int] = [0]
        self.named: list[tuple] = [start]
        self.states: dict[tuple, int] = {start: 0}
        self.size = 1 << 20
        self.keys = np.full(self.size, -1, dtype=np.int64)
        self.to = np.zeros(self.size, dtype=np.int64)
        self.used = 0

    def _encode(self, text: str) -> list[int]:
        """Ids of ``text`` as the inside of a longer text: the library's leading space is not part of it."""
        # A line feed, which no piece joins with anything, stands in front; its own ids are dropped.
        return self.model.encode("\n" + text.replace(SPACE, " "))[self.lead :]

    def _compile(self, state: int, klass: int) -> tuple[int, int]:
        """The next state and the change of the token count, on reading a character of this class."""
        text, count, key = self.texts[state], self.counts[state], self.named[state]
        if klass > len(self.chars):
            return 0, klass - len(self.chars) if self.bytes else 1
        new = text + self.chars[klass - 1]
        ids = self._encode(new)
        change = len(ids) - count
        # Only places at which a piece that is still possible could begin matter: suffixes that begin a piece.
        live = [0, ids[-1], 0]
        longest = 0
        for i in range(1, len(key), 3):
            d = key[i] + 1
            if new[-d:] in self.prefixes:
                longest = max(longest, d)
                live += (d, key[i + 1], key[i + 2] + change)
        key = (new[len(new) - longest :], *live)
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.texts)
            self.texts.append(new)
            self.counts.append(len(ids))
            self.named.append(key)
        return at, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the free place where it belongs."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self.size - 1)
        wrong = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (self.size - 1)
            found = self.keys[slot[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found >= 0)]
        return slot

    def step(self, states: np.ndarray, klasses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and count changes of many walks at once."""
        keys = states * self.n_klass + klasses
        slot = self._slots(keys)
        unknown = self.keys[slot] < 0
        if unknown.any():
            for k in np.unique(keys[unknown]).tolist():
                state, change = self._compile(k // self.n_klass, k % self.n_klass)
                at = int(self._slots(np.array([k]))[0])
                self.keys[at], self.to[at] = k, state << 16 | (change + 0x8000)
                self.used += 1
                if 2 * self.used > self.size:
                    self._grow()
            slot = self._slots(keys)
        to = self.to[slot]
        return to >> 16, (to & 0xFFFF) - 0x8000

    def _grow(self) -> None:
        held = np.flatnonzero(self.keys >= 0)
        keys, to = self.keys[held], self.to[held]
        self.size *= 2
        self.keys, self.to = np.full(self.size, -1, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        for k, t in zip(keys.tolist(), to.tolist(), strict=True):
            at = int(self._slots(np.array([k]))[0])
            self.keys[at], self.to[at] = k, t

    def walk(self, klasses: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of many walks over stretches of ``klasses``, each from its entry state."""
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        active = int(np.searchsorted(-left, 0, side="left"))
        i = 0
        while active:
            state[:active], change = self.step(state[:active], klasses[at[:active] + i])
            count[:active] += change
            i += 1
            active = int(np.searchsorted(-left[:active], -i, side="left"))
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def count(self, texts: list[str | None], chunk: int = CHUNK, at_once: int = AT_ONCE) -> np.ndarray:
        """Tokens of each text, as the library counts them. Of long texts ``at_once`` characters are looked at in one go."""
        if len(self.texts) > MOST_STATES:
            self.reset()
        normal = [self.model.normalize(t) if t else "" for t in texts]
        total = np.zeros(len(texts), dtype=np.int64)
        state, before = np.zeros_like(total), np.zeros_like(total)  # where a text's part before left off
        rows, at = np.arange(len(texts)), 0
        while len(rows):
            tokens, state[rows], before[rows] = self._parts([normal[i][at : at + at_once] for i in rows], state[rows], before[rows], chunk)
            total[rows] += tokens
            at += at_once
            rows = np.array([i for i in rows.tolist() if len(normal[i]) > at], dtype=np.int64)
        return total

    def _parts(self, parts: list[str], entry: np.ndarray, before: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, exit states and last character classes of parts of texts, entered in states behind characters ``before``."""
        sizes = np.array([len(t) for t in parts], dtype=np.int64)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        total = np.zeros(len(parts), dtype=np.int64)
        if not len(codes):
            return total, entry, before
        klasses = self.klass[codes].astype(np.int64)
        n, ends, some = len(klasses), np.cumsum(sizes), np.flatnonzero(sizes)
        # Breaks: nothing before them reaches past them. Class 0, before a text, stands beside nothing in a piece.
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = ~self.inside[klasses[:-1] * self.n_klass + klasses[1:]]
        starts = (ends - sizes)[some]
        fresh[starts] = ~self.inside[before[some] * self.n_klass + klasses[starts]]
        # Chunks begin at every part and every ``chunk`` characters inside it.
        of_part = np.repeat(np.arange(len(parts)), -(-sizes // chunk))
        begin = np.concatenate([np.arange(e - s, e, chunk) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True) if s])
        end = np.minimum(np.r_[begin[1:], n], ends[of_part])
        breaks = np.flatnonzero(fresh)
        first = np.searchsorted(breaks, begin)
        head = end.copy()
        inner = first < len(breaks)
        head[inner] = np.minimum(breaks[first[inner]], end[inner])
        # Stretches from breaks are walked from the start state, cut at chunk ends: a chunk's last one leaves its exit state.
        cuts = np.unique(np.concatenate((breaks, end)))
        cuts = cuts[cuts < n]
        stretch = cuts[fresh[cuts]]
        stop = np.searchsorted(cuts, stretch, side="right")
        stop = np.where(stop < len(cuts), cuts[np.minimum(stop, max(len(cuts) - 1, 0))], n) if len(cuts) else np.full(len(stretch), n)
        state, tokens = self.walk(klasses, stretch, stop - stretch, np.zeros(len(stretch), dtype=np.int64))
        np.add.at(total, of_part[np.searchsorted(begin, stretch, side="right") - 1], tokens)
        fixed = head < end  # such a chunk leaves one state, however it is entered
        leaves = np.zeros(len(begin), dtype=np.int64)
        leaves[fixed] = state[np.searchsorted(stretch, end[fixed]) - 1]
        self._heads(klasses, begin, head, fixed, leaves, of_part, entry, total)
        out = entry.copy()
        out[of_part] = leaves  # of a part's chunks the last one counts
        last = before.copy()
        last[some] = klasses[ends[some] - 1]
        return total, out, last

    def _heads(self, klasses, begin, head, fixed, leaves, of_part, entry, total) -> None:
        """Add the tokens of all chunks' heads to ``total`` and put the states that chunks without a break leave into ``leaves``."""
        carried = np.flatnonzero(head > begin)
        if not len(carried):
            return
        opens = (carried == 0) | (of_part[carried] != of_part[carried - 1])
        known = opens | fixed[carried - 1]
        enter = np.where(opens, entry[of_part[carried]], leaves[carried - 1])
        guess = carried[~known]
        warm = np.minimum(WARM, begin[guess] - begin[guess - 1])
        enter[~known] = self.walk(klasses, begin[guess] - warm, warm, np.zeros(len(guess), dtype=np.int64))[0]
        left, tokens = self.walk(klasses, begin[carried], head[carried] - begin[carried], enter)
        maps = [{e: (x, t)} for e, x, t in zip(enter.tolist(), left.tolist(), tokens.tolist(), strict=True)]
        runs = np.split(np.arange(len(carried)), np.flatnonzero(known)[1:])
        while runs:
            again, lacking = [], []
            for run in runs:
                own = [maps[i] for i in run]
                ways = [prefix.get(int(enter[run[0]])) for prefix in scan(own)]
                known_to = next((j for j, w in enumerate(ways) if w is None), len(run))
                if known_to < len(run):
                    again.append(run)
                    lacking.append((run[known_to], ways[known_to - 1][0]))
                    continue
                total[of_part[carried[run[0]]]] += ways[-1][1]
                for j, w in zip(run.tolist(), ways, strict=True):
                    if not fixed[carried[j]]:
                        leaves[carried[j]] = w[0]
            if lacking:
                at = carried[[i for i, _ in lacking]]
                states = np.array([s for _, s in lacking], dtype=np.int64)
                left, tokens = self.walk(klasses, begin[at], head[at] - begin[at], states)
                for (i, s), x, t in zip(lacking, left.tolist(), tokens.tolist(), strict=True):
                    maps[i][s] = (x, t)
            runs = again


def composed(a: dict, b: dict) -> dict:
    """The map of two neighbouring chunks: entry state to (exit state, tokens), where ``b`` knows the state that ``a`` leaves."""
    return {e: (b[x][0], n + b[x][1]) for e, (x, n) in a.items() if x in b}


def scan(maps: list[dict]) -> list[dict]:
    """Of chunk maps in order, the composed map of every prefix, in rounds of doubling reach: composition is associative."""
    step = 1
    while step < len(maps):
        maps = [*maps[:step], *(composed(a, b) for a, b in zip(maps, maps[step:], strict=False))]
        step *= 2
    return maps


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """The worker's automaton: Python workers serve many tasks, and states compiled for one serve the next."""
    return Transducer(path)


def counted(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    No begin, end or other special token is counted, and their strings in a text are ordinary text. A null text is
    empty: 0 bytes, 0 tokens. Repeated rows count alike; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(*keep, whole(text).alias("__text"))
    schema = slim.select(*keep).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = transducer(path)
        for b in slices(batches):
            column = b.column(b.num_columns - 1)
            texts = column.to_pylist()
            n_bytes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            n_tokens = np.zeros(len(texts), dtype=np.int64)
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(n_bytes[at:]), AT_ONCE, side="right")) + at)
                n_tokens[at:upto] = automaton.count(texts[at:upto])
                at = upto
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, schema)
