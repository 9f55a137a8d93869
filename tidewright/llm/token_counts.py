"""Token counts by a finite-state tokenizer, compiled from a vocabulary file.

Two transducers stand one behind the other. The first marks where words begin (letters in a run, single digits, runs of
other signs, the contractions 's 't 're 've 'm 'll 'd). The second reads bytes, each with its mark, and every transition
carries the number of tokens by which it changes the count: byte-pair encoding is finite-state, because a sequence of
tokens is the encoding of its text exactly if each two neighbours are the encoding of theirs. A state holds, for
each place where a token that is still being read may have begun, the place in the trie of tokens, the token before it and
the count there against the count here. States are made as they are first met and kept in a dense table.

Texts are laid end to end and cut into equal chunks, which run in lockstep: one NumPy step moves all of them by a symbol.
Each chunk gets a state map, from entry to exit and change of the count, over the entries that can occur there: it runs from
the state between words, then from each exit found for the chunk before, until no new ones appear. A run ends early where it
meets the chunk's first run, at a word's start at the latest. The maps are then composed by a prefix scan in a logarithmic
number of steps. Chunk lengths are multiples of 64, so repeated signs come out of a chunk as they went in and maps stay small.
Should entries go on multiplying, maps stop growing after ``MOST_ROUNDS`` rounds, and one lane follows the chunks that have no
entry for the true state: exact as well, and linear. The table of states never passes ``MOST_STATES``: a block of symbols that
needs more is given up, the table starts afresh and a shorter block is read from the same state.

Defined cases: null counts as empty, an empty text has no bytes and no tokens; the strings of special tokens inside a
text count as one token each, as by the library's default; no truncation, whatever the length; repeated rows are
counted alike; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidewright.llm.common import map_arrow

#: Chunks in lockstep, and symbols that are laid out at a time: what a task holds beside its rows.
LANES, SYMBOLS = 1 << 14, 1 << 22
#: The shortest block, read in one lane, and the unit of a chunk's length.
LEAST_BLOCK, UNIT = 1 << 12, 64
#: The table of states starts afresh at this many; it is a cache, so that changes no count.
MOST_STATES = 130_000
#: Rounds in which state maps gain entries.
MOST_ROUNDS = 32
SPACE, LETTER, DIGIT, OTHER = range(4)
#: The contractions that the pattern splits off, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WORD_END = "</w>"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies, to the byte: printable Latin-1 for
    itself, the others in order from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """For each code point: white space, letter, digit or other."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = DIGIT
    # The code points that Unicode calls white space.
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def word_starts(cps: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a word begins; ``kinds`` are the classes of the code points."""
    starts = kinds != SPACE
    same = np.zeros(len(kinds), dtype=bool)
    same[1:] = (kinds[1:] == kinds[:-1]) & (kinds[1:] != DIGIT)
    starts &= ~same
    marks = np.flatnonzero((cps == ord("'")) & starts)
    if len(marks):
        padded = np.append(cps, np.zeros(3, dtype=cps.dtype))
        length = np.zeros(len(marks), dtype=np.int64)
        for c in CONTRACTIONS:
            fits = np.ones(len(marks), dtype=bool)
            for k, ch in enumerate(c):
                fits &= padded[marks + 1 + k] == ord(ch)
            length[fits & (length == 0)] = len(c)
        found, length = marks[length > 0], length[length > 0]
        starts[found + 1] = False
        after = found + 1 + length
        inside = after < len(cps)
        after = after[inside]
        starts[after[kinds[after] != SPACE]] = True
    return starts


class TableFull(Exception):
    """A block of symbols needs more states than the table may hold."""


class CountMachine:
    """The second transducer, for a vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        signs = byte_signs()
        self.made: dict[str, int] = {}  # rank of the merge that makes a token; those of one byte have none
        self.halves: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for rank, (a, b) in enumerate(merges):
            self.made[a + b], self.halves[a + b], self.rank[a, b] = rank, (a, b), rank
        for s in signs:
            self.made[s] = self.made[s + WORD_END] = -1
        # The trie of all tokens: children by byte, the token that ends here, and the one that ends a word here.
        self.children: list[dict[int, int]] = [{}]
        self.inner: list[str | None] = [None]
        self.final: list[str | None] = [None]
        for token in self.made:
            ends = token.endswith(WORD_END)
            node = 0
            for s in token[: -len(WORD_END)] if ends else token:
                node = self.children[node].setdefault(signs[s], len(self.children))
                if node == len(self.inner):
                    self.children.append({})
                    self.inner.append(None)
                    self.final.append(None)
            (self.final if ends else self.inner)[node] = token
        self.agrees: dict[tuple[str, str], bool] = {}
        self.reset()

    def neighbours(self, left: str | None, right: str) -> bool:
        """Whether the encoding of ``left + right`` is these two tokens: undoes their merges, the latest first, and looks
        whether a merge across the border would have come before."""
        if left is None:
            return True
        key = (left, right)
        known = self.agrees.get(key)
        if known is not None:
            return known
        before, answer = len(self.rank) + 1, True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < before:
                answer = False
                break
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                break
            if a > b:
                before, left = a, self.halves[left][1]
            else:  # at equal rank the merge further left comes first
                before, right = b + 1, self.halves[right][0]
        if len(self.agrees) > 2_000_000:
            self.agrees.clear()
        self.agrees[key] = answer
        return answer

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.ends: list[int] = []
        self.width = 64
        self.symbol = np.full(513, -1, dtype=np.int32)  # symbols seen so far get dense numbers
        self.symbols: list[int] = []
        self.next = np.full((1024, self.width), -1, dtype=np.int32)
        self.delta = np.zeros((1024, self.width), dtype=np.int16)
        self.idle = self._state(())
        self.root = ((0, None, 0),)

    def _state(self, items: tuple) -> int:
        number = self.ids.get(items)
        if number is None:
            number = len(self.items)
            if number >= MOST_STATES:
                raise TableFull
            self.ids[items] = number
            self.items.append(items)
            # At a word's end: the one token that ends the word and agrees with the token before it.
            self.ends.append(next((c + 1 for n, l, c in items if self.final[n] and self.neighbours(l, self.final[n])), 0))
            if number >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return number

    def _read(self, items: tuple, byte: int) -> tuple[tuple, int]:
        """The items after one more byte of a word, and by how much the count changes."""
        going, here = [], None
        for node, left, count in items:
            child = self.children[node].get(byte)
            if child is not None:
                going.append((child, left, count))
                token = self.inner[child]
                if token is not None and here is None and self.neighbours(left, token):
                    here = (token, count + 1)
        token, change = here
        return (*((n, l, c - change) for n, l, c in going), (0, token, 0)), change

    def _fill(self, state: int, dense: int) -> None:
        symbol = self.symbols[dense]
        if symbol == 512:  # white space
            to, change = (), self.ends[state]
        elif symbol >= 256:  # a byte that begins a word
            to, change = self._read(self.root, symbol - 256)
            change += self.ends[state]
        else:
            to, change = self._read(self.items[state] or self.root, symbol)
        number = self._state(to)
        self.next[state, dense], self.delta[state, dense] = number, change

    def dense(self, symbols: np.ndarray) -> np.ndarray:
        for s in np.flatnonzero((np.bincount(symbols, minlength=513) > 0) & (self.symbol < 0)):
            self.symbol[s] = len(self.symbols)
            self.symbols.append(int(s))
        if len(self.symbols) > self.width:
            more = max(self.width, len(self.symbols) - self.width)
            self.next = np.pad(self.next, ((0, 0), (0, more)), constant_values=-1)
            self.delta = np.pad(self.delta, ((0, 0), (0, more)))
            self.width += more
        return self.symbol[symbols]

    def step(self, states: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = states * self.width + dense
        to = self.next.ravel()[at]
        if to.min(initial=0) < 0:
            for k in np.unique(at[to < 0]).tolist():
                self._fill(*divmod(k, self.width))
            to = self.next.ravel()[at]
        return to, self.delta.ravel()[at]

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """Change of the count at each symbol, the first one read between words. What depends on the entry of a chunk is
        counted at the chunk's first symbol: it comes before the next start of a word, so it is of the same text."""
        out = np.empty(len(symbols), dtype=np.int32)
        at, block, entry = 0, SYMBOLS, ()
        while at < len(symbols):
            if len(self.items) > MOST_STATES * 7 // 8:
                self.reset()
            piece = symbols[at : at + block]
            try:
                out[at : at + len(piece)], entry = self._block(piece, entry)
            except TableFull:
                self.reset()
                block = max(block // 8, LEAST_BLOCK)
                continue
            at += len(piece)
            if len(self.items) < MOST_STATES // 4:
                block = min(2 * block, SYMBOLS)
        return out

    def _block(self, symbols: np.ndarray, entry: tuple) -> tuple[np.ndarray, tuple]:
        """Changes in a block entered by the state ``entry``, and the state that it is left by (unless it is the last)."""
        n = len(symbols)
        wanted = 1 if n <= LEAST_BLOCK else min(LANES, n // UNIT)
        length = -(-n // (wanted * UNIT)) * UNIT
        lanes = -(-n // length)
        padded = np.full(lanes * length, 512, dtype=np.int64)
        padded[:n] = symbols
        dense = np.ascontiguousarray(self.dense(padded).reshape(lanes, length).T)
        states = np.zeros((length + 1, lanes), dtype=np.int64)
        out = np.zeros((length, lanes), dtype=np.int32)
        states[0] = self.idle
        states[0, 0] = self._state(entry)
        for t in range(length):
            states[t + 1], out[t] = self.step(states[t], dense[t])
        last = states[length, -1]
        if lanes > 1:
            change, last = self._compose(*self._maps(states, out, dense), states, out, dense)
            out[0] += change
        return out.T.ravel()[:n], self.items[last]

    def _run(self, lane: np.ndarray, entry: np.ndarray, states: np.ndarray, out: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit of each chunk ``lane`` entered by ``entry``, and its count less that of the chunk's first run."""
        exits, change = states[-1, lane], np.zeros(len(lane), dtype=np.int64)
        going, now = np.arange(len(lane)), entry
        for t in range(len(dense)):
            chunk = lane[going]
            now, counted = self.step(now, dense[t, chunk])
            change[going] += counted.astype(np.int64) - out[t, chunk]
            apart = now != states[t + 1, chunk]
            if not apart.all():
                going, now = going[apart], now[apart]
                if not len(going):
                    break
        exits[going] = now
        return exits, change

    def _maps(self, states: np.ndarray, out: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State maps of all chunks as rows (chunk and entry in one code, exit, change of the count), in order of the code."""
        lanes = states.shape[1]
        lane = np.arange(lanes)
        codes, exits, change = lane * MOST_STATES + states[0], states[-1], np.zeros(lanes, dtype=np.int64)
        fresh_lane, fresh_exit = lane, exits
        for _ in range(MOST_ROUNDS):
            inner = fresh_lane < lanes - 1
            found = np.setdiff1d((fresh_lane[inner] + 1) * MOST_STATES + fresh_exit[inner], codes)
            if not len(found):
                break
            fresh_lane, entry = np.divmod(found, MOST_STATES)
            fresh_exit, more = self._run(fresh_lane, entry, states, out, dense)
            codes, exits, change = np.append(codes, found), np.append(exits, fresh_exit), np.append(change, more)
        order = np.argsort(codes)
        return codes[order], exits[order], change[order]

    def _compose(
        self, codes: np.ndarray, exits: np.ndarray, change: np.ndarray, states: np.ndarray, out: np.ndarray, dense: np.ndarray
    ) -> tuple[np.ndarray, int]:
        """The change of the count in each chunk under its true entry, and the last chunk's exit.

        A map is a row of places: where in the next chunk's map its exit is an entry (-1: nowhere). The scan composes each row
        with the row 1, 2, 4, ... chunks before, after which all lead from the first chunk's entry.
        """
        lanes = states.shape[1]
        lane = codes // MOST_STATES
        first = np.searchsorted(lane, np.arange(lanes))
        place = np.arange(len(codes)) - first[lane]
        target = (lane + 1) * MOST_STATES + exits
        at = np.minimum(np.searchsorted(codes, target), len(codes) - 1)
        maps = np.full((lanes, place.max() + 1), -1, dtype=np.int32)
        maps[lane, place] = np.where(codes[at] == target, place[at], -1)
        apart = 1
        while apart < lanes - 1:
            before = maps[:-apart]
            after = np.take_along_axis(maps[apart:], np.maximum(before, 0), axis=1)
            maps[apart:] = np.where(before < 0, -1, after)
            apart *= 2
        entered = np.append(0, maps[:-1, 0])
        unknown = np.flatnonzero(entered < 0)
        rows = first + np.maximum(entered, 0)
        changes, last = change[rows], int(exits[rows[-1]])
        if len(unknown):  # one lane follows from the first chunk whose map lacks the true entry
            known = dict(zip(codes.tolist(), zip(exits.tolist(), change.tolist(), strict=True), strict=True))
            last = int(exits[rows[unknown[0] - 1]])
            for chunk in range(unknown[0], lanes):
                found = known.get(chunk * MOST_STATES + last)
                last, changes[chunk] = found or self._walk(chunk, last, states, out, dense)
        return changes, last

    def _walk(self, chunk: int, state: int, states: np.ndarray, out: np.ndarray, dense: np.ndarray) -> tuple[int, int]:
        """As ``_run``, for one chunk."""
        change = 0
        for d, met, counted in zip(dense[:, chunk].tolist(), states[1:, chunk].tolist(), out[:, chunk].tolist(), strict=True):
            if self.next[state, d] < 0:
                self._fill(state, d)
            change += int(self.delta[state, d]) - counted
            state = int(self.next[state, d])
            if state == met:
                return int(states[-1, chunk]), change
        return state, change

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, for texts that are normalised and hold no special tokens."""
        whole = "\n".join(texts) + "\n"
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = char_classes()[cps]
        starts = word_starts(cps, kinds)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        symbols = data.astype(np.int64)
        symbols[lead[starts]] += 256
        blank = kinds == SPACE
        symbols[lead[blank]] = 512
        keep = np.ones(len(data), dtype=bool)
        wide = np.flatnonzero(blank & (cps > 0x7F))  # the further bytes of wide white space
        for k in (1, 2):
            more = lead[wide] + k
            keep[more[(data[np.minimum(more, len(data) - 1)] & 0xC0) == 0x80]] = False
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        first = lead[np.concatenate([[0], np.cumsum(sizes)[:-1]])]
        if not keep.all():
            first = np.cumsum(keep)[first] - 1
            symbols = symbols[keep]
        return np.add.reduceat(self.emissions(symbols).astype(np.int64), first)


def normalise(text: str) -> str:
    """Canonical composition and lower case, sign by sign (so that no sigma becomes a final one)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def machine(path: str) -> CountMachine:
    return CountMachine(path)


def count_texts(m: CountMachine, texts: list[str]) -> list[int]:
    """Tokens of each text: cut at special tokens, laid out in blocks, counted."""
    special = re.compile("|".join(map(re.escape, m.special)))
    totals = [0] * len(texts)
    owners: list[int] = []
    parts: list[str] = []
    size = 0

    def flush() -> None:
        for owner, n in zip(owners, m.count_batch(parts).tolist(), strict=True):
            totals[owner] += n

    for i, text in enumerate(texts):
        pieces = [text]
        if "<|" in text:
            pieces = special.split(text)
            totals[i] += len(pieces) - 1
        for piece in pieces:
            owners.append(i)
            parts.append(normalise(piece))
            size += len(piece) + 1
            if size >= SYMBOLS:
                flush()
                owners, parts, size = [], [], 0
    if parts:
        flush()
    return totals


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = machine(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts = count_texts(m, texts) if texts else []
        sizes = [len(t.encode()) for t in texts]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every whole text; no shuffle."""
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    counted = map_arrow(chosen, partial(_count_batches, path=path), "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
