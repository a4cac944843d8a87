"""Byte-level BPE as a streaming transducer with bounded look-ahead, and the way back.

A sequence of tokens is the encoding of its bytes exactly when each neighbouring pair is the encoding of its own bytes.
So for every position of a byte stream there is one last token, found from the last tokens of at most ``longest`` earlier
positions. Following these back from the last ``longest`` positions, all paths meet; tokens before that place can no longer
change and leave. How far back they meet is bounded by a number computed from the merge list (``MergeTable.lookahead``),
so pending bytes never exceed it, however long a run of letters or blanks is. What a worker remembers between texts is
bounded in bytes (``CACHES``).

Decoding is a state machine from bytes to text that keeps at most three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairlens.llm.common import ByteMemo, slices, strings

SPACE = r"\t-\r \x85\xa0  -     　"
LETTER, NUMBER = r"\p{L}", r"\p{N}"
OTHER = rf"[^{SPACE}\p{{L}}\p{{N}}]"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
RUNS = {name: regex.compile(f"{one}+") for name, one in (("letter", LETTER), ("number", NUMBER), ("other", OTHER), ("space", f"[{SPACE}]"))}
SAFE_CUT = regex.compile(rf"(?r)(?<=[^{SPACE}]) (?=[^{SPACE}])")
BLANKS = frozenset(chr(c) for c in range(0x3001) if regex.match(f"[{SPACE}]", chr(c)))
FEED = 1 << 16
CACHED_KEY = 64
#: Bytes of each cache of a worker, 374 MB together.
CACHES = {"neighbours": 64 << 20, "steps": 40 << 20, "heads": 64 << 20, "first": 2 << 20, "after": 192 << 20, "words": 12 << 20}
HEAD = 6
#: Bytes of texts or ids that a worker answers at a time.
SLICE = 4 << 20


def _vocabulary(path: str) -> tuple[dict, dict[str, int], dict[bytes, int], dict[str, int]]:
    """The file, the byte that each character of its tokens stands for, ids of tokens by their bytes, and added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return spec, byte_of, {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}, added


class MergeTable:
    """Tokens as bytes, merges by rank, which pairs of tokens may be neighbours, and the look-ahead bound."""

    def __init__(self, path: str):
        spec, byte_of, ids, self.added = _vocabulary(path)
        self.bytes_of = {i: b for b, i in ids.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (ids[bytes(byte_of[c] for c in x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges[left, right] = (rank, ids[self.bytes_of[left] + self.bytes_of[right]])
        self.lookahead = self._bound()
        self.neighbours = ByteMemo(self._may_follow, CACHES["neighbours"])
        # only tokens that are the encoding of their own bytes can occur
        self._proper = {piece: i for piece, i in ids.items() if self.merged(piece) == [i]}
        self.longest = max(map(len, self._proper))
        self.size_of = {i: len(piece) for piece, i in self._proper.items()}
        self._heads = {piece[:k] for piece in self._proper for k in range(1, len(piece) + 1)}
        self._names, self._numbers = [b""], {b"": 0}
        self.steps = ByteMemo(self._step, CACHES["steps"])

    def _may_follow(self, pair: int) -> bool:
        left, right = pair >> 20, pair & 0xFFFFF
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _step(self, key: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """From a state (the longest end of the bytes read that starts a token) by one byte: the state it leads to, and the tokens ending there, longest first."""
        name = self._names[key >> 8] + bytes([key & 255])
        while name not in self._heads:
            name = name[1:]
        if name not in self._numbers:
            self._numbers[name] = len(self._names)
            self._names.append(name)
        ends = [(self._proper[name[k:]], len(name) - k) for k in range(len(name)) if name[k:] in self._proper]
        return self._numbers[name], tuple(ends)

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the leftmost pair of least rank until none is left (short inputs)."""
        parts, merges = [self.single[b] for b in data], self.merges.get
        while True:
            best, at = None, 0
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                rank = merges(pair)
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [best[1]]

    def _bound(self) -> int:
        """Bytes before the end of what is known from which on tokens may still change.

        Unknown bytes can take the last token as right part of a merge, or withhold it from a merge to its left, which
        frees or takes the token before, and so on. Each step goes one left part to the left and needs a merge of
        higher rank, whose right part starts where the step before began. The bound is the longest such chain.
        """
        reach: dict[int, int] = {}
        parts = {made: pair for pair, (_, made) in self.merges.items()}
        for (left, right), _ in sorted(self.merges.items(), key=lambda m: m[1][0]):
            far, start = 0, right
            while True:
                far = max(far, reach.get(start, 0))
                if start not in parts:
                    break
                start = parts[start][0]
            reach[left] = max(reach.get(left, 0), len(self.bytes_of[left]) + far)
        return max(reach.values(), default=0)


class Transducer:
    """Encodes one pre-token given in parts; ``feed`` returns the tokens that are settled, ``finish`` the rest."""

    def __init__(self, table: MergeTable):
        self._table = table
        self._heads = ByteMemo(self._after_head, CACHES["heads"])
        self._reset()

    def _reset(self) -> None:
        self._last: list[int] = []  # the last token at each position since the last settled one
        self._state, self._before = 0, None

    @property
    def pending(self) -> int:
        return len(self._last)

    def feed(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), 256):
            self._advance(data[at : at + 256])
            out += self._settled()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self._last))
        self._reset()
        return out

    def once(self, data: bytes) -> list[int]:
        """A short pre-token at one go; what its first bytes lead to is remembered."""
        if len(data) > HEAD:
            state, last = self._heads[data[:HEAD]]
            self._state, self._last = state, list(last)
            data = data[HEAD:]
        self._advance(data)
        return self.finish()

    def _after_head(self, head: bytes) -> tuple[int, tuple[int, ...]]:
        other = Transducer(self._table)
        other._advance(head)
        return other._state, tuple(other._last)

    def _advance(self, data: bytes) -> None:
        last, steps, neighbours, before, state = self._last, self._table.steps, self._table.neighbours, self._before, self._state
        end = len(last)
        for byte in data:
            end += 1
            state, ends = steps[state << 8 | byte]
            for token, size in ends:
                at = end - size
                if at > 0:
                    if neighbours[last[at - 1] << 20 | token]:
                        break
                elif at == 0 and (before is None or neighbours[before << 20 | token]):
                    break
            else:
                raise RuntimeError("no token ends here")
            last.append(token)
        self._state = state

    def _path(self, end: int) -> list[int]:
        out, size_of = [], self._table.size_of
        while end:
            token = self._last[end - 1]
            out.append(token)
            end -= size_of[token]
        out.reverse()
        return out

    def _settled(self) -> list[int]:
        n, size_of = len(self._last), self._table.size_of
        live = set(range(max(0, n - self._table.longest + 1), n + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - size_of[self._last[top - 1]])
        cut = live.pop()
        if n - cut > self._table.lookahead + self._table.longest:
            raise RuntimeError("the look-ahead bound does not hold")
        out = self._path(cut)
        if out:
            self._before = out[-1]
            self._last = self._last[cut:]
        return out


class Encoder:
    """Text in parts to token ids, given out as packed 32-bit integers; memory does not grow with the text."""

    def __init__(self, table: MergeTable, most: int = FEED):
        self._table, self._most = table, most
        self._open = Transducer(table)
        self._short = Transducer(table)
        self._first = ByteMemo(self._chunk, CACHES["first"])
        self._after = ByteMemo(self._spaced, CACHES["after"])
        self._words = ByteMemo(self._pretoken, CACHES["words"])
        added = sorted(table.added, key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self._starts = {a[:k] for a in added for k in range(1, len(a))}
        self._held, self._tail, self._run = "", "", None

    def encode(self, text: str) -> np.ndarray:
        self._held, self._tail, self._run, out = "", "", None, []
        for at in range(0, len(text), FEED):
            out += self.feed(text[at : at + FEED])
        return np.frombuffer(b"".join(out + self.finish()), dtype="<i4")

    def feed(self, text: str) -> list[bytes]:
        text, out = self._held + text, []
        self._held = ""
        if self._added:
            while found := self._added.search(text):
                out += self._segment(text[: found.start()], True)
                out.append(_packed([self._table.added[found[0]]]))
                text = text[found.end() :]
            keep = next((k for k in range(min(len(text), max(map(len, self._starts), default=0)), 0, -1) if text[-k:] in self._starts), 0)
            if keep:
                text, self._held = text[:-keep], text[-keep:]
        return out + self._segment(text, False)

    def finish(self) -> list[bytes]:
        text, self._held = self._held, ""
        return self._segment(text, True)

    def _segment(self, text: str, last: bool) -> list[bytes]:
        """Text between added tokens; ``last``: it ends here."""
        text, out = self._tail + text, []
        self._tail = ""
        if self._run:
            found = RUNS[self._run].match(text)
            end = found.end() if found else 0
            ended = last or end < len(text)
            if self._run == "space" and end and not (last and end == len(text)):
                end -= 1  # the last blank goes with what follows
            out.append(_packed(self._open.feed(text[:end].encode())))
            text = text[end:]
            if not ended:
                self._tail = text
                return out
            out.append(_packed(self._open.finish()))
            self._run = None
        if last:
            return out + self._whole(text) if text else out
        cut = SAFE_CUT.search(text)
        if cut:
            out += self._whole(text[: cut.start()])
            text = text[cut.start() :]
        if len(text) > self._most:
            done, long = 0, False
            for found in WORDS.finditer(text):
                if found.end() > len(text) - 4:
                    long = found.end() - found.start() > self._most // 2
                    break
                out.append(self._pretoken(found[0]))
                done = found.end()
            text = text[done:]
            if long:
                start = int(text[0] == " " and text[1] not in BLANKS)
                self._run = next(name for name, runs in RUNS.items() if runs.match(text, start))
                end = RUNS[self._run].match(text, start).end() - (self._run == "space")
                out.append(_packed(self._open.feed(text[:end].encode())))
                text = text[end:]
        self._tail = text
        return out

    def _whole(self, text: str) -> list[bytes]:
        """Text that starts and ends where pre-tokens do. A lone blank between other characters starts a pre-token."""
        head, *rest = text.split(" ")
        try:
            if max(map(len, rest), default=0) > CACHED_KEY:
                parts = [self._look(self._after, c) for c in rest]
            else:
                parts = list(map(self._after.__getitem__, rest))
            return [self._look(self._first, head), *parts] if head else parts
        except _Blanks:
            return [self._pretoken(w) for w in WORDS.findall(text)]

    @staticmethod
    def _look(memo: ByteMemo, chunk: str) -> bytes:
        return memo[chunk] if len(chunk) <= CACHED_KEY else memo.fn(chunk)

    def _spaced(self, body: str) -> bytes:
        """What follows a lone blank, with that blank; letters alone are one pre-token."""
        return self._pretoken(" " + body) if body.isalpha() else self._chunk(body, " ")

    def _chunk(self, body: str, before: str = "") -> bytes:
        if not body or body[0] in BLANKS or body[-1] in BLANKS:
            raise _Blanks
        return b"".join([self._look(self._after, w[1:]) if w[0] == " " and w[1:].isalpha() else self._look(self._words, w) for w in WORDS.findall(before + body)])

    def _pretoken(self, word: str) -> bytes:
        data = word.encode()
        return _packed(self._short.once(data) if len(data) <= 512 else self._short.feed(data) + self._short.finish())


class _Blanks(Exception):
    """Blanks lie side by side."""


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Decoder:
    """Token ids in parts to text; bytes that are no UTF-8 become U+FFFD, ids of no token give nothing."""

    def __init__(self, path: str):
        _, _, ids, added = _vocabulary(path)
        pieces = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        ordered = [pieces.get(i, b"") for i in range(max(pieces) + 2)]  # the last one stands for all ids of no token
        self._size = np.array([len(b) for b in ordered])
        self._start = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self._text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        ids = np.where((ids < 0) | (ids >= len(self._size)), len(self._size) - 1, ids)
        size = self._size[ids]
        ends = np.cumsum(size)
        spots = np.repeat(self._start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self._text.decode(self._bytes[spots].tobytes())

    def finish(self) -> str:
        out = self._text.decode(b"", True)
        self._text.reset()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One a worker process, so that later tasks find its caches filled."""
    return Encoder(MergeTable(path))


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, "<i4")))


def _text(decoder: Decoder, ids: np.ndarray) -> str:
    return "".join([decoder.feed(ids[at : at + FEED]) for at in range(0, len(ids), FEED)]) + decoder.finish()


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replace column ``text`` by ``ids`` (array of int), all other columns kept.

    Ids are those of the tokenizers library for the same file without added special tokens. A null or empty text gives an
    empty array. A column already named ``ids`` is replaced. With ``decoded`` the ids are decoded again at once, into a
    column of that name, so that a task needs one worker for the way there and back.
    """
    made = [ids] + ([decoded] if decoded else [])
    kept = [c for c in documents.columns if c not in (text, *made)]
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + [T.StructField(c, T.StringType()) for c in made[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(path), _decoder(path) if decoded else None
        for batch in slices(batches, text, SLICE):
            values = [encoder.encode(t) if t else np.zeros(0, "<i4") for t in strings(batch, text)]
            back = [pa.array([_text(decoder, v) for v in values], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(values), *back], names=[*kept, *made])

    return documents.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace column ``ids`` by ``text``, all other columns kept. Null ids give the empty text."""
    kept = [c for c in encoded.columns if c not in (text, ids)]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in slices(batches, ids, SLICE):
            parts = [v.values for v in batch.column(ids)]
            texts = ["" if part is None else _text(decoder, part.to_numpy(zero_copy_only=False)) for part in parts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text])

    return encoded.select(*kept, ids).mapInArrow(run, schema)
