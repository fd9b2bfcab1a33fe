"""Token ids of whole texts by a public byte-level BPE, as a streaming transducer.

Rules are applied to bytes in the order of the merge list. Suppose a text
goes on beyond its first n bytes. The two runs (with and without the rest)
can only begin to differ where a rule u+v joins a token u that ends at n;
the boundary up to which both runs agree then moves left by the length of
u. A later rule u'+v' can move it on only if v' starts with u, since u is
what stands at the boundary in both runs. So the boundary moves along a
chain of rules of rising rank, each of whose right sides starts with the
left side of the one before, and the longest such chain, summed over the
left sides' bytes, is a *sufficient lookahead* L: all tokens that end at
least L bytes before the end of what has been read are final. The
transducer reads a window, emits the final tokens, drops their bytes and
reads on, with memory bounded by the window whatever the text's length.
What follows a final token is encoded as if it stood alone, because no
rule has crossed the boundary before it.

Rules never cross the pieces of the tokenizer's splitting pattern, which
are found block by block: the pieces at a block's end that more text could
change begin the next block, so neither pieces nor windows of a long text
are held together. Ids of frequent short pieces are kept in a table of
bounded size. Tokens are turned back into text by an incremental
byte-to-text state machine that holds the bytes of one unfinished
character.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.session import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the splitting pattern of byte-level BPE; the second is the same for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_KEPT_PIECES, _KEPT_LENGTH = 1 << 18, 64
_TEXT_BLOCK = 1 << 16
# Characters after a piece's start that decide where it ends, beside its own run ('re).
_PIECE_AHEAD = 3
_HEAP_FROM = 48
_BLOCK = 4096
_NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _class(kind: str) -> str:
    """The characters of the first plane in a class of the regex module, as ranges for the plain one."""
    found = [m.span() for m in regex.finditer(f"{kind}+", "".join(map(chr, range(0x10000))))]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in found)


@lru_cache(1)
def _plane_pattern() -> re.Pattern:
    """``PATTERN`` for texts of the first plane; the plain module looks its classes up in tables and is several times as fast."""
    letter, number, space = (_class(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


class Transducer:
    """Streaming encoder and decoder for one merge list."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        rules = [(raw(a), raw(b)) for a, b in merges]
        self.bytes_of = {i: b for b, i in ids.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(rules)}
        self.result = [ids[a + b] for a, b in rules]
        self.lookahead = sufficient_lookahead(rules)
        self.window = 4 * (self.lookahead + max(map(len, ids)))
        self.pieces = regex.compile(PATTERN)
        self.plane_pieces = _plane_pattern()
        self.ascii_pieces = re.compile(ASCII_PATTERN, re.ASCII)
        self.known: dict[str, tuple[int, ...]] = {}

    def _apply_rules(self, data: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in data]
        get = self.rank.get
        if len(ids) > _HEAP_FROM:
            return self._apply_by_heap(ids)
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != _NONE:
            i = ranks.index(r)
            ids[i] = new = self.result[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, _NONE)
        return ids

    def _apply_by_heap(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) over linked places; places left of a rule's are taken first."""
        get, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])] + [_NONE]
        heap = [(r, i) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue  # one of its two tokens has gone
            j = after[i]
            ids[i] = new = self.result[r]
            ids[j], ranks[j] = -1, _NONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = get(new << 32 | ids[k], _NONE)
                if r != _NONE:
                    heapq.heappush(heap, (r, i))
            else:
                ranks[i] = _NONE
            h = before[i]
            if h >= 0:
                ranks[h] = r = get(ids[h] << 32 | new, _NONE)
                if r != _NONE:
                    heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece whose bytes arrive in chunks; at most a window and a chunk are held."""
        held = b""
        for chunk in chunks:
            held += chunk
            at = 0
            while len(held) - at > self.window:
                part = held[at : at + self.window]
                done, stable = 0, self.window - self.lookahead
                for i in self._apply_rules(part):
                    if done + len(self.bytes_of[i]) > stable:
                        break
                    done += len(self.bytes_of[i])
                    yield i
                at += done
            held = held[at:]
        yield from self._apply_rules(held)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= self.window:
            ids = tuple(self._apply_rules(data))
        else:
            ids = tuple(self.stream(data[i : i + self.window] for i in range(0, len(data), self.window)))
        if len(piece) <= _KEPT_LENGTH:
            if len(self.known) >= _KEPT_PIECES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a block at a time."""
        find = (self.ascii_pieces if text.isascii() else self.pieces if _BEYOND.search(text) else self.plane_pieces).findall
        at, block = 0, _TEXT_BLOCK
        while len(text) - at > block:
            pieces = find(text[at : at + block])
            rest = 0  # characters of the pieces that wait: the last one and those that begin where more text could change them
            while pieces and (not rest or rest < _PIECE_AHEAD):
                rest += len(pieces.pop())
            if not pieces:
                block *= 2  # a piece longer than the block
                continue
            yield pieces
            at, block = at + block - rest, _TEXT_BLOCK
        yield find(text[at:] if at else text)

    def encode_blocks(self, text: str) -> Iterator[list[tuple[int, ...]]]:
        """The ids of each piece in turn, a block at a time."""
        for pieces in self._pieces(text):
            found = list(map(self.known.get, pieces))
            if None in found:
                make = self._piece
                found = [make(p) if f is None else f for p, f in zip(pieces, found)]
            yield found

    def encode(self, text: str) -> Iterator[int]:
        """Ids of a text."""
        return chain.from_iterable(chain.from_iterable(self.encode_blocks(text)))

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        return sum(sum(map(len, found)) for found in self.encode_blocks(text))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, as soon as characters are complete; bytes that are no UTF-8 become U+FFFD.

        The state machine is fed a block of tokens at a time, so memory is
        bounded by a block.
        """
        machine, ids, known = Utf8Machine(), iter(ids), self.bytes_of.get
        while block := list(islice(ids, _BLOCK)):
            yield machine.push(b"".join([known(i, b"") for i in block]))
        yield machine.end()


class Utf8Machine:
    """Incremental byte-to-text state machine; holds at most three bytes."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _length(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character at the end waits
            lead = data[-back]
            if lead >= 0xC0:
                if self._length(lead) > back:
                    cut -= back
                break
            if lead < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token beyond which no continuation can change it (see the module's text)."""
    reach: dict[bytes, int] = {}  # left side -> longest chain ending with a rule of this left side
    longest = 0
    for left, right in rules:
        g = len(left) + max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), g)
        longest = max(longest, g)
    return longest


@lru_cache(2)
def _transducer(vocabulary: str) -> Transducer:
    return Transducer(vocabulary)


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # a string column may hold bytes that are no UTF-8
        return [None if b is None else b.decode("utf-8", "replace") for b in column.view(pa.binary()).to_pylist()]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast (a fixed 1.6 MB, whatever the data)."""
    ship(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, key: str, text: str, ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): the token ids of every text, without special tokens.

    Marker strings in a text are ordinary text. Empty and null texts give
    an empty list; bytes that are no UTF-8 count as U+FFFD. One row per
    input row, keys as they are (null and repeated ones too); no shuffle;
    other columns are ignored.
    """
    shared = _vocabulary(df, vocabulary)
    schema = T.StructType([df.schema[key], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for batch in batches:
            flat, ends = array("i"), [0]
            for value in _texts(batch.column(1)):
                if value:
                    flat.extend(t.encode(value))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), lists], schema=arrow)

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, size: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, size BIGINT): number of token ids of every text; empty and null texts have 0."""
    shared = _vocabulary(df, vocabulary)
    schema = T.StructType([df.schema[key], T.StructField(size, T.LongType(), False)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for batch in batches:
            sizes = [t.count(v) if v else 0 for v in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(sizes, pa.int64())], schema=arrow)

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the text of every list of ids; null lists give null, unknown ids nothing."""
    shared = _vocabulary(df, vocabulary)
    schema = T.StructType([df.schema[key], T.StructField(text, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for batch in batches:
            out = [None if v is None else "".join(t.decode(v)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(out, arrow.field(1).type)], schema=arrow)

    return df.select(key, F.col(ids).alias("_ids")).mapInArrow(run, schema)


def check_round_trip(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, same_text, n_ids): does the text come back from its ids; a null text counts as empty. One pass, no shuffle."""
    shared = _vocabulary(df, vocabulary)
    schema = T.StructType([df.schema[key], T.StructField("same_text", T.BooleanType(), False), T.StructField("n_ids", T.LongType(), False)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for batch in batches:
            same, sizes = [], []
            for value in _texts(batch.column(1)):
                ids = array("i", t.encode(value or ""))
                same.append("".join(t.decode(ids)) == (value or ""))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(same), pa.array(sizes, pa.int64())], schema=arrow)

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)
