"""Byte-level BPE without a regular expression.

Pre-tokens are found on arrays: each code point has a class, each class a transition function over a
few states, and the functions form a small finite monoid whose composition is a table. A prefix scan
over that table, done in blocks because composition is associative, gives the state after every code
point, and states and classes of neighbours tell where pre-tokens begin. The byte slices between the
beginnings are dictionary-encoded, each distinct slice is merged once and kept, and the ids of a text
are gathered from there. The byte offset of every token is kept, from which any run of ids decodes.

Defined cases: a null or empty text has no tokens; special-token strings are ordinary text; texts of
any length are cut only where a pre-token surely begins, so the cut never changes the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from auditframe.llm.codepoints import WHITE
from auditframe.llm.common import PASS_BYTES, byte_texts, map_arrow, ragged, rows_in_passes
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

# Classes of code points. The contraction letters have classes of their own.
C_BLANK, C_WHITE, C_LETTER, C_NUMBER, C_OTHER, C_QUOTE, C_SHORT, C_R, C_V, C_L, C_E = range(11)
CLASSES = 11
# States: what the code point just read is part of. S_QUOTE may open a contraction, S_R, S_V and S_L
# have read its first letter and S_DONE its last.
S_START, S_WHITE, S_BLANK, S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_R, S_V, S_L, S_DONE = range(11)
STATES = 11
# Answers of the boundary table; the last three also look at the next code point.
NO, YES, UNLESS_E, UNLESS_L, BEFORE_WORD = range(5)
BLOCK = 64
#: Distinct slices kept between passes of a task; a full store is emptied, which changes no result.
KEPT_SLICES = 150_000
#: Up to this many bytes a slice is merged by repeated search, beyond by a heap.
SHORT_SLICE = 48


def next_state(state: int, kind: int) -> int:
    if kind == C_BLANK:
        return S_BLANK
    if kind == C_WHITE:
        return S_WHITE
    if kind == C_NUMBER:
        return S_NUMBER
    if kind == C_OTHER:
        return S_OTHER
    if kind == C_QUOTE:
        return S_OTHER if state in (S_BLANK, S_OTHER, S_QUOTE) else S_QUOTE
    if state == S_QUOTE:
        return {C_SHORT: S_DONE, C_R: S_R, C_V: S_V, C_L: S_L}.get(kind, S_LETTER)
    if (state in (S_R, S_V) and kind == C_E) or (state == S_L and kind == C_L):
        return S_DONE
    return S_LETTER


def begins(state: int, kind: int) -> int:
    """Whether a pre-token begins at a code point of this class read in this state."""
    if state == S_START:
        return YES
    if kind in (C_BLANK, C_WHITE):
        return BEFORE_WORD if state in (S_BLANK, S_WHITE) else YES
    if state == S_BLANK:
        return NO
    if kind == C_NUMBER:
        return NO if state == S_NUMBER else YES
    if kind in (C_OTHER, C_QUOTE):
        return NO if state in (S_OTHER, S_QUOTE) else YES
    if state == S_QUOTE:
        return {C_SHORT: NO, C_R: UNLESS_E, C_V: UNLESS_E, C_L: UNLESS_L}.get(kind, YES)
    return NO if state in (S_LETTER, S_R, S_V, S_L) else YES


class Scanner:
    """Tables of the transition monoid and the scan over them."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        letters = [tuple(next_state(s, c) for s in range(STATES)) for c in range(CLASSES)]
        # A first code point of a text starts from S_START whatever came before.
        firsts = [(f[S_START],) * STATES for f in letters]
        elements = list(dict.fromkeys([tuple(range(STATES)), *letters, *firsts]))
        place = {f: i for i, f in enumerate(elements)}
        for f in elements:  # grows while it is read: closure under composition with the generators
            for g in letters:
                h = tuple(g[s] for s in f)
                if h not in place:
                    place[h] = len(elements)
                    elements.append(h)
        size = len(elements)
        self.size = size
        self.apply = np.array(elements, dtype=np.uint8).ravel()
        self.compose = np.array([place[tuple(g[s] for s in f)] for f in elements for g in elements], dtype=np.uint16 if size > 255 else np.uint8)
        self.inner = np.array([place[f] for f in letters], dtype=self.compose.dtype)
        self.first = np.array([place[f] for f in firsts], dtype=self.compose.dtype)
        self.begins = np.array([begins(s, c) for s in range(STATES) for c in range(CLASSES)], dtype=np.uint8)

    def totals(self, element: np.ndarray) -> np.ndarray:
        """Prefix products of a sequence of elements, by blocks of blocks."""
        count = len(element)
        if count <= BLOCK:
            out = element.copy()
            for i in range(1, count):
                out[i] = self.compose[int(out[i - 1]) * self.size + int(out[i])]
            return out
        blocks = -(-count // BLOCK)
        rows = np.zeros(blocks * BLOCK, dtype=element.dtype)  # element 0 is the identity
        rows[:count] = element
        rows = np.ascontiguousarray(rows.reshape(blocks, BLOCK).T)
        for i in range(1, BLOCK):
            rows[i] = self.compose[rows[i - 1].astype(np.int32) * self.size + rows[i]]
        before = self.totals(rows[-1])
        carried = np.zeros(blocks, dtype=np.int32)
        carried[1:] = before[:-1]
        out = self.compose[carried[None, :] * self.size + rows]
        return np.ascontiguousarray(out.T).ravel()[:count]

    def beginnings(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """True where a pre-token begins; ``firsts`` are the positions where texts begin."""
        kind = self.classes[points]
        element = self.inner[kind]
        element[firsts] = self.first[kind[firsts]]
        after = self.apply[self.totals(element).astype(np.int32) * STATES + S_START]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[firsts] = S_START
        answer = self.begins[before.astype(np.int32) * CLASSES + kind]
        following = np.full(len(kind), 255, dtype=np.uint8)  # 255: the text ends
        following[:-1] = kind[1:]
        following[firsts[firsts > 0] - 1] = 255
        begin = answer == YES
        begin |= (answer == UNLESS_E) & (following != C_E)
        begin |= (answer == UNLESS_L) & (following != C_L)
        begin |= (answer == BEFORE_WORD) & (following != 255) & (following > C_WHITE)
        return begin


def property_members(name: str) -> np.ndarray:
    """The code points that the tokenizer library's own Unicode tables give a property.

    Python's tables may be of another Unicode version, and the ids must be those of the library.
    """
    singles = tiktoken.Encoding("property", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(chr(x) for x in range(sys.maxunicode + 1) if not 0xD800 <= x < 0xE000)
    return np.frombuffer(singles.decode(singles.encode_ordinary(every)).encode("utf-32-le"), np.uint32)


@functools.cache
def class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, C_OTHER, dtype=np.uint8)
    table[property_members("L")] = C_LETTER
    table[property_members("N")] = C_NUMBER
    table[list(WHITE)] = C_WHITE
    table[ord(" ")] = C_BLANK
    table[ord("'")] = C_QUOTE
    for letter in "stmd":
        table[ord(letter)] = C_SHORT
    for letter, kind in (("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        table[ord(letter)] = kind
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_slice(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank merges first, the left one of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > SHORT_SLICE:
        return merge_long_slice(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    far = len(ranks) + 1_000_000
    pair = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:])]
    while pair:
        best = min(pair)
        if best == far:
            break
        i = pair.index(best)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], far)
    return [ranks[x] for x in parts]


def merge_long_slice(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge_slice, with a heap of pairs over a linked list: n log n for slices of any length."""
    size = len(piece)
    end = list(range(1, size + 1))  # end[i]: where the part that begins at i ends; 0 once it is merged away
    back = list(range(-1, size - 1))
    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= size or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, 0
        if stop < size:
            back[stop] = i
            if (rank := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if i and (rank := ranks.get(piece[back[i]:stop])) is not None:
            heapq.heappush(heap, (rank, back[i], stop))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def segments(text: bytes, size: int = PASS_BYTES) -> list[bytes]:
    """Cut a long text before blanks that follow a printable ASCII character; a pre-token begins at each."""
    if len(text) <= size:
        return [text]
    out, start, at = [], 0, size
    while (at := text.find(b" ", at)) > 0:
        if 0x20 < text[at - 1] < 0x7F:
            out.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    return [*out, text[start:]]


class Codec:
    """Encoding and decoding inside a task."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.scanner, self.kept = ranks, Scanner(classes), {}
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(x) for x in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length

    def pass_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text, all found in one array pass."""
        whole = b"".join(texts)
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        none = np.zeros(0, dtype=np.uint32)
        if not len(points):
            return [none] * len(texts)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width) - width  # byte offset of every code point
        text_at = np.cumsum([0, *map(len, texts)])
        filled = np.unique(text_at[:-1][np.diff(text_at) > 0])
        begin = np.flatnonzero(self.scanner.beginnings(points, np.searchsorted(at, filled)))
        slice_at = np.append(at[begin], len(whole)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(slice_at), pa.py_buffer(whole)]).dictionary_encode()
        if len(self.kept) > KEPT_SLICES:
            self.kept.clear()
        kept, ranks, flat, counts = self.kept, self.ranks, [], []
        for piece in slices.dictionary.to_pylist():
            found = kept.get(piece)
            if found is None:
                found = kept[piece] = tuple(merge_slice(piece, ranks))
            flat += found
            counts.append(len(found))
        counts = np.array(counts, dtype=np.int64)
        starts = np.cumsum(counts) - counts
        code = slices.indices.to_numpy()
        ids = np.array(flat, dtype=np.uint32)[ragged(starts[code], counts[code])]
        token_at = np.concatenate([[0], np.cumsum(counts[code])])
        edge = token_at[np.searchsorted(slice_at, text_at)]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, ids of its next segment), texts in order; long texts come in several segments."""
        owner, parts = [], []
        for number, text in enumerate(texts):
            for part in segments(text):
                owner.append(number)
                parts.append(part)
        for start, stop in rows_in_passes(np.array([len(x) for x in parts], dtype=np.int64)):
            yield from zip(owner[start:stop], self.pass_ids(parts[start:stop]))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which every token begins, and the end."""
        return np.concatenate([[0], np.cumsum(self.token_length[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.token_bytes[ragged(self.token_start[ids], self.token_length[ids])].tobytes()


def _shared_codec(spark: SparkSession, ranks: dict[bytes, int]):
    """A function that opens the codec inside a task, once.

    About 1 MB of ranks and 1.1 MB of classes are broadcast, whatever the size of the corpus.
    """
    tables, held = spark.sparkContext.broadcast((ranks, class_table())), []

    def codec() -> Codec:
        if not held:
            held.append(Codec(*tables.value))
        return held[0]

    return codec


def _joined(codec: Codec, texts: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for number, ids in codec.encode(texts):
        parts[number].append(ids)
    return [np.concatenate(x) if len(x) != 1 else x[0] for x in parts]


def encode(df: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token_ids, token_offsets): the ids of every whole text and the byte offset of each token."""
    codec = _shared_codec(df.sparkSession, ranks)

    def step(batch):
        rows = _joined(codec(), byte_texts(batch.column(1)))
        return {
            id_column: batch.column(0),
            "token_ids": pa.array([x.astype(np.int32) for x in rows], pa.list_(pa.int32())),
            "token_offsets": pa.array([codec().offsets(x)[:-1].astype(np.int32) for x in rows], pa.list_(pa.int32())),
        }

    kind = dict(df.dtypes)[id_column]
    return map_arrow(df.select(id_column, text), step, f"`{id_column}` {kind}, token_ids array<int>, token_offsets array<int>")


def decode(df: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(id, decoded): the bytes that the ids stand for; null or no ids give no bytes."""
    codec = _shared_codec(df.sparkSession, ranks)

    def step(batch):
        return {id_column: batch.column(0), "decoded": pa.array([codec().decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()], pa.binary())}

    return map_arrow(df.select(id_column, ids), step, f"`{id_column}` {dict(df.dtypes)[id_column]}, decoded binary")


def round_trip(df: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode its ids, digest both."""
    codec = _shared_codec(df.sparkSession, ranks)

    def step(batch):
        texts = byte_texts(batch.column(1))
        counts = [0] * len(texts)
        id_hash = [hashlib.sha256() for _ in texts]
        byte_hash = [hashlib.sha256() for _ in texts]
        for number, ids in codec().encode(texts):
            counts[number] += len(ids)
            id_hash[number].update(ids.astype("<u4").tobytes())
            byte_hash[number].update(codec().decode(ids))
        return {
            id_column: batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": [x.hexdigest() for x in id_hash], "decoded_sha256": [x.hexdigest() for x in byte_hash],
        }

    kind = dict(df.dtypes)[id_column]
    return map_arrow(df.select(id_column, text), step, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
