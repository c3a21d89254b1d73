"""Byte-level BPE encoding and decoding without a regular expression over the text.

1. All texts of a batch become one array of code points and one of classes
   (letter, number, other, space, other white space, apostrophe of a contraction).
2. Where a piece begins depends on a small automaton. Each class is a function
   from state to state; functions compose associatively, so the state before
   every code point comes from a blocked prefix scan: blocks are folded side by
   side, the folds of the blocks are scanned by doubling, and the blocks are
   replayed from their entry states.
3. The byte ranges between the boundaries are the pieces. Each distinct piece is
   merged once by rank and kept in a bounded cache.
4. Byte offsets of the tokens of a document are kept, so ids decode to exactly
   the bytes and any token maps to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load
from .textkit import give_back, pieces, utf8_of

# classes of code points
LETTER, NUMBER, OTHER, BLANK, SPACE, SHORT, LONG, RESET, SAME = range(9)
# states: what the last code point was or, after an apostrophe, how much of a contraction is left
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_SPACE, TWO_LEFT, ONE_LEFT, CONTRACTED = range(9)

#: The contractions of the pattern, after the apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

BLOCK = 256
CACHED_PIECES = 200_000
#: A batch's arrays hold some 40 times this.
BATCH_BYTES = 1 << 18
QUADRATIC_LIMIT = 96
NO_PAIR = 1 << 60
#: A text of twice as many code points is taken in parts of about this many.
LONG_TEXT = 1 << 18


def class_table() -> np.ndarray:
    """The class of every code point, as the library that the ids must equal sees it.

    The library's Unicode version isn't Python's, so its own letters, numbers and white space are taken: what it matches of
    one string of all code points.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranks = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        of_kind = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(of_kind).decode("utf-8").encode("utf-32-le"), dtype=np.uint32)] = kind
    table[0x20] = BLANK
    return table


def _step(state: int, kind: int) -> int:
    if kind == SAME:
        return state
    if kind == RESET:
        return START
    if state in (TWO_LEFT, ONE_LEFT):
        return state + 1
    if kind in (SHORT, LONG):
        if state in (IN_OTHER, AFTER_BLANK):
            return IN_OTHER
        return ONE_LEFT if kind == SHORT else TWO_LEFT
    return {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}[kind]


def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that the classes generate under composition.

    Returns the element of each class, the table element x element -> element of
    'first, then second', and the table element x state -> state.
    """
    start = [tuple(_step(s, kind) for s in range(9)) for kind in range(9)]
    found: dict[tuple[int, ...], int] = {}
    todo = list(dict.fromkeys(start))
    while todo:
        f = todo.pop()
        if f not in found:
            found[f] = len(found)
            todo += [tuple(g[s] for s in f) for g in start]
    functions = list(found)
    table = np.array([[found[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint16)
    return np.array([found[f] for f in start], dtype=np.uint16), table, np.array(functions, dtype=np.uint8)


_ELEMENT, _COMPOSE, _APPLY = transition_monoid()


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each code point, by the blocked scan."""
    n = len(kinds)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, SAME, dtype=np.uint8)
    padded[:n] = kinds
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    identity = _ELEMENT[SAME]
    folds = np.full(blocks, identity, dtype=np.uint16)
    for row in rows:
        folds = _COMPOSE[folds, _ELEMENT[row]]
    step = 1
    while step < blocks:
        folds[step:] = _COMPOSE[folds[:-step], folds[step:]]
        step *= 2
    entry = np.concatenate([np.array([identity], dtype=np.uint16), folds[:-1]])
    state = _APPLY[entry, START]
    step_of = _APPLY[_ELEMENT]
    out = np.empty_like(rows)
    for j, row in enumerate(rows):
        out[j] = state
        state = step_of[row, state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def _begins() -> np.ndarray:
    """state x class -> whether a piece begins at a code point, but for the end of runs of white space."""
    table = np.ones((9, 9), dtype=bool)
    table[[TWO_LEFT, ONE_LEFT]] = False
    for kind, own in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER), (SHORT, IN_OTHER), (LONG, IN_OTHER)):
        table[[own, AFTER_BLANK], kind] = False
    table[np.ix_([AFTER_BLANK, AFTER_SPACE], [BLANK, SPACE])] = False
    return table


_BEGINS = _begins()


def boundaries(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pieces of all rows begin, and for n rows the n + 1 piece indexes at which rows begin."""
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    # code points start at bytes that aren't continuations; each row is preceded by a RESET
    at = np.flatnonzero((data & 0xC0) != 0x80)
    row_at = np.searchsorted(at, offsets)
    kinds = table[points]
    following = np.concatenate([points[1:], np.zeros(2, np.uint32)])
    last = np.zeros(len(points) + 2, dtype=bool)  # of its row
    last[row_at[1:][np.diff(row_at) > 0] - 1] = True
    quote = np.flatnonzero(points == ord("'"))
    quote = quote[~last[quote]]
    for word in CONTRACTIONS:
        match = quote[following[quote] == ord(word[0])]
        if len(word) == 2:
            match = match[(following[match + 1] == ord(word[1])) & ~last[match + 1]]
        kinds[match] = SHORT if len(word) == 1 else LONG
    n = len(points)
    place = np.arange(n) + np.repeat(np.arange(1, rows + 1), np.diff(row_at))
    spread = np.full(n + rows, RESET, dtype=np.uint8)
    spread[place] = kinds
    state = states_before(spread)[place]
    start = _BEGINS[state, kinds]
    white = (kinds == BLANK) | (kinds == SPACE)
    after = (state == AFTER_BLANK) | (state == AFTER_SPACE)
    stops = np.concatenate([~white[1:], np.ones(1, bool)])[:n] & ~last[:n]
    start |= white & after & stops
    starts = at[start]
    return starts, np.searchsorted(starts, offsets)


class Merger:
    """Merges the bytes of a piece by rank, lowest rank and then leftmost first; keeps what it has merged."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        #: What each pair of tokens merges to; the id of a token is its rank.
        self.pairs = {
            (self.ranks[token[:i]], self.ranks[token[i:]]): rank
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        }
        self.cache: dict[bytes, tuple[tuple[int, ...], str]] = {}

    def piece(self, piece: bytes) -> tuple[tuple[int, ...], str]:
        """The ids of a piece, and the same as decimal text joined by commas."""
        got = self.cache.get(piece)
        if got is None:
            whole = self.ranks.get(piece)
            ids = (whole,) if whole is not None else tuple(self._merge(piece) if len(piece) <= QUADRATIC_LIMIT else self._merge_long(piece))
            if len(self.cache) >= CACHED_PIECES:
                self.cache.clear()
            got = self.cache[piece] = (ids, ",".join(map(str, ids)))
        return got

    def _merge(self, piece: bytes) -> list[int]:
        merged, none = self.pairs.get, NO_PAIR
        ids = [self.byte_ids[b] for b in piece]
        best = [merged(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while best:
            low = min(best)
            if low == none:
                break
            i = best.index(low)
            ids[i] = low
            del ids[i + 1], best[i]
            if i < len(best):
                best[i] = merged((low, ids[i + 1]), none)
            if i:
                best[i - 1] = merged((ids[i - 1], low), none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] - i != length:
                continue
            end[i], alive[j] = end[j], False
            if end[i] < n:
                before[end[i]] = i
            for a in (before[i], i):
                if a >= 0 and end[a] < n and (r := self.ranks.get(piece[a : end[end[a]]])) is not None:
                    heapq.heappush(heap, (r, a, end[end[a]] - a))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte at which each token begins, and the end of the last."""
        return np.concatenate([[0], np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)])


_STATE: dict[str, Merger] = {}


def _state(ranks: bytes) -> Merger:
    """The merger of a vocabulary, kept for a task."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _STATE:
        _STATE[key] = Merger(ranks)
    return _STATE[key]


def parts_of(text: str, table: np.ndarray) -> Iterator[str]:
    """A text in parts of about LONG_TEXT code points, cut before single spaces, where a piece always begins."""
    begin, at = 0, LONG_TEXT
    while (at := text.find(" ", at)) > 0 and at + 1 < len(text):
        if all(table[ord(c)] not in (BLANK, SPACE) for c in (text[at - 1], text[at + 1])):
            yield text[begin:at]
            begin, at = at, at + LONG_TEXT
        else:
            at += 1
    yield text[begin:]


def encoded(texts: pa.Array, merger: Merger, table: np.ndarray) -> Iterator[tuple[list[int], str]]:
    """For each text its ids and their decimal text joined by commas; a long text is taken in parts."""
    if len(texts) == 1 and texts[0].is_valid and len(text := texts[0].as_py()) > 2 * LONG_TEXT:
        ids, said = [], []
        for part in parts_of(text, table):
            for own in _encoded(pa.array([part]), merger, table):
                ids += own[0]
                said.append(own[1])
        yield ids, ",".join(said)
    else:
        yield from _encoded(texts, merger, table)


def _encoded(texts: pa.Array, merger: Merger, table: np.ndarray) -> Iterator[tuple[list[int], str]]:
    data, offsets = utf8_of(texts)
    starts, rows = boundaries(data, offsets, table) if len(data) else (np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    whole = data.tobytes()
    cuts = [*starts.tolist(), len(whole)]
    seen, piece = merger.cache.get, merger.piece
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        ids: list[int] = []
        said = []
        for i in range(a, b):
            part = whole[cuts[i] : cuts[i + 1]]
            got = seen(part) or piece(part)
            ids += got[0]
            said.append(got[1])
        yield ids, ",".join(said)


def encode(docs: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text", with_offsets: bool = False) -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and offsets.

    A null or empty text has no ids. Rows are encoded where they are read, without
    a shuffle; repeated rows each get their row. Other columns are not read.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<bigint>" * with_offsets
    # a vocabulary file and a byte a code point: their size doesn't depend on the data
    shared = docs.sparkSession.sparkContext.broadcast((ranks, class_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = shared.value
        merger = _state(ranks)
        for batch in pieces(batches, text, BATCH_BYTES):
            counts, ids_sha, decoded_sha, all_ids, all_offsets = [], [], [], [], []
            for ids, said in encoded(batch.column(text), merger, table):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(merger.decode(ids)).hexdigest())
                if with_offsets:
                    all_ids.append(ids)
                    all_offsets.append(merger.offsets(ids))
            columns = [batch.column(key), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_offsets:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_offsets, pa.list_(pa.int64()))]
                names += ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays(columns, names)
        # other operators' tasks come to this worker next
        _STATE.clear()
        del merger
        give_back()

    return docs.select(key, text).mapInArrow(run, schema)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    """The rank file of a public tokenizer, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), vocabulary())
