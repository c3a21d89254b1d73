"""An interpolated modified Kneser-Ney model of pairs of words, trained and scored by sharded count joins.

A word's probability without a context rests on its spelling by a letter model, so
the vocabulary is open. Three models are worked out side by side: those of the two
halves of the trusted texts, 0 and 1, and that of both, 2.

The logarithm of a text's probability is a sum over its words and pairs, each adding a
number that depends on it alone: a pair ``log1p(own share / share left to the word
alone)``, a word the same against its spelling and, as a context, the logarithm of the
weight it leaves. What the model hasn't seen adds nothing. So the numbers are one table
of words and pairs, dealt into shards by hash; texts send each shard the different
words and pairs that they hold, packed, and get sums back. The shards are worked through in PASSES, so
only so large a share of all words and pairs is on its way at a time.

Texts are taken apart once for training and once for scoring, into chunks of rows that hold numbers of words and a
list of the chunk's different words with their hashes; all passes read the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .letters import Words, class_table, spellings, turned
from .textkit import U64, give_back, mix64, pieces, tidy

MODELS = (0, 1, 2)
#: Parts in which pairs are counted, and passes over the shards in which texts are scored.
PARTS, PASSES = 4, 16
#: Words of a chunk, unless one text has more, and words and pairs that a task holds before it deals them out.
CHUNK, HELD = 1 << 22, 1 << 20
#: Passes whose sums are added up to one table.
ADDED = 4
#: Words of a chunk that are worked on at a time.
SLICE = 1 << 19
#: Rows of the model, and different words and pairs of texts, in a shard.
SHARD_ROWS, SHARD_ASKED = 1 << 20, 1 << 23
#: What is at least one in so many words of the trusted texts, and there so often at least, is looked up where it is met.
FREQUENT, OFTEN = 1 << 16, 1_000
#: Bytes of a text that are taken apart at a time.
PART = 1 << 20
_BEGIN = U64(0x6A09E667F3BCC909)
_SPACE = re.compile(r"\s")


class Read:
    """Words of some rows and their hashes. ``more``: the last row goes on, ``goes_on``: the first one is a part that follows another."""

    def __init__(self, batch: pa.RecordBatch, words: Words, salt: np.ndarray, goes_on: bool = False, more: bool = False):
        self.batch, self.words, self.goes_on, self.more = batch, words, goes_on, more
        self.last = words.hashes(salt)
        self.rows = words.rows
        self.size = np.diff(self.rows)


def read(batches: Iterator[pa.RecordBatch], salted: bool = False) -> Iterator[Read]:
    """The words of columns _text, _lang; a long text comes in parts. If not ``salted`` by column _salt, languages share their hashes."""
    table = class_table()
    for batch in pieces(batches, "_text", PART):
        salt = mix64((batch.column("_salt").to_numpy() if salted else np.zeros(batch.num_rows, np.int64)).view(U64))
        text = batch.column("_text")[0].as_py() if batch.num_rows == 1 else None
        if text is None or len(text) <= 2 * PART:
            yield Read(batch, Words(batch.column("_text"), table), salt)
            continue
        at, any_words = 0, False
        while at < len(text):
            space = _SPACE.search(text, at + PART)
            end = space.end() if space else len(text)
            more = end < len(text)
            words = Words(pa.array([text[at:end]], pa.string()), table, ended=False)
            any_words |= len(words.starts) > 0
            if not more and any_words:
                words = Words(pa.array([text[at:end]], pa.string()), table, ended=True)
            yield Read(batch, words, salt, at > 0, more)
            at = end


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


_PACKED = "langs array<string>, rows binary, halves binary, tongues binary, sizes binary, ids binary, salts binary, hashes binary, tongue_of binary, lengths binary, kinds binary, sums binary"


def packed(texts: DataFrame, tables: Broadcast | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """Chunks of the texts of columns _row, _lang, _half, _text; rows without words are left out.

    With tables of letter models chunks hold rows' sums of the spellings instead of the spellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, logs_of = _Packer(), None if tables is None else unpacked(tables.value)
        for part in read(batches, True):
            held.add(part)
            if held.count >= CHUNK and not part.more:
                yield held.chunk(logs_of, suffixes)
                held = _Packer()
        if held.count:
            yield held.chunk(logs_of, suffixes)

    return texts.select("_row", "_lang", "_half", "_text", F.xxhash64("_lang").alias("_salt")).mapInArrow(run, _PACKED)


class _Packer:
    def __init__(self) -> None:
        self.count = 0
        self.langs: dict[str, int] = {}
        self.salts: list[int] = []
        self.rows: list[np.ndarray] = []
        self.words: list[tuple[np.ndarray, ...]] = []

    def add(self, part: Read) -> None:
        batch = part.batch
        for lang, salt in zip(batch.column("_lang").to_pylist(), batch.column("_salt").to_pylist(), strict=True):
            if lang not in self.langs:
                self.langs[lang] = len(self.langs)
                self.salts.append(salt)
        tongues = np.array([self.langs[x] for x in batch.column("_lang").to_pylist()], np.uint32)
        if part.goes_on:
            self.rows[-1][3][-1] += part.size[0]
        else:
            self.rows.append((batch.column("_row").to_numpy(), batch.column("_half").to_numpy().astype(np.uint8), tongues, part.size.astype(np.uint32)))
        self.count += len(part.last)
        if not len(part.last):
            return
        hashes, at, ids = np.unique(part.last, return_index=True, return_inverse=True)
        words = part.words
        starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
        begin = np.cumsum(sizes) - sizes
        kinds = words.kinds[np.repeat(starts - begin, sizes) + np.arange(sizes.sum())]
        self.words.append((hashes, np.repeat(tongues, part.size)[at], (sizes << 1 | words.loud[at]).astype(np.uint32), kinds, ids.astype(np.uint32)))

    def chunk(self, logs_of: dict[str, np.ndarray] | None, suffixes: list[str] | None) -> pa.RecordBatch:
        """Words in order of how often they are met, so that their numbers are short."""
        rows, halves, tongues, sizes = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        some = sizes > 0
        hashes, of, lengths, kinds = (np.concatenate(c) for c in list(zip(*self.words, strict=True))[:4])
        hashes, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        ids, first = [], 0
        for own, *_, x in self.words:
            ids.append(number[first : first + len(own)].astype(np.uint32)[x])
            first += len(own)
        ids = np.concatenate(ids)
        order = np.argsort(-np.bincount(ids, minlength=len(hashes)))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        at = at[order]
        long = (lengths >> 1).astype(np.int64)
        begin = np.cumsum(long) - long
        kinds = kinds[np.repeat(begin[at] - (np.cumsum(long[at]) - long[at]), long[at]) + np.arange(long[at].sum())]
        ids = place[ids]
        lengths, of, spelt, sums = lengths[at], of[at], [None, None], None
        if logs_of is None:
            spelt = [lengths, kinds]
        else:
            logs = spelled_out(list(self.langs), of, lengths, kinds, logs_of, suffixes)
            starts = np.cumsum(sizes[some], dtype=np.int64) - sizes[some]
            sums = np.concatenate([np.add.reduceat(x[ids], starts) for x in ((lengths >> 1) + 1.0, *logs)])
        columns = [rows[some], halves[some], tongues[some], sizes[some], ids, np.array(self.salts, np.int64), hashes[order], of, *spelt, sums]
        return pa.RecordBatch.from_arrays([pa.array([list(self.langs)], pa.list_(pa.string())), *[pa.array([None if x is None else _packed(x)], pa.binary()) for x in columns]], [x.split()[0] for x in _PACKED.split(", ")])


class Chunk:
    """Rows of packed texts: ``rows``, ``half``, ``tongues`` (of ``langs``), ``sizes``; ``ids`` of all their words, in order."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self._get = lambda name, kind: _unpacked(batch.column(name)[i].as_py(), kind)
        self.langs = batch.column("langs")[i].as_py()
        self.rows, self.half, self.tongues = self._get("rows", np.int64), self._get("halves", np.uint8), self._get("tongues", np.uint32)
        self.sizes = self._get("sizes", np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @cached_property
    def ids(self) -> np.ndarray:
        return self._get("ids", np.uint32)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self._get("hashes", U64)

    @cached_property
    def tongue_of(self) -> np.ndarray:
        return self._get("tongue_of", np.uint32)

    @cached_property
    def sums(self) -> np.ndarray:
        """For each row its letters and, for each model, the logarithm of the probability of its words' spellings."""
        return self._get("sums", np.float64).reshape(1 + len(MODELS), -1)

    @property
    def slices(self) -> Iterator[tuple[slice, slice]]:
        """Rows and their words, about SLICE words at a time."""
        ends = self.starts + self.sizes
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, self.starts[at] + SLICE, side="right")))
            yield slice(at, end), slice(int(self.starts[at]), int(ends[end - 1]))
            at = end

    @cached_property
    def lengths(self) -> np.ndarray:
        return self._get("lengths", np.uint32)

    @cached_property
    def begins(self) -> np.ndarray:
        """For each row what stands for the word before its first."""
        return mix64(mix64(self._get("salts", np.int64).view(U64)) + _BEGIN)[self.tongues]

    @cached_property
    def kinds(self) -> np.ndarray:
        return self._get("kinds", np.uint8)

    def numbered(self, numbers: dict[str, int]) -> np.ndarray:
        """The number of each of ``langs``, or -1."""
        return np.array([numbers.get(x, -1) for x in self.langs], np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in tidy(batches):
        for i in range(batch.num_rows):
            yield Chunk(batch, i)


def spelt(lengths: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter n-grams of a chunk's different words, and those at which words begin."""
    sizes = (lengths >> 1).astype(np.int64)
    ends = np.cumsum(sizes)
    return spellings(kinds, ends - sizes, ends, lengths & 1 > 0)


def spelled_out(langs: list[str], tongue_of: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, tables: dict[str, np.ndarray], suffixes: list[str]) -> list[np.ndarray]:
    """For each model the logarithm of the probability of each different word's spelling; NaN without a letter model."""
    codes, begin = spelt(lengths, kinds)
    out = [np.full(len(lengths), np.nan) for _ in MODELS]
    sizes = np.diff(begin)
    for i, own in enumerate(langs):
        mine = tongue_of == i
        if not mine.any() or not any(own + x in tables for x in suffixes):
            continue
        inner = codes[np.repeat(mine, sizes)]
        starts = np.cumsum(sizes[mine]) - sizes[mine]
        for m in MODELS:
            logs = tables.get(own + suffixes[m])
            if logs is not None:
                out[m][mine] = np.add.reduceat(logs[inner].astype(np.float64), starts)
    return out


def unpacked(tables: dict[str, bytes]) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(zstandard.decompress(x), np.float32) for name, x in tables.items()}


def words_of(texts: DataFrame, numbers: dict[str, int], tables: Broadcast, suffixes: list[str]) -> DataFrame:
    """(lang, w, b0, b1, b2): the different words of the packed texts in ``numbers`` and their spellings' logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []
        logs_of = unpacked(tables.value)
        for chunk in chunks(batches):
            lang = chunk.numbered(numbers)
            met = lang[chunk.tongue_of] >= 0
            logs = spelled_out(chunk.langs, chunk.tongue_of, chunk.lengths, chunk.kinds, logs_of, suffixes)
            known.append((lang[chunk.tongue_of[met]].astype(np.int32), chunk.hashes[met], *[b[met] for b in logs]))
            if sum(len(x[0]) for x in known) >= HELD // 2:
                known = [_distinct(known)]
                if len(known[0][0]) >= HELD // 4:
                    yield _words_batch(known.pop())
        if known:
            yield _words_batch(_distinct(known))

    found = texts.mapInArrow(run, "lang int, w bigint, b0 double, b1 double, b2 double")
    return found.groupBy("lang", "w").agg(*[F.max(F.nanvl(f"b{m}", F.lit(None))).alias(f"b{m}") for m in MODELS])


def _distinct(known: list[tuple]) -> tuple:
    columns = [np.concatenate(c) for c in zip(*known, strict=True)]
    _, at = np.unique(columns[1], return_index=True)
    return tuple(c[at] for c in columns)


def _words_batch(x: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), _long(x[1]), *[pa.array(b, pa.float64()) for b in x[2:]]], ["lang", "w", "b0", "b1", "b2"])


def pairs_of(texts: DataFrame, numbers: dict[str, int], k: int) -> DataFrame:
    """(lang, v, w, c0, c1): how often w follows v in each half of the packed texts, for the v of part k; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for chunk in chunks(batches):
            number = chunk.numbered(numbers).astype(np.int32)
            for rows, words in chunk.slices:
                before, w = _pairs(chunk, rows, words, chunk.hashes, chunk.begins)
                lang = number[chunk.tongue_of[chunk.ids[words]]]
                at = np.flatnonzero(((before & U64(PARTS - 1)) == U64(k)) & (lang >= 0))
                held.append((before[at], w[at], lang[at], np.repeat(chunk.half[rows], chunk.sizes[rows])[at]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from _pairs_batches(held)
                    held = []
        if held:
            yield from _pairs_batches(held)

    return texts.mapInArrow(run, "lang int, v bigint, w bigint, c0 bigint, c1 bigint").groupBy("lang", "v", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _pairs(chunk: Chunk, rows: slice, words: slice, of: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a slice what ``of`` holds for the word before, or ``begins`` for its row, and its hash."""
    ids = chunk.ids[words]
    before = np.empty(len(ids), U64)
    before[1:] = of[ids[:-1]]
    before[chunk.starts[rows] - words.start] = begins[rows]
    return before, chunk.hashes[ids]


def _pairs_batches(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    v, w, lang, half = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    if not len(v):
        return
    gram = turned(v) ^ w
    order = np.argsort(gram)
    gram = gram[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    one = np.add.reduceat(half[order], first, dtype=np.int64)
    both = np.diff(np.append(first, len(gram)))
    at = order[first]
    yield pa.RecordBatch.from_arrays([pa.array(lang[at], pa.int32()), _long(v[at]), _long(w[at]), pa.array(both - one, pa.int64()), pa.array(one, pa.int64())], ["lang", "v", "w", "c0", "c1"])


def _cuts(c: list[Column]) -> dict[int, Column]:
    return {m: F.when(c[m] >= 3, F.col(f"d3_{m}")).when(c[m] == 2, F.col(f"d2_{m}")).when(c[m] == 1, F.col(f"d1_{m}")).otherwise(0.0) for m in MODELS}


def _discounts(table: DataFrame, c: list[Column], cut: list[Column]) -> dict[int, dict[str, float]]:
    """For each language the discounts d1_m, d2_m, d3_m of model m and the sum of its counts, n_m. ``cut``: three columns of n1 to n4."""
    kinds = [F.sum((c[m] == i).cast("long")).alias(f"n{i}_{m}") for m in MODELS for i in (1, 2, 3, 4)]
    rows = table.groupBy("lang").agg(*kinds, *[F.sum(c[m]).alias(f"n_{m}") for m in MODELS])
    renamed = lambda m: rows.select("lang", F.lit(m).alias("m"), *[F.col(f"n{i}_{m}").alias(f"n{i}") for i in (1, 2, 3, 4)], F.col(f"n_{m}").alias("n"))
    found: dict[int, dict[str, float]] = {}
    for m in MODELS:
        for r in renamed(m).select("lang", "n", *[x.alias(f"d{i}") for i, x in enumerate(cut, 1)]).collect():  # a row a language
            found.setdefault(r["lang"], {}).update({f"d{i}_{m}": float(r[f"d{i}"]) for i in (1, 2, 3)} | {f"n_{m}": float(r["n"] or 0)})
    return found


def _per_language(space: Workspace, found: dict[int, dict[str, float]]) -> DataFrame:
    fields = [f"d{i}_{m}" for m in MODELS for i in (1, 2, 3)] + [f"n_{m}" for m in MODELS]
    return F.broadcast(space.spark.createDataFrame([(k, *[x[f] for f in fields]) for k, x in found.items()], "lang int, " + ", ".join(f"{f} double" for f in fields)))


class Model:
    """What words and pairs add to a text, ``adding``, and each language's share of spellings.

    n is how often they are met. On the way, x_m of a pair is its count less what is cut off it, by what is cut off all pairs
    of v, and u_m of a word its probability without a context.
    """

    def __init__(self, texts: DataFrame, known: DataFrame, numbers: dict[str, int], cut: list[Column], space: Workspace):
        self.space = space
        self.parts = [space.table(pairs_of(texts, numbers, k), f"pairs-{k}") for k in range(PARTS)]
        c = [F.col("c0"), F.col("c1"), F.col("c0") + F.col("c1")]
        cuts = _per_language(space, _discounts(union(self.parts), c, cut))
        as_context, as_word = [], []
        for k, part in enumerate(self.parts):
            d = _cuts(c)
            sums = [F.sum(c[m]).alias(f"t{m}") for m in MODELS] + [F.sum(d[m]).alias(f"h{m}") for m in MODELS]
            cut_off = part.join(cuts, "lang")
            context = space.table(cut_off.groupBy("lang", "v").agg(*sums), f"contexts-{k}")
            as_context.append(context.withColumnRenamed("v", "w"))
            left = [F.sum((c[m] > 0).cast("long")).alias(f"k{m}") for m in MODELS]
            as_word.append(space.table(part.groupBy("lang", "w").agg(F.sum(c[2]).alias("n"), *left), f"left-{k}"))
            own = [F.when(c[m] > 0, F.try_divide(c[m] - d[m], F.col(f"h{m}"))).cast("float").alias(f"x{m}") for m in MODELS]
            self.parts[k] = space.table(cut_off.join(context.select("lang", "v", "h0", "h1", "h2"), ["lang", "v"]).select("v", "w", c[2].alias("n"), *own), f"own-{k}")
            space.drop(f"pairs-{k}")
        words = union(as_word).groupBy("lang", "w").agg(*[F.sum(x).alias(x) for x in ("n", "k0", "k1", "k2")])
        words = space.table(words.join(known, ["lang", "w"], "left"), "seen")
        k = [F.col(f"k{m}") for m in MODELS]
        found = _discounts(words, k, cut)
        d = _cuts(k)
        shares = words.join(_per_language(space, found), "lang").groupBy("lang").agg(*[F.sum(d[m]).alias(f"g{m}") for m in MODELS]).collect()  # a row a language
        self.share = {r["lang"]: [r[f"g{m}"] / found[r["lang"]][f"n_{m}"] if found[r["lang"]][f"n_{m}"] else None for m in MODELS] for r in shares}
        own = space.spark.createDataFrame([(lang, *x) for lang, x in self.share.items()], "lang int, g0 double, g1 double, g2 double")
        words = words.join(_per_language(space, found), "lang").join(F.broadcast(own), "lang")
        alone = [F.col(f"g{m}") * F.exp(f"b{m}") for m in MODELS]
        ratio = [F.try_divide(k[m] - d[m], F.col(f"n_{m}")) for m in MODELS]
        apart = [F.ln(ratio[m]) - F.ln(f"g{m}") - F.col(f"b{m}") for m in MODELS]  # spellings of long words are beyond doubles
        adds = [F.when(x > 30, x).otherwise(F.log1p(F.exp(x))).alias(f"a{m}") for m, x in enumerate(apart)]
        words = words.select("lang", "w", "n", *[(ratio[m] + alone[m]).cast("float").alias(f"u{m}") for m in MODELS], *adds)
        words = words.join(union(as_context), ["lang", "w"], "full")
        adds = [(F.coalesce(f"a{m}", F.lit(0.0)) + F.coalesce(F.when(F.col(f"t{m}") > 0, F.ln(F.try_divide(f"h{m}", f"t{m}"))), F.lit(0.0))).cast("float").alias(f"a{m}") for m in MODELS]
        words = words.select("w", F.greatest("n", "t2").alias("n"), *[f"u{m}" for m in MODELS], *adds)
        words = space.table(words, "words")
        space.drop("seen", *[f"{x}-{i}" for x in ("contexts", "left") for i in range(PARTS)])
        self.total = words.agg(F.sum("n")).first()[0] or 0
        gram = (F.shiftleft("v", 21).bitwiseOR(F.shiftrightunsigned("v", 43))).bitwiseXOR(F.col("w")).alias("gram")
        adds = [F.coalesce(F.log1p(F.try_divide(f"x{m}", f"u{m}")), F.lit(0.0)).cast("float").alias(f"a{m}") for m in MODELS]
        by_word = words.select("w", *[f"u{m}" for m in MODELS])
        for k, part in enumerate(self.parts):
            self.parts[k] = space.table(part.join(by_word, "w").select(gram, "n", *adds), f"adds-{k}")
            space.drop(f"own-{k}")
        #: (gram, n, a0, a1, a2) of all words and pairs.
        self.parts.append(space.table(words.select(F.col("w").alias("gram"), "n", *[f"a{m}" for m in MODELS]), "adds"))
        space.drop("words")
        self.adding = union(self.parts)
        self.rows = self.adding.count()

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The words and pairs that are met all the time, in order, and what they add; twice FREQUENT at most."""
        least = max(OFTEN, -(-self.total // FREQUENT))
        rows = self.adding.where(F.col("n") >= least).toArrow()
        gram = np.concatenate([rows.column("gram").to_numpy().view(U64), np.zeros(0, U64)])
        order = np.argsort(gram)
        return gram[order], np.stack([rows.column(f"a{m}").to_numpy()[order] for m in MODELS]).astype(np.float32)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


_ASKED = "shard int, batch bigint, grams binary, docs binary, times binary, rows binary, sums binary"


def asked(texts: DataFrame, numbers: dict[str, int], frequent: Broadcast, shards: int, k: int) -> DataFrame:
    """For the shards of pass k the words and pairs of the texts, packed; what is frequent is already summed.

    Documents are numbered in each ``batch``; one row of a batch holds their _row and these sums.
    """
    per = shards // PASSES
    low, high = (-(-i * (1 << 24) // PASSES) << 40 for i in (k, k + 1))
    here = lambda gram: gram - U64(low) <= U64(high - 1 - low)  # noqa: E731  shards are ranges of grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, adds = frequent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        batch, count = TaskContext.get().partitionId() << 32, 0
        for chunk in chunks(batches):
            good = chunk.numbered(numbers)[chunk.tongues] >= 0
            as_context, at_begin, inside = turned(chunk.hashes), turned(chunk.begins), here(chunk.hashes)
            for part, words in chunk.slices:
                doc = np.repeat(np.arange(part.stop - part.start, dtype=np.uint32), chunk.sizes[part])
                own = np.repeat(good[part], chunk.sizes[part])
                pairs, w = _pairs(chunk, part, words, as_context, at_begin)
                pairs ^= w
                begins = chunk.begins[part]
                some, two, one = np.flatnonzero(own & inside[chunk.ids[words]]), np.flatnonzero(own & here(pairs)), np.flatnonzero(good[part] & here(begins))
                gram = np.concatenate([w[some], pairs[two], begins[one]])
                docs = np.concatenate([doc[some], doc[two], one.astype(np.uint32)])
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                often = known[at] == gram if len(known) else np.zeros(len(gram), bool)
                size = part.stop - part.start
                sums.append(np.stack([np.bincount(docs[often], weights=adds[m][at[often]], minlength=size) for m in MODELS]) if often.any() else np.zeros((len(MODELS), size)))
                held.append((gram[~often], docs[~often] + np.uint32(count)))
                rows.append(chunk.rows[part])
                count += size
                if sum(len(x[0]) for x in held) >= HELD or count >= HELD:
                    yield from _asked_batches(held, rows, sums, shards, k * per, batch)
                    held, rows, sums, count, batch = [], [], [], 0, batch + 1
        if held:
            yield from _asked_batches(held, rows, sums, shards, k * per, batch)

    return texts.mapInArrow(run, _ASKED)


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    return ((gram >> U64(40)).astype(np.int64) * shards) >> 24


def _asked_batches(held: list[tuple[np.ndarray, np.ndarray]], rows: list[np.ndarray], sums: list[np.ndarray], shards: int, first: int, batch: int) -> Iterator[pa.RecordBatch]:
    gram, doc = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    fresh = np.ones(len(gram), dtype=bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(gram))).astype(np.uint32)
    gram, doc = gram[at], doc[at]
    shard = _shard(gram, shards)
    yield _asked_row(first + batch % max(1, shards // PASSES), batch, None, None, None, np.concatenate(rows), np.concatenate(sums, axis=1))
    edges = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else [], len(shard)).astype(np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield _asked_row(int(shard[a]), batch, np.diff(gram[a:b], prepend=U64(0)), doc[a:b], times[a:b], None, None)


def _asked_row(shard: int, batch: int, grams: np.ndarray | None, docs: np.ndarray | None, times: np.ndarray | None, rows: np.ndarray | None, sums: np.ndarray | None) -> pa.RecordBatch:
    columns = [None if x is None else _packed(x) for x in (grams, docs, times, rows)] + [None if sums is None else zstandard.compress(sums.tobytes(), 1)]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([batch], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], ["shard", "batch", "grams", "docs", "times", "rows", "sums"])


def answered(model: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_row, s0, s1, s2): the sums of what the model's rows (shard, gram, a0, a1, a2) add to the texts, shard by shard."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        gram = left.column("gram").to_numpy().view(U64)
        order = np.argsort(gram)
        gram = gram[order]
        adds = [left.column(f"a{m}").to_numpy()[order].astype(np.float64) for m in MODELS]
        found: list[tuple] = []
        for r in right.select(["batch", "grams", "docs", "times", "rows", "sums"]).to_batches(max_chunksize=1):
            batch, grams, docs, times, rows, sums = (c[0].as_py() for c in r.columns)
            if sums is not None:
                found.append((batch, None, rows, sums))
                continue
            want, doc, often = np.cumsum(_unpacked(grams, np.uint64), dtype=U64), _unpacked(docs, np.uint32), _unpacked(times, np.uint32)
            at = np.minimum(np.searchsorted(gram, want), max(len(gram) - 1, 0))
            met = gram[at] == want if len(gram) else np.zeros(len(want), bool)
            at, doc, often = at[met], doc[met], often[met]
            some = np.flatnonzero(np.bincount(doc)) if len(doc) else doc
            own = np.concatenate([np.bincount(doc, weights=adds[m][at] * often)[some] if len(doc) else np.zeros(0) for m in MODELS])
            found.append((batch, _packed(np.diff(some.astype(np.uint32), prepend=np.uint32(0))), None, _packed(own.astype(np.float32))))
        kinds = [pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 4, kinds, strict=True)], names=["batch", "docs", "rows", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = None, np.zeros((len(MODELS), 0))
        for batch in batches:
            for docs, own, sums in zip(*[batch.column(c).to_pylist() for c in ("docs", "rows", "sums")], strict=True):
                if own is not None:
                    rows, values = _unpacked(own, np.int64), np.frombuffer(zstandard.decompress(sums), np.float64).reshape(len(MODELS), -1)
                    at = np.arange(len(rows))
                else:
                    at, values = np.cumsum(_unpacked(docs, np.uint32)).astype(np.int64), _unpacked(sums, np.float32).reshape(len(MODELS), -1)
                if len(at) and at[-1] >= total.shape[1]:
                    total = np.concatenate([total, np.zeros((len(MODELS), int(at[-1]) + 1 - total.shape[1]))], axis=1)
                total[:, at] += values
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(x) for x in total]], ["_row", "s0", "s1", "s2"])

    parts = model.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(join, "batch bigint, docs binary, rows binary, sums binary")
    return parts.groupBy("batch").applyInArrow(add, "_row bigint, s0 double, s1 double, s2 double")


def sums_of(texts: DataFrame, words: int, model: Model, numbers: dict[str, int], space: Workspace) -> DataFrame:
    """(_row, s0, s1, s2): what the model adds to the packed texts, which hold so many words; rows with the same _row are to be summed up."""
    frequent = texts.sparkSession.sparkContext.broadcast(model.frequent())
    least = texts.sparkSession.sparkContext.defaultParallelism
    shards = PASSES * max(least, -(-model.rows // (PASSES * SHARD_ROWS)), -(-2 * words // (PASSES * SHARD_ASKED)))
    shard = F.shiftright(F.shiftrightunsigned("gram", 40) * shards, 24).cast("int")
    out = []
    for k in range(PASSES):
        rows = model.adding.withColumn("shard", shard).where(F.floor(F.col("shard") / (shards // PASSES)) == k).select("shard", "gram", *[f"a{m}" for m in MODELS])
        out.append(space.table(answered(rows, asked(texts, numbers, frequent, shards, k)), f"sums-{k}"))
        if (k + 1) % ADDED == 0:
            added = union(out[-ADDED:]).groupBy("_row").agg(*[F.sum(f"s{m}").alias(f"s{m}") for m in MODELS])
            out[-ADDED:] = [space.table(added, f"added-{k}")]
            space.drop(*[f"sums-{i}" for i in range(k + 1 - ADDED, k + 1)])
    frequent.destroy()
    return union(out)
