"""Near-duplicate join of documents by the Jaccard similarity of their word shingles.

Exact, up to collisions of 64-bit hashes, without a pair for each two members of a group:

1. Documents with equal shingle sets are one class; only classes are compared.
2. A fixed-size counting sketch over all documents orders shingles, rare ones
   first. Two linked sets share one of the first n - ceil(t n) + 1 shingles of
   each, so only those are dealt out; a shingle that one class alone has there
   goes no further. The number of them that a pair shares bounds its overlap.
3. Shingles that the very same classes share, as those of one passage, become one
   token that counts as many times.
4. Grouping: in each list of classes that share a token, all are compared with
   the list's most central class. That puts most similar classes in one group.
5. Token-group matrix: rows (token, group) stand for each group's token union. A class whose shared
   tokens with a group can't reach the overlap that some member would need
   doesn't open that group. Qualifying groups are opened: the class is compared
   with the group's members, in blocks of bounded size, until a link is found.
6. Components of all links; a document's component is its smallest document.

A link that is never looked for is one between two classes that are in the same
group already, which cannot change any component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, load
from .components import components
from .fixed_tables import emitted, merged
from .membership import membership
from .textkit import U64, mix64, pieces, shingles, stream64, tidy, utf8_of

SKETCH = 1 << 20
#: Shingles of the members that a task holds at a time; one larger member is a cell of its own.
SHINGLES_A_CELL = 1 << 19
QUERIES_A_CELL = 4096
_SEEN_LIMIT = 1 << 20
#: A token's list of more classes than this goes on as it streams by and is not merged with equal ones.
LONG_LIST = 1 << 16
_LIST_SALT, _LONG_SALT = stream64(47, 2)


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each shingle set; 0 for an empty one."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(sets), dtype=U64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix64(flat ^ stream64(41, 1)[0]), at)
            out[full] = mix64(sums ^ mix64(np.bitwise_xor.reduceat(mix64(flat ^ stream64(43, 1)[0]), at) + sizes[full].astype(U64))) | U64(1)
    return out


def row_id(key: str, text: str) -> Column:
    """A hash of a row's key and text."""
    return F.xxhash64(key, text)


def _scan(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows (key, rid, n, sid) of all documents, and the parts of the sketch of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "rid", "n", "sid", "block", "packed"]
        counts = np.zeros(SKETCH, dtype=np.uint32)
        none = lambda k, n: pa.nulls(n, k)
        kind = pa.int64()
        for batch in pieces(batches, text):
            kind = batch.column(key).type
            sets = shingles(*utf8_of(batch.column(text)), width)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> U64(44)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids(sets).view(np.int64)), none(pa.int32(), n), none(pa.binary(), n)], names
            )
        if counts.any():
            parts = emitted(counts)
            yield pa.RecordBatch.from_arrays(
                [none(kind, len(parts)), *[none(pa.int64(), len(parts))] * 3, pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names
            )

    rows = docs.select(key, text, row_id(key, text).alias("rid"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, rid bigint, n bigint, sid bigint, block int, packed binary")


def _heavy(sketch: np.ndarray) -> np.ndarray:
    """For each counter 0 if it is within the noise of a random table, else its count on a coarse log scale."""
    mean = float(sketch.sum(dtype=np.float64)) / SKETCH
    loud = sketch > mean + 5 * math.sqrt(mean) + 1
    return np.where(loud, np.minimum(np.log2(np.maximum(sketch, 1)) * 64, 0x7FFF), 0).astype(np.uint16)


def _firsts(docs: DataFrame, text: str, width: int, share: Fraction, heavy: np.ndarray) -> DataFrame:
    """For each class the first shingles of its order: rows (sid, n, last, tokens), once a task at least."""
    spread = docs.sparkSession.sparkContext.broadcast(heavy)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, text):
            sets = shingles(*utf8_of(batch.column(text)), width)
            rows: list[tuple] = []
            for sid, own in zip(set_ids(sets).view(np.int64).tolist(), sets, strict=True):
                if not len(own) or sid in seen:
                    continue
                if len(seen) >= _SEEN_LIMIT:
                    seen.clear()
                seen.add(sid)
                rank = (spread.value[(own >> U64(44)).astype(np.int64)].astype(U64) << U64(48)) | (own >> U64(16))
                first = np.argsort(rank, kind="stable")[: len(own) - math.ceil(share * len(own)) + 1]
                rows.append((sid, len(own), int(rank[first[-1]].view(np.int64)), own[first].view(np.int64)))
            if rows:
                at = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))],
                    ["sid", "n", "last", "tokens"],
                )

    return docs.select(text).mapInArrow(run, "sid bigint, n bigint, last bigint, tokens array<bigint>")


def _lists(tokens: DataFrame) -> DataFrame:
    """(list, sid, length) for each token that several classes have; rows (token, sid) stream by in order.

    ``list`` is a hash of the token's classes, so tokens with the same classes have
    the same one. ``length`` is the number of classes. A list of more than LONG_LIST
    classes is named by its token and has the length seen so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, sid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long: tuple | None = None  # the token whose list goes on as it streams by, and its length so far
        for batch in _and_end(batches):
            if batch is not None:
                token, sid = (np.concatenate([held, batch.column(c).to_numpy()]) for held, c in ((token, "token"), (sid, "sid")))
            if not len(token):
                continue
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            token, sid = token[fresh], sid[fresh]
            if long is not None:
                more = int(np.searchsorted(token, long[0], "right"))
                # the last row is kept back, so that a repeated one is seen as such
                out = more if more < len(token) or batch is None else more - 1
                yield _list_rows(np.full(out, long[2]), sid[:out], np.full(out, long[1] + out))
                long = (long[0], long[1] + out, long[2]) if out == more - 1 and batch is not None else None
                token, sid = token[out:], sid[out:]
                if long is not None or not len(token):
                    continue
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            done = len(edges) - 1 if batch is None else len(edges) - 2  # lists that are complete
            sizes = np.diff(edges[: done + 1])
            if done:
                end = edges[done]
                with np.errstate(over="ignore"):
                    named = mix64(np.add.reduceat(mix64(sid[:end].view(U64) ^ _LIST_SALT), edges[:done])).view(np.int64)
                several = np.repeat(sizes > 1, sizes)
                yield _list_rows(np.repeat(named, sizes)[several], sid[:end][several], np.repeat(sizes, sizes)[several])
                token, sid = token[end:], sid[end:]
            if batch is not None and len(token) > LONG_LIST:
                out, name = len(token) - 1, mix64(token[:1].view(U64) ^ _LONG_SALT).view(np.int64)[0]
                yield _list_rows(np.full(out, name), sid[:out], np.full(out, out))
                long, token, sid = (token[0], out, name), token[out:], sid[out:]

    return tokens.mapInArrow(run, "list bigint, sid bigint, length bigint")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from tidy(batches)
    yield None


def _list_rows(name: np.ndarray, sid: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (name, sid, length)], ["list", "sid", "length"])


class _Bound:
    """Column expressions for overlaps at a similarity of at least ``share``."""

    def __init__(self, share: Fraction):
        self.a, self.b = share.numerator, share.denominator

    def overlap(self, m: Column, n: Column) -> Column:
        """The least overlap of linked sets of m and n shingles."""
        return F.ceil((m + n) * self.a / (self.a + self.b) - 1e-9)

    def rest(self, n: Column) -> Column:
        """How many shingles are behind the first ones."""
        return F.ceil(n * self.a / self.b - 1e-9) - 1

    def sizes(self, m: Column, n: Column) -> Column:
        return (F.least(m, n) * self.b) >= (F.greatest(m, n) * self.a)


def _texts_of(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame, owners: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(sid, packed) with the compressed texts of the wanted classes, each from one of its documents, and perhaps a few more.

    The rows are picked by a bit set of fixed size where they are read, and name their
    class themselves, so no text is moved to find it. A row that occurs many times
    comes once a task.
    """
    may_have = membership(wanted.distinct().join(owners, "sid"), "rid")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = may_have(batch.column("rid").to_numpy())
                if keep.any():
                    yield batch.filter(pa.array(keep))

        for batch in pieces(kept(), "text"):
            sids, texts = set_ids(shingles(*utf8_of(batch.column("text")), width)).view(np.int64).tolist(), batch.column("text")
            fresh = [i for i, sid in enumerate(sids) if sid not in seen and not seen.add(sid)]
            yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in fresh], pa.int64()), pa.array([pack.compress((texts[i].as_py() or "").encode()) for i in fresh], pa.binary())], ["sid", "packed"])
            if len(seen) >= _SEEN_LIMIT:
                seen.clear()

    rows = docs.select(row_id(key, text).alias("rid"), F.col(text).alias("text"))
    return space.table(rows.mapInArrow(pick, "sid bigint, packed binary"), name)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the column text in place of the last, packed; a few at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [unpack.decompress(p).decode() for p in part.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.large_string())], [*part.schema.names[:-1], "text"])


def _opened(queries: DataFrame, members: DataFrame, texts: DataFrame, width: int, share: Fraction) -> DataFrame:
    """Links (a, b): for each query class (x, g) one linked member (g, y, n) in each cell of g, if there is one.

    A group's members and queries are dealt into cells of bounded size; a task
    holds one cell's members at a time while its queries stream by. Compressed texts
    are moved, as they are smaller than their sets.
    """
    sizes = members.groupBy("g").agg(F.ceil(F.sum("n") / SHINGLES_A_CELL).cast("int").alias("ms"))
    asked = queries.groupBy("g").agg(F.ceil(F.count("*") / QUERIES_A_CELL).cast("int").alias("qs"))
    cells = sizes.join(asked, "g")
    left = members.join(cells, "g").select(
        "g", F.pmod(F.hash("y"), F.col("ms")).alias("m"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(0).alias("role"), F.col("y").alias("sid")
    )
    right = queries.join(cells, "g").select(
        "g", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("m"), F.pmod(F.hash("x"), F.col("qs")).alias("q"), F.lit(1).alias("role"), F.col("x").alias("sid")
    )
    parts = max(2, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = left.unionByName(right).join(texts, "sid").repartition(parts, "g", "m", "q").sortWithinPartitions("g", "m", "q", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held, index = None, [], [], None
        for batch in pieces(_unpacked(batches), "text"):
            found = []
            sets = shingles(*utf8_of(batch.column("text")), width)
            for own, g, m, q, role, sid in zip(sets, *(batch.column(c).to_pylist() for c in ("g", "m", "q", "role", "sid")), strict=True):
                if (g, m, q) != cell:
                    cell, ids, held, index = (g, m, q), [], [], None
                if role == 0:
                    ids.append(sid)
                    held.append(own)
                    continue
                if index is None:
                    if not held:
                        continue
                    tokens = np.concatenate(held)
                    order = np.argsort(tokens, kind="stable")
                    sizes_ = np.array([len(h) for h in held])
                    index = (tokens[order], np.repeat(np.arange(len(held)), sizes_)[order], sizes_)
                    held = []
                low, high = np.searchsorted(index[0], own, "left"), np.searchsorted(index[0], own, "right")
                spans = high - low
                hits = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                common = np.bincount(index[1][hits], minlength=len(ids))
                linked = np.flatnonzero((common > 0) & (share.denominator * common >= share.numerator * (index[2] + len(own) - common)))
                linked = [j for j in linked.tolist() if ids[j] != sid]
                if linked:
                    found.append((sid, ids[linked[0]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.select("g", "m", "q", "role", "sid", "packed").mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: Fraction = Fraction(3, 4), space: Workspace | None = None, with_rows: bool = False) -> DataFrame:
    """One row per input row: key, n_shingles, component_id and, if asked for, row_id and first_row.

    ``component_id`` is the smallest key reachable by links. A document without
    words, be its text null, empty or white space, has 0 shingles and is its own
    component. Repeated rows have equal sets and are linked. A null key stays null
    and isn't a candidate for the smallest. An empty table has no rows; other
    columns are not read. ``row_id`` is that of row_id(), and ``first_row`` that of the
    row of the component with the smallest key, null keys last; a document without
    words is its own.
    """
    space = space or Workspace(docs.sparkSession, "ngram-join")
    scanned = space.table(_scan(docs, key, text, width), "scan")
    mine = scanned.where("n is not null").select(key, "rid", "n", "sid")
    heavy = _heavy(merged(scanned.where("block is not null"), "<u4", np.add, SKETCH))

    firsts = space.table(_firsts(docs, text, width, share, heavy), "firsts")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens = firsts.select(F.explode("tokens").alias("token"), "sid").repartition(parts, "token").sortWithinPartitions("token", "sid")
    shared = _lists(tokens).groupBy("list", "sid").agg(F.count("*").alias("times"), F.max("length").alias("length"))
    shared = space.table(shared, "shared")

    facts = firsts.select("sid", "n", "last").dropDuplicates(["sid"])
    about = shared.groupBy("sid").agg(F.sum("times").alias("several"), F.sum(F.col("times") * F.col("length")).alias("_total"))
    about = space.table(about.join(facts, "sid").select("sid", "several", "n", "last", (F.col("_total") / F.col("n")).cast("float").alias("central")), "about")
    space.drop("firsts")  # the largest table; what is needed of it is in the two others

    bound = _Bound(share)
    known = shared.select("list", "sid").join(about.select("sid", "central"), "sid")
    # a table of its own, so that the join can split a list of very many classes
    leaders = space.table(known.groupBy("list").agg(F.max(F.struct("central", "sid")).alias("_lead")).select("list", F.col("_lead.sid").alias("g")), "leaders")
    star = shared.select("list", "sid", "times").join(leaders, "list").where("sid <> g").groupBy("sid", "g").agg(F.sum("times").alias("common"))
    x, y = about.select("sid", F.col("n").alias("xn"), F.col("last").alias("xlast")), about.select(F.col("sid").alias("g"), F.col("n").alias("yn"), F.col("last").alias("ylast"))
    xn, yn = F.col("xn"), F.col("yn")
    behind = F.when(F.col("xlast") < F.col("ylast"), bound.rest(xn)).when(F.col("xlast") > F.col("ylast"), bound.rest(yn)).otherwise(F.greatest(bound.rest(xn), bound.rest(yn)))
    star = star.join(x, "sid").join(y, "g").where(bound.sizes(xn, yn) & (F.col("common") >= bound.overlap(xn, yn) - behind))
    star = space.table(star.select(F.col("sid").alias("x"), "g", F.col("yn").alias("n")), "star")
    owners = mine.where("n > 0").groupBy("sid").agg(F.min("rid").alias("rid"))
    texts = _texts_of(docs, key, text, width, star.select(F.col("x").alias("sid")).union(star.select("g")), owners, space, "texts-1")
    first_links = space.table(_opened(star.select("x", "g"), star.select("g", F.col("g").alias("y"), "n").distinct(), texts, width, share), "links-1")
    space.drop("star", "leaders", "texts-1")
    groups = components(first_links, space, "groups")

    weight = groups.groupBy("root").agg((F.count("*") + 1).alias("weight"))
    label = groups.select(F.col("node").alias("sid"), "root").union(groups.select(F.col("root").alias("sid"), "root").distinct())
    label = about.select("sid", "several", "n", "last").join(label, "sid", "left").withColumn("group", F.coalesce("root", "sid")).drop("root")
    label = label.join(weight.withColumnRenamed("root", "group"), "group", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    label = space.table(label, "label")
    space.drop("about")
    mixed = space.table(shared.select("list", "sid", "times").join(label, "sid"), "mixed")
    space.drop("shared")

    matrix = mixed.groupBy("list", F.col("group").alias("g")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("several").alias("g_several"), F.min("last").alias("g_first"), F.max("last").alias("g_last"), F.first("weight").alias("g_weight")
    )
    n = F.col("n")
    low = F.greatest(F.col("lo"), F.ceil(n * bound.a / bound.b - 1e-9))
    high = F.least(F.col("hi"), F.floor(n * bound.b / bound.a + 1e-9))
    least = (
        F.when(F.col("last") < F.col("g_first"), bound.overlap(n, low) - bound.rest(n))
        .when(F.col("last") > F.col("g_last"), F.least(*[bound.overlap(n, v) - bound.rest(v) for v in (low, high)]) - 1)
        .otherwise(F.least(*[bound.overlap(n, v) - F.greatest(bound.rest(n), bound.rest(v)) for v in (low, high)]) - 1)
    )
    cells = (
        mixed.join(matrix, "list")
        .where((F.col("weight") < F.col("g_weight")) | ((F.col("weight") == F.col("g_weight")) & (F.col("group") > F.col("g"))))
        .where(low <= high)
        .where(F.least("several", "g_several") >= least)
    )
    opens = cells.groupBy(F.col("sid").alias("x"), "g").agg(F.sum("times").alias("common"), F.min(least).alias("least")).where("common >= least").select("x", "g")
    opens = space.table(opens, "opens")
    space.drop("mixed")
    within = opens.select("g").distinct()
    members = space.table(label.select(F.col("group").alias("g"), F.col("sid").alias("y"), "n").join(within, "g", "left_semi"), "members")
    space.drop("label")
    texts = _texts_of(docs, key, text, width, opens.select(F.col("x").alias("sid")).union(members.select(F.col("y").alias("sid"))), owners, space, "texts-2")
    links = first_links.union(space.table(_opened(opens, members, texts, width, share), "links-2"))
    space.drop("opens", "members", "texts-2")
    final = components(links, space, "components")

    labelled = mine.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "sid")))
    labelled = space.table(labelled.select(F.col(key).alias("_key"), "rid", "n", "root"), "labelled")
    # a table of its own, so that the join can split a root of very many documents
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("rid").alias("row")))
    smallest = space.table(labelled.where("root is not null").groupBy("root").agg(first.alias("first")).select("root", "first.key", "first.row"), "smallest")
    joined = labelled.where("root is not null").join(smallest, "root").select("_key", "n", "key", "rid", "row")
    found = joined.union(labelled.where("root is null").select("_key", "n", "_key", "rid", "rid")).toDF(key, "n_shingles", "component_id", "row_id", "first_row")
    found = space.table(found if with_rows else found.drop("row_id", "first_row"), "found")
    space.keep("found")
    return found


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents"))
