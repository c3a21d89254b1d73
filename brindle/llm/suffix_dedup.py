"""Removal of long repeated strings by a sparse enhanced suffix array and its common-prefix interval tree.

Sorting all suffixes of the corpus would move each byte some two hundred times.
Only the suffixes at anchors are sorted: of every 200 bytes, the anchor is the
place of their smallest hashed k-byte string, leftmost first. It depends on these
bytes alone, so two equal 200-byte strings have their anchors at the same place,
and everything that repeats meets in the group of one anchor string.

1. Each text gives its anchors with the stretch of bytes whose windows they stand
   for. Stretches that occur more than once are repeats as they are; they need no
   text. An anchor string that occurs once is done.
2. What remains are different stretches around one anchor string, such as the
   edges of copied passages. They are the suffixes of one part of the array: sorted
   by what follows the anchor, with the lengths of common prefixes of neighbours.
   A stack scan over these gives the tree of common-prefix intervals. An interval
   whose members differ in what precedes them is a repeat that can't be extended;
   its members' common left extensions, found among all members and not between
   neighbours only, tell which windows repeat. All occurrences are given out.
3. The bytes that repeated windows cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, load
from .membership import membership
from .textkit import U64, hash_ranges, mix64, pieces, tidy, utf8_of

LENGTH = 200
ANCHOR = 100
REACH = LENGTH - ANCHOR  # how far an anchor can be from the start of its window
#: Groups of more members are told apart window by window, in Spark's own aggregation.
GROUP_LIMIT = 20_000
PAD = 0xFF  # in no UTF-8 text
#: Windows of a long text that are looked at together.
PART = 1 << 20
#: What is said of a row beside its place: nothing, that its batch has copies of its stretch, that it is such a copy.
ALONE, COPIED, COPY = range(3)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: its row, place, string's hash, first and last window start (bytes of the batch).

    A long text is taken in parts; an anchor whose windows a cut divides is put together again.
    """
    if len(offsets) != 2 or len(data) <= 2 * PART:
        return _anchors(data, offsets)
    found: list[list[np.ndarray]] = []
    for a in range(0, len(data) - LENGTH + 1, PART):
        part = data[a : min(len(data), a + PART + LENGTH - 1)]
        row, place, hashes, first, last = _anchors(part, np.array([0, len(part)]))
        own = [row, place + a, hashes, first + a, last + a]
        if found and found[-1][1][-1] == own[1][0]:
            found[-1][4][-1] = own[4][0]
            own = [c[1:] for c in own]
        if len(own[0]):
            found.append(own)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    sizes = np.diff(offsets)
    empty = np.zeros(0, np.int64)
    if not (sizes >= LENGTH).any():
        return empty, empty, np.zeros(0, U64), empty, empty
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = hash_ranges(data, at, at + ANCHOR)
    low = (hashes & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    width, span = 1, REACH + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    full = np.flatnonzero(sizes >= LENGTH)
    counts = sizes[full] - LENGTH + 1
    windows = np.repeat(offsets[full] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    place = (low[windows] & U64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(full, counts)
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return row[first], place[first], hashes[place[first]], windows[first], windows[last]


def _anchor_rows(docs: DataFrame, text: str) -> DataFrame:
    """(anchor, stretch, rid, at); windows start ``ahead`` to ``behind`` bytes before the anchor.

    ``at`` holds the tag that rid goes with, the anchor's place and what is known of
    the row: of the equal stretches of a batch one stands for all, and its copies
    needn't meet anything else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            data, offsets = utf8_of(batch.column(text))
            row, place, hashes, first, last = anchors(data, offsets)
            if len(row):
                ahead, behind = place - first, place - last
                stretch = mix64(hash_ranges(data, first, last + LENGTH) ^ mix64((ahead * 256 + behind).astype(U64)))
                stretch = (stretch & ~U64(0xFFFF)) | (ahead * 256 + behind).astype(U64)
                _, chief, which, copies = np.unique(stretch, return_index=True, return_inverse=True, return_counts=True)
                known = np.where(copies[which] > 1, COPY, ALONE)
                known[chief[copies > 1]] = COPIED
                at = (batch.column("tag").to_numpy()[row].astype(np.int64) << 32) | ((place - offsets[row]) << 2) | known
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(batch.column("rid").to_numpy()[row]), pa.array(at)],
                    ["anchor", "stretch", "rid", "at"],
                )

    return docs.select("rid", "tag", text).mapInArrow(run, "anchor bigint, stretch bigint, rid bigint, at bigint")


def _sorted_out(rows: DataFrame) -> DataFrame:
    """From rows in order of (anchor, stretch, copies last): those of repeated anchors, with what is known of them.

    ``known`` is 1 for a stretch that occurs more than once; ``chief`` is 1 for the
    first row of a stretch that isn't a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        several = known = False  # of the held row: its anchor, its stretch was seen before it
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            out, several, known = _settle(columns, several, known, held is not None, False)
            held = [c[-1:] for c in columns]
            if out is not None:
                yield out
        if held is not None:
            out, _, _ = _settle(held, several, known, True, True)
            if out is not None:
                yield out

    return rows.mapInArrow(run, "anchor bigint, stretch bigint, rid bigint, tag int, at int, known int, chief int")


def _settle(columns: list[np.ndarray], several: bool, known: bool, carried: bool, final: bool) -> tuple[pa.RecordBatch | None, bool, bool]:
    """All rows but the last, or the last too if it is final. The flags say what came before the first row and go on for the last."""
    anchor, stretch = columns[0], columns[1]
    n = len(anchor)
    same_anchor = anchor[1:] == anchor[:-1]
    same = same_anchor & (stretch[1:] == stretch[:-1])
    before_anchor = np.concatenate([[several and carried], same_anchor])
    before = np.concatenate([[known and carried], same])
    after_anchor, after = np.concatenate([same_anchor, [False]]), np.concatenate([same, [False]])
    said = columns[3] & 3
    keep = before_anchor | after_anchor | (said != ALONE)
    if not final:
        keep[-1] = False
    out = None
    if keep.any():
        packed = columns[3][keep]
        out = pa.RecordBatch.from_arrays(
            [
                *(pa.array(c[keep]) for c in columns[:3]),
                pa.array((packed >> 32).astype(np.int32)),
                pa.array(((packed & 0xFFFFFFFF) >> 2).astype(np.int32)),
                pa.array((before | after | (said != ALONE))[keep].astype(np.int32)),
                pa.array((~before & (said != COPY))[keep].astype(np.int32)),
            ],
            ["anchor", "stretch", "rid", "tag", "at", "known", "chief"],
        )
    return out, bool(before_anchor[n - 1]), bool(before[n - 1])


def _contexts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """The wanted rows with the bytes around their anchors, from one join on the row's id."""
    may_have = membership(wanted, "rid")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield batch.filter(pa.array(may_have(batch.column("rid").to_numpy())))

    texts = docs.select("rid", "tag", text).mapInArrow(pick, f"rid bigint, tag int, `{text}` string").dropDuplicates(["rid", "tag"])
    asked = wanted.groupBy("rid", "tag").agg(F.collect_list(F.struct("anchor", "stretch", "at", "known")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            data, offsets = utf8_of(batch.column(text))
            rows = batch.column("asked")
            at, flat = rows.offsets.to_numpy(), rows.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            place = flat.field("at").to_numpy() + offsets[row]
            for a in range(0, len(row), 1 << 14):
                b = slice(a, a + (1 << 14))
                index = place[b, None] + np.arange(-REACH, LENGTH)
                inside = (index >= offsets[row[b], None]) & (index < offsets[row[b] + 1, None])
                around = np.where(inside, data[np.clip(index, 0, len(data) - 1)], PAD).astype(np.uint8)
                ends = np.arange(len(around) + 1, dtype=np.int32) * (LENGTH + REACH)
                packed = pa.Array.from_buffers(pa.binary(), len(around), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(around))])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor")[b], flat.field("stretch")[b], *(pa.array(batch.column(c).to_numpy()[row[b]]) for c in ("rid", "tag")), flat.field("at")[b], flat.field("known")[b], packed],
                    ["anchor", "stretch", "rid", "tag", "at", "known", "around"],
                )

    schema = "anchor bigint, stretch bigint, rid bigint, tag int, at int, known int, around binary"
    return texts.join(asked, ["rid", "tag"]).select("rid", "tag", text, "asked").mapInArrow(run, schema)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows the length of their common beginning."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def intervals(common: np.ndarray, floor: int) -> Iterator[tuple[int, int, int, int]]:
    """The common-prefix intervals (depth, parent's depth, first, last) of a sorted part, by a stack scan.

    ``common[i]`` is the common prefix of members i and i + 1. Each interval comes
    once, children before parents; the root's parent has the depth ``floor`` - 1.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common.tolist(), floor - 1]):
        start = i
        while stack and stack[-1][0] > depth:
            top, start = stack.pop()
            yield top, max(depth, stack[-1][0] if stack else floor - 1), start, i
        if depth >= floor and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def repeated_windows(around: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(member, interval, far, near): its windows that start ``far`` to ``near`` bytes before the anchor repeat.

    The rows of ``around`` hold REACH bytes before and LENGTH bytes from the anchor.
    """
    right, left = around[:, REACH:], around[:, :REACH][:, ::-1]
    keys = [r.tobytes() for r in right]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
    left_keys = [r.tobytes() for r in left]
    by_left = np.empty(len(keys), dtype=np.int64)
    by_left[np.array(sorted(range(len(keys)), key=left_keys.__getitem__))] = np.arange(len(keys))
    sorted_right = right[order]
    for number, (depth, above, i, j) in enumerate(intervals(_common(sorted_right[:-1], sorted_right[1:]), ANCHOR)):
        members = order[i : j + 1]
        if (left[members] == left[members[0]]).all():  # no left diversity: one string, extended to the left as far as it counts
            extension = np.full(len(members), REACH)
        else:
            members = members[np.argsort(by_left[members])]
            gaps = _common(left[members[:-1]], left[members[1:]])
            extension = np.maximum(np.concatenate([[0], gaps]), np.concatenate([gaps, [0]]))
        near = np.maximum(LENGTH - depth, behind[members])
        far = np.minimum(np.minimum(LENGTH - above - 1, extension), ahead[members])
        for m in np.flatnonzero(far >= near).tolist():
            yield int(members[m]), number, int(far[m]), int(near[m])


def _grouped(contexts: DataFrame) -> DataFrame:
    """Repeats within groups of one anchor; rows come in order of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor = table.column("anchor").to_numpy()
            stretch = table.column("stretch").to_numpy().view(U64)
            ahead, behind = ((stretch >> U64(8)) & U64(255)).astype(np.int64), (stretch & U64(255)).astype(np.int64)
            known = table.column("known").to_numpy()
            around = np.frombuffer(b"".join(table.column("around").to_pylist()), dtype=np.uint8).reshape(-1, LENGTH + REACH)
            rid, tag, at = (table.column(c).to_numpy() for c in ("rid", "tag", "at"))
            edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    for m, number, far, near in repeated_windows(around[a:b], ahead[a:b], behind[a:b]):
                        if not known[a + m]:
                            found.append((rid[a + m], tag[a + m], at[a + m] - far, at[a + m] - near + LENGTH, anchor[a], number))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(f[i]) for f in found], pa.int32() if i == 1 else pa.int64()) for i in range(6)],
                    ["rid", "tag", "start", "end", "anchor", "number"],
                )

        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield from solved(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held))

    return contexts.mapInArrow(run, "rid bigint, tag int, start bigint, end bigint, anchor bigint, number bigint")


def _by_window(contexts: DataFrame) -> DataFrame:
    """Repeats within very large groups: each window's hash is counted, with partial sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                data = np.frombuffer(b"".join(part.column("around").to_pylist()), dtype=np.uint8)
                stretch = part.column("stretch").to_numpy().view(U64)
                ahead, behind = ((stretch >> U64(8)) & U64(255)).astype(np.int64), (stretch & U64(255)).astype(np.int64)
                counts = ahead - behind + 1
                row = np.repeat(np.arange(len(counts)), counts)
                before = np.repeat(ahead + np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) - np.arange(counts.sum())
                start = row * (LENGTH + REACH) + REACH - before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("anchor").to_numpy()[row]), pa.array(before), pa.array(hash_ranges(data, start, start + LENGTH).view(np.int64)), *(pa.array(part.column(c).to_numpy()[row]) for c in ("rid", "tag")), pa.array(part.column("at").to_numpy()[row] - before)],
                    ["anchor", "before", "window", "rid", "tag", "start"],
                )

    windows = contexts.mapInArrow(run, "anchor bigint, before bigint, window bigint, rid bigint, tag int, start bigint")
    twice = windows.groupBy("anchor", "before", "window").agg(F.count("*").alias("n")).where("n > 1")
    return windows.join(twice, ["anchor", "before", "window"]).select("rid", "tag", "start", (F.col("start") + LENGTH).alias("end"), "anchor", F.col("window").alias("number"))


def repeats(docs: DataFrame, text: str, space: Workspace) -> DataFrame:
    """(rid, tag, start, end, anchor, number): byte ranges of ``docs``' rows that repeated windows cover.

    Rows with the same anchor and number are the occurrences of one maximal repeat;
    a number of -1 or less names a stretch that occurs more than once as it is.
    """
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copy = F.col("at").bitwiseAND(3) == COPY
    # copies go anywhere, so a string that a third of all texts have doesn't go to one task
    rows = _anchor_rows(docs, text).repartition(parts, F.when(copy, F.xxhash64("rid", "at")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor", "stretch", copy)
    found = space.table(_sorted_out(rows), "anchors")
    groups = found.where("chief = 1").groupBy("anchor").agg(F.count("*").alias("members"), F.min("known").alias("_all")).where("_all = 0").drop("_all")
    wanted = space.table(found.where("chief = 1").join(groups, "anchor").select("anchor", "stretch", "rid", "tag", "at", "known", (F.col("members") > GROUP_LIMIT).alias("large")), "wanted")
    contexts = _contexts(docs, text, wanted)
    large = wanted.where("large").select("anchor").distinct()
    contexts = space.table(contexts, "contexts")
    if large.isEmpty():
        usual, rest = contexts, None
    else:
        usual, rest = contexts.join(large, "anchor", "left_anti"), contexts.join(large, "anchor", "left_semi")
    spans = _grouped(usual.repartition(parts, "anchor").sortWithinPartitions("anchor", "stretch"))
    if rest is not None:
        spans = spans.union(_by_window(rest))
    ahead = F.shiftright("stretch", 8).bitwiseAND(255)
    behind = F.col("stretch").bitwiseAND(255)
    whole = found.where("known = 1").select("rid", "tag", (F.col("at") - ahead).alias("start"), (F.col("at") - behind + LENGTH).alias("end"), "anchor", (-1 - F.abs(F.shiftright("stretch", 1))).alias("number"))
    spans = space.table(spans.unionByName(whole), "spans")
    space.drop("anchors", "wanted", "contexts")
    return spans


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, space: Workspace | None = None) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, all other columns with the cut text.

    Null and empty texts have no bytes and lose none; texts under 200 bytes can't
    lose any. Repeated rows repeat each other. With ``keep_text`` the result has the
    input's columns and the text without the removed bytes, code points that were
    cut in two dropped. An empty table has no rows.
    """
    space = space or Workspace(docs.sparkSession, "suffix-dedup")
    # 96 bits name a row's key and text
    names = [f.name for f in docs.schema] if keep_text else [key, text]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # no name clashes with those used here
    own_key, own_text = f"c{names.index(key)}", f"c{names.index(text)}"
    rows = plain.select("*", F.xxhash64(own_key, own_text).alias("rid"), F.hash(own_text, own_key).alias("tag"))
    spans = repeats(rows, own_text, space)
    cuts = spans.groupBy("rid", "tag", "start").agg(F.max("end").alias("end")).groupBy("rid", "tag").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    may_have = membership(spans, "rid")
    columns = plain.columns
    kinds = dict(plain.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in columns)
    schema = fields if keep_text else f"{own_key} {kinds[own_key]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def made(batch: pa.RecordBatch, starts: list, ends: list) -> pa.RecordBatch:
        texts, out = batch.column(own_text).to_pylist(), []
        for own, a, b in zip(texts, starts, ends, strict=True):
            body = (own or "").encode()
            kept, gone, runs, last = [], 0, 0, 0
            if len(a):
                order = np.argsort(a)
                a, b = a[order], np.maximum.accumulate(b[order])
                fresh = np.concatenate([[True], a[1:] > b[:-1]])
                heads, tails = a[fresh], b[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(b) - 1]])]
                for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
                    kept.append(body[last:h])
                    gone, runs, last = gone + t - h, runs + 1, t
            kept.append(body[last:])
            out.append((own, len(body), gone, runs, b"".join(kept)))
        if keep_text:
            cut = pa.array([o[0] if not o[2] else o[4].decode("utf-8", "ignore") for o in out], pa.string())
            return pa.RecordBatch.from_arrays([cut if c == own_text else batch.column(c) for c in columns], columns)
        return pa.RecordBatch.from_arrays(
            [batch.column(own_key), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3)), pa.array([hashlib.sha256(o[4]).hexdigest() for o in out], pa.string())],
            [own_key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own_text):
            part = batch.filter(pa.array(~may_have(batch.column("rid").to_numpy())))
            none = [np.zeros(0, np.int64)] * part.num_rows
            if part.num_rows:
                yield made(part, none, none)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield batch.filter(pa.array(may_have(batch.column("rid").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own_text):
            lists = batch.column("cuts")
            at, flat = lists.offsets.to_numpy(), lists.flatten()
            a, b = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            at = at - at[0]
            pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield made(batch, [a[i:j] for i, j in pairs], [b[i:j] for i, j in pairs])

    touched = rows.select("rid", "tag", *columns).mapInArrow(pick, f"rid bigint, tag int, {fields}").join(cuts, ["rid", "tag"], "left")
    found = rows.select("rid", *columns).mapInArrow(whole, schema).union(touched.mapInArrow(cut, schema))
    return found.toDF(*names) if keep_text else found.withColumnRenamed(own_key, key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(load(spark, sf_dir, "documents"))
