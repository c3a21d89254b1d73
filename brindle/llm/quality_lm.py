"""Quality classification by an interpolated modified Kneser-Ney model of words.

Words are modelled in pairs (word_lm.py) by sharded count joins. A word without a
context rests on its spelling by the letter model here, 4-grams over letters folded
to 32 classes, whose tables are bounded by the alphabet. Every document's perplexity
under its language's model is held against limits from quantiles of that language's
trusted documents, each half of which is judged by a model of the other half.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, cleaning, load
from .letters import BITS, CAPITAL, CLASSES, ORDER, SPACE, class_table, kinds_of
from .membership import membership
from .textkit import pieces, tidy, utf8_of
from .word_lm import Model, chunks, packed, read, spelt, sums_of, union, words_of

#: The quantile QUANTILE of a language's trusted texts, in texts that the model hasn't seen, is so far above the median;
#: a perplexity FENCE times as far above it is rejected.
QUANTILE = 0.9
FENCE = 8.0
#: Texts of so many letters have perplexities that spread by the root of two wider than those of long ones.
SHORT = 200
#: Width of the bins of log perplexity that are counted.
STEP = 0.0005
#: Documents whose language has fewer trusted n-grams than this are not judged.
LEAST_GRAMS = 2_000
#: Driver and workers hold three tables a language, of so many languages at a time.
MOST_LANGUAGES = 12
#: Stored bytes of packed texts that one task counts.
COUNTED_BYTES = 16 << 20
#: A table of a row a language is broadcast up to so many rows.
FEW_LANGUAGES = 10_000
#: Between a language and the number of one of its halves; in no language's name.
HALF = "\x1f"
#: Of the names of the letter models of a language: of its halves, of both.
SUFFIXES = [f"{HALF}0", f"{HALF}1", ""]


def grams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram at every code point, texts being preceded by spaces, and for n rows the n + 1 points at which rows begin.

    A capital after a capital has a class of its own, so running capitals are seen.
    """
    kinds, run, rows = kinds_of(data, offsets, table)
    starts = rows[:-1][np.diff(rows) > 0]
    kinds = np.where(run, CAPITAL, kinds).astype(np.uint32)
    codes = kinds.copy()
    for back in range(1, ORDER):
        shifted = np.zeros_like(kinds)
        shifted[back:] = kinds[:-back] if back < len(kinds) + 1 else 0
        for j in range(back):
            at = starts + j
            shifted[at[at < len(shifted)]] = SPACE
        codes |= shifted << np.uint32(BITS * back)
    return codes, rows


def counts(docs: DataFrame, text: str, lang: str, words: bool = False) -> DataFrame:
    """(lang, gram, c) over all rows, or of their words one by one; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for codes, rows, langs in _words_grams(batches) if words else _texts_grams(batches):
            for own in set(langs):
                if own not in found and len(found) >= MOST_LANGUAGES:
                    yield from _flush(found)
                mine = np.repeat(np.array([x == own for x in langs]), np.diff(rows))
                held = found.setdefault(own, np.zeros(1 << (BITS * ORDER), dtype=np.uint32))
                held += np.bincount(codes[mine], minlength=len(held)).astype(np.uint32)
        yield from _flush(found)

    rows = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    return rows.mapInArrow(run, "lang string, gram int, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _texts_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    table = class_table()
    for batch in pieces(batches, "_text"):
        yield *grams(*utf8_of(batch.column("_text")), table), batch.column("_lang").to_pylist()


def _words_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    for part in read(batches):
        codes, begin = part.words.spellings()
        yield codes, begin[part.rows], part.batch.column("_lang").to_pylist()


def packed_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, c) of the words, one by one, of packed texts; each half of a language is one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for chunk in chunks(batches):
            codes, begin = spelt(chunk.lengths, chunk.kinds)
            sizes = np.diff(begin)
            for half in (0, 1):
                times = np.bincount(chunk.ids[np.repeat(chunk.half == half, chunk.sizes)], minlength=len(sizes))
                for i, lang in enumerate(chunk.langs):
                    mine = (chunk.tongue_of == i) & (times > 0)
                    if not mine.any():
                        continue
                    own = f"{lang}{HALF}{half}"
                    if own not in found and len(found) >= MOST_LANGUAGES:
                        yield from _flush(found)
                    held = found.setdefault(own, np.zeros(1 << (BITS * ORDER), dtype=np.uint32))
                    held += np.bincount(codes[np.repeat(mine, sizes)], weights=np.repeat(times[mine], sizes[mine]), minlength=len(held)).astype(np.uint32)
        yield from _flush(found)

    return texts.mapInArrow(run, "lang string, gram int, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _flush(found: dict) -> Iterator[pa.RecordBatch]:
    for own, held in found.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at].astype(np.int64))], ["lang", "gram", "c"])
    found.clear()


def _orders(top: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(order, (lang, gram, c)) from 1 to ORDER; below the highest, c is the number of different left neighbours."""
    tables = [(ORDER, top)]
    for order in range(ORDER - 1, 0, -1):
        above = tables[-1][1]
        tables.append((order, above.groupBy("lang", F.col("gram").bitwiseAND((1 << (BITS * order)) - 1).alias("gram")).agg(F.count("*").alias("c"))))
    return reversed(tables)


def discounts() -> list[Column]:
    """What is cut off counts of one, two and more, from the numbers n1 to n4 of n-grams with counts of one to four."""
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    return [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k * 0.5)))) for k in (1, 2, 3)]


def train(top: DataFrame, space: Workspace) -> DataFrame:
    """(lang, order, gram, p) of seen n-grams and (lang, order, context, -weight) of contexts, by count joins.

    ``p`` is the interpolated probability of the last letter; a context's weight is
    what it gives to the next lower order. Contexts have negative values.
    """
    top = space.table(top, "counts")
    lower, out = None, None
    for order, table in _orders(top):
        seen = F.when(F.col("c") >= 3, 3).otherwise(F.col("c").cast("int"))
        kinds = table.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        cuts = kinds.select("lang", *[c.alias(f"d{k}") for k, c in enumerate(discounts(), 1)])
        table = table.withColumn("context", F.shiftright("gram", BITS)).join(cuts, "lang")
        table = table.withColumn("d", F.when(seen == 1, F.col("d1")).when(seen == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = table.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("kept"))
        table = table.join(contexts, ["lang", "context"]).withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            table = table.withColumn("p", F.col("own") + F.col("kept") / F.col("total") / CLASSES)
        else:
            suffix = F.col("gram").bitwiseAND((1 << (BITS * (order - 1))) - 1)
            table = table.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            table = table.withColumn("p", F.col("own") + F.col("kept") / F.col("total") * F.col("below"))
        rows = table.select("lang", F.lit(order).alias("order"), "gram", "p").union(
            contexts.select("lang", F.lit(order), F.col("context").cast("int"), -F.col("kept") / F.col("total"))
        )
        rows = space.table(rows, f"order-{order}")
        lower = rows.where("p > 0").select("lang", "gram", "p")
        out = rows if out is None else out.union(rows)
    return out


def dense(rows: Iterable[tuple[str, int, int, float]]) -> dict[str, np.ndarray]:
    """For each language log p of every n-gram, seen or not."""
    found: dict[str, list[dict]] = {}
    for lang, order, gram, p in rows:
        found.setdefault(lang, [{} for _ in range(2 * ORDER + 2)])[2 * order + (p < 0)][gram] = abs(p)
    return {lang: _filled([(np.array(list(t), np.int64), np.array(list(t.values()))) for t in tables]) for lang, tables in found.items()}


def _filled(tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log p of every n-gram from the n-grams and weights of each order, at 2 * order and 2 * order + 1."""
    below = np.full(1, 1.0 / CLASSES)
    for order in range(1, ORDER + 1):
        weight = np.ones(1 << (BITS * (order - 1)))
        weight[tables[2 * order + 1][0]] = tables[2 * order + 1][1]
        gram = np.arange(1 << (BITS * order))
        here = weight[gram >> BITS] * below[gram & ((1 << (BITS * (order - 1))) - 1)]
        here[tables[2 * order][0]] = tables[2 * order][1]
        below = here
    return np.log(below).astype(np.float32)


def _tables(model: DataFrame, langs: list[str]) -> dict[str, bytes]:
    """The languages' tables, compressed, each filled in a task of its own, whose rows are bounded by the alphabet; 4 MB each before that come to the driver."""

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*[[b.column(c).to_numpy() for c in ("order", "gram", "p")] for b in batches], strict=True)]
        order, gram, p = columns
        tables = [(gram[at].astype(np.int64), np.abs(p[at])) for o in range(ORDER + 1) for sign in (False, True) for at in (np.flatnonzero((order == o) & ((p < 0) == sign)),)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([zstandard.compress(_filled(tables).tobytes(), 1)], pa.binary())], ["lang", "packed"])

    rows = model.where(F.col("lang").isin(langs)).groupBy("lang").applyInArrow(fill, "lang string, packed binary").collect()
    return {r["lang"]: bytes(r["packed"]) for r in rows}


def based(texts: DataFrame) -> DataFrame:
    """For each row of texts packed with letter models its letters, its words and the logarithm of the probability of their spellings by each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            letters, *logs = chunk.sums
            columns = [pa.array(chunk.rows), pa.array(letters.astype(np.int64)), pa.array(chunk.sizes), *[pa.array(x, mask=np.isnan(x)) for x in logs]]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_letters", "_words", "_b0", "_b1", "_b2"])

    return texts.mapInArrow(run, "_row bigint, _letters bigint, _words bigint, _b0 double, _b1 double, _b2 double")


def _spread(letters: Column) -> Column:
    """How much wider than that of long texts the perplexities of texts of so many letters spread."""
    return F.sqrt(1 + F.try_divide(F.lit(float(SHORT)), letters))


def limits(held: DataFrame) -> DataFrame:
    """(_lang, _middle, _above) from perplexities (_lang, _perplexity, _letters) of texts that the model hasn't seen.

    Of logarithms, brought to the spread of long texts: their median, and FENCE times the distance of the quantile
    QUANTILE from it. They are counted in bins first, so a language's texts needn't meet in one task.
    """
    log = F.ln("_perplexity")
    bins = lambda x: F.floor(x / STEP)

    def quantile(rows: DataFrame, value: Column, share: float) -> DataFrame:
        counted = rows.groupBy("_lang", bins(value).alias("_bin")).agg(F.count("*").alias("_n"))
        upto = Window.partitionBy("_lang").orderBy("_bin")  # bins of a language, not its texts
        ranked = counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_lang")))
        return ranked.groupBy("_lang").agg(F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col("_bin"))).alias("_q"))

    middle = quantile(held, log, 0.5).select("_lang", ((F.col("_q") + 0.5) * STEP).alias("_middle"))
    apart = held.join(_small(middle), "_lang")
    high = quantile(apart, (log - F.col("_middle")) / _spread(F.col("_letters")), QUANTILE)
    return middle.join(high, "_lang").select("_lang", "_middle", ((F.col("_q") + 1) * STEP * FENCE).alias("_above"))


def _small(languages: DataFrame) -> DataFrame:
    """A table of a row a language, made local and broadcast if it has at most FEW_LANGUAGES rows."""
    rows = languages.limit(FEW_LANGUAGES + 1).collect()
    return F.broadcast(languages.sparkSession.createDataFrame(rows, languages.schema)) if len(rows) <= FEW_LANGUAGES else languages


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", space: Workspace | None = None, with_rows: bool = False) -> DataFrame:
    """(key, language, perplexity, threshold, rejected) and, if asked for, row_id, one row per input row.

    Trusted are documents labelled of quality 1 and not toxic in any row of
    ``labels``. They are dealt into two halves; the perplexities of each half under the
    other's model give the language's limits, and the model of both judges all
    documents. ``threshold`` is the limit for a text of this length. A null language
    is a language of its own. Documents without text, and those of languages with
    hardly any trusted text, have no perplexity or threshold and are kept. Repeated rows are judged alike; an empty table has no rows; without
    trusted documents nothing is rejected; null keys aren't trusted. Keys are of any type.
    """
    space = space or Workspace(docs.sparkSession, "quality")
    with cleaning(docs.sparkSession):
        return _judged(docs, labels, key, text, lang, space, with_rows)


def _judged(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, space: Workspace, with_rows: bool) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"))
    trusted = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    trusted = space.table(trusted.select("_key", F.xxhash64("_key").alias("_id")), "trusted")
    half = F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int")  # equal texts are in one half
    rows = rows.withColumns({"_row": F.xxhash64("_key", "_text", "_lang"), "_half": half})
    tasks = lambda size: max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // COUNTED_BYTES))
    texts = space.table(packed(_trusted(rows, trusted)), "texts")
    # a task's counts hardly grow after some texts, so tasks of COUNTED_BYTES shuffle much less than small ones
    texts = texts.coalesce(tasks(space.bytes("texts")))
    halves = space.table(packed_counts(texts), "halves")
    whole = halves.groupBy(F.substring_index("lang", HALF, 1).alias("lang"), "gram").agg(F.sum("c").alias("c"))
    enough = whole.groupBy("lang").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_GRAMS)
    langs = sorted(r["lang"] for r in enough.select("lang").collect())
    numbers = {x: i for i, x in enumerate(langs)}
    letters = train(halves.unionByName(whole), space)
    space.drop("halves", "counts")
    found = rows.select("_key", "_row", "_half", "_lang")
    groups = {at: {x: numbers[x] for x in langs[at : at + MOST_LANGUAGES]} for at in range(0, len(langs), MOST_LANGUAGES)}
    spread = lambda some: docs.sparkSession.sparkContext.broadcast(_tables(letters, [x + s for x in some for s in SUFFIXES]))  # noqa: E731  of fixed size for each of MOST_LANGUAGES at most
    known = []
    for at, some in groups.items():
        tables = spread(some)
        known.append(space.table(words_of(texts.where(F.arrays_overlap("langs", F.array(*[F.lit(x) for x in some]))), some, tables, SUFFIXES), f"known-{at}"))
        tables.destroy()
    if not known:
        judged_ = found.withColumns({"_perplexity": F.lit(None).cast("double"), "_limit": F.lit(None).cast("double"), "_gone": F.lit(False)})
    else:
        model = Model(texts, union(known), numbers, discounts(), space)
        space.drop("texts", *[f"known-{at}" for at in groups])
        chunked = []
        for at, some in groups.items():  # documents of languages without a model aren't read by Python
            tables = spread(some)
            chunked.append(space.table(packed(rows.where(F.col("_lang").isin(list(some))), tables, SUFFIXES), f"packed-{at}"))
            tables.destroy()
        space.drop(*[f"order-{o}" for o in range(1, ORDER + 1)])
        chunked = union(chunked).coalesce(tasks(sum(space.bytes(f"packed-{at}") for at in groups)))
        spelled = space.table(based(chunked), "based")
        words = spelled.agg(F.sum("_words")).first()[0] or 0
        sums = sums_of(chunked, words, model, numbers, space)
        scored = _scored(found, spelled, sums, model, langs)
        scored = space.table(scored, "scored")
        space.drop(*[f"packed-{at}" for at in groups])
        held = scored.join(trusted.select("_key"), "_key", "left_semi").select("_lang", "_letters", F.when(F.col("_half") == 0, F.col("_p1")).otherwise(F.col("_p0")).alias("_perplexity"))
        joined = scored.withColumnRenamed("_p2", "_perplexity").join(_small(limits(held.where("_perplexity is not null"))), "_lang", "left")
        limit = F.exp(F.col("_middle") + F.col("_above") * _spread(F.col("_letters")))
        judged_ = joined.withColumns({"_limit": limit, "_gone": F.coalesce(F.col("_perplexity") > limit, F.lit(False))})
    out = [F.col("_key").alias(key), F.nullif("_lang", F.lit("")).alias("language"), F.round("_perplexity", 4).alias("perplexity"), F.round("_limit", 4).alias("threshold"), F.col("_gone").alias("rejected")]
    out = space.table(judged_.select(*out, *([F.col("_row").alias("row_id")] if with_rows else [])), "judged")
    space.keep("judged")
    return out


def _scored(found: DataFrame, spelled: DataFrame, sums: DataFrame, model: Model, langs: list[str]) -> DataFrame:
    """``found`` with its letters and its perplexity for a letter by each model, _p0 to _p2; null for texts without words or of languages without a model.

    ``spelled`` and ``sums`` are of all rows of a _row, so what is summed is divided by their number.
    """
    number = lambda c, kind: F.lit(None).cast(kind).alias(c)
    own = ["_letters", "_words", "_b0", "_b1", "_b2"]
    each = spelled.select("_row", *own, F.lit(1).alias("n"), *[number(f"s{m}", "double") for m in range(3)])
    added = sums.select("_row", *[number(c, "bigint" if c in own[:2] else "double") for c in own], F.lit(0).alias("n"), "s0", "s1", "s2")
    total = each.unionByName(added).groupBy("_row").agg(*[F.max(c).alias(c) for c in own], F.sum("n").alias("_n"), *[F.sum(f"s{m}").alias(f"s{m}") for m in range(3)])
    shares = [(lang, *[math.log(x) if x else None for x in model.share[i]]) for i, lang in enumerate(langs) if i in model.share]
    table = found.sparkSession.createDataFrame(shares, "_lang string, g0 double, g1 double, g2 double")
    rows = found.join(total, "_row", "left").join(F.broadcast(table) if len(shares) <= FEW_LANGUAGES else table, "_lang", "left")
    some = F.col("_words") > 0
    log = lambda m: F.try_divide(F.col(f"_b{m}") + F.try_divide(f"s{m}", "_n") + F.col("_words") * F.col(f"g{m}"), F.col("_letters"))
    return rows.select(*found.columns, "_letters", *[F.when(some, F.exp(-log(m))).alias(f"_p{m}") for m in range(3)])


def row_id(key: str = "doc_id", text: str = "text", lang: str = "lang") -> Column:
    """The row_id of judged()."""
    return F.xxhash64(key, text, F.coalesce(F.col(lang), F.lit("")))


def _trusted(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The trusted rows; a bit set of fixed size leaves out most others before the join."""
    may_have = membership(trusted, "_id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield batch.filter(pa.array(may_have(batch.column("_id").to_numpy())))

    rows = rows.where(F.col("_key").isNotNull()).withColumn("_id", F.xxhash64("_key"))
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(pick, fields).drop("_id").join(trusted.select("_key"), "_key", "left_semi")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
