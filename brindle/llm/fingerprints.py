"""Order-independent document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut into paragraphs at line ends, and long paragraphs further after
words whose own hash says so, so that an edit changes only the parts around it.
Each part is hashed to a wide vector and the vectors of a text are added, modulo
2**32 in the first lanes and 2**16 in the others. So the order of the parts is of
no account, texts with the same parts have the same fingerprint, and a part is
inserted or deleted by one addition or subtraction without the rest of the text.
Line ends belong to no part, so the last paragraph is like any other; each adds a
vector of its own to the first lanes.

The first lanes are uniform words and serve equality. The others are sums of +1
and -1; the mean square of the difference of two such sums estimates how many
parts two texts don't share, which gives their likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .textkit import U64, hash_ranges, mix64, pieces, stream64, utf8_of, words_of

WIDE = 16  # lanes modulo 2**32
SIGNS = 256  # lanes modulo 2**16
#: A paragraph is cut after about one word in so many.
WORDS_A_PART = 16
_EQUAL_SALT = stream64(101, WIDE // 2)
_SIGN_SALT = stream64(102, SIGNS // 64)
_LINE_END = stream64(103, WIDE // 2).view("<u4")
#: number of parts, equality lanes, sign lanes
LAYOUT = np.dtype([("parts", "<u4"), ("wide", "<u4", (WIDE,)), ("signs", "<i2", (SIGNS,))])


def part_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the parts of all rows, for n rows the n + 1 part indexes at which rows begin, and each row's line ends."""
    starts, ends, rows = words_of(data, offsets)
    line_end = data == 0x0A
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    first[np.flatnonzero(line_end) + 1] = True
    # a word never cuts the paragraph after its own
    paragraph = np.cumsum(first)[starts]
    cut = np.flatnonzero(hash_ranges(data, starts, ends) % U64(WORDS_A_PART) == 0) + 1
    cut = cut[cut < len(starts)]
    first[starts[cut[paragraph[cut] == paragraph[cut - 1]]]] = True
    begins = np.flatnonzero(first[:-1])
    stops = np.concatenate([begins[1:], [len(data)]]).astype(np.int64)[: len(begins)]
    stops -= line_end[stops - 1]
    full = stops > begins
    begins, stops = begins[full], stops[full]
    lines = np.concatenate([[0], np.cumsum(line_end)])[offsets]
    return hash_ranges(data, begins, stops), np.searchsorted(begins, offsets), np.diff(lines)


def add_up(hashes: np.ndarray, rows: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The fingerprints, as LAYOUT records, of rows whose parts have the given hashes and that have so many line ends."""
    out = np.zeros(len(rows) - 1, dtype=LAYOUT)
    out["parts"] = np.diff(rows)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        at = rows[full]
        with np.errstate(over="ignore"):
            words = mix64(hashes[:, None] ^ _EQUAL_SALT[None, :])
            out["wide"][full] = np.add.reduceat(words.view("<u4"), at, axis=0, dtype=np.uint32)
            bits = np.unpackbits(mix64(hashes[:, None] ^ _SIGN_SALT[None, :]).view(np.uint8), axis=1)
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            out["signs"][full] = (2 * ones - np.diff(rows)[full][:, None]).astype(np.int16)
    with np.errstate(over="ignore"):
        out["wide"] += lines.astype(np.uint32)[:, None] * _LINE_END[None, :]
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    return add_up(*part_hashes(*utf8_of(pa.array(texts, pa.string()))))


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints after inserting (1) or deleting (-1) the parts of b."""
    out = np.empty_like(a)
    with np.errstate(over="ignore"):
        out["parts"] = a["parts"] + np.uint32(sign & 0xFFFFFFFF) * b["parts"]
        out["wide"] = a["wide"] + np.uint32(sign & 0xFFFFFFFF) * b["wide"]
        out["signs"] = a["signs"] + np.int16(sign) * b["signs"]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair about twice the shared parts over all parts of both, between 0 and 1.

    1 for equal fingerprints, two of empty texts included.
    """
    with np.errstate(over="ignore"):
        gap = (a["signs"] - b["signs"]).astype(np.float64)
    apart = (gap * gap).mean(axis=1)
    both = a["parts"].astype(np.float64) + b["parts"]
    near = np.clip(1 - apart / np.maximum(both, 1), 0, 1)
    return np.where(a == b, 1.0, np.where(both > 0, near, 1.0))


def written(prints: np.ndarray) -> list[str]:
    return [base64.b64encode(p.tobytes()).decode() for p in prints]


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=LAYOUT)


def _ranges(docs: DataFrame, key: str, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Upper ends of ranges of the key with about as many rows each; for the highest key of a range, the range above.

    Both have at most ``parts`` entries. Above the highest range comes the lowest.
    """
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []
    ends = np.unique(np.array(found, dtype=np.int64))
    number = F.pandas_udf(lambda keys: pd.Series(np.searchsorted(ends, keys.to_numpy())), "long")
    tops = sorted(docs.groupBy(number(key).alias("range")).agg(F.max(key)).collect())
    return ends, {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next document, in descending order of key.

    The table is dealt out once by ranges of the key. The first row of a range is
    also sent to the end of the range before, so each row meets its next one in its
    own task and no task holds more than a row of another range. Rows of equal keys
    follow each other in the order of their texts; null texts are empty and come
    last among them; a null key comes after all others. An empty table has no rows,
    and the only row of a table is followed by itself. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ends, above = _ranges(rows.select("_key"), "_key", parts)

    @F.pandas_udf("own long, also long")
    def places(keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"own": np.searchsorted(ends, keys.to_numpy()), "also": [above.get(k, -1) for k in keys.to_list()]})

    dealt = rows.withColumn("_place", places("_key"))
    dealt = dealt.select(
        "_key",
        "_text",
        F.explode(
            F.when(F.col("_place.also") < 0, F.array(F.struct(F.col("_place.own").alias("range"), F.lit(0).alias("tail")))).otherwise(
                F.array(F.struct(F.col("_place.own").alias("range"), F.lit(0).alias("tail")), F.struct(F.col("_place.also").alias("range"), F.lit(1).alias("tail")))
            )
        ).alias("_to"),
    ).select("_key", "_text", "_to.range", "_to.tail")
    ordered = dealt.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "tail", F.desc("_key"), F.desc("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in pieces(batches, "_text"):
            own = add_up(*part_hashes(*utf8_of(batch.column("_text"))))
            keys, texts, tails = (batch.column(c).to_pylist() for c in ("_key", "_text", "tail"))
            if held is not None:
                keys, texts, tails, own = [held[0], *keys], [held[1], *texts], [held[2], *tails], np.concatenate([held[3], own])
            pairs = [i for i in range(len(keys) - 1) if not tails[i]]
            if pairs:
                halves = [len(texts[i]) // 2 for i in pairs]
                edits = [texts[i][: len(texts[i]) - h] + texts[i + 1][:h] for i, h in zip(pairs, halves, strict=True)]
                changed, mine, following = fingerprints(edits), own[pairs], own[[i + 1 for i in pairs]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in pairs], pa.int64()),
                        pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                        pa.array(written(mine)),
                        pa.array(written(changed)),
                        pa.array(likeness(mine, changed)),
                        pa.array(likeness(mine, following)),
                    ],
                    [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            held = (keys[-1], texts[-1], tails[-1], own[-1:])

    schema = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = ordered.mapInArrow(run, schema)
    return done.withColumn(key, F.when(F.col(key) != -(1 << 63), F.col(key)))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(load(spark, sf_dir, "documents"))
