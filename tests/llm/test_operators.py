"""The training-data operators against brute force, and on nulls, empties, ties and odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import bpe, exact_search, fingerprints, license_scan, mixing, ngram_join, quality_lm, sharding, suffix_dedup, textkit, token_store

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(n))


BASE = prose(1, 80)
PASSAGE = prose(2, 60)
TEXTS = {
    1: BASE,
    2: BASE.upper().replace("É", "é").replace("SS", "ß"),
    3: " ".join(BASE.split()[:-3]) + " x y z",
    4: prose(3, 50) + "\n" + PASSAGE + "\n" + prose(4, 40),
    5: PASSAGE + " " + prose(5, 90),
    6: None,
    7: "",
    8: " \t\n",
    9: "one two three",
    10: "One TWO three",
    11: "漢字 😀 test's they'll  end \n\n",
    12: prose(6, 4000),
    13: BASE,
    14: "a" * 700,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i == 5 else f"s{i % 2}", None) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# 1


def shingle_set(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_matches_brute_force(docs):
    got = rows_of(ngram_join.join(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(TEXTS)


def test_ngram_join_on_edited_copies(spark):
    r = random.Random(5)
    texts = {}
    for i in range(240):
        words = prose(i % 12, 60).split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        texts[i] = " ".join(words[r.choice([0, 0, 1, 3]) :])
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    got = rows_of(ngram_join.join(df))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == brute_components(texts)


def test_ngram_join_of_nothing_and_of_repeated_rows(spark, none):
    assert ngram_join.join(none).collect() == []
    twice = spark.createDataFrame([(3, BASE), (3, BASE), (None, BASE), (4, None)], "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(twice).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (4, 4)], key=str)


def test_ngram_join_links_through_texts_without_a_key(spark):
    def changed(text, *at):
        words = text.split()
        for i in at:
            words[i] = f"w{i}"
        return " ".join(words)

    rows, want = [], []
    for n in range(12):
        base = prose(700 + n, 80)
        # the first and the last are similar to the one between alone
        rows += [(10 * n + 1, base), (None, changed(base, 20, 40)), (10 * n + 2, changed(base, 20, 40, 10, 60))]
        want += [(10 * n + 1, 10 * n + 1), (None, 10 * n + 1), (10 * n + 2, 10 * n + 1)]
        lone = prose(800 + n, 80)
        rows += [(None, lone), (None, lone), (None, changed(lone, 30))]
        want += [(None, None)] * 3
    got = [(r.doc_id, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ngram_join_of_long_lists_and_small_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    monkeypatch.setattr(ngram_join, "SHINGLES_A_CELL", 100)
    monkeypatch.setattr(ngram_join, "QUERIES_A_CELL", 4)
    r, texts, passage = random.Random(8), {}, prose(99, 30)
    for i in range(60):
        words = f"{passage} {prose(100 + i % 4, 45 - 20 * (i % 3 == 0))}".split()
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS).repartition(2)
    got = rows_of(ngram_join.join(df))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == brute_components(texts)


def test_ngram_join_tells_rows_of_one_key_apart(spark):
    other = prose(77, 60)
    df = spark.createDataFrame([(1, BASE), (1, other), (2, other + " end"), (2, BASE + " end"), (None, BASE)], "doc_id long, text string").selectExpr("*", "7 AS sid", "'x' AS rid", "1 AS n")
    got = sorted(((r.doc_id, r.component_id, r.row_id == r.first_row) for r in ngram_join.join(df, with_rows=True).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (None, 1, False)], key=str)


def test_shingles_do_not_cross_rows():
    sets = textkit.shingles(*textkit.utf8_of(pa.array(["a b c d e", "f a b c d e", None, "a b"])))
    assert [len(s) for s in sets] == [1, 2, 0, 1] and set(sets[0]) < set(sets[1])


# 2


def test_token_store_round_trip(docs, tmp_path):
    from tokenizers import Tokenizer

    config = token_store.configuration()
    folder = f"file://{tmp_path}/ids"
    manifest = token_store.store(docs, config, 1, folder).cache()
    got = rows_of(token_store.read_back(manifest, folder))
    tok, start = Tokenizer.from_str(config), 0
    for i in sorted(TEXTS):
        ids = [*tok.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)


def test_word_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    config = token_store.configuration()
    tok, made, r = Tokenizer.from_str(config), token_store.WordEncoder(config), random.Random(3)
    alphabet = "abzAZéÉßİΣσ'.,!<|>-_09१  \t\n ́漢😀sl"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> x<|startoftext|>", "they'll I'd can't"]
    for t in texts:
        assert made.text(t) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_encoder_splits_at_the_tokenizers_white_space_only():
    from tokenizers import Tokenizer

    config = token_store.configuration()
    tok, made, r = Tokenizer.from_str(config), token_store.WordEncoder(config), random.Random(4)
    odd = [chr(c) for c in [*range(0x20), *range(0x7F, 0xA1), 0xAD, 0x180E, 0x200B, 0xFEFF]] + [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{c}b" for c in odd] + [c for c in odd] + ["hello\x1fworld"] + ["".join(r.choice(["ab", "Z", "é", " ", "!", "漢", r.choice(odd)]) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        assert made.text(t) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_open_only_the_frames_asked_for(tmp_path):
    import pyarrow.fs as pafs

    fs, path = pafs.LocalFileSystem(), str(tmp_path / "one.zst")
    documents = [list(range(n)) for n in (5, 0, 40_000, 40_000, 150_000, 7)]
    with fs.open_output_stream(path, compression=None) as out:
        writer = token_store.FrameWriter(out)
        for i, ids in enumerate(documents):
            writer.add(i, ids)
        writer.close()
    with fs.open_input_file(path) as source:
        reader = token_store.FrameReader(source)
        assert reader.ids(2).tolist() == documents[2] and reader.opened == 1
        assert [reader.ids(i).tolist() for i in range(6)] == documents
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 1
    open(path, "wb").write(raw)
    with fs.open_input_file(path) as source, pytest.raises(Exception):
        token_store.FrameReader(source).ids(0)


def test_token_store_of_null_and_repeated_keys(spark, tmp_path):
    df = spark.createDataFrame([(2, "b b"), (None, "a"), (1, None), (None, None), (1, "c")], "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS n_tokens")
    folder = f"file://{tmp_path}/ids"
    manifest = spark.createDataFrame(token_store.store(df, token_store.configuration(), 1, folder).collect(), "file string, low long, high long, docs long, ids long")
    got = sorted(token_store.read_back(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2] and [r.n_tokens for r in got] == [1, 2, 1, 2, 3]
    assert [r.start for r in got] == [0, 1, 3, 4, 6]


def test_token_store_of_nothing(none, tmp_path):
    folder = f"file://{tmp_path}/ids"
    assert token_store.read_back(token_store.store(none, token_store.configuration(), 1, folder), folder).collect() == []


# 3


def test_sharding_law_and_slots(spark, docs, none):
    many = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "1 AS shard", "2 AS slot")
    got = sharding.assign(many, dict.fromkeys(range(40), 1.0), dict.fromkeys(range(41), 1.0)).toPandas()
    moved = got[got.grown_shard != got["shard"]]
    assert set(moved.grown_shard) == {40} and 30 < len(moved) < 130
    assert got.groupby("shard").size().between(40, 115).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    small = rows_of(sharding.assign(docs, {0: 1.0}, {0: 1.0, 1: 1.0}))
    for i, t in TEXTS.items():
        raw = (t or "").encode()
        assert (small[i]["size"], small[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.assign(none, {0: 1.0}, {0: 1.0}).collect() == []


def test_sharding_follows_weights_and_the_hash(spark):
    import math

    import xxhash

    weights = {0: 1.0, 1: 3.0, 2: 0.0}
    got = rows_of(spark.range(2000).select("id", sharding.shard_of(F.col("id"), weights).alias("shard")), "id")
    for i in range(2000):
        score = {s: -w / math.log(((xxhash.xxh64_intdigest(f"{i}:{s}", seed=42) >> 12) + 0.5) / 2**52) for s, w in weights.items() if w}
        assert got[i]["shard"] == max(score, key=score.get)
    assert 400 < sum(r["shard"] == 0 for r in got.values()) < 600
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), {1: 0})


# 4


def test_kneser_ney_probabilities_add_up(spark, docs, tmp_path):
    from brindle.llm.common import Workspace

    top = quality_lm.counts(docs.where("doc_id in (1, 4, 12)").fillna("en"), "text", "lang")
    tables = quality_lm.dense([tuple(r) for r in quality_lm.train(top, Workspace(spark, "t")).collect()])
    p = np.exp(tables["en"].astype(np.float64)).reshape(-1, quality_lm.CLASSES).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)


def test_counts_are_those_of_a_plain_count(docs):
    got = {r.gram: r.c for r in quality_lm.counts(docs.where("doc_id = 11"), "text", "lang").collect()}
    data, offsets = textkit.utf8_of(pa.array([TEXTS[11]]))
    kinds = [int(k) for k in quality_lm.class_table()[[ord(c) for c in TEXTS[11]]]]
    want = {}
    for i in range(len(kinds)):
        gram = 0
        for k in [0, 0, 0, *kinds][i : i + 4]:
            gram = gram << 5 | k
        want[gram] = want.get(gram, 0) + 1
    assert got == want


def test_quality_keeps_prose_and_rejects_noise(spark):
    r = random.Random(8)
    words = ["the", "water", "stone", "runs", "under", "bridge", "and", "light", "over", "hill"]
    good = [(i, " ".join(r.choice(words) for _ in range(120)) + ".", "en", "s", 0) for i in range(200)]
    bad = [(1000 + i, "".join(r.choice("#$%&*XQZ!") for _ in range(300)), "en", "s", 0) for i in range(20)]
    odd = [(2000, None, "en", None, None), (2001, "", None, None, None), (2002, "the water", "xx", "s", 0)]
    df = spark.createDataFrame(good + bad + odd, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_lm.judged(df, labels))
    assert len(got) == 223 and not any(got[i]["rejected"] for i in range(200)) and all(got[1000 + i]["rejected"] for i in range(20))
    assert not any(got[i]["rejected"] for i in (2000, 2001, 2002)) and got[2002]["perplexity"] is None


def test_quality_judges_other_scripts_by_their_letters(spark):
    r, rows, labels = random.Random(13), [], []
    scripts = {"ru": (0x430, 32, 5), "el": (0x3B1, 25, 5), "ar": (0x627, 20, 4), "hi": (0x915, 37, 4), "zh": (0x4E00, 20_000, 2), "ko": (0xAC00, 11_172, 2)}
    for n, (lang, (first, size, length)) in enumerate(scripts.items()):
        letter = lambda: chr(first + r.randrange(size))
        words = ["".join(letter() for _ in range(length)) for _ in range(40)]
        for i in range(60):
            rows.append((n * 1000 + i, " ".join(r.choice(words) for _ in range(100)), lang, "s", 0))
            labels += [(n * 1000 + i, 1, 0)] if i % 2 else []
        rows += [(n * 1000 + 900 + i, " ".join("".join(letter() for _ in range(length)) for _ in range(100)), lang, "s", 0) for i in range(10)]
    got = rows_of(quality_lm.judged(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {i for i, x in got.items() if x["rejected"]} == {i for i in got if i % 1000 >= 900}


def test_quality_judges_every_language(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "MOST_LANGUAGES", 2)
    r = random.Random(14)
    words = ["the", "water", "stone", "runs", "under", "bridge", "and", "light", "over", "hill"]
    langs = ["a", "b", "c", "d", None]
    rows = [(n * 1000 + i, " ".join(r.choice(words) for _ in range(120)), lang, "s", 0) for n, lang in enumerate(langs) for i in range(10 + n)]
    rows += [(n * 1000 + 900, "".join(r.choice("#$%&*XQZ!") for _ in range(300)), lang, "s", 0) for n, lang in enumerate(langs)] + [(9000, "the water", "untrusted", "s", 0)]
    labels = spark.createDataFrame([(x[0], 1, 0) for x in rows if x[0] % 1000 < 900 and x[0] != 9000], "doc_id long, quality int, toxic int")
    got = rows_of(quality_lm.judged(spark.createDataFrame(rows, DOCS), labels))
    assert len(got) == len(rows) and {i for i, x in got.items() if x["rejected"]} == {n * 1000 + 900 for n in range(5)}
    assert got[9000]["perplexity"] is None


def test_quality_without_rows_or_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_lm.judged(none, labels).collect() == []
    got = quality_lm.judged(docs, labels).collect()
    assert len(got) == len(TEXTS) and not any(r.rejected for r in got)


def plain_word_model(texts, logs):
    """The logarithm of a text's probability by pairs of words, counted in dictionaries, words without a context resting on their spelling."""
    from collections import Counter

    def cuts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        return [0, *[max(0.05, min(k - 0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and n[1] + 2 * n[2] else max(0.05, min(k - 0.05, k * 0.5)) for k in (1, 2, 3)]]

    def words(text):
        return re.findall(r"[a-z]+|[.]", text)

    def spelled(word):
        code, total = 0, 0.0
        for k in [29 if x == "." else ord(x) - 96 for x in word] + [0]:
            code = (code << 5 | k) & (1 << 20) - 1
            total += float(logs[code])
        return np.exp(total)

    pairs = Counter(p for t in texts for p in zip(["<", *words(t)], [*words(t), ""]))
    left = Counter(w for _, w in pairs)
    d, e = cuts(pairs.values()), cuts(left.values())
    share = sum(e[min(c, 3)] for c in left.values()) / sum(left.values())
    alone = lambda w: (left[w] - e[min(left[w], 3)]) / sum(left.values()) + share * spelled(w)
    begun, kept = Counter(), Counter()
    for (v, _), c in pairs.items():
        begun[v] += c
        kept[v] += d[min(c, 3)]

    def log(text):
        total = 0.0
        for p in zip(["<", *words(text)], [*words(text), ""]):
            p1 = alone(p[1])
            total += np.log((pairs[p] - d[min(pairs[p], 3)] + kept[p[0]] * p1) / begun[p[0]] if begun[p[0]] else p1)
        return total, sum(len(w) + 1 for w in words(text)) + 1

    return log


@pytest.mark.parametrize(("often", "part"), [(1_000, 1 << 20), (3, 100)])
def test_perplexity_is_that_of_a_plain_model_of_words(spark, monkeypatch, often, part):
    from brindle.llm import word_lm
    from brindle.llm.common import Workspace

    monkeypatch.setattr(word_lm, "OFTEN", often)
    monkeypatch.setattr(word_lm, "PASSES", 2)
    r = random.Random(21)
    some = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(some[min(int(r.expovariate(0.1)), 59)] for _ in range(50)) + ".", "en", "s", 0) for i in range(16)]
    rows += [(100, " ".join(sorted(rows[0][1][:-1].split())), "en", "s", 0), (101, "zzz qqq xxx", "en", "s", 0), (102, "abc " * 30, "en", "s", 0), *[(103, rows[3][1], "en", "s", 0)] * 2]
    monkeypatch.setattr(word_lm, "PART", part)
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    got = quality_lm.judged(df, labels).collect()
    top = quality_lm.counts(df.where("doc_id < 16"), "text", "lang", words=True)
    logs = quality_lm.dense([tuple(x) for x in quality_lm.train(top, Workspace(spark, "t")).collect()])["en"]
    log = plain_word_model([t for i, t, *_ in rows if i < 16], logs)
    want = {i: np.exp(-log(t)[0] / log(t)[1]) for i, t, *_ in rows}
    assert len(got) == len(rows) and all(abs(x.perplexity - want[x.doc_id]) < 1e-3 * want[x.doc_id] for x in got)
    assert want[100] > 1.1 * want[0]  # the same words in another order


def test_packed_texts_are_read_back_slice_by_slice(monkeypatch):
    from brindle.llm import word_lm

    monkeypatch.setattr(word_lm, "SLICE", 7)
    texts = ["a bb a. CC dd", None, "", "bb bb bb bb bb bb bb bb bb bb", "q", "  ", "zz a"]
    columns = {"_row": range(7), "_lang": ["x", "x", "y", "y", "x", "y", "y"], "_half": [0, 1] * 3 + [0], "_text": texts, "_salt": [5, 5, 6, 6, 5, 6, 6]}
    batch = pa.RecordBatch.from_pydict({c: pa.array(list(v), pa.string() if c in ("_lang", "_text") else pa.int64()) for c, v in columns.items()})
    held, want = word_lm._Packer(), {}
    for part in word_lm.read(iter([batch]), True):
        held.add(part)
        want |= {i: part.last[part.rows[i] : part.rows[i + 1]].tolist() for i in range(7) if part.size[i]}
    (chunk,) = word_lm.chunks(iter([held.chunk(None, None)]))
    got, before = {}, {}
    for rows, words in chunk.slices:
        v, w = word_lm._pairs(chunk, rows, words, chunk.hashes, chunk.begins)
        first = words.start
        for i in range(rows.start, rows.stop):
            at = slice(int(chunk.starts[i]) - first, int(chunk.starts[i] + chunk.sizes[i]) - first)
            got[int(chunk.rows[i])], before[int(chunk.rows[i])] = w[at].tolist(), v[at].tolist()
            assert before[int(chunk.rows[i])] == [int(chunk.begins[i]), *w[at][:-1].tolist()]
    assert got == want and len(chunk.hashes) < len(chunk.ids) and len(list(chunk.slices)) > 1


# 5


def brute_top(vectors, k):
    good = [(i, np.floor(64 * np.array(v, np.float64))) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted(((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_exact_search_matches_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(size=8).round(1).tolist()) for i in range(600)]
    vectors += [(600, None), (620, [1.0, None] + [0.0] * 6), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (680, [0.0] * 8), (700, [1.0, 2.0]), (701, [3.0, 4.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = sorted(tuple(x) for x in exact_search.search(df, lambda c: c % 20 == 0).collect())
    assert got == brute_top(f32, 20)


def test_m_tree_prunes_and_stays_exact():
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16)) * 300
    rows = np.floor(centres[r.integers(12, size=5000)] + r.normal(size=(5000, 16)) * 8)
    most = float((rows * rows).sum(axis=1).max())
    tree = exact_search.Cell(np.arange(5000), rows, most)
    queries = rows[:40]
    for i, (ids, scores) in enumerate(tree.search(np.arange(40), queries, np.full(40, -np.inf), 5)):
        exact = rows @ queries[i]
        exact[i] = -np.inf
        best = np.lexsort((np.arange(5000), -exact))[:5]
        order = np.lexsort((ids, -scores))
        assert ids[order].tolist() == best.tolist()
    assert tree.computed < 0.7 * 40 * 5000


def test_exact_search_goes_down_several_levels(spark, monkeypatch):
    for name, value in (("ROWS_A_CELL", 30), ("ROWS_A_SUBTREE", 200), ("FAN", 4), ("SAMPLE_A_NODE", 20), ("ROWS_A_DEAL", 64), ("QUERIES_A_CELL", 8)):
        monkeypatch.setattr(exact_search, name, value)
    g = np.random.default_rng(6)
    centers = g.normal(size=(12, 6)) * 4
    vectors = {i: (centers[i % 12] + g.normal(size=6) * 0.2).tolist() for i in range(1500)}
    vectors |= {2000 + i: [1.0] * 6 for i in range(70)}  # no routing object tells these apart
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in exact_search.search(df, lambda c: c % 20 == 0, k=7).collect())
    assert got == brute_top(list(vectors.items()), 7)


def test_exact_search_of_repeated_rows_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    from brindle.llm.catalogue import OP5_SQL

    g = np.random.default_rng(8)
    rows = [(i % 90, g.normal(size=4).astype(float).tolist()) for i in range(90)]
    rows += [(3, rows[3][1])] * 2 + [(7, rows[7][1]), (50, None), (51, [1.0, None, 2.0, 3.0]), (52, [float("nan")] * 4), (53, [float("inf"), 0.0, 0.0, 0.0]), (3, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({OP5_SQL})").fetchall()
    got = exact_search.search(df, lambda c: c % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_exact_search_of_nothing(spark):
    assert exact_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c % 20 == 0).collect() == []


# 6


def test_pfair_pattern_stays_within_a_block():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"x": 9, "y": 1}):
        share = mixing.shares(weights, 240)
        assert sum(share.values()) == 240
        order, had = mixing.pattern(share, 240), dict.fromkeys(share, 0)
        for t, s in enumerate(order, 1):
            had[s] += 1
            assert all(abs(had[x] - share[x] * t / 240) < 1 for x in share)
        assert had == share


def test_phases_place_every_block_once():
    blocks = {"a": 400, "b": 33, "c": 1, "d": 0, "e": 57}
    slots = []
    for p in mixing.phases(blocks, {"a": 3, "b": 1, "c": 1, "d": 1, "e": 2}):
        slots += [p.slot + (b - p.first) // p.share * p.period + p.places[(b - p.first) % p.share] for b in range(p.first, p.end)]
    assert sorted(slots) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("weights", [{"a": 0.999, "b": 0.001}, {"big": (1 / 3 * 1e7) ** 0.5, **{f"s{i}": (2 / 57 * 1e7) ** 0.5 for i in range(19)}}])
def test_mixing_stays_within_a_block_of_the_weights(spark, monkeypatch, weights):
    whole = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    blocks, had = {s: int(30_000 * w) + 9 for s, w in whole.items()}, dict.fromkeys(weights, 0)
    order = {p.slot + at: p.source for p in mixing.phases(blocks, weights) if p.number == 0 for at in p.places}
    assert len(order) > 25_000 and sorted(order) == list(range(len(order)))
    for t in range(len(order)):
        had[order[t]] += 1
        assert abs(had[order[t]] - whole[order[t]] * (t + 1)) < 1
        if t % 500 == 0 or t == len(order) - 1:
            assert all(abs(had[s] - whole[s] * (t + 1)) < 1 for s in had)
    # release and deadline follow from the weights too, over pieces of any size
    monkeypatch.setattr(mixing, "PIECE", 100)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in blocks.items() for _ in range(n // 30 + 1))], "doc_id long, source string")
    for r in mixing.scheduled(rows, weights, block_rows=1).where("phase = 0").collect():
        assert r.release == r.block / whole[r.source] // 1 and r.deadline == -(-(r.block + 1) / whole[r.source] // 1) and r.release <= r.slot < r.deadline


def test_pieces_of_any_size_give_the_same_schedule():
    blocks, weights = {"a": 400, "b": 33, "c": 1, "e": 57}, {"a": 3.3, "b": 1, "c": 1e-9, "e": 2}
    placed = [{(p.source, p.first + i): (p.number, p.slot + at) for piece in mixing.cut(blocks, weights, size) for p in mixing.placed(piece) for i, at in enumerate(p.places)} for size in (1, 7, 10**6)]
    assert placed[0] == placed[1] == placed[2] and len(placed[0]) == 491


def test_mixing_keeps_all_rows_in_slots(spark, docs, none):
    many = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 5) END AS source", "0 AS slot", "0 AS block")
    got = mixing.scheduled(many, {"hot": 1, "s0": 1, None: 1}, block_rows=8).toPandas()
    assert sorted(got.doc_id) == list(range(4000)) and got.position.is_unique
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    blocks = got.fillna("none").groupby(["source", "block"]).slot.nunique()
    assert (blocks == 1).all() and sorted(got.slot.unique()) == list(range(got.slot.nunique()))
    assert len(mixing.scheduled(docs).collect()) == len(TEXTS) and mixing.scheduled(none).collect() == []


# 7


def test_license_scan_finds_spans(spark, none):
    grant = license_scan.TEMPLATES["MIT-grant"]
    texts = {1: "x y\nReleased under the MIT License.", 2: f"é {grant.upper()} end", 3: grant.replace("free of charge", "gratis") + " released UNDER the mit\nlicense!", 4: "no license at all, released under nothing", 5: None, 6: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'z' AS license")
    got = sorted((r.doc_id, r.license, r.coverage, texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()) for r in license_scan.scan(df).collect())
    assert [(g[0], g[1]) for g in got] == [(1, "MIT"), (2, "MIT-grant"), (3, "MIT"), (3, "MIT-grant")]
    assert got[0][3] == "Released under the MIT License" and got[2][3] == "released UNDER the mit\nlicense" and got[1][2] == 1.0 and 0.9 < got[3][2] < 1
    assert license_scan.scan(none).collect() == []


def test_license_scan_finds_each_template_anywhere(spark):
    r, texts = random.Random(12), []
    filler = lambda n: " ".join("".join(r.choice("bcdfg") for _ in range(6)) for _ in range(n))
    for name, template in license_scan.TEMPLATES.items():
        for _ in range(8):
            texts += [(name, template, f"{template} {filler(5)}"), (name, template, f"{filler(4)} {template} {filler(4)}"), (name, template, f"{filler(5)} {template}"), (name, template, template)]
    df = spark.createDataFrame([(i, t[2]) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(x.doc_id, x.license): x for x in license_scan.scan(df).collect()}
    for i, (name, template, text) in enumerate(texts):
        x = got[i, name]
        assert x.coverage == 1 and text.encode()[x.start_byte : x.end_byte].decode() in template


def test_license_scan_of_short_templates_with_a_word_replaced():
    # three words in a row are left, so winnowing may keep none of their strings
    index = license_scan.Index({"MIT": license_scan.TEMPLATES["MIT"]})
    for i in range(50):
        found = list(index.scan(*textkit.utf8_of(pa.array([f"x{i} released under the w{i} license y{i}"]))))
        assert [(f[1], f[2], f[3]) for f in found] == [("MIT", 4, 5)]


def test_banded_alignment_is_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randint(1, 8))], [r.randrange(5) for _ in range(r.randint(1, 8))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        matched, first, end = license_scan.align(np.array(a), np.array(b), np.array([0, 0]), np.array([0, 0]), np.array([len(b), 1]), 9)
        assert matched[0] == table[-1][-1] and matched[1] == (b[0] in a)
        if matched[0]:
            rest = iter(b[first[0] : end[0]])
            assert b[first[0]] in a and sum(x in rest for x in a) <= matched[0] <= end[0] - first[0]


def plain_words(text):
    return [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def test_license_scan_misses_no_notice_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {}
    for r in license_scan.scan(docs).collect():
        got.setdefault((r.doc_id, r.license), []).append(r.coverage)
    seen = 0
    for d in docs.collect():
        words = plain_words(d.text)
        for name, template in license_scan.TEMPLATES.items():
            t = plain_words(template)
            times = sum(words[i : i + len(t)] == t for i in range(len(words)))
            seen += times
            assert got.get((d.doc_id, name), []).count(1.0) >= times
    assert seen > 20


def test_license_scan_gives_every_place_and_any_replaced_word(spark):
    scan = lambda text: [(f[1], text.encode()[f[4] : f[5]].decode()) for f in license_scan.Index(license_scan.TEMPLATES).scan(*textkit.utf8_of(pa.array([text])))]
    mit, rights = "Released under the MIT License", "All rights reserved"
    assert scan(f"{mit}. {mit}.") == [("MIT", mit)] * 2
    assert scan(f"{rights}. " * 40) == [("All-rights-reserved", rights)] * 40
    assert [n for n, _ in scan(f"{rights}. {mit}. a {rights}")] == ["All-rights-reserved"] * 2 + ["MIT"]
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        for i in range(len(words)):
            if len(plain_words(template)) >= 5 and plain_words(words[i]):
                changed = " ".join([*words[:i], "zzz", *words[i + 1 :]])
                assert name in [n for n, _ in scan(f"b c d {changed} e f g")] or len(plain_words(words[i])) > 1
    assert list(license_scan.Index({"one": "alpha", "two": "alpha beta", "none": "..."}).scan(*textkit.utf8_of(pa.array(["x alpha beta"])))) == [(0, "one", 1, 1, 2, 7), (0, "two", 2, 2, 2, 12)]


# 8


def test_long_texts_are_taken_in_parts(monkeypatch):
    r = random.Random(31)
    text = " ".join(r.choice(["ab", "cde", "f" * 150, "é", "same words again and again " * 6]) for _ in range(900))
    data, offsets = textkit.utf8_of(pa.array([text]))
    starts, ends, _ = textkit.words_of(data, offsets)
    plain, whole = suffix_dedup._anchors(data, offsets), textkit.hash_ranges(data, starts, ends)
    edges = np.array([0, 0, 5, 900]), np.array([len(data), 1, 4000, 901])
    far = textkit.hash_ranges(data, *edges)
    monkeypatch.setattr(textkit, "NEAR", 100)
    monkeypatch.setattr(textkit, "_POWERS", [])
    assert (textkit.hash_ranges(data, starts, ends) == whole).all() and (textkit.hash_ranges(data, *edges) == far).all()
    for part in (1, 7, 300, 5000):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        got = suffix_dedup.anchors(data, offsets)
        assert all((a == b).all() for a, b in zip(got, plain, strict=True))


def test_suffix_dedup_of_copies_in_one_batch_and_clashing_columns(spark):
    r = random.Random(33)
    passage = "".join(r.choice("abcdef ") for _ in range(450))
    texts = {i: "".join(r.choice("ghijk ") for _ in range(60 + i)) + passage[(i % 3) * 40 :] + "".join(r.choice("lmno ") for _ in range(30)) for i in range(40)}
    texts |= {100 + i: texts[3] for i in range(5)} | {200: "z" * 199, 201: "y" * 900, 202: None}
    for parts in (1, 5):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS rid", "'t' AS tag", "2 AS anchor", "3 AS `a.b`", "array(struct(1 AS start)) AS cuts")
        assert cut_rows(df) == brute_cut(texts.items())
        kept = suffix_dedup.removed(df, keep_text=True)
        assert kept.columns == df.columns and kept.where("tag = 't' AND rid = 1 AND `a.b` = 3").count() == len(texts)


def brute_cut(texts):
    raw = {i: (t or "").encode() for i, t in texts}
    seen = {}
    for n, b in raw.items():
        for p in range(len(b) - 199):
            seen.setdefault(b[p : p + 200], []).append((n, p))
    marks = {n: bytearray(len(b)) for n, b in raw.items()}
    for places in seen.values():
        if len(places) > 1:
            for n, p in places:
                marks[n][p : p + 200] = b"\1" * 200
    out = {}
    for n, b in raw.items():
        m = marks[n]
        runs = sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1]))
        out[n] = (len(b), sum(m), runs, hashlib.sha256(bytes(c for c, f in zip(b, m) if not f)).hexdigest())
    return out


def cut_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect()}


def test_suffix_dedup_matches_brute_force(docs):
    assert cut_rows(docs) == brute_cut(TEXTS.items())


@pytest.mark.parametrize("limit", [20_000, 3])
def test_suffix_dedup_on_shared_passages(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    r, texts = random.Random(11), {}
    passages = [prose(50 + i, n) for i, n in enumerate((30, 45, 70, 200))]
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            cut = r.randrange(len(p) // 2)
            parts += [prose(1000 + r.randrange(10**6), r.randint(0, 25)), p[cut : cut + r.randint(150, len(p))]]
        texts[i] = " ".join(parts)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    assert cut_rows(df) == brute_cut(texts.items())


def test_suffix_dedup_of_repeated_rows_and_nothing(spark, none):
    assert suffix_dedup.removed(none).collect() == []
    twice = spark.createDataFrame([(1, BASE), (1, BASE), (1, PASSAGE), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.removed(twice).collect())
    n = len(BASE.encode())
    assert got == sorted([(1, n, n), (1, n, n), (1, len(PASSAGE.encode()), 0), (2, 5, 0)])
    kept = suffix_dedup.removed(twice, keep_text=True).collect()
    assert sorted(r.text for r in kept) == sorted(["", "", PASSAGE, "short"])


def test_intervals_are_all_repeats_of_a_sorted_part():
    r = random.Random(6)
    for _ in range(100):
        words = sorted("".join(r.choice("ab") for _ in range(6)) for _ in range(r.randint(2, 12)))
        rows = np.array([list(w.encode()) for w in words], dtype=np.uint8)
        got = {(d, i, j) for d, _, i, j in suffix_dedup.intervals(suffix_dedup._common(rows[:-1], rows[1:]), 1)}
        want = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words)):
                d = len(__import__("os").path.commonprefix(words[i : j + 1]))
                wider = (i and words[i - 1][:d] == words[i][:d]) or (j + 1 < len(words) and words[j + 1][:d] == words[i][:d])
                if d and not wider:
                    want.add((d, i, j))
        assert got == want


# 9


def test_fingerprints_of_edits(docs):
    got = rows_of(fingerprints.with_next(docs))
    order = sorted(TEXTS, reverse=True)
    for n, i in enumerate(order):
        text, following = TEXTS[i] or "", TEXTS[order[(n + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[13]["fingerprint"] != got[3]["fingerprint"]
    assert got[12]["near_edited"] > 0.3 > got[12]["near_next"]


def test_fingerprints_are_homomorphic_and_blind_to_order():
    a, b, both, swapped = fingerprints.fingerprints(["x y\n", "p q r\n", "x y\np q r\n", "p q r\nx y\n"])
    assert both == swapped and fingerprints.combined(a[None], b[None])[0] == both
    assert fingerprints.combined(both[None], b[None], -1)[0] == a
    assert fingerprints.read(fingerprints.written(a[None])[0])[0] == a


def test_fingerprints_without_a_final_line_end():
    r, base = random.Random(15), fingerprints.fingerprints
    assert base(["A\nB"])[0] == base(["B\nA"])[0] != base(["A\nB\n"])[0]
    assert fingerprints.combined(base(["A"]), base(["\nB"]))[0] == base(["A\nB"])[0]
    for i in range(40):
        lines = [r.choice(["", " ", "\t"]) + prose(r.randrange(10**6), r.randint(0, 40)) for _ in range(r.randint(1, 6))]
        texts = ["\n".join(lines), "\n".join(reversed(lines)), "\n".join(lines[:-1]), "\n" + lines[-1]]
        # rows of one batch have no influence on each other
        alone = np.concatenate([base([t]) for t in texts])
        assert (base(texts) == alone).all() and alone[0] == alone[1]
        if len(lines) > 1:
            assert fingerprints.combined(alone[2:3], alone[3:])[0] == alone[0] and fingerprints.combined(alone[:1], alone[3:], -1)[0] == alone[2]


def test_fingerprints_of_few_rows(spark, none):
    assert fingerprints.with_next(none).collect() == []
    one = fingerprints.with_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    ties = fingerprints.with_next(spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in ties) == ["5", "5", "5", "None"]


# 10


def test_bpe_agrees_with_the_library(docs, none):
    import public_tokenizers
    import tiktoken

    merger, table = bpe.Merger(bpe.vocabulary()), bpe.class_table()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merger.ranks, special_tokens={})
    r = random.Random(9)
    alphabet = "ab'sS trevlmd  \n\t é1२.!,'ß漢😀ll've\r"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["x" * 3000, "", "'ll", "a'", " 's"]
    got = [ids for ids, _ in bpe.encoded(pa.array(texts), merger, table)]
    assert got == [library.encode_ordinary(t) for t in texts]
    for r_ in bpe.encode(docs, bpe.vocabulary(), with_offsets=True).collect():
        text = TEXTS[r_.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r_.n_tokens == len(ids) and r_.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r_.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r_.offsets[-1] == len(text.encode()) and len(r_.offsets) == len(ids) + 1
    assert bpe.encode(none, bpe.vocabulary()).collect() == []


def test_bpe_of_every_code_point_and_of_parts(monkeypatch):
    import public_tokenizers
    import tiktoken

    merger, table = bpe.Merger(bpe.vocabulary()), bpe.class_table()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merger.ranks, special_tokens={})
    r = random.Random(13)
    texts = ["".join(f"a{chr(c)}1 " for c in range(a, a + 0x400) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 0x400)]
    texts.append("".join("a" + chr(c) for c in range(0x20000, 0x110000, 97)))
    assert [ids for ids, _ in bpe.encoded(pa.array(texts), merger, table)] == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG_TEXT", 20)
    for _ in range(200):
        text = "".join(r.choice(["ab", " ", "  ", "'s", "\n", " \n", "1", "é", ".", " a"]) for _ in range(r.randint(41, 300)))
        ((ids, said),) = bpe.encoded(pa.array([text]), merger, table)
        assert ids == library.encode_ordinary(text) and said == ",".join(map(str, ids)) and "".join(bpe.parts_of(text, table)) == text


def test_transition_functions_compose_associatively():
    element, compose, apply = bpe.transition_monoid()
    n = len(compose)
    r = np.random.default_rng(0)
    a, b, c = r.integers(n, size=(3, 500))
    assert (compose[compose[a, b], c] == compose[a, compose[b, c]]).all()
    assert (apply[compose[a, b], 3] == apply[b, apply[a, 3]]).all()


def test_similarity_bounds_are_the_least_overlap(spark):
    bound = ngram_join._Bound(Fraction(3, 4))
    df = spark.createDataFrame([(m, n) for m in range(1, 40) for n in range(1, 40)], "m long, n long")
    for r in df.select("m", "n", bound.overlap(df.m, df.n).alias("o")).collect():
        assert r.o == next(k for k in range(200) if 4 * k >= 3 * (r.m + r.n - k))
