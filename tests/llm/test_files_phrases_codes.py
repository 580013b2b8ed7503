"""Token files, collocations and vector codes against brute force on edge cases."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipper.llm import collocations, tokenfiles, vectorcodes
from dipper.sources.store import new_folder

CUT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_token_files(spark, docs, rows, bpe_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path)
    root = new_folder(spark, "test-tokens")
    tokenfiles.write_tokens(docs, bpe_path, root)
    tokens = tokenfiles.read_tokens(spark, root)
    want = collections.Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    stored = tokens.collect()
    assert collections.Counter((r["id"], tuple(r["ids"])) for r in stored) == want
    # ascending from file to file and in each, nulls first, and starts without gaps
    in_order = sorted(stored, key=lambda r: (r["file"], r["place"]))
    ids = [r["id"] for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and ids[:2] == [None, None]
    found = sorted(map(tuple, tokenfiles.summarize_tokens(tokens, tokenfiles.file_starts(tokens)).collect()), key=lambda r: r[1])
    at = 0
    for r, (i, start, n, crc) in zip(in_order, found, strict=True):
        assert (i, start, n, crc) == (r["id"], at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += n


def scanned(df):
    """Rows that the scan of a plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_token_files_are_pruned(spark, bpe_path):
    docs = spark.range(0, 60_000, 2, numPartitions=4).selectExpr("(id * 7919) % 60000 as doc_id", "concat('text ', id) as text")
    root = new_folder(spark, "test-tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tokenfiles.write_tokens(docs, bpe_path, root, stripe_bytes=64 << 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    read = lambda **k: tokenfiles.read_tokens(spark, root, **k).select("id", "n_tokens")
    assert read().count() == 30_000
    # an odd id lies within the minima and maxima of a row group, so only its Bloom filter can deny it
    assert scanned(read(ids=[5001])) == 0
    assert scanned(read(ids=[5000])) <= 1000 and [r["id"] for r in read(ids=[5000]).collect()] == [5000]
    near = read(least=59_000)
    assert scanned(near) <= 2000 and near.count() == 500
    reader = spark._jvm.org.apache.orc.OrcFile
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/tokens")
    conf = spark._jsc.hadoopConfiguration()
    listed = [f.getPath() for f in files.getFileSystem(conf).listStatus(files) if f.getPath().getName().endswith(".orc")]
    opened = [reader.createReader(p, reader.readerOptions(conf)) for p in listed]
    assert len(opened) == 2 and all(o.getStripes().size() > 1 and o.getRowIndexStride() == 1000 for o in opened)


def test_many_texts_of_one_id_share_out(spark, bpe_path):
    docs = spark.range(3000).selectExpr("7L as doc_id", "concat('text ', id) as text").unionByName(spark.range(3000).selectExpr("8L as doc_id", "'same' as text"))
    root = new_folder(spark, "test-tokens")
    tokenfiles.write_tokens(docs, bpe_path, root)
    per = {r["file"]: r["count"] for r in tokenfiles.read_tokens(spark, root).groupBy("file").count().collect()}
    assert sum(per.values()) == 6000 and len(per) == 8 and max(per.values()) < 3000


def test_empty_tables(spark, empty, bpe_path):
    root = new_folder(spark, "test-tokens")
    tokenfiles.write_tokens(empty, bpe_path, root)
    tokens = tokenfiles.read_tokens(spark, root)
    assert tokenfiles.summarize_tokens(tokens, tokenfiles.file_starts(tokens)).collect() == []
    assert collocations.collocations(empty).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out, books = vectorcodes.compress(none)
    assert out.collect() == [] and books.size == 0


def brute_phrases(texts, min_count, max_words, cover, first):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in CUT.split((text or "").translate(UPPER)):
            words = WORD.findall(piece)
            total[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = collections.Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i : i + n]] = max(covered[p[i : i + n]], a)
        found = []
        for p, a in candidates.items():
            if 100 * covered[p] >= cover * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, total[lang], score) for i, (score, a, p, left, right) in enumerate(found[:first])]
    return sorted(out)


@pytest.mark.parametrize("max_words, salted", [(3, False), (3, True), (5, True), (2, False)])
def test_collocations(spark, docs, rows, monkeypatch, max_words, salted):
    if salted:
        monkeypatch.setattr(collocations, "PIVOT_FRAGMENTS", 3)
    lines = ["a b a b a. b, a b\tA  B", "x x x x x", None, "", " . ; ", "New York city! new york\x0bNEW YORK", "é É ü. z" * 50, "w" * 100_000 + " tail", "  nb  "]
    langs = [None, "und", "en", "", "d e\nf"]
    own = [(t, langs[i % 5]) for i, t in enumerate(lines * 3)]
    texts = [(r[1], r[2]) for r in rows] + own
    df = docs.select("text", "lang", F.lit(1).alias("bucket"), F.lit(1).alias("place"), F.lit("x").alias("words")).unionByName(spark.createDataFrame([(*t, 1, 1, "x") for t in own], "text string, lang string, bucket int, place int, words string"))
    out = collocations.collocations(df, min_count=3, max_words=max_words, first=500).collect()
    want = brute_phrases(texts, 3, max_words, 50, 500)
    assert len(want) > 100 and sorted(map(tuple, out)) == want


def test_scores_are_exact(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", 0, "", 4 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big - 7)], "lang string, words int, phrase string, f long")
    (r,) = collocations.score_phrases(counts).collect()
    assert r["score"] == 1_000_000 * (big - 7) ** 2 // ((big + 1) * (big + 3))


def brute_codes(rows, parts, entries, rounds, scale):
    """Codes by a search through all entries, in Python's integers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (dims - len(v)), g) for i, v, g in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = dims // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda j: (gap(part, books[p][j]), j)) for p, part in enumerate(cut(v))] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(gap(part, books[p][c[p]]) for p, part in enumerate(cut(v))) for (_, v, _), c in zip(kept, codes, strict=True)]
    of_label = collections.Counter()
    for (_, _, g), e in zip(kept, errors, strict=True):
        of_label[g] += e
    return [(i, bytes(c), e, of_label[g]) for (i, _, g), c, e in zip(kept, codes, errors, strict=True)], books


@pytest.mark.parametrize("rounds, hot", [(2, False), (4, True), (0, False)])
def test_vector_codes(spark, monkeypatch, rounds, hot):
    if hot:
        monkeypatch.setattr(vectorcodes, "HOT_SHARE", 3)
        monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 8) / 4 + (i % 3)], int(i % 5) if i % 7 else None) for i in rng.permutation(300)]
    rows += [(7, [0.5] * 8, 1), (7, [0.5] * 8, 1), (7, [-0.5] * 8, 2), (None, [1.0] * 8, None), (None, [0.25] * 3, 3), (500, [], 1)]
    rows += [(501, None, 1), (502, [1.0, None] * 4, 1), (503, [float("nan")] * 8, 1), (504, [float("inf")] * 8, 1), (3, [float("-inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, embedding array<float>, label int, id int, code binary").repartition(3)
    out, books = vectorcodes.compress(df, parts=4, entries=12, rounds=rounds)
    want, want_books = brute_codes(rows, 4, 12, rounds, 256)
    assert books.entries.tolist() == want_books
    got = [(r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    back = vectorcodes.decompress(out, books).limit(3).collect()
    assert all(len(r["approximate"]) == 8 for r in back)


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (1, 16, 4))
    v = (centres[0][rng.integers(0, 16, 2000)] + rng.integers(-40, 41, (2000, 4)))[:, None, :]
    books = vectorcodes.Codebooks(centres)
    code, upper, lower = np.zeros((2000, 1), np.int64), np.full((2000, 1), np.inf), np.zeros((2000, 1, 16), np.uint16)
    squares, done = vectorcodes.assign(books, v, code, upper, lower, True)
    full = ((v[:, 0, None] - centres[0][None]) ** 2).sum(-1)
    assert (code[:, 0] == full.argmin(1)).all() and (squares[:, 0] == full.min(1)).all() and done < 0.7 * full.size
    moved = vectorcodes.Codebooks(centres + rng.integers(-3, 4, centres.shape))
    upper, lower = vectorcodes.shift(upper, lower, code, moved.moved(books))
    _, again = vectorcodes.assign(moved, v, code, upper, lower, False)
    assert again < 0.05 * full.size and (code[:, 0] == ((v[:, 0, None] - moved.entries[0][None]) ** 2).sum(-1).argmin(1)).all()


def test_large_components_are_clipped(spark):
    df = spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [0.0] * 4, 2)], "vec_id long, embedding array<double>, label int")
    out, books = vectorcodes.compress(df, parts=2, entries=2, rounds=1)
    assert {r["vec_id"]: r["code"].hex() for r in out.collect()} == {1: "0000", 2: "0101", 3: "0000"} and abs(books.entries).max() <= vectorcodes.LARGEST
