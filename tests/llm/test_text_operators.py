"""Text operators against brute force on a corpus of edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from dipper.llm import bpe, jaccard, linededup, media, packing, pii, quality, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def multiset(rows):
    return collections.Counter(map(repr, rows))


def test_bpe_is_the_library(docs, rows, bpe_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path)
    out = bpe.encode_documents(docs, bpe_path, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((i, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), back, hashlib.sha256(back.encode()).hexdigest()))
    assert multiset(map(tuple, out)) == multiset(want)
    again = bpe.decode_ids(bpe.encode_documents(docs, bpe_path), bpe_path).select("doc_id", "decoded").collect()
    assert multiset(map(tuple, again)) == multiset((i, t or "") for i, t, *_ in rows)


def test_bpe_on_random_strings(bpe_path):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    lib, codec, rng = Tokenizer.from_file(bpe_path), bpe.Codec(bpe.load_table(bpe_path)), random.Random(3)
    letters = [*" \n\t\r\x0b\x1c\x85\u00a0\u2003aabTHEe's'té¡0129²½.,!$日語😀\u0301\u200d\0", "<|endoftext|>", "  ", " the", "ing", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    off, ids = codec.encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids[off[i] : off[i + 1]].tolist() == want
        assert codec.decode(want).decode() == lib.decode(want, skip_special_tokens=False)


def test_packing(docs, rows, bpe_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path)
    out = packing.pack_documents(docs, bpe_path, max_len=64, slack=2).collect()
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for p in out:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        pieces[p["doc_id"]].append((p["start"], p["ids"], p["doc_tokens"]))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
        total += at
        padding += 0 if packing.power_of_two(at) else 64 - at
    assert padding < 0.04 * total
    copies = collections.Counter(i for i, *_ in rows)
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert {d for _, _, d in pieces[i]} == {len(ids)}
        got = sorted((s, tuple(x)) for s, x, _ in pieces[i])
        if copies[i] == 1:
            assert [x for _, part in got for x in part] == ids
        assert sum(len(x) for _, x in got) == copies[i] * len(ids)


def test_packing_keeps_ids_beside_null_ones(spark, bpe_path):
    far = [2**53 + 1 + 4 * i for i in range(40)] + [-(2**62) - 3]
    rows = [(i, "some words here") for i in far] + [(None, "some words here")] * 300
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bpe_path).collect()
    assert collections.Counter(p["doc_id"] for p in out) == collections.Counter(i for i, _ in rows)
    names = packing.pack_documents(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string"), bpe_path).collect()
    assert {p["doc_id"] for p in names} == {"a", None}


@pytest.mark.parametrize("hist", [{600: 1000}, {1: 5}, {1023: 7, 1: 3}, {1024: 3}, {700: 100, 300: 50, 333: 1}, {k: 1 + k % 7 for k in range(1, 1024)}, {}])
def test_packing_plan(hist):
    plan = packing.Plan(hist, 1024, 8)
    sequences = collections.defaultdict(list)
    for length, count in hist.items():
        for rank in range(count):
            parts = plan.place(length, rank)
            assert sum(p[1] for p in parts) == length
            for _, n, sequence, offset in parts:
                sequences[sequence].append((offset, n))
    assert sorted(sequences) == list(range(len(sequences)))
    total = padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        total += at
        padding += 0 if packing.power_of_two(at) else 1024 - at
    assert padding <= 0.01 * total


def brute_lines(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    found = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if found[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup(docs, rows, min_docs):
    out = linededup.drop_common_lines(docs, min_docs, carry=("bucket", "rest")).collect()
    want = [(r[0], *x, r[5], r[9]) for r, x in zip(rows, brute_lines([r[1] for r in rows], min_docs))]
    assert multiset(map(tuple, out)) == multiset(want)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    hi[:100] = hi[0]  # distinct by the other half alone
    h = linededup.PerfectHash(hi, lo)
    assert sorted(h(hi, lo)) == list(range(5000))


def test_line_arrays_turn_strange_lines_away():
    rng = np.random.default_rng(3)
    entries = np.zeros(6000, linededup._ENTRY)
    entries["hi"], entries["lo"] = rng.integers(0, 1 << 63, 6000), rng.integers(0, 1 << 63, 6000)
    entries["docs"] = np.arange(6000) % 20 + 1
    index = linededup.LineIndex.unpacked(linededup.LineIndex(entries, 10).packed())
    keys = linededup.in_full(entries)
    assert len(index.counts) == (entries["docs"] > 1).sum()  # lines of one document are in no array
    assert (index.documents(keys) == np.where(entries["docs"] > 1, entries["docs"], 0)).all()
    assert (index.are_common(keys, 10) == (entries["docs"] >= 10)).all()
    # lines that take the slot and fingerprint of a common one fail the second look
    forged = keys.copy()
    forged["lo"] ^= np.uint64(1)
    slots = index.hash(keys["hi"], keys["lo"])
    where = {h: i for i, h in enumerate(forged["hi"].tolist())}
    index.hash = lambda hi, lo: slots[[where[h] for h in hi.tolist()]]
    assert (index.documents(forged) == np.where(entries["docs"] > 1, entries["docs"], 0)).all() and not index.are_common(forged, 10).any()


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window, hot", [(3, 10_000), (35, 10_000), (30, 3)])
def test_substring_dedup(docs, rows, window, hot):
    out = substrings.drop_repeats(docs, window, hot=hot).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], window))]
    assert multiset((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out) == multiset(want)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)


def test_extension_finds_maximal_repeats():
    import random

    import pyarrow as pa

    rng = random.Random(9)
    for window, hot, turns in ((35, 10_000, 60), (28, 4, 60), (40, 10_000, 30)):
        for _ in range(turns):
            parts = [[f"p{k}-{i}" for i in range(rng.randint(20, 60))] for k in range(4)]
            texts = []
            for _ in range(12):
                w = []
                for _ in range(rng.randint(1, 4)):
                    part = parts[rng.randrange(4)]
                    a = rng.randrange(len(part))
                    w += part[a : a + rng.randint(5, 60)] + [f"u{rng.randrange(30)}"] * rng.randint(0, 2)
                texts.append(" ".join(w))
            tables = [pa.table({"bucket": [k] * 6, "text": texts[6 * k : 6 * k + 6]}) for k in range(2)]
            buckets = [substrings.Bucket(t, window) for t in tables]
            sent = [list(b.sent(1)) for b in buckets]
            said = substrings._places([x for s in sent for _, x in s], hot)
            answers = iter(said)
            told = [pa.table({"at_shard": pa.array([0] * len(s), pa.int64()), "said": pa.array([next(answers) for _ in s], pa.binary())}) for s in sent]
            seeds = [b.seeds(t, 1) for b, t in zip(buckets, told)]
            rows = [[], []]
            for kind, judge in ((0, lambda a: substrings._extend_shard(a, window - 26)), (1, substrings._repeated_windows)):
                own = [(k, s[kind][2]) for k, s in enumerate(seeds) if len(s[kind][2])]
                for (k, _), x in zip(own, judge([e.tobytes() for _, e in own]) if own else []):
                    rows[k].append((kind, 0, x))
            got = []
            for b, t, r in zip(buckets, told, rows):
                gone = b.covered(t, pa.table({c: pa.array([x[i] for x in r], k) for i, (c, k) in enumerate((("kind", pa.int64()), ("at_shard", pa.int64()), ("said", pa.binary())))}), 1)
                got += [int(gone[a:e].sum()) for a, e in zip(b.off, b.off[1:])]
            assert got == [x[1] for x in brute_repeats(texts, window)]


def test_periodic_text_within_one_seed(spark):
    # equal windows a few words apart, with one anchor between them
    unit = [f"w{i}" for i in range(5)]
    text = " ".join(["a", "b"] + unit * 8 + ["c", "d"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert substrings.drop_repeats(df).first()["n_removed"] == brute_repeats([text], 35)[0][1] > 0


def brute_classes(rows, n=5):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]  # the rows without an id are copies of each other alone
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i) if i is not None else None) for i, *_ in rows]


def test_jaccard(docs, rows):
    assert multiset(map(tuple, jaccard.near_duplicates(docs).collect())) == multiset(brute_classes(rows))


def test_jaccard_in_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_TOKENS", 150)
    assert multiset(map(tuple, jaccard.near_duplicates(docs).collect())) == multiset(brute_classes(rows))


def test_large_group_of_near_copies(spark):
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(w)))
    out = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {c for _, _, c in brute_classes(texts)}


def test_filters_are_intersected_by_pair(monkeypatch):
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(120):
        w = rng.sample(base, 40) if rng.random() < 0.5 or not texts else texts[rng.randrange(len(texts))].split()
        w = [x if rng.random() > 0.03 else rng.choice(base) for x in w]
        texts.append(" ".join(w))
    import pyarrow as pa

    off, tokens = jaccard.shingle_sets(pa.array(texts, pa.large_string()), 2)
    n = np.diff(off)
    _, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
    sets = [set(tokens[a:b].tolist()) for a, b in zip(off, off[1:])]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]

    def classes(pairs, m):
        label = list(range(m))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [x if c == y else c for c in label]
        return label

    def same(a, b):
        return len(set(zip(a, b))) == len(set(a)) == len(set(b))

    got = jaccard.link_cell(n, off, tokens, np.frexp(count[inverse])[1], 75)
    assert linked and same(got.tolist(), classes(linked, len(n)))
    side = np.arange(len(n)) % 2
    for inner in (False, True):
        allowed = [(a, b) for a, b in linked if side[a] != side[b] or (inner and side[a] == 1)]
        got = jaccard.link_cell(n, off, tokens, np.frexp(count[inverse])[1], 75, side, inner)
        assert same(got.tolist(), classes(allowed, len(n)))
        known = np.arange(len(n)) // 10
        got = jaccard.link_cell(n, off, tokens, np.frexp(count[inverse])[1], 75, side, inner, known)
        assert same(got.tolist(), classes(allowed + [(i, i // 10 * 10) for i in range(len(n))], len(n)))


def test_a_cell_takes_time_in_proportion():
    import time

    def cell(m):
        # groups of four near copies with one token in common, and many nodes of one class
        rng = np.random.default_rng(m)
        rows = [rng.integers(1 << 40, 1 << 62, 8) for _ in range(m // 8)]
        group = rng.integers(1 << 40, 1 << 62, 40)
        sets = [np.sort(np.where(np.arange(8) == k, rng.integers(1, 1 << 30), r)) for r in rows for k in range(4)]
        sets += [np.sort(np.where(np.arange(40) == k % 40, k + 1, group)) for k in range(m // 2)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        tokens = np.concatenate(sets).astype(np.uint64)
        _, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
        start = time.process_time()
        jaccard.link_cell(np.diff(off), off, tokens, np.frexp(count[inverse])[1], 75)
        return time.process_time() - start

    cell(1000)
    assert cell(32_000) < 8 * cell(8_000) + 1


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_private(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_patterns_on_random_strings():
    import random

    rng = random.Random(5)
    parts = [*"a@.b-+%_ 0123456789()é\n", "@", ".", " 4111111111111111 ", "+1 (555) 555-1234", "10.0.0.1", "x@y.z"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert sorted(pii.base_spans(t)[0]) == sorted(brute_private(t))


def test_spelt_out_addresses_of_any_case():
    text = "Bob (At) Example (Dot) Com"
    assert [text[a:b] for _, a, b in pii.loose_spans(text)] == [text]
    long = "x" * 300 + " at " + "y" * 200 + " dot z" * 9
    assert [long[a:b] for _, a, b in pii.loose_spans(long)] == [long]


def test_national_numbers():
    for t in ("415-555-0132", "(415) 555-0132", "1-415-555-0132", "030 1234 5678", "(0171) 555 1234"):
        assert [("x " + t + " y")[a:b] for _, a, b in pii.loose_spans("x " + t + " y")] == [t]
    assert pii.loose_spans("on 2024-01-15 12:30, 1234567, 10.20.30") == []


def plain_spans(text, weights):
    """As ``all_spans``, each looser span held against all spans taken so far."""
    out = [(*s, False) for s in pii.base_spans(text)[0]]
    for s in pii.loose_spans(text):
        if all(s[2] <= b or s[1] >= e for _, b, e, _ in out) and pii.believed(weights, pii.label(text, s, 0)[1]):
            out.append((*s, True))
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_added_spans_overlap_nothing():
    import random

    rng = random.Random(8)
    yes = np.zeros(pii._DIM + 1)
    yes[-1] = 1
    parts = ["415-555-0132", " at ", "dot", " ", "a@b.com", "bob", "x", "+1 (555) 555-1234", "(0171) 555 1234", "4111 1111 1111 1111", "call "]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.all_spans(t, yes) == plain_spans(t, yes)


def test_private_data(docs, rows):
    weights = pii.fit(docs)
    out = pii.find_private(docs, weights).collect()
    got = multiset((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["added"]]) for r in out)
    assert got == multiset((r[0], brute_private(r[1] or "")) for r in rows)
    added = [s for r in out for s in r["spans"] if s["added"]]
    assert {s["kind"] for s in added} <= {"phone", "email"}
    hidden = pii.mask_private(docs, weights)
    assert hidden.columns == docs.columns
    text = hidden.where("text like 'mail [email]%'").first()["text"]
    assert "bob@" not in text and "4111 1111" not in text and "999.1.1.1" in text and "4111111111111112" in text
    assert hidden.where("text is null").count() == 1


def test_long_texts_take_linear_time():
    import time

    start = time.time()
    for t in ("1" * 300_000, "a" * 300_000, "@" * 300_000, "+" * 300_000, "1.1" * 100_000, "+1" + "-" * 300_000, "a@" * 150_000, "a at " * 60_000 + "dot"):
        pii.all_spans(t, np.zeros(pii._DIM + 1))
    yes = np.zeros(pii._DIM + 1)
    yes[-1] = 1
    assert len(pii.all_spans("call 415-555-0132 " * 20_000, yes)) == 20_000
    assert len(pii.all_spans("bob at host dot com, 415-555-0132, " * 10_000, yes)) == 20_000
    assert time.time() - start < 20


def test_media(docs, rows, tmp_path):
    root = f"file://{tmp_path}/m"
    out = media.media_columns(docs, root, body=True).collect()
    seen = {}
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert multiset((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == multiset(want)
    for r in out:
        assert r["width"] == 64 and r["height"] * 64 == r["payload_bytes"] and r["digest"].hex() == r["payload_sha256"]
        assert seen.setdefault(r["payload_sha256"], (r["shard"], r["offset"], r["media_sha256"], r["feature"])) == (r["shard"], r["offset"], r["media_sha256"], r["feature"])
    import tarfile

    for path in (tmp_path / "m").glob("*.tar"):
        with tarfile.open(path) as t:
            for m in t.getmembers():
                assert hashlib.sha256(media.read_png(t.extractfile(m).read())).hexdigest() == m.name


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r[0] for r in quality.judge_quality(docs).where("keep").select("doc_id").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    bad, good = [i for i, q in known.items() if q == 0], [i for i, q in known.items() if q == 1]
    assert sum(i in kept for i in bad) <= 0.1 * len(bad) and sum(i in kept for i in good) >= 0.98 * len(good)
    assert {r[0] for r in quality.keep_good(docs).select("doc_id").collect()} == kept


def test_quality_edges(docs, rows):
    out = quality.judge_quality(docs).collect()
    assert len(out) == len(rows)
    assert all(r["keep"] for r in out if r["doc_id"] is not None and not (rows[r["doc_id"]][1] or "").strip())
    assert quality.keep_good(docs).columns == docs.columns


def plain_description(text):
    """Votes and shares of a text, written out from their definition."""
    import xxhash

    words = text.encode().split()
    n, m = len(words), len(words) + 6
    if not n:
        return "0000000", {}

    def shape(w):
        out = "".join("a" if c >= 128 or chr(c).islower() else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else chr(c) for c in w)
        return re.sub(r"(.)\1+", r"\1", out, flags=re.S)

    shapes = [shape(w) for w in words]
    mark = sum(bool(re.search(r"[$%&#*]|!!", s)) or s.endswith("!") for s in shapes) / m
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    known = sum(w.strip(b".,;:!?\"'()").lower() in quality.FUNCTION_WORDS for w in words)
    up, low = (sum(text.encode().count(c) for c in letters) for letters in ([b"A", b"E", b"I", b"N", b"R", b"T"], [b"a", b"e", b"i", b"n", b"r", b"t"]))
    odd = sum(not re.fullmatch(r"(a|Aa|A|0)[.,;:?]?", s) for s in shapes)
    votes = ["-" if x else "0" for x in (up / (6 + up + low) >= 0.3, mark >= 0.1, shapes.count("|") / m >= 0.06, again >= 0.1, 100 * known + 54 <= 3 * m, 4 * len(set(words)) + 12 <= m)]
    votes.append("-" if 10 * odd >= 4 * m or again >= 0.2 else "+" if 10 * odd <= m and again <= 0.04 else "0")
    share = collections.Counter()
    for s in shapes + ["a"] * 6:
        share[xxhash.xxh3_64_intdigest(s.encode()) % (quality.DIM - 1)] += 1 / m
    share[quality.DIM - 1] = again
    return "".join(votes), share


def test_quality_query_by_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, _ = quality.fit(table)
    want = {}
    for r in table.select("doc_id", "text").collect():
        votes, share = plain_description(r["text"] or "")
        assert (votes, {k: pytest.approx(v) for k, v in share.items()}) == quality.describe((r["text"] or "").encode())
        z = sum(model.weights[i] * x for i, x in share.items()) + model.weights[-1]
        want[r["doc_id"]] = 1 / (1 + np.exp(-z)) if share else 1.0
    got = quality.QUERIES["op6_quality_filter"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == {i for i, s in want.items() if s >= 0.5}
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-4) for r in got)


def test_quality_has_no_step_in_length():
    # one word more or less changes no share by more than the words around it could
    for n in range(1, 40):
        votes, share = quality.describe(b" ".join([b"word", b"other."] * n))
        assert share and len(votes) == 7
    a, b = (quality.describe(b" ".join([b"w%d" % i for i in range(n)]))[1] for n in (7, 8))
    assert a.keys() == b.keys()


def test_empty_tables(empty, bpe_path, tmp_path):
    assert bpe.encode_documents(empty, bpe_path).count() == 0
    assert packing.pack_documents(empty, bpe_path).count() == 0
    assert linededup.drop_common_lines(empty).count() == 0
    assert substrings.drop_repeats(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert pii.find_private(empty, pii.fit(empty)).count() == 0
    assert media.media_columns(empty, f"file://{tmp_path}/e").count() == 0
    assert quality.judge_quality(empty).count() == 0


@pytest.fixture(scope="session")
def table(docs, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    return sf


def test_media_query(spark, table, rows):
    import struct

    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        feature = f"64x{len(payload) // 64}x8;sum={sum(payload)};distinct={len(set(payload))};zeros={payload.count(0)}"
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature))
    out = media.QUERIES["op4_media_columns"](spark, table)
    assert out.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert multiset(map(tuple, out.collect())) == multiset(want)


def test_bpe_query(spark, table, rows, bpe_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path)
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = bpe.QUERIES["op5_bpe_round_trip"](spark, table).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert multiset(map(tuple, out.collect())) == multiset(want)


def test_private_data_query(spark, table, docs, rows):
    weights = pii.fit(docs)
    want = []
    for r in rows:
        base = sorted(brute_private(r[1] or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        every = plain_spans(r[1] or "", weights)
        assert [s[:3] for s in every if not s[3]] == base
        joined = [",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans) for spans in (base, every)]
        want.append((r[0], *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
    out = pii.QUERIES["op7_pii"](spark, table).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert multiset(map(tuple, out.collect())) == multiset(want)


def test_packing_query(spark, table, rows, bpe_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path)
    out = packing.QUERIES["op8_pack_documents"](spark, table).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for p in out:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        pieces[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    total = padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        total += at
        padding += 0 if packing.power_of_two(at) else 1024 - at
    copies = collections.Counter(r[0] for r in rows)
    for i, t, *_ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[i])
        assert sum(n for _, n, _, _ in own) == copies[i] * len(ids)
        for start, n, crc, tokens in own:
            assert tokens == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
    assert padding <= 0.01 * total + 1024
