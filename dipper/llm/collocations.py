"""Phrase collocation mining by pivot partitioning.

1. Documents are dealt into buckets of a few MB by where they lie, so no id, text or language fills one. A bucket sends
   each of its distinct words once to the word's shard and is told how often all documents have it (``exchange``). Words
   go as strings, so counts are exact.
2. Words rarer than ``min_count`` end every phrase. Of a phrase of other words the rarest is the pivot (ties by a hash,
   then the word). Around each word the text is rewritten to what phrases with that pivot can hold: at most
   ``max_words - 1`` words on either side, up to the next rarer word, on the left also up to the same word, so that a
   phrase belongs to the first of equal pivots. A bucket sends equal fragments once, with their number, to the pivot's
   shard. A pivot of more than PIVOT_FRAGMENTS occurrences is salted over many shards.
3. A shard counts the phrases of its fragments that hold the pivot, and no others, so it sends each phrase it owns, with
   its count; rare ones of pivots that aren't salted go at once. Sums over shards complete the salted ones.
4. Phrases meet the counts of their parts, and the longer phrases around them, by joins, which Spark may split where a
   part is hot. Ranks within a language are taken in salted groups first.

A phrase's score at a cut is floor(1,000,000 a^2 / (l r)), in decimals of 38 digits; counts up to 10^15 are exact.

A-Z are lower-cased; texts are cut at ``[.,;:!?\\x0A-\\x0D]`` and words are ``[^\\x20\\x09]+``. Null texts count as empty; a
null language is ``und``. Very long texts are one row of a bucket each. Repeated rows count each. An empty table gives no
rows. Other columns than the text and the language are not read, so their names can't clash. The input must give the
same rows in the same order when it is read again, as a table does.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipper.llm.bpe import buffers
from dipper.llm.common import cut, mix, parallelism, word_hashes
from dipper.llm.exchange import answer, deal_buckets, shard_slices, with_answers

#: Bytes of text for which one shard is made, and how many there are at least.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 32
#: Occurrences of a pivot that one salt takes, about.
PIVOT_FRAGMENTS = 200_000

#: What a byte becomes: A-Z lower-cased, cuts a line feed, tab a space.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 10
_BYTES[9] = 32


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each word its text, its piece and its code, and the distinct words. Pieces of different texts have different numbers."""
    off, data = buffers(text)
    t = _BYTES[data]
    inside = (t != 32) & (t != 10)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = np.diff(off) > 0  # words end with their text
    first[off[:-1][some]] = inside[off[:-1][some]]
    last[off[1:][some] - 1] = inside[off[1:][some] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    piece = np.cumsum(t == 10)[start] + doc if len(start) else start
    ends = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(t[inside]))
    coded = words.dictionary_encode()
    return doc, piece, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Bucket:
    """The words of one bucket by language: ``code`` of each word of the texts, and for each code language, word, hash and number."""

    def __init__(self, table: pa.Table):
        doc, self.piece, word, words = words_of(table.column("text").combine_chunks().cast(pa.large_string()))
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] if len(doc) else doc
        self.langs = langs.dictionary.to_pylist()
        pairs, code, count = np.unique(lang * max(len(words), 1) + word, return_inverse=True, return_counts=True)
        lang, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
        lang_hash = word_hashes(pa.array(self.langs, pa.string()))
        h = mix(word_hashes(words)[word] ^ mix(lang_hash, 3)[lang]) if len(pairs) else np.zeros(0, np.uint64)
        names = words.take(pa.array(word))
        # by hash, equal hashes by the word and the language
        order = np.argsort(h, kind="stable")
        if (h[order][1:] == h[order][:-1]).any():
            by_name = np.empty(len(h), np.int64)
            by_name[pc.sort_indices(names).to_numpy()] = np.arange(len(h))
            order = np.lexsort((lang, by_name, h))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code, self.hash, self.lang, self.count = place[code], h[order], lang[order], count[order]
        self.words = names.take(pa.array(order))

    def sent(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """Distinct words by shard, each with its language and its number in the bucket."""
        langs = pa.array([quote(x) for x in self.langs], pa.large_string())
        names = pc.binary_join_element_wise(langs.take(pa.array(self.lang)), self.words, pa.scalar(" ", pa.large_string()))
        for s, c in shard_slices(self.hash, shards):
            counts = self.count[c].astype("<i8")
            yield s, np.array([len(counts)], "<i8").tobytes() + counts.tobytes() + "\n".join(names[c].to_pylist()).encode()

    def told(self, said: pa.Table, shards: int) -> np.ndarray:
        """How often all documents have each word, from the answers."""
        by_shard = dict(zip(said.column("at_shard").to_pylist(), said.column("said").to_pylist(), strict=True)) if said.num_rows else {}
        return np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(by_shard[s], "<i8") for s, _ in shard_slices(self.hash, shards))]).astype(np.int64)


def total_counts(arrays: list[bytes]) -> list[bytes]:
    """For each array that a word shard got, how often all arrays have its words."""
    names, counts = [], []
    for a in arrays:
        n = int(np.frombuffer(a, "<i8", 1)[0])
        counts.append(np.frombuffer(a, "<i8", n, 8))
        names.append(pc.split_pattern(pa.array([a[8 + 8 * n :].decode()], pa.large_string()), "\n").flatten())
    code = pa.concat_arrays(names).dictionary_encode().indices.to_numpy()
    total = np.zeros(int(code.max()) + 1, np.int64)
    np.add.at(total, code, np.concatenate(counts))
    return [x.tobytes() for x in np.split(total[code], np.cumsum([len(c) for c in counts])[:-1])]


class Fragments:
    """Distinct fragments around pivots: their words, ragged, ``lead`` (words before the pivot), and how often each occurs."""

    def __init__(self, bucket: Bucket, total: np.ndarray, min_count: int, max_words: int):
        code, piece = bucket.code, bucket.piece
        n, reach = len(code), max_words - 1
        rank = np.full(len(total), -1)  # rarest first; -1 for words too rare for any phrase
        kept = np.flatnonzero(total >= min_count)
        # words lie by hash and name, so a stable sort by count breaks ties by these
        rank[kept[np.argsort(total[kept], kind="stable")]] = np.arange(len(kept))
        r = rank[code]
        lead, tail = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left, right = r >= 0, r >= 0
        for d in range(1, min(reach, n - 1) + 1):
            same = piece[d:] == piece[:-d]
            left[d:] &= same & (r[:-d] > r[d:])
            left[:d] = False
            right[:-d] &= same & (r[d:] >= r[:-d])
            right[-d:] = False
            lead += left
            tail += right
        at = np.flatnonzero(lead + tail)
        lead, size = lead[at], (1 + lead + tail)[at]
        width = 2 * reach + 1
        matrix = np.full((len(at), width), -1, np.int32)
        h = np.zeros(len(at), np.uint64)
        for j in range(width):
            some = np.flatnonzero(size > j)
            own = code[at[some] - lead[some] + j]
            matrix[some, j] = own
            h[some] = mix(h[some] ^ bucket.hash[own], j)
        h ^= lead.astype(np.uint64)
        order = np.argsort(h, kind="stable")
        h, lead, size, matrix, pivot = h[order], lead[order], size[order], matrix[order], code[at][order]
        # an equal hash of other words only parts equal fragments
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (lead[1:] != lead[:-1]) | (matrix[1:] != matrix[:-1]).any(1)]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        single = kept  # each word is a phrase of itself as well
        self.hash = np.concatenate([h[first], bucket.hash[single]])
        self.pivot = np.concatenate([pivot[first], single])
        self.lead = np.concatenate([lead[first], np.zeros(len(single), np.int64)])
        self.size = np.concatenate([size[first], np.ones(len(single), np.int64)])
        self.count = np.concatenate([np.diff(np.append(first, len(h))), bucket.count[single]])
        alone = np.full((len(single), width), -1, np.int32)
        alone[:, 0] = single
        self.words = np.concatenate([matrix[first], alone])


def route(bucket: Bucket, fragments: Fragments, total: np.ndarray, shards: int) -> pa.Table:
    """Packed fragments for each pivot's shard, in rows of one language, salted or not."""
    f = fragments
    salts = -(-total[f.pivot] // PIVOT_FRAGMENTS)
    salted = salts > 1
    salt = np.where(salted & (f.size > 1), f.hash % np.maximum(salts, 1).astype(np.uint64), 0).astype(np.uint64)
    shard = (((mix(bucket.hash[f.pivot] + salt, 11) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    lang = bucket.lang[f.pivot]
    out: dict[str, list] = {k: [] for k in _ROUTED}
    order = np.lexsort((salted, lang, shard))
    s, g, w = shard[order], lang[order], salted[order]
    cuts = np.flatnonzero((s[1:] != s[:-1]) | (g[1:] != g[:-1]) | (w[1:] != w[:-1])) + 1
    starts = [0, *cuts.tolist()] if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=False):
        own = order[a:b]
        matrix = f.words[own]
        used, local = np.unique(matrix[matrix >= 0], return_inverse=True)
        names = "\n".join(bucket.words.take(pa.array(used)).to_pylist()).encode()
        wide = "<u2" if len(used) <= 1 << 16 else "<u4"
        for c, v in zip(out.values(), (int(s[a]), bucket.langs[g[a]], bool(w[a]), len(own), names, np.stack([f.size[own], f.lead[own]]).astype(np.uint8).tobytes(), f.count[own].astype("<u4").tobytes(), local.astype(wide).tobytes()), strict=True):
            c.append(v)
    # the words of each language in all: a phrase of no words
    all_words = np.bincount(bucket.lang, weights=bucket.count, minlength=len(bucket.langs)).astype(np.int64)
    for lang_name, n in zip(bucket.langs, all_words.tolist(), strict=True):
        for c, v in zip(out.values(), (int(mix(word_hashes(pa.array([lang_name], pa.string())))[0] % np.uint64(shards)), lang_name, True, 0, b"", b"", np.array([n], "<i8").tobytes(), b""), strict=True):
            c.append(v)
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


_ROUTED = {"shard": "long", "lang": "string", "salted": "boolean", "n": "long", "names": "binary", "shape": "binary", "counts": "binary", "codes": "binary"}


def mine(table: pa.Table, min_count: int, max_words: int) -> pa.Table:
    """The phrases of a shard's fragments that hold their pivots: ``lang``, ``words`` (how many), ``phrase``, ``f``.

    Those of pivots that aren't salted are whole, so that rare ones can go.
    """
    out: dict[str, list] = {"lang": [], "words": [], "phrase": [], "f": []}

    def give(lang: str, words: int, phrases: list[str], counts: list[int]) -> None:
        out["lang"].extend([lang] * len(phrases))
        out["words"].extend([words] * len(phrases))
        out["phrase"].extend(phrases)
        out["f"].extend(counts)

    groups: dict[tuple[str, bool], list[int]] = {}
    langs, salted, sizes = (table.column(c).to_pylist() for c in ("lang", "salted", "n"))
    for i, key in enumerate(zip(langs, salted, strict=True)):
        if sizes[i]:
            groups.setdefault(key, []).append(i)
        else:
            give(key[0], 0, [""], [int(np.frombuffer(table.column("counts")[i].as_py(), "<i8")[0])])
    for (lang, partial), rows in groups.items():
        own = table.take(pa.array(rows))
        parts = [pc.split_pattern(pa.array([x.decode()], pa.large_string()), "\n").flatten() for x in own.column("names").to_pylist()]
        coded = pa.concat_arrays(parts).dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        base = np.cumsum([0, *map(len, parts)])
        flat = [code[b + np.frombuffer(x, "<u2" if len(p) <= 1 << 16 else "<u4").astype(np.int64)] for b, p, x in zip(base.tolist(), parts, own.column("codes").to_pylist(), strict=False)]
        codes = np.concatenate(flat)
        shape = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in own.column("shape").to_pylist()], axis=1).astype(np.int64)
        size, lead = shape
        count = np.concatenate([np.frombuffer(x, "<u4") for x in own.column("counts").to_pylist()]).astype(np.int64)
        start = np.cumsum(size) - size
        for n in range(1, max_words + 1):
            first, times = [], []
            for before in range(n):  # words of the phrase before its pivot
                some = np.flatnonzero((size == 1) if n == 1 else (size > 1) & (lead >= before) & (size - lead >= n - before))
                first.append(start[some] + lead[some] - before)
                times.append(count[some])
            first, times = np.concatenate(first), np.concatenate(times)
            if not len(first):
                continue
            # phrases by number, one word more at a time
            number = codes[first]
            for j in range(1, n):
                number = np.unique(number * len(words) + codes[first + j], return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            at = np.flatnonzero(np.diff(number[order], prepend=-1))
            f = np.add.reduceat(times[order], at)
            keep = np.full(len(f), True) if partial else f >= min_count
            place = first[order[at[keep]]]
            text = words.take(pa.array(codes[place]))
            for j in range(1, n):
                text = pc.binary_join_element_wise(text, words.take(pa.array(codes[place + j])), pa.scalar(" ", pa.large_string()))
            give(lang, n, text.to_pylist(), f[keep].tolist())
    return pa.table({"lang": pa.array(out["lang"], pa.string()), "words": pa.array(out["words"], pa.int32()), "phrase": pa.array(out["phrase"], pa.string()), "f": pa.array(out["f"], pa.int64())})


def count_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3) -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of 1 to ``max_words`` words occurs, if at least ``min_count`` times.

    A row of 0 words for each language has all its words.
    """
    if not 2 <= max_words <= 100:
        raise ValueError("phrases of 2 to 100 words")
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    dealt = deal_buckets(rows.withColumn("place", F.monotonically_increasing_id()), F.xxhash64("place"), total)

    def send(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        return Bucket(table).sent(shards)

    def apply(table: pa.Table, said: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        counts = bucket.told(said, shards)
        return route(bucket, Fragments(bucket, counts, min_count, max_words), counts, shards)

    routed = with_answers(dealt, answer(dealt, send, total_counts), apply, ", ".join(f"{k} {t}" for k, t in _ROUTED.items()))
    mined = routed.groupBy("shard").applyInArrow(lambda t: mine(t, min_count, max_words), "lang string, words int, phrase string, f long")
    return mined.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= min_count))


def score_phrases(counts: DataFrame, cover_percent: int = 50) -> DataFrame:
    """Candidates of ``count_phrases`` with their lowest-scoring cut: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``.

    A phrase goes if a longer one around it has at least ``cover_percent`` of its occurrences.
    """
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = counts.where("words > 0").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("part"), "f")
    # a phrase in a longer one is in all between, which occur no less: one word more is enough
    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    around = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where(f"covered is null or 100 * covered < {cover_percent} * a")
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnRenamed("f", name), (F.col("lang") == F.col("of_lang")) & (F.col(side) == F.col("part"))).drop("of_lang", "part", side)
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def top_phrases(counts: DataFrame, scored: DataFrame, first: int = 2000) -> DataFrame:
    """The best of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the language), ``score``."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(4 * parallelism(scored.sparkSession)))
    some = scored.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(counts.where("words = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3, cover_percent: int = 50, first: int = 2000) -> DataFrame:
    """The collocations of each language, as ``top_phrases`` gives them."""
    counts = cut(count_phrases(df, text_col, lang_col, min_count, max_words))
    return top_phrases(counts, score_phrases(counts, cover_percent), first)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 3 words of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {
    "op12_collocations": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?
-
]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?
-
]'), 1) AS p FROM docs),
split AS (SELECT d, p, lang, [w for w in string_split_regex(piece, '[ 	]+') if w <> ''] AS ws FROM pieces),
words AS (SELECT d, p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
run AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w AS phrase, count(*) AS f FROM words GROUP BY ALL),
f2 AS (SELECT lang, w AS a1, w2 AS a2, count(*) AS f FROM run WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w AS a1, w2 AS a2, w3 AS a3, count(*) AS f FROM run WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inner2 AS (SELECT lang, a1, a2, max(f) AS covered FROM (SELECT lang, a1, a2, f FROM f3 UNION ALL SELECT lang, a2, a3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.a1 || ' ' || c.a2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.phrase = c.a1 JOIN f1 y ON y.lang = c.lang AND y.phrase = c.a2
  LEFT JOIN inner2 i ON i.lang = c.lang AND i.a1 = c.a1 AND i.a2 = c.a2
  WHERE c.f >= 10 AND (i.covered IS NULL OR 100 * i.covered < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.a1 || ' ' || c.a2 || ' ' || c.a3, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.phrase = c.a1 JOIN f2 y ON y.lang = c.lang AND y.a1 = c.a2 AND y.a2 = c.a3
  UNION ALL
  SELECT c.lang, c.a1 || ' ' || c.a2 || ' ' || c.a3, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.a1 = c.a1 AND x.a2 = c.a2 JOIN f1 y ON y.lang = c.lang AND y.phrase = c.a3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
}
