"""Substring dedup by seed and extend: words covered by a passage that also starts elsewhere go.

1. Seeds: each window of ``window`` words selects, among the hashes of its runs of ``SEED`` words, the least (winnowing), so
   equal windows select equal anchors. Anchors meet by hash in shards; buckets of documents learn which of theirs have
   other places.
2. Join and extension: the places of an anchor meet in its shard, each with the words on both sides, as far as a window
   can reach. For every number of words to the left, places that agree in them are in order of the words to their right;
   the longest match to the right with any of them is the one with a neighbour. So every place gets its maximal repeats,
   whatever the number of places, and no pairs of places are formed. Repeats of ``window`` words or more are kept.
3. Each place's words within its repeats are marked. Repeats longer than a window are the union of those of their anchors,
   which overlap.

An anchor with more than ``hot`` places would make a large group in one shard. Its seeds are lengthened to whole windows
before they meet, which then need no extension: equal windows of a bucket make one entry, and places whose surroundings
differ fall apart. The result is the same. See ``exchange`` for how hot passages make one entry a bucket.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; they are compared by 48 bits of hash each beside 96 bits of their seed. Null
and empty texts have no words; texts shorter than a window stay whole; very long texts are read whole. Repeated rows are
places each. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipper.llm.common import mix, window_hashes, word_codes, word_hashes
from dipper.llm.exchange import answer, deal, shard_slices, with_answers

#: Words of a seed; ``window - SEED + 1`` seeds compete in a window.
SEED = 26
#: Places beyond which an anchor's seeds are whole windows.
HOT_PLACES = 10_000
#: Bytes of text for which one shard is made.
SHARD_BYTES = 16 << 20
_ANCHOR = np.dtype([("key", "<u8"), ("places", "<u4")])
_WHOLE = np.dtype([("key", "<u8"), ("check", "<u4"), ("more", "u1")])


def seed_type(reach: int) -> np.dtype:
    """A seed and the words around it, the nearest first: 48 bits each, 0 beyond the text."""
    return np.dtype([("key", "<u8"), ("check", "<u4"), ("more", "u1"), ("high", "<u4", (2, reach)), ("low", "<u2", (2, reach))])


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of ``width`` neighbours."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step] if step else out, out[step:])
        done += step
    return out


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each distinct key in ascending order, which of them each row is, whether more rows are)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of, np.bincount(of, minlength=int(new.sum())) > 1


class Bucket:
    """The windows and seeds of one bucket's texts."""

    def __init__(self, table: pa.Table, window: int):
        text = table.column("text").combine_chunks().cast(pa.large_string())
        self.window, self.seed = window, min(SEED, window)
        self.reach = window - self.seed
        self.off, self.codes, self.words = word_codes(text, lower=False)
        n = len(self.codes)
        self.starts = np.zeros(0, np.int64)  # of windows within one text
        self.least = np.zeros(0, np.uint64)  # the anchor that each window selects
        self.places = np.zeros(0, np.int64)  # selected
        self.anchors = np.zeros(0, np.uint64)  # at these places
        if n < window:
            return
        self.hashes = word_hashes(self.words)[self.codes]
        self.begin, self.end = (np.repeat(x, np.diff(self.off)) for x in (self.off[:-1], self.off[1:]))
        ok = np.arange(n - window + 1) + window <= self.end[: n - window + 1]
        self.starts = np.flatnonzero(ok)
        width = self.reach + 1
        grams = window_hashes(self.hashes, self.seed)
        least = _slide(grams, width, np.minimum)
        # least hashes are small; scrambled, they fall evenly into shards
        self.least = mix(least[self.starts], 99)
        # A place is selected if it holds the least hash of a window around it.
        pad = np.zeros(width - 1, np.uint64)
        around = _slide(np.concatenate([pad, np.where(ok, least, 0), pad]), width, np.maximum)
        self.places = np.flatnonzero((around == grams) & (around > 0))
        self.anchors = mix(grams[self.places], 99)

    def sent(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """Distinct anchors and how many places each has in the bucket."""
        keys, places = np.unique(self.anchors, return_counts=True)
        entries = np.zeros(len(keys), _ANCHOR)
        entries["key"], entries["places"] = keys, places
        for s, cut in shard_slices(keys, shards):
            yield s, entries[cut].tobytes()

    def _told(self, said: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchors, which have other places, which have very many)."""
        keys = np.unique(self.anchors)
        by_shard = dict(zip(said.column("at_shard").to_pylist(), said.column("said").to_pylist(), strict=True)) if said.num_rows else {}
        shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for s, c in shard_slices(keys, shards):
            if s in by_shard:
                bits = np.frombuffer(by_shard[s], np.uint8).reshape(2, -1)
                shared[c], hot[c] = (np.unpackbits(b, count=c.stop - c.start).astype(bool) for b in bits)
        return keys, shared, hot

    def seeds(self, said: pa.Table, shards: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Seeds to extend, and whole windows of hot anchors; each as (places, entry of each, entries ascending by key)."""
        kind = seed_type(self.reach)
        if not len(self.places):
            none = np.zeros(0, np.int64)
            return (none, none, np.zeros(0, kind)), (none, none, np.zeros(0, _WHOLE))
        keys, shared, hot = self._told(said, shards)
        of = np.searchsorted(keys, self.anchors)
        at = self.places[shared[of] & ~hot[of]]
        key, check = mix(window_hashes(self.hashes, self.seed)[at], 99), window_hashes(self.hashes, self.seed, 23)[at].astype(np.uint32)
        near = np.zeros((len(at), 2, self.reach), np.uint64)
        for k in range(self.reach):
            left, right = at - 1 - k, at + self.seed + k
            near[:, 0, k] = np.where(left >= self.begin[at], self.hashes[left.clip(0)] | np.uint64(1), 0)
            near[:, 1, k] = np.where(right < self.end[at], self.hashes[right.clip(0, len(self.hashes) - 1)] | np.uint64(1), 0)
        near &= np.uint64((1 << 48) - 1)
        around = np.zeros(len(at), np.uint64)
        for k in range(self.reach):
            for d in range(2):
                around = mix(around ^ near[:, d, k], 2 * k + d)
        first, entry, more = _distinct(key, check, around)
        entries = np.zeros(len(first), kind)
        entries["key"], entries["check"], entries["more"] = key[first], check[first], more
        entries["high"], entries["low"] = near[first] >> np.uint64(16), near[first] & np.uint64(0xFFFF)
        whole = self.starts[hot[np.searchsorted(keys, self.least)]]
        key, check = window_hashes(self.hashes, self.window, 11)[whole], window_hashes(self.hashes, self.window, 23)[whole].astype(np.uint32)
        first, of_whole, more = _distinct(key, check)
        wholes = np.zeros(len(first), _WHOLE)
        wholes["key"], wholes["check"], wholes["more"] = key[first], check[first], more
        return (at, entry, entries), (whole, of_whole, wholes)

    def covered(self, said_anchor: pa.Table, said_seed: pa.Table, shards: int) -> np.ndarray:
        """Which words lie in a repeat."""
        edge = np.zeros(len(self.codes) + 1, np.int64)
        (at, entry, entries), (whole, of_whole, wholes) = self.seeds(said_anchor, shards)
        extent = np.full((len(entries), 2), 255, np.uint8)
        hit = np.zeros(len(wholes), bool)
        slices = [dict(shard_slices(e["key"], shards)) for e in (entries, wholes)]
        for kind, s, x in zip(*(said_seed.column(c).to_pylist() for c in ("kind", "at_shard", "said")), strict=True) if said_seed.num_rows else ():
            if kind == 0:
                extent[slices[0][s]] = np.frombuffer(x, np.uint8).reshape(-1, 2)
            else:
                c = slices[1][s]
                hit[c] = np.unpackbits(np.frombuffer(x, np.uint8), count=c.stop - c.start).astype(bool)
        far = extent[entry].astype(np.int64)
        some = far[:, 0] < 255
        whole = whole[hit[of_whole]]
        np.add.at(edge, at[some] - far[some, 0], 1)
        np.add.at(edge, at[some] + self.seed + far[some, 1], -1)
        np.add.at(edge, whole, 1)
        np.add.at(edge, whole + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def extended(entries: np.ndarray, reach: int) -> np.ndarray:
    """How far to the left and right of each seed its repeats of ``reach`` more words go, as (rows, 2) bytes; 255: there are none.

    A seed's repeats all hold it, so their union is one run of words.
    """
    n = len(entries)
    near = (entries["high"].astype(np.uint64) << np.uint64(16)) | entries["low"]
    same = mix(entries["key"], 7) ^ mix(entries["check"].astype(np.uint64), 8)
    order = np.lexsort((*(near[:, 1, k] for k in range(reach - 1, -1, -1)), same))
    near, same, more = near[order], same[order], entries["more"][order].astype(bool)
    own = (np.cumsum(near == 0, axis=2) == 0).sum(2)  # words up to the border of the text, on each side
    out = np.full((n, 2), -1, np.int64)
    right = near[:, 1]
    for left in range(reach + 1):
        if left:
            # places that agree in one word more to the left; at a border, with none
            word = near[:, 0, left - 1]
            same = np.where(word == 0, mix(np.arange(n).astype(np.uint64), 1000 + left), mix(same ^ mix(word, left), 5))
        by = np.argsort(same, kind="stable")  # of those that agree, in the order of the words to the right
        equal = same[by][1:] == same[by][:-1]
        match = np.full(n + 1, -1, np.int64)
        a, b = right[by[1:][equal]], right[by[:-1][equal]]
        match[1:-1][equal] = np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(1)
        best = np.full(n, -1, np.int64)
        best[by] = np.maximum(match[:-1], match[1:])
        best = np.where(more & (own[:, 0] >= left), own[:, 1], best)
        kept = (best >= 0) & (left + best >= reach)
        out[kept, 0] = left
        out[kept, 1] = np.maximum(out[kept, 1], best[kept])
    said = np.full((n, 2), 255, np.uint8)
    said[order] = np.where(out < 0, 255, out)
    return said


def _extend_shard(arrays: list[bytes], reach: int) -> list[bytes]:
    parts = [np.frombuffer(a, seed_type(reach)) for a in arrays]
    said = extended(np.concatenate(parts), reach)
    return [x.tobytes() for x in np.split(said, np.cumsum([len(p) for p in parts])[:-1])]


def _repeated_windows(arrays: list[bytes]) -> list[bytes]:
    """A bitmap for each array: which windows have another place."""
    parts = [np.frombuffer(a, _WHOLE) for a in arrays]
    entries = np.concatenate(parts)
    _, of, _ = _distinct(entries["key"], entries["check"])
    hit = np.bincount(of, weights=1 + entries["more"])[of] >= 2
    return [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(p) for p in parts])[:-1])]


def _places(arrays: list[bytes], hot: int) -> list[bytes]:
    """Two bitmaps for each array of anchors: which have more than one place, and which more than ``hot``."""
    parts = [np.frombuffer(a, _ANCHOR) for a in arrays]
    entries = np.concatenate(parts)
    _, of = np.unique(entries["key"], return_inverse=True)
    total = np.bincount(of, weights=entries["places"])[of]
    return [np.packbits(x > 1).tobytes() + np.packbits(x > hot).tobytes() for x in np.split(total, np.cumsum([len(p) for p in parts])[:-1])]


def drop_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PLACES) -> DataFrame:
    """One row per row: the id, ``n_words``, ``n_removed``, ``spans`` (word positions removed, end exclusive) and the words kept, joined by spaces."""
    dealt = deal(df, id_col, text_col)
    shards = max(32, -(-dealt.total // SHARD_BYTES))
    anchors = answer(dealt, lambda t: Bucket(t, window).sent(shards), lambda a: _places(a, hot))
    by_bucket = anchors.groupBy("at_bucket").agg(F.collect_list(F.struct("at_shard", "said")).alias("anchors"))

    def unnest(said: pa.Table, column: str) -> pa.Table:
        rows = [x for r in said.column(column).to_pylist() if r for x in r] if said.num_rows else []
        return pa.table({c: pa.array([x.get(c) for x in rows], t) for c, t in (("kind", pa.int64()), ("at_shard", pa.int64()), ("said", pa.binary()))})

    def send(docs: pa.Table, said: pa.Table) -> pa.Table:
        (_, _, entries), (_, _, wholes) = Bucket(docs, window).seeds(unnest(said, "anchors"), shards)
        found = [(kind, s, x[c].tobytes()) for kind, x in enumerate((entries, wholes)) for s, c in shard_slices(x["key"], shards)]
        at = docs.column("bucket")[0].as_py() if docs.num_rows else 0
        return pa.table({"kind": pa.array([k for k, _, _ in found], pa.int64()), "shard": pa.array([s for _, s, _ in found], pa.int64()), "from_bucket": pa.array([at] * len(found), pa.int64()), "packed": pa.array([x for _, _, x in found], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        arrays = table.column("packed").to_pylist()
        said = _repeated_windows(arrays) if table.column("kind")[0].as_py() else _extend_shard(arrays, window - min(SEED, window))
        return pa.table({"kind": table.column("kind"), "at_bucket": table.column("from_bucket"), "at_shard": table.column("shard"), "said": pa.array(said, pa.binary())})

    sent = with_answers(dealt, by_bucket, send, "kind long, shard long, from_bucket long, packed binary")
    replies = sent.groupBy("kind", "shard").applyInArrow(reply, "kind long, at_bucket long, at_shard long, said binary")
    both = by_bucket.select(F.col("at_bucket").alias("b"), "anchors").join(replies.groupBy("at_bucket").agg(F.collect_list(F.struct("kind", "at_shard", "said")).alias("seeds")), F.col("b") == F.col("at_bucket")).select("at_bucket", "anchors", "seeds")

    def apply(docs: pa.Table, said: pa.Table) -> pa.Table:
        bucket = Bucket(docs, window)
        gone = bucket.covered(unnest(said, "anchors"), unnest(said, "seeds"), shards)
        off = bucket.off
        stay = np.flatnonzero(~gone)
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[off[1:]] - before[off[:-1]]
        kept_off = off - before[off]
        lists = pa.ListArray.from_arrays(pa.array(kept_off, pa.int32()), bucket.words.cast(pa.string()).take(pa.array(bucket.codes[stay])))
        kept = pc.binary_join(lists, " ")
        flag = np.concatenate([gone, [False]]).astype(np.int8)
        spans = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            d = np.diff(flag[a:b], prepend=0, append=0) if b > a else np.zeros(0)
            spans.append([{"start": s, "stop": e} for s, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)])
        return pa.table({"id": docs.column("id"), "n_words": pa.array(np.diff(off)), "n_removed": pa.array(removed), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "text": kept})

    kind = df.schema[id_col].dataType.simpleString()
    out = with_answers(dealt, both, apply, f"id {kind}, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", F.col("text").alias(text_col))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, without words in windows of 35 that occur elsewhere."""
    rows = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_WINDOW = "concat_ws(' ', word, " + ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 35)) + ")"
_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents),
words AS (SELECT rn, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
windows AS (SELECT rn, p, CASE WHEN lead(word, 34) OVER o IS NOT NULL THEN {_WINDOW} END AS k FROM words WINDOW o AS (PARTITION BY rn ORDER BY p)),
again AS (SELECT k FROM windows WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
marked AS (SELECT rn, p, coalesce(max(CASE WHEN a.k IS NOT NULL THEN p END) OVER (PARTITION BY rn ORDER BY p) > p - 35, false) AS gone FROM windows LEFT JOIN again a USING (k)),
kept AS (SELECT rn, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS text FROM marked JOIN words USING (rn, p) GROUP BY rn)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rn)"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE_SQL = {"op9_substring_dedup": _SQL}
