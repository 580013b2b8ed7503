"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct words of a block of documents lie in one flat array of symbols. An index maps each mergeable pair to all
its positions in that array. Ranks with positions are applied in ascending order, each to all its positions at once,
and the lists of the pairs that a merge creates are updated. A merge can only create pairs of higher rank, as its
product exists from its own rank on, so one ascending sweep gives what merging word by word gives.

Results are those of the tokenizers library for a ``ByteLevel`` BPE file with ``add_special_tokens=False`` and without
truncation and padding: strings of special tokens in a text become their ids.

Null texts count as empty; empty texts have no ids; very long texts are encoded whole, in the block that they fall into; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from dipper.llm.common import blocks, ragged_take, text_column

_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the published splitting pattern of byte-level BPE.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A word always starts at a space before something that isn't white space.
_START = re.compile(r" (?=\S)")
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_PLAIN = f"^[{_LETTERS}]+[.,]?$"
#: Pieces that don't go on from a single space: none, or white space first (here with the separators that only some count).
_ODD_WORD = r"^$|^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    strings = strings.cast(pa.large_string())
    _, off, data = strings.buffers()
    o = np.frombuffer(off, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return o - o[0], np.frombuffer(data or b"", np.uint8)[o[0] : o[-1]]


def byte_letters() -> dict[int, str]:
    """The published rule that gives each byte a printable character."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def load_table(path: str) -> dict:
    """What the kernel needs of a tokenizers file; about 2 MB, whatever the data."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, letters = file["model"]["vocab"], byte_letters()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
    return {
        "bytes": [vocab[letters[b]] for b in range(256)],
        "left": np.array([vocab[a] for a, _ in merges], np.int64),
        "right": np.array([vocab[b] for _, b in merges], np.int64),
        "made": np.array([vocab[a + b] for a, b in merges], np.int64),
        "special": {x["content"]: x["id"] for x in file.get("added_tokens", [])},
        "tokens": vocab,
    }


class Codec:
    """Encodes and decodes blocks of texts with one table."""

    def __init__(self, table: dict):
        self.byte_ids = np.array(table["bytes"], np.int64)
        key = table["left"] << 32 | table["right"]
        # the last of equal pairs counts, as in a dictionary
        last = np.sort(len(key) - 1 - np.unique(key[::-1], return_index=True)[1])
        self.left, self.right, self.made = table["left"], table["right"], table["made"]
        order = np.argsort(key[last], kind="stable")
        self.keys, self.ranks = key[last][order], last[order]
        letter = np.arange(256)
        self.byte_ranks = self.rank_of(self.byte_ids[np.repeat(letter, 256)], self.byte_ids[np.tile(letter, 256)])
        self.special = table["special"]
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in byte_letters().items()}
        size = max([*table["tokens"].values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in table["tokens"].items():
            self.token_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.decimals = [str(i) for i in range(size)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1) if len(self.keys) else np.full(len(key), -1)

    def merge(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word of a ragged array of bytes, ragged, by the pair occurrence index."""
        n = len(data)
        if not n:
            return off, np.zeros(0, np.int32)
        sym = self.byte_ids[data]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        some = np.diff(off) > 0
        nxt[off[1:][some] - 1] = -1
        prv[off[:-1][some]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, i, j in zip(rank[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        at = np.flatnonzero(nxt >= 0)
        enter(at, self.byte_ranks[data[at].astype(np.int64) << 8 | data[at + 1]])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[sym[at] == a]
            right = nxt[at]
            ok = (right >= 0) & (sym[right] == b)
            at, right = at[ok], right[ok]
            if a == b and len(at) > 1:  # in aaa only the first two merge
                joined = np.concatenate([[False], right[:-1] == at[1:]])
                first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                take = (np.arange(len(at)) - first) % 2 == 0
                at, right = at[take], right[take]
            if not len(at):
                continue
            after = nxt[right]
            sym[at], sym[right] = self.made[r], -1
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            new = distinct(np.concatenate([before[before >= 0], at[has]]))
            enter(new, self.rank_of(sym[new], sym[nxt[new]]))
        alive = sym >= 0
        return np.concatenate([[0], np.cumsum(alive)])[off], sym[alive].astype(np.int32)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, ragged: (offsets, ids)."""
        n = len(text)
        split = pc.split_pattern(text, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        coded = split.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        size = len(words)
        # Pieces are cut off by single spaces; where white space follows a space, or a special token occurs, another way.
        odd = pc.match_substring_regex(words, _ODD_WORD).to_numpy(zero_copy_only=False)
        first = np.zeros(len(code), bool)
        first[off[:-1][np.diff(off) > 0]] = True
        doc = np.repeat(np.arange(n), np.diff(off))
        slow = np.zeros(n, bool)
        slow[doc[odd[code] & ~first]] = True
        for s in self.special:
            slow |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
        # Segments: 2 * word, one more with a space before it; those of slow texts are added behind.
        segment = 2 * code + ~first
        extra: dict[str, int] = {}
        own: dict[int, list[int]] = {}
        for d in np.flatnonzero(slow).tolist():
            ids = own[d] = []
            t = text[d].as_py()
            for part in self.special_split.split(t) if self.special_split else [t]:
                if part in self.special:
                    ids.append(extra.setdefault("\0" + part, len(extra)))
                elif part:
                    head, *rest = _START.split(part)
                    ids += [extra.setdefault(x, len(extra)) for x in ([head] if head else [])]
                    ids += [extra.setdefault(" " + x, len(extra)) for x in rest]
        seen = np.zeros(2 * size, bool)
        seen[segment[~slow[doc]] if own else segment] = True
        # Most are a space and letters, perhaps with one mark at the end: two pre-tokens at most.
        plain = np.flatnonzero(seen[1::2] & pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False))
        taken = words.take(pa.array(plain))
        dot, comma = (pc.ends_with(taken, x).to_numpy(zero_copy_only=False) for x in ".,")
        stems = pc.ascii_rtrim(taken, ".,").dictionary_encode()
        stem, spaced = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), stems.dictionary, pa.scalar(" ", pa.large_string()))
        count = len(spaced)
        per = [1 + (dot | comma)]
        flat = np.repeat(stem, per[0])
        marks = np.cumsum(per[0])[dot | comma] - 1
        flat[marks] = np.where(dot, count, count + 1)[dot | comma]
        # All others, by the pattern.
        seen[2 * plain + 1] = False
        rest = np.flatnonzero(seen)
        token: dict[str, int] = {".": 0, ",": 1}
        put = token.setdefault
        lists: list[list[int]] = []
        for w, s in zip(words.take(pa.array(rest >> 1)).to_pylist(), (rest & 1).tolist(), strict=True):
            lists.append([put(x, len(token)) for x in SPLIT.findall(" " + w if s else w)])
        at = np.full(2 * size, -1, np.int64)
        at[2 * plain + 1] = np.arange(len(plain))
        at[rest] = len(plain) + np.arange(len(rest))
        base = len(plain) + len(rest)
        special_seg = {}
        for i, x in enumerate(extra):
            if x[0] == "\0" and x[1:] in self.special:
                special_seg[base + i] = self.special[x[1:]]
                lists.append([0])  # any pre-token; its id is set below
            else:
                lists.append([put(p, len(token)) for p in SPLIT.findall(x)])
        per.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        flat = np.concatenate([flat, count + np.fromiter((x for s in lists for x in s), np.int64, int(per[1].sum()))])
        pre_off = np.concatenate([[0], np.cumsum(np.concatenate(per))])
        raw = [x.encode("utf-8", "surrogatepass") for x in token]
        spaced_off, spaced_data = buffers(spaced)
        b_off = np.concatenate([spaced_off, spaced_off[-1] + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        tok_off, tok_ids = self.merge(b_off, np.concatenate([spaced_data, np.frombuffer(b"".join(raw), np.uint8)]))
        t_off, seg_ids = ragged_take(tok_off, tok_ids, flat)
        seg_off = t_off[pre_off]
        for s, i in special_seg.items():
            seg_ids[seg_off[s]] = i  # "." is one token
        if own:
            parts = [base + np.asarray(own[d], np.int64) if slow[d] else at[segment[off[d] : off[d + 1]]] for d in range(n)]
            index, doc_off = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, n))])
        else:
            index, doc_off = at[segment], off
        o, ids = ragged_take(seg_off, seg_ids, index)
        return o[doc_off], ids

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of some ids; invalid bytes become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace").encode()


_codecs: dict[str, Codec] = {}


class Shared:
    """A broadcast table under a name of its own."""

    def __init__(self, df: DataFrame, path: str):
        self.key = uuid.uuid4().hex
        self.table = df.sparkSession.sparkContext.broadcast(load_table(path))


def share(df: DataFrame, path: str) -> Shared:
    """Broadcasts the table of a tokenizer file (about 2 MB); executors need not see the file."""
    return Shared(df, path)


def codec_of(shared: Shared) -> Codec:
    """One codec for each table and Python worker."""
    if shared.key not in _codecs:
        _codecs.clear()
        _codecs[shared.key] = Codec(shared.table.value)
    return _codecs[shared.key]


_KINDS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """One row per row: the id column and the outputs asked for.

    ``ids``: the token ids; ``n_tokens``: their number; ``decoded``: the text that they decode to; ``ids_sha256`` and
    ``decoded_sha256``: lowercase hex digests of the decimal ids joined by commas, and of the decoded text in UTF-8.
    """
    shared = share(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in blocks(batches, "text"):
            off, ids = codec.encode(text_column(b, "text"))
            out: dict[str, list] = {k: [] for k in outputs}
            for i in range(b.num_rows):
                own = ids[off[i] : off[i + 1]].tolist()
                decoded = codec.decode(own) if {"decoded", "decoded_sha256"} & out.keys() else b""
                for k, v in out.items():
                    v.append(len(own) if k == "n_tokens" else own if k == "ids" else decoded.decode() if k == "decoded" else hashlib.sha256(",".join(map(codec.decimals.__getitem__, own)).encode() if k == "ids_sha256" else decoded).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names=["id", *out])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, " + ", ".join(f"{k} {_KINDS[k]}" for k in outputs))
    return rows.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text that the ids decode to (null or no ids: the empty text)."""
    shared = share(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            text = [codec.decode(x or []).decode() for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, out_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, StringType())]))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
