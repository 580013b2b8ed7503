"""N-gram Jaccard join by filters under several global token orders.

A document's set holds the hashes of its distinct 5-word shingles. Documents with equal sets are one node. Then:

1. Shingles that only one node holds can't be shared. Which those are comes from the exchange of ``exchange`` (32 bits a
   shingle; a chance match only weakens the filter). A node with more of them than a partner may lack is done.
2. Those that are left count, in the same way, how many of them hold each shingle; that is the rarity that orders use.
   Shingles that only one of them holds are left out, and nodes that then can't reach the threshold, too.
3. Two nodes whose similarity reaches the threshold share a token among the first |A| - ceil(t|A|) + 1 of each, under
   any global order of tokens. A pair is a candidate only if it shares such a prefix token under each of three orders:
   by rarity; by powers of two of rarity and another hash; by rarity among the nodes that meet. To bring pairs together
   without listing them, nodes are first dealt to cells: those that share prefix tokens under the first order, directly
   or through others, and under the second within these cells. Cells only say who meets; the three filters are
   intersected pair by pair where nodes meet, and what is left is verified by the exact size of the intersection.
4. Links are what components need: a node is only compared with those that it isn't yet connected with, and lists of
   holders that are one class are passed over, so a group of near copies takes about as many comparisons as it has
   members. Cells of more than CELL_TOKENS are split into chunks: each chunk meets itself and the first one; then, of
   nodes that aren't in the cell's main class, chunks meet all others. So a giant group of near copies is read twice,
   not once for each of its chunks. Nothing is capped: every candidate pair that could connect two components is
   verified.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Documents with fewer words than a shingle are their whole sequence;
null, empty and blank texts have no shingles and are linked with nothing; very long texts are read whole. Counts of
holders stop at 255 a bucket, which only bears on the order of tokens. Repeated rows are copies; rows with one id and
different texts are documents each; rows with a null id are compared too, but no component is named after them, and
their own ``component_id`` is null. Columns other than the id and the text are not read. Ids are whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipper.llm.common import cut, mix, ragged_take, window_hashes, word_codes, word_hashes
from dipper.llm.components import components
from dipper.llm.exchange import answer, deal, deal_buckets, read_bitmaps, shard_slices, with_answers

#: Bytes of text, and of prefix tokens, for which one shard is made.
SHARD_BYTES = 16 << 20
#: Tokens of the nodes in one chunk of a cell.
CELL_TOKENS = 1_000_000
_PREFIX = np.dtype([("token", "<u8"), ("node", "<i8")])


def shingle_sets(text: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text, ragged and ascending: (offsets, hashes)."""
    off, codes, words = word_codes(text, lower=True)
    h = word_hashes(words)[codes]
    grams = window_hashes(h, n)
    sets = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            sets.append(window_hashes(h[a:b], b - a, 100 + b - a) if b > a else np.zeros(0, np.uint64))
    return np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest tokens that a set of n shares with one that it links with: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def shard_count(total: int) -> int:
    """A power of two, so that the top bits of a token are its shard and the next 32 tell it from others there."""
    return 1 << max(5, (-(-total // SHARD_BYTES) - 1).bit_length())


def pack(keys: np.ndarray, holders: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Ascending tokens by shard: differences of 32 bits, byte by byte, and the numbers of holders up to 255; about 3 bytes a token."""
    bits = shards.bit_length() - 1
    short = (keys >> np.uint64(32 - bits)).astype(np.uint32)
    few = np.minimum(holders, 255).astype(np.uint8)
    for s, c in shard_slices(keys, shards):
        step = np.diff(short[c], prepend=np.uint32(0)).astype("<u4")
        yield s, zlib.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes() + few[c].tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4")[:, 0], dtype=np.uint32), planes[4]


def total_holders(arrays: list[bytes]) -> list[np.ndarray]:
    """For each array that a shard got, in how many documents of all arrays its tokens are."""
    parts = [unpack(a) for a in arrays]
    _, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([h for _, h in parts]))[inverse].astype("<u4")
    return np.split(total, np.cumsum([len(k) for k, _ in parts])[:-1])


class Bucket:
    """The sets of one bucket's documents."""

    def __init__(self, table: pa.Table, n: int, shards: int):
        order = pc.sort_indices(table, sort_keys=[("id", "ascending")])
        table = table.take(order)
        self.ids = table.column("id")
        self.text_hash = pc.struct_field(table.column("rest"), "text_hash")
        self.off, self.tokens = shingle_sets(table.column("text").combine_chunks().cast(pa.large_string()), n)
        self.n = np.diff(self.off)
        filled = np.flatnonzero(self.n > 0)
        self.hi, self.lo = np.zeros(len(self.n), np.uint64), np.zeros(len(self.n), np.uint64)
        if len(filled):
            at = self.off[:-1][filled]
            self.hi[filled] = mix(np.add.reduceat(mix(self.tokens, 31), at), 5) ^ self.n[filled].astype(np.uint64)
            self.lo[filled] = np.add.reduceat(mix(self.tokens, 57), at)
        # the first row of each set in the bucket, the one of least id, stands for the node
        node = np.lexsort((np.arange(len(self.n)), self.lo, self.hi))
        new = np.concatenate([[True], (self.hi[node][1:] != self.hi[node][:-1]) | (self.lo[node][1:] != self.lo[node][:-1])]) if len(node) else np.zeros(0, bool)
        self.first = np.zeros(len(self.n), bool)
        self.first[node[new]] = True
        self.first &= self.n > 0
        _, flat = ragged_take(self.off, self.tokens, np.flatnonzero(self.first))
        self.keys, self.holders = np.unique(flat, return_counts=True)
        self.shards = shards

    def sent(self) -> Iterator[tuple[int, bytes]]:
        return pack(self.keys, self.holders, self.shards)

    def slices(self) -> list[tuple[int, int]]:
        """(shard, number of keys) of what was sent."""
        return [(s, c.stop - c.start) for s, c in shard_slices(self.keys, self.shards)]


def prefixes(n: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the node of each token, how many tokens each node's prefix has, which places of a node's sequence are in it).

    Tokens are those that other nodes hold; the ``n - len`` others come first in every order.
    """
    have = np.diff(off)
    take = np.minimum(have, have - least_common(n, percent) + 1).clip(0)
    return np.repeat(np.arange(len(n)), have), take, np.arange(off[-1]) - np.repeat(off[:-1], have) < np.repeat(take, have)


def second_order(tokens: np.ndarray, scale: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each node's tokens lie by the second order: by powers of two of rarity, then by a hash of its own."""
    return np.lexsort((mix(tokens, 1002), scale, of))


def prefix_entries(n: np.ndarray, off: np.ndarray, tokens: np.ndarray, scale: np.ndarray, nodes: np.ndarray, cells: np.ndarray | None, order: int, percent: int) -> np.ndarray:
    """The first tokens of each node under one order, as (token in its cell, node). Tokens lie in the first order."""
    of, _, keep = prefixes(n, off, percent)
    at = np.flatnonzero(keep) if order == 1 else second_order(tokens, scale, of)[keep]
    token = mix(tokens[at], 1000 + order)
    out = np.zeros(len(at), _PREFIX)
    out["token"] = token if cells is None else mix(token ^ mix(cells.astype(np.uint64)[of[at]], 9), 3)
    out["node"] = nodes[of[at]]
    return out


def star_edges(entries: np.ndarray) -> np.ndarray:
    """(node, least node) for nodes that share a token, each once."""
    entries = entries[np.lexsort((entries["node"], entries["token"]))]
    if not len(entries):
        return np.zeros((0, 2), np.int64)
    start = np.concatenate([[True], entries["token"][1:] != entries["token"][:-1]])
    hub = entries["node"][np.flatnonzero(start)][np.cumsum(start) - 1]
    pairs = np.stack([entries["node"], hub], axis=1)[entries["node"] != hub]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def link_cell(n: np.ndarray, off: np.ndarray, tokens: np.ndarray, scale: np.ndarray, percent: int, side: np.ndarray | None = None, inner: bool = False, known: np.ndarray | None = None) -> np.ndarray:
    """The first node of its class, for each node that meets here; verified links make classes. Tokens lie in the first order.

    ``side``: 0 or 1; only pairs of both sides are compared, and, with ``inner``, those within side 1. ``known``: nodes with
    equal numbers are one class from the start. Work follows the lists of holders, not the number of pairs.
    """
    m = len(n)
    label = np.arange(m) if known is None else (lambda u: u[1][u[2]])(np.unique(known, return_index=True, return_inverse=True))
    if m < 2:
        return label
    members: dict[int, list[int]] = {}
    for i, c in enumerate(label.tolist()):
        members.setdefault(c, []).append(i)
    _, local = np.unique(tokens, return_inverse=True)
    df = np.bincount(local)
    of, take, keep = prefixes(n, off, percent)
    head = np.concatenate([[0], np.cumsum(take)])
    orders = [local[keep], local[second_order(tokens, scale, of)][keep], local[np.lexsort((local, df[local], of))][keep]]
    mine = orders[2]  # candidates come from the lists of the last order, and must pass the others
    by = np.argsort(mine, kind="stable")
    holder = np.repeat(np.arange(m), take)[by]
    lists = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=len(df)))])
    filled = np.flatnonzero(np.diff(lists))
    mask = np.zeros(len(df), bool)
    done = np.zeros(m, bool)
    # Nodes made of what most others hold come first: they connect the most.
    weight = np.add.reduceat(df[local], off[:-1]) / np.maximum(np.diff(off), 1)
    todo = np.argsort(-weight, kind="stable")
    todo = todo[take[todo] > 0]
    if not len(todo):
        return label
    hub, step = int(todo[0]), 1

    def shared(offsets: np.ndarray, values: np.ndarray, y: int, near: np.ndarray) -> np.ndarray:
        """How many of y's values each of ``near`` has."""
        own = values[offsets[y] : offsets[y + 1]]
        mask[own] = True
        o, flat = ragged_take(offsets, values, near)
        count = np.add.reduceat(mask[flat].astype(np.int64), o[:-1])
        mask[own] = False
        return count

    while len(todo):
        # lists whose holders are one class give nothing any more
        classes = label[holder]
        mixed = np.zeros(len(df), bool)
        mixed[filled] = np.minimum.reduceat(classes, lists[filled]) != np.maximum.reduceat(classes, lists[filled])
        some = np.concatenate([[0], np.cumsum(mixed[mine])])[head]
        todo = todo[some[todo + 1] > some[todo]]
        batch, todo, step = todo[:step].tolist(), todo[step:], 2 * step
        for y in batch:
            # nodes of the first one's class meet the others when it's their turn
            if label[y] == label[hub] and y != hub:
                continue
            done[y] = True
            own = mine[head[y] : head[y + 1]]
            own = own[mixed[own]]
            start, length = lists[own], lists[own + 1] - lists[own]
            at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - start, length)
            near = holder[at]
            near = near[(label[near] != label[y]) & ~done[near]]
            if side is not None:
                near = near[(side[near] != side[y]) | (inner & (side[near] == 1) & (side[y] == 1))]
            near = near[(100 * n[near] >= percent * n[y]) & (100 * n[y] >= percent * n[near])]
            near = np.unique(near)
            for values in orders[:2]:
                if len(near):
                    near = near[shared(head, values, y, near) > 0]
            if not len(near):
                continue
            common = shared(off, local, y, near)
            for z in near[100 * common >= percent * (n[near] + n[y] - common)].tolist():
                a, b = int(label[y]), int(label[z])
                if a != b:
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    label[members[b]] = a
                    members[a] += members.pop(b)
    return label


def count_holders(held: DataFrame, columns: Callable, total: int, percent: int) -> DataFrame:
    """(node, n, tokens, scale): of each node's tokens those that other nodes of ``held`` hold, the rarest first, ties by a hash.

    ``scale``: the power of two of each one's number of holders. Nodes that share too few tokens are left out. ``total``: the
    bytes of all tokens, about.
    """
    shards = shard_count(total)
    dealt = deal_buckets(held.select("node", "n", "tokens"), F.xxhash64("node"), total)

    def send(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        return pack(*np.unique(columns(table)[2], return_counts=True), shards)

    def judge(arrays: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in total_holders(arrays)]

    def apply(table: pa.Table, said: pa.Table) -> pa.Table:
        n, off, tokens, node = columns(table)
        keys = np.unique(tokens)
        by_shard = dict(zip(said.column("at_shard").to_pylist(), said.column("said").to_pylist(), strict=True)) if said.num_rows else {}
        holders = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(by_shard[s], "<u4") for s, _ in shard_slices(keys, shards))])[np.searchsorted(keys, tokens)]
        shared = holders > 1
        many = np.concatenate([[0], np.cumsum(shared)])[off]
        keep = np.diff(many) >= least_common(n, percent)
        of = np.repeat(np.arange(len(n)), np.diff(off))
        left = np.flatnonzero(shared & keep[of])
        left = left[np.lexsort((mix(tokens[left], 1001), holders[left], of[left]))]
        sorted_tokens, scale = tokens[left], np.frexp(holders[left])[1].astype(np.uint8)
        rows = np.flatnonzero(keep)
        ends = np.cumsum(np.diff(many)[rows])
        cuts = [slice(a, b) for a, b in zip((ends - np.diff(many)[rows]).tolist(), ends.tolist(), strict=True)]
        return pa.table({"node": pa.array(node[rows]), "n": pa.array(n[rows]), "tokens": pa.array([sorted_tokens[c].tobytes() for c in cuts], pa.binary()), "scale": pa.array([scale[c].tobytes() for c in cuts], pa.binary())})

    return with_answers(dealt, answer(dealt, send, judge), apply, "node long, n long, tokens binary, scale binary")


def _columns(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, offsets, tokens, nodes) of packed rows."""
    raw = table.column("tokens").to_pylist()
    off = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
    return table.column("n").to_numpy(), off, np.frombuffer(b"".join(raw), "<u8"), table.column("node").to_numpy()


def _scale(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("scale").to_pylist()), np.uint8)


def _cells(rows: DataFrame, order: int, shards: int, percent: int) -> DataFrame:
    """(node, cell) of nodes that share prefix tokens under an order, within their cells so far."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, off, tokens, node = _columns(b)
            old = b.column("cell").to_numpy() if "cell" in b.schema.names else None
            entries = prefix_entries(size, off, tokens, _scale(b), node, old, order, percent)
            of = (((entries["token"] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[by])) + 1
            parts = [(int(of[p[0]]), entries[p].tobytes()) for p in np.split(by, cuts) if len(p)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["shard", "packed"])

    def edges(table: pa.Table) -> pa.Table:
        found = star_edges(np.frombuffer(b"".join(table.column("packed").to_pylist()), _PREFIX))
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    found = components(rows.mapInArrow(send, "shard long, packed binary").groupBy("shard").applyInArrow(edges, "a long, b long"))
    return found.select(F.col("vertex").alias("node"), F.col("component").alias("cell"))


def _links(spread: DataFrame, keys: tuple[str, ...], inner: bool, percent: int) -> DataFrame:
    """(a, b) links that make the classes of nodes that meet: rows of equal ``keys``, with ``upper`` for their side."""

    def link(table: pa.Table) -> pa.Table:
        size, off, tokens, node = _columns(table)
        side = table.column("upper").to_numpy().astype(np.int64)
        known = table.column("known").to_numpy() if "known" in table.column_names else None
        label = link_cell(size, off, tokens, _scale(table), percent, side if side.any() else None, inner, known)
        first = node[label]
        some = first != node
        return pa.table({"a": pa.array(node[some]), "b": pa.array(first[some])})

    return spread.groupBy(*keys).applyInArrow(link, "a long, b long")


def _linked_cells(placed: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what is linked, of nodes ``placed`` in cells; ``sizes``: (cell, size in tokens)."""
    chunks = F.ceil(F.col("size") / CELL_TOKENS).cast("int")
    big = cut(sizes.select(F.col("cell").alias("big_cell"), chunks.alias("chunks")).where("chunks > 1"))
    rows = placed.join(big, F.col("cell") == F.col("big_cell"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    packed = ("node", "n", "tokens", "scale")
    # the first chunk meets itself and, beside each other one, that one
    meets = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))
    first = _links(rows.select("cell", F.explode(meets).alias("chunk"), (F.col("own") > 0).alias("upper"), *packed), ("cell", "chunk"), True, percent)
    if big.isEmpty():
        return first
    first = cut(first)
    known = components(first).select(F.col("vertex").alias("v"), "component")
    rest = rows.where("chunks > 1 and own > 0").join(known, F.col("node") == F.col("v"), "left").withColumn("known", F.coalesce("component", "node")).select("cell", "chunks", "own", "known", *packed)
    per_class = rest.groupBy("cell", "known").agg(F.sum(F.octet_length("tokens") / 8).alias("size"))
    main = per_class.groupBy("cell").agg(F.max(F.struct("size", "known")).alias("main"), F.sum("size").alias("size"))
    parts = F.ceil((F.col("size") - F.col("main.size")) / CELL_TOKENS).cast("int")
    main = main.select(F.col("cell").alias("of_cell"), F.col("main.known").alias("main"), parts.alias("parts")).where("parts > 0")
    rest = rest.join(main, F.col("cell") == F.col("of_cell"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    others = rest.where("known <> main").select("cell", part.alias("part"), F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("upper"), "known", *packed)
    every = rest.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("own").alias("chunk"), F.lit(True).alias("upper"), "known", *packed)
    return first.unionByName(_links(others.unionByName(every), ("cell", "part", "chunk"), False, percent))


def _classes(df: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents, sets): rows as (id, text_hash, n, hi, lo, row), and (hi, lo, least id, first) of each distinct set.

    ``first``: (no id, id, row, text_hash) of the least document of the set's class.
    """
    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    dealt = deal(whole, "id", "text", ("text_hash",))
    shards = shard_count(dealt.total)
    answers = answer(dealt, lambda t: Bucket(t, n, shards).sent(), lambda a: [np.packbits(x > 1).tobytes() for x in total_holders(a)])

    def judge(docs: pa.Table, said: pa.Table) -> pa.Table:
        b = Bucket(docs, n, shards)
        bits = read_bitmaps(said, b.slices())
        tokens: list[bytes | None] = [None] * len(b.n)
        for i in np.flatnonzero(b.first).tolist():
            own = b.tokens[b.off[i] : b.off[i + 1]]
            shared = own[bits[np.searchsorted(b.keys, own)]]
            if len(shared) >= least_common(b.n[i], percent):
                tokens[i] = shared.tobytes()
        row = (docs.column("bucket")[0].as_py() if docs.num_rows else 0) << 32
        return pa.table({"id": b.ids, "text_hash": b.text_hash, "row": pa.array(np.arange(row, row + len(b.n))), "n": pa.array(b.n), "hi": pa.array(b.hi.astype(np.int64)), "lo": pa.array(b.lo.astype(np.int64)), "tokens": pa.array(tokens, pa.binary())})

    docs = cut(with_answers(dealt, answers, judge, "id long, text_hash long, row long, n long, hi long, lo long, tokens binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "text_hash")).alias("first")
    # numbered once and kept, so that a lost task can't number them anew
    nodes = cut(docs.where("n > 0").groupBy("hi", "lo").agg(least).withColumn("node", F.monotonically_increasing_id()))
    # Each bucket gave the tokens to its least row of a set; the least of all has them.
    held = docs.where("tokens is not null").select("row", "n", "tokens").join(nodes.select(F.col("first.row").alias("first_row"), "node"), F.col("row") == F.col("first_row")).select("node", "n", "tokens")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]
    held = cut(count_holders(held, _columns, total, percent))
    second = _cells(held.join(_cells(held, 1, shards, percent), "node"), 2, shards, percent)
    sizes = held.select("node", (F.octet_length("tokens") / 8).alias("size")).join(second, "node").groupBy("cell").agg(F.sum("size").alias("size"))
    joined = components(_linked_cells(held.join(second, "node"), sizes, percent)).select(F.col("vertex").alias("v"), "component")
    linked = nodes.join(joined, F.col("node") == F.col("v"))
    best = linked.groupBy("component").agg(F.min("first").alias("class_first")).withColumnRenamed("component", "of_component")
    of_node = linked.join(best, F.col("component") == F.col("of_component")).select(F.col("node").alias("linked_node"), "class_first")
    sets = nodes.join(of_node, F.col("node") == F.col("linked_node"), "left").select("hi", "lo", F.coalesce("class_first", "first").alias("first"))
    return docs, sets


def _with_first(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Each document with the least one of its class; null where it has no shingles."""
    of_set = sets.select(F.col("hi").alias("h"), F.col("lo").alias("l"), "first")
    return docs.join(of_set, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left")


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``n_shingles`` and ``component_id``, the least id reachable by links of similarity ``percent`` / 100."""
    out = _with_first(*_classes(df, n, percent, id_col, text_col))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("first.id", "id")).alias("component_id"))


def keep_first(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` less all but one document of each class of near copies: the one of the least id, null ids last.

    Rows are told apart by id and text, so rows of one id with texts that aren't near copies stay, and of rows that are
    the same in both, one: that of the least hash of its other columns (but maps, which have none). Rows without words all
    stay.
    """
    found = _with_first(*_classes(df, n, percent, id_col, text_col)).where("n > 0")
    own = F.struct("id", "text_hash")
    gone = found.where(~own.eqNullSafe(F.struct("first.id", "first.text_hash"))).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.col(f"`{text_col}`").alias("own_text"))
    has_words = F.coalesce(F.col("own_text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    worded = rows.where(has_words).select("doc", "own_id", F.xxhash64("own_text").alias("own_hash"))
    others = [F.col("doc")[c] for c, kind in df.dtypes if c != text_col and "map<" not in kind]
    same = Window.partitionBy("own_id", "own_hash").orderBy(F.xxhash64(*others))
    worded = worded.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    left = worded.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti")
    return left.select("doc.*").unionByName(rows.where(~has_words).select("doc.*"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class that links of similarity 0.75 or more put it in."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHINGLE = "concat_ws(' ', word, " + ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 5)) + ")"
_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rn, doc_id,
         [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents),
words AS (SELECT rn, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
shingles AS (
  SELECT DISTINCT rn, k FROM (SELECT rn, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN {_SHINGLE} END AS k FROM words WINDOW o AS (PARTITION BY rn ORDER BY p)) WHERE k IS NOT NULL
  UNION ALL SELECT rn, array_to_string(words, ' ') FROM docs WHERE len(words) BETWEEN 1 AND 4),
sizes AS (SELECT rn, count(*) AS n FROM shingles GROUP BY rn),
common AS (SELECT a.rn AS x, b.rn AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.rn <> b.rn GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.rn = x JOIN sizes t ON t.rn = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
best AS (SELECT x AS rn, min(doc_id) AS m FROM reach JOIN docs ON docs.rn = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, m) AS component_id FROM docs LEFT JOIN sizes USING (rn) LEFT JOIN best USING (rn)"""

QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLE_SQL = {"op10_ngram_jaccard_join": _SQL}
