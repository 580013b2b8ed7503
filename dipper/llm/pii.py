"""Personal data: weak-supervision aggregation of span labellers.

Candidate spans come from strict patterns (the base) and looser ones. On each, labellers vote: the strict pattern with
its checks, gazetteers (domain endings, issuer prefixes, reserved networks, area codes), cue words before the span, its
borders, and its shape. Expectation-maximisation over the counts of all vote patterns of a kind estimates the labellers'
reliabilities; posteriors train the final span classifier, a logistic model on discrete features of the span. Its
training table holds each combination of votes and features once with its count, over all documents, and is bounded by
their number of combinations. Base spans stay whatever it says; a span that fails its base check
(such as a card's check digit) is a lesson for the labellers, but never added; of the looser ones, it adds those that
it believes and that overlap no base span.

Null texts count as empty and have no spans; very long texts are searched whole. Cue words are, by definition, those in the
40 characters before a span. Positions are code points, ends exclusive. Repeated rows give repeated
results. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipper.llm.common import blocks, text_column
from dipper.llm.weak import fit_logistic, posteriors, votes_key

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They match what the plain ones do, in time that is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOT = re.compile("dot", re.IGNORECASE)
# Looser ones.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]++)++", re.IGNORECASE)
# National numbers: an area code and two groups, with or without a trunk prefix.
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:(?:1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?[ /-][0-9]{3,4}[ -][0-9]{3,5})(?![0-9-])")

# Gazetteers and cue words.
_ENDINGS = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es it nl eu ch at pl se no ca au us jp in br mx".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38", "22", "23", "24", "25", "26", "27", "50", "56", "57", "58", "62")
_CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "client", "login", "from"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon"),
}
_AGAINST = ("isbn", "version", "invoice", "order", "serial", "ref", "item")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(matches that pass their check, matches that fail it), leftmost and non-overlapping within a kind."""
    good: list[tuple[str, int, int]] = []
    bad: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            good.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return good, bad
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        (good if ok else bad).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            (good if luhn(digits) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(map(m[0].count, "0123456789"))
            (good if 9 <= n <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that only the looser patterns match, of whatever length."""
    found = [("email", *m.span()) for m in _SPELT.finditer(text)] if _DOT.search(text) else []
    return found + ([("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)] if _DIGIT.search(text) else [])


def label(text: str, span: tuple[str, int, int], strict: int) -> tuple[str, tuple[int, ...]]:
    """Votes on a span, and its features. ``strict``: 1 passed the base check, -1 failed it, 0 matched a looser pattern."""
    kind, a, b = span
    body = text[a:b]
    digits = re.sub("[^0-9]", "", body)
    before = text[max(0, a - 40) : a].lower()
    if kind == "email":
        gazetteer = 1 if body.rpartition(".")[2].rpartition(" ")[2].lower() in _ENDINGS else -1
        shape = 1 if len(body) <= 80 and ".." not in body else -1
    elif kind == "ip":
        first = int(digits[:3]) if (head := body.partition(".")[0]) and len(head) > 3 else int(head)
        gazetteer = -1 if first == 0 or first >= 224 else 1
        shape = -1 if any(len(p) > 1 and p[0] == "0" for p in body.split(".")) else 1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(_ISSUERS) else -1
        shape = 1 if len(digits) in (15, 16) else -1
    else:
        gazetteer = 1 if 10 <= len(digits) <= 13 else -1
        shape = 1 if re.search("[ ().-]", body) else 0
    context = 1 if any(c in before for c in _CUES[kind]) else -1 if any(c in before for c in _AGAINST) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    border = -1 if left.isalnum() or right.isalnum() or right in ("@", "_") else 1
    votes = votes_key([strict, gazetteer, context, border, shape])
    spelt = kind == "email" and "@" not in body
    return votes, (KINDS.index(kind), min(len(digits), 19), min(b - a, 40) // 8, int(spelt), int(border > 0), int(gazetteer > 0), int(shape > 0), int(kind == "card" and luhn(digits)), context + 1)


_WIDTHS = (4, 20, 6, 2, 2, 2, 2, 2, 3)
_DIM = sum(_WIDTHS) + 4 * 2 * 2 * 2


def feature_index(features: tuple[int, ...]) -> dict[int, float]:
    """One-hot features, and the crossing of kind, border, gazetteer and checksum."""
    out, base = {}, 0
    for x, w in zip(features, _WIDTHS, strict=True):
        out[base + x] = 1.0
        base += w
    out[base + ((features[0] * 2 + features[4]) * 2 + features[5]) * 2 + features[7]] = 1.0
    return out


def fit(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights of the span classifier, from the votes on all candidate spans of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            seen: Counter = Counter()
            for text in text_column(b, "text").to_pylist():
                good, bad = base_spans(text)
                for spans, strict in ((good, 1), (bad, -1), (loose_spans(text), 0)):
                    for s in spans:
                        seen[label(text, s, strict)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in seen], pa.string()), pa.array([list(f) for _, f in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["votes", "features", "n"])

    rows = df.selectExpr(f"`{text_col}` as text").mapInArrow(run, "votes string, features array<int>, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    training = []
    for kind in range(len(KINDS)):
        own = sorted([(r["votes"], tuple(r["features"]), r["n"]) for r in rows if r["features"][0] == kind])
        patterns: Counter = Counter()
        for votes, _, n in own:
            patterns[votes] += n
        p, _ = posteriors(dict(patterns), trust=0.7, slip=0.1)
        training += [(feature_index(f), p[v], float(n)) for v, f, n in own]
    return fit_logistic(training, _DIM)


def believed(weights: np.ndarray, features: tuple[int, ...]) -> bool:
    return sum(weights[i] * v for i, v in feature_index(features).items()) + weights[-1] > 0


def _with_spans(starts: list[int], ends: list[int], spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Disjoint ascending spans and others, disjoint from them, as one list."""
    both = sorted([*zip(starts, ends, strict=True), *spans])
    return [a for a, _ in both], [b for _, b in both]


def all_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the classifier added it), by kind, then start."""
    good, _ = base_spans(text)
    out = [(*s, False) for s in good]
    # ends of the union of spans taken: they ascend, so one place tells whether a span is free
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in good):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    fresh = 0  # end of the last span added; looser spans of a kind ascend
    last = None
    for s in loose_spans(text):
        if s[0] != last:
            if last is not None:
                starts, ends = _with_spans(starts, ends, [x[1:3] for x in out if x[3]])
            last, fresh = s[0], 0
        i = bisect_right(ends, s[1])
        if s[1] >= fresh and (i == len(starts) or starts[i] >= s[2]) and believed(weights, label(text, s, 0)[1]):
            out.append((*s, True))
            fresh = s[2]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def masked(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones, the first and longest."""
    parts, at = [], 0
    for k, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def find_private(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id and ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e, "added": x} for k, s, e, x in all_spans(t, weights)] for t in text_column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,added:boolean>>")
    return out.withColumnRenamed("id", id_col)


def mask_private(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, with personal data in the text masked. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            at = b.schema.get_field_index(text_col)
            texts = [None if t is None else masked(t, found) if (found := all_spans(t, weights)) else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_private(docs, fit(docs))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: ~x["added"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
