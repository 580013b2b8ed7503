"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table (at most ``max_labelled`` urls, an error beyond that) and scored with
built-in functions alone. Weights are integers, so any engine that follows the formula gives the same verdicts.

A url that is null or has no ``://`` has an empty host and path and no n-grams; the bias decides. Repeated rows give
repeated results; columns other than the id and the url are not read. Very long urls are scored whole, all their n-grams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the n-gram hash (a prime), n-gram size, multiplier, and the scale of integer weights.
DIM, GRAM, MULTIPLIER, SCALE = 4093, 4, 257, 1 << 12

#: The rules of the query, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: A small labelled table (1: block), of general words; it holds no host of any table that the filter is applied to.
_SPAM = "cheap casino free spam ads adult poker pills bonus link click porn slots meds spins seo banner dating loan viagra win farm track bets popup cams cash prize xxx replica".split()
_PLAIN = "library recipes weather history garden museum theatre harbour science school music travel health forest books cinema farmers railway county hospital chess poetry garage bakery sailing nature village energy physics teachers football painting archive church valley bridge market coffee winter island".split()
_FORMS = (("www.", "com", "en", ""), ("", "org", "de", "/"), ("m.", "net", "fr", ".html"), ("blog.", "com", "es", ""), ("", "net", "en", "/"), ("www.", "org", "fr", ""))


def paired(words: list[str], step: int) -> list[str]:
    """Names of two words each, most with a hyphen."""
    return [w + ("-" if (i + step) % 3 else "") + words[(i + step) % len(words)] for i, w in enumerate(words)]


def opaque(n: int) -> list[str]:
    """Names that mean nothing, as many sites have."""
    return ["".join("bcdfgklmnprstvz"[(7 * i + 5 * j + i // 15) % 15] + "aeiou"[(3 * i + 2 * j) % 5] for j in range(2 + i % 3)) for i in range(n)]


def labelled(blocked: list[str], allowed: list[str]) -> list[tuple[str, int]]:
    """Two urls of each name; both classes have the same forms and paths."""
    return [(f"http{'s' * (i % 2)}://{pre}{name}.example.{top}/{lang}/{1000 + 577 * (i % 10)}{end}", label) for label, names in ((1, blocked), (0, allowed)) for i, name in enumerate(names) for pre, top, lang, end in (_FORMS[i % 6], _FORMS[(i + 3) % 6])]


LABELLED = tuple(labelled(_SPAM + paired(_SPAM, 3) + paired(_SPAM, 11), _PLAIN + paired(_PLAIN, 3) + paired(_PLAIN, 11) + opaque(120)))


def _grams(text: str, seed: int) -> list[int]:
    """The n-gram hashes of a text; ``_gram_column`` is the same for columns."""
    c = [ord(x) for x in f"^{text}$"] if text else []
    return [(sum(c[i + j] * MULTIPLIER ** (GRAM - 1 - j) for j in range(GRAM)) + seed) % DIM for i in range(len(c) - GRAM + 1)]


def fit(labelled: list[tuple[str, int]], steps: int = 300, rate: float = 40.0, decay: float = 1e-4, max_labelled: int = 10_000, margin: float = 0.3) -> list[int]:
    """Weights by gradient descent on the mean n-gram of host and path: DIM integers, then the bias.

    ``margin``: the log-odds that a url must exceed to be blocked, taken off the bias; opaque names that the model hasn't
    seen score up to about 0.3.
    """
    if len(labelled) > max_labelled:
        raise ValueError(f"{len(labelled)} labelled urls; at most {max_labelled} are taken")
    rows = []
    for url, y in labelled:
        host, path = split_url(url)
        x: dict[int, float] = {}
        for text, seed in ((host, 1), (path, 2)):
            grams = _grams(text, seed)
            for h in grams:
                x[h] = x.get(h, 0.0) + 1 / len(grams)
        rows.append((x, y))
    positive = max(1, sum(y for _, y in rows))
    balance = {1: 0.5 / positive, 0: 0.5 / max(1, len(rows) - positive)}
    w, bias = [0.0] * DIM, 0.0
    for _ in range(steps):
        grad: dict[int, float] = {}
        up = 0.0
        for x, y in rows:
            z = bias + sum(w[h] * v for h, v in x.items())
            e = balance[y] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            up += e
            for h, v in x.items():
                grad[h] = grad.get(h, 0.0) + e * v
        bias -= up
        for h, g in grad.items():
            w[h] -= rate * (g + decay * w[h])
    return [round(SCALE * v) for v in w] + [round(SCALE * (bias - margin))]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one labelled url; ``host_of`` and ``path_of`` are the same for columns."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _letters(text: Column) -> Column:
    """Code points of a padded text; none of an empty one."""
    each = F.transform(F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), 0), lambda c: F.ascii(c).cast("long"))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(each)


def _total(letters: Column, weights: Column, seed: int) -> tuple[Column, Column]:
    """Sum of the weights of a part's n-grams, and their number, 1 at least."""
    n = F.greatest(F.size(letters) - (GRAM - 1), F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def weight(i: Column) -> Column:
        h = F.lit(seed).cast("long")
        for j in range(GRAM):
            h = h + F.get(letters, i + j) * F.lit(MULTIPLIER ** (GRAM - 1 - j))
        return F.get(weights, (h % DIM).cast("int"))

    return F.aggregate(starts, F.lit(0).cast("long"), lambda acc, i: acc + weight(i)), F.greatest(n, F.lit(1)).cast("long")


def judge_urls(df: DataFrame, weights: list[int], rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: the id, ``host``, ``path``, ``rule`` (that decided, or null), ``verdict`` and ``model_blocks`` (what the model alone says).

    A rule holds for its host and the subdomains, where the path starts with the rule's; the longest wins.
    """
    table = F.expr("array(" + ", ".join(f"{w}L" for w in weights[:-1]) + ")")  # folded into one constant
    parts = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumns({"host_letters": _letters(F.col("host")), "path_letters": _letters(F.col("path"))})
    (hs, hn), (ps, pn) = _total(F.col("host_letters"), table, 1), _total(F.col("path_letters"), table, 2)
    parts = parts.select(id_col, "host", "path", hs.alias("hs"), hn.alias("hn"), ps.alias("ps"), pn.alias("pn"))
    rule: Column | None = None
    verdict: Column | None = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    # bias + hs / hn + ps / pn in whole numbers
    total = F.lit(weights[-1]).cast("long") * F.col("hn") * F.col("pn") + F.col("hs") * F.col("pn") + F.col("ps") * F.col("hn")
    by_model = F.when(total > 0, "block").otherwise("allow")
    return parts.select(id_col, "host", "path", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), F.coalesce(verdict, by_model).alias("verdict") if verdict is not None else by_model.alias("verdict"), (total > 0).alias("model_blocks"))


_WEIGHTS: list[int] = []


def default_weights() -> list[int]:
    """The weights for LABELLED; fitted once a process."""
    if not _WEIGHTS:
        _WEIGHTS.extend(fit(list(LABELLED)))
    return _WEIGHTS


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_weights())


def oracle() -> str:
    w = default_weights()

    def total(part: str, seed: int) -> str:
        h = " + ".join(f"{part}[i + {j}] * {MULTIPLIER ** (GRAM - 1 - j)}" for j in range(GRAM))
        return f"coalesce(list_sum([w[(({h} + {seed}) % {DIM}) + 1] for i in range(1, greatest(len({part}) - {GRAM - 2}, 1))]), 0)::BIGINT"

    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = [f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}'))" for _, t in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, (_, t) in zip(fits, rules, strict=True)) + " END"
    kind = "CASE " + " ".join(f"WHEN {f} THEN '{k}'" for f, (k, _) in zip(fits, rules, strict=True)) + " WHEN total > 0 THEN 'block' ELSE 'allow' END"
    return f"""
WITH weights AS (SELECT {w[:-1]} AS w),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
letters AS (
  SELECT *, CASE WHEN host = '' THEN [] ELSE [unicode(x)::BIGINT for x in string_split('^' || host || '$', '')] END AS hl,
         CASE WHEN path = '' THEN [] ELSE [unicode(x)::BIGINT for x in string_split('^' || path || '$', '')] END AS pl
  FROM parts),
sums AS (
  SELECT page_id, host, path, {total('hl', 1)} AS hs, greatest(len(hl) - {GRAM - 1}, 1) AS hn, {total('pl', 2)} AS ps, greatest(len(pl) - {GRAM - 1}, 1) AS pn
  FROM letters, weights),
totals AS (SELECT *, {w[-1]} * hn * pn + hs * pn + ps * hn AS total FROM sums)
SELECT page_id, host, path, {rule} AS rule, {kind} AS verdict, total > 0 AS model_blocks FROM totals"""


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE_SQL = {"op2_url_filter": oracle}
