"""Top-k, URL filters, weak labels, components, SQL, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipper.llm import registry, topk, urlfilter, weak
from dipper.llm.components import components


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name]))


@pytest.mark.parametrize("big", [False, True])
def test_top_k(spark, big):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=20) * (1e5 if big else 1)], "extra") for i in range(300)]
    vectors += [(1000 + i, vectors[5][1], "copy") for i in range(30)]  # ties
    vectors += [(2000, None, ""), (2001, [1.0, None], ""), (2002, [float("nan")], ""), (2003, [float("inf")], ""), (2004, [], ""), (2005, [1.0], ""), (None, [1.0], ""), (7, vectors[7][1], "repeated")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, cell string")
    out = topk.top_k(df, F.col("vec_id") % 10 == 5, k=12).collect()
    ok = [(i, np.floor(np.array(v, object).astype(float) * 1024).astype(object).astype(int) if len(v) else []) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    want = []
    for q, a in ok:
        if q % 10 == 5:
            scored = sorted((-dot(a, b), i) for i, b in ok if i != q)[:12]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, out)) == sorted(want)
    many = spark.createDataFrame([(5, [float(i), 1.0]) for i in range(30)] + [(6, [2.0, float(i)]) for i in range(200)], "vec_id long, embedding array<double>")
    hot = topk.top_k(many, F.col("vec_id") == 5, k=3, scale=1).collect()
    assert len(hot) == 90 and sorted({(r["query_id"], r["rank"], r["vec_id"]) for r in hot}) == [(5, i, 6) for i in (1, 2, 3)]
    assert max(r["score"] for r in hot) == 29 * 2 + 199
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), F.lit(True), k=10).count() == 6


def test_url_filter(spark):
    urls = [("http://A.Example.org/es/1", "example.org/es/"), ("https://example.org/en/1?x", "example.org/en/1"), ("http://xexample.org/es/", "org/"), ("http://h.com/fr/#a", "com/fr/"), ("http://h.com/de", None), ("http://h.com/de/", "com/de/"), ("http://org", None), ("http://org/", "org/"), ("nothing", None), (None, None), ("", None), ("://", None), ("a://b://c/d", None), ("http://" + "x" * 50_000 + ".net/" + "y" * 50_000, None)]
    df = spark.createDataFrame([(i, u, 1, 2) for i, (u, _) in enumerate(urls)] + [(0, urls[0][0], 1, 2)], "page_id long, url string, host int, rule int")
    out = urlfilter.judge_urls(df, urlfilter.default_weights()).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert r["rule"] == urls[r["page_id"]][1]
        assert (r["host"], r["path"]) == urlfilter.split_url(urls[r["page_id"]][0])
        assert r["verdict"] in ("allow", "block")
    by = {r["page_id"]: r for r in out}
    assert by[0]["verdict"] == "block" and by[2]["verdict"] == "allow" and by[0]["host"] == "a.example.org"
    assert urlfilter.judge_urls(df.where("false"), urlfilter.default_weights()).count() == 0
    with pytest.raises(ValueError):
        urlfilter.fit([("a", 0)] * 3, max_labelled=2)


def test_url_model_on_names_it_has_not_seen(spark):
    spam, plain, odd = urlfilter._SPAM, urlfilter._PLAIN, urlfilter.opaque(120)
    weights = urlfilter.fit(urlfilter.labelled(spam + urlfilter.paired(spam, 3), plain + urlfilter.paired(plain, 3) + odd[:80]))
    held = urlfilter.labelled(urlfilter.paired(spam, 11), urlfilter.paired(plain, 11) + odd[80:])
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r["page_id"]: r["model_blocks"] for r in urlfilter.judge_urls(df, weights, ()).collect()}
    bad, good = [got[i] for i, (_, y) in enumerate(held) if y], [got[i] for i, (_, y) in enumerate(held) if not y]
    assert sum(bad) >= 0.8 * len(bad) and sum(good) <= 0.05 * len(good)


def test_url_table_holds_no_host_of_the_pages(spark, sf_dir):
    hosts = {r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select(urlfilter.host_of(F.col("url"))).distinct().collect()}
    known = {urlfilter.split_url(u)[0] for u, _ in urlfilter.LABELLED}
    name = lambda host: host.split(".example.")[0].rpartition(".")[2]
    assert not {name(h) for h in hosts} & {name(h) for h in known}


def test_expectation_maximisation():
    rng = random.Random(1)
    patterns, truth = {}, {}
    for _ in range(5000):
        y = rng.random() < 0.8
        votes = [(1 if y == (rng.random() < a) else -1) if rng.random() < 0.9 else 0 for a in (0.95, 0.85, 0.7, 0.6)]
        key = weak.votes_key(votes)
        patterns[key] = patterns.get(key, 0) + 1
        truth.setdefault(key, []).append(y)
    p, says = weak.posteriors(patterns)
    assert sum(sum(y == (p[k] >= 0.5) for y in ys) for k, ys in truth.items()) > 0.92 * 5000
    assert says[0, 0, 2] > says[0, 2, 2] > says[0, 3, 2]
    assert weak.posteriors({}) [0] == {} and len(weak.fit_logistic([], 3)) == 4


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5, 5), (2000, 2000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["vertex"]: r["component"] for r in got} == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_first(rows):
    """(id, text) rows less all but the least of each class of near copies; nulls last; one of rows that are the same."""
    from tests.llm.test_text_operators import WORD, brute_classes

    worded = sorted({r for r in rows if WORD.search(r[1] or "")}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    classes = brute_classes([(k, t) for k, (_, t) in enumerate(worded)])
    return [worded[k] for k in range(len(worded)) if classes[k][2] == k] + [r for r in rows if not WORD.search(r[1] or "")]


def test_near_duplicates_with_one_id(spark):
    from dipper.llm import jaccard

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text of its own"), (1, "another that shares no word with it"), (1, "another that shares no word with it"), (2, long), (1, long + " end"), (3, long), (None, long + " more"), (None, "alone"), (None, "alone"), (4, None), (4, ""), (5, " "), (5, " "), (None, None)]
    df = spark.createDataFrame([(*r, i, "x", 0) for i, r in enumerate(rows)], "doc_id long, text string, gone long, copy string, own_id int")
    out = jaccard.keep_first(df)
    assert out.columns == df.columns
    want = [(1, "one text of its own"), (1, "another that shares no word with it"), (1, long + " end"), (None, "alone"), (4, None), (4, ""), (5, " "), (5, " "), (None, None)]
    assert sorted([tuple(r)[:2] for r in out.collect()], key=repr) == sorted(want, key=repr)
    assert jaccard.keep_first(df.where("false")).count() == 0


def test_pipeline_is_its_stages_by_brute_force(spark, docs, rows, tmp_path, bpe_path):
    import collections

    import corpus_pipeline
    from tests.llm.test_text_operators import brute_lines
    from tokenizers import Tokenizer

    from dipper.llm import pii, quality

    sf = str(tmp_path)
    # rows of one id with texts of their own, and a column that stages use the name of
    more = spark.createDataFrame([(1, "a second text of the first document " + " ".join(map(str, range(20)))), (1, "third text of it, like none of the others at all")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "'g' as gone")
    table = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'g' as gone").unionByName(more)
    table.write.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    model, _ = quality.fit(table)
    left = [(r["doc_id"], r["text"]) for r in table.collect() if model.score(*quality.describe((r["text"] or "").encode())) >= model.threshold]
    left = [(i, x[2]) for (i, _), x in zip(left, brute_lines([t for _, t in left], 10))]
    unique = brute_first(left)
    assert sum(i == 1 for i, _ in unique) >= 2
    weights = pii.fit(spark.createDataFrame(unique, "doc_id long, text string"))
    final = [(i, pii.masked(t or "", found) if (found := pii.all_spans(t or "", weights)) else t or "") for i, t in unique]
    lib = Tokenizer.from_file(bpe_path)
    want = collections.Counter()
    for i, t in final:
        want[i] += len(lib.encode(t, add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    stage = dict(corpus_pipeline.STAGES)["line dedup"](spark, table, sf)
    assert stage.columns == table.columns and stage.where("n_chars <> length(text)").count() == 0


def test_pipeline_on_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs.where("false").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
