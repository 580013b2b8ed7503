import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, id string, shard string, cell string, rest string, node string"


def corpus():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and lines, and repeated rows."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6)))
    words = lambda n: [word() for _ in range(n)]
    base = [words(rng.randint(30, 120)) for _ in range(30)]
    passage = words(60)
    texts = []
    for i, w in enumerate(base):
        texts.append(" ".join(w))
        texts += [" ".join(w)] * (i % 3)  # exact copies
        for _ in range(i % 4):  # near copies
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    texts += [" ".join(words(40) + passage + words(40)) for _ in range(12)]
    texts += ["Common Line \n" + " ".join(words(20)) + "\n  common line" for _ in range(11)]
    texts += [" ".join(["same"] * 200), "x y z w v " * 30, "Ab aB", "ab AB", "a b c d e", "A B c d E"]
    texts += [None, "", "   ", "\n", "\n\n", "\t a \x0b", " lead", "trail ", "two  spaces", "<|endoftext|> mid<|endoftext|>", "né\u00a0ö \u2003x \u3000y", "e\u0301\U0001f600 \x1c\x1d end", "word" * 30_000, "tab\tand\r\nline " * 3_000]
    texts += ["mail bob@example.com or +1 (415) 555-0132, card 4111 1111 1111 1111, host 10.20.30.40, bad 999.1.1.1 and 4111111111111112", "call (415) 555-0132 now", "v1.2.3.4.5 a@b a@b.c%x@d.e 12345"]
    rows = [(i, t, "en", "s", len(t or ""), i % 3, "i", "s", "c", "r", "n") for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows += [(None, "row without an id", None, None, None, None, None, None, None, None, None)] * 2
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def bpe_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")
