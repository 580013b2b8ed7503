"""Ids of many texts and texts of many ids spread over buckets; the least threshold of line dedup."""

from pyspark.sql import functions as F

from dipper.llm import jaccard, linededup
from dipper.llm.exchange import deal


def test_an_id_of_many_texts_fills_no_bucket(spark):
    one = spark.range(3000).selectExpr("7L as doc_id", "concat('text ', id) as text")
    for df in (one, one.withColumn("doc_id", F.lit(None).cast("long")), spark.range(3000).selectExpr("id as doc_id", "'same' as text")):
        counts = [r["count"] for r in deal(df, "doc_id", "text").rows.groupBy("bucket").count().collect()]
        assert len(counts) >= 32 and max(counts) < 300


def test_all_lines_go_where_one_document_is_enough(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nc"), (2, None)], "doc_id long, text string")
    out = linededup.drop_common_lines(df, min_docs=1).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, ""), (1, ""), (2, "")]


def test_the_row_kept_of_those_alike_in_id_and_text_is_the_same_in_any_order(spark):
    rows = [(1, "one two three four five six", f"from {i}", {"k": i}) for i in range(40)] + [(2, "seven", None, None), (2, "", "x", None), (2, "", "x", None)]
    schema = "doc_id long, text string, source string, extra map<string,int>"
    kept = [sorted((r["doc_id"], r["text"], r["source"] or "") for r in jaccard.keep_first(spark.createDataFrame(order, schema).repartition(n)).collect()) for order, n in ((rows, 1), (rows[::-1], 5))]
    assert kept[0] == kept[1] and len(kept[0]) == 4
