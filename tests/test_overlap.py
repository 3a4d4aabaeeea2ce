from refloom.plans import catalogue


def test_every_pair_that_shares_a_word(spark, tmp_path):
    """No word is too frequent: five copies of an item and all documents meet, on a word that all items have."""
    items = [(i, "common words here") for i in range(5)] + [(5, "common ünique term"), (6, "nothing alike"), (7, "42"), (8, None)]
    docs = [(10, "a common tale"), (11, "words, words and common unique words here"), (12, "apart"), (13, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.item_id, r.doc_id): r.overlap for r in catalogue.title_overlap_score(spark, str(tmp_path)).collect()}
    assert found == {(i, 10): 0.33 for i in range(6)} | {(i, 11): 1.0 for i in range(5)} | {(5, 11): 0.67}
