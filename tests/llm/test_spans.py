"""Marked spans leave the texts."""

from __future__ import annotations

from tabulon.llm import decontamination


def test_short_items_are_cut_out_of_texts(spark):
    docs = spark.createDataFrame([(1, "before Four short item words after"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "Four short item words")], "item_id string, text string")
    found = decontamination.find_items(docs, items)
    got = {r["doc_id"]: r["text"] for r in decontamination.without_spans(found).collect()}
    assert got == {1: "before  after", 2: "nothing here", 3: None}
    kept = {r["doc_id"]: r["text"] for r in decontamination.without_spans(found, longest=13).collect()}
    assert kept[1] == "before Four short item words after"
