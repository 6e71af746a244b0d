from tracewright.llm import containment as ct


def test_blocks_are_bounded_by_bytes(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(400 if i % 5 == 0 else 20))) for i in range(60)]
    docs = spark.createDataFrame([(100 + i, "lead " + t + " tail") for i, t in items], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    blocks = [[(r.item_id, r.text) for r in b.collect()] for b in ct.item_blocks(asked, 25, 8000)]
    assert sorted(x for b in blocks for x in b) == items
    assert len(blocks) > 3 and all(len(b) <= 25 and sum(len(t) for _, t in b) <= 8000 for b in blocks)
    got = sorted((r.doc_id, r.item_id) for r in ct.contaminated(docs, asked, block_items=25, block_bytes=8000).collect())
    assert got == [(100 + i, i) for i, _ in items]


def test_long_items_and_copies_stand_alone(spark):
    asked = spark.createDataFrame([(1, "a " * 50), (1, "a " * 50), (2, "b " * 50), (3, "c")], "item_id long, text string")
    sizes = sorted(b.count() for b in ct.item_blocks(asked, 10, 30))
    assert sizes == [1, 1, 2]
    assert [b.count() for b in ct.item_blocks(asked.limit(0), 10, 30)] == [0]


def test_items_under_five_words_match_whole_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x a b c y z")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "A b c")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in ct.contaminated(docs, asked).collect()] == [(1, 7)]
