from quillspark.llm import leaks

WORDS = [f"w{i}" for i in range(60)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_passages_of_any_place_and_length(spark):
    item = " ".join(WORDS[:40])
    docs = [
        (1, "intro " * 30 + " ".join(WORDS[5:17]) + " outro" * 50),  # exactly twelve words
        (2, "intro " * 30 + " ".join(WORDS[5:16]) + " outro" * 50),  # eleven
        (3, " ".join(WORDS[:12]).upper()),  # nothing but the passage, other case
        (4, None), (5, ""), (6, "short text"), (7, "x " * 200_000 + ", ".join(WORDS[20:40])),  # very long
        (8, " ".join(WORDS[5:17])), (8, " ".join(WORDS[5:17])),  # a repeated row
    ]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item_id string")  # a clashing column
    i = spark.createDataFrame([(100, item, 1), (101, None, 1), (102, "", 1), (103, "too few words here", 1)], "item_id long, text string, doc_id int")
    assert rows(leaks.leaked_items(d, i)) == [(1, 100), (3, 100), (7, 100), (8, 100)]


def test_full_bitmaps_let_more_through_and_give_the_same(spark):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(30)]
    docs = [(k, "pad " * k + items[k % 30][1] + " end") for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = rows(leaks.leaked_items(d, i)), rows(leaks.leaked_items(d, i, band_bits=6, passage_bits=7))
    assert whole == parts and len(whole) == 60


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(leaks.leaked_items(d, i)) == []
    assert rows(leaks.leaked_items(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), i)) == []
