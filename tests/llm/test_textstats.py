import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import textstats as ts

PIECES = ["The index keeps the row. ", "\n", "\n\n", "- item one\n", "a | b | c\n", "tab\tcell\n", "(cid:12) ", "xkrtz ", "12,34,56\n", "Wort über Straße! ", "…………… 3\n", "   ", "", "word" * 30, "\r\n", "\r", " " * 200, "x" * 90, "ae" + "k" * 70, "17.51    46.06    row\n", "8f f3 38 "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 400))
def test_chunks_give_what_the_whole_gives(parts, chunk):
    text = "".join(parts)
    assert ts.statistics(text, chunk) == ts.statistics(text)


def kind(text):
    return ts.statistics(text)[-1]


PROSE = "The storage quota compares the parity check with the list. In this chapter, the bar replaces the policy until the counter returns to zero. "


def test_kinds():
    assert kind(PROSE * 4) == "prose"
    assert kind(PROSE * 4 + "\n- one\n- two\n- three\n") == "prose"
    assert kind(PROSE * 4 + "\n| a | b |\n|---|---|\n| 1 | 2 |\n") == "prose"
    assert kind("\n".join(f"- entry {w} of many" for w in "abcdefgh")) == "list"
    assert kind("\n".join(f"{i}) vector store near the limit" for i in range(9))) == "list"
    assert kind("\n".join(f"{i},{i * 7},{i * 3},n/a,yes" for i in range(20))) == "table"
    assert kind("a | b | c\n" * 10) == "table"
    assert kind("(cid:12) �� □□□ ?�? " * 20) == "junk"
    assert kind("00000000  bb 42 72 15 f5 ec 7c 83 b4 6d a6 97 27 41 e0 07\n" * 8) == "junk"
    assert kind("\n".join(["=?; / /^>~: %& ? |}_/#; { >/ ! | !/**? :{+{# +@ #{_%!#| |!?>~"] * 6)) == "junk"
    assert kind("\n".join(f"{i}.51          {i}.06         vector store      8{i}" for i in range(10, 20))) == "table"
    assert kind("\n".join("-               -              n/a" for _ in range(12))) == "table"
    assert kind("\n".join(f"{i}.48,2025-04-{i},2025-04-08" for i in range(10, 30))) == "table"
    assert kind("journal locale dépôt relevé l’archive journal révision gestionnaire lecteur vecteur tri manifeste l’équipe locale mémoire tableau\n" * 9) == "junk"
    assert kind("") == kind(None) == kind("   \n ") == "prose"


def test_rows_with_every_oddity(spark):
    random.seed(1)
    long = (PROSE * 900)[:100_000]
    rows = [(1, None, 5), (2, "", 5), (3, long, 5), (4, long, 5), (5, "x", None), (6, "w" * 50_000, 5), (7, PROSE, 5), (7, PROSE, 5)]
    table = "a | b | c\r\n" * 900
    rows += [(8, long, 5), (8, table, 5), (8, table, 5)]  # one key, two texts, one of them twice
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")  # a clashing column
    got = [tuple(r) for r in ts.text_statistics(df, chunk=2_000).collect()]
    assert len(got) == len(rows) and sorted(r[-1] for r in got if r[0] == 8) == ["prose", "table", "table"]
    out = {r[0]: r[1:] for r in got if r[0] < 8}
    assert set(out) == {1, 2, 3, 4, 5, 6, 7}
    assert out[3] == out[4] == ts.statistics(long)
    assert out[6] == ts.statistics("w" * 50_000)
    assert out[1] == out[2] == ts.statistics("")
    assert ts.text_statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0
