from datetime import datetime

from quillspark.llm import scans

SCHEMA = "id string, indexed_at timestamp, collection string, file_path string, page_number int, chunk_index int, document_type string, ocr_language string, ocr_triggered_by string, ocr_confidence double, content string, text string, kinds string"
BODY = ["The storage quota compares the parity check with the", "older list. The manifest confirms the regular index at", "the end of the month, and the corpus checks the file."]
PLAIN = "The storage quota compares the parity check with the older list. The manifest confirms the regular index at the end of the month, and the corpus checks the file."


def row(i, path, page, content, lang="eng", kind="pdf"):
    return (i, datetime(2025, 1, 1), "c", path, page, None if page is None else page - 1, kind, lang, None, 50.0 if lang else None, content, "t", "k")


def table(spark, rows):
    clean = [row(f"m{i}", f"/m{i}.md", None, "\n".join(BODY), None, "md") for i in range(60)]
    return spark.createDataFrame([*rows, *clean], SCHEMA)


def found(spark, rows):
    return {r["id"]: (tuple(r["kinds"]), r["text"]) for r in scans.repaired(table(spark, rows)).collect()}


def test_each_kind_of_damage_is_found_and_repaired(spark):
    pages = [
        row("a", "/s.pdf", 1, "Storage Notes Quarterly\n" + "\n".join(BODY) + "\n- 4 -"),
        row("b", "/s.pdf", 2, "5    Storage Notes Quarterly\n" + "\n".join(BODY).replace("manifest", "manlfesf")),
        row("c", "/s.pdf", 3, "\n".join(BODY).replace("parity check", "pari-\nty check")),
        row("d", "/clean.pdf", 1, "\n".join(BODY)), row("e", "/clean.pdf", 2, "— \nFigure 6\n" + "\n".join(BODY)),
    ]
    got = found(spark, pages)
    assert got["a"][0] == ("header", "page_number") and got["a"][1] == PLAIN
    assert got["b"] == (("characters", "header", "page_number"), PLAIN)
    assert got["c"] == (("hyphenation",), PLAIN)
    assert got["d"] == ((), PLAIN) and got["e"][0] == ()
    assert not {"m0", "m1"} & set(got)


def test_odd_rows(spark):
    rows = [row("n", "/x.pdf", 1, None), row("b", "/x.pdf", None, "   \n "), row("z", "/x.pdf", 3, ""), row("l", "/x.pdf", 4, "\n".join(BODY * 3000)), row("l", "/x.pdf", 4, "\n".join(BODY * 3000)), row("f", None, None, "\n".join(BODY))]
    got = found(spark, rows)
    assert got["n"] == got["b"] == got["z"] == ((), "") and got["l"][0] == () and set(got) == {"n", "b", "z", "l", "f"}
    assert scans.repaired(table(spark, []).limit(0)).count() == 0


def test_links_by_join_give_the_same(spark):
    rows = [row(f"r{i}", f"/f{i}.pdf", 1, "\n".join(BODY).replace("quota", "qu0ta")) for i in range(3)]
    t = table(spark, rows)
    a, b = (sorted((r["id"], tuple(r["kinds"]), r["text"]) for r in scans.repaired(t, link_limit=n).collect()) for n in (500_000, 0))
    assert a == b and all(k == ("characters",) for _, k, _ in a)


def test_rare_names_are_repaired_by_unscanned_rows(spark):
    sound = [row(f"k{i}", f"/k{i}.md", None, "\n".join(BODY).replace("corpus", "Nabagu"), None, "md") for i in range(6)]
    twice = [row(f"w{i}", f"/w{i}.md", None, "\n".join(BODY).replace("corpus", w), None, "md") for i, w in enumerate(["Zafen", "Zafcn"] * 4)]
    rows = [row("s", "/s.pdf", 1, "\n".join(BODY).replace("corpus", "Nabagii")), row("t", "/t.pdf", 1, "\n".join(BODY).replace("corpus", "Zafcn"))]
    got = found(spark, [*sound, *twice, *rows])
    assert got["s"] == (("characters",), PLAIN.replace("corpus", "Nabagu"))
    assert got["t"] == ((), PLAIN.replace("corpus", "Zafcn"))


def test_compounds_are_those_of_all_rows(spark):
    rows = [row(f"h{i}", f"/h{i}.pdf", 1, "\n".join(BODY).replace("parity check", "parity-\ncheck")) for i in range(6)]
    whole = row("w", "/w.md", None, "\n".join(BODY).replace("parity check", "parity-check"), None, "md")
    t = table(spark, [*rows, whole])
    got = {r["id"]: (tuple(r["kinds"]), r["text"]) for r in scans.repaired(t, sample=1).collect()}
    assert all(got[f"h{i}"] == ((), PLAIN.replace("parity check", "parity-check")) for i in range(6))


def test_skeletons_fold_confused_glyphs():
    for a, b in (("without", "withoiit"), ("oldest", "oldesf"), ("report", "rep0rt"), ("shard", "sbard"), ("ahead", "ahcacl"), ("limit", "lirnit"), ("merges", "mer9es"), ("prefix", "preﬁx"), ("quality", "quahty")):
        assert scans.skeleton(a) == scans.skeleton(b), a
    assert scans.skeleton("Foken") != scans.skeleton("token")


def test_page_numbers():
    assert scans.number_of("- 12 -") == {12} and scans.number_of("12 / 19") == {12} and 9 in scans.number_of("ix") and 14 in scans.number_of("l4")
    assert scans.number_of("The 12 lists") is None and scans.parted("[5]    A Running Head") == ({5}, "A Running Head")


def test_vectors_decide_between_words_of_one_skeleton(spark):
    """'frcc' may be tree or free: only the words around tell. Without vectors the more frequent one always wins."""
    import random

    r = random.Random(3)
    tree, free = ["the heading tree keeps the old branch of", "each branch of the tree keeps its root in"], ["as soon as the lock is free again the", "while the lock was free the worker could"]
    tail = ["index and the report", "list before the audit", "corpus during the night", "file without a pause"]
    say = lambda kind: f"{r.choice(kind)} {r.choice(tail)}."
    sound = [row(f"v{i}", f"/v{i}.md", None, " ".join(say(tree if r.random() < 0.6 else free) for _ in range(8)), None, "md") for i in range(300)]
    bad, want = [], {}
    for i in range(40):
        t = say(tree if i % 2 else free)
        want[f"x{i}"] = t
        bad.append(row(f"x{i}", f"/x{i}.pdf", 1, t.replace("tree", "frcc").replace("free", "frcc")))
    t = spark.createDataFrame([*sound, *bad], SCHEMA)
    right = {}
    for trust in (0.5, 0.0):
        got = {x["id"]: x for x in scans.repaired(t, trust=trust).collect()}
        assert all(got[i]["kinds"] == ["characters"] for i in want)
        right[trust] = sum(got[i]["text"] == w for i, w in want.items())
    assert right[0.5] >= 38 and right[0.0] <= 22


def test_headers_and_numbers_are_voted_over_the_whole_of_a_long_file(spark):
    r = lambda i, page: row(f"l{i}", "/long.pdf", page, f"Storage Notes Quarterly\n{BODY[0]}\n{BODY[1]}\n{BODY[2]}\nthe end of it {i + 40}")
    rows = [r(i, i + 1) for i in range(65)] + [row("other", "/other.pdf", 1, "\n".join(BODY)), row("nopage", "/long.pdf", None, "Storage Notes Quarterly\n" + "\n".join(BODY))]
    t = table(spark, rows)
    whole, blocks = ({x["id"]: (tuple(x["kinds"]), x["text"]) for x in scans.repaired(t, pages=n).collect()} for n in (1000, 64))
    assert whole == blocks and all("header" in whole[f"l{i}"][0] for i in range(65)) and whole["other"][0] == () and "header" in whole["nopage"][0]


def test_ligatures_are_undone(spark):
    got = found(spark, [row("a", "/a.pdf", 1, "\n".join(BODY).replace("corpus", "xuﬁba"))])
    assert got["a"] == (("characters",), PLAIN.replace("corpus", "xufiba"))


def test_vectors_are_learned_from_all_rows(spark):
    """What tells tree from free stands in rows that no sample of 6,000 by their hashes holds."""
    ids = [r["id"] for r in spark.range(7_400).selectExpr("concat('v', id) as id").orderBy("id").selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    tree, free = "each branch of the tree keeps its root in place", "while the lock was free again the worker could go on"
    plain = [row(i, f"/{i}.md", None, PLAIN[:70], None, "md") for i in ids[:7_000]]
    sound = [row(i, f"/{i}.md", None, " ".join([tree, free, tree][: 2 + k % 2]), None, "md") for k, i in enumerate(ids[7_000:])]
    bad = [row(f"x{k}", f"/x{k}.pdf", 1, t.replace("tree", "frcc").replace("free", "frcc")) for k, t in enumerate((tree, free))]
    got = {r["id"]: r["text"] for r in scans.repaired(spark.createDataFrame([*plain, *sound, *bad], SCHEMA)).collect()}
    assert got == {"x0": tree, "x1": free}


def test_neighbours_are_counted_in_every_row(spark):
    texts = ["A b, a\nB 7 c", "b a", None, "", "c-\nb a", "zz a"] * 3
    t = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3)
    counts = spark.createDataFrame([("a", 9), ("A", 3), ("b", 9), ("B", 3), ("c", 3), ("C", 2), ("cb", 9), ("zz", 4), ("7", 9)], "word string, n long")
    known = scans.vocabulary(counts)
    word = {int(scans.place(known, w)): w for w in ("a", "b", "c", "cb")}
    got = {tuple(sorted((word[r["x"]], word[r["y"]]))): r["n"] for r in scans.beside(t, "t", scans.shared(spark, {"known": known})).collect()}
    assert len(known) == 4 and scans.place(known, "zz") == -1
    assert got == {("a", "b"): 12, ("a", "a"): 3, ("b", "b"): 3, ("b", "c"): 3, ("a", "c"): 3, ("a", "cb"): 3}
