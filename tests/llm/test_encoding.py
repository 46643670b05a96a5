import random

import numpy as np
import pytest

from quillspark.llm import encoding as en

SOUND = [
    "Der Rückstand prüft das Wörterbuch, und die Größe schützt den Schlüssel über Nacht.",
    "La révision répare le numéro de page – l’équipe a déjà vérifié la clé « été ».",
    "El número de versión protege la señal, y el año de edición revisa el catálogo.",
    "The team’s naïve first draft – “good enough” – isn’t documented anywhere; café, résumé, façade…",
]


def sample(n=240, seed=0):
    r = random.Random(seed)
    return [" ".join(r.choice(SOUND) for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def repairer():
    words = {w for t in SOUND for w in en.foreign_words(t)}
    return en.Repairer(en.Classifier(sample()), lexicon=en.Lexicon(np.array([en.word_hash(w) for w in words]), np.ones(len(words), np.int64)))


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp850", "utf-8>cp1251", "utf-8>cp1252 twice", "cp1252>cp850", "cp1252>cp1251"])
def test_round_trips(repairer, chain):
    hits = whole = 0
    for t in sample(20, 9):
        g = en.garble(t, chain)
        bad, _, _, back = repairer.judge(g)
        hits += bad
        whole += back == en.garble(t, chain) or back == t or back == t.encode(en.CHAINS[chain][0][0], "ignore").decode(en.CHAINS[chain][0][0])
    assert hits == 20 and whole >= 18


def test_sound_and_quoted_text_is_left_alone(repairer):
    for t in [*SOUND, *sample(20, 4), "", None, "plain ascii", "When “Ã©” shows up instead of “é”, the décodage is wrong."]:
        assert repairer.judge(t)[0] is False, t
    assert repairer.judge("r�sum� is lost")[:3] == (True, "lossy", False)


def test_rows(spark):
    rows = [(f"s{i}", t, "x") for i, t in enumerate(sample(120))]
    rows += [("g1", en.garble(SOUND[0], "utf-8>cp1252"), "x"), ("g2", SOUND[0] + " " + en.garble(SOUND[1], "utf-8>mac_roman"), "x"), ("n", None, None), ("e", "", None), ("long", "ascii " * 100_000, "x"), ("g1", en.garble(SOUND[0], "utf-8>cp1252"), "x")]
    df = spark.createDataFrame(rows, "id string, content string, chain string")  # a clashing column
    out = [r for r in en.repaired(df).collect()]
    assert {r["id"] for r in out if r["affected"]} == {"g1", "g2"} and len(out) == len(rows)
    assert next(r for r in out if r["id"] == "g1")["text"] == SOUND[0]
    assert en.repaired(df.limit(0)).count() == 0


def test_rare_words_are_known_by_other_rows_alone(spark):
    """A row garbled between single-byte encodings whose only words outside ASCII stand in one other row."""
    rows = [(f"s{i}", t) for i, t in enumerate(sample(300))]
    name = "Der Name ist Jörgküß, und Bävölü kennt Zöblän."
    rows += [("name", name), ("bad", en.garble(name, "cp1252>cp850")), ("own", "Die Åkjæröy und Ñuñöa Çağlä sind Orte.")]
    df = spark.createDataFrame(rows, "id string, content string")
    for limit in (4_000_000, 0):  # sent to the executors, or joined
        out = {r["id"]: r for r in en.repaired(df, sample=300, words=limit).collect()}
        assert [i for i, r in out.items() if r["affected"]] == ["bad"] and out["bad"]["text"] == name and len(out) == len(rows)
