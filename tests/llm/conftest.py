import random

import pytest

WORDS = {
    "en": "the of and to in that was with this from have not are which you were her all she there would their we him been has when who will more no if out".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont été avec être aux mais comme ont".split(),
}
RUDE = "moron idiot scum trash".split()


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "s", "ing", ",", "."]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, toxic): prose with copies, near copies, shared passages, personal data and odd rows."""
    rng = random.Random(5)
    rows = []
    passage = prose(rng, "en", 120)
    for i in range(240):
        lang = rng.choice(list(WORDS))
        text = prose(rng, lang, rng.randrange(30, 160))
        toxic = int(i % 5 == 0)
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
            text = " ".join(words)
        rows.append((i, text, lang, toxic))
    for k in range(25):
        base = rows[k * 3][1].split()
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = "changed"
        rows.append((300 + k, " ".join(base), rows[k * 3][2], rows[k * 3][3]))
    for k in range(8):
        rows.append((400 + k, prose(rng, "en", 20) + " " + passage + " " + prose(rng, "en", 25), "en", 0))
    rows += [(500 + k, "For " * 300 + "é" * k, "en", 0) for k in range(3)]
    rows += [(600, "Mail joe.b+x@mail.example.com or call +1 (988) 555-2485; 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111.\nLater again: 555-2485", "en", 0), (601, "a@b a@b.c @x.y 4111-1111-1111-1112 1.2.3.4.5 +12345678", "en", 0)]
    rows += [(700, None, "en", None), (701, "", None, None), (702, "  \n\t ", "en", 0), (703, "12 34 !", "en", 0), (704, "one", "en", None), (705, "naïve café <|endoftext|> 日本語 😀 don't İstanbul ΟΔΟΣ  x\r\n\n\ty <|startoftext|>z", "fr", None)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", None), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra columns whose names operators might use themselves."""
    rows = [(i, t, g, "src", len(t) if t is not None else None, "x", 1, [1]) for i, t, g, _ in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, spans array<int>").repartition(4).cache()


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, 1, x) for i, _, _, x in corpus if x is not None] + [(None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").cache()
