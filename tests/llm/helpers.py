"""Small tables with the cases that every operator must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, spans string, fp string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source). The last four columns bear names that operators use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), -7, "x", "y", "z") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "an", "or", "ti", "wh", "ea", "ing", "st") for b in
             ("re", "ou", "nd", "er", "ha", "ly", "ble", "tion")] + [f"w{k}q" for k in range(vocabulary)]
    out = []
    for k in range(n):
        word = rng.choice(words)
        out.append(word.capitalize() if k % 12 == 0 else word)
        if k % 12 == 11:
            out[-1] += "."
    return " ".join(out)


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, odd characters."""
    long = prose(1, 6000)
    return [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (None, prose(2, 50), "en", None),
            (4, long, "en", "a"), (5, prose(3, 80), None, "b"), (5, prose(3, 80), None, "b"), (6, prose(3, 80), "de", "b"),
            (7, "é x y İK\x1cz 😀😀 a", "fr", "b"), (None, None, None, None), (5, prose(9, 40), "en", "c"),
            (8, "one", "en", "c"), (9, "one two three four five six", "en", "c"), (10, "word " * 3000, "en", "c")]
