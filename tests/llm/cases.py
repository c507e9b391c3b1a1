"""Small documents with every awkward case."""

LONG = "word" * 30_000
PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and " + PASSAGE, "en", "s", 1),
    (2, "Another start here. " + PASSAGE + " and an end of its own", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \t\n", "en", "s", 3),
    (6, "one", "en", "s", 3),
    (6, "one", "en", "s", 3),
    (7, "Ça va? naïve café 漢字 🙂 x y\x0bz", "fr", None, 1),
    (8, LONG, "en", "s", len(LONG)),
    (9, "a b " * 4000, "en", "s", 16000),
    (None, "no id at all " + PASSAGE, "en", "s", 1),
    (None, None, "en", "s", 1),
    (10, "mail me at jo.doe+x@mail1.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.255 not 10.0.0.256", "en", "s", 1),
    (10, "a second text of one id", "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark):
    """The same with columns that bear the names of results."""
    from pyspark.sql import functions as F

    names = ["score", "fp", "ids", "decoded", "n_words", "n_removed", "kept_text", "base", "spans", "component_id", "length", "piece", "Score2"]
    df = documents(spark)
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def brute_repeats(rows, window=20):
    """(n_words, removed flags, kept) of each row by the plain rule, rows being (doc_id, text) in order."""
    seen, out = set(), []
    for _, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out
