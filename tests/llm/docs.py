"""A documents table with every awkward row, shared by the operators' tests."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id string, size string, media string"
LONG = " ".join(f"word{i % 977} the of and" for i in range(6000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
NEAR = BASE + " seven"
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, NEAR, "en", None),
    (4, None, None, "b"),
    (5, "", "fr", "b"),
    (6, "   \n\t ", "fr", None),
    (7, LONG, "en", "a"),
    (8, "Été naïf — ça va?  Deux  espaces\n\nlà. <|endoftext|> fin ", "fr", "c"),
    (9, "Hi", "en", "c"),
    (9, "Hi", "en", "c"),
    (None, BASE, "en", "a"),
    (None, "nobody names this text at all", None, None),
    (10, "12345 678 !!! ...", "en", "c"),
]


def table(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "w") for r in ROWS], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
