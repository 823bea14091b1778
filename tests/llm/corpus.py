"""Small documents with the odd cases that every operator meets."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = "ha lo mi ne re ta ku so vi pe an or el in us".split()
    out = []
    for k in range(words):
        word = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        out.append(word.capitalize() + "" if k % 9 == 0 else word + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, copies, a very long text."""
    base, long = prose(1, 120), prose(2, 9000)
    rows = [
        (0, base, "en", "a", len(base)), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
        (4, base, "en", "b", len(base)), (4, base, "en", "b", len(base)), (None, prose(3, 80), "en", "c", 1), (None, None, None, None, None),
        (5, long, "en", "a", len(long)), (6, base.replace("ha", "hu", 1), "en", "a", len(base)), (7, "word", "en", "a", 4), (8, "ß ü\x85é 漢字 😀 <|endoftext|> \x00", "de", "a", 9),
        (9, "a" * 700, "en", "a", 700), (10, prose(4, 60) + "\n" + base + "\n" + prose(5, 40), "en", "a", 5),
    ]
    return rows + [(20 + k, prose(100 + k, 60 + k), "en", "s", 3) for k in range(40)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def clashing(spark):
    """The same with columns whose names operators might use themselves, and without others."""
    from pyspark.sql import functions as F

    names = ["words", "node", "label", "blob", "ids", "row", "shard", "score", "h", "text_bytes", "__blob", "spans", "kind", "class_id"]
    return odd(spark).drop("n_chars", "lang").withColumns({n: F.lit(f"x{n}") for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r.doc_id if r.doc_id is not None else -1) for r in df.select("doc_id").collect())


IDS = sorted(r[0] if r[0] is not None else -1 for r in odd_rows())
