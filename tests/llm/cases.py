"""Small tables with every awkward case: nulls, empties, ties, repeats, clashing columns."""

EXTRA = "_row string, _fp bigint, _hit int, label int, part int, held boolean, Tokens string"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(20_000))


def documents(spark, texts, sources=None):
    """(doc_id, text, lang, source, n_chars) and extra columns; ids from 0, then a repeat and nulls."""
    rows = [(i, t, None, (sources or ["s"])[i % len(sources or ["s"])], None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "en", None, 3), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "r", 7, 1, 1, 2, True, "t") for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA)


def empty(spark):
    return documents(spark, ["x"]).where("false")


MESSY = ["one two three four", "", None, "   \n\t ", "one two three four", "Ein ß Straße İ   x", LONG, "a",
         "one two three five\nline", "\n\n", "!!! ??? 123"]
