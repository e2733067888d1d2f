"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, _q_key string, row double, spans string, _d_key string, _b_lines string, _pos string, value string, error string, _j_key string, site string, lines string, n_lines bigint, kept string"
LONG = "long words of a text, again and again. " * 20_000


def rows():
    texts = [None, "", " \n\t", "a", "Ein Satz. Noch einer!", "Ein Satz. Noch einer!", LONG, "é😀 ퟿ ß", "x" * 30_000, "1" * 50_000, "@" * 2000 + "a@b.co", "\n" * 500, "NULL\x00byte"]
    out = [(k, t, "de" if k % 2 else None, "s" if k % 3 else None, len(t or ""), "k", "s", 1.0, "x", "y", *"abcdefg", 1, "h") for k, t in enumerate(texts)]
    return [*out, out[4], (None, "no id here at all", *[None] * 17)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
