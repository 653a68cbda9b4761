"""Small documents and brute-force versions."""

import zlib

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, k string, t long, shard double"
#: Null and empty texts, null keys, repeated rows, non-ASCII, odd white space.
ODD = [(900, None), (901, ""), (902, " \t\n\x0b\x0c\r "), (None, "a row without a key " * 20), (903, "e\u0301\u00a0\u3000x \U0001d518 " * 30), (904, "twice the same row"), (904, "twice the same row"), (905, "\n\n\n"), (906, "x" * 5000)]


def documents(spark, pairs, slices=3):
    """A documents table with extra columns whose names operators use inside."""
    rows = [(i, t, "en", "src", len(t) if t is not None else None, "own", "own", 5, 0.5) for i, t in pairs]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(slices)


def crc(text):
    return zlib.crc32((text or "").encode())
