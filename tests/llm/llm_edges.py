"""Rows (doc_id, text, lang, source) with nulls, empty and long texts, ties and repeated rows."""

EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "b"), (4, "one", "en", None),
         (5, "one", "en", "a"), (5, "one", "en", "a"), (None, "one two", None, "c"), (6, "x" * 70_000, "en", "a"),
         (7, "a b c d e f g h\n" * 3000, "de", "b")]
