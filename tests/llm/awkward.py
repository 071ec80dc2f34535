"""Rows that operators must stand."""

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
AWKWARD = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, LONG, "en", "a"), (5, "same text here", "de", "b"), (6, "same text here", "de", "b"), (6, "same text here", "de", "b")]
