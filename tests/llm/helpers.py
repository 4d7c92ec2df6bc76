"""Rows that several tests share."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["size", "key", "fp", "part", "bucket", "line", "line_no", "h1", "kept", "row", "block", "shard", "first", "target", "encoded", "language", "line_dedup", "__row", "kind", "a", "e", "p", "n"]

WORDS = "the of and to in that is was for with on as his they at be this from have or by one had not but".split()


def prose(i: int, n: int) -> str:
    return " ".join(WORDS[(i * 7 + k * k + k * i) % len(WORDS)] + "xyzw"[(i + k) % 4] * ((i + k) % 3) for k in range(n))


def odd_rows():
    line = "A line that many texts have in common, word for word, at any rate so far."
    rows = [
        (1, f"{line}\n{prose(1, 80)}", "en", "s1", None),
        (2, f"{line}\n{prose(2, 80)}\n\n{line}", "en", None, 1),
        (3, None, None, "s1", None),
        (4, "", "en", "s2", 0),
        (5, " \n\t ", "de", "s2", 4),
        (6, "!!! ### 123", None, None, 11),
        (7, prose(7, 3000), "en", "s1", None),  # very long
        (8, prose(7, 3000), "en", "s1", None),
        (9, prose(7, 2999) + " changed", "en", "s3", None),
        (10, "x" * 5000, "de", "s3", 5000),  # one word
        (11, "café \U0001f600 naïve ▁ 日本語\n" * 30, "fr", "s3", None),
        (None, prose(3, 60), "en", "s1", None),
        (None, None, None, None, None),
        (12, f"{line}\n{prose(1, 80)}", "en", "s1", None),
        (12, f"{line}\n{prose(1, 80)}", "en", "s1", None),  # a repeated row
        (13, line.replace("common", "comon"), "en", "s1", None),
    ]
    return rows
