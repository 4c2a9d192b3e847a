"""Rows that every operator must take; fixtures are in ``conftest``."""

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 7919}x{i}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten"
#: Null id and text, empty and blank texts, a very long one, ties, repeated rows.
AWKWARD = [
    (1, SAME, "s1"),
    (2, SAME, "s1"),
    (2, SAME, "s1"),
    (3, None, None),
    (4, "", "s2"),
    (5, " \t\n \n", "s2"),
    (6, LONG, "s3"),
    (7, LONG + " tail", "s3"),
    (None, SAME + " eleven", None),
    (None, "alone here", "null"),
    (8, "short", ""),
    (9, "Released under the MIT License.\n" + SAME + "\n\nReleased under the MIT License.", "s1"),
    (10, "éß \U0001f600 <|endoftext|> a  b c\r\nd", "s4"),
]
CLASHES = ("row", "size", "target", "key", "node", "root", "copies", "block", "window_id", "id", "_id", "_row", "_gone", "again")
