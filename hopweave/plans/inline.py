"""Small inline inputs of the catalog queries."""

from __future__ import annotations


def stats_line(name: str, code: str, articles: str, users: str, local: str, wiki: str, width: int = 37) -> str:
    """A statistics line with values at the positions that are read."""
    f = ["0"] * width
    for k, v in ((1, name), (2, code), (4, articles), (7, users), (10, local), (36, wiki)):
        if k < width:
            f[k] = v
    return ",".join(f)


STATS = [
    stats_line("English", "en", "7000000", "49000000", '"English"', "enwiki"),
    stats_line("German", "de", "3000000", "4500000", "Deutsch", "dewiki"),
    stats_line("French", "fr", "2600000", "5000000", "Fran&#231;ais", "frwiki"),
    stats_line("Ukrainian", "uk", "1300000", "800000", "&#x423;", "ukwiki"),
    stats_line("Simple", "simple", "260000", "1500000", "Simple", "simplewiki"),
    stats_line("Broken", "bad", "many", "1", "x", "badwiki"),
    stats_line("No prefix", "", "1", "1", "x", "nowiki"),
    stats_line("Short", "sh", "1", "1", "x", "shwiki", 36),
    "",
]

FILES = [
    (f"{code}wiki-{date}-{kind}.sql.gz", size)
    for code, date, kinds in (
        ("de", "20250801", (("page", 300), ("linktarget", 200), ("pagelinks", 900))),
        ("en", "20250801", (("page", 3000), ("linktarget", 2000), ("pagelinks", 9000))),
        ("en", "20250701", (("page", 2900), ("linktarget", 1900))),
        ("xx", "20250601", (("page", 1), ("linktarget", 2), ("pagelinks", 3))),
        ("fr", "20250801", (("page", 5), ("langlinks", 6), ("pagelinks", 7))),
    )
    for kind, size in kinds
] + [("notes.txt", 10), ("commons-20250801-page.sql.gz", 11)]

FEEDS = [
    ("en", "<rss><channel><link>https://dumps.wikimedia.org/enwiki/20250801</link><item><link>https://x/20240101</link></item></channel></rss>"),
    ("simple", "<rss><link>https://dumps.wikimedia.org/simplewiki/20250720</link></rss>"),
]
