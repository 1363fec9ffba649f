"""Licence scans and media columns over rows with null and repeated ids, and columns that are named like helpers."""

import hashlib
import re
from collections import Counter

from quillmill.llm import licenses, media

ROWS = [(1, "the MIT license x"), (1, "Apache License, then MIT License."), (None, "mit license"), (None, None), (None, ""), (1, "the MIT license x"), (None, "mit license"), (7, " \t"), (7, "general public  license " * 40), (2, "ünder the mit\nlicense" + " word" * 3000)]
CLASH = ["row", "w", "h", "n", "two", "grams", "label", "template", "place", "k", "n_bytes", "offset", "media", "name", "members", "text_hash", "payload"]


def table(spark, rows):
    return spark.createDataFrame([(*r, *[i] * len(CLASH)) for i, r in enumerate(rows)], "doc_id long, text string" + "".join(f", {c} int" for c in CLASH))


def test_licenses_of_odd_rows(spark):
    want = Counter()
    for i, text in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        found = [(at, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        places = [at for at, _ in found]
        want[i, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))] += 1
    got = licenses.scan_licenses(table(spark, ROWS)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, got)) == want


def test_media_of_odd_rows(spark):
    want = Counter((i, len((t or "").encode()), hashlib.sha256(media.payload_of((t or "").encode())).hexdigest()) for i, t in ROWS)
    folder = media.write_archives(table(spark, ROWS))
    for size in (200, 1 << 20):
        got = media.describe(media.read_archives(spark, folder, rangeBytes=size)).select("doc_id", "n_bytes", "payload_sha256").collect()
        assert Counter(map(tuple, got)) == want
