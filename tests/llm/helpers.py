"""Small tables with every odd case, and plain definitions to compare with."""

from __future__ import annotations

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, block long, a long, bucket long"


def documents(spark, rows):
    """(doc_id, text) rows as documents, with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "host/x", len(t) if t else None, "clash", 7, 3, 1, 2) for i, t in rows], DOCUMENTS)


def odd_rows(seed: int = 1):
    """Null, empty and blank texts, no doc_id, repeated rows and ids, copies, near copies, very long and non-Latin texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "or", "ti", "é", "st", "ou"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    edited = base.split()
    edited[60] = "changed"
    shared = prose(40)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, base), (4, base), (5, " ".join(edited)), (6, prose(80) + "\n" + shared), (7, shared + "\n" + prose(90)), (8, "two words"), (9, prose(3000))]
    rows += [(10, "中文 文本 " * 20), (11, "a" * 5000), (None, base), (3, base), (12, "😀 emoji 😀\n" + shared), (600, base), (1300, shared), (-5, prose(30))]
    return rows


def words(text: str) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z_\x80-\U0010ffff]+", folded)


def grams(items: list, n: int = 5) -> list[tuple]:
    return [tuple(items[i : i + n]) for i in range(len(items) - n + 1)] or ([tuple(items)] if items else [])


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}
