"""Periodic runs against a definition that tries every period, on rows with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cataloom.llm import periodic_runs
from cataloom.llm import textcore as tc

from .helpers import documents, odd_rows


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_runs(words):
    """(start, length, period) of every run, by every period and every place."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(words[i : i + length - d] == words[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(doc_id, words):
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = repeated(doc_id, split(text))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(words), len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows():
    rng = random.Random(3)
    out = odd_rows()
    for k in range(260):
        words = [str(rng.randint(1, rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(0, 3)):
            q, n, s = rng.randint(1, len(words) // 3), rng.randint(20, len(words)), rng.randint(0, len(words) - 1)
            for i in range(s + q, min(len(words), s + n)):
                words[i] = words[i - q]
        out.append((2000 + k, rng.choice([" ", "\n", " \t"]).join(words) + rng.choice(["", " "])))
    return out


def test_runs_are_those_of_the_definition(spark):
    cases = rows()
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_repeats(documents(spark, cases))))
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == sorted((expected(*r) for r in cases), key=repr)
    assert sum(r[2] for r in found) > 100 and max(r[5] or 0 for r in found) > 60


def test_no_rows(spark):
    docs = documents(spark, [(1, "x")]).where("doc_id = 2")
    assert periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_repeats(docs))).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_long_periods(seed):
    """Thousands of words over a small alphabet, one run planted with a long period; every period is tried."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3000, 6000))
    word = rng.integers(0, 3, n).astype(np.int32)
    q = int(rng.integers(9, n // 3))
    size = int(rng.integers(3 * q, n + 1))
    s = int(rng.integers(0, n - size + 1))
    for i in range(s + q, s + size):
        word[i] = word[i - q]
    exact = []
    for p in range(1, n // 3 + 1):
        turn = np.flatnonzero(np.diff(np.concatenate([[0], (word[:-p] == word[p:]).astype(np.int8), [0]])))
        for b, e in zip(turn[::2].tolist(), (turn[1::2] + p).tolist(), strict=True):
            if e - b >= max(24, 3 * p) and not any(p % d == 0 and (word[b : e - d] == word[b + d : e]).all() for d in range(1, p)):
                exact.append((b, p, e - b))
    assert periodic_runs.runs_of(word, np.array([0, n])) == sorted(exact) and exact


def test_a_text_longer_than_a_slice(spark):
    """A run of 150,000 words with a period of 40,000, over more than one slice's bytes, beside small rows."""
    period = [f"w{i:05d}" for i in range(40_000)]
    words = ["head"] * 10 + period * 3 + period[:30_000] + ["tail"]
    text = " ".join(words)
    assert len(text) > tc.SLICE
    r = periodic_runs.find_runs(documents(spark, [(1, "a b"), (2, text), (3, "c " * 24)])).orderBy("doc_id").collect()
    assert [len(x.runs) for x in r] == [0, 1, 1]
    assert tuple(r[1].runs[0]) == (10, 150_000, 40_000) and r[1].collapsed == " ".join(["head"] * 10 + period + ["tail"])
    assert tuple(r[2].runs[0]) == (0, 24, 1) and r[2].collapsed == "c"
