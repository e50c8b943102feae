"""The manifest against a tree built in memory, on rows with every odd case and at several sizes of a superblock."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cataloom.llm import merkle, queries

from .helpers import DOCUMENTS, documents, odd_rows

SF = "/root/testdata/sf0.001"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(row):
    """All levels over a row of digests."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    path = []
    for row in levels[:-1]:
        begin = i // 8 * 8
        path.append(("".join(row[begin:i]), "".join(row[i + 1 : begin + 8])))
        i //= 8
    return path


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in groups[name]), key=lambda x: x[:3])
        trees.append((own, climb([x[2] for x in own])))
    upper = climb([levels[-1][0] for _, levels in trees])
    out = []
    for t, (own, levels) in enumerate(trees):
        for i, (_, _, digest, r) in enumerate(own):
            path = siblings(levels, i) + siblings(upper, t)
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None and tampered(r[0]) else r[1]
            node = leaf(r, low)
            for left, right in path:
                node = sha(left + node + right)
            root = upper[-1][0]
            out.append((r[0], digest, levels[-1][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def audited(docs, depth):
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.audit(docs, changed={"text": F.translate("text", LETTERS, LETTERS.lower())}, where=where, depth=depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def cases(n: int, langs: int):
    """Groups of very unlike sizes, one of them null, one of a single row; odd texts; a doc_id thrice, one row twice."""
    rows = [(i, t, "en", "host/x", len(t) if t else None, "k", 1, 2, 3, 4) for i, t in odd_rows()]
    for i in range(n):
        lang = None if i % 11 == 0 else "en" if i % 3 else f"l{(i * 7) % langs:03d}é"
        rows.append((5000 + 3 * i, f"Text Number {i} ÄÖ", lang, None if i % 5 == 0 else "s", i, None, 1, 2, 3, 4))
    return rows + [(9, "Other", "zz", "q", None, "k", 1, 2, 3, 4), (5000, "Twice", "en", "s", 5, None, 1, 2, 3, 4), rows[-1]]


@pytest.mark.parametrize(("n", "langs", "depth"), [(40, 3, 4), (700, 3, 1), (900, 90, 2)])
def test_roots_and_proofs(spark, n, langs, depth):
    rows = cases(n, langs)
    got = audited(spark.createDataFrame(rows, DOCUMENTS), depth)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_full_and_single_runs(spark, n):
    """One group of exactly a run, a superblock, or one more."""
    rows = [(i, f"A{i}", "en", "s", 2, "k", 1, 2, 3, 4) for i in range(n)]
    assert audited(spark.createDataFrame(rows, DOCUMENTS), 1) == plain(rows)


def test_a_long_text(spark):
    rows = [(1, "Ab" * 1_500_000, "en", "s", 3, "k", 1, 2, 3, 4), (2, None, "en", None, None, "k", 1, 2, 3, 4)]
    assert audited(spark.createDataFrame(rows, DOCUMENTS), 4) == plain(rows)


def test_no_rows(spark):
    assert audited(documents(spark, [(1, "x")]).where("doc_id = 2"), 4) == []


def test_an_honest_table_verifies(spark):
    rows = merkle.audit(documents(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows()) and all(r.verified for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query_and_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = duck.sql(queries.ORACLES["op11_manifest"])
    mine = queries.op11_manifest(spark, SF).select(*found.columns).collect()
    assert sorted(tuple(r) for r in mine) == sorted(found.fetchall())
