"""Merkle manifest against a plain tree, with few and with many rounds of blocks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from somatica.llm import merkle

from . import plain


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(nodes):
    """Root, and the siblings before and after on the way there, of every node."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 :][:3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes, at = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r.text) for r in by[s]]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            path = path + up
            cut = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and cut is not None:
                cut = cut.replace("\n", "")
            folded = leaf(r, cut)
            for before, after in path:
                folded = digest(before, folded, after)
            out.append((r.doc_id, leaf(r, r.text), trees[s][0], root, digest(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=repr)


def documents(spark, sizes):
    rng = random.Random(3)
    rows = []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), "".join(rng.choices("ab \né", k=rng.randrange(9))), "en", source, k) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, plain.SCHEMA).repartition(3)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 1}, {"hot": 2000, "é": 730, "z": 729, None: 4, "y": 1}])
def test_against_plain_tree(spark, sizes):
    docs = documents(spark, sizes)
    got = sorted((tuple(r) for r in merkle.proof_digests(docs).collect()), key=repr)
    assert got == manifest(docs.collect())


def test_blocks_of_a_tree():
    """Blocks of nine leaves give the lowest two levels of every proof."""
    for n in (2, 9, 10, 100):
        own = [digest(str(k)) for k in range(n)]
        levels = merkle.height(n)
        top, each = merkle.grown(own, levels)
        assert ([*top], each) == ([tree(own)[0]], tree(own)[1])
        for at in range(0, n, 9):
            up, inner = merkle.grown(own[at : at + 9], min(2, levels))
            assert len(up) == 1 and inner == [p[:2] for p in each[at : at + 9]]


@pytest.mark.parametrize("most", [1, 2, 40])
def test_driver_bound(spark, most):
    docs = documents(spark, {f"s{k}": 1 + k % 4 for k in range(12)} | {"hot": 800})
    show = lambda df: sorted((r.key, r.leaf, r.root, r.path) for r in df.select("key", "leaf", "root", F.col("path").cast("string").alias("path")).collect())
    assert show(merkle.manifest(merkle.document_leaves(docs), most)) == show(merkle.manifest(merkle.document_leaves(docs)))


def test_awkward(spark):
    docs = spark.createDataFrame(plain.AWKWARD, plain.SCHEMA)
    clashes = docs.withColumns({c: F.lit(7) for c in [*plain.CLASHES, "tree", "pos", "digest", "path", "top", "leaf", "rest"]})
    got = sorted((tuple(r) for r in merkle.proof_digests(clashes).collect()), key=repr)
    assert got == manifest(docs.collect()) and len(got) == len(plain.AWKWARD)
    assert merkle.proof_digests(docs.where("false")).collect() == []
