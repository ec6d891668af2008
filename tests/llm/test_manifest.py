"""The Merkle manifest against hashlib, and on odd and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphslice.llm import manifest, queries

SF_DIR = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(rows):
    """What the query returns, with every root folded from the whole runs."""

    def now(r):
        drawn = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        return lowered(r["text"]) if drawn and r["text"] is not None else r["text"]

    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {name: tree([leaf(r, r["text"]) for r in sources[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    found = []
    for place, name in enumerate(names):
        for i, r in enumerate(sources[name]):
            folded, siblings = leaf(r, now(r)), []
            for levels, at in ((trees[name], i), (top, place)):
                for level in levels[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    siblings += run[:slot] + run[slot + 1 :]
                    folded, at = digest("".join([*run[:slot], folded, *run[slot + 1 :]])), at // 16
            root = top[-1][0]
            own = (r["doc_id"], trees[name][0][i], trees[name][-1][0], root, digest("".join(siblings)), folded, folded == root)
            found.append(own)
    return sorted(found, key=str)


def tampered(docs):
    some = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(some, manifest.lower_ascii(F.col("text"))).otherwise(F.col("text"))


def verified(docs):
    return sorted((tuple(r) for r in manifest.Manifest(docs, tampered(docs)).verify().collect()), key=str)


def test_states_are_those_of_sha256():
    texts = [digest(str(i)) * (i % 5) for i in range(40)]
    for text in texts:
        blocks = np.frombuffer(text.encode(), np.uint8).reshape(-1, 64)
        state = manifest.start(1)
        for block in blocks:
            state = manifest.compress(state, manifest.blocks_of(block[None]))
        assert manifest.finish(state, np.array([len(blocks)])).tobytes().decode() == digest(text)


def test_query_by_hand(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = queries.op11_midstate_manifest(spark, SF_DIR)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)


@pytest.mark.parametrize("size", [1, 2, 16, 17, 257])
def test_sizes_of_a_tree(docs_of, size):
    docs = docs_of([(i, f"Text {i}", "only") for i in range(size)])
    assert verified(docs) == by_hand(docs.collect())


def test_many_sources_and_a_large_one(docs_of):
    rows = [(i, f"Some Text {i}", f"s{i % 40}") for i in range(200)] + [(1000 + i, "Copy", "hot") for i in range(300)]
    docs = docs_of(rows)
    assert verified(docs) == by_hand(docs.collect())


def test_odd_rows(docs_of, odd_docs):
    assert verified(odd_docs) == by_hand(odd_docs.collect())
    repeated = docs_of([(7, "The Same", "a")] * 50 + [(None, None, None)] * 20 + [(5, "É A", "ß")] * 3)
    assert verified(repeated) == by_hand(repeated.collect())


def test_no_rows(docs_of):
    empty = docs_of([(1, "x", "a")]).limit(0)
    tree_of_none = manifest.Manifest(empty, tampered(empty))
    assert tree_of_none.verify().collect() == [] and tree_of_none.nodes().collect() == []


def test_nodes_keep_the_state_before_each_slot(docs_of):
    docs = docs_of([(i, f"Text {i}", f"s{i % 3}") for i in range(120)])
    nodes = manifest.Manifest(docs).nodes().collect()
    assert {n["height"] for n in nodes} == {1, 2}
    for node in nodes:
        children = [node["children"][i : i + 64] for i in range(0, len(node["children"]), 64)]
        for slot in range(len(children)):
            state = np.frombuffer(node["states"][32 * slot : 32 * slot + 32], ">u4").astype(np.uint32)[:, None]
            for child in children[slot:]:
                state = manifest.compress(state, manifest.blocks_of(np.frombuffer(child.encode(), np.uint8)[None]))
            assert manifest.finish(state, np.array([len(children)])).tobytes().decode() == node["digest"]
