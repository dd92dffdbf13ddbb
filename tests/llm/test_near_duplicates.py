"""Candidate pairs of the Jaccard join: no link is lost, and unlike documents with shared passages form no block."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_duplicates

SCHEMA = "doc_id long, text string"


def test_equal_sets_are_one_node(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in range(20)] + [(20 + i, "\n ".join(words).upper()) for i in range(20)] + [(40, "some other text")]
    found = near_duplicates.signed_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), 5, 80, 100).collect()
    assert len(found) == 41 and len({r.node for r in found if r.doc_id < 40}) == 1 and len({r.node for r in found}) == 2


def test_shared_passages_make_no_block(spark, monkeypatch):
    """Every document shares a third of its text with each of six others, and none is like another but for one."""
    n = 60
    passages = [" ".join(f"p{p}w{i}" for i in range(40)) for p in range(n)]
    texts = [" ".join(passages[(i + step) % n] for step in (0, 1, 3)) for i in range(n)]
    rows = list(enumerate(texts)) + [(n, texts[7] + " more")]
    written, members = near_duplicates.written, []

    def noted(df, purpose):
        out = written(df, purpose)
        if purpose == "shingle-members":
            members.extend(out.collect())
        return out

    monkeypatch.setattr(near_duplicates, "written", noted)
    found = {r.doc_id: r.component_id for r in near_duplicates.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: i for i in range(n)} | {n: 7}
    assert len(members) == 2


def test_each_kept_text_is_moved_by_one_join(spark, monkeypatch):
    """Without broadcasts the joins that choose the rows to keep shuffle whole rows once, and once more for repeated ones."""
    monkeypatch.setattr(near_duplicates, "bounded", lambda df, rows: df)
    words = [" ".join(f"d{d}w{i}" for i in range(30)) for d in range(6)]
    rows = list(enumerate(words)) + [(10, words[0]), (3, words[3]), (3, words[3]), (1, words[1] + " more"), (None, words[2]), (7, None), (7, None)]
    left = near_duplicates.one_of_each(spark.createDataFrame(rows, SCHEMA))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and plan.count("Join Inner") == 1 and plan.count("Join") == 2
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=lambda r: (r[0], r[1] or ""))
    assert kept == [(0, words[0]), (1, words[1]), (1, words[1] + " more"), *[(d, words[d]) for d in (2, 3, 4, 5)], (7, None)]


@pytest.mark.parametrize("held", [7, 100_000])
def test_candidate_pairs_connect_every_link(monkeypatch, held):
    """Sets of tokens in order of their number: rare ones high and low, common ones in between, in small and large groups."""
    monkeypatch.setattr(near_duplicates, "HELD_PROBES", held)
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = set(rng.integers(0, 400, rng.integers(1, 30)).tolist())
        for _ in range(rng.integers(1, 6)):
            sets.append(frozenset(base - set(rng.choice(sorted(base), rng.integers(0, 3)).tolist()) | set(rng.integers(0, 400, rng.integers(0, 3)).tolist())))
    sets += [frozenset({500} | set(rng.integers(0, 40, 4).tolist())) for _ in range(90)]  # a large group
    sets = [s for s in dict.fromkeys(sets) if s]
    num, den = 80, 100
    probes = []
    for node, s in enumerate(sets):
        prefix = sorted(s)[: near_duplicates.prefix_length(len(s), num, den)]
        probes += [(t, len(s) << 32 | prefix[-1], node) for t in prefix] * (1 + node % 2)  # of repeated rows
    probes.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([p[c] for p in probes[i : i + 3]], pa.int64()) for c in (0, 2, 1)], names=["token", "node", "size"])
               for i in range(0, len(probes), 3)]
    common, need = Counter(), {}
    for out in near_duplicates._pairs(num, den)(iter(batches)):
        for a, b, least in zip(*(c.to_pylist() for c in out.columns), strict=True):
            common[a, b] += 1
            need[a, b] = min(least, need.get((a, b), least))
    label = list(range(len(sets)))
    kept = [p for p in common if common[p] >= need[p]]
    for a, b in kept:
        label = [label[a] if x == label[b] else x for x in label]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert len(links) > 30 and all(label[a] == label[b] for a, b in links)
    assert held == 7 or len(kept) < len(common)
