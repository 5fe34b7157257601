"""The pipeline's stages against plain Python."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from counterpoise.llm import quality
from counterpoise.session import materialize

from . import helpers as H

SMALL = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    results, seen = [docs], [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, results[-1], SMALL), "stage-test")
        results.append(out)
        seen.append({r["doc_id"]: r for r in out.collect()})
    assert all(r.columns == docs.columns for r in results[:-1])

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = quality.score_documents(docs, labels).collect()
    assert set(seen[1]) == {r["doc_id"] for r in scores if r["predicted"] == 1}

    lines = collections.defaultdict(set)
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for d, r in seen[1].items():
        for line in r["text"].split("\n"):
            lines[key(line)].add(d)
    gone = {k: max(v) for k, v in lines.items() if len(k) >= 20 and len(v) >= 3}
    for d, r in seen[1].items():
        want = "\n".join(x for x in r["text"].split("\n") if gone.get(key(x), d) == d)
        assert seen[2][d]["text"] == want and seen[2][d]["n_chars"] == len(want)

    groups = H.jaccard_groups([(d, r["text"]) for d, r in seen[2].items()])
    assert set(seen[3]) == {d for d, (first, _) in groups.items() if first == d}

    items = [" ".join(H.words(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = {d: f" {' '.join(H.words(r['text']))} " for d, r in seen[3].items()}
    leaking = {d for d, t in plain.items() if any(f" {x} " in t for x in items)}
    assert not leaking & set(seen[4]) and len(seen[3]) - len(seen[4]) <= len(leaking) + 2

    copies = collections.Counter(r["doc_id"] for r in results[5].collect())
    assert set(copies) <= set(seen[4]) and max(copies.values()) <= 3
    assert {"shard", "position"} <= set(results[5].columns)


def test_odd_and_empty_documents(spark):
    labels = f"{SMALL}"
    odd = spark.createDataFrame([r[:5] for r in H.odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, labels), "stage-odd")
        assert docs.count() >= 0


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
    assert len([q for q in __spark_entry__.queries() if q.startswith("op")]) >= 10
