"""Terms beside personal data are counted once for each different text."""

import re

import numpy as np
from pyspark.sql import functions as F

from counterpoise.llm import personal_data


def _docs(spark):
    """Copies, a row that comes twice, a null text, and words that only spans hold."""
    texts = [f"alpha{i % 3} beta gamma{i % 7} mail bob{i % 4}@host{i % 2}.org now" for i in range(40)]
    texts += ["beta gamma1 plain words", None, "", "ALPHA1 host1 bob1@host1.org x İstanbul"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(0, 44, 3)] + rows[40:42]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def _counted(docs, min_docs=2):
    """(term, entity): disclosure by plain counting over different texts."""
    held = {}
    for r in docs.select("text", personal_data.terms_of(F.col("text")).alias("terms")).collect():
        held[r["text"]] = set(r["terms"]) - set(personal_data.only_inside(r["text"]))
    values = {t: {(t or "")[a:b] for _, a, b in personal_data.base_spans(t)} for t in held}
    out, n = {}, len(held)
    for entity in set().union(*values.values()):
        own = [t for t in held if entity in values[t]]
        for term in set().union(*(held[t] for t in own)) if min_docs <= len(own) < n else ():
            both, every = sum(term in held[t] for t in own), sum(term in words for words in held.values())
            if both >= min_docs:
                out[term, entity] = np.log(n * both / (len(own) * every)) / np.log(n / len(own))
    return out


def test_terms_are_counted_once_for_each_text_and_not_shuffled(spark, monkeypatch):
    docs = _docs(spark)
    want = {k: v for k, v in _counted(docs).items() if v >= 0.05}
    for limits in ({}, {"BROADCAST_ROWS": 0}, {"BROADCAST_TERMS": 0}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(personal_data, name, value)
            found = personal_data.find_entities(docs, "doc_id", "text")
            got = personal_data.revealing_terms(docs, found, "doc_id", "text", 2, 0.05)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            rows = {(r["term"], r["entity"]): r["disclosure"] for r in got.collect()}
        assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-9 for k in want)
        # rows of one text and one term are not brought together
        assert not re.search(r"Aggregate \[(_hash#\d+L?, term#|term#\d+, _hash#)", plan)
