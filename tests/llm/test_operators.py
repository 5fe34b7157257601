"""Operators against plain Python on the smallest tables, and on odd and empty inputs."""

from __future__ import annotations

import collections
import hashlib
import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import (
    decontaminate, graph, induced_sort, jaccard_join, line_dedup, mixing, personal_data, quality, queries, suffix_dedup,
    token_rollup, topk, url_cascade, wordhash,
)
from counterpoise.session import new_path

from . import helpers as H

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(H.odd_rows(), H.DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# 1 URL filter

def test_url_parts_and_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    urls = ["http://EXAMPLE.com/en/1", "https://www.example.com/en/?q", "http://a.www.example.com/en/", "http://notexample.com/en/",
            "http://example.com", "ftp://example.org/en/", "no scheme", None, "", "x://", "http://example.com/EN/"]
    pages = spark.createDataFrame([(i, u, "keep", "clash") for i, u in enumerate(urls)], "page_id long, url string, row string, host string")
    found = {r["page_id"]: r for r in url_cascade.filter_urls(pages, rules).collect()}
    assert [found[i]["verdict"] for i in range(11)] == ["block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert [found[i]["rule"] for i in range(6)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", None, None]
    assert (found[0]["host"], found[0]["path"], found[0]["row"]) == ("example.com", "/en/1", "keep")
    assert all((found[i]["host"], found[i]["path"]) == ("", "") for i in (6, 7, 8, 9))


def test_url_blocked_hosts_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x"), (2, "http://good.org/x")], "page_id long, url string")
    hosts = spark.createDataFrame([("bad.org",), (None,), ("bad.org",)], "key string")
    found = {r["page_id"]: r["verdict"] for r in url_cascade.filter_urls(pages, [], hosts).collect()}
    assert found == {1: "block", 2: "allow"}
    assert url_cascade.filter_urls(pages.limit(0), queries.RULES, hosts).count() == 0


@pytest.mark.parametrize("first_bits", [2.0, 12.0])
def test_cascade_is_exact(spark, monkeypatch, first_bits):
    monkeypatch.setattr(url_cascade, "FIRST_BITS", first_bits)
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", 200)
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    names = universe.where("crc32(key) % 10 = 0")
    cascade = url_cascade.build_cascade(names, universe)
    assert cascade.shards > 1
    got = universe.select("key", url_cascade.listed(cascade, F.col("key")).alias("in")).where("in").select("key")
    want = {r[0] for r in names.collect()}
    assert {r[0] for r in got.collect()} == want
    assert {r["key"] for r in url_cascade.listed_by_shard(cascade, universe, "key").collect() if r["listed"]} == want


# 2 decontamination

def edited(text, share, seed):
    draws, w = np.random.default_rng(seed), text.split()
    for _ in range(int(share * len(w))):
        at, kind = int(draws.integers(len(w))), draws.integers(3)
        w[at : at + (kind != 1)] = ["qq" + str(draws.integers(99))] if kind != 2 else []
    return " ".join(w)


def test_leaks_exact_and_edited(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(H.words(t))
    docs = [(d, t) for d, t in small]
    planted = {}
    for n, (i, t) in enumerate(items * 2):
        noisy = edited(t, 0.08, n)
        docs.append((10_000 + n, "Some lead in here. " * (n % 5) + noisy + " and so on"))
        planted[10_000 + n, i] = t
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(
        frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    text_of = dict(docs)
    verbatim = {(d, i) for d, t in docs for i, x in items if plain(x) and f" {plain(x)} " in f" {plain(t)} "}
    assert verbatim <= set(got)
    near = {k for k, t in planted.items() if slow_distance(plain(t), plain(text_of[k[0]])) <= 0.2 * len(plain(t))}
    assert len(near & set(got)) >= 0.9 * len(near)
    for (d, i), r in list(got.items())[:40]:
        assert r["distance"] >= slow_distance(plain(dict(items)[i]), plain(text_of[d]))
        assert r["similarity"] >= 0.8 - 1e-9


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d)))
    return min(row)


def leak_copies(text, share, draws):
    """Copies of a normalised item with ``share`` of its characters edited, by kind of edit."""
    n = len(text)
    edits, letters = int(share * n), "abcdefghijklmnopqrstuvwxyz"
    other = lambda k: "".join(draws.choice(list(letters), k))
    typos = list(text)
    for at in sorted(draws.choice(n, edits, replace=False), reverse=True):
        kind = draws.integers(3)
        typos[at : at + (kind != 1)] = [other(1)] if kind != 2 else []
    at = int(draws.integers(n - edits + 1))
    return {"typos": "".join(typos), "block": text[:at] + other(edits) + text[at + edits :], "gap": text[:at] + text[at + edits :],
            "filling": text[:at] + other(edits) + text[at:], "head": other(edits) + text[edits:], "tail": text[: n - edits] + other(edits)}


def test_leaks_at_the_threshold_against_brute_force(spark):
    """Each kind of edit at similarity 0.8 to 0.9; the plain distance says which copies are leaks."""
    draws = np.random.default_rng(11)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()][:14]
    items += [(1000 + n, " ".join(t.split()[:k])) for n, ((_, t), k) in enumerate(zip(items, (3, 4, 5, 6, 8, 10, 12)))]
    docs, planted = [], {}
    for i, t in items:
        for share in (0.1, 0.15, 0.2):
            for kind, copy in leak_copies(" ".join(H.words(t)), share, draws).items():
                docs.append((len(docs), "some words before " * int(draws.integers(4)) + copy + " and some behind"))
                planted[docs[-1][0], i] = kind
    text_of, item_of = dict(docs), {i: " ".join(H.words(t)) for i, t in items}
    near = {(d, i): k for (d, i), k in planted.items() if slow_distance(item_of[i], " ".join(H.words(text_of[d]))) <= 0.2 * len(item_of[i]) + 1e-9}
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    held = {kind: np.mean([k in found for k, v in near.items() if v == kind]) for kind in set(near.values())}
    assert len(near) > 300 and min(held.values()) >= 0.98 and np.mean([k in found for k in near]) >= 0.99, held
    for d, i in list(near)[::10]:
        if (d, i) in found:
            words, r = H.words(text_of[d]), found[d, i]
            assert r["distance"] == slow_distance(item_of[i], " ".join(words))
            assert r["distance"] >= slow_distance(item_of[i], " ".join(words[r["first_word"] : r["end_word"]]))


def test_edit_distances_match_plain(spark):
    draws = np.random.default_rng(3)
    pairs = [("".join(draws.choice(list("abc"), draws.integers(0, 12))), "".join(draws.choice(list("abc"), draws.integers(0, 15)))) for _ in range(60)]
    got = decontaminate.edit_distances([(a, b, 100) for a, b in pairs if a])
    assert got == [slow_distance(a, b) for a, b in pairs if a]
    assert decontaminate.edit_distances([("aaaa", "bbbb", 1), ("aaaa", "aaab", 1)]) == [None, 1]


def test_leaks_odd_inputs(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, "word"), (4, "?!"), (5, "two words")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, items).collect()}
    assert found == {(d, i) for d in (9, 10) for i in (3, 5)}
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaking(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_leaks_in_blocks(spark, small):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = frame(spark, small)
    keys = ["doc_id", "item_id", "distance"]
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, items).select(keys).collect()))
    parts = sorted(map(tuple, decontaminate.find_leaks(docs, items, block_windows=300).select(keys).collect()))
    assert whole == parts and whole


# 3 quality

def test_quality_held_out_accuracy(spark):
    got = queries.QUERIES["op3_quality"](spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert ((held["predicted"] == held["quality"]).mean()) > 0.97
    ranks = held["score"].rank()
    good = held["quality"] == 1
    n, m = good.sum(), (~good).sum()
    assert (ranks[good].sum() - n * (n + 1) / 2) / (n * m) > 0.97
    assert got["score"].between(0, 1).all()


def test_quality_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(1, 14)], "doc_id long, quality int")
    scored = quality.score_documents(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    alike = {r["doc_id"]: r["score"] for r in scored}
    assert alike[1] == alike[2] and alike[4] == alike[5]
    assert len({r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()}) == 1
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_tree_paths():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0\n   Else (feature 1 > 2.0)\n    Predict: 1\n  Else (feature 0 > 1.5)\n   Predict: 1"
    assert quality.tree_paths(text, ["a", "b"]) == [
        (("a", True, 1.5),), (("a", True, 1.5), ("b", True, 2.0)), (("a", True, 1.5), ("b", False, 2.0)), (("a", False, 1.5),)]
    assert quality.simplified((("a", True, 3.0), ("a", True, 2.0), ("a", False, 1.0))) == (("a", False, 1.0), ("a", True, 2.0))


# 4 personal data

def test_base_spans_match_patterns(small):
    tricky = ["a@b.c@d.e f@g", "x..y@z-.q..r", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.004", "0000000000000255.1.1.1", "+1 (386) 555-3733.",
              "+12345678 +1-2", "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111", "é@b.c", "@b.c", "a@b", "😀 a.b@c.d 10.0.0.1", None, "",
              "1" * 5000, "a" * 5000, "1." * 3000, "+" * 50 + "1" * 20, "a@" * 500]
    for text in tricky + [t for _, t in small]:
        assert personal_data.base_spans(text) == H.personal_spans(text)


def test_disclosing_terms(spark, odd, empty):
    rows = [(i, f"mail bob@x.org about zebra number {i} w{i % 7}") for i in range(6)]
    rows += [(100 + i, f"other text about number {i} w{i % 7}") for i in range(60)]
    found = {r["doc_id"]: r for r in personal_data.sanitise(frame(spark, rows)).collect()}
    text = rows[0][1]
    at = text.index("zebra")
    assert ("term", at, at + 5) in [tuple(s) for s in found[0]["spans"]]
    assert found[0]["clean"].startswith("[TERM] [EMAIL]") or found[0]["clean"].startswith(" [EMAIL]")
    assert "zebra" not in found[0]["clean"] and "about" in found[0]["clean"]
    assert not found[100]["spans"] and found[100]["clean"] == rows[6][1]
    strange = personal_data.sanitise(odd).collect()
    assert len(strange) == odd.count() and all(not r["spans"] for r in strange)
    assert personal_data.sanitise(empty).count() == 0


def test_disclosure_with_copies(spark):
    """Entity and term in three texts only, each copied 200 times."""
    rows = [(i, f"mail bob@x.org about zebra {'one two three'.split()[i % 3]}") for i in range(600)]
    rows += [(1000 + i, f"other text about number {i}") for i in range(300)]
    found = {r["doc_id"]: r for r in personal_data.sanitise(frame(spark, rows)).collect()}
    assert all("zebra" not in found[i]["clean"] for i in range(600))
    docs = frame(spark, rows)
    got = personal_data.revealing_terms(docs, personal_data.find_entities(docs, "doc_id", "text"), "doc_id", "text").collect()
    assert {r["term"]: round(r["disclosure"], 9) for r in got}["zebra"] == 1


def test_name_in_address_and_prose(spark):
    """Only the places outside base spans count."""
    rows = [(i, f"write john.smith@acme.com as smith said {i}") for i in range(6)]
    rows += [(100 + i, f"other text said {i}") for i in range(60)] + [(200 + i, f"mail x{i}@smith.org said {i}") for i in range(6)]
    found = {r["doc_id"]: r for r in personal_data.sanitise(frame(spark, rows)).collect()}
    at = rows[0][1].index("smith said")
    assert ("term", at, at + 5) in [tuple(s) for s in found[0]["spans"]]
    assert "smith" not in found[0]["clean"] and "said" in found[0]["clean"]
    assert personal_data.only_inside("john a@john.org smith@x.org") == ["a", "org", "smith", "x"]


# 5 token counts

def test_ledger(spark):
    ledger = token_rollup.TokenLedger(spark, new_path(spark, "ledger-test"))
    assert ledger.totals().count() == 0
    feed = lambda *rows: spark.createDataFrame(rows, token_rollup.FEED)
    first = feed(("insert", 1, "a", "en", "t", 5), ("insert", 2, None, None, "t", 7), ("insert", 2, None, None, "u", 1),
                 ("insert", None, "a", "en", "t", 9), ("insert", 3, "a", "en", "t", None), ("odd", 4, "a", "en", "t", 1),
                 ("insert", 1, "a", "en", "t", 5))
    assert ledger.commit(1, first)
    total = lambda: {(r[0], r[1], r[2]): (r[3], r[4]) for r in ledger.totals().collect()}
    assert total() == {("a", "en", "t"): (2, 5), (None, None, "t"): (1, 7), (None, None, "u"): (1, 1)}
    second = feed(("revise", 1, "b", "en", "t", 50), ("delete", 2, None, None, None, None), ("delete", 99, None, None, None, None),
                  ("revise", 8, "c", "de", "t", 2))
    assert ledger.commit(2, second)
    after = {("a", "en", "t"): (1, 0), ("b", "en", "t"): (1, 50), ("c", "de", "t"): (1, 2)}
    assert total() == after
    assert not ledger.commit(2, second) and not ledger.commit(1, first)
    assert total() == after
    # a batch that was written but not recorded does not count, and can be sent again
    feed(("insert", 5, "z", "z", "t", 1)).write.parquet(f"{ledger.folder}/deltas/batch=3")
    assert total() == after
    assert ledger.commit(3, feed()) and total() == after


def test_token_counts_and_rollup(spark, small):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=queries.SPLIT, mergeable_ranks=ranks, special_tokens={})
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    want, seen = collections.defaultdict(lambda: [0, 0]), set()
    for _, source, lang, text in sorted(docs):
        if text in seen:
            continue
        seen.add(text)
        for name, n in (("words", len(re.findall(r"\S+", text))), ("byte_bpe_50k", len(encoder.encode_ordinary(text)) + 1)):
            want[source, lang, name][0] += 1
            want[source, lang, name][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in queries.QUERIES["op5_token_rollup"](spark, SMALL).collect()}
    assert got == dict(want)


def test_token_counts_odd(spark, odd, empty):
    got = token_rollup.count_tokens(odd, queries.VOCABULARY, queries.SPLIT).collect()
    assert len(got) == odd.count() and {r["tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert token_rollup.count_tokens(empty, queries.VOCABULARY, queries.SPLIT).count() == 0


# 6 n-gram Jaccard join

@pytest.mark.parametrize("chunk,members", [(60, 1 << 12), (1 << 17, 1 << 12), (1 << 17, 5)])
def test_jaccard_join_matches_all_pairs(spark, small, chunk, members):
    base = "the quick brown fox jumps over the lazy dog while many other animals look on from the edge of a dark wood".split()
    family = [(5000 + i, " ".join(base + [f"tail{i % 3}"] + (["more"] if i % 2 else []))) for i in range(12)]
    docs = small + family
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(frame(spark, docs), chunk_shingles=chunk, chunk_members=members).collect()}
    assert got == H.jaccard_groups(docs)


@pytest.mark.parametrize("cells,light", [(1 << 22, 32), (5000, 2)])
def test_jaccard_tile_of_form_letters(monkeypatch, cells, light):
    monkeypatch.setattr(jaccard_join, "STRIPE_CELLS", cells)
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    # letters of 13 words that differ in one word near the end, in two families, and some unlike all others
    texts = [f"dear sir or madam we write to say{'' if i % 2 else ' again'} that your order is number{i % 700 // 2}" for i in range(1500)]
    texts = list(dict.fromkeys(texts)) + [" ".join(f"own{i}x{j}" for j in range(13)) for i in range(50)]
    docs = np.random.default_rng(3).permutation(len(texts)) * 10
    tile = pd.DataFrame({"_doc": docs, "_size": 1 + docs % 3, "_bands": [[int(i % 11 == 0), 5] for i in docs], "_band": 1, "_hash": 5,
                         "_ci": 0, "_cj": 0, "_chunk": 0, "_text": texts})
    cut = tile.assign(_chunk=docs % 4 // 2 * 3, _cj=3)
    for t in (tile, cut):
        sets = [H.shingle_set(x) for x in texts]
        links, up = collections.Counter(), {d: d for d in docs}
        for i in range(len(texts)):
            for j in range(i):
                a, b = docs[i], docs[j]
                apart = t["_ci"][0] == t["_cj"][0] or t["_chunk"][i] != t["_chunk"][j]
                if not apart or (a % 11 == 0) == (b % 11 == 0):
                    continue
                c = len(sets[i] & sets[j])
                if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                    links[a] += 1 + b % 3
                    links[b] += 1 + a % 3
                    low, high = sorted((up[a], up[b]))
                    up = {d: low if r == high else r for d, r in up.items()} if low != high else up
        got = next(jaccard_join.tile_links(5, 0.8)(iter([t])))
        assert dict(zip(got["_doc"], got["_links"])) == dict(links)
        assert dict(zip(got["_doc"], got["_root"])) == {d: up[d] for d in links}


def test_jaccard_join_odd(spark, odd, empty):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(odd).collect()}
    assert got == H.jaccard_groups([r[:2] for r in H.odd_rows() if r[0] is not None])
    assert got[5] == (4, 1) and got[10] == (9, 1) and got[1] == (1, 0)
    assert jaccard_join.jaccard_join(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_band_plan():
    bands, rows = jaccard_join.band_plan()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (None, 1), (1, 2), *[(i, i + 1) for i in range(100, 140)]]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 141)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_match_words():
    texts = ["One two three four five six", "", None, "Ünïcode words_and 123", "a b c d", "x " * 50]
    hashes, first, *_ = wordhash.word_hashes(texts)
    values, at = wordhash.shingles(hashes, first, 5)
    for i, t in enumerate(texts):
        w = H.words(t)
        assert first[i + 1] - first[i] == len(w)
        assert at[i + 1] - at[i] == (len(w) - 4 if len(w) >= 5 else int(bool(w)))
        assert len(set(values[at[i] : at[i + 1]].tolist())) == len(H.shingle_set(t))


# 7 line dedup

def test_line_dedup_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect() if r["doc_id"]}
    assert [got[i]["text"] for i in (1, 2, 6, 7, 8, 11)] == ["", "", "first tail", "second tail", H.SHARED, "\n\n\n"]
    assert [(got[i]["_n_lines"], got[i]["_n_dropped"]) for i in (1, 6, 7, 8, 11)] == [(1, 0), (2, 1), (2, 1), (1, 0), (4, 0)]
    assert line_dedup.dedup_lines(odd).columns == [*odd.columns, "_n_lines", "_n_dropped"]
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(empty).count() == 0


# 8 top k

def test_topk_matches_brute_force(spark):
    draws = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draws.normal(size=(400, 12)))]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    rows += [(2000, None), (2001, [1.0, None] * 6), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2050, []), (2100, [1.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows[:-6] + rows[-1:]}
    want = {}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_topk_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 768 * 256 - 256 * 512)]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_stops_on_proof():
    draws = np.random.default_rng(4)
    x = np.floor(256 * np.abs(draws.normal(size=(3000, 8)) ** 3)).astype(np.int64)
    table = topk.build_shard((0,), pd.DataFrame({"_id": np.arange(3000), "_x": list(x)})).iloc[0]
    shard = topk.Shard(table["ids"], table["vectors"], table["postings"], table["starts"], 8)
    work = []
    for q in range(20):
        ids, scores, processed = shard.search(q, x[q], 5)
        want = sorted((-int(x[q] @ v), i) for i, v in enumerate(x) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
        work.append(processed / x.size)
    assert min(work) < 1


# 9 suffix array

def test_induced_order():
    draws = np.random.default_rng(1)
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        for t in range(120):
            x = np.append(draws.integers(1, draws.integers(2, 6), draws.integers(1, 60)), 0)
            x = np.append(np.tile(x[:-1], 3), 0) if t % 3 == 0 else x
            letters = x.tolist()
            want = sorted(range(len(letters)), key=lambda i: letters[i:])
            assert induced_sort.suffix_order(x, folder, None, [64, 1 << 20][t % 2], 2).tolist() == want


@pytest.mark.parametrize("length,gram", [(400, 64), (60, 20)])
def test_suffix_dedup_matches_lookup(spark, small, monkeypatch, length, gram):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    rows = small + [(9001, "ab" * 600), (9002, None), (9003, ""), (9004, "é" * 500), (9005, "x" * 399)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=length, gram=gram).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got}
    assert found == H.removed_bytes(rows, length)


def test_suffix_dedup_odd(spark, odd, empty):
    assert suffix_dedup.remove_repeats(odd).count() == 13
    assert suffix_dedup.remove_repeats(empty).count() == 0


# 10 mixing

def check_mix(rows, got):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    sources = collections.Counter()
    for d, _, s in rows:
        sources[s] += size[d]
    want, taken = H.mix_targets(sources), collections.Counter()
    more = {}
    for d, _, s in rows:
        r = got[d]
        assert (r["size"], r["source_size"]) == (size[d], sources[s])
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * size[d] and r["taken"] == size[d] * len(r["places"])
        taken[s] += r["taken"]
        if 0 < size[d] and r["taken"] < 3 * size[d]:
            more[s] = min(more.get(s, size[d]), size[d])
    for s in sources:
        assert taken[s] <= want[s] + 1e-6 and (s not in more or want[s] - taken[s] < more[s])


def test_mix_targets_and_copies(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in table.collect()]
    plan = mixing.plan_mix(table).collect()
    got = {r["doc_id"]: r for r in plan}
    check_mix(rows, got)
    again = {r["doc_id"]: r for r in mixing.plan_mix(table.repartition(5)).collect()}
    assert got == again
    mixed = mixing.mix(table).collect()
    assert collections.Counter(r["doc_id"] for r in mixed) == collections.Counter({d: len(r["places"]) for d, r in got.items() if r["places"]})
    assert {(r["doc_id"], r["shard"]) for r in mixed} == {(d, p["shard"]) for d, r in got.items() for p in r["places"]}


def test_mix_odd(spark, odd, empty):
    rows = [(r[0], r[1], r[3]) for r in H.odd_rows()]
    known = [r for r in rows if r[0] is not None]
    plan = mixing.plan_mix(odd.where("doc_id is not null")).collect()
    check_mix(known, {r["doc_id"]: r for r in plan})
    assert mixing.plan_mix(odd).count() == odd.count()
    assert mixing.mix(odd).columns[:5] == odd.columns[:5]
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_meets_targets_beside_giant_documents(spark):
    # by place in the permuted order: one document of 40 % or 60 % of its source, others of 7 to 11 words
    order = spark.range(200).select("id", mixing.draw("mix", F.lit("order"), F.col("id")).alias("u")).orderBy("u").collect()
    rows = []
    for n, place in enumerate((0.1, 0.5, 0.9)):
        for share in (0.4, 0.6):
            ids = [r["id"] + 1000 * (2 * n + (share == 0.6)) for r in order]
            source, giant = f"s{n}{share}", round(199 * 9 * share / (1 - share))
            placed = spark.createDataFrame([(i,) for i in ids], "id long").orderBy(mixing.draw("mix", F.lit("order"), F.col("id")))
            for i, r in enumerate(placed.collect()):
                rows.append((r["id"], "w " * (giant if i == int(200 * place) else 7 + i % 5), source))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.plan_mix(table, shards=4).collect()}
    check_mix(rows, got)
    taken = collections.Counter()
    for d, _, s in rows:
        taken[s] += got[d]["taken"]
    assert all(taken[s] > got[d]["target"] - 12 for d, _, s in rows)


def test_split_quotas_are_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 25), ("c", 0), ("d", 7)], "_source string, _blocks long")
    for shards in (1, 5, 16):
        leaves = mixing.split_quotas(quotas, shards).toPandas()
        assert leaves.groupby("_source")["_blocks"].sum().to_dict() == {"a": 40, "b": 25, "c": 0, "d": 7}
        sizes = leaves.groupby("shard")["_blocks"].sum()
        assert len(sizes) == shards and sizes.sum() == 72
        if shards == 16:
            assert sizes.max() - sizes.min() <= 2
    draws = spark.range(4000).select(
        mixing.hypergeometric((F.col("id") + 0.5) / 4000, F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long")).alias("x"))
    values = draws.toPandas()["x"]
    assert values.between(0, 10).all() and abs(values.mean() - 4) < 0.02
    assert abs(values.var() - 10 * 0.4 * 0.6 * 20 / 29) < 0.05


def test_places_are_json(spark):
    row = queries.QUERIES["op10_mixing"](spark, SMALL).where("taken > 0").first()
    assert json.loads(row["places"])[0].keys() == {"shard", "position"}
