"""Fingerprints, spelling variants and lexical search against plain Python, and on odd and empty inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import fingerprints, lexical, queries, spelling

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


# 11 fingerprints

def plain_phrases(text, levels):
    """Phrases of the highest level as substrings, by the rule of the docstring, symbol by symbol."""
    symbols = [(ord(c), c) for c in text]
    for _ in range(levels):
        runs = []
        for s, t in symbols:
            if runs and runs[-1][0] == s:
                runs[-1] = (s, runs[-1][1] + t, runs[-1][2] + 1)
            else:
                runs.append((s, t, 1))
        names = [s if n == 1 else int(fingerprints.mixed((np.array([s], np.uint64) + np.array([n], np.uint64) * fingerprints.STEP))[0]) for s, _, n in runs]
        labels = names
        for _ in range(4):
            new = [labels[0] & 1] if labels else []
            for before, own in zip(labels, labels[1:]):
                low = ((before ^ own) & -(before ^ own)).bit_length() - 1 if before != own else 0
                new.append(2 * low + (own >> low & 1))
            labels = new
        cuts = [i for i in range(len(names)) if i == 0 or 0 < i < len(names) - 1 and labels[i] < labels[i - 1] and labels[i] < labels[i + 1]]
        symbols = []
        for a, b in zip(cuts, cuts[1:] + [len(names)]):
            parts = np.array(names[a:b], np.uint64) + np.arange(1, b - a + 1, dtype=np.uint64) * fingerprints.STEP
            name = fingerprints.mixed(np.array([fingerprints.mixed(parts).sum()], np.uint64))[0]
            symbols.append((int(name), "".join(t for _, t, _ in runs[a:b])))
    return symbols


def test_parse_matches_plain_rule(small):
    texts = [t for _, t in small[:12]] + ["", "a", "aaaa", "abab", "ééé 😀😀", "xy" * 40]
    for levels in (1, 3):
        got = fingerprints.sketches(texts, levels, names=10**6, least=1)
        for text, sketch in zip(texts, got):
            want = plain_phrases(text, levels)
            assert sketch.get(levels, np.zeros(0)).tolist() == sorted({name >> 32 for name, _ in want})
            assert "".join(t for _, t in want) == text


def test_equal_substrings_share_phrases_at_any_offset(small):
    inner = "".join(t for _, t in small[:3])[:4000]
    for offset in (0, 1, 7, 100):
        phrases = [[t for _, t in plain_phrases(small[9][1][:offset] + inner, 3)], [t for _, t in plain_phrases(inner, 3)]]
        same = collections.Counter(phrases[0]) & collections.Counter(phrases[1])
        assert sum(same.values()) >= len(phrases[1]) - 4


def test_likeness_is_the_share_of_common_phrases(spark, small):
    a, b = small[0][1] * 3, small[0][1] * 2 + small[1][1]
    x, y = (fingerprints.sketches([t], 3, names=10**6)[0] for t in (a, b))
    sets = [{n for n, _ in plain_phrases(t, 3)} for t in (a, b)]
    assert fingerprints.alike(x, y, 10**6) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    frame = spark.createDataFrame([("", "", 1.0), ("1:00000001", "", 0.0), ("1:0000000100000002", "1:00000002", 0.5)], "a string, b string, want double")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", fingerprints.likeness(F.col("a"), F.col("b"))).collect())
    assert fingerprints.read(fingerprints.spelled(x)).keys() == x.keys()


@pytest.mark.parametrize("bucket_chars", [1 << 25, 40_000])
def test_edited_texts_follow_falling_ids(spark, small, monkeypatch, bucket_chars):
    monkeypatch.setattr(fingerprints, "BUCKET_CHARS", bucket_chars)
    monkeypatch.setattr(fingerprints, "CHARS", 20_000)
    rows = small + [(-5, None), (10**17 + 1, "abc"), (10**17, "defgh é"), (None, "left out")]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    ids = sorted((d for d, _ in rows if d is not None), reverse=True)
    text = {d: t or "" for d, t in rows}
    assert sorted(got, reverse=True) == ids
    for d, after in zip(ids, ids[1:] + ids[:1]):
        n = len(text[d])
        edited = text[d][: n - n // 3] + text[after][: n // 3]
        own, new, following = fingerprints.sketches([text[d], edited, text[after]])
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.spelled(own), fingerprints.spelled(new))
        assert r["near_edited"] == fingerprints.alike(own, new) and r["near_next"] == fingerprints.alike(own, following)
    long_ones = [r for d, r in got.items() if r["n_chars"] > 1500]
    assert np.mean([r["near_edited"] for r in long_ones]) > 0.35 and np.mean([r["near_next"] for r in long_ones]) < 0.15


def test_fingerprints_odd(spark, odd, empty):
    found = fingerprints.fingerprint(odd).collect()
    assert len(found) == odd.count() and {r["fingerprint"] for r in found if r["n_chars"] == 0} == {""}
    by_text = {i: r for i, r in zip([r[0] for r in H.odd_rows()], found)}
    assert by_text[4]["fingerprint"] == by_text[5]["fingerprint"] and by_text[9]["fingerprint"] == by_text[10]["fingerprint"]
    assert fingerprints.compare_edited(odd).count() == 13
    twice = odd.where("doc_id in (4, 9)").union(odd.where("doc_id in (4, 9)"))
    assert fingerprints.compare_edited(twice).count() == 4
    assert fingerprints.compare_edited(empty).count() == 0 and fingerprints.fingerprint(empty).count() == 0
    assert fingerprints.compare_edited(odd.where("doc_id = 9")).first()["near_next"] == 1


# 12 spelling variants

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0] if near and -near[0][0] >= 2 * n else None
        out[w] = (form and form[1], n, len(near), form and -form[0])
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (form, root(w), n, near, form_n) for w, (form, n, near, form_n) in out.items()}


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_variants_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    draws = random.Random(block)
    counts = {"".join(draws.choice("abcé") for _ in range(draws.randint(1, 6))): draws.choice([1, 2, 3, 5, 9, 20, 40]) for _ in range(300)}
    counts |= {"": 4, "😀b": 1, "z" * 3000: 1, "z" * 2999: 2, "y" + "z" * 2999: 7}
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == plain_variants(counts)


def test_blocks_meet_where_prefixes_allow():
    draws = random.Random(5)
    words = sorted({"".join(draws.choice("ab") for _ in range(draws.randint(1, 9))) for _ in range(300)})
    cut = [words[i : i + 4] for i in range(0, len(words), 4)]
    low, high = [c[0] for c in cut], [c[-1] for c in cut]
    for i in range(len(cut)):
        want = {j for j in range(i, len(cut)) if any(one_edit(a, b) for a in cut[i] for b in cut[j])}
        assert want <= set(spelling.meeting(low, high, i))
    wide = sorted("".join(draws.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(4000))
    cut = [wide[i : i + 4] for i in range(0, len(wide), 4)]
    low, high = [c[0] for c in cut], [c[-1] for c in cut]
    met = [len(spelling.meeting(low, high, i)) / (len(cut) - i) for i in range(0, 900, 7)]
    assert np.mean(met) < 0.2 and np.median(met) < 0.15


def test_count_words_with_dropout(spark, small):
    rows = small + [(9001, None), (9002, ""), (9003, "ÀÉÎÕü ÀÉÎÕü word×sign÷sign HELLO hello Hello"), (None, "hello " * 5)]
    want = collections.Counter()
    for d, t in rows:
        if d is not None:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{d}:{run}".encode())
                want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["word"]: r["n"] for r in spelling.count_words(frame, "doc_id", "text", dropout=97).collect()} == want


def test_spelling_odd(spark, odd, empty):
    words = spelling.count_words(odd, "doc_id", "text")
    assert {r["word"] for r in spelling.group_variants(words).collect()} >= {"boilerplate", "documents"}
    assert spelling.group_variants(spelling.count_words(empty, "doc_id", "text")).count() == 0


# 13 lexical search

def plain_ranking(docs, items, k):
    def terms(text):
        return re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    held = {d: collections.Counter(terms(t)) for d, t in docs if d is not None}
    held = {d: c for d, c in held.items() if c}
    n, total = len(held), sum(sum(c.values()) for c in held.values())
    df = collections.Counter(t for c in held.values() for t in c)
    asked = collections.defaultdict(set)
    for i, t in (x for x in items if x[0] is not None):
        asked[i] |= set(terms(t))
    out = []
    for i, want in asked.items():
        scores = []
        for d, c in held.items():
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,item_bytes,tiles", [(5, 1 << 24, (4096, 256, 1024)), (50, 400, (3, 2, 16))])
def test_ranking_matches_plain(spark, small, monkeypatch, k, item_bytes, tiles):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "TERM_TILE", tiles[0])
    monkeypatch.setattr(lexical, "ITEM_TILE", tiles[1])
    monkeypatch.setattr(lexical, "DOC_TILE", tiles[2])
    docs = small + [(9000 + i, small[3][1]) for i in range(8)] + [(9100, None), (9101, "..."), (None, small[3][1])]
    items = [(i, small[3 * i][1][:60] + " Éa") for i in range(12)] + [(3, "the"), (50, None), (51, "!?"), (None, "the"), (52, "unheardof")]
    got = lexical.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(tuple(r) for r in got.collect()) == plain_ranking(docs, items, k)


def test_term_tiles_keep_sums_exact():
    items = [np.arange(2000, dtype=np.int32)]
    tile = lexical.ItemTile(items, np.full(2000, 2**33 // 10))
    assert all(len(w) * (2**33 // 10) * lexical.MOST_IMPACT < 2**53 for _, w in tile.tiles) and len(tile.tiles) > 100
    term = np.arange(2000)
    got = tile.scores(np.zeros(2000, np.int64), term, np.full(2000, 999_999), 1)
    assert int(got[0, 0]) == 2000 * (2**33 // 10) * 999_999


def test_lexical_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "two words"), (2, "BOILERPLATE ünïcode")], "item_id long, text string, doc_id long, rank int".split(", doc")[0])
    found = lexical.rank_documents(odd, items).collect()
    assert [r["doc_id"] for r in found if r["item_id"] == 1][:2] == [9, 10]
    assert lexical.rank_documents(empty, items).count() == 0
    assert lexical.rank_documents(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("name,columns", [
    ("op11_fingerprints", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    ("op12_spelling", ["word", "form", "root", "n", "n_near", "form_n"]), ("op13_lexical_search", ["item_id", "rank", "doc_id", "score"]),
])
def test_query_columns(spark, name, columns):
    assert queries.QUERIES[name](spark, SMALL).columns == columns
