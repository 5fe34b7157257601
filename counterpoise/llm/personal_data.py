"""Personal data: exact base spans, then terms that give protected entities away.

Base spans follow fixed patterns.  Their values are the protected entities.  How strongly a
term reveals an entity is estimated from the whole corpus: the pointwise mutual information
of both in one document, as a share of the entity's own information content.  A term that
appears (almost) only beside an entity reveals it; it is removed or generalised with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

KINDS = ("email", "ip", "card", "phone")
MIN_DOCS = 3
REMOVE_AT = 0.9
GENERALISE_AT = 0.6
WORD = r"[\p{L}\p{N}_]+"
BROADCAST_TERMS = 50_000
BROADCAST_ROWS = 500_000

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_before_at = re.compile(r"[A-Za-z0-9._%+-]")
# possessive runs and the look-behind keep long digit runs linear; matches are the same
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@``: the run before it starts a match, or nothing does."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _before_at.match(text[start - 1]):
            start -= 1
        met = _domain.match(text, at + 1) if start < at else None
        if met:
            found.append((start, met.end()))
            last = met.end()
        at = text.find("@", max(at + 1, last))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ip.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _phone.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then by start."""
    text = text or ""
    return [(k, a, b) for k in KINDS for a, b in FINDERS[k](text)]


def only_inside(text: str | None) -> list[str]:
    """Lower-case words that a text holds in base spans only."""
    text = text or ""
    taken = sorted((a, b) for _, a, b in base_spans(text))
    inside, outside, k, reach = set(), set(), 0, 0
    for m in _word.finditer(text) if taken else ():
        # spans of different kinds may overlap: ``reach`` is how far those begun so far go
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][1]), k + 1
        (inside if reach > m.start() else outside).add(m[0].lower())
    return sorted(inside - outside)


def find_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``_doc``, ``_hash``, ``_values``, ``_inside``) of the documents that hold an entity.

    ``_hash`` names the text, ``_inside`` are those of its terms that appear in base spans only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [sorted({(t or "")[a:b] for _, a, b in base_spans(t)}) for t in batch["text"]]
            some = [bool(v) for v in values]
            yield pd.DataFrame({
                "_doc": batch["doc"][some], "_hash": batch["hash"][some], "_text": batch["text"][some],
                "_values": pd.Series([v for v in values if v], dtype=object).to_numpy(),
                "_inside": pd.Series([only_inside(t) for t in batch["text"][some]], dtype=object).to_numpy(),
            })

    kind = dict(docs.dtypes)[id_col]
    given = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")
    )
    found = given.mapInPandas(run, f"_doc {kind}, _hash long, _text string, _values array<string>, _inside array<string>")
    # the words of both engines may differ in rare letters: hidden terms are counted off the terms below
    return found.select("_doc", "_hash", "_values", F.array_intersect("_inside", terms_of(F.col("_text"))).alias("_inside"))


def terms_of(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1))


def each_once(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row (``_hash``, ``_text``) per different text; ``sizes`` has how often each hash occurs.

    Texts without copies stay where they are read, and only the others are shuffled, unless there
    are too many names of them to be sent to every task.
    """
    rows, copied = texts.select("_hash", "_text"), sizes.where(F.col("_n") > 1).select("_hash")
    if copied.count() > BROADCAST_ROWS:
        return rows.groupBy("_hash").agg(F.min("_text").alias("_text"))
    copies = rows.join(F.broadcast(copied), "_hash", "left_semi").groupBy("_hash").agg(F.min("_text").alias("_text"))
    return rows.join(F.broadcast(copied), "_hash", "left_anti").unionByName(copies)


def revealing_terms(
    docs: DataFrame, found: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS,
    threshold: float = GENERALISE_AT,
) -> DataFrame:
    """(``term``, ``entity``, ``disclosure``) for pairs above the threshold.

    disclosure = log(n * both / (entity * term)) / log(n / entity) with counts of different
    texts over the whole corpus: 1 if the term never appears without the entity, 0 if they are
    independent.  Entities, and pairs, in fewer than ``min_docs`` different texts say nothing.
    All counts combine before they are shuffled; documents' words are paired with the few
    entities of the same document only.
    """
    # a further copy of the same text is no further evidence, for the terms and the whole as for entities
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")
    )
    sizes = materialize(texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    n = sizes.count()
    once = found.groupBy("_hash").agg(F.min_by(F.struct("_doc", "_values", "_inside"), "_doc").alias("_first"))
    named = once.select("_first._doc", F.explode("_first._values").alias("entity"))
    common = named.groupBy("entity").agg(F.count(F.lit(1)).alias("_e")).where((F.col("_e") >= min_docs) & (F.col("_e") < n))
    holding = materialize(named.join(common, "entity"), "holding")
    ids = holding.select(F.col("_doc").alias("_id")).distinct()
    words = texts.join(ids, "_id").select("_id", F.explode(terms_of(F.col("_text"))).alias("term"))
    # occurrences in base spans belong to these spans
    hidden = once.select("_first._doc", "_hash", F.explode("_first._inside").alias("term"))
    words = words.join(hidden.select(F.col("_doc").alias("_id"), "term"), ["_id", "term"], "left_anti")
    pairs = holding.join(words, holding["_doc"] == words["_id"]).groupBy("entity", "_e", "term").agg(F.count(F.lit(1)).alias("_both"))
    pairs = materialize(pairs.where(F.col("_both") >= min_docs), "pairs")
    wanted = materialize(pairs.select("term").distinct(), "terms")
    everywhere = each_once(texts, sizes).select(F.explode(terms_of(F.col("_text"))).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        everywhere = everywhere.join(F.broadcast(wanted), "term")
    # every text has a term once, so counts combine in their tasks; what spans hide is taken off again
    less = hidden.groupBy("term").agg(F.count(F.lit(1)).alias("_less"))
    counted = everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("_all")).join(wanted, "term").join(less, "term", "left")
    counted = counted.select("term", (F.col("_all") - F.coalesce("_less", F.lit(0))).alias("_t"))
    rows = F.lit(float(n))
    share = F.log(rows * F.col("_both") / (F.col("_e") * F.col("_t"))) / F.log(rows / F.col("_e"))
    scored = pairs.join(counted, "term").select("term", "entity", share.alias("disclosure"))
    return scored.where(F.col("disclosure") >= threshold)


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """(``id_col``, ``base``, ``spans``, ``clean``) of every row.

    ``base`` and ``spans`` are arrays of (kind, first, last) in code points, ``last`` exclusive.
    ``spans`` adds ``term`` spans: in a document that holds an entity, the words whose
    disclosure of it reaches a threshold and that lie outside base spans.  ``clean`` is the text with
    base spans replaced by ``[KIND]``, words from ``generalise_at`` by ``[TERM]`` (``[NUMBER]``
    for digits), and words from ``remove_at`` taken out.  Null texts count as empty; ids must be
    unique; a row without an id gets its base spans only.
    """
    found = materialize(find_entities(docs, id_col, text_col), "entities")
    revealing = materialize(revealing_terms(docs, found, id_col, text_col, min_docs, generalise_at), "revealing")
    named = found.select("_doc", F.explode("_values").alias("entity")).join(revealing, "entity")
    marked = named.groupBy("_doc", "term").agg(F.max("disclosure").alias("level"))
    marked = materialize(marked.groupBy("_doc").agg(F.collect_list(F.struct("term", "level")).alias("_terms")), "marked")
    kind = dict(docs.dtypes)[id_col]
    span = "array<struct<kind:string,first:int,last:int>>"

    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    few = (marked.agg(F.sum(F.size("_terms"))).first()[0] or 0) <= BROADCAST_ROWS
    both = given.join(F.broadcast(marked) if few else marked, given["_id"] == marked["_doc"], "left").drop("_doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [cleaned(t, m, remove_at) for t, m in zip(batch["_text"], batch["_terms"])]
            yield pd.DataFrame({
                "_id": batch["_id"].to_numpy(), "clean": [r[2] for r in rows],
                **{c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(("base", "spans"))},
            })

    out = both.select("_id", "_text", "_terms").mapInPandas(run, f"_id {kind}, base {span}, spans {span}, clean string")
    return out.withColumnRenamed("_id", id_col)


def cleaned(text: str | None, terms, remove_at: float) -> tuple[list, list, str]:
    """One document's base spans, all spans and clean text."""
    text, base = text or "", base_spans(text)
    levels = {t["term"]: t["level"] for t in terms} if terms is not None else {}
    taken = sorted((a, b) for _, a, b in base)
    found, k = [], 0
    for m in _word.finditer(text) if levels else ():
        if m[0].lower() not in levels:
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            found.append(("term", m.start(), m.end()))
    out, at = [], 0
    for kind, a, b in sorted(base + found, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif levels[text[a:b].lower()] < remove_at:
            out.append("[NUMBER]" if text[a:b].isdigit() else "[TERM]")
        at = b
    out.append(text[at:])
    rows = [[{"kind": k, "first": a, "last": b} for k, a, b in part] for part in (base, base + found)]
    return rows[0], rows[1], "".join(out)


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
