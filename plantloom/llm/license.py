"""Licence scan by a positional index of rare words, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table

# Words of letters, digits and non-ASCII characters, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COVERED = 0.8  # share of a template's word weight that an alignment must cover


@dataclass(frozen=True)
class Template:
    """Words of a licence text, its label, and phrases that must stand inside the alignment."""

    label: str
    text: str
    keys: tuple[str, ...] = field(default=())

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Phrases whose every exact place counts.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of"
                    " this software and associated documentation files", ("hereby granted",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution",)),
    Template("gpl-3", "licensed under the gnu general public license version 3",
             ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2",
             ("gnu general public license", "version 2")),
    Template("bsd", "redistribution and use in source and binary forms with or without"
                    " modification are permitted provided that the following conditions are met",
             ("source and binary forms",)),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0",
             ("mozilla public license",)),
)


def _hit(hits, k):
    return F.get(hits, k)


def _exact(hits, words: list[str], idf: dict[str, float]):
    """Starts of all places where the words stand one after the other."""
    a = max(range(len(words)), key=lambda j: idf[words[j]])

    def whole(x):
        ok = F.lit(True)
        for j, w in enumerate(words):
            if j != a:
                h = _hit(hits, x.k + (j - a))
                ok &= F.coalesce((h.i == x.h.i + (j - a)) & (h.w == w), F.lit(False))
        return ok

    return F.transform(F.filter(_anchors(hits, words[a]), whole), lambda x: x.h.i - a)


def _anchors(hits, word: str):
    """The index's hits of one word: (its place among the hits, the hit)."""
    rows = F.transform(hits, lambda h, k: F.when(h.w == word, F.struct(k.alias("k"), h.alias("h"))))
    return F.filter(rows, lambda x: x.isNotNull())


def _aligned(hits, t: Template, idf: dict[str, float]):
    """Alignments of a template: (start, covered share of its word weight).

    The anchors are its rarest words of together more weight than an accepted alignment may lack.
    """
    words, m = t.words, len(t.words)
    want, weight = F.array(*map(F.lit, words)), F.array(*[F.lit(idf[w]) for w in words])
    total = sum(idf[w] for w in words)

    anchors, lack = [], (1 - COVERED) * total
    for j in sorted(range(m), key=lambda j: -idf[words[j]]):
        anchors.append(j)
        if sum(idf[words[k]] for k in anchors) > lack * (1 + 1e-9):
            break

    def covered(a: int):
        def share_at(x):
            start = x.h.i - a
            near = F.slice(hits, F.greatest(x.k - a, F.lit(0)) + 1, F.lit(2 * m))
            share = F.aggregate(near, F.lit(0.0), lambda s, h: s + F.when(
                F.get(want, h.i - start) == h.w, F.get(weight, h.i - start)).otherwise(0.0))
            return F.struct(start.alias("start"), (share / total).alias("share"))

        return share_at  # of one parameter: a second one would get the element's index

    return F.array_distinct(F.concat(*[
        F.transform(_anchors(hits, words[a]), covered(a)) for a in anchors]))


def _any_within(places, start, room: int):
    return F.exists(places, lambda p: (p >= start) & (p <= start + room))


def _labelled(places, label: str):
    return F.transform(places, lambda p: F.struct(
        F.lit(label).alias("label"), p.cast("long").alias("start"), F.lit(1.0).alias("share")))


def scan_licenses(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    base=BASE, templates=TEMPLATES,
) -> DataFrame:
    """One row per input row with the places of base phrases and the labels found.

    ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``. One
    pass keeps the positions of licence words only (words of any template). Document frequencies
    of those words give their IDF; each template is looked up at the positions of as many of its
    rarest words as make up over 20 % of its IDF weight, its other words are intersected by relative position, and it matches where at least 80 % of its
    IDF weight stands in place and each key phrase stands inside it without a gap. Base phrases
    count at every exact place. ``labels`` are the base labels and those of matching templates;
    ``score`` is the best share of an accepted match; ``matches`` lists (label, start, share).

    NULL and empty texts have no words, no labels ('') and score 0. Rows may repeat. Other columns
    are not read. Nothing is shuffled but the counts of licence words.
    """
    vocabulary = sorted({w for t in (*base, *templates) for p in (t.text, *t.keys)
                         for w in p.split()})
    text = F.coalesce(q(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def licence_word(w, i):
        low = F.lower(w)
        return F.when(low.isin(vocabulary) & (F.octet_length(w) == F.length(low)),
                      F.struct(i.alias("i"), low.alias("w")))

    rows = stored(df.select(q(id_col).alias("_id"), words.alias("words")).select(
        "_id", F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", licence_word), lambda x: x.isNotNull()).alias("hits"),
    ), "license-hits")
    n = rows.count()
    df_of = {r.w: r["count"] for r in rows.select(F.explode(F.array_distinct(
        F.transform("hits", lambda h: h.w))).alias("w")).groupBy("w").count().collect()}
    idf = {w: math.log((n + 2) / (df_of.get(w, 0) + 1)) + 1e-6 for w in vocabulary}

    hits = F.col("hits")
    found = rows
    for i, t in enumerate(base):
        found = found.withColumn(f"_b{i}", _exact(hits, t.words, idf))
    for i, t in enumerate(templates):
        found = found.withColumn(f"_t{i}", _aligned(hits, t, idf))
        for j, key in enumerate(t.keys):
            found = found.withColumn(f"_k{i}_{j}", _exact(hits, key.split(), idf))

    def accepted(i: int, t: Template):
        def good(x):
            ok = x.share >= COVERED
            for j, key in enumerate(t.keys):
                room = len(t.words) - len(key.split())
                ok &= _any_within(F.col(f"_k{i}_{j}"), x.start, room)
            return ok

        return F.transform(F.filter(F.col(f"_t{i}"), good), lambda x: F.struct(
            F.lit(t.label).alias("label"), x.start.cast("long").alias("start"),
            x.share.alias("share")))

    exact = F.concat(*[_labelled(F.col(f"_b{i}"), t.label) for i, t in enumerate(base)])
    found = found.select("_id", "n_words", exact.alias("base"), F.concat(
        exact, *[accepted(i, t) for i, t in enumerate(templates)]).alias("matches"))

    def labels(c):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x.label))), ",")

    starts = F.transform("base", lambda x: x.start)
    best = F.array_max(F.transform("matches", lambda x: x.share))
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)).alias("score"), "matches")


def op7_license_scan(spark, sf: str) -> DataFrame:
    """Licences in all documents."""
    return scan_licenses(table(spark, sf, "documents")).drop("matches")
