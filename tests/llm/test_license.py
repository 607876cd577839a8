import re

import math

from plantloom.llm.license import BASE, COVERED, TEMPLATES, op7_license_scan, scan_licenses

from .brute import ODD_SCHEMA, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [(i, t.label) for t in BASE for i in range(len(words))
              if words[i: i + len(t.words)] == t.words]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def got_of(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_documents(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_license_scan(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert got_of(r) == plain(text[r.doc_id])
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
        assert ("GNU General Public License, version 3" in (text[r.doc_id] or "")) == (
            "gpl-3" in r.labels)


def test_planted_texts(spark):
    texts = [
        "Under the MIT License. under THE mit-license; under the mit licence",
        "apache license version 2 apache license version 2 0 cc by nc cc by cc by nc",
        "permission is hereby granted, free of charge, to any person getting a copy of this software"
        " and associated documentation files",
        "permission granted free of charge to any person obtaining a copy",
        "the the the under under mit mit license license " * 2000,
        "under the mit license " * 3000, "cc BY\x00nc", "Kcc by nc cć by nc",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert got_of(got[i]) == plain(t), t[:60]
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1 and got[3].labels == ""


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA).withColumnRenamed("size", "hits")
    got = scan_licenses(df).collect()
    assert len(got) == len(odd_rows())
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in got)
    assert scan_licenses(df.limit(0)).count() == 0


def test_near_copies_without_the_rarest_word(spark):
    exact = ("permission is hereby granted free of charge to any person obtaining a copy of this"
             " software and associated documentation files")
    texts = [exact] * 2 + [exact.replace("obtaining", "getting")] * 5 + ["plain words"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert all(got[i].labels == "mit" and len(got[i].matches) == 1 for i in range(7))
    assert got[0].score > 0.999 and 0.8 <= got[2].score < 0.999 and got[7].labels == ""


def aligned(texts):
    """Per text the (label, start, share) of each template by trying every start."""
    docs = [WORD.findall((t or "").translate(UPPER)) for t in texts]
    vocabulary = {w for t in (*BASE, *TEMPLATES) for p in (t.text, *t.keys) for w in p.split()}
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    idf = {w: math.log((len(docs) + 2) / (df[w] + 1)) + 1e-6 for w in vocabulary}
    out = []
    for words in docs:
        found = []
        for t in BASE:
            found += [(t.label, i, 1.0) for i in range(len(words))
                      if words[i: i + len(t.words)] == t.words]
        for t in TEMPLATES:
            total = sum(idf[w] for w in t.words)
            for start in range(-len(t.words), len(words)):
                share = sum(idf[w] for j, w in enumerate(t.words)
                            if 0 <= start + j < len(words) and words[start + j] == w) / total
                inside = words[max(start, 0): start + len(t.words)]
                keys = all(any(inside[i: i + len(k.split())] == k.split() for i in range(len(inside)))
                           for k in t.keys)
                if share >= COVERED and keys:
                    found.append((t.label, start, share))
        out.append(found)
    return out


def test_every_template_where_it_stands(spark):
    pad = "one two three four five six seven "
    texts = [p + t.text for t in TEMPLATES for p in ("", pad)]
    texts += [pad + " ".join(w if j != len(t.words) // 2 else "changed" for j, w in enumerate(t.words))
              for t in TEMPLATES]
    texts += [pad * 9, "", TEMPLATES[0].text + " and " + TEMPLATES[5].text, *[pad] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, want in enumerate(aligned(texts)):
        mine = sorted((m.label, m.start, round(m.share, 9)) for m in got[i].matches)
        assert mine == sorted((a, b, round(c, 9)) for a, b, c in want), texts[i]
    for i, t in enumerate(TEMPLATES):
        for j, start in ((2 * i, 0), (2 * i + 1, 7)):
            assert (t.label, start) in [(m.label, m.start) for m in got[j].matches]
            assert t.label in got[j].labels.split(",") and got[j].score > 0.999
