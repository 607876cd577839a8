import hashlib
import math
import random
import re
from collections import Counter

import pytest

from plantloom.llm.private import KINDS, find_private, op11_sanitise, sanitise

from .brute import ODD_SCHEMA, odd_rows

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
SCHEMA = "doc_id long, text string"


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return (True, kind == 1 and all(int(p) <= 255 for p in hit.split(".")),
            14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[kind]


def base(text):
    """(start, kind, end) of personal data by the plain forms."""
    return sorted((m.start(), k, m.end()) for k, form in enumerate(PLAIN)
                  for m in form.finditer(text or "") if holds(k, m.group()))


def spans_of(r):
    return [(s.start, s.kind, s.end) for s in r.spans]


def card(rnd, n):
    d = "".join(rnd.choices("0123456789", k=n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_forms_on_random_texts(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("a1@.-+ ()9_é\U0001f600", [5, 6, 3, 5, 2, 1, 2, 1, 1, 4, 1, 1, 1],
                                 k=rnd.randrange(120))) for _ in range(1500)]
    texts += [rnd.choice(["é ", "\U0001f600", "", "x"]) + sep.join(
        card(rnd, n)[i: i + 4] for i in range(0, n, 4)) + rnd.choice(["", "-", " 7"])
        for n in range(12, 22) for sep in ("", " ", "-") for _ in range(4)]
    texts += ["+1 (456) 555-2186", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256",
              "é+44 20 7946 0958 x@y.zé 10.0.0.1", "9" * 400, "1.2.3." + "0" * 50 + "4"]
    rows = list(enumerate(texts))
    got = {r.doc_id: spans_of(r) for r in find_private(
        spark.createDataFrame(rows, SCHEMA), support=10 ** 6).collect()}
    assert sum(map(len, got.values())) > 300
    for i, t in rows:
        assert got[i] == base(t), t


def test_query_on_documents(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_sanitise(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = base(text[r.doc_id])
        kinds = Counter(k for _, k, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in range(4))
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == listed
    assert sum(r.n_email for r in rows) > 0


def disclosing(texts, bits=1.0, support=3):
    """{term: replacement} by counting, for e-mail addresses only."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    f = Counter(w.lower() for t in texts for w in word.findall(t))
    both, contexts = Counter(), {}
    for t in texts:
        hits = list(PLAIN[0].finditer(t))
        for i, m in enumerate(hits):
            left = t[hits[i - 1].end() if i else 0: m.start()]
            right = t[m.end(): hits[i + 1].start() if i + 1 < len(hits) else len(t)]
            assert len(left) < 160 and len(right) < 160
            near = word.findall(left)[-8:] + word.findall(right)[:8]
            for w in near:
                both[m.group().lower(), w.lower()] += 1
                contexts.setdefault((m.group().lower(), w.lower()), set()).add(tuple(near))

    def general(t):
        m = re.sub("[0-9]", "#", t)
        return m if m != t else t[:2] + "*"

    out = {}
    for (c, t), n in both.items():
        if len(contexts[c, t]) >= support and math.log2(f[t] / n) <= bits:
            g = general(t)
            left = sum(m for (d, u), m in both.items() if d == c and general(u) == g)
            hides = left * 2 ** bits < sum(m for u, m in f.items() if general(u) == g)
            out[t] = g if hides and out.get(t) != "" else ""
    return out


TEXTS = [
    "Write to Aurelia Vance at a.vance@x.org for the file",
    "the desk of Aurelia is a.vance@x.org in Room 4711 today",
    "ask Aurelia (A.Vance@x.org) or the office about room 4711",
    "we saw that aurelia spoke; a.vance@x.org and 4711 again the",
    "the Aurelia files", "auction autumn author august au pair " * 3,
    "the office and the room are for the file to be at in or about " * 3,
    "mail b@y.net the quartz", "mail b@y.net a quartz", "mail b@y.net quartz room",
]


def test_disclosing_terms(spark):
    want = disclosing(TEXTS)
    assert want["aurelia"] == "au*" and want["quartz"] == "" and "the" not in want
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, SCHEMA)
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for r in find_private(df).collect():
        mine = base(TEXTS[r.doc_id])
        terms = [(m.start(), 4, m.end()) for m in word.finditer(TEXTS[r.doc_id])
                 if m.group().lower() in want
                 and not any(a < m.end() and m.start() < b for a, _, b in mine)]
        assert spans_of(r) == sorted(mine + terms)
    got = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert got[0] == "Write to au* Vance at <email> for the file"
    assert got[4] == "the au* files" and got[5] == TEXTS[5] and got[7] == " <email> the "
    assert all(not s for r in find_private(df, support=5).collect() for _, k, s in spans_of(r) if k == 4)


def test_copies_are_not_evidence(spark):
    rows = [(i, "Zebulon wrote from z@z.org") for i in range(50)] + [(99, "other words")]
    got = find_private(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all([k for _, k, _ in spans_of(r)] == [0] for r in got if r.doc_id < 50)


def test_odd_rows(spark):
    rows = [*odd_rows(), (9, "call +1 (456) 555-2186 x@y.zz", "en", "a", 1, 1, 1)]
    df = spark.createDataFrame(rows, ODD_SCHEMA).selectExpr("*", "size AS k1", "node AS spans", "1 AS n")
    got = sanitise(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.text is None, r.text or "") for r in got if r.doc_id != 9) == sorted(
        (r[0] or 0, r[1] is None, r[1] or "") for r in rows[:-1])
    assert [r.text for r in got if r.doc_id == 9] == ["call <phone> <email>"]
    assert sanitise(df.limit(0)).count() == 0


# What the plain forms find, which take quadratic time on some of these.
@pytest.mark.parametrize(("text", "want"), [
    ("a" * 3_000_000, []), ("1" * 3_000_000, []), ("1 " * 1_000_000, []), ("+1" * 500_000, []),
    ("x@" + "y." * 500_000, [(0, 0, 1_000_001)]),
    ("a@b.cc " * 20_000, [(7 * i, 0, 7 * i + 6) for i in range(20_000)]),
])
def test_long_texts(spark, text, want):
    df = spark.createDataFrame([(1, text)], SCHEMA)
    assert spans_of(find_private(df, support=10 ** 6).first()) == want
