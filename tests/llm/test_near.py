"""The near-duplicate join against brute force."""

from collections import Counter

from plantloom.llm.near import bands_for, first_of_class, near_duplicates

from .brute import components, jaccard_links, sets_of


def test_bands_reach_recall():
    for s, recall in [(0.8, 0.9999), (0.5, 0.99), (1.0, 0.9)]:
        bands, rows = bands_for(s, recall)
        assert 1 - (1 - s**rows) ** bands >= recall - 1e-12


def check(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    got = near_duplicates(df).collect()
    sets = [sets_of(r[1]) for r in rows]
    links = jaccard_links(sets, 0.8)
    count = Counter(x for pair in links for x in pair)
    comp = components(len(rows), links)
    want = Counter(
        (rows[i][0], min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]), count[i])
        for i in range(len(rows)))
    assert Counter((r.doc_id, r.class_id, r.links) for r in got) == want
    return got


def test_small_cases(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(10, " ".join(base)), (11, " ".join(base[1:])), (12, "  ".join(base)), (3, None), (4, ""),
            (5, " \n "), (6, "one two"), (7, "one two"), (8, "one  two three"), (9, "alpha"),
            (20, " ".join(base[6:])), (21, "word " * 30_000)]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[12].class_id == 10 and got[12].copies == 2 and got[11].text_links == 1
    assert got[5].class_id == 3 and got[20].links == 0


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i % 97] + [f"x{i}"] + words[i % 97 + 1:])) for i in range(700)]
    got = check(spark, rows)
    assert {r.class_id for r in got} == {0} and min(r.links for r in got) == 699


def test_first_of_class_keeps_one(spark):
    t = "one two three four five six seven"
    rows = [(2, t, 1), (2, t, 1), (1, t, 5), (4, "other text here", 0), (None, "other text here", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    assert sorted(map(tuple, first_of_class(df).collect())) == [
        (1, t, 5), (4, "other text here", 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and first_of_class(df).count() == 0


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_ids_that_repeat_over_different_texts(spark):
    def near(p):
        base = [f"{p}{i}" for i in range(60)]
        return [" ".join(base), " ".join(base[1:]), " ".join(base[2:])]

    texts = [t for p in "abcdefgh" for t in near(p)]
    ids = [None if i % 3 == 0 else i % 4 for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (ids[1], texts[1]), (ids[0], texts[0])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [sets_of(t) for _, t in rows]
    links = jaccard_links(sets, 0.8)
    comp, count = components(len(rows), links), Counter(x for pair in links for x in pair)
    first = [min((rows[j][0] for j in range(len(rows))
                  if comp[j] == c and rows[j][0] is not None), default=None) for c in comp]
    assert Counter((r.doc_id, r.class_id, r.links) for r in got) == Counter(
        (rows[i][0], first[i], count[i]) for i in range(len(rows)))
    kept = first_of_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text[0] for r in kept) == list("abcdefgh")
