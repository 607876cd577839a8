"""Information-theoretic sanitisation: personal data and the terms that give it away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
# Fixed forms of personal data. No character that may follow a possessive run is in the run, and
# a match can begin inside a run of the first class only where the match before it ended, so these
# find what the plain forms find, in linear time and without recursion.
FORMS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NEEDS = ("@", ".", None, "+")  # a text without it has no match
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NEAR = 8  # words of context on either side of a match
REACH = 160  # code points in which these words are looked for
LONG = 64  # code points; longer terms go by their digest


def _digits(hit):
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits):
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))

    def value(d, i):
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(each, value), F.lit(0), lambda s, v: s + v) % 10 == 0


def _holds(kind, hit):
    """Whether a match of a form is of its kind."""
    n = F.length(_digits(hit))
    small = F.forall(F.split(hit, r"\."), lambda p: (
        F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (
        F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    return (F.when(kind == 0, True).when(kind == 1, small)
            .when(kind == 2, F.when((n >= 14) & (n <= 19), _luhn(_digits(hit))).otherwise(False))
            .otherwise((n >= 10) & (n <= 15)))


def _cut(text, form: str, kind: int):
    """The gaps before, between and after the matches: (kind, gap's size, hit, its ends)."""
    both = F.arrays_zip(F.split(text, form, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("hit"))
    return F.transform(both, lambda x: F.struct(
        F.lit(kind).alias("kind"), F.length(x.gap).alias("gap"),
        F.octet_length(x.gap).alias("gap_bytes"), x.hit.alias("hit"),
        F.substring(x.gap, -REACH, REACH).alias("tail"), F.substring(x.gap, 1, REACH).alias("head")))


def _placed(cut: DataFrame) -> DataFrame:
    """Start and end of each hit of ``key.., kind, pos, gap, gap_bytes, hit``, and the next head."""
    order = W.partitionBy("k1", "k2", "kind").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    size, wide = F.length("hit"), F.octet_length("hit")
    return cut.select(
        "*", F.sum(F.col("gap") + F.coalesce(size, F.lit(0))).over(upto).alias("end"),
        F.sum(F.col("gap_bytes") + F.coalesce(wide, F.lit(0))).over(upto).alias("end_byte"),
        *([F.lead("head").over(order).alias("after")] if "head" in cut.columns else []),
    ).where("hit IS NOT NULL").withColumn("start", F.col("end") - size).withColumn(
        "start_byte", F.col("end_byte") - wide)


def _term(word):
    return F.when(F.length(word) > LONG, F.sha2(word.cast("binary"), 256)).otherwise(F.lower(word))


def _class(term):
    """The general form of a term: digits as #, a word by its first two characters."""
    masked = F.regexp_replace(term, "[0-9]", "#")
    return F.when(term != masked, masked).otherwise(F.concat(F.substring(term, 1, 2), F.lit("*")))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    return df.select(q(id_col).alias("_id"), text.alias("_text"), q(text_col).isNull().alias("_null"),
                     F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def disclosing_terms(matches: DataFrame, words: DataFrame, *, bits: float, support: int) -> DataFrame:
    """``term, replacement, entity, pmi, ic``: the terms that give an entity away.

    ``matches`` are (entity, tail, after, n) of the found personal data, ``n`` texts each;
    ``words`` (term, n) counts the terms of the corpus. With c an entity and t a term among the
    ``NEAR`` words on either side of it, t reveals PMI(c; t) = log2 p(c|t)/p(c) of the IC(c) =
    -log2 p(c) bits of c; what it leaves is log2 f(t)/f(c,t). A term that leaves at most ``bits``
    and stands near c in at least ``support`` different contexts exceeds the threshold. It is
    replaced by its class if the class leaves more than that of each such entity, else by nothing.
    """
    def near(side, tail: bool):
        each = F.regexp_extract_all(side, F.lit(TERM), F.lit(0))
        whole = F.length(side) < REACH  # else the outermost word may be a part
        rest = F.when(whole | (F.size(each) == 0), each)
        if tail:
            kept = F.coalesce(rest, F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))))
            return F.slice(kept, F.greatest(F.size(kept) - NEAR, F.lit(0)) + 1, F.lit(NEAR))
        kept = F.coalesce(rest, F.slice(each, 1, F.greatest(F.size(each) - 1, F.lit(0))))
        return F.slice(kept, 1, NEAR)

    sides = matches.select(
        "entity", "n", near(F.coalesce("tail", F.lit("")), True).alias("a"),
        near(F.coalesce("after", F.lit("")), False).alias("b"))
    seen = sides.select("entity", "n", F.xxhash64("a", "b").alias("context"), F.explode(
        F.concat("a", "b")).alias("w"))
    pairs = stored(
        seen.groupBy("entity", _term(F.col("w")).alias("term"), "context").agg(F.sum("n").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts")),
        "private-pairs")
    left = F.lit(2.0 ** bits)
    total = F.lit(words.agg(F.sum("n")).first()[0] or 0)
    entities = matches.groupBy("entity").agg(F.sum("n").alias("f_entity"))
    near_ones = stored(
        pairs.where(F.col("contexts") >= support).join(words, "term")
        .where(F.col("both") * left >= F.col("n")), "private-near")
    classes = near_ones.select(_class(F.col("term")).alias("class"), "entity").distinct()
    f_class = words.groupBy(_class(F.col("term")).alias("class")).agg(F.sum("n").alias("f_class"))
    by_class = pairs.groupBy("entity", _class(F.col("term")).alias("class")).agg(
        F.sum("both").alias("both_class"))
    general = classes.join(f_class, "class").join(by_class, ["entity", "class"]).select(
        "entity", "class", (F.col("both_class") * left < F.col("f_class")).alias("hides"))
    found = near_ones.withColumn("class", _class(F.col("term"))).join(
        general, ["entity", "class"]).join(entities, "entity")
    ic = F.log2(total / F.col("f_entity"))
    pmi = ic - F.greatest(F.log2(F.col("n") / F.col("both")), F.lit(0.0))
    best = F.max(F.struct(pmi.alias("pmi"), ic.alias("ic"), F.col("entity")))
    return found.groupBy("term", "class").agg(F.min("hides").alias("hides"), best.alias("b")).select(
        "term", F.when(F.col("hides"), F.col("class")).otherwise("").alias("replacement"),
        "b.entity", "b.pmi", "b.ic")


def find_private(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: float = 1.0,
    support: int = 3,
) -> DataFrame:
    """One row per input row: ``id_col, spans`` and the key ``k1, k2`` of the text.

    ``spans`` has (start, kind, end, start_byte, end_byte, from_byte, replacement), by start, then
    in the order of ``KINDS``; places are code points, ends exclusive. E-mail addresses, IP
    addresses, payment cards and phone numbers are the leftmost matches of their forms that hold
    (parts up to 255; 14 to 19 digits that pass Luhn; 10 to 15 digits). Each distinct value is a
    protected entity; co-occurrence over the whole corpus tells which terms give one away, see
    ``disclosing_terms``. Those are spans of kind ``term`` wherever they stand outside personal
    data.

    NULL and empty texts have no spans. Equal texts are worked on once and all get the result;
    rows and ids may repeat or be NULL. Terms that tie at the threshold exceed it. An empty table
    gives no rows. Long texts are matched in linear time; the spans of one text are held together.
    Other columns are not read. DataFrame functions only.
    """
    docs = _keyed(df, id_col, text_col)
    text = F.col("_text")
    cuts = [F.when(F.contains(text, F.lit(need)) if need else F.lit(True), _cut(text, form, kind))
            .otherwise(F.array()) for kind, (form, need) in enumerate(zip(FORMS, NEEDS, strict=True))]
    rows = stored(docs.select("_id", "k1", "k2", F.flatten(F.filter(
        F.array(*cuts), lambda z: F.size(z) > 1)).alias("cut")), "private-rows")
    each = rows.where(F.size("cut") > 0).groupBy("k1", "k2").agg(
        F.first("cut").alias("cut"), F.count("*").alias("n"))
    base = stored(_placed(each.select(
        "k1", "k2", "n", F.posexplode("cut").alias("pos", "c")).select(
        "k1", "k2", "n", "pos", "c.*")).where(_holds(F.col("kind"), F.col("hit"))), "private-base")

    words = stored(
        docs.select(F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("w"))
        .groupBy(_term(F.col("w")).alias("term")).agg(F.count("*").alias("n")), "private-words")
    plain = F.when(F.col("kind") < 2, F.lower("hit")).otherwise(_digits(F.col("hit")))
    terms = stored(disclosing_terms(
        base.select(F.concat(F.col("kind"), F.lit(":"), plain).alias("entity"), "tail", "after", "n"),
        words, bits=bits, support=support), "private-terms")

    spans = base.select(
        "k1", "k2", "kind", "start", "end", "start_byte", "end_byte", F.concat(
            F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.lit(">"))
        .alias("replacement"))
    if not terms.isEmpty():
        spans = spans.union(_term_spans(docs, terms, spans))
    order = W.partitionBy("k1", "k2").orderBy("start", "kind", "end")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    listed = spans.withColumn(
        "from_byte", F.coalesce(F.max("end_byte").over(before), F.lit(0))).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct(
            "start", "kind", "end", "start_byte", "end_byte", "from_byte", "replacement"))).alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return rows.select("_id", "k1", "k2").join(
        stored(listed, "private-spans"), ["k1", "k2"], "left").select(
        F.col("_id").alias(id_col), F.coalesce("spans", none).alias("spans"), "k1", "k2")


def _term_spans(docs: DataFrame, terms: DataFrame, base: DataFrame) -> DataFrame:
    """Places of the disclosing terms outside the spans of personal data."""
    word = F.explode(F.regexp_extract_all(F.col("_text"), F.lit(TERM), F.lit(0)))
    with_terms = stored(docs.select("k1", "k2", word.alias("w")).select(
        "k1", "k2", _term(F.col("w")).alias("term")).join(terms, "term", "left_semi").select(
        "k1", "k2").distinct(), "private-texts")
    texts = docs.join(with_terms, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(
        F.first("_text").alias("_text"))
    both = F.arrays_zip(F.split(F.col("_text"), TERM, -1).alias("gap"), F.regexp_extract_all(
        F.col("_text"), F.lit(TERM), F.lit(0)).alias("hit"))
    cut = texts.select("k1", "k2", F.posexplode(both).alias("pos", "c")).select(
        "k1", "k2", F.lit(len(KINDS) - 1).alias("kind"), "pos", F.length("c.gap").alias("gap"),
        F.octet_length("c.gap").alias("gap_bytes"), F.col("c.hit").alias("hit"))
    at = _placed(cut).withColumn("term", _term(F.col("hit"))).join(
        terms.select("term", "replacement"), "term").select(*base.columns)
    # A term overlaps personal data that begins before the term's end and ends after its start.
    both = at.select("*", F.lit(False).alias("_base")).union(
        base.select("*", F.lit(True).alias("_base")))
    upto = W.partitionBy("k1", "k2").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_at", F.when(F.col("_base"), F.col("start")).otherwise(F.col("end") - 1))
    reach = F.max(F.when(F.col("_base"), F.col("end"))).over(upto)
    return both.withColumn("_reach", reach).where(
        "NOT _base AND (_reach IS NULL OR _reach <= start)").select(*base.columns)


def sanitise(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: float = 1.0,
    support: int = 3,
) -> DataFrame:
    """One row per input row: ``id_col, text`` with the spans of ``find_private`` replaced, ``spans``.

    Personal data become their kind in angle brackets, terms their general form or nothing. A NULL
    text stays NULL.
    """
    found = find_private(df, id_col=id_col, text_col=text_col, bits=bits, support=support)
    per_text = found.where(F.size("spans") > 0).groupBy("k1", "k2").agg(
        F.first("spans").alias("spans"))
    raw = F.col("_text").cast("binary")

    def between(a, b):
        return F.substring(raw, a + 1, F.greatest(b - a, F.lit(0)).cast("int")).cast("string")

    pieces = F.transform("spans", lambda s: F.concat(
        between(s.from_byte.cast("int"), s.start_byte.cast("int")), s.replacement))
    last = F.array_max(F.transform("spans", lambda s: s.end_byte)).cast("int")
    new = F.concat(F.array_join(pieces, ""), between(last, F.octet_length("_text")))
    return _keyed(df, id_col, text_col).join(per_text, ["k1", "k2"], "left").select(
        F.col("_id").alias(id_col),
        F.when(~F.col("_null"), F.coalesce(new, "_text")).alias("text"),
        F.coalesce("spans", F.array().cast(per_text.schema["spans"].dataType)).alias("spans"))


def op11_sanitise(spark, sf: str) -> DataFrame:
    """Personal data of all documents and the terms that give it away."""
    found = find_private(table(spark, sf, "documents"))
    names = F.array(*map(F.lit, KINDS))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")

    def of_kind(k):
        return lambda s: s.kind == k

    base = F.filter("spans", lambda s: s.kind < len(KINDS) - 1)
    return found.select(
        "doc_id", *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{n}")
                    for k, n in enumerate(KINDS[:-1])],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))
