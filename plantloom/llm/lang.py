"""Language identification: a mixture of languages per document, from n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.llm.common import held_out, q, table

GRAMS = 1 << 18  # hashed n-grams of a language model
LAPLACE = 0.05
BATCH_BYTES = 1 << 20  # text that is looked at at a time

# Bytes that are part of no letter become blanks; letters A-Z become a-z.
_LETTERS = np.arange(256, dtype="uint8")
_LETTERS[:128] = 32
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def _parts(texts):
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if part and size + len(raw) > BATCH_BYTES:
            yield first, part
            part, size, first = [], 0, i
        part.append(raw)
        size += len(raw) + 2
    if part:
        yield first, part


def _grams(part):
    """Hashed trigrams of the words of some texts: (gram at each byte, word starts, words per text).

    A word is a run of letters with a blank on either side; a gram stands at its first byte, and
    those of a word are its bytes from the blank before it to its last but one.
    """
    data = _LETTERS[np.frombuffer(b" " + b"  ".join(part) + b"   ", "uint8")]
    gap = data == 32
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    x = data.astype("uint32")
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    gram = (code * np.uint32(2654435761)) >> np.uint32(32 - 18)
    lengths = np.fromiter(map(len, part), "int64", len(part))
    begin = np.concatenate([[0], np.cumsum(lengths + 2)])
    real = ~gap[1:-1]  # a letter in the middle: the gram lies within one word
    return gram, real, starts, np.searchsorted(starts, begin)


def _counts(batches, languages: list[str]):
    at = {x: i for i, x in enumerate(languages)}
    total = np.zeros((len(languages), GRAMS), "int64")
    for batch in batches:
        texts = batch.column(0).to_pylist()
        langs = batch.column(1).to_pylist()
        for first, part in _parts(texts):
            for i in set(langs[first: first + len(part)]):
                own = [t for t, x in zip(part, langs[first: first + len(part)], strict=True)
                       if x == i]
                gram, real, _, _ = _grams(own)
                total[at[i]] += np.bincount(gram[real], minlength=GRAMS)
    lang, gram = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang.astype("int32")), pa.array(gram.astype("int32")),
         pa.array(total[lang, gram])], names=["lang", "gram", "n"])


class LanguageModel:
    """Log-probabilities of hashed trigrams per language; its size is languages × 2^18 numbers."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + LAPLACE) / (counts.sum(1, keepdims=True) + LAPLACE * GRAMS)
        self.logp = np.ascontiguousarray(np.log(p).T.astype("float32"))


def fit_languages(
    df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = 8000,
) -> LanguageModel:
    """Trigram counts of the labelled rows of ``df``.

    All labels are learned. Of a language with more rows than about ``per_language`` (the bound of
    the sample) those with the smallest text hashes count. NULL texts and labels are left out.
    """
    rows = df.select(q(text_col).alias("t"), q(lang_col).cast("string").alias("l")).where(
        "t IS NOT NULL AND l IS NOT NULL")
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, GRAMS)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    rank = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(rank < share[F.col("l")])
    counts = np.zeros((len(languages), GRAMS), "int64")
    found = sample.mapInArrow(
        lambda it: _counts(it, languages), "lang int, gram int, n long"
    ).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts[found["lang"], found["gram"]] = found["n"]
    return LanguageModel(languages, counts)


def _em(like: np.ndarray, owner: np.ndarray, begin: np.ndarray, pi: np.ndarray, rounds: int):
    """Proportions per text by expectation-maximisation over its words, and the log-likelihood."""
    n = np.diff(np.append(begin, len(owner)))[:, None]
    for _ in range(rounds):
        share = like * pi[owner]
        share /= share.sum(1, keepdims=True)
        pi = np.add.reduceat(share, begin, 0) / n
        pi = np.maximum(pi, 1e-9 * (pi > 0))
    return pi, np.add.reduceat(np.log((like * pi[owner]).sum(1)), begin)


def _mixtures(words: np.ndarray, edge: np.ndarray, rounds: int, most: int, penalty: float):
    """(proportions, chosen number of languages) per text with words.

    ``words`` are log-likelihoods per word and language. All languages start equal; the k largest
    proportions are the candidate set of k languages, fitted again; the set with the best
    log-likelihood minus penalty · k · log(words) / 2 is taken.
    """
    begin, n = edge[:-1], np.diff(edge)
    owner = np.repeat(np.arange(len(n)), n)
    top = words.max(1, keepdims=True)
    like = np.exp(np.maximum(words - top, -60)).astype("float64")
    count = like.shape[1]
    pi, _ = _em(like, owner, begin, np.full((len(n), count), 1 / count), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    best = np.full(len(n), -np.inf)
    out = np.zeros_like(pi)
    for k in range(1, min(most, count) + 1):
        start = np.zeros_like(pi)
        np.put_along_axis(start, order[:, :k], np.take_along_axis(pi, order[:, :k], 1) + 1e-6, 1)
        start /= start.sum(1, keepdims=True)
        fitted, value = _em(like, owner, begin, start, 0 if k == 1 else rounds // 2)
        value = value - penalty * k * np.log(n + 1) / 2
        better = value > best
        best[better], out[better] = value[better], fitted[better]
    return out


def _predict(batches, model: LanguageModel, text_at: int, rounds: int, most: int, penalty: float,
             names: list[str]):
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        found = [[] for _ in texts]
        for first, part in _parts(texts):
            if not model.languages:
                break
            gram, real, starts, edge = _grams(part)
            has = np.flatnonzero(np.diff(edge))
            if not len(has):
                continue
            logp = model.logp[gram] * real[:, None]
            words = np.add.reduceat(logp, starts, 0)
            pi = _mixtures(words, np.append(edge[:-1][has], edge[-1]), rounds, most, penalty)
            win = pi.argmax(1)
            for row, i in enumerate(has):
                text = texts[first + i]
                if not any(map(str.isalpha, text)):
                    continue
                lang[first + i] = model.languages[win[row]]
                score[first + i] = min(1.0, pi[row, win[row]])
                found[first + i] = [(model.languages[k], float(pi[row, k]))
                                    for k in np.argsort(-pi[row], kind="stable") if pi[row, k] > 0]
        yield pa.RecordBatch.from_arrays([
            *batch.columns, pa.array(lang), pa.array(score),
            pa.array([[{"lang": a, "share": b} for a, b in x] for x in found],
                     pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
            names=names)


def identify_languages(
    df: DataFrame, model: LanguageModel, *, text_col: str = "text", rounds: int = 8,
    most: int = 3, penalty: float = 4.0,
) -> DataFrame:
    """All columns of ``df`` plus ``lang_pred, lang_score, lang_mix``.

    A word's likelihood under a language is the product of its trigrams' probabilities; a
    document's language proportions are fitted by expectation-maximisation over all its words; the
    set of at most ``most`` languages is chosen by penalised likelihood. ``lang_pred`` has the
    largest proportion, ``lang_score``; ``lang_mix`` lists the set. NULL, empty and letterless texts
    are ``und`` with score 0 and no set, as is every text when nothing was learned. Columns of
    ``df`` with these names are replaced; the others pass unchanged. Rows keep their number, an
    empty table stays empty. Of languages with equal proportions the first by name is taken. A text
    is worked on whole in one task, in one number for each of its bytes and languages.
    """
    new = ["lang_pred", "lang_score", "lang_mix"]
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    shared = df.sparkSession.sparkContext.broadcast(model)
    at, names = df.columns.index(text_col), [*df.columns, *new]
    mix = T.ArrayType(T.StructType().add("lang", "string").add("share", "double"))
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("lang_score", T.DoubleType()),
                           T.StructField("lang_mix", mix)])
    return df.mapInArrow(
        lambda it: _predict(it, shared.value, at, rounds, most, penalty, names), schema)


def op10_language_mixture(spark, sf: str) -> DataFrame:
    """Languages of all documents, learned from the labelled four fifths."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5)
    model = fit_languages(docs.where(~out))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), "lang_mix")
