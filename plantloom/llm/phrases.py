"""Phrase collocations per language, from n-gram counts in HAT-tries that merge by prefix."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table
from plantloom.llm.hattrie import COUNT, EDGES, HatTrie, first_of_equal
from plantloom.llm.shingles import mixed, word_hashes

LONGEST = 5  # words of a phrase
BITS = 26  # of the hash that a frequent phrase's bit stands at: 8 MB, whatever the corpus
CHUNK = 3 << 19  # bytes of text that are cut into words at a time
WORD_BITS = 9  # of a word's id that part the runs of words
WORDS_HELD = 1_000_000  # distinct words that a task holds before it hands them on
RUN = 512  # ids of a stored run of words, more or less
IDS = 1 << 19  # ids of words that are read at a time
PLACES = 1 << 21  # phrases whose codes are sorted at a time, and distinct ones that are held
PART_WORDS = 1 << 22  # words of the corpus whose runs one task merges
BORDERS = np.zeros(256, bool)
BORDERS[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAPS = BORDERS.copy()
GAPS[[0x20, 0x09]] = True
_JOIN = np.uint64(0x9FB21C651E98DF25)


@functools.lru_cache(maxsize=4096)
def _language(lang: str | None) -> tuple[str, int]:
    """The group of a language and the number that keeps its words apart from other groups'."""
    lang = "und" if lang is None else lang
    return lang, int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _segments(texts, langs):
    """Runs of (lower-cased bytes, language) of about ``CHUNK`` bytes; long texts go in pieces."""
    part, size = [], 0
    for text, lang in zip(texts, langs, strict=True):
        raw, begin = (text.as_py() or "").encode().lower(), 0
        while begin < len(raw) or begin == 0:
            end = len(raw)
            if end - begin > CHUNK:  # phrases end at a border, so a cut there loses none
                data = np.frombuffer(raw, "uint8", offset=begin)
                cut = np.flatnonzero(BORDERS[data[:CHUNK]])
                cut = cut[-1:] if len(cut) else CHUNK + np.flatnonzero(BORDERS[data[CHUNK:]])[:1]
                end = begin + int(cut[0]) + 1 if len(cut) else end
            if part and size + end - begin > CHUNK:
                yield part
                part, size = [], 0
            part.append((raw[begin:end], lang))
            size += end - begin
            begin = end or 1
    if part:
        yield part


def _words(part):
    """Of a run of texts: (bytes, first byte of each word, its id, its piece, its text)."""
    data = np.frombuffer(b"\n" + b"\n".join(raw for raw, _ in part) + b"\n", "uint8")
    starts, hashes = word_hashes(data, GAPS)
    piece = np.cumsum(BORDERS[data], dtype="int32")[starts]
    sizes = np.fromiter((len(raw) + 1 for raw, _ in part), "int64", len(part))
    text = np.repeat(np.arange(len(part)), np.diff(np.searchsorted(starts, 1 + np.cumsum(sizes)), prepend=0))
    lang = np.array([_language(x)[1] for _, x in part], "uint64")
    return data, starts, np.maximum(mixed(hashes ^ lang[text]), 1), piece, text


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Id of the phrase whose words but the last, and but the first, have these ids."""
    return mixed(left * _JOIN + right)


def _taken(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of some words, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _word_runs(batches):
    """Sorted runs of words: (top bits of the ids, ids, occurrences, numbers of their languages,
    the languages, sizes, words), summed in the task as far as it holds."""
    held, numbers = [], {}

    def merged():
        keys, n, lang, sizes = (np.concatenate([x[i] for x in held]) for i in range(4))
        data = np.concatenate([x[4] for x in held])
        order, first = first_of_equal(keys)
        n, one = np.add.reduceat(n[order], first), order[first]
        starts = np.cumsum(sizes) - sizes
        return keys[one], n, lang[one], sizes[one], _taken(data, starts[one], sizes[one])

    def rows():
        keys, n, lang, sizes, data = held[0]
        names = np.array(list(numbers), dtype=object)
        edge = np.flatnonzero(np.diff(keys >> np.uint64(64 - WORD_BITS), prepend=np.uint64(1 << WORD_BITS)))
        at = np.append(0, np.cumsum(sizes))
        for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
            known, own = np.unique(lang[a:b], return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([int(keys[a] >> np.uint64(64 - WORD_BITS))], pa.int64()),
                *(pa.array([x.tobytes()]) for x in (
                    keys[a:b], n[a:b], own.astype("int32"), sizes[a:b], data[at[a]: at[b]])),
                pa.array([names[known].tolist()], pa.list_(pa.string()))],
                names=["part", "keys", "n", "own", "sizes", "words", "langs"])

    fresh = 0
    for batch in batches:
        for part in _segments(batch.column(0), batch.column(1).to_pylist()):
            data, starts, ids, _, text = _words(part)
            if not len(ids):
                continue
            order, first = first_of_equal(ids)
            one = order[first]
            gap = GAPS[data]
            sizes = (np.flatnonzero(~gap[:-1] & gap[1:]) + 1)[one] - starts[one]
            number = np.array([numbers.setdefault(_language(x)[0], len(numbers)) for _, x in part], "int32")
            held.append((ids[one], np.diff(np.append(first, len(ids))), number[text[one]], sizes,
                         _taken(data, starts[one], sizes)))
            fresh += len(one)
            if fresh > WORDS_HELD:
                held = [merged()]
                fresh = 0
                if len(held[0][0]) > WORDS_HELD:
                    yield from rows()
                    held = []
    if held:
        held = [merged()]
        yield from rows()


def _merged_words(part: pa.Table, least: int) -> pa.Table:
    """Of one part of the ids: the words that occur ``least`` times, and the sum of each language,
    with no word."""
    keys, n, own, sizes = (
        np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part[c]])
        for c, kind in (("keys", "uint64"), ("n", "int64"), ("own", "int32"), ("sizes", "int64")))
    langs, of_row = {}, part["langs"].to_pylist()
    many = [len(x.as_buffer()) // 8 for x in part["keys"]]
    begin = np.cumsum([0, *map(len, of_row)])[:-1]
    number = np.array([langs.setdefault(x, len(langs)) for row in of_row for x in row])
    lang = number[own + np.repeat(begin, many)]
    order, first = first_of_equal(keys)
    f = np.add.reduceat(n[order], first)
    kept = np.flatnonzero(f >= least)
    at, end = order[first][kept], np.cumsum(sizes)
    raw, names = b"".join(x.as_buffer() for x in part["words"]), list(langs)
    total = np.zeros(len(names), "int64")
    np.add.at(total, lang, n)
    return pa.table({
        "key": pa.array([*keys[at].view("int64").tolist(), *[None] * len(names)], pa.int64()),
        "lang": pa.array([*(names[i] for i in lang[at]), *names], pa.string()),
        "w": pa.array([*(raw[end[i] - sizes[i]: end[i]].decode() for i in at), *[None] * len(names)],
                      pa.string()),
        "n": pa.array(np.concatenate([f[kept], total]))})


def _spoken(batches, frequent):
    """Words of the texts as runs of ids; a 0 stands where no phrase goes on.

    Words that are not marked frequent, or have no neighbour that is, are in no phrase.
    """
    bits = np.frombuffer(frequent.value[0], "uint8")
    for batch in batches:
        for part in _segments(batch.column(0), batch.column(1).to_pylist()):
            _, _, ids, piece, _ = _words(part)
            ok = _marked(bits, ids)
            pair = ok[:-1] & ok[1:] & (piece[:-1] == piece[1:])
            kept = np.flatnonzero(np.append(pair, False) | np.append(False, pair)) if len(ids) else ids
            if not len(kept):
                continue
            new = np.append(True, ~pair[kept[1:] - 1])
            place = np.arange(len(kept)) + np.cumsum(new)
            out = np.zeros(place[-1] + 1, "uint64")
            out[place] = ids[kept]
            first = place[new] - 1  # a run may begin at any 0
            first = first[np.flatnonzero(np.diff(first // RUN, prepend=-1))]
            edge = pa.py_buffer((np.append(first, len(out)) * 8).astype("int32"))
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(
                pa.binary(), len(first), [None, edge, pa.py_buffer(out)])], names=["ids"])


def _ids(batches):
    """The ids of stored runs, about ``IDS`` at a time."""
    part, size = [], 0
    for batch in batches:
        for run in batch.column(0):
            part.append(run.as_buffer())
            size += part[-1].size
            if size > 8 * IDS:
                yield np.frombuffer(b"".join(part), "uint64")
                part, size = [], 0
    if part:
        yield np.frombuffer(b"".join(part), "uint64")


def _spelled(ids: np.ndarray, frequent: list[np.ndarray]):
    """By number of words from 2 on, places of phrases that may be frequent: (first word, left, right).

    Both the phrase without its last word and that without its first must be marked frequent, as
    must be their own parts; a marked phrase may be rare, a frequent one is always marked.
    """
    here = np.flatnonzero(ids)
    key = ids[here]
    for bits in frequent:
        ok = _marked(bits, key)
        here, key = here[ok], key[ok]
        both = np.flatnonzero(here[1:] == here[:-1] + 1)
        here, left, right = here[both], key[both], key[both + 1]
        yield here, left, right
        if not len(here):
            return
        key = joined(left, right)


def _marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).view("int64")] >> (at & np.uint64(7)).astype("uint8")) & 1 > 0


def _code_runs(batches, frequent, part_bits: int):
    """Sorted runs of codes of phrases one word longer than the last bitmap's: (prefix of the
    code, rests as steps, occurrences).

    A code is the top 32 + ``part_bits`` bits of a phrase's key. Phrases that share one count
    together, so a run has no lower counts than the phrases.
    """
    bits = [np.frombuffer(x, "uint8") for x in frequent.value]
    codes, times, new, size = np.zeros(0, "uint64"), np.zeros(0, "int64"), [], 0

    def merged():
        fresh, n = np.unique(np.concatenate(new), return_counts=True)
        both = np.concatenate([codes, fresh])
        order, first = first_of_equal(both << np.uint64(32 - part_bits))
        return both[order[first]], np.add.reduceat(np.concatenate([times, n])[order], first)

    def rows():
        part = (codes >> np.uint64(32)).view("int64")
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(first, [*first[1:], len(part)], strict=False):
            rest = codes[a:b].astype("uint32")
            step = np.diff(rest, prepend=np.uint32(0)).astype("<u4")
            planes = [step.view("uint8").reshape(-1, 4).T.tobytes(),
                      times[a:b].astype("<u4").view("uint8").reshape(-1, 4).T.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a])], pa.int64()), *(pa.array([x]) for x in planes)],
                names=["part", "steps", "times"])

    for ids in _ids(batches):
        found = list(_spelled(ids, bits))
        if len(found) < len(bits):
            continue
        _, left, right = found[-1]
        new.append(joined(left, right) >> np.uint64(32 - part_bits))
        size += len(left)
        if size > PLACES:
            codes, times = merged()
            new.clear()
            size = 0
            if len(codes) > PLACES:
                yield from rows()
                codes, times = codes[:0], times[:0]
    if new and size:
        codes, times = merged()
    yield from rows()


def _part_bits(total: int) -> int:
    """Bits of the prefix that parts the runs of a corpus of ``total`` words."""
    return min(30, max(6, (total // PART_WORDS).bit_length()))


def _marks(spoken: DataFrame, held, total: int, least: int) -> DataFrame:
    """Keys, right in their top bits, of all phrases of the next length that may be frequent."""
    part_bits = _part_bits(total)

    def merge(part: pa.Table) -> pa.Table:
        def column(name):
            return [np.frombuffer(x.as_buffer(), "uint8").reshape(4, -1).T.copy().view("<u4").ravel()
                    for x in part[name]]

        rest = np.concatenate([np.cumsum(x, dtype="uint32") for x in column("steps")])
        times = np.concatenate(column("times")).astype("int64")
        order, first = first_of_equal(rest.astype("uint64") << np.uint64(32))
        kept = rest[order[first]][np.add.reduceat(times[order], first) >= least].astype("uint64")
        top = np.uint64(part["part"][0].as_py()) << np.uint64(64 - part_bits)
        return pa.table({"key": pa.array((top | kept << np.uint64(32 - part_bits)).view("int64"))})

    runs = spoken.mapInArrow(lambda it: _code_runs(it, held, part_bits),
                           "part long, steps binary, times binary")
    return runs.groupBy("part").applyInArrow(merge, "key long")


def _phrase_counts(batches, marked, part_bits: int):
    """Sorted runs of the marked phrases of 2 and more words: (prefix part, left, right, n)."""
    trie, marks = HatTrie(), [np.frombuffer(x, "uint8") for x in marked.value]

    def rows(run):
        prefix = joined(run[:, 0].view("uint64"), run[:, EDGES - 1].view("uint64"))
        part = (prefix >> np.uint64(64 - part_bits)).view("int64")
        order = np.argsort(part, kind="stable")
        part, run = part[order], run[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(first, [*first[1:], len(part)], strict=False):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a])], pa.int64()),
                 *(pa.array([run[a:b, j].tobytes()]) for j in (EDGES, EDGES + 1, COUNT))],
                names=["part", "left", "right", "n"])

    found, size = [], 0

    def counted():
        first, second, left, right, key = (np.concatenate(x) for x in zip(*found, strict=True))
        trie.add([first, second], left, right, key)
        found.clear()
        for run in trie.spilled():
            yield from rows(run)

    for ids in _ids(batches):
        for (here, left, right), bits in zip(_spelled(ids, marks[:-1]), marks[1:], strict=False):
            key = joined(left, right)
            own = _marked(bits, key)
            here, left, right, key = here[own], left[own], right[own], key[own]
            found.append([x.view("int64") for x in (
                *(ids[here + j] for j in range(EDGES)), left, right, key)])
            size += len(key)
        if size > PLACES // 2:
            yield from counted()
            size = 0
    if size:
        yield from counted()
    for run in trie.spilled(rest=True):
        yield from rows(run)


def _merged(part: pa.Table, least: int) -> pa.Table:
    """The phrases of one prefix part that occur ``least`` times: (key, left, right, f)."""
    left, right, n = (np.concatenate([np.frombuffer(x.as_buffer(), "int64") for x in part[c]])
                      for c in ("left", "right", "n"))
    order = np.lexsort((right, left))
    left, right, n = left[order], right[order], n[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    first = np.flatnonzero(new)
    f = np.add.reduceat(n, first)
    keep = f >= least
    left, right, f = left[first][keep], right[first][keep], f[keep]
    key = joined(left.view("uint64"), right.view("uint64")).view("int64")
    return pa.table([pa.array(x) for x in (key, left, right, f)], names=["key", "left", "right", "f"])


def _bitmap(spark, frequent: DataFrame):
    """One bit for each value of the top bits of the keys; its size is the same for any corpus."""
    place = F.shiftrightunsigned("key", 64 - BITS) + 1
    out = bytearray((1 << BITS) // 8)
    for r in frequent.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        out[(r.b - 1) * 4096: r.b * 4096] = r.bits
    return bytes(out)


def count_phrases(
    df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100,
    longest: int = LONGEST,
) -> tuple[DataFrame, list[DataFrame]]:
    """(``lang, n`` of all words, the phrases of 1, 2, … words that occur ``least`` times or more).

    The phrase tables have ``key, lang, phrase, last, f`` and ``heads, tails``: the counts of their
    proper beginnings and ends by number of words; from two words on ``left, right``, the keys of
    the phrase without its last and first word. A phrase is only counted where both of these are
    frequent, so no frequent one is missed: its parts are at least as frequent. Texts are read
    twice: to count words, then to store the ids of frequent ones that stand together, which all
    further passes read. Which phrases may
    be frequent is found by number of words: each task spills sorted runs of short codes, which are
    merged per prefix of the code, and a bitmap of 8 MB marks the frequent codes; a rare phrase may
    be marked, never a frequent one not. A last pass counts the marked phrases of all lengths in a
    HAT-trie per task that spills its subtrees as sorted runs, merged per prefix of two words.
    Keys are 64-bit hashes of words and language; a phrase is told apart by those of both its
    parts.
    """
    spark = df.sparkSession
    docs = df.select(q(text_col).cast("string").alias("_text"),
                     q(lang_col).cast("string").alias("_lang"))
    words = stored(
        docs.mapInArrow(_word_runs, "part long, keys binary, n binary, own binary, sizes binary,"
                        " words binary, langs array<string>")
        .groupBy("part").applyInArrow(lambda part: _merged_words(part, least),
                                      "key long, lang string, w string, n long"), "phrase-words")
    sizes = stored(words.where("w IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    none = F.array().cast("array<bigint>")
    levels = [stored(words.where("w IS NOT NULL").select(
        "key", "lang", F.col("w").alias("phrase"), F.col("w").alias("last"), F.col("n").alias("f"),
        none.alias("heads"), none.alias("tails")), "phrases")]
    total = sizes.agg(F.sum("n")).first()[0] or 0
    marks = [_bitmap(spark, levels[0])]
    first = spark.sparkContext.broadcast(marks[:1])
    spoken = stored(docs.mapInArrow(lambda it: _spoken(it, first), "ids binary"), "phrase-ids")
    first.unpersist()
    while len(marks) < longest and any(marks[-1]):
        held = spark.sparkContext.broadcast(marks)
        marks.append(_bitmap(spark, stored(_marks(spoken, held, total, least), "phrase-marks")))
        held.unpersist()
    held = spark.sparkContext.broadcast(marks)
    part_bits = _part_bits(total)
    runs = spoken.mapInArrow(lambda it: _phrase_counts(it, held, part_bits),
                           "part long, left binary, right binary, n binary")
    counted = stored(runs.groupBy("part").applyInArrow(
        lambda part: _merged(part, least), "key long, left long, right long, f long"),
        "phrase-counts")
    for _ in marks[1:]:
        a = levels[-1].select(F.col("key").alias("left"), "lang", F.col("phrase").alias("begin"),
                              "heads", F.col("f").alias("f_left"))
        b = levels[-1].select(F.col("key").alias("right"), "last", "tails",
                              F.col("f").alias("f_right"))
        levels.append(stored(counted.join(a, "left").join(b, "right").select(
            "key", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f_left")).alias("heads"),
            F.concat("tails", F.array("f_right")).alias("tails"), "left", "right"), "phrases"))
    return sizes, levels


def collocations(
    df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100,
    longest: int = LONGEST, top: int = 2000,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; texts are cut at ``. , ; : ! ?`` and line ends into pieces, and these at
    blanks and tabs into words. Candidates are phrases of 2 to ``longest`` words that occur
    ``a >= least`` times inside pieces. A cut into two parts of l and r occurrences scores
    floor(1000 a n / (l r)), n being all words of the language; the lowest cut counts, of equal
    ones the earliest. A candidate that stands inside a longer one of as many occurrences is
    dropped; if any longer one does so, one of a single word more does. Equal scores rank by ``a``
    and then by the bytes of the phrase. Products are decimals of 38 digits, so exact.

    A NULL language is ``und``, with the texts that say so; NULL and empty texts have no words;
    rows may repeat, and each counts. An empty table gives no rows. A text of any length goes
    through in parts cut at piece borders. Other columns are not read.
    """
    sizes, levels = count_phrases(
        df, text_col=text_col, lang_col=lang_col, least=least, longest=longest)
    found = []
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=False):
        if longer is not None:
            inside = longer.select(F.explode(F.array("left", "right")).alias("key"), "f").groupBy(
                "key").agg(F.max("f").alias("most"))
            level = level.join(inside, "key", "left").where("most IS NULL OR most < f")
        found.append(level.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
    if not found:  # phrases of one word were asked for
        found = [levels[0].limit(0).select("lang", "phrase", F.col("f").alias("a"), "heads", "tails")]
    all_ = functools.reduce(DataFrame.union, found).join(sizes, "lang")
    big = [F.col(c).cast("decimal(20,0)") for c in ("a", "n")]
    parts = F.arrays_zip(F.col("heads").alias("l"), F.reverse("tails").alias("r"))
    cuts = F.transform(parts, lambda x, k: F.struct(k.alias("k"), x.l.alias("l"), x.r.alias("r")))
    cut = all_.select("lang", "phrase", "a", "n", F.explode(cuts).alias("c"), *[
        x.alias(f"_{i}") for i, x in enumerate(big)]).select(
        "lang", "phrase", "a", "n", "c.*", F.expr(
            "CAST(CAST(_0 * _1 * 1000 AS DECIMAL(38,0)) DIV"
            " CAST(CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0)) AS DECIMAL(38,0))"
            " AS BIGINT)").alias("score"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "phrase", "a", "n", "b.*")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf: str) -> DataFrame:
    """The 2000 strongest collocations of each language of all documents."""
    return collocations(table(spark, sf, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM spoken GROUP BY 1),
places AS (
  SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
  FROM spoken, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
counted AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k >= 2),
kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, s.n, c.j,
    ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN sizes s ON s.lang = c.lang
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.j], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY
  row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
