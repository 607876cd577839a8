"""Ranked lexical search: impacts of terms in shards of documents, bounded by range maxima."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table
from plantloom.llm.rmq import Postings

TERMS = 300_000  # terms of the items that are searched together
POSTINGS = 1_000_000  # postings of one shard
CHUNK = 1 << 22  # bytes of a text that are split at a time
# Letters A-Z in lower case; ASCII bytes outside letters and digits become blanks.
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def _terms(text: str | None):
    """Lists of the terms of a text, of at most about ``CHUNK`` bytes each."""
    raw, begin = (text or "").encode().translate(FOLD), 0
    while begin < len(raw):
        end = raw.find(b" ", begin + CHUNK)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


def _item_terms(batches):
    """(item, its distinct terms)."""
    for batch in batches:
        own = [sorted({t for part in _terms(x.as_py()) for t in part}) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["_item", "terms"])


def _held_terms(batches, places):
    """(id, number of terms, places of the asked terms it holds, their occurrences)."""
    get = places.value.get
    for batch in batches:
        sizes, found = [], []
        for x in batch.column(1):
            n, own = 0, Counter()
            for part in _terms(x.as_py()):
                n += len(part)
                own.update(map(get, part))
            own.pop(None, None)
            sizes.append(n)
            found.append(own)
        edge = pa.array(np.cumsum([0, *map(len, found)]).astype("int32"))
        terms = np.fromiter((t for own in found for t in own), "int32")
        times = np.fromiter((c for own in found for c in own.values()), "int32")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(edge, pa.array(terms)),
             pa.ListArray.from_arrays(edge, pa.array(times))],
            names=["_id", "n", "terms", "times"])


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L, in 64-bit integers."""
    wide = 90 * docs * int(n.max(initial=0)) >= 1 << 63
    m = 10 + (90 * (n.astype(object) if wide else n) * docs // max(total, 1)).astype("int64")
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _shard(group: pa.Table, items, weights: np.ndarray, docs: int, total: int, k: int) -> pa.Table:
    """The ``k`` best documents of a shard for each item: (item, id, score)."""
    size = np.diff(group["terms"].combine_chunks().offsets.to_numpy())
    term = group["terms"].combine_chunks().flatten().to_numpy().astype("int64")
    tf = group["times"].combine_chunks().flatten().to_numpy().astype("int64")
    n = group["n"].to_numpy()
    # Neighbours should be alike, so that an interval's maxima are near its documents' impacts.
    first = np.cumsum(size) - size
    main = np.full(int(size.sum()), -1)
    main[first + _argmax(tf, first)] = 0
    main = term[main == 0]
    order_of_id = pc.sort_indices(group["_id"], null_placement="at_end").to_numpy()
    rank = np.empty(len(n), "int64")
    rank[order_of_id] = np.arange(len(n))
    order = np.lexsort((rank, n, main))
    place = np.empty(len(n), "int64")
    place[order] = np.arange(len(n))
    owner = np.repeat(np.arange(len(n)), size)
    index = Postings(term, place[owner], impacts(weights[term], tf, n[owner], docs, total),
                     rank[order], len(weights))
    who, found, scores = [], [], []
    for item, terms in items:
        own, points = index.search(terms, k)
        who.append(np.full(len(own), item))
        found.append(order[own[points > 0]])
        scores.append(points[points > 0])
        who[-1] = who[-1][points > 0]
    at = np.concatenate(found) if found else np.zeros(0, "int64")
    return pa.table({
        "_item": pa.array(np.concatenate(who) if who else at, pa.int64()),
        "_id": group["_id"].take(pa.array(at)),
        "score": pa.array(np.concatenate(scores) if scores else at, pa.int64())})


def _argmax(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of each run's first largest value, within the run."""
    sizes = np.diff(np.append(first, len(values)))
    top = np.repeat(np.maximum.reduceat(values, first), sizes)
    at = np.flatnonzero(values == top)
    run = np.searchsorted(first, at, "right") - 1
    keep = np.diff(run, prepend=-1) > 0
    return at[keep] - first[run[keep]]


def _searcher(sent, docs: int, total: int, k: int):
    return lambda group: _shard(group, *sent.value, docs, total, k)


def lexical_search(
    df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", k: int = 10,
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents of each item, scores above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. With N documents
    that have a term, L terms in them, n in one, df documents that hold a term and tf occurrences:
    a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document's m is 10 + (90nN) div L, and it
    scores the sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 8m)). Equal
    scores rank by id, NULL ids last.

    Documents are dealt to shards of about a million postings of asked terms. A shard keeps its
    posting lists under range-maximum sparse tables; see ``Postings.search``. Items go in blocks of
    at most about 300,000 terms, so that what a task is sent is bounded; the texts are read once a
    block. NULL and empty texts have no terms; repeated documents are all ranked. An item id that
    repeats asks once, with its smallest text; an item without terms, or of terms that no document
    holds, has no rows. Long texts are split in parts. Other columns are not read.
    """
    spark = df.sparkSession
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in (
        (df, id_col), (items, item_col)))
    docs = df.select(q(id_col).alias("_id"), q(text_col).cast("string").alias("_text"))
    asked = stored(items.groupBy(q(item_col).alias("_item")).agg(
        F.min(q(item_text).cast("string")).alias("_text")).mapInArrow(
        _item_terms, f"_item {item_kind}, terms array<binary>"), "lexical-items")
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS
    sizes, out = None, None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).collect()
        places = {t: i for i, t in enumerate(sorted({t for r in own for t in r.terms}))}
        held = spark.sparkContext.broadcast(places)
        rows = stored(docs.mapInArrow(
            lambda it, held=held: _held_terms(it, held),
            f"_id {kind}, n long, terms array<int>, times array<int>"), "lexical-postings")
        if sizes is None:
            sizes = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        total, count = int(sizes[1] or 0), int(sizes[0])
        holders = {r.t: r["count"] for r in rows.select(F.explode("terms").alias("t"))
                   .groupBy("t").count().collect()}
        weights = np.array([
            math.floor(1000 * math.log((2 * count + 2) / (2 * holders.get(i, 0) + 1)))
            for i in range(len(places))] or [0], "int64")
        asked_of = [(i, np.array([places[t] for t in r.terms], "int64")) for i, r in enumerate(own)]
        sent = spark.sparkContext.broadcast((asked_of, weights))
        shards = 1 + sum(holders.values()) // POSTINGS

        best = rows.where(F.size("terms") > 0).withColumn("_shard", F.pmod(
            F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("_shard")
        best = best.applyInArrow(_searcher(sent, count, total, k),
                                 f"_item long, _id {kind}, score long")
        names = spark.createDataFrame(
            [(i, r["_item"]) for i, r in enumerate(own)], f"_item long, _name {item_kind}")
        order = W.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(
            F.broadcast(names), "_item").select(
            F.col("_name").alias(item_col), F.col("rank").cast("int").alias("rank"),
            F.col("_id").alias(id_col), "score")
        out = top if out is None else out.unionByName(top)
    return out


def op12_lexical_search(spark, sf: str) -> DataFrame:
    """The 10 best documents of every benchmark item, over all documents."""
    return lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT count(*) AS N, sum(len(ws))::BIGINT AS L FROM d WHERE len(ws) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
held AS (
  SELECT rid, doc_id, n, t, count(*) AS tf
  FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS t FROM d)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * N + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM held GROUP BY 1), sizes),
scored AS (
  SELECT a.item_id, h.doc_id, h.rid, sum(w.w * ((1000000000 * h.tf)
    // (1000 * h.tf + 8 * (100 - 90 + ((90 * h.n * s.N) // s.L)))))::BIGINT AS score
  FROM asked a JOIN held h ON h.t = a.t JOIN weights w ON w.t = h.t, sizes s
  GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
  doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
