"""N-gram Jaccard join by MinHash banding with exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table
from plantloom.llm.components import components
from plantloom.llm.shingles import mixed, shingle_sets

BLOCK = 256  # texts of one side of a task's block of pairs
COLUMNS = 4096  # shingles that are multiplied at a time


def bands_for(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so fewest false candidates, within ``most`` hashes.

    A pair at ``similarity`` meets in a band with probability similarity ** rows.
    """
    best = (1, 1)
    for rows in range(1, most + 1):
        p = similarity ** rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-p)))
        if bands * rows <= most:
            best = (max(1, bands), rows)
    return best


def _sketches(batches, words: int, bands: int, rows: int):
    rng = np.random.default_rng(99)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype="uint64") * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype="uint64")
    for batch in batches:
        n, fp1, fp2, keys = [], [], [], []
        for flat, at in shingle_sets(batch.column(1).to_pylist(), words):
            size = np.diff(at)
            some = np.flatnonzero(size)
            a, b = np.zeros((2, len(size)), "uint64")
            key = np.zeros((len(size), bands), "uint64")
            if len(some):
                begin = at[:-1][some]
                a[some] = np.add.reduceat(flat, begin)
                b[some] = np.bitwise_xor.reduceat(mixed(flat), begin)
                for k in range(bands * rows):
                    low = np.minimum.reduceat(flat * factors[k] + shifts[k], begin)
                    col = key[some, k // rows]
                    key[some, k // rows] = mixed(col + low + np.uint64(k % rows + 1))
            n.append(size)
            fp1.append(a)
            fp2.append(b)
            keys.append(key)
        if not n:
            continue
        flat_keys = np.concatenate(keys).view("int64").ravel()
        edges = pa.array(np.arange(0, len(flat_keys) + 1, bands, dtype="int32"))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array(np.concatenate(n)),
            pa.array(np.concatenate(fp1).view("int64")),
            pa.array(np.concatenate(fp2).view("int64")),
            pa.ListArray.from_arrays(edges, pa.array(flat_keys)),
        ], names=["_id", "text_key", "n", "fp1", "fp2", "bands"])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pairs: np.ndarray):
    """Sizes of the intersections of ``pairs`` (row, column) of the two lists of sets."""
    if len(pairs) <= 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
                         for i, j in pairs], "int64")
    who = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([sets[i] for i in who])
    owner = np.repeat(who, [len(sets[i]) for i in who])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    l_at, r_at = ({int(x): k for k, x in enumerate(side)} for side in (left, right))
    l_row = np.array([l_at.get(int(x), -1) for x in who])[np.searchsorted(who, owner)]
    r_row = np.array([r_at.get(int(x), -1) for x in who])[np.searchsorted(who, owner)]
    sums = np.zeros((len(left), len(right)), "float32")
    top = int(code[-1]) + 1 if len(code) else 0
    for base in range(0, top, COLUMNS):
        a, b = np.searchsorted(code, [base, base + COLUMNS])
        c = code[a:b] - base
        x, y = np.zeros((len(left), COLUMNS), "float32"), np.zeros((len(right), COLUMNS), "float32")
        x[l_row[a:b][l_row[a:b] >= 0], c[l_row[a:b] >= 0]] = 1
        y[r_row[a:b][r_row[a:b] >= 0], c[r_row[a:b] >= 0]] = 1
        sums += x @ y.T
    return np.rint(sums[pairs[:, 0], pairs[:, 1]]).astype("int64")


def _block_links(group: list[tuple], similarity: float):
    """Linked pairs of one block of a bucket: indexes into ``group``, each pair once.

    ``group`` holds (side, bands, band, set) of the bucket's texts. A pair counts in the first band
    in which its two texts meet.
    """
    side = np.array([g[0] for g in group])
    keys, band = np.stack([g[1] for g in group]), group[0][2]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    same = side[0] == 2
    first = np.ones((len(left), len(right)), bool)
    for k in range(band):
        first &= keys[left, k][:, None] != keys[right, k][None, :]
    if same:
        first = np.triu(first, 1)
    sets = [g[3] for g in group]
    n = np.array([len(s) for s in sets])
    small = np.minimum(n[left][:, None], n[right][None, :])
    large = np.maximum(n[left][:, None], n[right][None, :])
    first &= small >= similarity * large - 1e-9
    pairs = np.argwhere(first)
    if not len(pairs):
        return pairs
    common = _overlaps(sets, left, right, pairs)
    a, b = left[pairs[:, 0]], right[pairs[:, 1]]
    linked = common >= similarity * (n[a] + n[b] - common) - 1e-9
    return np.stack([a[linked], b[linked]], 1)


def _spanning(pairs: np.ndarray, n: int):
    """Edges of a spanning forest of the pairs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            yield a, b


def _verify(batches, similarity: float, words: int):
    """Link counts and spanning edges of the blocks; rows of a block come one after the other."""
    out = []

    def close(block):
        if len(block) < 2:
            return
        seen, group, names, sizes = set(), [], [], []
        for c, copies, *rest in block:
            if c not in seen:
                seen.add(c)
                group.append(rest)
                names.append(c)
                sizes.append(copies)
        if len(group) < 2:
            return
        pairs = _block_links(group, similarity)
        if not len(pairs):
            return
        ends, others = pairs.ravel(), pairs[:, ::-1].ravel()
        links = np.bincount(ends, minlength=len(group))
        docs = np.bincount(ends, weights=np.array(sizes)[others], minlength=len(group))
        out.extend((names[i], int(links[i]), int(docs[i]), None) for i in np.flatnonzero(links))
        out.extend((names[a], 0, 0, names[b]) for a, b in _spanning(pairs, len(group)))

    def flush():
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in cols], names=["c", "links", "docs", "other"])

    block, at = [], None
    for batch in batches:
        d = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        keys = list(zip(*[d[k].to_pylist() for k in ("band", "h", "bi", "bj")], strict=True))
        wide = len(d["bands"].values) // max(1, len(d["bands"]))
        bands = d["bands"].flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
        c, copies, side = (d[k].to_pylist() for k in ("c", "copies", "side"))
        texts, i = d["_text"].to_pylist(), 0
        for flat, edge in shingle_sets(texts, words):
            for k in range(len(edge) - 1):
                s = flat[edge[k]: edge[k + 1]]
                if keys[i] != at:
                    close(block)
                    block, at = [], keys[i]
                block.append((c[i], copies[i], side[i], bands[i], keys[i][0], s.copy()))
                i += 1
        if len(out) > 20_000:
            yield flush()
    close(block)
    yield flush()


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
    similarity: float = 0.8, recall: float = 0.9999,
) -> DataFrame:
    """One row per input row: ``id_col, class_id, copy_id, copies, links, text_links`` and keys.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity``. Texts of equal sets are copies: ``copy_id`` is the smallest id among them and
    ``copies`` their number. The others are compared when they agree in a MinHash band; bands and
    rows follow from ``recall`` at ``similarity``, and every candidate is verified on full sets.
    ``text_links`` counts the linked other texts, ``links`` the linked other rows, copies included.
    ``class_id`` is the smallest id that links lead to. ``class_key`` names the class and
    ``text_key`` (xxhash64) the row's text even where ids repeat.

    Pairs are neither emitted nor collected: a bucket is split into blocks of 256 texts, each task
    verifies pairs of blocks and returns counts and a spanning forest. A text shorter than a
    shingle is one shingle; NULL, empty and blank texts have no shingle and are copies of each
    other. Repeated rows count as copies. Ids may be NULL or repeat; NULL is the smallest id only
    of a class that has no other. An empty table gives an empty result; other columns are ignored.
    A text is hashed and verified whole in one task, in arrays of several times its size.
    """
    bands, rows = bands_for(similarity, recall)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(q(id_col).alias("_id"), q(text_col).cast("string").alias("_text"))
    sketch = stored(docs.withColumn("text_key", F.xxhash64("_text")).mapInArrow(
        lambda it: _sketches(it, words, bands, rows),
        f"_id {kind}, text_key long, n long, fp1 long, fp2 long, bands array<bigint>",
    ).withColumn("c", F.xxhash64("n", "fp1", "fp2")), "near-sketch")
    reps = stored(sketch.groupBy("c").agg(
        F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "text_key")).alias("rep"),
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"),
    ).select("c", "rep._id", "rep.text_key", "copies", "n", "bands"), "near-texts")

    each = reps.where("n > 0").select("c", F.posexplode("bands").alias("band", "h"))
    buckets = each.groupBy("band", "h").agg(
        F.count("*").alias("size"), F.bit_xor("c").alias("x"),
        F.sum(F.pmod("c", F.lit(1 << 40))).alias("s"),
    ).where("size > 1").groupBy("size", "x", "s").agg(F.min(F.struct("band", "h")).alias("b"))
    buckets = buckets.select("b.band", "b.h", "size")
    member = each.join(buckets, ["band", "h"]).groupBy("c").agg(
        F.collect_list(F.struct("band", "h", "size")).alias("bucket"))
    wanted = stored(member.join(reps, "c").select(
        "c", "_id", "text_key", "copies", "n", "bands", "bucket"), "near-wanted").select(
        F.col("_id").alias("_rep"), F.col("text_key").alias("_rep_key"), "c", "copies", "bands",
        "bucket", F.xxhash64("_id", "text_key").alias("_row"))
    block = F.pmod(F.xxhash64("c", F.lit(3)), F.col("blocks")).cast("int")
    # One row per class, by id and text: ids repeat, and NULL ids would all meet.
    keyed = docs.withColumn("_key", F.xxhash64("_text")).withColumn(
        "_row", F.xxhash64("_id", "_key"))
    same = F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_key") == F.col("_rep_key"))
    texts = keyed.join(wanted, "_row").where(same).dropDuplicates(["_row", "c"])
    placed = (
        texts
        .select("c", "copies", "bands", "_text", F.explode("bucket").alias("b"))
        .select("c", "copies", "bands", "_text", "b.band", "b.h",
                F.ceil(F.col("b.size") / BLOCK).cast("int").alias("blocks"))
        .withColumn("own", block)
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("c", "copies", "bands", "_text", "band", "h",
                F.least("own", "to").alias("bi"), F.greatest("own", "to").alias("bj"),
                F.when(F.col("own") == F.col("to"), 2).when(F.col("own") < F.col("to"), 0)
                .otherwise(1).alias("side"))
    )
    found = stored(
        placed.repartition("band", "h", "bi", "bj")
        .sortWithinPartitions("band", "h", "bi", "bj", "side", "c")
        .mapInArrow(lambda it: _verify(it, similarity, words),
                    "c long, links long, docs long, other long"), "near-found")
    counts = found.where("other IS NULL").groupBy("c").agg(
        F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(found.where("other IS NOT NULL").select(
        F.col("c").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "c")
    named = reps.select("c", "_id", "copies").join(counts, "c", "left").join(roots, "c", "left")
    root = F.coalesce("root", "c")
    classes = named.groupBy(root.alias("_root")).agg(F.min("_id").alias("class_id"))
    named = named.withColumn("_root", root).join(classes, "_root").select(
        "c", F.col("_root").alias("class_key"), "class_id", F.col("_id").alias("copy_id"), "copies",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("links", F.lit(0)).alias("text_links"))
    return sketch.select("_id", "text_key", "c").join(named, "c").select(
        F.col("_id").alias(id_col), "class_id", "copy_id", "copies", "links", "text_links",
        "class_key", "text_key")


def op3_ngram_jaccard_join(spark, sf: str) -> DataFrame:
    """All documents with their near-duplicate class and number of links (5 words, 0.8)."""
    return near_duplicates(table(spark, sf, "documents")).drop("class_key", "text_key")


def first_of_class(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``df`` with the smallest id of each near-duplicate class, all columns kept.

    Of rows that repeat id and text one stays. Rows and their NULLs count as in
    ``near_duplicates``: all texts without words are one class.
    """
    found = near_duplicates(df, id_col=id_col, text_col=text_col)
    stay = found.groupBy("class_key").agg(F.min(F.struct(
        F.col(f"`{id_col}`").isNull(), q(id_col).alias("id"), "text_key")).alias("s"))
    stay = stay.select(F.col("s.id").alias("_stay_id"), F.col("s.text_key").alias("_stay_text"))
    key = F.xxhash64(q(text_col).cast("string"))
    same = q(id_col).eqNullSafe(F.col("_stay_id")) & (F.col("_key") == F.col("_stay_text"))
    once = Window.partitionBy("_stay_id", "_key").orderBy(F.lit(0))
    return df.withColumn("_key", key).join(stay, same).withColumn(
        "_copy", F.row_number().over(once)).where("_copy = 1").select(*[q(c) for c in df.columns])
