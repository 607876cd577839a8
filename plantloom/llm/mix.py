"""Mixing overlapping sources to target weights by minimum-cost flow."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table, word_count
from plantloom.llm.cuts import weighted_cuts
from plantloom.llm.flow import Network

WEIGHTS = (5, 2, 1)
MOST = 3  # times that a document, and so a source, can be taken
# Exposures of one text up to which a step of the cost curve reaches; each step costs more.
STEPS = (1, 2, 3, 4, 6, 8, 16, 64, 256, 1 << 40)
MERGED = 1024  # groups into which the rarer patterns are merged


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of the total by repeating weights; what is above most * size is shared anew."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        by = sum(weights[i % len(weights)] for i in open_)
        want = {i: left * weights[i % len(weights)] / by for i in open_}
        over = [i for i in open_ if want[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else want[i]
        if not over:
            break
        open_ -= set(over)
        left -= sum(most * sizes[i] for i in over)
    return out


def _route(patterns: dict, cells: dict, goals: dict, most: int) -> dict:
    """Words that each (pattern, source) gives: least total cost of repeated exposure."""
    pat = {p: 2 + i for i, p in enumerate(patterns)}
    src = {s: 2 + len(pat) + i for i, s in enumerate(goals)}
    net = Network(2 + len(pat) + len(src))
    rooms = Counter()
    for (p, _), w in cells.items():
        rooms[p] += most * w
    for p, words in patterns.items():
        before = 0
        for cost, upto in enumerate(STEPS):
            net.arc(0, pat[p], words * (upto - before), cost)
            before = upto
            if words * upto >= rooms[p]:
                break
    arcs = {(p, s): net.arc(pat[p], src[s], most * w) for (p, s), w in cells.items() if w}
    for s, goal in goals.items():
        net.arc(src[s], 1, goal)
    net.solve(0, 1)
    return {k: net.flow(e) for k, e in arcs.items()}


def mix_sources(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, most: int = MOST, seed: int = 7, max_patterns: int = 4096,
) -> DataFrame:
    """All columns of ``df`` plus ``_size, _source_size, _target, _repeats``.

    Sources in code-point order (NULL is a source, the last) get shares by repeating ``weights``
    of all words, at most ``most`` times their own. A text's membership pattern is the set of
    sources that have an equal text. Documents are summed by pattern and source; a minimum-cost
    flow routes words of the patterns to the sources' targets, where the cost per word grows with
    the times that a text of the pattern is shown, so texts in many sources are not repeated while
    others are unused. Every document of a cell (pattern, source) is then taken floor(x) times,
    x being words routed over words present, and those with the smallest hash / fraction once
    more, until the source's words come nearest its target. Equal seeds give equal mixes.

    NULL or blank texts have no words and are taken 0 times; rows equal in id and text are taken
    alike; an empty table gives an empty result. The driver holds one entry per source and the
    ``max_patterns`` patterns of most words; the rarer ones are merged by their hash into at most
    1024 groups, each routed as one pattern with the words that its texts share. A column of
    ``df`` named like a new one is replaced. A text of any length is one value; only its number of
    words is carried.
    """
    new = ["_size", "_source_size", "_target", "_repeats"]
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    text = q(text_col)
    code = F.when(q(source_col).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("="), q(source_col).cast("string")))
    head = [F.xxhash64(text).alias("_h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
            .alias("_crc"), word_count(text).alias("_size"), code.alias("_code")]
    marks = stored(df.select(*head), "mix-marks")
    key = ["_h", "_crc", "_size"]
    groups = marks.groupBy(*key).agg(F.array_sort(F.collect_set("_code")).alias("_pattern"))
    several = groups.where(F.size("_pattern") > 1)
    kept = stored(
        several.groupBy("_pattern").agg(F.sum("_size").alias("words"))
        .orderBy(F.desc("words"), "_pattern").limit(max_patterns), "mix-patterns")
    group = F.pmod(F.xxhash64("_pattern"), F.lit(MERGED)).cast("string")
    shared = stored(
        several.join(F.broadcast(kept.select("_pattern", F.lit(True).alias("_kept"))), "_pattern", "left")
        .withColumn("_pattern", F.when(F.col("_kept"), F.col("_pattern"))
                    .otherwise(F.array(F.lit("~"), group))).drop("_kept"), "mix-shared")
    rows = stored(
        df.select("*", *head).join(shared, key, "left").withColumn(
            "_pattern", F.coalesce("_pattern", F.array("_code"))), "mix-rows")

    # In a fixed order: equal tables give equal flows.
    cells = dict(sorted(((tuple(r._pattern), r._code), r.w) for r in rows.groupBy(
        "_pattern", "_code").agg(F.sum("_size").alias("w")).collect()))
    distinct = rows.select("_pattern", *key).distinct().groupBy("_pattern").agg(
        F.sum("_size").alias("w"))
    patterns = dict(sorted((tuple(r._pattern), r.w) for r in distinct.collect()))
    names = sorted({s for _, s in cells}, key=lambda s: (s == "n", s))
    of_source = Counter()
    for (_, s), w in cells.items():
        of_source[s] += w
    sizes = [of_source[x] for x in names]
    goals = targets(sizes, weights, most)
    routed = _route(patterns, cells, {s: int(g) for s, g in zip(names, goals, strict=True)}, most)
    plan, place = [], {s: i for i, s in enumerate(names)}
    for (p, s), w in cells.items():
        words, i = routed.get((p, s), 0), place[s]
        base = words // w if w else 0
        plan.append((list(p), s, i, int(base), (words - base * w) / w if w else 0.0,
                     sizes[i], float(goals[i])))
    spark = df.sparkSession
    plan_df = F.broadcast(spark.createDataFrame(plan, (
        "_pattern array<string>, _code string, _node int, _base long, _part double,"
        " _source_size long, _target double")))
    need = [0] * len(names)
    for p, s, i, base, part, *_ in plan:
        need[i] += round(part * cells[(tuple(p), s)])
    u = (F.pmod(F.xxhash64(F.lit(seed), q(id_col), "_h"), F.lit(1 << 52)) + 0.5) / (1 << 52)
    ratio = u / F.col("_part")
    rows = rows.join(plan_df, ["_pattern", "_code"]).withColumn(
        "_key", F.when(F.col("_part") > 0, F.floor(ratio / (ratio + 1) * (1 << 58)))
        .cast("long"))
    cuts = weighted_cuts(
        rows.where("_part > 0").select(F.col("_node").alias("node"), F.col("_key").alias("key"),
                                       F.col("_size").alias("weight")), need, 0)
    cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("_node") + 1) if cuts else None
    extra = F.coalesce((F.col("_key") <= cut).cast("long"), F.lit(0)) if cuts else F.lit(0)
    repeats = F.when(F.col("_size") > 0, F.col("_base") + extra).otherwise(0).cast("long")
    return rows.withColumn("_repeats", repeats).select(*[q(c) for c in df.columns], *new)


def op2_mix_sources(spark, sf: str) -> DataFrame:
    """All documents mixed to 5 : 2 : 1 source weights."""
    mixed = mix_sources(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_repeats")).alias("taken"))
