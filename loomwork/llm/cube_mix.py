"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source whose target is q times its size is taken floor(q) times, and once more with
probability frac(q). Which ones get the extra copy is a balanced sample: the flight phase moves three
fractional probabilities at a time along the null-space of the two constraints (words, documents) until
one becomes 0 or 1, which leaves both totals as they are. Sources are cut into blocks by hash of the id, so
a hot source is many tasks; at most two documents a block stay fractional, and go on to the next
level's blocks until one block is left for each source. Landing: the last one or two are rounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.common import discard, stored, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Documents in a block of the flight phase (on average).
BLOCK = 2_000
#: Rows of a unit that one row of a plan becomes at a time.
CHUNK = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """src, source_size, target, n_docs from (src, size) rows. One row for each source is all that is sorted.

    Targets share the total by weight; none exceeds most times its source's size: with
    sources in order of most * size / weight, those up to some place are full, and the rest shares
    what is left by weight."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = (F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double")).withColumn("most", F.col("source_size") * most)
    by_fill = W.orderBy(F.col("most") / F.col("weight"), F.col("src").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weights"))  # words a unit of weight, if this source and all after it are not full
        .withColumn("full", F.col("most") < F.col("level") * F.col("weight"))
    )
    level = F.coalesce(F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"], F.lit(0.0))
    return per.select("src", "source_size", "n_docs", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def fly(size: list[float], p: list[float], luck: list[float], eps: float = 1e-9) -> list[float]:
    """Flight: at most two of p stay between 0 and 1; sums of p and of p * size stay as they are. luck: a coin in [0, 1) for each."""
    p = list(p)
    pool: list[int] = []
    for i in range(len(p)):
        if eps < p[i] < 1 - eps:
            pool.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(pool) == 3:
            a, b, c = pool
            v = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if v == (0, 0, 0):
                v = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(pool, v) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(pool, v) if x)
            step = up if luck[i] * (up + down) < down else -down
            for k, x in zip(pool, v):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
            gone = [k for k in pool if not eps < p[k] < 1 - eps]
            if not gone:  # rounding: what is nearest to the border is there
                gone = [min(pool, key=lambda k: min(p[k], 1 - p[k]))]
            for k in gone:
                p[k] = float(round(p[k]))
                pool.remove(k)
    return p


def land(size: list[float], p: list[float]) -> list[float]:
    """Rounds the (at most two) fractional ones so that the words stay nearest, then the documents."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    p = list(p)
    want, docs = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    options = [[(k >> j) & 1 for j in range(len(open_))] for k in range(1 << len(open_))]
    best = min(options, key=lambda o: (abs(sum(x * size[i] for x, i in zip(o, open_)) - want), abs(sum(o) - docs), o))
    for i, x in zip(open_, best):
        p[i] = float(x)
    return p


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, body (a hash of the text), source_col, size, source_size, target, copies, taken.

    copies: how often the mix holds the document (0 to most), taken = copies * size. Reruns agree: blocks, their order and
    coins follow from ids, sizes, texts and the seed. Nulls: a null source is a source of its own (last), a null text has
    no words, a null id is like any other. Rows with equal id, source and text are one unit of the flight, however many there are:
    what the unit takes is dealt out evenly over its rows. If there are no words at all, or no
    rows, nothing is taken. Other columns are not read. Texts are read once, for their sizes; only (id, source, size, hash) moves."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body")), "mix-sizes")
    targets = source_targets(rows, weights, most)
    ratio = F.col("target") / F.col("source_size")
    same = rows.groupBy("id", "src", "size", "body").agg(F.count(F.lit(1)).alias("n"))
    units = (
        same.join(targets, same["src"].eqNullSafe(targets["src"]), "left")
        .drop(targets["src"])
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.least(ratio, F.lit(float(most)))).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor(F.col("ratio") + 1e-9).cast("int"))
        .withColumn("more", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)) * F.col("n"))
        .withColumn("sure", F.floor(F.col("more") + 1e-9) + F.col("whole").cast("long") * F.col("n"))
        .withColumn("p", F.greatest(F.col("more") - F.floor(F.col("more") + 1e-9), F.lit(0.0)))
        .withColumn("luck", (F.pmod(F.xxhash64(F.lit(seed), "id", "size", "body"), F.lit(1 << 30)) / float(1 << 30)))
        .withColumn("coin", (F.pmod(F.xxhash64(F.lit(seed + 2), "id", "size", "body"), F.lit(1 << 30)) / float(1 << 30)))
        .withColumn("blocks", F.ceil(F.col("n_docs") / block).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "body"), F.col("blocks")).cast("int"))
        .drop("ratio", "n_docs", "more", "whole")
    )
    schema = f"id {kinds[id_col]}, src string, size bigint, body bigint, n bigint, source_size bigint, target double, sure bigint, p double, luck double, coin double, blocks int, part int"
    units = units.select(*(c.split()[0] for c in schema.split(", ")))

    def flight(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["luck", "id", "size", "body"], kind="mergesort", na_position="first")
            size = pdf["size"].astype(float).tolist()
            p = fly(size, pdf["p"].tolist(), pdf["coin"].tolist())
            return pdf.assign(p=land(size, p) if last else p)

        return run

    done, level = [], stored(units.groupBy("src", "part").applyInPandas(flight(False), schema), "mix-flight")
    discard(rows)
    while True:
        done.append(level.filter("p = 0 or p = 1"))
        rest = level.filter("p > 0 and p < 1")
        blocks = rest.agg(F.max("blocks")).first()[0] or 1
        if blocks <= 1 or rest.count() == 0:
            break
        fewer = F.ceil(F.col("blocks") * 2 / block).cast("int")
        next_ = rest.withColumn("blocks", fewer).withColumn("part", F.pmod(F.col("part"), fewer).cast("int"))
        level = stored(next_.groupBy("src", "part").applyInPandas(flight(False), schema), "mix-flight")
    done.append(rest.groupBy("src").applyInPandas(flight(True), schema))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # the rows of a unit, in chunks: total // n copies each, and one more for the first total % n
    total = out.withColumn("total", F.col("sure") + F.col("p").cast("long"))
    chunk = total.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    row = chunk.withColumn("j", F.explode(F.sequence(F.col("i") * CHUNK, F.least((F.col("i") + 1) * CHUNK, F.col("n")) - 1)))
    copies = (F.floor(F.col("total") / F.col("n")) + (F.col("j") < F.col("total") % F.col("n")).cast("long")).cast("int")
    return row.select(F.col("id").alias(id_col), "body", F.col("src").alias(source_col), "size", "source_size", "target", copies.alias("copies")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
