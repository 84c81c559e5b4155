"""Samples, folds, grouped splits and mutants, all by hashes of seeds and ids: the same on any cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *ids: Column) -> Column:
    """A text whose order is a random one of the ids."""
    return F.md5(F.concat_ws("\t", F.lit(str(seed)), *ids))


def sample(df: DataFrame, ids: Sequence[str], k: int, seed: int, length: Column | None = None, least: int = 0, most: int = 0) -> DataFrame:
    """k rows without replacement, of those with least <= length <= most (0: no limit)."""
    x = df
    if length is not None and least:
        x = x.filter(length >= least)
    if length is not None and most:
        x = x.filter(length <= most)
    return x.orderBy(hash_order(seed, *(F.col(i).cast("string") for i in ids)), *ids).limit(k)


def samples(df: DataFrame, key: str, sizes: Sequence[int], replicates: int) -> DataFrame:
    """(size, replicate, key, n): for each size and replicate that many keys, seeded by size * 1000 + replicate."""
    draws = F.explode(F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(n.alias("size"), r.alias("replicate"))))))
    x = df.select(key, draws.alias("d")).select(key, "d.size", "d.replicate")
    order = F.md5(F.concat_ws("\t", (F.col("size") * 1000 + F.col("replicate")).cast("string"), F.col(key).cast("string")))
    w = Window.partitionBy("size", "replicate").orderBy(order, key)
    return x.withColumn("n", F.row_number().over(w)).filter("n <= size").select("size", "replicate", key, "n")


def ordinals(df: DataFrame, order: Sequence[str], out: str = "n") -> DataFrame:
    """Row numbers from 0 in a total order: rows are range partitioned, counted by partition, and numbered within."""
    from ..session import checkpoint

    parts = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").count().orderBy("__p").collect()  # a row a partition
    ahead, starts = 0, {}
    for r in counts:
        starts[r["__p"]] = ahead
        ahead += r["count"]
    start = F.create_map(*(F.lit(v) for kv in starts.items() for v in kv)) if starts else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("__p").orderBy(*order)
    return parts.withColumn(out, (F.try_element_at(start, F.col("__p")) + F.row_number().over(w) - 1).cast("bigint")).drop("__p")


def assigned_ids(df: DataFrame, order: Sequence[str], prefix: str, first: int = 1, least_width: int = 4, out: str = "new_id") -> DataFrame:
    """Sequential ids `PREFIX_0001` in the given order, as wide as the largest number needs."""
    width = max(least_width, len(str(first + max(df.count() - 1, 0))))
    return ordinals(df, order, "__n").withColumn(out, F.concat(F.lit(f"{prefix}_"), F.lpad((F.col("__n") + first).cast("string"), width, "0"))).drop("__n")


def parts_of(df: DataFrame, order: Sequence[str], size: int, out: str = "part") -> DataFrame:
    """Numbers of parts of `size` rows each, in the given order."""
    return ordinals(df, order, "__n").withColumn(out, F.floor(F.col("__n") / size).cast("bigint")).drop("__n")


def grouped_split(df: DataFrame, group: str, train: float, validation: float, seed: int) -> DataFrame:
    """df with a split: distinct groups in hash order, cut after int(n * train) and int(n * validation) more. Null groups are one group."""
    groups = df.select(F.col(group).alias("__g")).distinct()
    n = groups.count()
    a, b = int(n * train), int(n * validation)
    numbered = ordinals(groups.withColumn("__h", hash_order(seed, F.coalesce("__g", F.lit("")))), ["__h", "__g"], "__n")
    split = F.when(F.col("__n") < a, "train").when(F.col("__n") < a + b, "val").otherwise("test")
    return df.join(numbered.select("__g", split.alias("split")), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def chosen_examples(df: DataFrame, key: str, score: str, flags: Sequence[str], n: int) -> DataFrame:
    """(key, reason, score): the best row, the best with each flag, then the best of the rest, n in all and each key once.

    Only the n best rows of each kind are looked at further.
    """
    best = df.groupBy(key).agg(F.max(score).alias("score"), *(F.max(F.when(F.col(f), F.col(score))).alias(f"f_{f}") for f in flags))
    order = [F.desc("score"), F.asc(key)]
    picks = [best.orderBy(*order).limit(1).select(key, "score", F.lit(0).alias("p"), F.lit("best").alias("reason"))]
    for i, f in enumerate(flags, 1):
        picks.append(best.filter(f"f_{f} is not null").orderBy(F.desc(f"f_{f}"), key).limit(1).select(key, "score", F.lit(i).alias("p"), F.lit(f).alias("reason")))
    picks.append(best.orderBy(*order).limit(n + len(picks)).select(key, "score", F.lit(len(flags) + 1).alias("p"), F.lit("fill").alias("reason")))
    every = picks[0]
    for p in picks[1:]:
        every = every.unionByName(p)
    once = every.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("p"))).filter("k = 1")
    return once.orderBy("p", *order).limit(n).select(key, "reason", "score")


# Residue groups by chemistry, the letters that are drawn from, and the modes.
GROUPS = ("AVLIM", "FYW", "ST", "NQ", "DE", "KRH", "GP", "C")
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
MODES = ("random", "conservative", "nonconservative", "alanine", "glycine", "shuffle")


def mutate(seq: str, positions: np.ndarray, rate: float, mode: str, seed: int, protected: str = "") -> tuple[str, list[int]]:
    """(mutant, changed positions from 0): max(1, round(n * rate)) of the positions, not the protected letters, are replaced or shuffled."""
    rng = np.random.default_rng(seed)
    may = np.array([p for p in positions if 0 <= p < len(seq) and seq[p] not in protected], np.int64)
    if not len(may):
        return seq, []
    many = min(len(may), max(1, int(np.rint(len(may) * rate))))
    chosen = np.sort(rng.choice(may, many, replace=False))
    out = list(seq)
    if mode == "shuffle":
        for p, q in zip(chosen, rng.permutation(chosen)):
            out[p] = seq[q]
    else:
        group = {a: letters for letters in GROUPS for a in letters}
        for p in chosen:
            own = group.get(seq[p])
            same = own or ""
            pool = {"random": LETTERS, "conservative": same, "nonconservative": [x for x in LETTERS if x not in same], "alanine": "A", "glycine": "G"}[mode]
            # where the residue itself is the only choice, any other one
            others = [x for x in pool if x != seq[p]] or [x for x in LETTERS if x != seq[p]]
            out[p] = others[int(rng.integers(len(others)))]
    return "".join(out), chosen.tolist()


def mutants(df: DataFrame, key: str, seq: str, modes: Sequence[str], rates: Sequence[float], replicates: int, seed: int, protected: str = "") -> DataFrame:
    """(mutant_id, key, mode, rate, replicate, mutant, changed): all of modes x rates x replicates for each sequence, seeded by a hash of all of them."""
    for m in modes:
        if m not in MODES:
            raise ValueError(m)
    kind = df.schema[key].dataType.simpleString()
    plan = [(m, float(r), i) for m in modes for r in rates for i in range(1, replicates + 1)]
    settings = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(r).alias("rate"), F.lit(i).alias("replicate")) for m, r, i in plan))
    x = df.filter(F.length(seq) > 0).select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.explode(settings).alias("s"))
    x = x.select("key", "seq", "s.mode", "s.rate", "s.replicate", F.xxhash64(F.lit(seed), F.col("key").cast("string"), "s.mode", "s.rate", "s.replicate").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [mutate(s, np.arange(len(s)), r, m, int(h) & (2**63 - 1), protected) for s, m, r, h in zip(b["seq"], b["mode"], b["rate"], b["h"])]
            ids = [f"{k}|{m}|{r:g}|{i}" for k, m, r, i in zip(b["key"], b["mode"], b["rate"], b["replicate"])]
            yield pd.DataFrame({"mutant_id": ids, "key": b["key"], "mode": b["mode"], "rate": b["rate"], "replicate": b["replicate"], "mutant": [g[0] for g in got], "changed": [len(g[1]) for g in got]})

    return x.mapInPandas(run, f"mutant_id string, key {kind}, mode string, rate double, replicate int, mutant string, changed int").withColumnRenamed("key", key)


def bootstrap(df: DataFrame, key: str, fraction: float, iterations: int, seed: int) -> DataFrame:
    """(iteration, key): max(2, round(fraction x rows)) rows for each iteration, by the order of a hash of seed + iteration.

    Iterations lie one after the other in a range-partitioned order, so that none is sorted in one task. key: unique.
    """
    rows = df.count()
    most = min(rows, max(2, round(fraction * rows)))
    x = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    x = x.withColumn("__h", hash_order_of(F.col("iteration") + seed, F.col(key).cast("string")))
    return ordinals(x, ["iteration", "__h", key], "__n").filter(F.col("__n") - F.col("iteration") * F.lit(rows) < most).select("iteration", key)


def hash_order_of(seed: Column, *ids: Column) -> Column:
    """As hash_order, with a seed that is a column."""
    return F.md5(F.concat_ws("\t", seed.cast("string"), *ids))


def peek(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(key): n keys at random, in order."""
    return sample(df.select(key), [key], n, seed).orderBy(key)
