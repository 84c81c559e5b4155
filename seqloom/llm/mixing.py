"""Mixing sources to target weights, by hierarchical budgeting.

A tree has the levels of `path`, e.g. domain, source, language; one level carries the target weights. The budget of
the root is passed down: nodes above the weighted level get the sum of the weights below them, nodes under it share
by the tokens they hold. A node can give at most its tokens times its repeats; what a child can't give is passed to
its siblings first and only then, through the parent, to the parent's siblings. Each leaf then takes whole seeded
epochs, in each of which every document comes once in its own random order, and of the last epoch the prefix that
fits the rest of its budget. What is left of that, as the next document is too large, goes to the documents of the same
node of the weighted level that have not been taken in this epoch and fit, again and again until none fits.

A prefix is found without sorting a leaf: documents fall into 4,096 ranges of their hash, whose tokens are summed,
and only in the one range where the budget ends documents are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import small, trimmed

RANGE_BITS = 12
#: Turns in which what is left of budgets is given out; each leaves less than the size of a document that was next.
MOST_TURNS = 10
#: Part of a budget that may be left without another turn.
CLOSE = 0.0005
#: Leaves of the budget tree that the driver plans for: nodes of the weighted level times, say, languages.
MOST_LEAVES = 100_000


@dataclass
class Node:
    weight: float = 0.0
    capacity: float = 0.0
    held: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def _sum_up(node: Node) -> None:
    for child in node.children.values():
        _sum_up(child)
    if node.children:
        node.capacity = sum(c.capacity for c in node.children.values())
        node.held = sum(c.held for c in node.children.values())
        node.weight = node.weight or sum(c.weight for c in node.children.values())


def _pass_down(node: Node, budget: float) -> None:
    """Fill the children in proportion to weight; what full ones leave over goes to their siblings, again and again."""
    node.budget = min(budget, node.capacity)
    left, open_ = node.budget, [c for c in node.children.values() if c.capacity > 0]
    given = dict.fromkeys(map(id, open_), 0.0)
    while open_ and left > 1e-9 * max(1.0, node.budget):
        by_weight = sum(c.weight for c in open_)
        # Siblings without any weight take part only when those with weight are full.
        share = (lambda c: c.weight / by_weight) if by_weight > 0 else (lambda c: c.capacity / sum(x.capacity for x in open_))  # noqa: B023
        takes = [min(left * share(c), c.capacity - given[id(c)]) for c in open_]
        for child, take in zip(open_, takes):
            given[id(child)] += take
        left -= sum(takes)
        rest = [c for c in open_ if c.capacity - given[id(c)] > 1e-9 * c.capacity]
        if len(rest) == len(open_):
            break
        open_ = rest
    for child in node.children.values():
        _pass_down(child, given.get(id(child), 0.0))


def plan(leaves: Sequence[tuple[tuple[str, ...], float, int]], weights: dict[str, float], level: int, total: float) -> dict[tuple[str, ...], float]:
    """The budget in tokens of each leaf. leaves: (path, tokens, repeats); weights: by the name at `level` of the path."""
    root = Node()
    for path, tokens, repeats in leaves:
        node = root
        for depth, name in enumerate(path):
            node = node.children.setdefault(name, Node())
            if depth == level:
                node.weight = weights.get(name, 0.0)
        node.capacity, node.held = float(tokens) * max(repeats, 0), float(tokens)
        if level < len(path) - 1:
            node.weight = float(tokens)

    def below(node: Node, depth: int) -> None:
        for child in node.children.values():
            below(child, depth + 1)
        if depth > level + 1 and node.children:  # between the weighted level and the leaves: by tokens
            node.weight = sum(c.weight for c in node.children.values())

    below(root, 0)
    _sum_up(root)
    _pass_down(root, total)
    out: dict[tuple[str, ...], float] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        if not node.children:
            out[path] = node.budget
        for name, child in node.children.items():
            walk(child, (*path, name))

    walk(root, ())
    return out


def language(column) -> F.Column:
    """A language code of two or three letters in lower case, `und` for anything else."""
    code = F.regexp_extract(F.lower(trimmed(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.length(code) > 0, code).otherwise("und")


def _take(docs: DataFrame, by: Sequence[str], rests: dict[tuple[str, ...], float], half: bool) -> DataFrame:
    """docs with `more` set to 1 for the prefix, in the order of (h, doc_id), of those that fit the rest of their key.

    docs: the columns of `by`, doc_id, tokens, h, range, open (can be taken) and more. A document that is larger than
    the rest is passed over; with `half`, one that is larger than twice the rest, and the last one is taken if at least
    half of it lies within the rest.
    """
    part = 0.5 if half else 1.0
    spark = docs.sparkSession
    rows = [(*key, rest) for key, rest in rests.items() if rest > 0]
    goal = F.broadcast(spark.createDataFrame(rows, ", ".join([*(f"`{b}` string" for b in by), "rest double"])))  # at most MOST_LEAVES rows
    docs = docs.join(goal, list(by), "left")
    can = F.col("open") & (F.col("more") == 0) & (F.col("tokens") * part <= F.col("rest"))
    docs = docs.withColumn("can", F.coalesce(can, F.lit(False)))
    upto = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = docs.filter("can").groupBy(*by, "range").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    # The range in which the rest ends, one row for each key at most.
    ends = ranges.filter("ahead + t > rest").groupBy(*by).agg(F.min(F.struct("range", "ahead")).alias("end"))
    docs = docs.join(small(ends.select(*by, F.col("end.range").alias("end"), "end.ahead")), list(by), "left")
    at_end = F.col("can") & F.coalesce(F.col("range") == F.col("end"), F.lit(False))
    before = Window.partitionBy(*by).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = docs.filter(at_end).withColumn("now", (F.col("ahead") + F.coalesce(F.sum("tokens").over(before), F.lit(0)) + F.col("tokens") * part) <= F.col("rest"))
    other = docs.filter(~at_end).withColumn("now", F.col("can") & F.coalesce(F.col("range") < F.col("end"), F.lit(True)))
    whole = last.unionByName(other).withColumn("more", F.when(F.col("now"), 1).otherwise(F.col("more")))
    return whole.drop("rest", "can", "end", "ahead", "now")


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: Sequence[str] = ("domain", "source", "lang"), seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The uses (doc_id, source, tokens, uses) of the documents that are used, and the report, a row for each target.

    documents: doc_id, tokens and the columns of `path` but `domain`, which is one for all unless it is a column.
    targets: source (unique), weight (parts), max_repeats. total: tokens of the mixture; by default those of all
    documents of the sources in targets, once.

    The report has target_share, budget and tokens, share (reached), short (whether the source can't give its part of
    the total), available, the number of documents and uses, and the tokens of the smallest document that could still be
    used once more (smallest_open, null for none). A source without documents or with all texts empty is
    reported with 0 tokens. Null, NaN or negative weights count as 0, null max_repeats as 1. Documents of other
    sources, or with null source or without tokens, are not used. Equal hashes are ordered by doc_id. Texts are taken
    whole: a source that isn't short misses its budget by less than its smallest document that is still open, or by CLOSE of it.
    More than MOST_LEAVES leaves are an error.
    """
    w = F.col("weight").cast("double")
    goals = small(
        targets.filter("source is not null").select(
            "source", F.when(w.isNotNull() & ~F.isnan(w) & (w > 0), w).otherwise(0.0).alias("weight"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeats"), F.lit(1))).cast("int").alias("max_repeats")
        )
    )
    names = list(path)
    docs = documents if "domain" in documents.columns or "domain" not in names else documents.withColumn("domain", F.lit("all"))
    docs = docs.filter("tokens > 0").join(goals.select("source", "max_repeats"), "source")
    docs = docs.select("doc_id", "tokens", "max_repeats", *(F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in names))
    held = docs.groupBy(*names).agg(F.sum("tokens").alias("held"), F.first("max_repeats").alias("max_repeats"), F.count("*").alias("n"))
    leaves = held.limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    weights = {r.source: r.weight for r in goals.select("source", "weight").collect()}
    everything = sum(weights.values())
    total = float(sum(r.held for r in leaves)) if total is None else float(total)
    budgets = plan([(tuple(r[p] for p in names), r.held, r.max_repeats) for r in leaves], weights, names.index("source"), total)

    rows, rests = [], {}
    for r in leaves:
        leaf = tuple(r[p] for p in names)
        full = min(r.max_repeats, int(budgets[leaf] // r.held))
        rests[leaf] = budgets[leaf] - full * r.held if full < r.max_repeats else 0.0
        rows.append((*leaf, full))
    spark = documents.sparkSession
    schema = ", ".join([*(f"`{p}` string" for p in names), "epochs int"])
    chosen = F.broadcast(spark.createDataFrame(rows, schema))  # at most MOST_LEAVES rows

    # The order of a document in the last, partial epoch of its leaf.
    ordered = docs.join(chosen, names).withColumn("h", F.xxhash64(F.lit(seed), "epochs", F.col("doc_id")))
    ordered = ordered.withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS)).withColumn("h", F.shiftleft("h", RANGE_BITS))
    ordered = ordered.withColumn("open", F.col("epochs") < F.col("max_repeats")).withColumn("more", F.lit(0))
    # First each leaf; then what all leaves below a node of the weighted level have left is given out among them; last,
    # where no document fits any more, one goes beyond the rest if that is nearer to it.
    top = names[: names.index("source") + 1]
    goal: dict[tuple[str, ...], float] = {}
    for leaf, rest in rests.items():
        goal[leaf[: len(top)]] = goal.get(leaf[: len(top)], 0.0) + rest
    by, half = names, False
    for turn in range(MOST_TURNS):
        half = half or turn == MOST_TURNS - 1
        ordered = checkpoint(_take(ordered, by, rests, half))
        taken = {tuple(r[p] for p in top): r.t for r in ordered.groupBy(*top).agg(F.sum(F.col("tokens") * F.col("more")).alias("t")).collect()}
        now = {node: rest - taken.get(node, 0) for node, rest in goal.items()}
        if half or not any(rest > CLOSE * goal[node] for node, rest in now.items()):
            break
        half = by is top and now == rests
        by, rests = top, now
    uses = ordered.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).alias("uses"))
    uses = checkpoint(uses.filter("uses > 0"))

    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"))
    have = held.groupBy("source").agg(F.sum("held").alias("available"))
    every = sum(r.t or 0 for r in got.agg(F.sum("tokens").alias("t")).collect())
    part = F.col("weight") / F.lit(everything or 1.0)
    planned: dict[str, float] = {}
    for path_, budget in budgets.items() if leaves else ():
        name = path_[names.index("source")]
        planned[name] = planned.get(name, 0.0) + budget
    have = have.join(F.broadcast(spark.createDataFrame(list(planned.items()), "source string, budget double")), "source", "left")
    smallest = ordered.filter("open and more = 0").groupBy("source").agg(F.min("tokens").alias("smallest_open"))
    have = have.join(smallest, "source", "left")
    report = (
        goals.join(have, "source", "left")
        .join(got, "source", "left")
        .select(
            "source",
            "weight",
            part.alias("target_share"),
            "max_repeats",
            F.coalesce("available", F.lit(0)).cast("bigint").alias("available"),
            F.coalesce("budget", F.lit(0.0)).alias("budget"),
            F.col("smallest_open").cast("bigint").alias("smallest_open"),
            F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
            F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"),
            F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
            (F.coalesce("tokens", F.lit(0)) / F.lit(float(every or 1))).alias("share"),
            (part * F.lit(total) > F.coalesce("available", F.lit(0)) * F.col("max_repeats")).alias("short"),
        )
    )
    return uses, report
