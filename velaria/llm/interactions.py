"""What each filter of a chain removes, in every order of the chain, from decision diagrams of failure masks.

1. One pass gives each row its failure flags; the flag for repeated texts comes from the least id of each text.
2. Spark counts rows by part and failure mask, so a part is at most 2^k weights for k filters.
3. Per part the weights become the leaves of a decision diagram with one filter a level, in which equal
   subdiagrams are one node and every node knows the weight below it.  Orders follow one another by swaps of two
   adjacent levels (each order once, by plain changes).  On the path on which every filter passes, the branch that
   fails at a level is what the filter of that level removes, and the branch that passes is what is kept.

A null part is the empty string, a null text is empty.  A row with a null id repeats nothing and has no labels;
rows that repeat the least id of a text all pass, as no id is smaller.  Several label rows of an id count as one
that says 1 where any does; null labels say nothing.  An empty table gives no rows.  Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from velaria.llm import common

Weights = tuple[int, ...]

# ----------------------------------------------------------------------- the diagram


class Diagram:
    """Weights of masks as an ordered decision diagram; level 0 is the first filter applied.

    A node is (pass child, fail child) at its level; the children of the last level are weights.  Nodes of a level
    with equal children are one node.  No level is left out, so a node's weight is the sum of its children's.
    """

    def __init__(self, size: int, weights: dict[int, Weights], columns: int):
        self.order = list(range(size))
        self.columns = columns
        self.leaves: dict[Weights, int] = {}
        self.leaf_weights: list[Weights] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(size)]
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        nothing = (0,) * columns
        below = [self._leaf(weights.get(mask, nothing)) for mask in range(1 << size)]
        # The filter of level 0 is the lowest bit of a mask: pair masks that differ in the highest bit first.
        for level in reversed(range(size)):
            half = len(below) // 2
            below = [self._node(level, below[i], below[i + half]) for i in range(half)]
        self.root = below[0]
        self._totals: list[dict[int, Weights]] = [{} for _ in range(size)]

    def _leaf(self, weights: Weights) -> int:
        if weights not in self.leaves:
            self.leaves[weights] = len(self.leaf_weights)
            self.leaf_weights.append(weights)
        return self.leaves[weights]

    def _node(self, level: int, passes: int, fails: int) -> int:
        unique = self.levels[level]
        pair = (passes, fails)
        if pair not in unique:
            unique[pair] = len(self.nodes[level])
            self.nodes[level].append(pair)
        return unique[pair]

    def total(self, level: int, node: int) -> Weights:
        """The weight of all masks below a node."""
        if level == len(self.order):
            return self.leaf_weights[node]
        known = self._totals[level]
        if node not in known:
            passes, fails = self.nodes[level][node]
            known[node] = tuple(a + b for a, b in zip(self.total(level + 1, passes), self.total(level + 1, fails)))
        return known[node]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next: (f00, f01), (f10, f11) become (f00, f10), (f01, f11)."""
        upper, lower = self.nodes[level], self.nodes[level + 1]
        self.levels[level], self.nodes[level] = {}, []
        self.levels[level + 1], self.nodes[level + 1] = {}, []
        self._totals[level], self._totals[level + 1] = {}, {}
        for passes, fails in upper:
            (f00, f01), (f10, f11) = lower[passes], lower[fails]
            # Subdiagrams that differed still differ, so nodes keep their numbers and levels above stay as they are.
            self._node(level, self._node(level + 1, f00, f10), self._node(level + 1, f01, f11))
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[Weights, Weights]]:
        """(kept, removed) of each level along the path on which every filter passes."""
        out, node = [], self.root
        for level in range(len(self.order)):
            passes, fails = self.nodes[level][node]
            out.append((self.total(level + 1, passes), self.total(level + 1, fails)))
            node = passes
        return out


def plain_changes(size: int) -> Iterator[int]:
    """Levels to swap with the next one, one after another, so that each order of `size` filters comes once."""
    if size < 2:
        return
    inner = plain_changes(size - 1)
    down = True
    while True:
        walk = range(size - 1)
        yield from reversed(walk) if down else walk
        down = not down
        step = next(inner, None)
        if step is None:
            return
        # The largest element stands at the left end after a walk down: what it stands beside moved by one.
        yield step + (0 if down else 1)


def audit_part(names: str, weights: dict[int, Weights], columns: int) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, lost..., shapley) for each order and step.

    The first weight is the count of rows, the others count rows of some kind, which are lost when removed.
    """
    size = len(names)
    diagram = Diagram(size, weights, columns)
    paths = {tuple(diagram.order): diagram.steps()}
    for level in plain_changes(size):
        diagram.swap(level)
        paths[tuple(diagram.order)] = diagram.steps()
    failing, alone, shapley = [0] * size, [0] * size, [0] * size
    for order, path in paths.items():
        failing[order[0]] = path[0][1][0]
        alone[order[-1]] = path[-1][1][0]
        for i, (_, removed) in zip(order, path):
            shapley[i] += removed[0]
    return [
        ("".join(names[i] for i in order), step, kept[0], removed[0], failing[i] - removed[0], alone[i], *removed[1:], shapley[i])
        for order, path in sorted(paths.items())
        for step, (i, (kept, removed)) in enumerate(zip(order, path), 1)
    ]


# --------------------------------------------------------------------- over all parts


def audit(df: DataFrame, filters: dict[str, Column], part: Column, kinds: dict[str, Column], n: Column | None = None) -> DataFrame:
    """One row per part, order and step.

    `filters` are failure flags by a one-letter name (their number's factorial is the number of orders), `kinds`
    flags of rows whose loss is told in a column of that name, `n` how many rows of the table a row stands for.
    """
    names, kinds = "".join(filters), dict(kinds)
    if len(names) != len(filters) or not names:
        raise ValueError("filters need one letter each")
    n = F.lit(1) if n is None else n
    mask = F.lit(0)
    for i, flag in enumerate(filters.values()):
        mask = mask + F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
    weights = [n.cast("long"), *[F.when(flag, n).otherwise(F.lit(0)).cast("long") for flag in kinds.values()]]
    rows = df.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), *[w.alias(f"w{i}") for i, w in enumerate(weights)])
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(weights))]
    # At most two to the number of filters in a list.
    by_part = rows.groupBy("part", "mask").agg(*sums).groupBy("part").agg(
        F.collect_list(F.struct("mask", F.array(*[f"w{i}" for i in range(len(weights))]).alias("w"))).alias("masks")
    )
    numbers = ["kept", "removed", "redundant", "unique_fails", *kinds, "shapley"]
    columns = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audit_part(names, {m["mask"]: tuple(m["w"]) for m in masks}, columns)
                order, step, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), pa.array(order), pa.array(step, pa.int32()), *[pa.array(c, pa.int64()) for c in rest]],
                    names=["part", "filter_order", "step", *numbers],
                )

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in numbers))


# ------------------------------------------------------------- the filters of the query


def text_flags(text: Column) -> dict[str, Column]:
    """Failure flags of a text alone: A few words, B repeated words, C capitals, D signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """Rows with flags A to E, the part, label flags, and how many equal rows each stands for."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flags = text_flags(F.col("body"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("body"), F.col(f"`{part}`").cast("string").alias("part"))
    rows = rows.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), *[f.alias(c) for c, f in flags.items()])
    rows = common.written(rows, "flags")
    # Rows that repeat an id are one from here on; the least id of each text is a row per text.
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    rows = rows.join(first, ["id", "digest"], "left").join(said, "id", "left")
    return rows.withColumn("E", F.col("first").isNull() & F.col("id").isNotNull())


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents, in all orders, by source."""
    rows = marked(docs, labels)
    kinds = {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
    return audit(rows, {c: F.col(c) for c in "ABCDE"}, F.col("part"), kinds, F.col("n"))
