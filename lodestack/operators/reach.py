"""Reachability along a spanning forest, then over the edges that the forest lacks.

Every node keeps one of its edges. While there are more than ``FEW`` of these, a quarter of the nodes is left out: those that
a coin shows and whose next one it does not, so that no two in a row go and every edge to one of them is led on to its next.
All such rounds together move some multiples of the edges, as each has three quarters of the one before. Over the last ones
the ends of all chains are found in rounds that double their length, log2(n) for a line of n nodes; the nodes left out are
added where an edge of a reached node leads to them, last ones first. Edges that were not kept lead from what
is reached to new starts, until there are none: as many passes as a way needs such edges, few in a history of commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.shared import cut

#: Kept edges up to which chains are followed by doubling, which moves all of them in each round.
FEW = 200_000


def _proper(edges: DataFrame) -> DataFrame:
    """Edges between two nodes, both ends of one type: the coins of a node are those of its value."""
    kind = edges.select("source").union(edges.select("target")).schema[0].dataType
    return edges.select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target")).filter("source is not null and target is not null and source <> target")


def _coin(node: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(2)) == 1


class Jumps:
    """The k-th table jumps 2 ** k edges: (source, target), of the kept edges after the last round that left nodes out. A
    table is made when it is first asked for, and written."""

    def __init__(self, edges: DataFrame) -> None:
        self.kept = cut(_proper(edges).groupBy("source").agg(F.min("target").alias("target")), "jump")
        self.out: list[tuple[DataFrame, DataFrame]] = []  # by round: edges of nodes left out, and edges of others to them
        self.rounds = 0
        last, n = self.kept, self.kept.count()
        while n > FEW:
            last = self._fewer(last)
            n, loops = last.agg(F.count(F.lit(1)), F.count_if(F.col("source") == F.col("target"))).first()
            if loops:
                raise ValueError("the edges have a cycle: commits are none")
        self.tables = [last]
        self.most = n.bit_length() + 1  # no chain is longer than there are edges

    def _fewer(self, last: DataFrame) -> DataFrame:
        """Edges of three quarters of the nodes, led past the others."""
        level = len(self.out)
        here, there = _coin(F.col("source"), level), _coin(F.col("target"), level)
        gone = last.filter(here & ~there)
        at = gone.select(F.col("source").alias("target"), F.col("target").alias("onward"))
        led = cut(last.filter(there).join(at, "target", "left").select("source", "target", "onward"), "led")
        self.out.append((gone, led.filter("onward is not null").select("source", "target")))
        on = led.select("source", F.coalesce("onward", "target").alias("target"))
        return cut(last.filter(~here & ~there).unionByName(on), "jump")

    def table(self, k: int) -> DataFrame | None:
        """None where no chain has so many edges. Kept edges of a cycle would jump for ever."""
        while len(self.tables) <= k:
            if self.tables[-1].isEmpty():
                return None
            if len(self.tables) > self.most:
                raise ValueError("the edges have a cycle: commits are none")
            last = self.tables[-1]
            self.rounds += 1
            self.tables.append(cut(last.alias("a").join(last.alias("b"), F.col("a.target") == F.col("b.source")).select("a.source", "b.target"), "jump"))
        return None if self.tables[k].isEmpty() else self.tables[k]

    def along(self, starts: DataFrame) -> DataFrame:
        """ids of starts(id) and of all that their chains of kept edges lead to."""
        starts = starts.select("id").distinct()
        if not self.out:
            return self._doubled(starts)
        begun = []
        for gone, _ in self.out:  # a start that is left out goes on from its next node
            begun.append(starts)
            on = starts.join(gone, F.col("id") == F.col("source"), "left")
            starts = cut(on.select(F.coalesce("target", "id").alias("id")).distinct(), "starts")
        reached = self._doubled(starts)
        for (_, led), own in zip(reversed(self.out), reversed(begun), strict=True):
            to = led.join(reached, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id")).unionByName(own)
            reached = cut(reached.unionByName(to.distinct().join(reached, "id", "left_anti")), "reached")
        return reached

    def _doubled(self, reached: DataFrame) -> DataFrame:
        k = 0
        while (jump := self.table(k)) is not None:
            reached = cut(reached.unionByName(reached.join(jump, F.col("id") == F.col("source")).select(F.col("target").alias("id"))).distinct(), "reached")
            k += 1
        return reached


def reachable(edges: DataFrame, starts: DataFrame, jumps: Jumps | None = None) -> DataFrame:
    """ids that edges(source, target) lead to from starts(id), these included. Null ends and loops lead nowhere."""
    jumps = jumps or Jumps(edges)
    others = cut(_proper(edges).join(jumps.kept, ["source", "target"], "left_anti").distinct(), "edges")
    reached = cut(jumps.along(starts.filter("id is not null")), "reached")
    fresh = reached
    while True:
        doors = cut(others.join(fresh, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id")).distinct().join(reached, "id", "left_anti"), "doors")
        if doors.isEmpty():
            return reached
        fresh = cut(jumps.along(doors).join(reached, "id", "left_anti"), "fresh")
        reached = cut(reached.unionByName(fresh), "reached")
