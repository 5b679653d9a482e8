"""A stored closure that follows edits of its edges: what an edit cannot reach is not derived again.

An added edge brings the pairs of what reaches its start with what its end reaches; several added edges are chained among themselves.
A removed edge first takes away every pair that some path over it gave, its cone, and then gives back those that other paths still
give. Cycles and diamonds are no special cases. All joins start from the edit, so their size is that of its cone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.lineage import written
from quadloom.operators.ontology import transitive


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("sub", "super").filter("sub IS NOT NULL AND super IS NOT NULL").distinct()


def cone(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """(sub, super): pairs with a path over one of the edges: (start or what reaches it) x (end or what it reaches), edge by edge."""
    below = closure.select(F.col("super").alias("x"), F.col("sub").alias("a"))
    above = closure.select(F.col("sub").alias("y"), F.col("super").alias("b"))
    ends = edges.select(F.col("sub").alias("x"), F.col("super").alias("y"))
    left = ends.select("x", "y", F.col("x").alias("a")).union(ends.join(below, "x").select("x", "y", "a"))
    right = left.select("a", F.col("y").alias("b")).union(left.join(above, "y").select("a", "b"))
    return right.distinct().toDF("sub", "super")


def add_edges(closure: DataFrame, added: DataFrame) -> DataFrame:
    """The closure with edges added: new pairs are chains of the added edges' cones."""
    return closure.union(transitive(cone(closure, _clean(added)))).distinct()


def remove_edges(closure: DataFrame, edges: DataFrame, removed: DataFrame, max_rounds: int = 200) -> DataFrame:
    """The closure without edges. `edges` are those before the removal. Each round gives back pairs whose first step is an edge
    that is left and whose rest is known to hold; it ends when a round finds none, after as many as the longest way around."""
    gone = _clean(removed).join(_clean(edges), ["sub", "super"], "left_semi")
    left = written(_clean(edges).join(gone, ["sub", "super"], "left_anti"))
    doubtful = written(cone(closure, gone).join(closure, ["sub", "super"], "left_semi"))
    sure = written(closure.join(doubtful, ["sub", "super"], "left_anti"))
    back = written(doubtful.join(left, ["sub", "super"], "left_semi"))
    frontier, first = back, doubtful.join(left.select("sub", F.col("super").alias("via")), "sub")
    # the first round reaches over pairs that were never in doubt, later ones over what the round before gave back
    new = first.join(sure.select(F.col("sub").alias("via"), "super"), ["via", "super"], "left_semi").select("sub", "super")
    for _ in range(max_rounds):
        more = first.join(frontier.select(F.col("sub").alias("via"), "super"), ["via", "super"], "left_semi").select("sub", "super")
        frontier = written(new.union(more).distinct().join(back, ["sub", "super"], "left_anti"))
        if frontier.isEmpty():
            return sure.union(back)
        back = written(back.union(frontier))
        new = frontier.limit(0)
    raise RuntimeError(f"a way around is longer than {max_rounds} edges")


def edit_closure(closure: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closure, classes): transitive(edges) after the removals and then the additions, and the classes (class) whose supers
    differ, which is what apply_changes of a maintained index wants. Removals that are no edges and additions that are change nothing.
    Null ends are left out; repeated edges count once."""
    before = written(closure.select("sub", "super"))
    after = written(add_edges(remove_edges(before, edges, removed), added))
    lost, won = before.join(after, ["sub", "super"], "left_anti"), after.join(before, ["sub", "super"], "left_anti")
    return after, lost.union(won).select(F.col("sub").alias("class")).distinct()
