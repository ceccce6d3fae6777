"""Exact k-nearest-neighbour vote over feature vectors.

Training rows form a tree of clusters that splits until a leaf holds a bounded number of rows, so that its size
follows the data; each node has a centre, a radius and a count. A row first searches the leaf around it, which bounds
the distance of its k-th neighbour, then goes down all branches that can hold something closer, by the triangle
inequality. Each leaf meets the rows that reach it in blocks of bounded size, one Arrow batch of matrix arithmetic
each. Nothing is dropped: branches ruled out cannot hold a neighbour, and a block gives a row its k nearest, by
distance and id, however many lie as far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.operators.features import row_hash
from busweave.session import checkpointed

BLOCK_ROWS = 32768
#: Training rows of a leaf at most, but for rows that are all alike, for each four dimensions. Bounds rule out less with
#: each dimension, and a row is sent to every leaf that is left, so leaves of long vectors are larger, up to a block.
LEAF_ROWS = 2048
#: Distances worked out at a time.
CELLS = 1 << 20


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _stats(rows: DataFrame) -> DataFrame:
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("to_centre").alias("radius"))
    return checkpointed(nodes, "knn-nodes")


def _centres(rows: DataFrame, pivots: int, level: int) -> DataFrame:
    """``node, centres``: of each node some rows by hash and one of those farthest from its centre, distinct vectors."""
    mixed = Window.partitionBy("node").orderBy(F.xxhash64("train_id", F.lit(level)), "train_id")
    place = rows.withColumn("__place", F.row_number().over(mixed)).where(F.col("__place") < pivots).where("__place < __most")
    far = rows.where("to_centre = radius").withColumn("__place", F.row_number().over(mixed)).where("__place = 1")
    picked = place.select("node", "__v").unionByName(far.select("node", "__v"))
    centres = picked.groupBy("node").agg(F.array_sort(F.array_distinct(F.collect_list("__v"))).alias("centres"))
    return checkpointed(centres, "knn-centres")


def cluster_tree(base: DataFrame, pivots: int = 16, leaf_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaf of every row of ``base (train_id, __v, …)``, the nodes below each split node, and the root.

    A node with more than ``leaf_rows`` rows is split among up to ``pivots`` of its own rows, twice as many as leaves
    are needed at most, each row going to the nearest; one of them is as far from the node's centre as any, so that only rows that are all alike stay together.
    Rounds grow with the logarithm of the rows. Returns ``rows (…, node)``, ``tree (parent, children)`` and
    ``root (centre, radius, n, leaf)`` with one row.
    """
    first = base.orderBy(row_hash("train_id"), "train_id").limit(1).select(F.col("__v").alias("__c"))
    middle = first.first()
    if middle is None:
        raise ValueError("no training rows")
    leaf_rows = leaf_rows or min(BLOCK_ROWS, LEAF_ROWS * max(1, len(middle[0] or []) // 4))
    start = base.withColumn("node", F.lit("0")).join(first.withColumn("node", F.lit("0")), "node")
    open_rows = checkpointed(start.withColumn("to_centre", _distance(F.col("__v"), F.col("__c"))).drop("__c"), "knn-rows")
    splits = (F.col("n") > leaf_rows) & (F.col("radius") > 0)
    stats, level, leaves, trees = _stats(open_rows), 0, [], []
    root = stats.join(first.withColumn("node", F.lit("0")), "node").select(
        "node", F.col("__c").alias("centre"), "radius", "n", (~splits).alias("leaf")
    )
    while True:
        split = stats.where(splits).select("node", "radius", F.greatest(F.lit(2), F.ceil(2 * F.col("n") / leaf_rows)).alias("__most"))
        leaves.append(open_rows.join(split, "node", "left_anti").drop("to_centre"))
        if split.isEmpty():
            break
        inside = open_rows.join(split, "node")
        centres = _centres(inside, pivots, level)
        nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(_distance(c, F.col("__v")).alias("d"), i.alias("i"))))
        below = inside.drop("to_centre", "radius", "__most").join(centres, "node").withColumn("__h", nearest).drop("centres")
        below = below.withColumns({"node": F.concat_ws(".", "node", "__h.i"), "to_centre": F.col("__h.d")}).drop("__h")
        open_rows = checkpointed(below, "knn-rows")
        stats = _stats(open_rows)
        listed = centres.select(F.col("node").alias("parent"), F.posexplode("centres").alias("i", "centre"))
        listed = listed.withColumn("node", F.concat_ws(".", "parent", "i")).join(stats, "node")
        child = F.struct("node", "centre", "radius", "n", (~splits).alias("leaf"))
        trees.append(listed.groupBy("parent").agg(F.collect_list(child).alias("children")))
        level += 1
    rows, tree = leaves[0], trees[0] if trees else None
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    for more in trees[1:]:
        tree = tree.unionByName(more)
    kind = "array<struct<node:string,centre:array<double>,radius:double,n:bigint,leaf:boolean>>"
    if tree is None:
        tree = base.sparkSession.createDataFrame([], f"parent string, children {kind}")
    return rows, checkpointed(tree, "knn-tree"), checkpointed(root, "knn-root")


def _home(asked: DataFrame, tree: DataFrame, root: DataFrame, need: int) -> DataFrame:
    """Leaf around each row: down to the nearest child as long as it holds ``need`` rows; null where that ends above a leaf.

    ``bound`` is the least distance within which some node on the way is known to hold ``need`` rows.
    """
    far = lambda d, node: F.when(F.col(f"{node}.n") >= need, d + F.col(f"{node}.radius")).otherwise(F.lit(float("inf")))
    to_root = _distance(F.col("__v"), F.col("root.centre"))
    top = root.select(F.struct("node", "centre", "radius", "n", "leaf").alias("root"), F.lit(0).alias("__one"))
    front = asked.withColumn("__one", F.lit(0)).join(top, "__one").drop("__one")
    front = front.withColumn("bound", far(to_root, "root")).select(*asked.columns, "bound", F.struct("root.node", "root.leaf").alias("at"))
    done = []
    while True:
        front = checkpointed(front, "knn-home")
        done.append(front.where("at IS NULL OR at.leaf").select(*asked.columns, "bound", F.col("at.node").alias("home")))
        front = front.where("NOT at.leaf")
        if front.isEmpty():
            break
        ways = front.join(tree, F.col("at.node") == F.col("parent"))
        reach = lambda c: F.struct(_distance(c["centre"], F.col("__v")).alias("d"), c["node"].alias("node"), c["radius"].alias("radius"), c["n"].alias("n"), c["leaf"].alias("leaf"))
        ways = ways.withColumn("__next", F.array_min(F.transform(F.filter("children", lambda c: c["n"] >= need), reach)))
        tighter = F.least("bound", F.coalesce(F.col("__next.d") + F.col("__next.radius"), F.lit(float("inf"))))
        at = F.when(F.col("__next").isNotNull(), F.struct("__next.node", "__next.leaf"))
        front = ways.select(*asked.columns, tighter.alias("bound"), at.alias("at"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return checkpointed(out, "knn-bound")


def _reachable(asked: DataFrame, tree: DataFrame, root: DataFrame) -> DataFrame:
    """``(test_id, home, node)`` for every leaf that can hold a row within the row's ``bound``.

    All levels are one pass: leaves wait while the rest goes down, and no vector is written or sent on the way.
    """
    top = root.select("node", "leaf")
    front = asked.withColumn("__one", F.lit(0)).join(top.withColumn("__one", F.lit(0)), "__one").drop("__one")
    within = lambda c: _distance(c["centre"], F.col("__v")) - c["radius"] <= F.col("bound") * 1.000000001 + 1e-9
    for _ in range(_depth(tree, root)):
        below = F.transform(F.filter("children", within), lambda c: F.struct(c["node"].alias("node"), c["leaf"].alias("leaf")))
        ways = front.join(tree, F.col("node") == F.col("parent"), "left")
        ways = ways.withColumn("__c", F.explode(F.when(F.col("leaf"), F.array(F.struct("node", "leaf"))).otherwise(below)))
        front = ways.select(*asked.columns, F.col("__c.node").alias("node"), F.col("__c.leaf").alias("leaf"))
    return front.select("test_id", "home", "node")


def _depth(tree: DataFrame, root: DataFrame) -> int:
    """Levels below the root; a node's name holds a dot for each level above it."""
    deepest = tree.agg(F.max(F.length("parent") - F.length(F.replace("parent", F.lit("."), F.lit(""))))).first()[0]
    return 0 if deepest is None else deepest + 1


def _nearest_in_block(k: int, leave_self_out: bool):
    def nearest(asked_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked_rows.empty or rows.empty:
            return pd.DataFrame({"test_id": [], "train_id": [], "distance": [], "__carry": []})
        a, b = np.stack(asked_rows["__v"].to_numpy()), np.stack(rows["__v"].to_numpy())
        asked_ids, bounds = asked_rows["test_id"].to_numpy(), asked_rows["bound"].to_numpy(float)
        ids, labels = rows["train_id"].to_numpy(), rows["__carry"].to_numpy()
        own_row = np.isin(asked_ids, ids) if leave_self_out else np.zeros(len(a), bool)
        take = min(k, len(ids))
        out = []
        # The expanded square cancels for vectors far from the origin: measure from the block's middle, and
        # widen the cut by what rounding can add, which grows with the norms.
        middle = b.mean(axis=0)
        near, norms = b - middle, ((b - middle) ** 2).sum(axis=1)
        unit = 4 * (b.shape[1] + 4) * np.finfo(float).eps
        twice, most = -2 * near.T, norms.max()
        step = max(1, CELLS // len(ids))
        for start in range(0, len(a), step):
            part, part_ids = a[start : start + step], asked_ids[start : start + step]
            moved = part - middle
            own = (moved**2).sum(axis=1)
            square = moved @ twice
            square += norms  # less the row's own square, which is the same for all
            for i in np.flatnonzero(own_row[start : start + step]):
                square[i, ids == part_ids[i]] = np.inf
            slack = 4 * unit * (own + most)
            limit = bounds[start : start + step]
            cut = limit**2 * (1 + 1e-9) - own
            if np.isinf(limit).any():
                open_rows = np.isinf(limit)
                cut[open_rows] = np.partition(square[open_rows], take - 1, axis=1)[:, take - 1]
            rows_in, cols_in = np.nonzero(square <= (cut + slack)[:, None])
            if leave_self_out:
                other = part_ids[rows_in] != ids[cols_in]
                rows_in, cols_in = rows_in[other], cols_in[other]
            exact = np.sqrt(((part[rows_in] - b[cols_in]) ** 2).sum(axis=1))
            order = np.lexsort((ids[cols_in], exact, rows_in))
            rows_in, cols_in, exact = rows_in[order], cols_in[order], exact[order]
            best = np.arange(len(rows_in)) - np.searchsorted(rows_in, rows_in) < k
            rows_in, cols_in = rows_in[best], cols_in[best]
            out.append(pd.DataFrame({"test_id": part_ids[rows_in], "train_id": ids[cols_in], "distance": exact[best], "__carry": labels[cols_in]}))
        return pd.concat(out)

    return nearest


def _search(asked: DataFrame, reached: DataFrame, rows: DataFrame, k: int, leave_self_out: bool, carry_type: str) -> DataFrame:
    """The k nearest training rows of every row ``asked (test_id, __v, bound, node)``, leaf by leaf in blocks of bounded size.

    ``reached`` has the ``node`` of the same rows, to count them without their vectors.
    """
    blocks = lambda df, name: df.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias(name))
    sizes = checkpointed(blocks(reached, "__tb").join(blocks(rows, "__rb"), "node"), "knn-blocks")
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    left = asked.select("test_id", "__v", "bound", "node").join(sizes, "node").withColumns({"tb": row_hash("test_id") % F.col("__tb"), "rb": every("__rb")})
    right = rows.join(sizes, "node").withColumn("rb", row_hash("train_id") % F.col("__rb")).withColumn("tb", every("__tb"))
    keys = ["node", "tb", "rb"]
    both = left.drop("__tb", "__rb").groupBy(*keys).cogroup(right.drop("__tb", "__rb").groupBy(*keys))
    return both.applyInPandas(_nearest_in_block(k, leave_self_out), f"test_id long, train_id long, distance double, __carry {carry_type}")


def knn_neighbours(
    train: DataFrame,
    test: DataFrame,
    row_id: str,
    vector: str,
    k: int = 5,
    pivots: int = 16,
    leave_self_out: bool = False,
    carry: str | None = None,
    leaf_rows: int | None = None,
) -> DataFrame:
    """``test_id, train_id, distance, place`` of the k nearest training rows of every test row.

    ``leave_self_out`` ignores the training row with the test row's own id. Ties go to the smaller id. ``pivots`` is
    the number of children of a node of the tree.
    """
    extra = [F.col(carry).alias("__carry")] if carry else [F.lit(None).cast("string").alias("__carry")]
    as_vector = F.col(vector).cast("array<double>").alias("__v")
    base = train.select(F.col(row_id).cast("long").alias("train_id"), as_vector, *extra)
    rows, tree, root = cluster_tree(base, pivots, leaf_rows)
    need = k + int(leave_self_out)
    carry_type = train.schema[carry].dataType.simpleString() if carry else "string"
    asked = _home(test.select(F.col(row_id).cast("long").alias("test_id"), as_vector), tree, root, need)
    home = asked.where("home IS NOT NULL").select("test_id", "__v", F.lit(float("inf")).alias("bound"), F.col("home").alias("node"))
    at_home = checkpointed(_search(home, home, rows, k, leave_self_out, carry_type), "knn-at-home")
    best = Window.partitionBy("test_id").orderBy("distance", "train_id")
    if root.first()["leaf"] and asked.where("home IS NULL").isEmpty():  # one leaf holds all rows
        found = at_home
    else:
        kth = at_home.withColumn("__place", F.row_number().over(best)).where(F.col("__place") == k)
        kth = kth.select(F.col("test_id").alias("__id"), "distance")
        tight = asked.join(kth, F.col("test_id") == F.col("__id"), "left")
        tight = checkpointed(tight.select("test_id", "__v", "home", F.least("bound", F.coalesce("distance", F.lit(float("inf")))).alias("bound")), "knn-tight")
        reached = _reachable(tight, tree, root).where(~F.col("node").eqNullSafe(F.col("home")))
        reached = checkpointed(reached.distinct(), "knn-reached").withColumnsRenamed({"test_id": "__id", "home": "__home"})
        elsewhere = tight.join(reached, (F.col("test_id") == F.col("__id")) & F.col("home").eqNullSafe(F.col("__home")))
        found = at_home.unionByName(_search(elsewhere, reached, rows, k, leave_self_out, carry_type))
    out = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return out.withColumnRenamed("__carry", carry) if carry else out.drop("__carry")


def share_skipped(train: DataFrame, test: DataFrame, row_id: str, vector: str, k: int = 5, pivots: int = 16, leaf_rows: int | None = None) -> float:
    """Share of the pairs of a test row and a leaf that the tree rules out, with the exact bound of ``knn_neighbours``."""
    as_vector = F.col(vector).cast("array<double>").alias("__v")
    rows, tree, root = cluster_tree(train.select(F.col(row_id).cast("long").alias("train_id"), as_vector), pivots, leaf_rows)
    near = knn_neighbours(train, test, row_id, vector, k, pivots, leaf_rows=leaf_rows).where(F.col("place") == k)
    asked = test.select(F.col(row_id).cast("long").alias("test_id"), as_vector)
    asked = asked.join(near.select("test_id", F.col("distance").alias("bound")), "test_id").withColumn("home", F.lit(None).cast("string"))
    met = _reachable(asked, tree, root).count()
    return 1 - met / (asked.count() * rows.select("node").distinct().count())


def knn_vote(
    train: DataFrame, test: DataFrame, row_id: str, vector: str, label: str, k: int = 5, leave_self_out: bool = False
) -> DataFrame:
    """Most frequent label among the k nearest; the smallest label among equals."""
    near = knn_neighbours(train, test, row_id, vector, k, leave_self_out=leave_self_out, carry=label)
    votes = near.groupBy("test_id", label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("test_id").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("prediction"))
