"""Links among the members of a key, for keys with any number of members, without all pairs.

What is wanted are edges that connect whatever a relation links, directly or by a chain; a spanning forest does.

1. A key's members are dealt by hash into chunks of CELL members or CELL_BYTES at most, and each chunk is settled in one
   task.  Small keys are one chunk and done.
2. Of a larger key, whose chunks were settled apart, each component of a chunk sends REPRESENTATIVES members to the next
   tier, which is dealt and settled the same way, until the representatives fit into one chunk or components stop
   melting.  Copies of one text thus become one component at a cost in proportion to their number.
3. If a key then still has several components, nothing says that they aren't linked: all members of the largest are
   compared with all others, and the others among themselves, chunk against chunk.  Only this step, and only for
   members that no tier linked, costs more than the number of members.

Edges of one key count for all, so components are those of the whole table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import HOT, cut_lineage, join_hot, to_table
from lacuna.operators.components import connected_components
from lacuna.operators.grouped import key_runs

CELL, CELL_BYTES = 2048, 16 << 20
REPRESENTATIVES = 16


def spanning_forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1; near(i, others) is a mask."""
    left, out = np.arange(n), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            mask = near(i, left)
            if mask.any():
                out += [(i, j) for j in left[mask]]
                front += list(left[mask])
                left = left[~mask]
    return out


def stars(a: list, b: list) -> tuple[list, list]:
    """The components of edges (a, b) as edges from each node to the least of its component."""
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        up[max(x, y)] = up[min(x, y)] = min(x, y)
    found = [(x, top(x)) for x in up]
    return [x for x, y in found if x != y], [y for x, y in found if x != y]


def _settled(placed: DataFrame, relation, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges `(a, b)` within the cells of rows (key, cell, cls, what, main, large), and representatives `(key, cls, what)` of the components of large keys' cells.

    In a cell with main members, which are linked already, only others are linked with one of them.
    """
    kind, key_kind, what_kind = (placed.schema[c].dataType.simpleString() for c in ("cls", "key", "what"))

    def run(batches):
        def compare(key, rows):
            cls, what, main = rows.column("cls").to_pylist(), rows.column("what").to_pylist(), np.array(rows.column("main").to_pylist())
            edges = []
            if len(cls) > 1 and not main.all():
                near = relation(what)
                if main.any():
                    mains = np.flatnonzero(main)
                    hits = ((i, mains[near(i, mains)]) for i in np.flatnonzero(~main))
                    edges = [(i, js[0]) for i, js in hits if len(js)]
                else:
                    edges = spanning_forest(len(cls), near)
            a.extend(cls[i] for i, _ in edges)
            b.extend(cls[j] for _, j in edges)
            if rows.column("large")[0].as_py():
                label, held = list(range(len(cls))), Counter()
                for i, j in edges:  # in the order of a search from each component's first member
                    label[j] = label[i]
                for i, x in enumerate(label):
                    held[x] += 1
                    if held[x] <= REPRESENTATIVES:
                        reps.append((key, cls[i], what[i]))

        def out():
            null = [None] * len(reps)
            keys, names, whats = list(zip(*reps, strict=True)) or [()] * 3
            low, high = stars(a, b)  # keys of a task often hold the same classes
            empty = [None] * len(low)
            columns = [low + null, high + null, empty + list(keys), empty + list(names), empty + list(whats)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "b", "key", "cls", "what"])

        a, b, reps, types = [], [], [], None
        for (key, _), rows in key_runs(batches, ["key", "cell"]):
            types = types or [rows.schema.field(c).type for c in ("cls", "cls", "key", "cls", "what")]
            compare(key, rows)
            if len(a) > 1 << 16 or len(reps) > 1 << 12:
                yield out()
                a, b, reps = [], [], []
        if types is not None:
            yield out()

    sorted_ = placed.select("key", "cell", "cls", "what", "main", "large").repartition("key", "cell").sortWithinPartitions("key", "cell", "cls")
    both = to_table(sorted_.mapInArrow(run, f"a {kind}, b {kind}, key {key_kind}, cls {kind}, what {what_kind}"), folder)
    return both.filter("a is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), both.filter("key is not null").select("key", "cls", "what")


def _chunks(n, size, cell: int, cell_bytes: int):
    return F.greatest(F.ceil(n / cell), F.ceil(size / cell_bytes)).cast("bigint")


def _dealt(chunks, seed: int):
    return F.pmod(F.xxhash64("cls", F.lit(seed)), chunks)


def components(members: DataFrame, relation, folder: str, cell: int = CELL, cell_bytes: int = CELL_BYTES, whats: DataFrame | None = None) -> DataFrame:
    """`(node, root)` of all classes of members (key, cls, what) that relation(list of what) -> near links with another one of their key, directly or by others.

    root is the least class of its component.  A class is once in a key at most.  With whats (cls, what), one row for each
    class, members are only (key, cls), and those of keys that have several meet it: less is shuffled where a class has
    many keys.  Tables go below folder.
    """
    if whats is not None:
        several = to_table(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("is_shared", F.lit(True)), f"{folder}/several")
        shared = _of_keys(members.select("key", "cls"), several, several.agg(F.sum("n")).first()[0] or 0, "is_shared")
        members = to_table(shared.select("key", "cls").join(whats, "cls"), f"{folder}/met")
    n, size = F.count(F.lit(1)), F.sum(F.octet_length("what"))
    chunks = _chunks(n, size, cell, cell_bytes).alias("chunks")
    counted = to_table(members.groupBy("key").agg(n.alias("n"), chunks).filter("n > 1"), f"{folder}/counts")
    total, most = counted.agg(F.sum("n"), F.max("chunks")).first()
    sized = _of_keys(members.select("key", "cls", "what"), counted, total or 0, "chunks")
    dealt = lambda rows, seed: rows.select("key", _dealt(F.col("chunks"), seed).alias("cell"), "cls", "what", F.lit(False).alias("main"), (F.col("chunks") > 1).alias("large"))
    edges, pool = _settled(dealt(sized, 0), relation, f"{folder}/tier-0")
    if (most or 0) <= 1:
        return connected_components(edges, cut_lineage)
    tier, before = 1, None
    while (now := pool.count()) and (before is None or now <= 0.75 * before):
        pooled = to_table(pool.groupBy("key").agg(n.alias("n"), chunks), f"{folder}/pooled-{tier}")
        more, pool = _settled(dealt(_of_keys(pool, pooled, now, "chunks"), tier), relation, f"{folder}/tier-{tier}")
        edges, before, tier = edges.unionByName(more), now, tier + 1
    edges = to_table(edges, f"{folder}/edges")
    roots = connected_components(edges, cut_lineage)
    big = sized.filter("chunks > 1").drop("chunks")
    named = to_table(big.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), f"{folder}/rooted")
    keys = _apart(named, f"{folder}/apart")
    if keys.isEmpty():
        return roots
    more, _ = _settled(_rest(named, keys, named.count(), cell, cell_bytes), relation, f"{folder}/rest")
    return roots if more.isEmpty() else connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), cut_lineage)


def _apart(named: DataFrame, folder: str) -> DataFrame:
    """One row for each key of rows (key, root, cls, what) that has several components: how many, the largest, and the rows and bytes of all and of the largest."""
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("what")).alias("size"))
    best = F.struct("n", "root")
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("root", best).alias("main_root"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.max_by("size", best).alias("size_main"), F.sum("size").alias("size"))
    return to_table(keys.filter("parts > 1"), folder)


def _of_keys(rows: DataFrame, keys: DataFrame, total: int, *columns: str) -> DataFrame:
    """Rows of the keys, with the columns; rows of a key that has more than 1/HOT of all are dealt by class."""
    hot = keys.filter(F.col("n") * HOT > total)
    return join_hot(rows, keys.select("key", *columns), hot.select("key", *columns), "key", F.col("cls")).filter(F.col(columns[0]).isNotNull())


def _rest(named: DataFrame, keys: DataFrame, total: int, cell: int, cell_bytes: int) -> DataFrame:
    """Cells of what is still apart in rows (key, root, cls, what): the members of the largest component with all others, and these among themselves."""
    half = cell // 2 or 1
    grid = keys.select("key", "n", "main_root", _chunks(F.col("n_main"), F.col("size_main"), half, cell_bytes // 2).alias("mains"), _chunks(F.col("n") - F.col("n_main"), F.col("size") - F.col("size_main"), half, cell_bytes // 2).alias("others"))
    met = _of_keys(named, grid, total, "main_root", "mains", "others").withColumn("is_main", F.col("root") == F.col("main_root"))
    mine = _dealt(F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")), -1)
    across = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.col("mine") * F.col("others") + j)).otherwise(F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: i * F.col("others") + F.col("mine")))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: -1 - (F.least("mine", j) * F.col("others") + F.greatest("mine", j)))
    placed = met.withColumn("mine", mine)
    one = placed.select("key", F.explode(across).alias("cell"), "cls", "what", F.col("is_main").alias("main"))
    two = placed.filter("not is_main").select("key", F.explode(among).alias("cell"), "cls", "what", F.lit(False).alias("main"))
    return one.unionByName(two).withColumn("large", F.lit(False))
