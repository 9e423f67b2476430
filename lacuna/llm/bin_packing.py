"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form a group that never leaves its shard.  Groups go to bins in order of falling size, each
into the bin with the least remaining capacity that still holds it; the bins stand in a balanced search tree by
remaining capacity.

Spark sorts and counts, the driver packs runs.  A size is rounded up to DIGITS binary digits, so there are at most
2^(DIGITS-1) sizes to an octave (about 40,000 in all, however many groups), and one row for each of them, with its
count, reaches the driver.  Equal sizes follow one another, and best fit puts them into one bin until that is full,
so a run is placed in one step; the result is that of packing group by group.  Within a size, groups are ranked by
hash and dealt to the runs' bins.

`pack` opens as many bins of a fixed capacity as needed; `pack_evenly` searches for the smallest capacity that
needs no more than the given number of bins, which makes their sizes near equal (law `bytes`).  A group larger
than an even share gets a shard for itself, and the other shards divide what is left.

Null text has no bytes (size 1) and groups with other nulls; the empty text is a group of its own.  Equal rows
share a shard and get different slots.  A text of any length counts whole.  An empty table gives an empty result.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.workspace import HOT, join_hot, new_folder, to_table

#: Binary digits of a size that are kept; below 2^DIGITS sizes are exact.
DIGITS = 12
#: Rows that one task numbers at a time.
CELL_ROWS = 50_000


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class CapacityTree:
    """Balanced (AA) tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            l = t.left
            t.left, l.right = l.right, t
            return l
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            r = t.right
            t.right, r.left = r.left, t
            r.level += 1
            return r
        return t

    def add(self, key) -> None:
        def into(t):
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return self._split(self._skew(t))

        self.root = into(self.root)

    def remove(self, key) -> None:
        def out(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = out(t.left, key)
            elif key > t.key:
                t.right = out(t.right, key)
            elif t.left is None and t.right is None:
                return None
            elif t.left is None:
                n = t.right
                while n.left:
                    n = n.left
                t.key, t.right = n.key, out(t.right, n.key)
            else:
                n = t.left
                while n.right:
                    n = n.right
                t.key, t.left = n.key, out(t.left, n.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and low < t.right.level:
                    t.right.level = low
            t = self._skew(t)
            if t.right:
                t.right = self._skew(t.right)
                if t.right.right:
                    t.right.right = self._skew(t.right.right)
            t = self._split(t)
            if t.right:
                t.right = self._split(t.right)
            return t

        self.root = out(self.root, key)

    def tightest(self, size: int):
        """The entry with the least capacity of at least size, or None."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def pack(runs: list[tuple[int, int]], capacity: int) -> tuple[list[list[tuple[int, int]]], int]:
    """(bin, how many) of each run (size, count), and how many bins.  Sizes must fall; an item above capacity fills a bin alone."""
    tree, bins, out = CapacityTree(), 0, []
    for size, count in runs:
        placed = []
        while count:
            found = tree.tightest(size)
            if found is None:
                left, at = capacity, bins
                bins += 1
            else:
                tree.remove(found)
                left, at = found
            n = min(count, max(1, left // size))  # the bin stays the tightest one until it holds no more of this size
            count -= n
            placed.append((at, n))
            if left > n * size:
                tree.add((left - n * size, at))
        out.append(placed)
    return out, bins


def pack_evenly(runs: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """As `pack`, with the smallest capacity found that needs at most `bins` bins."""
    total, alone, rest = sum(s * n for s, n in runs), 0, [list(r) for r in runs]
    while rest and alone < bins - 1 and rest[0][0] * (bins - alone) > total:  # larger than an even share of what is left
        total -= rest[0][0]
        alone += 1
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    heads = list(range(alone))
    out: list[list[tuple[int, int]]] = []
    for _, n in runs:
        own, heads = heads[:n], heads[n:]
        out.append([(b, 1) for b in own])
    if not rest:
        return out
    left, rest = bins - alone, [tuple(r) for r in rest]
    low = max(rest[0][0], -(-total // left))
    high = low + rest[0][0]
    while pack(rest, high)[1] > left:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if pack(rest, mid)[1] <= left else (mid + 1, high)
    while pack(rest, low)[1] > left:  # best fit isn't monotone in the capacity
        low += 1 + low // 10_000
    packed = dict(zip((s for s, _ in rest), pack(rest, low)[0], strict=True))
    return [own + [(alone + b, n) for b, n in packed.get(s, [])] for own, (s, _) in zip(out, runs, strict=True)]


def rounded(size: str) -> Column:
    """The column of sizes, rounded up to DIGITS binary digits."""
    drop = f"greatest(length(bin({size})) - {DIGITS}, 0)"
    return F.expr(f"shiftleft(shiftright({size} - 1, {drop}) + 1, {drop})")


def _group(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit("null").cast("binary"))


def _ranked(df: DataFrame, keys: list[str], order: list[str], total: int) -> DataFrame:
    """Adds `rank`, gapless from 0 within keys: rows are dealt to cells of about CELL_ROWS, which are numbered apart and start where the ones before end."""
    cells = max(1, -(-total // CELL_ROWS))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.ceil(F.col("__n") / CELL_ROWS).cast("int").alias("__cells")) if cells > 1 else None
    dealt = df.withColumn("__cells", F.lit(1)) if counted is None else df.join(F.broadcast(counted), keys)
    dealt = dealt.withColumn("__cell", F.pmod(F.xxhash64(*order), F.col("__cells")).cast("int")).drop("__cells")
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(*keys, "__cell").orderBy(*order)
    return dealt.withColumn("__k", F.row_number().over(within)).join(starts, [*keys, "__cell"]).withColumn("rank", (F.col("__first") + F.col("__k") - 1).cast("long")).drop("__cell", "__first", "__k")


def shard(docs: DataFrame, folder: str, shards: int = 16, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' id, size, text_crc32, law, shard, slot and grown_shard; texts are read once, tables of sizes go below folder."""
    spark: SparkSession = docs.sparkSession
    body = F.col(text).cast("string")
    rows = to_table(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"),
            _group(body).alias("g"),
        ),
        f"{folder}/rows",
    )
    groups = to_table(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("class", rounded("bytes")), f"{folder}/groups")
    count, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect()  # 2^(DIGITS-1) an octave
    packed = pack_evenly([(r["class"], r["n"]) for r in classes], shards)
    runs = []
    for r, placed in zip(classes, packed, strict=True):
        ends, at = [], 0
        for b, n in placed:
            at += n
            ends.append((at, b))
        runs.append((r["class"], ends))
    dealt = spark.createDataFrame(runs, "class bigint, runs array<struct<upto:bigint,bin:int>>")
    of_group = (
        _ranked(groups.select("g", "n", "class"), ["class"], ["g"], n_groups)
        .join(F.broadcast(dealt), "class")  # a row for each class
        .select("g", "n", F.expr("filter(runs, r -> r.upto > rank)[0].bin").alias("shard"))
    )
    of_group = to_table(of_group, f"{folder}/placed")
    hot = of_group.filter(F.col("n") * HOT > count).select("g", "shard")
    own = rows.select("id", "size", "crc", "g", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))  # names a row, so equal rows part
    placed = to_table(join_hot(own, of_group.select("g", "shard"), hot, "g", F.struct("file", "at")).drop("g"), f"{folder}/sharded")
    numbered = _ranked(placed, ["shard"], ["id", "file", "at"], count)
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "shards"))


