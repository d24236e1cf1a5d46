"""Prefix trie of conversations, built by van Emde Boas recursion.

All sequences are cut at half their span at once. The cut prefix of each gets a name; the upper halves form a trie, and the
lower halves of each cut prefix a trie of their own, a forest. Both kinds are the next round's sequences: equal ones of one forest become one row
that counts its conversations, so copies vanish in the first rounds. After as many rounds as the span has bits a row is one turn between two
names: a node and its parent. A span of any length is met by spelling sequences in units: a conversation of more than ``UNIT`` turns is
a sequence of digests of ``UNIT`` turns, if need be of several tiers, so that no row holds more than ``UNIT`` entries.

Totals over subtrees are grafted upward along the same cuts. First the total of each lower forest, as far down as its span goes, is added to the
total of the upper trie's first node, from span one to the largest. Then, from the largest span to the smallest, what is known at the end of
a lower forest is added to its cut prefix. Each pass sends every cut once, so the work is that of the nodes, and a node with very many
children is summed by partial aggregates.

Names and turns are known by 128-bit hashes.

Edge cases: a NULL role or text is empty; rows with a NULL conv_id take no part; turns with equal numbers, NULLs among them first, are ordered by the hash
of role and text; repeated rows are turns of their own; conversations that lose all turns are members of the root; an empty table has no nodes; other
columns are ignored; long texts enter by hash and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.llm.common import keep

UNIT = 1024  # a power of two
IDS = 8192  # member ids in one piece of text
EMPTY = hashlib.sha256(b"").hexdigest()


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def _digest(tag: str, *cols) -> Column:
    return F.struct(F.xxhash64(F.lit(tag), *cols).alias("a"), F.xxhash64(F.lit(tag + "'"), *cols).alias("b"))


def _name(forest, seg) -> Column:
    """Name of the prefix that leads through ``seg`` from the prefix ``forest``."""
    return _digest("name", forest, seg)


def ordered_turns(df: DataFrame) -> DataFrame:
    """conv_id, place in the conversation from 0, and turn ``x`` (hash and code points): places come from one range sort and a count per range."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    x = _digest("turn", role, text).withField("cp", F.length(text).cast("int"))
    d = df.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", x.alias("x")).withColumn("u", F.monotonically_increasing_id())
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "x", "u"]
    laid = keep(d.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "x", F.monotonically_increasing_id().alias("m")))
    part = laid.withColumn("p", F.shiftright("m", 33))
    spans = part.groupBy("conv_id", "p").agg(F.min("m").alias("first"), F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    spans = spans.withColumn("off", before - F.col("first")).drop("first", "c")
    return part.join(spans, ["conv_id", "p"]).select("conv_id", (F.col("m") + F.col("off")).alias("pos"), "x")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, size), and their turns with the first few taken from the conversation at the last multiple of ``every``."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    head = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("base"))
    head = head.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("head"))  # at most heads - 1 turns
    info = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(head, "base", "left")
    info = keep(info.select("conv_id", "own", "h", F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast("array<struct<a:bigint,b:bigint,cp:int>>"))
                            .otherwise(F.slice("head", 1, F.greatest("h", F.lit(1)))).alias("take")))
    size = F.size("take") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    given = info.select("conv_id", F.posexplode("take").alias("pos", "x")).select("conv_id", F.col("pos").cast("long").alias("pos"), "x")
    # a long conversation meets its row piece by piece
    pieces = info.filter(F.col("own") > F.col("h")).select("conv_id", (F.size("take") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / UNIT))).alias("g"))
    own = turns.filter(F.col("pos") >= h).withColumn("g", F.floor(F.col("pos") / UNIT)).join(pieces, ["conv_id", "g"])
    return info.select("conv_id", size.alias("size")), given.unionByName(own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "x"))


def _tiers(rows: DataFrame, unit: int) -> list[DataFrame]:
    """Tables (conv_id, i, seg): arrays of turns, then arrays of digests of such arrays, until a conversation is one row."""
    out = []
    while True:
        rows = rows.groupBy("conv_id", F.floor(F.col("pos") / unit).alias("i")).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
        out.append(keep(rows.select("conv_id", "i", F.transform("s", lambda e: e["x"]).alias("seg"))))
        if out[-1].filter("i > 0").isEmpty():
            return out
        rows = out[-1].select("conv_id", F.col("i").alias("pos"), _digest("unit", "seg").withField("cp", F.lit(0)).alias("x"))


def _merged(rows: DataFrame) -> DataFrame:
    """Equal sequences of a forest as one row, with the smallest conversation and their number."""
    g = rows.withColumn("key", F.xxhash64("seg")).groupBy("forest", "end", "start", "whole", "key", _digest("seg", "seg").alias("key2"))
    return g.agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.any_value("seg").alias("seg")).drop("key", "key2")


def _nodes(tiers: list[DataFrame], unit: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Nodes below the root, and for each span the cuts (forest, mid, end) with the depth of the lower half."""
    top, levels = len(tiers) - 1, []
    span = 1 << max(0, (tiers[top].agg(F.max(F.size("seg"))).first()[0] or 1) - 1).bit_length()
    d = tiers[top].select(_root().alias("forest"), F.lit(0).cast("long").alias("start"), F.col("conv_id").alias("rep"), F.lit(1).cast("long").alias("n"), "seg", _digest("whole", "seg").alias("whole"))
    d = keep(_merged(d.withColumn("end", F.when(F.size("seg") == span, _name("forest", "seg")))))
    for tier in range(top, -1, -1):
        scale = unit ** tier
        if tier < top:  # each unit spelled out
            spelled = tiers[tier].groupBy(_digest("unit", "seg").alias("key")).agg(F.any_value("seg").alias("seg"))
            d = d.withColumn("key", F.struct(F.col("seg")[0]["a"].alias("a"), F.col("seg")[0]["b"].alias("b"))).drop("seg").join(spelled, "key").drop("key")
            d, span = keep(d.withColumn("end", F.when(F.size("seg") == unit, F.col("end")))), unit
        while span > 1:
            half = span // 2
            upper = F.slice("seg", 1, half)
            d = d.withColumn("mid", F.when(F.size("seg") >= half, _name("forest", upper)))
            levels.append((half * scale, d.select("forest", "mid", "end")))
            goes_on = F.size("seg") > half
            parts = F.array(F.struct("forest", F.col("mid").alias("end"), "start", upper.alias("seg"), F.when(~goes_on, F.col("whole")).alias("whole")),
                            F.struct(F.col("mid").alias("forest"), "end", (F.col("start") + half * scale).alias("start"), F.slice("seg", half + 1, half).alias("seg"), "whole"))
            d = d.select("rep", "n", F.explode(F.when(goes_on, parts).otherwise(F.slice(parts, 1, 1))).alias("z")).select("z.*", "rep", "n")
            d, span = keep(_merged(d)), half
    turn = F.col("seg")[0]
    one = d.groupBy(F.col("end").alias("name"), F.col("forest").alias("parent"), (F.col("start") + 1).alias("depth")).agg(
        F.any_value(turn["cp"]).cast("long").alias("cp"), F.min("rep").alias("rep"), F.sum("n").alias("n"), F.max("whole").alias("whole"))
    return one, levels[::-1]


def _grafted(values: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Sums of ``leaf`` and ``saved`` over all nodes below each node that has any: name, leaf, saved."""
    def total(d: DataFrame) -> DataFrame:
        return keep(d.groupBy("name").agg(F.min("depth").alias("depth"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))

    up = total(values.filter("depth > 0").select(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth"), "leaf", "saved"))
    steps = []
    for length, cuts in levels:
        steps.append(up)
        cut = cuts.filter("mid IS NOT NULL").select("forest", F.col("mid").alias("name")).distinct()
        lower = up.join(cut, "name").select(F.col("forest").alias("name"), (F.col("depth") - length).alias("depth"), "leaf", "saved")
        up = total(up.filter(F.col("depth") % (2 * length) == 0).unionByName(lower))
    down = up
    for (length, cuts), known in zip(levels[::-1], steps[::-1], strict=True):
        ends = cuts.filter("end IS NOT NULL").select("mid", F.col("end").alias("name")).distinct()
        lower = down.join(ends, "name").select(F.col("mid").alias("name"), (F.col("depth") - length).alias("depth"), "leaf", "saved")
        down = down.unionByName(total(known.filter(F.col("depth") % (2 * length) != 0).unionByName(lower)))
    return down.drop("depth")


def _ids_hashed(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each group ``whole``. A group's ids are sorted over many tasks, put into pieces of ``IDS`` there, and only
    the pieces pass through one task, one after the other, since the hash is defined over them in order."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, schema = None, [], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

        def out():
            return held[0], held[1], ids[0], ",".join(map(str, ids))

        for batch in batches:
            done = []
            for a, b, i in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id")), strict=True):
                if held != (a, b) or len(ids) == IDS:
                    if ids:
                        done.append(out())
                    held, ids = (a, b), []
                ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, schema.types, strict=True)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out(), schema.types, strict=True)], schema=schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, schema = None, None, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())])
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if held == (a, b):
                    sha.update(b",")
                else:
                    if held:
                        done.append((*held, sha.hexdigest()))
                    held, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, schema.types, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, sha.hexdigest()), schema.types, strict=True)], schema=schema)

    flat = ends.select("whole.a", "whole.b", "conv_id")
    p = flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(pieces, "a long, b long, first long, ids string")
    s = p.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashes, "a long, b long, sha string")
    return s.select(F.struct("a", "b").alias("whole"), "sha")


def build(df: DataFrame, every: int = 100, heads: int = 6, unit: int = UNIT) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations."""
    spark = df.sparkSession
    convs, turns = rebuilt(ordered_turns(df), every, heads)
    tiers = _tiers(turns, unit)
    nodes, levels = _nodes(tiers, unit)
    root = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).filter("n > 0")
    root = root.select(_root().alias("name"), F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("cp"), "rep", "n", _root().alias("whole"))
    nodes = keep(nodes.unionByName(root))
    kids = nodes.filter("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    values = keep(nodes.join(kids, "name", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"), "saved": (F.col("n") - 1) * F.col("cp")}))
    below = _grafted(values, levels)
    zero = F.lit(0)
    d = values.join(below.select("name", F.col("leaf").alias("l"), F.col("saved").alias("s")), "name", "left").select(
        "name", "parent", "depth", "rep", "n", "whole", "n_children", (F.col("leaf") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved_tokens"))
    # a node with very many children meets them in salted parts: one row for each salt that occurs, then one for each child
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)))
    parts = d.filter("depth > 0").select("parent", "salt").distinct().join(nodes.select(F.col("name").alias("parent"), F.col("rep").alias("parent_conv_id")), "parent")
    below_root = d.filter("depth > 0").join(parts, ["parent", "salt"])
    d = below_root.unionByName(d.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")), allowMissingColumns=True)
    ends = tiers[-1].select("conv_id", _digest("whole", "seg").alias("whole")).unionByName(convs.filter("size = 0").select("conv_id", _root().alias("whole")))
    hashed = _ids_hashed(ends)
    d = keep(d)
    inner = d.filter("whole IS NULL").withColumn("ends_sha256", F.lit(EMPTY))
    ended = d.filter("whole IS NOT NULL").join(hashed, "whole", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    cols = [F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.select(*cols).unionByName(ended.select(*cols))
