"""Exact Jaccard join of word n-gram sets, with skipping by set relations.

1. A text's set holds the 64-bit hashes of its n-grams; equal sets are one set with several documents.
2. Index. Sizes are covered by overlapping windows, so that any two sets that can link share one. In a window, hashes are dealt to
   k parts by their value. Two linked sets differ in at most d hashes, so at least k - d of their
   parts are equal. k is chosen so that among these is one of two hashes or more: parts with fewer are
   left out by every set that has no more of them than ``k - d - 1``. What is indexed is a part with its place, never a
   single hash, so a passage that many texts share does not bring them together.
3. Sets that share an index entry are joined to the smallest of them, and these stars to families. Linked sets are
   always of one family. An entry that a batch of texts holds many times leaves the batch once.
4. Answers. The pivot of a family, its set with most copies, is compared with every member. A member is kept as its
   difference from the pivot: the pivot's hashes it lacks and those it adds. Members linked with the pivot are
   settled. The overlap of two others follows from their differences alone, without their sets, and the distances to the
   pivot bound it: Jaccard distance is a metric, so members are laid out in blocks by their distance, and two blocks
   whose distances differ by more than the threshold allows are skipped. Members linked with the pivot are not compared with each other.
5. The links that remain connect sets to components.

No task holds more than a block of ``BLOCK`` members, or ``ENTRIES`` hashes of theirs, on either side, and no pair of documents is ever a row.

Edge cases: a text of fewer words than n is one n-gram, one without words (NULL, empty, white space) has an empty set that links with nothing; repeated
rows and repeated doc_ids are rows of their own; NULL doc_ids take part, but name no component; an empty table gives no row; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.llm.common import bytes_of, keep, slices
from aerotrace.llm.links import components
from aerotrace.llm.word_hash import mix, words

SLICE = 2 << 20
GROWTH = 1.3
WEAK = 2  # hashes a part needs to be indexed
BLOCK = 2048
RING = 20  # rings of distance from the pivot, per unit
FEATURES = 2048
PAIRS = 1 << 21
SEEN = 1 << 20  # texts a task remembers
ENTRIES = 1 << 21  # hashes in the differences of one block
SALT = np.uint64(0x5851F42D4C957F2D)


def ngrams(raw: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, ascending within a text, and how many each text has."""
    w = words(raw, start, end)
    rows, total = len(start), np.bincount(w.row, minlength=len(start))
    first = np.cumsum(total) - total
    full = np.repeat(total >= n, total)
    at = np.flatnonzero(full & (np.arange(len(w.row)) <= np.repeat(first + total - n, total)))
    h = w.hash[at + n - 1] if len(at) else np.zeros(0, np.uint64)
    for k in range(n - 2, -1, -1):
        h = mix(h * SALT + w.hash[at + k])
    row = w.row[at]
    few = np.flatnonzero((total > 0) & (total < n))
    if len(few):  # the whole sequence as one
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = total[few] > k
            short[has] = mix(short[has] * SALT + w.hash[first[few[has]] + k] + np.uint64(k + 1))
        h, row = np.concatenate((h, short)), np.concatenate((row, few))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=rows)


def set_hashes(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for an empty one."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        sums = np.add.reduceat(mix(h ^ SALT), (np.cumsum(count) - count)[full])
        out[full] = mix(sums + count[full].astype(np.uint64)) | np.uint64(1)
    return out


@lru_cache(maxsize=8)
def windows(percent: int, largest: int, single: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(smallest size, largest size, parts, parts that may be weak, hashes a part needs) of each window up to size ``largest``.

    Sizes below the first window can only link with equal sets. With ``single``, a window whose parts are too small to hold two hashes
    mostly, by the Poisson law at its smallest size, is content with one.
    """
    def differ(a: int, b: int) -> int:  # most hashes in which linked sets of these sizes differ
        return (100 - percent) * (a + b) // (100 + percent)

    low, out = 1, []
    while differ(low, low * 100 // percent) == 0:
        low += 1
    while low <= largest:
        high = max(low + 1, int(np.ceil(low * GROWTH))) - 1  # the smaller set of a pair
        other = high * 100 // percent
        d = differ(high, other)
        weak, need = int(np.ceil(0.14 * (d + 1) / 0.86)) + 1, WEAK
        mean = low / (d + weak + 1)
        if single and np.exp(-mean) * (1 + mean) * (d + weak + 1) > 0.8 * weak:
            need = 1
        out.append((low, other, d + weak + 1, weak, need))
        low = high + 1
    return out


def _parts(mine: np.ndarray, owner: np.ndarray, parts: int, place: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, owner, number of hashes, and place among ``parts`` of every part that holds any."""
    part = ((mine >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # hashes ascend, so parts do
    begin = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))) if len(mine) else np.zeros(0, np.int64)
    key = mix(np.add.reduceat(mix(mine + SALT), begin) + mix(place + part[begin])) if len(mine) else np.zeros(0, np.uint64)
    return key, owner[begin], np.diff(np.append(begin, len(mine))), part[begin]


def index_keys(h: np.ndarray, count: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of each set: their keys and the number of the set each belongs to.

    With ``frequent``, sorted hashes, the parts are made of the other hashes, in which linked sets differ no more than in all; only sets with
    too many weak parts among those are indexed by all their hashes as well. Two linked sets share an entry of the first
    kind if either is not such a set, else one of the second. Any set of hashes will do.
    """
    first, keys, owners = np.cumsum(count) - count, [], []
    rare = None
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] != h
    for number, (low, high, parts, allowed, need) in enumerate(windows(percent, int(count.max(initial=0)), frequent is not None)):
        sets = np.flatnonzero((count >= low) & (count <= high))
        if not len(sets):
            continue
        place = np.uint64(number + 1) << np.uint64(40)
        if rare is not None:
            size = count[sets]
            owner = np.repeat(np.arange(len(sets)), size)
            at = np.repeat(first[sets] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            key, who, held, _ = _parts(h[at[rare[at]]], owner[rare[at]], parts, place + (np.uint64(1) << np.uint64(39)))
            strong = held >= need
            keys.append(key[strong])
            owners.append(sets[who[strong]])
            sets = sets[parts - np.bincount(who[strong], minlength=len(sets)) > allowed]
            if not len(sets):
                continue
        size = count[sets]
        owner = np.repeat(np.arange(len(sets)), size)
        mine = h[np.repeat(first[sets] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        key, who, held, part = _parts(mine, owner, parts, place)
        strong = held >= need
        weak = parts - np.bincount(who[strong], minlength=len(sets))
        keep = strong | (weak > allowed)[who]
        keys.append(key[keep])
        owners.append(sets[who[keep]])
        for i in np.flatnonzero(weak > allowed):  # its empty parts count too
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[who == i])
            keys.append(mix(mix(place + empty)))
            owners.append(np.full(len(empty), sets[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def frequent_ngrams(docs: DataFrame, n: int, sample: int = 20_000, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Hashes that ``least`` of the ``sample`` rows of smallest hash hold, the ``most`` most frequent of them, ascending.

    They only steer the index: it loses no link whichever they are. At most ``most`` numbers go to the driver.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text")
    picked = keyed.select("k").orderBy("k").limit(sample).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, c = np.unique(ngrams(*bytes_of(batch.column("text")), n)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(c.astype(np.int64))], ["h", "c"])

    counted = keyed.join(F.broadcast(picked), "k").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counted.filter(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(most).toArrow()
    return np.sort(np.asarray(rows["h"].combine_chunks(), np.int64).view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def combine(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries (key, set) of a batch, each key once: its other sets become entries of pairs with the smallest."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    hub = sets[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))] if len(keys) else sets
    other = hub != sets
    if not other.any():
        return keys[new], sets[new]
    pairs = np.unique(np.stack((hub[other], sets[other]), 1), axis=0)
    own = mix(mix(pairs[:, 0]) + pairs[:, 1])
    return np.concatenate((keys[new], own, own)), np.concatenate((sets[new], pairs[:, 0], pairs[:, 1]))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set (NULL if empty) and text_hash of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, count = ngrams(*bytes_of(batch.column("text")), n)
                s = set_hashes(h, count)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(s.view(np.int64), mask=count == 0), batch.column("text_hash")],
                                                 ["doc_id", "n_shingles", "set", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, n_shingles long, `set` long, text_hash long")


def entries(docs: DataFrame, n: int, percent: int, frequent: np.ndarray | None = None) -> DataFrame:
    """Index entries (key, set) of all texts, combined batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, count = ngrams(*bytes_of(batch.column("text")), n)
                s = set_hashes(h, count)
                _, once = np.unique(s, return_index=True)
                keep = np.zeros(len(count), bool)
                keep[once] = True
                h, count, s = h[np.repeat(keep, count)], count[keep], s[keep]
                keys, owner = index_keys(h, count, percent, frequent)
                keys, sets = combine(keys, s[owner])
                yield pa.RecordBatch.from_arrays([_signed(keys), _signed(sets)], ["key", "set"])

    return docs.select("text").mapInArrow(run, "key long, `set` long")


def different_texts(docs: DataFrame) -> DataFrame:
    """text_hash and text of the rows that hold a text; most copies that a task meets are left out, a few may stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for h in batch.column("text_hash").to_pylist():
                new.append(h not in seen)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
            yield batch.filter(pa.array(new, pa.bool_()))

    return docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "text_hash long, text string")


def differences(texts: DataFrame, n: int) -> DataFrame:
    """Members as their differences from the pivot of their family.

    ``texts`` has family, salt, member (0 for the pivot), set, text; the pivot is there once for each salt.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, out, held = None, None, [], 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, count = ngrams(*bytes_of(batch.column("text")), n)
                s, first = set_hashes(h, count).view(np.int64), np.cumsum(count) - count
                for i, (family, salt, member, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("family", "salt", "member", "set")), strict=True)):
                    if s[i] != key:  # another text of the same hash
                        continue
                    mine = h[first[i]:first[i] + count[i]]
                    if not member:
                        at, pivot = (family, salt), mine.copy()
                        continue
                    if at != (family, salt):
                        raise RuntimeError("a member came before its pivot")
                    place = np.searchsorted(pivot, mine)
                    common = np.zeros(len(mine), bool)
                    inside = place < len(pivot)
                    common[inside] = pivot[place[inside]] == mine[inside]
                    lacks = np.ones(len(pivot), bool)
                    lacks[place[common]] = False
                    out.append((family, key, len(mine), len(pivot), int(common.sum()), np.flatnonzero(lacks).astype("<u4").tobytes(), mine[~common].astype("<u8").tobytes()))
                    held += len(out[-1][5]) + len(out[-1][6])
                    if held >= SLICE:
                        yield _members(out)
                        out, held = [], 0
        if out:
            yield _members(out)

    laid = texts.repartition("family", "salt").sortWithinPartitions("family", "salt", "member", "set")
    return laid.mapInArrow(run, "family long, `set` long, n long, pivot_n long, common long, lacks binary, adds binary")


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 5 + (pa.binary(),) * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["family", "set", "n", "pivot_n", "common", "lacks", "adds"])


def overlaps(a: list[tuple], b: list[tuple], pivot_n: int) -> np.ndarray:
    """Overlap of each of ``a`` with each of ``b``, members as (n, common, lacks, adds) of one pivot, from the differences alone.

    A hash that both lack counts once more than their single losses do, one that both add counts as it is. Hashes that many members
    have are counted by a matrix product, those that few have pair by pair.
    """
    lacks = [np.frombuffer(r[2], "<u4") for r in (*a, *b)]
    adds = [np.frombuffer(r[3], "<u8") for r in (*a, *b)]
    lost, gained = np.array([len(x) for x in lacks]), np.array([len(x) for x in adds])
    owner = np.repeat(np.tile(np.arange(len(lost)), 2), np.concatenate((lost, gained)))
    feature = np.concatenate((np.concatenate(lacks).astype(np.int64), pivot_n + np.unique(np.concatenate(adds), return_inverse=True)[1]))
    n_a, n_b = len(a), len(b)
    left = owner < n_a
    most = int(feature.max(initial=-1)) + 1
    in_a, in_b = np.bincount(feature[left], minlength=most), np.bincount(feature[~left], minlength=most)
    pairs = in_a * in_b
    many = pairs > n_a * n_b // 64
    out = np.zeros((n_a, n_b), np.float32)
    number = np.cumsum(many) - 1  # of the hashes that many have
    for low in range(0, int(many.sum()), FEATURES):
        here = many[feature] & (number[feature] >= low) & (number[feature] < low + FEATURES)
        x = np.zeros((n_a + n_b, FEATURES), np.float32)
        x[owner[here], number[feature[here]] - low] = 1
        out += x[:n_a] @ x[n_a:].T
    few = (pairs > 0) & ~many
    order = np.argsort(feature, kind="stable")
    order = order[few[feature[order]]]
    fa, fb = order[left[order]], order[~left[order]]
    begin_b, flat = np.cumsum(np.where(few, in_b, 0)) - np.where(few, in_b, 0), out.reshape(-1)
    ends = np.cumsum(in_b[feature[fa]])
    at = 0
    while at < len(fa):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        f = feature[fa[at:to]]
        n = in_b[f]
        place = np.repeat(begin_b[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(flat, np.repeat(owner[fa[at:to]], n) * n_b + owner[fb[place]] - n_a, np.float32(1))
        at = to
    return (pivot_n - lost[:n_a, None] - lost[None, n_a:]).astype(np.int32) + out.astype(np.int32)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same rows as this square symmetric matrix of links does, one less than rows for each component."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            front += new.tolist()
    return out


def tile_links(sides: tuple[list[tuple], list[tuple]], pivot_n: int, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of a tile, enough to connect what is linked. Members are (set, n, common, lacks, adds); one side only: within it."""
    a, b = sides
    b = b or a
    n_a, n_b = np.array([r[1] for r in a]), np.array([r[1] for r in b])
    common = overlaps([r[1:] for r in a], [r[1:] for r in b], pivot_n)
    linked = 100 * common >= percent * (n_a[:, None] + n_b[None, :] - common)
    if a is b:
        np.fill_diagonal(linked, False)
        return [(a[i][0], a[j][0]) for i, j in spanning(linked)]
    both = np.zeros((len(a) + len(b),) * 2, bool)
    both[:len(a), len(a):], both[len(a):, :len(a)] = linked, linked.T
    rows = a + b
    return [(rows[i][0], rows[j][0]) for i, j in spanning(both)]


def links_of(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of each family, enough to connect what is linked; the pivot is the one with an empty difference."""
    linked = F.col("common") * 100 >= (F.col("n") + F.col("pivot_n") - F.col("common")) * percent
    distance = 1 - F.col("common") / (F.col("n") + F.col("pivot_n") - F.col("common"))
    rows = members.withColumn("outer", (~linked).cast("int"))
    sizes = keep(rows.groupBy("family").agg(F.count("*").alias("m"), F.max("outer").alias("any_outer")).filter("any_outer = 1").select("family", "m"))
    ring = F.when(F.col("m") > BLOCK, F.floor(distance * RING).cast("int")).otherwise(0)
    rows = keep(rows.join(sizes, "family").withColumn("ring", ring).withColumn("outer", F.when(F.col("m") > BLOCK, F.col("outer")).otherwise(1)).drop("m"))
    size = F.sum(F.octet_length("lacks") / 4 + F.octet_length("adds") / 8)
    counts = keep(rows.groupBy("family", "outer", "ring").agg(F.ceil(F.greatest(F.count("*") / BLOCK, size / ENTRIES)).cast("int").alias("parts")))
    blocks = counts.select("family", "outer", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    this, that = blocks.select("family", *[F.col(c).alias(f"{c}_a") for c in ("outer", "ring", "part")]), blocks.select("family", *[F.col(c).alias(f"{c}_b") for c in ("outer", "ring", "part")])
    ordered = (F.col("outer_b") == 0) | (F.struct("ring_a", "part_a") <= F.struct("ring_b", "part_b"))
    near = F.abs(F.col("ring_a") - F.col("ring_b")) <= RING * (100 - percent) // 100 + 1
    tiles = this.join(that, "family").filter((F.col("outer_a") == 1) & ordered & near)
    names = [f"{c}_{s}" for s in "ab" for c in ("outer", "ring", "part")]
    one = tiles.select("family", *names, F.lit(0).alias("side"), F.col("outer_a").alias("outer"), F.col("ring_a").alias("ring"), F.col("part_a").alias("part"))
    two = tiles.filter("outer_a <> outer_b OR ring_a <> ring_b OR part_a <> part_b").select(
        "family", *names, F.lit(1).alias("side"), F.col("outer_b").alias("outer"), F.col("ring_b").alias("ring"), F.col("part_b").alias("part"))
    places = keep(one.unionByName(two))
    placed = rows.join(counts, ["family", "outer", "ring"]).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")).drop("parts")
    dealt = placed.join(places, ["family", "outer", "ring", "part"]).select("family", *names, "side", "set", "n", "pivot_n", "common", "lacks", "adds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, pivot_n, out = None, ([], []), 0, []

        def done():
            if at is not None and (len(sides[0]) > 1 or sides[1]):
                out.extend(tile_links(sides, pivot_n, percent))

        for batch in batches:
            for r in batch.to_pylist():
                tile = (r["family"], *[r[c] for c in names])
                if tile != at:
                    done()
                    at, sides, pivot_n = tile, ([], []), r["pivot_n"]
                sides[r["side"]].append((r["set"], r["n"], r["common"], r["lacks"], r["adds"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])
                out = []
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: tiles are small to read and long to work on
    return dealt.repartition(tasks, "family", *names).sortWithinPartitions("family", *names, "side", "set").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, n: int = 4, percent: int = 85, steered: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, and set, component (hashes; NULL for an empty set), text_hash of every row.

    Two rows link when the Jaccard similarity of their sets is ``percent`` hundredths or more; ``component_id`` is the smallest doc_id
    that links reach, the row's own if its set is empty. ``steered`` keeps n-grams that are frequent in a sample out of the index
    where it can, which changes no result; it pays at lower similarities, where parts hold few hashes.
    """
    rows = keep(sets_of(docs, n))
    sets = keep(rows.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("text_hash").alias("text_hash")))
    hub = F.min("set").over(Window.partitionBy("key"))
    stars = entries(docs, n, percent, frequent_ngrams(docs, n) if steered else None).withColumn("hub", hub).filter("`set` <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    families = keep(components(stars).withColumnRenamed("key", "set").withColumnRenamed("root", "family"))
    members = keep(families.join(sets, "set"))
    pivots = keep(members.groupBy("family").agg(F.count("*").alias("m"), F.max(F.struct("copies", (-F.col("set")).alias("s"))).alias("p"))
                 .select("family", F.ceil(F.col("m") / 1024).cast("int").alias("salts"), (-F.col("p.s")).alias("pivot")))
    known = members.join(pivots, "family")
    picked = known.withColumn("salt", F.explode(F.when(F.col("set") == F.col("pivot"), F.sequence(F.lit(-1), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("set"), F.col("salts")).cast("int")))))
    # the pivot is the first row of every salt, and a member of the first
    picked = picked.withColumn("member", ((F.col("set") != F.col("pivot")) | (F.col("salt") == -1)).cast("int")).withColumn("salt", F.greatest("salt", F.lit(0)))
    wanted = keep(picked.select("text_hash", "family", "salt", "member", "set"))
    # one text of each set, whatever its doc_ids: copies are given up before a join could bring them together
    texts = different_texts(docs).join(wanted.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    texts = texts.join(wanted, "text_hash").select("family", "salt", "member", "set", "text")
    diff = keep(differences(texts, n).dropDuplicates(["set"]))
    direct = (diff.filter((F.col("common") * 100 >= (F.col("n") + F.col("pivot_n") - F.col("common")) * percent))
              .join(pivots, "family").select(F.col("set").alias("a"), F.col("pivot").alias("b")))
    found = components(direct.unionByName(links_of(diff, percent))).withColumnRenamed("key", "set").withColumnRenamed("root", "component")
    grouped = keep(sets.join(keep(found), "set", "left").withColumn("component", F.coalesce("component", "set")))
    ids = keep(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = keep(grouped.join(ids, "component").select("set", "component", "component_id"))
    return rows.join(named, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set", "component", "text_hash")
