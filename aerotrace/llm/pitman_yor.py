"""Language model scores by a hierarchical Pitman-Yor process over words.

A context restaurant for each word seats the words that follow it; all share one parent, the root restaurant, whose customers are
the tables of the contexts, and whose own parent is uniform over the vocabulary and one unknown word. Seating is sampled by Gibbs: a customer leaves a table, drawn by size, and sits down at a
table in proportion to its size less the discount, or opens one in proportion to ``(strength + discount * tables) * parent's probability``. Each sweep moves every customer of each
dish of each restaurant. Dishes are sampled side by side against the table counts of the sweep before, contexts against the root's
latest probabilities. Customers of a dish move one by one, beyond ``ALONE`` customers in parties of up to ``PARTY``, which leave together and are seated again by their joint probability given those who stay.
Predictive probabilities are averaged over the sweeps after the first.

Every training document is counted. Text is read once, in blocks of about ``BLOCK_BYTES`` of whole documents, each kept as a file of word numbers in the shared folder. Four exchanges go between blocks and
buckets, as compressed arrays, one row for a block and a bucket: words to numbers and counts; distinct pairs of neighbours to their seating; tables to the root; the root's
shares back to blocks. A word or pair appears once a block however often it is written, so copies and frequent words weigh no more than others; a context with more pairs than half a bucket is
dealt over several by the following word, and its table counts are summed in the root's exchange. Buckets grow in number with the words seen.

Words are known by 64-bit hashes, pairs by the numbers of their words.

Edge cases: NULL and empty texts hold the end alone; a NULL doc_id is training text; repeated rows are all counted and scored; an empty table gives no rows; other columns are ignored; a very long text is a block of its own;
without training text every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.llm.common import bytes_of, keep, open_fs, shared_folder, slices
from aerotrace.llm.word_hash import mix, words

BLOCK_BYTES = 16 << 20
WORDS_A_BUCKET, TOKENS_A_BUCKET = 1 << 21, 3 << 19
ALONE, PARTY = 64, 512  # customers of a dish who move one by one, and those of a larger dish who move at once
END = np.uint64(0x5851F42D4C957F2D)
SCALE = 256.0  # steps of a probability's binary logarithm on its way to the seating
ROW = "block long, kind int, bucket int, name string, a binary, b binary, c binary"
DOC, WORD, PAIR, ROOT, TABLES, CONTEXTS, TOTALS = range(7)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(x: np.ndarray) -> bytes:
    """The array's bytes, those of equal weight together, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in ROW.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], names=names)


# ---- blocks ---------------------------------------------------------------------------------


def _blocks(docs: DataFrame, held_out, folder: str) -> DataFrame:
    """Writes the word numbers of each block to a file; one DOC row a block (ids, flags, lengths) and one WORD row (hashes, training counts)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, seq = TaskContext.get(), 0
        fs, path = open_fs(folder)
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                w = words(*bytes_of(batch.column("text")))
                n = batch.num_rows
                lens = np.bincount(w.row, minlength=n) + 1
                tokens = np.full(len(w.hash) + n, END)
                tokens[np.arange(len(w.hash)) + w.row] = w.hash
                known, codes = np.unique(tokens, return_inverse=True)
                held = np.asarray(batch.column("held").to_pylist(), bool)
                counts = np.bincount(codes[np.repeat(~held, lens)], minlength=len(known))
                name, block = f"{ctx.partitionId()}-{seq}-{ctx.taskAttemptId()}", ctx.partitionId() << 32 | seq
                with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(pack(codes.astype("<u4")))
                ids = batch.column("doc_id")
                null = np.asarray(ids.is_null().to_pylist(), bool)
                yield _rows([(block, DOC, None, name, pack(np.asarray(ids.fill_null(0), np.int64)), pack((held + 2 * null).astype(np.uint8)), pack(lens.astype(np.int64))),
                             (block, WORD, None, None, pack(np.diff(known, prepend=np.uint64(0))), pack(counts.astype(np.int64)), None)]).to_batches()[0]
                seq += 1

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held"))
    return keep(d.mapInArrow(read, ROW))


def _numbered(blocks: DataFrame, buckets: int) -> DataFrame:
    """WORD rows with the numbers and training counts of a block's words that fall in a bucket, and one TOTALS row a bucket."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known, counts = np.cumsum(unpack(row["a"], np.uint64), dtype=np.uint64), unpack(row["b"], np.int64)
                at = [0, *np.searchsorted(known, edges).tolist(), len(known)]
                yield _rows([(row["block"], WORD, b, None, pack(np.diff(known[i:j], prepend=np.uint64(0))), pack(counts[i:j]), None)
                             for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]).to_batches()[0]

    def number(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        parts = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        known, where = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.zeros(len(known), np.int64)
        np.add.at(count, where, np.concatenate([unpack(r["b"], np.int64) for r in rows]))
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -count))] = np.arange(len(known))  # frequent words get small numbers
        ids = rank * buckets + bucket
        if len(ids) and ids.max() >= 1 << 32:
            raise ValueError("more words than 32-bit numbers")
        out, at = [], 0
        for r, p in zip(rows, parts, strict=True):
            k = where[at:at + len(p)]
            out.append((r["block"], WORD, bucket, None, pack(ids[k].astype("<u4")), pack(count[k]), None))
            at += len(p)
        return _rows([*out, (None, TOTALS, bucket, None, pack(np.array([count.sum(), (count > 0).sum()])), None, None)])

    return keep(blocks.filter(F.col("kind") == WORD).mapInArrow(deal, ROW).groupBy("bucket").applyInArrow(number, ROW))


class _Block:
    """A block's tokens with the numbers and counts of their words, and its distinct pairs in the order of their buckets."""

    def __init__(self, rows: list[dict], folder: str, total: int, buckets: int):
        of = lambda kind: sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"] or 0)
        doc, held = of(DOC)[0], of(WORD)
        self.doc_id, flags, self.lens = unpack(doc["a"], np.int64), unpack(doc["b"], np.uint8), unpack(doc["c"], np.int64)
        self.held, self.null = (flags & 1) > 0, flags > 1
        self.ids, self.counts = (np.concatenate([unpack(r[c], k) for r in held]) for c, k in (("a", "<u4"), ("b", np.int64)))
        fs, path = open_fs(folder)
        with fs.open_input_file(f"{path}/{doc['name']}") as f:
            self.codes = unpack(f.read(), "<u4")
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[:1] = self.codes[-1:]  # a block ends with an end, as each document before another does
        self.before = before
        pairs, self.pair = np.unique(before.astype(np.uint64) << np.uint64(32) | self.codes, return_inverse=True)
        self.u, self.w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # a context with many pairs goes to several buckets, by the word that follows
        self.parts = np.maximum(1, -(-self.counts[self.u] * 2 * buckets // max(1, total)))
        m = lambda x: mix(self.ids[x].astype(np.uint64) + np.uint64(1))
        bucket = ((m(self.u) % np.uint64(1 << 30)).astype(np.int64) + (m(self.w) % np.uint64(1 << 30)).astype(np.int64) % self.parts) % buckets
        self.order = np.lexsort((self.ids[self.w], self.ids[self.u], bucket))
        self.bucket = bucket[self.order]


# ---- seating --------------------------------------------------------------------------------


def seat(count: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, discount: float, strength: float, sweeps: int, rng: np.random.Generator, share: np.ndarray | None = None,
         tables: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish: their mean over the sweeps after the first, and those of the last sweep.

    ``count`` customers eat each dish of a ``restaurant`` (numbers from 0), ``parent`` is the dish's probability above. ``share`` tells of how many equal parts of the
    restaurant these dishes are one; ``tables`` fixes the number of all tables instead. A dish begins with one table.
    """
    t = (count > 0).astype(np.int64)
    n = int(restaurant.max()) + 1 if len(restaurant) else 0
    share = np.ones(n) if share is None else share
    classes, low = [], 2
    while low <= ALONE:  # dishes of about as many customers together; no dish has more tables than customers
        high = min(2 * low - 1, ALONE)
        classes.append(np.flatnonzero((count >= low) & (count <= high)))
        low = high + 1
    groups = []
    for at in classes:
        if len(at):
            s = np.zeros((len(at), int(count[at].max())), np.int64)
            s[:, 0] = count[at]
            groups.append((at, s))
    large = np.flatnonzero(count > ALONE)
    large = large[np.argsort(count[large], kind="stable")]
    seats = [np.array([c], np.int64) for c in count[large].tolist()]
    mean = np.zeros(len(count))
    for sweep in range(sweeps):
        all_tables = np.full(n, float(tables)) if tables is not None else np.bincount(restaurant, t, n) * share
        for at, s in groups:
            c = count[at]
            opening = (strength + discount * all_tables[restaurant[at]]) * parent[at]
            line = np.arange(len(at))
            for move in range(int(c.max())):
                if move >= c.min():
                    live = np.flatnonzero(c > move)
                    s[live] = _moved(s[live], c[live], opening[live], discount, rng, line[:len(live)])
                else:
                    _moved(s, c, opening, discount, rng, line)
            t[at] = (s > 0).sum(1)
        for i in range(0, len(large), 256):
            at = large[i:i + 256]
            fresh = _fresh((strength + discount * all_tables[restaurant[at]]) * parent[at], discount, int(min(PARTY, count[at].max())))
            for j, f in enumerate(fresh, i):
                seats[j] = _reseated(seats[j], f, discount, rng)
                t[large[j]] = len(seats[j])
        if sweep or sweeps == 1:
            mean += t
    return mean / max(1, sweeps - 1), t


def _moved(s: np.ndarray, c: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator, line: np.ndarray) -> np.ndarray:
    """One customer of each row leaves its table and sits down again."""
    leave = np.minimum((s.cumsum(1) <= (rng.random(len(s)) * c)[:, None]).sum(1), s.shape[1] - 1)
    s[line, leave] -= 1
    weight = np.where(s > 0, s - discount, 0.0).cumsum(1)
    draw = rng.random(len(s)) * (weight[:, -1] + opening)
    old = np.minimum((weight <= draw[:, None]).sum(1), s.shape[1] - 1)
    s[line, np.where(draw >= weight[:, -1], (s > 0).argmin(1), old)] += 1
    return s


def _tail(discount: float, n: int) -> np.ndarray:
    """Weight, over ``(k - 1)!``, of ``k`` = 1 .. ``n`` customers at one new table."""
    k = np.arange(1, n)
    return np.cumprod(np.concatenate(([1.0], (k - discount) / k)))


def _fresh(opening: np.ndarray, discount: float, n: int) -> np.ndarray:
    """Logarithms of the weight, over ``m!``, of all seatings of ``m`` = 0 .. ``n`` customers at new tables only, a row for each opening weight.

    They are the coefficients of ``exp(opening * (1 - (1 - z) ** discount) / discount)``, which follow from each other by sums of positive terms.
    """
    opening = np.maximum(opening, 1e-280)
    scale = np.maximum(1.0, opening / 128)  # keeps the terms within the range of doubles
    tail = _tail(discount, n) * scale[:, None] ** -np.arange(n)
    g = np.ones((len(opening), n + 1))
    for m in range(1, n + 1):
        g[:, m] = opening / scale / m * np.einsum("ij,ij->i", tail[:, :m], g[:, m - 1::-1])
    return np.log(g) + np.log(scale)[:, None] * np.arange(n + 1)


def _drawn(log_weight: np.ndarray, rng: np.random.Generator) -> int:
    w = np.exp(log_weight - log_weight.max()).cumsum()
    return int(min(np.searchsorted(w, rng.random() * w[-1], "right"), len(w) - 1))


def _reseated(s: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes of a dish's tables after each of its customers has moved once, in parties; ``fresh`` tells the weights of a party's new tables."""
    waiting, left = s, int(s.sum())
    tail, steps = np.log(_tail(discount, len(fresh) - 1)), np.arange(len(fresh) - 1)
    while left:
        n = min(len(fresh) - 1, left)
        up = rng.multivariate_hypergeometric(waiting, n, method="marginals") if len(s) > 1 else np.array([n])
        s, waiting, left = s - up, waiting - up, left - n
        s, waiting = s[s > 0], waiting[s > 0]
        m = n
        if len(s):  # those who stay seated draw n - m of the party to their tables, the others share new ones
            w = s - discount
            join = np.concatenate(([0.0], np.cumsum(np.log((w.sum() + steps[:n]) / (steps[:n] + 1.0)))))
            m = _drawn(fresh[:n + 1] + join[::-1], rng)
            share = rng.standard_gamma(w)
            s = s + rng.multinomial(n - m, share / share.sum())
        new = []
        while m:
            new.append(_drawn(tail[:m] + fresh[m - 1::-1][:m], rng) + 1)
            m -= new[-1]
        if new:
            s, waiting = np.concatenate((s, new)), np.concatenate((waiting, np.zeros(len(new), np.int64)))
    return s


def _seated(blocks: DataFrame, numbers: DataFrame, root: DataFrame | None, folder: str, total: int, vocabulary: int, buckets: int, word_buckets: int, discount: float, strength: float, sweeps: int,
            seed: int, scalars: tuple[float, float] | None) -> DataFrame:
    """PAIR rows (shares of a block's pairs in a bucket), TABLES rows (tables of the words, for the root) and CONTEXTS rows (tables of the contexts)."""
    def deal(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        b = _Block(rows, folder, total, buckets)
        train = np.repeat(~b.held, b.lens)
        seen = np.bincount(b.pair[train], minlength=len(b.u))
        above = _root_probability(rows, b, scalars, vocabulary) if scalars else (b.counts + 0.5) / (total + 0.5 * (vocabulary + 1))
        level = np.round(-SCALE * np.log2(above))[b.w].astype("<u2")
        u, w, out = b.ids[b.u], b.ids[b.w], []
        at = np.flatnonzero(np.diff(b.bucket, prepend=-1, append=-1)) if len(b.bucket) else [0]
        for i, j in zip(at, at[1:]):
            k = b.order[i:j]
            own, first, runs = np.unique(u[k], return_index=True, return_counts=True)
            out.append((int(rows[0]["block"]), PAIR, int(b.bucket[i]), None, pack(np.stack((np.diff(own, prepend=own.dtype.type(0)), runs.astype("<u4"), b.parts[k][first].astype("<u4"))).reshape(-1)),
                        pack(w[k]), pack(np.stack((np.minimum(seen[k], (1 << 32) - 1).astype("<u4"), level[k].astype("<u4"))).reshape(-1))))
        return _rows(out)

    def sample(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        keys, seen, level, own, parts = [], [], [], [], []
        for r in sorted(rows, key=lambda r: r["block"]):
            du, runs, p = unpack(r["a"], "<u4").reshape(3, -1)
            u = np.cumsum(du, dtype=np.uint64)
            keys.append(np.repeat(u, runs) << np.uint64(32) | unpack(r["b"], "<u4"))
            c, q = unpack(r["c"], "<u4").reshape(2, -1)
            seen.append(c)
            level.append(q)
            own.append(u)
            parts.append(p)
        sizes = [len(k) for k in keys]
        pairs, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, where, np.concatenate(seen).astype(np.int64))
        contexts, restaurant = np.unique(pairs >> np.uint64(32), return_inverse=True)
        share = np.ones(len(contexts))
        share[np.searchsorted(contexts, np.concatenate(own))] = np.concatenate(parts)
        parent = np.exp2(np.concatenate(level)[first].astype(float) / -SCALE)
        mean, last = seat(count, restaurant, parent, discount, strength, sweeps, np.random.default_rng([seed, bucket]), share)
        share_of = (count - discount * mean).astype("<f4")
        out, at = [], 0
        for r, m in zip(sorted(rows, key=lambda r: r["block"]), sizes, strict=True):
            out.append((r["block"], PAIR, bucket, None, pack(share_of[where[at:at + m]]), None, None))
            at += m
        held, k = np.unique(pairs & np.uint64(0xFFFFFFFF), return_inverse=True)
        for kind, ids, t in ((TABLES, held, np.bincount(k, last)), (CONTEXTS, contexts, np.bincount(restaurant, mean))):
            ids, t = ids[t > 0], t[t > 0]
            to = ids.astype(np.int64) % word_buckets
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1)) if len(to) else []
            for i, j in zip(cut, cut[1:]):
                x = order[i:j]
                out.append((None, kind, int(to[x[0]]), None, pack(ids[x].astype("<u4")), pack(t[x].astype(np.float64)), None))
        return _rows(out)

    known = blocks.filter(F.col("kind") == DOC).unionByName(numbers.filter(F.col("kind") == WORD))
    known = known.unionByName(root.filter(F.col("kind") == ROOT)) if root is not None else known
    dealt = known.groupBy("block").applyInArrow(deal, ROW)
    return keep(dealt.groupBy("bucket").applyInArrow(sample, ROW))


def _rooted(seated: DataFrame, numbers: DataFrame, vocabulary: int, discount: float, strength: float, sweeps: int, seed: int) -> DataFrame:
    """ROOT rows: the root's share of each word of a block and the tables of its context; one TOTALS row a bucket (customers, mean tables)."""
    def sample(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, asked = rows[0]["bucket"], [r for r in rows if r["kind"] == WORD]
        ids = [unpack(r["a"], "<u4") for r in asked]
        known = np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.uint32)
        sums = {}
        for kind in (TABLES, CONTEXTS):
            total = np.zeros(len(known))
            for r in rows:
                if r["kind"] == kind:
                    total[np.searchsorted(known, unpack(r["a"], "<u4"))] += unpack(r["b"], np.float64)
            sums[kind] = total
        count = np.round(sums[TABLES]).astype(np.int64)
        mean, _ = seat(count, np.zeros(len(count), np.int64), np.full(len(count), 1.0 / (vocabulary + 1)), discount, strength, sweeps, np.random.default_rng([seed, bucket, 1]), tables=vocabulary)
        out = []
        for r, i in zip(asked, ids, strict=True):
            k = np.searchsorted(known, i)
            out.append((r["block"], ROOT, bucket, None, pack((count - discount * mean)[k].astype("<f4")), pack(sums[CONTEXTS][k].astype("<f4")), None))
        return _rows([*out, (None, TOTALS, bucket, None, pack(np.array([float(count.sum()), mean.sum()])), None, None)])

    rows = numbers.filter(F.col("kind") == WORD).unionByName(seated.filter(F.col("kind").isin(TABLES, CONTEXTS)))
    return keep(rows.groupBy("bucket").applyInArrow(sample, ROW))


def _totals(rows: DataFrame, kind) -> np.ndarray:
    def add(batches):
        total = np.zeros(2)
        for batch in batches:
            for x in batch.column("a").to_pylist():
                total += unpack(x, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]])], ["x", "y"])

    r = rows.filter(F.col("kind") == TOTALS).select("a").mapInArrow(add, "x double, y double").agg(F.sum("x"), F.sum("y")).first()
    return np.array([r[0] or 0.0, r[1] or 0.0])


def _root_probability(rows: list[dict], b: _Block, scalars: tuple[float, float, float, float], vocabulary: int) -> np.ndarray:
    customers, tables, discount, strength = scalars
    share = np.concatenate([unpack(r["a"], "<f4") for r in sorted((r for r in rows if r["kind"] == ROOT), key=lambda r: r["bucket"])]).astype(float)
    return (share + (strength + discount * tables) / (vocabulary + 1)) / (strength + customers)


# ---- scores ---------------------------------------------------------------------------------


def score(docs: DataFrame, held_out, discounts: tuple[float, float] = (0.8, 0.8), strengths: tuple[float, float] = (1.0, 1.0), rounds: int = 1, sweeps: int = 3, seed: int = 12,
          pseudo: float = 0.1) -> DataFrame:
    """Scores of all documents by the model learned from those for which ``held_out`` is false.

    ``discounts`` and ``strengths`` are those of root and contexts. Each of ``rounds`` seats the contexts under the root's probabilities of the round before
    (at first those of all customers at tables of their own) and then the root under the contexts' tables, by ``sweeps`` Gibbs sweeps each. ``pseudo`` is the base score's added count.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "word-blocks")
    blocks = _blocks(docs, held_out, folder)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = blocks.filter(F.col("kind") == WORD).agg(F.sum(F.length("a"))).first()[0]
    if not sizes:
        return spark.createDataFrame([], OUT)
    word_buckets = max(least, -(-int(sizes) // (6 * WORDS_A_BUCKET)))
    numbers = _numbered(blocks, word_buckets)
    total, vocabulary = (int(x) for x in _totals(numbers, np.int64))
    buckets = max(least, -(-total // TOKENS_A_BUCKET))
    root = scalars = None
    for k in range(rounds):
        seated = _seated(blocks, numbers, root, folder, total, vocabulary, buckets, word_buckets, discounts[1], strengths[1], sweeps, seed + k, scalars)
        root = _rooted(seated, numbers, vocabulary, discounts[0], strengths[0], sweeps, seed + k)
        scalars = (*_totals(root, np.float64).tolist(), discounts[0], strengths[0])

    def scored(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        b = _Block(rows, folder, total, buckets)
        share = np.empty(len(b.u))
        share[b.order] = np.concatenate([unpack(r["a"], "<f4") for r in sorted((r for r in rows if r["kind"] == PAIR), key=lambda r: r["bucket"])])
        above = _root_probability(rows, b, scalars, vocabulary)
        tables = np.concatenate([unpack(r["b"], "<f4") for r in sorted((r for r in rows if r["kind"] == ROOT), key=lambda r: r["bucket"])]).astype(float)
        p = (share + (strengths[1] + discounts[1] * tables[b.u]) * above[b.w]) / (strengths[1] + b.counts[b.u])
        base = np.log10((b.counts + pseudo) / (total + pseudo * (vocabulary + 1)))
        start = np.cumsum(b.lens) - b.lens
        sums = lambda x: np.add.reduceat(x, start)
        return pa.table([pa.array(b.doc_id, mask=b.null), pa.array(b.held), pa.array(b.lens), pa.array(sums((b.counts > 0).astype(np.int64)[b.codes])), pa.array(np.full(len(b.lens), total)),
                         pa.array(sums(base[b.codes])), pa.array(sums(np.log10(p)[b.pair]))], names=[c.split()[0] for c in OUT.split(", ")])

    rows = blocks.filter(F.col("kind") == DOC).unionByName(numbers.filter(F.col("kind") == WORD)).unionByName(root.filter(F.col("kind") == ROOT)).unionByName(seated.filter(F.col("kind") == PAIR))
    return rows.groupBy("block").applyInArrow(scored, OUT)
