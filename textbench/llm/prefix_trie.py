"""Prefix trie of conversations over minimal-perfect-hash node tables (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.flat import mix
from textbench.llm.shared import bounded, rows_of, spread_join, staged

#: Rows of one conversation (or conversations of one node) that are ordered in one piece; longer ones are ordered in pieces.
PIECE = 1 << 16
#: A shard closes once it has so many rows.
SHARD = 1 << 18
#: The root's digest.
_ROOT = (0, 0)


class Slots:
    """A minimal perfect hash of 128-bit digests: each distinct one has a slot from 0 to size - 1, and slots hold their digest.

    Level by level, digests that share no bit of a bitmap with another take it, the others go on to the next level; a slot is the
    number of bits before its own. Every look-up is verified against the digest in its slot.
    """

    def __init__(self, g: np.ndarray):
        """g: (n, 2), uint64, repeats allowed."""
        order = np.lexsort((g[:, 1], g[:, 0]))
        g = g[order]
        left = g[np.r_[True, (g[1:] != g[:-1]).any(1)]] if len(g) else g
        self.levels, self.size = [], len(left)
        self.digests = np.zeros((len(left), 2), np.uint64)
        before = 0
        while len(left):
            n = 2 * len(left) + 1
            at = self._place(left, len(self.levels), n)
            hits = np.bincount(at, minlength=n)
            alone = hits == 1
            rank = before + np.cumsum(alone) - alone
            self.levels.append((n, alone, rank))
            own = alone[at]
            self.digests[rank[at[own]]] = left[own]
            before, left = before + int(alone.sum()), left[~own]

    @staticmethod
    def _place(g: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(g[:, 0] ^ mix(g[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))) % np.uint64(n)).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        out, left = np.full(len(g), -1, np.int64), np.arange(len(g))
        for level, (n, alone, rank) in enumerate(self.levels):
            at = self._place(g[left], level, n)
            own = alone[at]
            out[left[own]] = rank[at[own]]
            left = left[~own]
        if (out < 0).any() or (self.digests[out] != g).any():
            raise ValueError("a digest that has no slot")
        return out


def accumulate(piece: np.ndarray, depth: np.ndarray, g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, sums): for each node of a shard, the sums of `own` (rows, columns) over its rows and those below it.

    The rows of a piece come deepest first and hang each on the next one. Counts are scattered into arrays by slot, and, from the
    deepest level up, added to the slots of the parents.
    """
    slots = Slots(g)
    slot = slots.find(g)
    sums = np.zeros((slots.size, own.shape[1]), np.int64)
    np.add.at(sums, slot, own)
    parent, level = np.full(slots.size, -1, np.int64), np.zeros(slots.size, np.int64)
    inner = np.flatnonzero(piece[1:] == piece[:-1])
    parent[slot[inner]] = slot[inner + 1]
    level[slot] = depth
    if (level[slot] != depth).any() or (parent[slot[inner]] != slot[inner + 1]).any():
        raise ValueError("two prefixes share a digest")
    order = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.diff(level[order], prepend=-1, append=-1))
    for lo, hi in zip(edges, edges[1:]):
        at = order[lo:hi]
        at = at[parent[at] >= 0]
        np.add.at(sums, parent[at], sums[at])
    return slots.digests, sums


def _numbered(rows: DataFrame, key: list[str], order: list[str], counts: DataFrame, piece: int) -> DataFrame:
    """`rows` with i, their number from 1 in the order of `order` among those that agree in `key`. counts (staged): key and m.

    Keys of more than `piece` rows are numbered over ranges of (key, order), whose sizes alone meet in one place.
    """
    found = staged(counts.filter(F.col("m") > piece).select(*key))
    long = bounded(found)
    own = Window.partitionBy(*key).orderBy(*order)
    short = rows.join(long, key, "left_anti").withColumn("i", F.row_number().over(own).cast("long"))
    if not rows_of(found):
        return short
    many = rows.join(long, key, "left_semi").withColumn("tie__", F.monotonically_increasing_id())
    many = many.repartitionByRange(*key, *order, "tie__").sortWithinPartitions(*key, *order, "tie__").drop("tie__")
    many = staged(many.withColumn("id__", F.monotonically_increasing_id())).withColumn("part__", F.shiftrightunsigned("id__", 33))
    before = Window.partitionBy(*key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    bases = many.groupBy(*key, "part__").agg(F.count("*").alias("m__")).withColumn("base__", F.coalesce(F.sum("m__").over(before), F.lit(0))).drop("m__")
    at = F.row_number().over(Window.partitionBy(*key, "part__").orderBy("id__"))
    many = many.withColumn("at__", at).join(bases, [*key, "part__"]).withColumn("i", F.col("at__") + F.col("base__"))
    return short.unionByName(many.select(*short.columns))


def rebuilt(conversations: DataFrame, prefix: Column | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): turns (c, depth, size, x1, x2, bytes) of the rebuilt conversations, and convs (c, size), staged.

    A conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own turns after its first h; h is
    `prefix`, a column of c, by default crc32 of its decimal text, modulo 9. x1 and x2 are halves of a digest of role and text,
    which stand for them from here on; turns of equal number go by their role and this digest.
    """
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(9)) if prefix is None else prefix
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    x = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda lo: F.conv(F.substring("x", lo, 16), 16, -10).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), x.alias("x"), F.octet_length(text).cast("long").alias("bytes")).filter("c IS NOT NULL")
    rows = rows.select("c", F.col("turn").isNotNull().alias("told"), "turn", "role", "x", "bytes")
    counts = staged(rows.groupBy("c").agg(F.count("*").alias("m")))
    rows = _numbered(rows, ["c"], ["told", "turn", "role", "x"], counts, piece)
    rows = staged(rows.select("c", "i", half(1).alias("x1"), half(17).alias("x2"), "bytes"))
    convs = counts.select("c", "m", h.cast("long").alias("h"), (F.col("c") - F.col("c") % 5).alias("b"))
    convs = convs.join(counts.select(F.col("c").alias("b"), F.col("m").alias("n")), "b", "left")
    convs = convs.withColumn("lead", F.least("h", F.coalesce("n", F.lit(0))))
    convs = staged(convs.select("c", "b", "h", "lead", "m", (F.col("lead") + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("size")))
    own = spread_join(rows, convs.select("c", "h", "lead", "size"), convs.select("c", "m"), ["c"], ["i"]).filter("i > h").withColumn("depth", F.col("i") - F.col("h") + F.col("lead"))
    first = rows.filter("i <= 8 AND c % 5 = 0" if prefix is None else "c % 5 = 0").withColumnRenamed("c", "b").join(convs.select("c", "b", "h", "size"), "b").filter("i <= h").withColumn("depth", F.col("i"))
    columns = ["c", "depth", "size", "x1", "x2", "bytes"]
    return own.select(*columns).unionByName(first.select(*columns)), convs.select("c", "size")


def _digested(turns: DataFrame, piece: int) -> DataFrame:
    """`turns` with g1, g2, the digest of their prefix, and p1, p2, that of the prefix one turn shorter (the root's: 0).

    A turn and its place are hashed twice, and a prefix's digest is the XOR of these, so pieces of a long conversation are taken
    apart and joined again by the digests of whole pieces.
    """
    rows = turns.withColumns({f"v{j}": F.xxhash64(F.lit(j), "x1", "x2", "depth") for j in (1, 2)}).withColumn("piece", F.floor(F.col("depth") / piece))
    rows = staged(rows.drop("x1", "x2"))
    own = Window.partitionBy("c", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"g{j}": F.bit_xor(f"v{j}").over(own) for j in (1, 2)})
    long = rows.filter(F.col("size") >= piece)
    if not long.isEmpty():
        whole = long.groupBy("c", "piece").agg(F.bit_xor("v1").alias("w1"), F.bit_xor("v2").alias("w2"))
        before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        whole = whole.select("c", "piece", *[F.coalesce(F.bit_xor(f"w{j}").over(before), F.lit(0)).alias(f"w{j}") for j in (1, 2)])
        out = out.join(whole, ["c", "piece"], "left").withColumns({f"g{j}": F.col(f"g{j}").bitwiseXOR(F.coalesce(f"w{j}", F.lit(0))) for j in (1, 2)})
    last = lambda j: F.col(f"g{j}").bitwiseXOR(F.col(f"v{j}"))
    return out.select("c", "depth", "size", "piece", "bytes", "g1", "g2", last(1).alias("p1"), last(2).alias("p2"))


def _below(turns: DataFrame, nodes: DataFrame, piece: int, shard: int) -> DataFrame:
    """(g1, g2, n_leaves, saved): sums over the subtrees of all nodes but the root, and the root's by its children.

    What a node adds is put on the turn of its smallest member alone, so every shard, any set of conversations, sums up its own
    part of each subtree, and the parts are added. Long conversations are cut into pieces; what the deeper pieces add is put on
    the deepest turn of a piece.
    """
    own = nodes.filter("depth > 0").select(F.col("conv_id").alias("c"), "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    rows = turns.select("c", "depth", "size", "piece", "g1", "g2").join(own, ["c", "depth"], "left").fillna(0, ["leaf", "saved"])
    rows = staged(rows)
    long = rows.filter(F.col("size") >= piece)
    if not long.isEmpty():
        deeper = Window.partitionBy("c").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
        whole = long.groupBy("c", "piece").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.max("depth").alias("depth"))
        more = whole.select("c", "depth", *[F.coalesce(F.sum(n).over(deeper), F.lit(0)).alias(f"more_{n}") for n in ("leaf", "saved")])
        rows = rows.join(more, ["c", "depth"], "left").withColumns({n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in ("leaf", "saved")})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told(rows_: np.ndarray) -> pa.RecordBatch:
            part = np.cumsum(np.r_[True, (rows_[1:, :2] != rows_[:-1, :2]).any(1)]) if len(rows_) else np.zeros(0, np.int64)
            g, out = accumulate(part, rows_[:, 2], rows_[:, 3:5].view(np.uint64), rows_[:, 5:7])
            some = out.any(1)
            g, out = g[some].view(np.int64), out[some]
            return pa.record_batch([pa.array(x) for x in (g[:, 0], g[:, 1], out[:, 0], out[:, 1])], ["g1", "g2", "n_leaves", "saved"])

        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy() for i in range(7)]))
            if sum(map(len, held)) >= shard:
                rows_ = np.concatenate(held)
                new = np.flatnonzero((rows_[1:, :2] != rows_[:-1, :2]).any(1)) + 1  # the last piece may go on in the next batch
                cut = int(new[-1]) if len(new) else 0
                if cut:
                    yield told(rows_[:cut])
                held = [rows_[cut:]]
        if held:
            yield told(np.concatenate(held))

    dealt = rows.select("c", "piece", "depth", "g1", "g2", "leaf", "saved").repartition("c", "piece").sortWithinPartitions("c", "piece", F.desc("depth"))
    return dealt.mapInArrow(sums, "g1 long, g2 long, n_leaves long, saved long").groupBy("g1", "g2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _ends(ends: DataFrame, piece: int) -> DataFrame:
    """(g1, g2, ends_sha256) of the conversations `ends` (g1, g2, c) by node. The numbers of a node with more than `piece` of them are
    joined in pieces, which one task reads in order, hashing as it goes."""
    counts = staged(ends.groupBy("g1", "g2").agg(F.count("*").alias("m")))
    listed = lambda df, *key: df.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("s"))
    found = staged(counts.filter(F.col("m") > piece).select("g1", "g2"))
    long = bounded(found)
    out = listed(ends.join(long, ["g1", "g2"], "left_anti"), "g1", "g2").select("g1", "g2", F.sha2("s", 256).alias("ends_sha256"))
    if not rows_of(found):
        return out
    many = ends.join(long, ["g1", "g2"], "left_semi")
    many = _numbered(many, ["g1", "g2"], ["c"], counts, piece).withColumn("part", F.floor((F.col("i") - 1) / piece))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done = lambda: pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["g1", "g2", "ends_sha256"])
        for batch in batches:
            for g1, g2, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (g1, g2) != key:
                    if key is not None:
                        yield done()
                    key, state = (g1, g2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(s.as_py().encode())
        if key is not None:
            yield done()

    parts = listed(many, "g1", "g2", "part").repartition("g1", "g2").sortWithinPartitions("g1", "g2", "part").select("g1", "g2", "s")
    return out.unionByName(parts.mapInArrow(hashed, "g1 long, g2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, prefix: Column | None = None, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see rebuilt()): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, bytes of a
    node's last text times members less one) and ends_sha256 (of the members that end there, ascending, comma-joined).

    1. Turns become digests, numbered and rebuilt by joins. 2. A prefix's digest is the XOR of its turns' and places' hashes;
    equal digests meet in a partial aggregate, which counts the members and finds the smallest, and a node's depth and parent must
    agree in all of them or the job fails. 3. Conversations are dealt into shards of about `shard` rows; each assigns its prefixes
    verified slots of a minimal perfect hash, scatters what its nodes add into arrays and accumulates it through parent slots in
    depth order (accumulate()); a shard's part of a subtree is added to the others'. No step gathers a node's members, however
    many, and conversations of more than `piece` turns are worked on in pieces.

    Defined cases: rows without a conv_id are left out; null role and text are empty; a null turn comes first, equal turns go by
    role and the MD5 of role and text; repeated rows are turns each; an empty table gives an empty result (no root without a
    member); other columns are left behind.
    """
    turns, convs = rebuilt(conversations, prefix, piece)
    turns = staged(_digested(turns, piece))
    agree = [F.min(F.struct(*c)) == F.max(F.struct(*c)) for c in (["depth", "p1", "p2", "bytes"],)]
    nodes = turns.groupBy("g1", "g2").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.struct("depth", "p1", "p2", "bytes")).alias("own"), agree[0].alias("one"))
    checked = F.when(F.col("one"), F.col("own")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("struct<depth:long,p1:long,p2:long,bytes:long>"))
    nodes = nodes.withColumn("own", checked).select("g1", "g2", "conv_id", "n_convs", "own.depth", "own.p1", "own.p2", "own.bytes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("g1"), zero.alias("g2"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"))
    nodes = staged(nodes.unionByName(root))
    children = staged(nodes.filter("depth > 0").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children")))
    nodes = staged(nodes.join(children, ["g1", "g2"], "left").fillna(0, ["n_children"]))
    sums = staged(_below(turns, nodes, piece, shard))
    top = turns.filter("depth = 1").select("g1", "g2").distinct().join(sums, ["g1", "g2"]).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    sums = sums.unionByName(top.filter("n_leaves IS NOT NULL").select(zero.alias("g1"), zero.alias("g2"), "n_leaves", "saved"))
    ended = turns.filter("depth = size").select("g1", "g2", "c").unionByName(convs.filter("size = 0").select(zero.alias("g1"), zero.alias("g2"), "c"))
    out = nodes.join(sums, ["g1", "g2"], "left").join(_ends(ended, piece), ["g1", "g2"], "left")
    named = nodes.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    kids = children.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("n_children").alias("m"))
    out = spread_join(out.filter("depth > 0"), named, kids, ["p1", "p2"], ["g1", "g2"]).unionByName(out.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    lone = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0))
    return out.select(
        "conv_id",
        F.col("depth").cast("long"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", lone).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
