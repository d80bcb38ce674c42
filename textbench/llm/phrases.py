"""Collocations of two to four words by vertical partitioning of a depth-truncated suffix tree (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.flat import FOLD, mix, slices, words
from textbench.llm.shared import bitmap, in_bitmap, rows_of, spread_join, staged
from textbench.operators.numbering import with_running

DEPTH = 4
#: Bytes that end a piece, and those that words are made of.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
#: A task sends on what it has counted once it holds so many different words or word sequences.
HELD = 1 << 20
_H = [f"h{i}" for i in range(1, DEPTH + 1)]


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a word sequence and one more word."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1))


class _Text:
    """h: the hashes of a slice's words, the language mixed in (never 0, which stands for the end of a sequence); follows[k]: which
    words have a k-th word behind them in their piece."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lang: np.ndarray):
        x = words(buf, off, _WORD, fold=True)
        self.words = x
        self.h = np.maximum(mix(x.h ^ lang[x.doc]), np.uint64(1))
        piece = np.searchsorted(np.union1d(np.flatnonzero(_ENDS[buf]), off), x.starts, "right")
        n = len(piece)
        self.follows = [np.r_[piece[k:] == piece[: n - k], np.zeros(min(k, n), bool)] if k < n else np.zeros(n, bool) for k in range(DEPTH)]

    def behind(self, k: int) -> np.ndarray:
        """The hash of the k-th word behind each word (of any piece)."""
        return np.r_[self.h[k:], np.zeros(min(k, len(self.h)), np.uint64)]


class _Counter:
    """Counts of rows of numbers, told apart by a 64-bit key; holds the different ones until there are HELD of them."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, columns: list[np.ndarray], count: np.ndarray | None = None) -> None:
        key, at, of = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(of, count, len(key)).astype(np.int64)
        self.parts.append((key, [c[at] for c in columns], count))
        self.size += len(key)

    def merged(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            columns = [np.concatenate(c) for c in zip(*(p[1] for p in parts))]
            self.add(np.concatenate([p[0] for p in parts]), columns, np.concatenate([p[2] for p in parts]))

    def told(self, last: bool = False) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """What has been counted, (columns, counts), once there is enough of it."""
        if self.size > 2 * HELD or last:
            self.merged()
        if self.size > HELD or last:
            for _, columns, count in self.parts:
                yield columns, count
            self.parts, self.size = [], 0


def _as_rows(names: list[str]) -> Callable[[list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]]:
    return lambda columns, count: iter([pa.record_batch([*(pa.array(c.view(np.int64)) for c in columns), pa.array(count)], [*names, "c"])])


def _as_blocks(columns: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(g, block): the numbers of each group (the first column) together, as one block of bytes."""
    order = np.argsort(columns[0], kind="stable")
    g, rest = columns[0][order], np.column_stack([*(c.view(np.int64) for c in columns[1:]), count])[order]
    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.zeros(0, np.int64)
    blocks = [rest[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])]
    yield pa.record_batch([pa.array(g[edges[:-1]]), pa.array(blocks, pa.binary())], ["g", "block"])


def _counted(docs: DataFrame, written: Callable[[list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], types: str, each: Callable[[_Text, _Counter], None]) -> DataFrame:
    """What `each` adds to the counter of its task for every slice of the texts, as `written`; counts are partial, by task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            lang = batch.column(1).to_numpy().view(np.uint64)
            for lo, hi, buf, off in slices(batch.column(0)):
                each(_Text(buf, off, lang[lo:hi]), counter)
                for found in counter.told():
                    yield from written(*found)
        for found in counter.told(last=True):
            yield from written(*found)

    return docs.select("text", "lh").mapInArrow(rows, types)


def _words(docs: DataFrame) -> DataFrame:
    """(lang, w, h, f): how often each word occurs in each language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}

        def told() -> pa.RecordBatch:
            lang, w, c = (list(x) for x in zip(*found.values())) if found else ([], [], [])
            h = np.array(list(found), np.uint64).view(np.int64)
            found.clear()
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(w, pa.string()), pa.array(h), pa.array(c, pa.int64())], ["lang", "w", "h", "c"])

        for batch in batches:
            lang, name = batch.column(1).to_numpy().view(np.uint64), batch.column(2)
            for lo, hi, buf, off in slices(batch.column(0)):
                x = _Text(buf, off, lang[lo:hi])
                h, at, n = np.unique(x.h, return_index=True, return_counts=True)
                low = FOLD[buf].tobytes()
                for key, i, c in zip(h.tolist(), at.tolist(), n.tolist()):
                    if key in found:
                        found[key][2] += c
                    else:
                        w = low[x.words.starts[i] : x.words.ends[i]].decode()
                        found[key] = [name[lo + int(x.words.doc[i])].as_py(), w, c]
                if len(found) > HELD // 4:
                    yield told()
        yield told()

    out = docs.select("text", "lh", "lang").mapInArrow(rows, "lang string, w string, h long, c long")
    return out.groupBy("lang", "w", "h").agg(F.sum("c").alias("f"))


def _among(sets: list[np.ndarray], d: int, h: np.ndarray) -> np.ndarray:
    """Which hashes are heavy prefixes of d words."""
    own = sets[d]
    at = np.minimum(np.searchsorted(own, h), max(len(own) - 1, 0))
    return own[at] == h if len(own) else np.zeros(len(h), bool)


class _Prefixes:
    """The vertical partition: which word prefixes there are, and which group each belongs to.

    Prefixes of two words that are frequent are `open`. A prefix that occurs more often than the budget allows is heavy, and is
    split into the prefixes of one more word, down to DEPTH. All others, in the order of their hashes, are dealt into groups of
    a budget each, by running sums of their counts. Only heavy prefixes (of each length fewer than occurrences over budget) and
    the groups' ends (no more than twice that) leave the tasks.
    """

    def __init__(self, docs: DataFrame, frequent: DataFrame, least: int, budget: int):
        spark = docs.sparkSession
        common = spark.sparkContext.broadcast(bitmap(frequent.select("h"), rows_of(frequent), clamp=True))

        def pairs(x: _Text, counter: _Counter) -> None:
            ok = in_bitmap(common.value, x.h)
            at = np.flatnonzero(x.follows[1] & ok & np.r_[ok[1:], np.zeros(min(1, len(ok)), bool)])
            s = _chain(x.h[at], x.behind(1)[at])
            counter.add(s, [s])

        level = _counted(docs, _as_rows(["s"]), "s long, c long", pairs).groupBy("s").agg(F.sum("c").alias("f"))
        level = staged(level.filter(F.col("f") >= least))
        self.open = spark.sparkContext.broadcast(bitmap(level.select(F.col("s").alias("h")), rows_of(level), clamp=True))
        total = level.agg(F.sum("f")).first()[0] or 0
        share = total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.budget = max(min(budget, 1000), min(budget, share))
        self.heavy = [np.zeros(0, np.uint64) for _ in range(DEPTH + 1)]
        done = level.filter(F.col("f") <= self.budget)
        for d in range(2, DEPTH):
            found = level.filter(F.col("f") > self.budget).select("s").collect()
            if not found:
                break
            self.heavy[d] = np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))
            level = staged(self._longer(docs, d).groupBy("s").agg(F.sum("c").alias("f")))
            done = done.unionByName(level.filter(F.col("f") <= self.budget) if d + 1 < DEPTH else level)
        groups = with_running(done.select("s", "f"), "s", F.col("f"), "upto").withColumn("g", F.floor((F.col("upto") - 1) / self.budget))
        ends = groups.groupBy("g").agg(F.min("s").alias("s")).orderBy("s").collect()
        self.ends = np.array([r["s"] for r in ends], np.int64)

    def _longer(self, docs: DataFrame, d: int) -> DataFrame:
        """(s, c): partial counts of the prefixes of d + 1 words that lie behind heavy ones of d words; those of the end too."""
        of = self.suffixes()
        heavy = self.heavy

        def each(x: _Text, counter: _Counter) -> None:
            _, h, _ = of(x)
            s = _chain(h[0], h[1])
            for k in range(2, d):
                s = _chain(s, h[k])
            own = _among(heavy, d, s)
            s = _chain(s[own], h[d][own])
            counter.add(s, [s])

        return _counted(docs, _as_rows(["s"]), "s long, c long", each)

    def suffixes(self) -> Callable[[_Text], tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """A function to (places, word hashes, depth) of the suffixes of a slice that start with an open pair, cut before the first
        pair that is not open; hashes are 0 from there."""
        open_ = self.open

        def of(x: _Text) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
            pair = x.follows[1] & in_bitmap(open_.value, _chain(x.h, x.behind(1)))
            at = np.flatnonzero(pair)
            h, going = [x.h[at], x.behind(1)[at]], np.ones(len(at), bool)
            for k in range(2, DEPTH):
                going &= np.r_[pair[k - 1 :], np.zeros(k - 1, bool)][at]
                h.append(np.where(going, x.behind(k)[at], np.uint64(0)))
            return at, h, 1 + sum((c != 0).astype(np.int32) for c in h[1:])

        return of

    def dealt(self, docs: DataFrame) -> DataFrame:
        """(g, block): the suffixes by the group of their prefix, rows of numbers: the length of the prefix, the suffix and its count,
        which is partial, by task."""
        of, heavy, ends = self.suffixes(), self.heavy, self.ends

        def each(x: _Text, counter: _Counter) -> None:
            _, h, _ = of(x)
            s = _chain(h[0], h[1])
            lead, own = np.full(len(s), 2, np.int64), s.copy()
            for d in range(2, DEPTH):
                more = (lead == d) & _among(heavy, d, own)
                own[more] = _chain(own[more], h[d][more])
                lead[more] = d + 1
                s = _chain(s, h[d])
            g = np.searchsorted(ends, own.view(np.int64), "right") - 1
            counter.add(s, [np.maximum(g, 0), lead, *h])

        return _counted(docs, _as_blocks, "g long, block binary", each)


def _subtrees(dealt: DataFrame, least: int) -> DataFrame:
    """(h1, ..., f): the nodes of depth 2 to DEPTH with their counts. Each group sorts its suffixes, which makes every node of
    its subtrees a run of leaves, and reads the node's count from the totals of its leaves. Nodes above a heavy prefix lie in
    several groups, and their parts are added."""

    def build(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("block").to_pylist()), np.int64).reshape(-1, DEPTH + 2)
        h = [rows[:, i].view(np.uint64) for i in range(1, DEPTH + 1)]
        order = np.lexsort(h[::-1])
        h, lead, c = [x[order] for x in h], rows[order, 0], rows[order, -1]
        out, new = [], np.zeros(len(c), bool)
        new[:1] = True
        for d in range(DEPTH):
            new[1:] |= h[d][1:] != h[d][:-1]
            at = np.flatnonzero(new)
            if d and len(at):
                f = np.add.reduceat(c, at)
                keep = (h[d][at] != 0) & ((f >= least) | (d + 1 < np.maximum.reduceat(lead, at)))
                at = at[keep]
                own = [h[i][at] if i <= d else np.zeros(len(at), np.uint64) for i in range(DEPTH)]
                out.append(pa.table([*(pa.array(x.view(np.int64)) for x in own), pa.array(f[keep])], [*_H, "f"]))
        return pa.concat_tables(out)

    nodes = dealt.groupBy("g").applyInArrow(build, ", ".join(f"{n} long" for n in [*_H, "f"]))
    return nodes.groupBy(*_H).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _key(h: list[Column]) -> Column:
    return F.xxhash64(*[*h, *[F.lit(0).cast("long")] * (DEPTH - len(h))])


def _span(lo: int, hi: int) -> Column:
    return _key([F.col(_H[i]) for i in range(lo, hi)])


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """`phrases` with l, r and score of their lowest-scoring cut; counts: (z, f) of all words and phrases that can be a part."""
    cuts = lambda m: F.array(*[F.struct(F.lit(k).alias("k"), _span(0, k).alias("x"), _span(k, m).alias("y")) for k in range(1, m)])
    which = F.when(F.col("m") == 2, cuts(2))
    for m in range(3, DEPTH + 1):
        which = which.when(F.col("m") == m, cuts(m))
    parts = phrases.select("z", F.explode(which).alias("cut")).select("z", "cut.k", F.explode(F.array(F.struct(F.lit(0).alias("side"), "cut.x"), F.struct(F.lit(1).alias("side"), F.col("cut.y").alias("x")))).alias("p"))
    parts = staged(parts.select(F.col("z").alias("of"), "k", "p.side", F.col("p.x").alias("z")))
    asked = staged(parts.groupBy("z").agg(F.count("*").alias("m")))
    found = spread_join(parts, counts.select("z", "f"), asked, ["z"], ["of", "k"])
    cut = found.groupBy("of", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    cut = cut.join(phrases.select(F.col("z").alias("of"), "f"), "of")
    cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(20, 0)) * cast(f as decimal(18, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"))
    best = cut.groupBy("of").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return phrases.join(best.select(F.col("of").alias("z"), "b.l", "b.r", "b.score"), "z")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int | None = 2000, budget: int = 1 << 20) -> DataFrame:
    """The phrases of two to four words that hold together best in each language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z lower-cased) are cut at `.,;:!?` and line ends, words at blanks and tabs. a, l, r: how often the phrase and the
    two sides of its lowest-scoring cut occur; score: floor(2,000,000 a / (l + r)); n: all words of the language. Phrases that
    occur `least` times count, unless a longer one that holds them occurs `share` percent as often. top: so many of each
    language, by score, a and phrase; None: all.

    1. Words are counted. 2. Word prefixes are partitioned by a budget of occurrences (_Prefixes). 3. Suffixes are dealt to the
    groups of their prefixes, counted by task first, and each group builds its subtrees (_subtrees) on its own, in the memory of
    `budget` suffixes. A word or pair that occurs less than `least` times ends a suffix: no longer phrase can be frequent. The bitmaps
    that tell this are of fixed size and may say too often that a pair is frequent, which costs work and changes nothing. 4.
    Cuts look their sides up by join. 64-bit hashes stand for words.

    Defined cases: null text is empty; a null language is `und`, one with that very name too; repeated rows count each; an empty
    table gives an empty result; other columns are left behind.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).withColumn("lh", F.xxhash64("lang"))
    every = staged(_words(rows))
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = staged(every.filter(F.col("f") >= least))
    nodes = _subtrees(_Prefixes(rows, frequent, least, budget).dealt(rows), least)
    m = sum((F.col(c) != 0).cast("int") for c in _H)
    phrases = staged(nodes.withColumns({"m": m, "z": _key([F.col(c) for c in _H])}))
    counts = frequent.select(_key([F.col("h")]).alias("z"), "f").unionByName(phrases.select("z", "f"))
    inside = [(m, lo, lo + n) for m in range(3, DEPTH + 1) for n in range(2, m) for lo in range(m - n + 1)]
    held = F.array(*[F.when(F.col("m") == m, _span(lo, hi)) for m, lo, hi in inside])
    longer = phrases.filter("m > 2").select("f", F.explode(held).alias("z")).filter("z IS NOT NULL").groupBy("z").agg(F.max("f").alias("longer"))
    kept = phrases.join(longer, "z", "left").filter((100 * F.coalesce("longer", F.lit(0))) < share * F.col("f")).drop("longer")
    kept = staged(_scored(staged(kept), counts))
    spelt = staged(kept.select("z", F.posexplode(F.array(*_H)).alias("i", "h")).filter("h <> 0"))
    named = spread_join(spelt, frequent.select("h", "lang", "w"), staged(spelt.groupBy("h").agg(F.count("*").alias("m"))), ["h"], ["z"])
    named = named.groupBy("z").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]), " ").alias("phrase"))
    out = kept.join(named, "z").select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score", "z")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:
        own = F.row_number().over(Window.partitionBy("lang", F.pmod("z", F.lit(64))).orderBy(*order))
        out = out.withColumn("own", own).filter(F.col("own") <= top).drop("own")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = out if top is None else out.filter(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
