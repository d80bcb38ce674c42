"""Exact Jaccard join of documents by word shingles over a token-group matrix (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.components import components
from textbench.llm.flat import SPACED, Words, mix, slices, words
from textbench.llm.shared import arrow_rows, bitmap, bounded, in_bitmap, keyed, later_copies, rows_of, spread_join, staged

#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
_LAST = (1 << 63) - 1
_CUT = np.uint64(16)
_BANDS = 8
#: Documents that a leader matches to this percentage lie in its group, linked or not.
_NEAR = 50


def least_shared(n):
    """Of a set of n shingles, the fewest that any partner shares."""
    return (n * PERCENT + 99) // 100


def surplus(n):
    """How many shared shingles the prefix is to show beyond the first."""
    return np.maximum(1, n // 12)


def prefix(n):
    """Of n shingles in hash order, so many: two linked sets share surplus() of the smaller one among their prefixes."""
    return n - least_shared(n) + surplus(n)


def shingles(x: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct n-word shingles, ascending; with fewer words, the whole sequence as one."""
    size = np.diff(x.first)
    at = np.flatnonzero(x.valid(n))
    h, d = [x.ngrams(n)[at]], [x.doc[at]]
    for m in np.unique(size[(size > 0) & (size < n)]):
        at = x.first[:-1][size == m]
        h.append(x.ngrams(int(m))[at])
        d.append(x.doc[at])
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(size) + 1))


def _ranks(off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    return np.arange(off[-1]) - np.repeat(off[:-1], n)


def _prefix_hashes(docs: DataFrame, n: int) -> DataFrame:
    """(k, h): the prefix shingles of each document, cut to 48 bits."""

    def rows(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for lo, hi, buf, off in slices(batch.column(0)):
                h, at = shingles(words(buf, off, SPACED, fold=True), n)
                size = np.diff(at)
                own = _ranks(at) < np.repeat(prefix(size), size)
                yield pa.record_batch({"k": np.repeat(keys[lo:hi], size)[own], "h": (h[own] >> _CUT).astype(np.int64)})

    return docs.select("text", "k").mapInArrow(rows, "k long, h long")


def _sets(docs: DataFrame, n: int, bits: np.ndarray | None) -> DataFrame:
    """(k, doc_id, t1, t2, t3, n, set): shingle counts; set, the packed hashes, only of documents that can have a partner.

    docs: text, k, doc_id, t1, t2, t3, skip (a later copy: no set) and hits, the shared prefix shingles, unless a bitmap counts them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        whole = shared.value
        for batch in batches:
            skip = batch.column(6).to_numpy(zero_copy_only=False)
            hits = batch.column(7).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in slices(batch.column(0)):
                h, at = shingles(words(buf, off, SPACED, fold=True), n)
                size = np.diff(at)
                if whole is not None:
                    seen = in_bitmap(whole, (h >> _CUT).astype(np.uint64)) & (_ranks(at) < np.repeat(prefix(size), size))
                    found = np.r_[0, np.cumsum(seen)]
                    found = found[at[1:]] - found[at[:-1]]
                else:
                    found = hits[lo:hi]
                keep = (size > 0) & (found >= surplus(least_shared(size))) & ~skip[lo:hi]
                packed = [h[at[i] : at[i + 1]].tobytes() if keep[i] else None for i in range(hi - lo)]
                own = [batch.column(c).slice(lo, hi - lo) for c in range(1, 6)]
                yield pa.record_batch([*own, pa.array(size, pa.int64()), pa.array(packed, pa.binary())], ["k", "doc_id", "t1", "t2", "t3", "n", "set"])

    return docs.mapInArrow(rows, "k long, doc_id long, t1 long, t2 int, t3 int, n long, set binary")


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(i)
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in column]
    off = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), off


def _members(sets: DataFrame, only_prefix: bool) -> DataFrame:
    """(h, k, n): the shingles of each set, or those of its prefix."""

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                h, off = _unpack(part, 1)
                size = np.diff(off)
                own = _ranks(off) < np.repeat(prefix(size), size) if only_prefix else np.ones(len(h), bool)
                yield pa.record_batch({"h": h[own].view(np.int64), "k": np.repeat(part.column(0).to_numpy(), size)[own], "n": np.repeat(size, size)[own].astype(np.int32)})

    return sets.select("k", "set").mapInArrow(rows, "h long, k long, n int")


def _found(sets: DataFrame, hashes: DataFrame) -> DataFrame:
    """(k, set, n, found): each set with its size and how many of its shingles are among `hashes` (a staged table).

    The shingles are held against a bitmap, or joined with `hashes` if there are too many for one.
    """
    bits = bitmap(hashes, rows_of(hashes))
    if bits is None:
        found = _members(sets, False).select("k", F.shiftrightunsigned("h", 16).alias("h")).join(hashes, "h", "left_semi")
        found = found.groupBy("k").agg(F.count("*").cast("int").alias("found"))
        return sets.select("k", "set", F.floor(F.octet_length("set") / 8).cast("int").alias("n")).join(found, "k")
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                h, off = _unpack(part, 1)
                found = np.r_[0, np.cumsum(in_bitmap(shared.value, (h >> _CUT).astype(np.uint64)))]
                own = {"n": np.diff(off), "found": found[off[1:]] - found[off[:-1]]}
                yield pa.record_batch([*part.columns, *(pa.array(v, pa.int32()) for v in own.values())], ["k", "set", *own])

    return sets.select("k", "set").mapInArrow(rows, "k long, set binary, n int, found int")


def _pruned(sets: DataFrame) -> DataFrame:
    """(k, set, share): one row for each k of the sets of which enough shingles occur in another set too for any link; share is their part."""
    full = _members(sets, False).select(F.shiftrightunsigned("h", 16).alias("h")).groupBy("h").count().filter("count > 1").select("h")
    out = _found(sets, staged(full)).filter(F.col("found") >= _col_least(F.col("n")))
    return out.select("k", "set", (F.col("found") / F.col("n")).alias("share")).dropDuplicates(["k"])


def _bands(sets: DataFrame) -> DataFrame:
    """(k, band, v): minima of each set under a few hash functions."""

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                h, off = _unpack(part, 1)
                for b in range(_BANDS):
                    v = np.minimum.reduceat(mix(h ^ mix(np.full(1, b + 1, np.uint64))), off[:-1]) if len(h) else h
                    yield pa.record_batch({"k": part.column(0), "band": np.full(len(v), b, np.int32), "v": v.view(np.int64)})

    return sets.select("k", "set").mapInArrow(rows, "k long, band int, v long")


def _likened(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, link): the pairs whose whole sets have a similarity of _NEAR percent or more, and whether it is PERCENT or more."""

    def rows(batches):
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            near, link = [], []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                near.append(100 * both >= _NEAR * (len(s) + len(t) - both))
                link.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            own = pa.record_batch([batch.column(0), batch.column(1), pa.array(link, pa.bool_())], ["a", "b", "link"])
            yield own.filter(pa.array(near, pa.bool_()))

    pairs = staged(pairs)
    x = sets.select(F.col("k").alias("a"), F.col("set").alias("x")).join(bounded(pairs), "a")
    led = staged(pairs.groupBy("b").agg(F.count("*").alias("m")))
    y = sets.select(F.col("k").alias("b"), F.col("set").alias("y")).join(bounded(led).drop("m"), "b")
    x = spread_join(x, y, led, ["b"], ["a"])
    return x.select("a", "b", "x", "y").mapInArrow(rows, "a long, b long, link boolean")


def _grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    """`df` with c, the group of k: the least of its component, or k itself."""
    return df.join(bounded(groups), "k", "left").withColumn("c", F.coalesce("c", "k"))


def _leaders(sets: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """Candidate links of each set to one leader of another group (groups: k and c): of the buckets of equal minima, the leader it
    meets most often.

    A bucket is led by its most central set, that with the largest share of common shingles (an original rather than an edited
    copy), in the first two turns, and by a random one in later turns. From the second turn on buckets also hold sets of similar
    size only: parts of an original, which are like it but not linked, find leaders of their own.
    """
    rows = _grouped(_bands(sets), groups)
    rank = F.xxhash64("k", F.lit(turn))
    more = sets.select("k", "share", F.floor(F.log(F.octet_length("set")) / F.log(F.lit(1.2)) + turn / 2).alias("size"))
    rows = rows.join(more, "k")
    if turn < 2:
        rank = F.struct(-F.col("share"), rank)
    if turn:
        rows = rows.withColumn("v", F.xxhash64("v", "size"))
    lead = rows.groupBy("band", "v").agg(F.min(F.struct(rank.alias("r"), F.col("k"), F.col("c"))).alias("lead"), F.count("*").alias("m")).filter("m > 1")
    lead = staged(lead.select("band", "v", F.col("lead.k").alias("b"), F.col("lead.c").alias("cb"), "m"))
    met = spread_join(rows, lead.drop("m"), lead, ["band", "v"], ["k"]).filter("c <> cb")
    met = met.groupBy("k", "b").agg(F.count("*").alias("m"))
    if turn:
        met = met.filter("m > 1")
    return met.groupBy("k").agg(F.max_by("b", F.struct("m", "b")).alias("b")).select(F.col("k").alias("a"), "b")


def _col_least(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100).cast("int")


def _col_needed(x: Column, y: Column) -> Column:
    """How many prefix shingles two linked sets of x and y shingles share at least: of PERCENT / (100 + PERCENT) of both sizes,
    as many as are left when all others lie behind the longer remainder."""
    both = F.ceil((x + y) * PERCENT / (100.0 + PERCENT) - 1e-6)
    behind = lambda n: _col_least(n) - F.greatest(F.lit(1), F.floor(n / 12))
    return F.greatest(both - F.greatest(behind(x), behind(y)), F.lit(1)).cast("int")


def _col_least_needed(n: Column, lo: Column, hi: Column) -> Column:
    """The least _col_needed(n, y) of all sizes y from lo to hi; null if there is none.

    Up to n the need grows with y, beyond n it falls, but for the rounding: that is less than 2 at the one end, where a size adds
    3/7, and less than 3 at the other, where it takes off 5/21 or more. So the least need lies among the first 5 or last 12 sizes.
    """
    ends = F.concat(F.sequence(lo, F.least(lo + 5, hi)), F.sequence(F.greatest(hi - 12, lo), hi))
    return F.when(lo <= hi, F.array_min(F.transform(ends, lambda y: _col_needed(n, y))))


def _crossing(sets: DataFrame, homes: DataFrame) -> DataFrame:
    """(k, f): how many shingles of each set occur in another home too; of those with too few for any link, no row."""
    rows = _grouped(_members(sets, False), homes).select(F.shiftrightunsigned("h", 16).alias("h"), F.shiftrightunsigned(F.xxhash64("c"), 16).alias("c"))
    across = staged(rows.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h"))
    few = _found(sets, across).filter(F.col("found") >= _col_least(F.col("n")))
    return staged(few.select("k", F.col("found").alias("f")))


def _guests(sets: DataFrame, homes: DataFrame) -> DataFrame:
    """(k, g): the sets and the homes they do not belong to that may hold a link of theirs, by the token-group matrix.

    The matrix holds, for each prefix shingle that two or more homes have, the homes whose union has it. A query, a set of the
    smaller of two homes, is bounded against the other by the shingles they share: fewer than a link to any size the home
    holds needs, and the home stays closed.

    Two linked sets of x and y shingles share 3/7 of x + y or more, and all of these cross between homes. So a set of which f
    shingles cross has no partner of more than 7/3 * f - x: a query and a home meet only if either side allows for the other's
    sizes.
    """
    few = _crossing(sets, homes)
    rows = _grouped(_members(sets, True).join(bounded(few), "k"), homes)
    largest = F.floor((F.col("f") * (100.0 + PERCENT)) / PERCENT + 1e-6 - F.col("n")).cast("int")
    rows = rows.withColumns({"lo": _col_least(F.col("n")), "hi": F.least(F.floor(F.col("n") * 100 / PERCENT).cast("int"), largest)})
    sizes = rows.groupBy("c").agg(F.count_distinct("k").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("hi").alias("reach"))
    sizes = staged(sizes)
    across = rows.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h")
    rows = staged(rows.join(across, "h", "left_semi").join(sizes.select("c", "members"), "c"))
    matrix = rows.select("h", F.col("c").alias("g"), F.col("members").alias("others")).distinct()
    matrix = matrix.join(sizes.select(F.col("c").alias("g"), "least", "most", "reach"), "g")
    smaller = F.struct("members", "c") < F.struct("others", "g")
    fits = (F.col("least") <= F.col("hi")) & (F.col("most") >= F.col("lo")) & (F.col("reach") >= F.col("n"))
    bound = rows.alias("q").join(matrix.alias("u"), (F.col("q.h") == F.col("u.h")) & smaller & fits)
    bound = bound.groupBy("k", "g", "n", "least", "most", "lo", "hi").agg(F.count("*").alias("m"))
    lo, hi = F.greatest("least", "lo"), F.least("most", "hi")
    return bound.filter(F.col("m") >= _col_least_needed(F.col("n"), lo, hi)).select("k", "g")


def _against(sets: DataFrame, places: DataFrame) -> DataFrame:
    """(k, g, p, guest, n, o, link, extra, lost): for each place (k, g, p, guest), how the set of k differs from p, the pivot of home g.

    n and o are the sizes of both, extra what only k has, lost what only p has; link: is k linked to p?
    """

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                extra, lost, link, n, o = [], [], [], [], []
                for s, t in zip(part.column(4), part.column(5)):
                    s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                    extra.append(np.setdiff1d(s, t, assume_unique=True).view(np.int64))
                    lost.append(np.setdiff1d(t, s, assume_unique=True).view(np.int64))
                    both = len(s) - len(extra[-1])
                    link.append(100 * both >= PERCENT * (len(s) + len(t) - both))
                    n.append(len(s))
                    o.append(len(t))
                listed = [pa.array(x, pa.list_(pa.int64())) for x in (extra, lost)]
                own = [*part.columns[:4], pa.array(n, pa.int32()), pa.array(o, pa.int32()), pa.array(link, pa.bool_()), *listed]
                yield pa.record_batch(own, ["k", "g", "p", "guest", "n", "o", "link", "extra", "lost"])

    pivots = staged(places.groupBy("p").agg(F.count("*").alias("m")))
    named = pivots.join(sets.select(F.col("k").alias("p"), F.col("set").alias("pivot")), "p")
    both = spread_join(sets.select("k", "set").join(bounded(places), "k"), named.drop("m"), pivots, ["p"], ["k", "g"])
    both = both.select("k", "g", "p", "guest", "set", "pivot")
    return both.mapInArrow(rows, "k long, g long, p long, guest boolean, n int, o int, link boolean, extra array<long>, lost array<long>")


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """One row for each shingle h of the array `column` that a stray and another set of the home have, with its place.

    Places count from 0 in an order that is the same for all sets of a home: what no stray shares comes first, then the rarest.
    """
    each = rows.withColumn("h", F.explode(column)).withColumn("size", F.size(column)).drop("extra", "lost")
    often = each.groupBy("g", "h").agg(F.count("*").alias("m"), F.max("stray").alias("met")).filter("m > 1 AND met")
    often = staged(often.select("g", "h", "m", F.col("m").alias("often")))
    each = spread_join(each, often.drop("m"), often, ["g", "h"], ["k"])
    own = Window.partitionBy("k", "g")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "h")) - 1
    return each.withColumn("place", place).drop("size", "often")


def _strays(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidate links (a, b) inside homes, other than those to pivots; rows: _against(), groups: the components so far.

    With E the extra and L the lost shingles of a set against the pivot (o shingles), two sets x and y of a home share
    o - |Lx| - |Ly| + |Lx & Ly| + |Ex & Ey|, so a link needs a number of common extras that the sizes tell: the overlap a link
    needs, less o, plus the larger L. Where that is above 0, the pair meets at a common extra shingle; where not, at least one
    common lost shingle is needed, as a stray (a set that is not in its pivot's component) is itself not linked to the pivot, and
    the pair meets there. In either case at a place that leaves enough shingles behind it on both sides.
    """
    rows = _grouped(rows, groups)
    rows = rows.join(bounded(groups.select(F.col("k").alias("p"), F.col("c").alias("cp"))), "p", "left").withColumn("stray", F.col("c") != F.coalesce("cp", "p"))
    ends = rows.groupBy("g").agg(F.min("n").alias("least"), F.max("stray").alias("any")).filter("any").select("g", "least")
    rows = rows.withColumns({"e": F.size("extra"), "l": F.size("lost")}).join(ends, "g")
    overlap = lambda x, y: F.floor((PERCENT * (x + y) + (99 + PERCENT)) / (100 + PERCENT)).cast("int")
    least = overlap(F.col("n"), F.greatest(F.col("least"), _col_least(F.col("n")))) - F.col("o") + F.col("l")
    rows = staged(rows.withColumn("need", least).select("k", "g", "c", "stray", "guest", "n", "o", "e", "l", "need", "extra", "lost"))

    def met(ranked: DataFrame, size: str, extras: bool) -> DataFrame:
        q, y = ranked.filter("stray").alias("q"), ranked.alias("y")
        if not extras:
            y = ranked.filter("n < o").alias("y")
        col = lambda name: (F.col(f"q.{name}"), F.col(f"y.{name}"))
        base = overlap(*col("n")) - F.col("q.o")
        need = base + F.greatest(*col("l"))
        ok = (F.col("q.g") == F.col("y.g")) & (F.col("q.h") == F.col("y.h")) & (F.col("q.c") != F.col("y.c")) & ~(F.col("q.guest") & F.col("y.guest"))
        ok &= ~F.col("y.stray") | (F.col("q.k") < F.col("y.k")) if extras else F.lit(True)
        shared = F.greatest(need, F.lit(1)) if extras else base + F.col("q.l") + F.col("y.l") - F.least(*col("e"))
        ok &= F.lit(True) if extras else need <= 0
        for side in ("q", "y"):
            ok &= F.col(f"{side}.place") <= F.col(f"{side}.{size}") - shared
        return q.join(y, ok).select(F.col("q.k").alias("a"), F.col("y.k").alias("b"))

    some = _ranked(rows, "extra").filter(F.col("place") <= F.col("e") - F.greatest("need", F.lit(1)))
    lost = _ranked(rows.filter("need <= 0 AND (stray OR n < o)"), "lost")
    return met(staged(some), "e", True).unionByName(met(staged(lost), "l", False)).distinct()


def similar_groups(docs: DataFrame, n: int = 5, turns: int = 3) -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, the least doc_id that its links reach.

    Documents link when their sets of distinct n-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.75 or more.
    1. Whole copies stand behind their first row, by text hash. 2. In hash order, two linked sets share a known number of
    shingles among their prefixes; documents whose prefix holds too few shingles that occur twice are done. 3. So are those
    of which under three quarters occur in another set. 4. Similar documents form groups, here called homes: each is compared
    with a leader it shares minima with, in `turns` rounds, and lies with it at a similarity of one half; the set that leads
    most is the home's pivot. 5. The token-group matrix bounds every document against every other home, and it is a guest of
    those that may hold a link of its. 6. An opened home is searched by what its sets and guests differ in from the pivot: those
    linked to the pivot are in one component, and only pairs that are not are looked for, by common differences. All links
    are verified on whole sets of 64-bit hashes; links inside a component would not change it and are not looked for.

    Defined cases: null, empty and word-less texts have no shingles and component_id = doc_id; with fewer than n words the
    whole sequence is one shingle; a null doc_id counts as larger than any and stays null when alone; an empty table gives an
    empty result; other columns are left behind.
    """
    docs = keyed(docs).withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text"), "t3": F.coalesce(F.length("text"), F.lit(-1))})
    copies = staged(later_copies(docs)).withColumn("skip", F.lit(True))
    docs = docs.join(bounded(copies), "k", "left").withColumn("skip", F.coalesce("skip", F.lit(False)))
    first = docs.filter("NOT skip")
    hashes = staged(_prefix_hashes(first, n).groupBy("h").count().filter("count > 1").select("h"))
    bits = bitmap(hashes, rows_of(hashes))
    if bits is None:
        hits = _prefix_hashes(first, n).join(hashes, "h", "left_semi").groupBy("k").agg(F.count("*").alias("hits"))
        docs = docs.join(hits, "k", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    else:
        docs = docs.withColumn("hits", F.lit(0).cast("long"))
    rows = staged(_sets(docs.select("text", "k", "doc_id", "t1", "t2", "t3", "skip", "hits"), n, bits))
    sets = staged(_pruned(rows.filter("set IS NOT NULL").select("k", "set")))
    joined = lambda groups, links: components(groups.toDF("a", "b").unionByName(links))
    near, led = None, staged(sets.sparkSession.createDataFrame([], "k long, c long"))
    for turn in range(turns):
        with arrow_rows(sets.sparkSession, 256):
            new = staged(_likened(_leaders(sets, led, turn), sets))
        near = new if near is None else near.unionByName(new)
        if turn + 1 < turns:  # the first leader that a set is linked to stands for its group
            more = new.filter("link").select(F.col("a").alias("k"), F.col("b").alias("c"))
            led = staged(more if not turn else led.unionByName(more.join(bounded(led), "k", "left_anti")))
    links = near.filter("link").select("a", "b")
    groups = components(links)
    homes = joined(groups, near.filter("NOT link").select("a", "b"))
    led = _grouped(near.groupBy(F.col("b").alias("k")).agg(F.count("*").alias("m")), homes)
    pivots = staged(led.groupBy(F.col("c").alias("g")).agg(F.max_by("k", F.struct("m", "k")).alias("p")))
    own = homes.select("k", F.col("c").alias("g")).unionByName(homes.select(F.col("c").alias("k"), F.col("c").alias("g")).distinct())
    places = own.withColumn("guest", F.lit(False)).unionByName(staged(_guests(sets, homes)).withColumn("guest", F.lit(True)))
    places = staged(places.join(bounded(pivots), "g", "left").select("k", "g", F.coalesce("p", "g").alias("p"), "guest"))
    with arrow_rows(sets.sparkSession, 256):
        differ = staged(_against(sets, places))
    groups = joined(groups, differ.filter("link").select(F.col("k").alias("a"), F.col("p").alias("b")))
    with arrow_rows(sets.sparkSession, 256):
        more = staged(_likened(_strays(differ, groups), sets))
    groups = joined(groups, more.filter("link").select("a", "b"))
    rows = rows.drop("set")
    last = F.coalesce("doc_id", F.lit(_LAST))
    classes = rows.filter("n > 0").groupBy("t1", "t2", "t3").agg(F.min(last).alias("d"), F.min_by("k", F.struct(last, F.col("k"))).alias("k"), F.count("*").alias("m"))
    classes = staged(_grouped(classes, groups))
    ends = classes.groupBy("c").agg(F.min("d").alias("component_id"))
    classes = staged(spread_join(classes, ends, staged(classes.groupBy("c").agg(F.count("*").alias("m"))), ["c"], ["k"]).select("t1", "t2", "t3", "m", "component_id"))
    out = spread_join(rows, classes.drop("m"), classes, ["t1", "t2", "t3"], ["k"], "left")
    reached = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif(F.col("component_id"), F.lit(_LAST)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), reached.alias("component_id"))
