"""Deletion of repeated line runs by a suffix array over line sequences (operator 9); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.shared import row_key, spread_join, staged

_LAST = (1 << 63) - 1
_PLACE = ("d", "k", "at")


def let(value: Column, body) -> Column:
    """body(value) with `value` worked out once, also where body uses it inside a function over an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(lines: Column) -> Column:
    """(i, x) of the lines that are not blank."""
    every = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(every, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def _agree(x: Column, y: Column) -> Column:
    """How many leading elements two arrays share."""
    differ = F.zip_with(x, y, lambda a, b: F.when(a == b, F.lit(0)).otherwise(F.lit(1)))
    return F.coalesce(F.nullif(F.array_position(differ, F.lit(1)), F.lit(0)) - 1, F.least(F.size(x), F.size(y)).cast("long")).cast("int")


def _ordered(groups: DataFrame, depths: tuple[int, ...] = ()) -> DataFrame:
    """`groups`, unique in `parts`, in the order of that array: `before`, the sum of m over all earlier rows, `prior`, the row before,
    and for each of `depths` (elements of parts) `from_<depth>`, the `before` of the first row of the run of neighbours that share
    so many leading elements with the one before them.

    The rows are dealt out by ranges of `parts`; only the sums, last rows and last starts of the ranges meet in one place.
    """
    rows = staged(groups.repartitionByRange("parts").sortWithinPartitions("parts").withColumn("id", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftrightunsigned("id", 33)).withColumn("own", F.struct("parts", "one"))
    earlier = Window.orderBy("part")
    above = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("m").alias("s"), F.max_by("own", "id").alias("end"))
    sums = sums.select("part", F.coalesce(F.sum("s").over(above), F.lit(0)).alias("base"), F.lag("end").over(earlier).alias("last"))
    within = Window.partitionBy("part").orderBy("id")
    rows = rows.withColumns({"before": F.coalesce(F.sum("m").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "prior": F.lag("own").over(within)})
    rows = rows.join(F.broadcast(sums), "part").withColumns({"before": F.col("before") + F.col("base"), "prior": F.coalesce("prior", "last")})
    if depths:
        same = F.when(F.col("prior").isNull(), F.lit(0)).otherwise(_agree(F.col("prior.parts"), F.col("parts")))
        rows = rows.withColumn("same", same).withColumns({f"from_{d}": F.when(F.col("same") < d, F.col("before")) for d in depths})
        starts = rows.groupBy("part").agg(*[F.max(f"from_{d}").alias(f"last_{d}") for d in depths])
        starts = starts.select("part", *[F.max(f"last_{d}").over(above).alias(f"last_{d}") for d in depths])
        upto = within.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.join(F.broadcast(starts), "part").withColumns({f"from_{d}": F.coalesce(F.max(f"from_{d}").over(upto), f"last_{d}") for d in depths})
        rows = rows.drop("same", *[f"last_{d}" for d in depths])
    return rows.drop("id", "part", "own", "base", "last")


class Suffixes:
    """The suffix array of the repeated lines of documents, by prefix doubling.

    The text is the sequence of line IDs (64-bit hashes, in their order). A line that occurs once, like the end of a document,
    ends every repeated run, so only lines that occur at two places are ranked; a suffix reaches to the `end` of its stretch of
    such lines. First, suffixes are sorted by their first WIDTH lines; every round then sorts those still equal by the ranks of
    FACTOR suffixes, each behind what the one before it covers (two doublings at once). Only stretches as long as what has
    been compared go on, so the rounds shrink.

    levels[j]: (d, k, at, end, size, parts): the arrays by which round j sorts; an element covers step[j] lines.
    array: (d, k, at, end, rank, m): each suffix's place in the array, and how many suffixes are equal to it.
    intervals: (d, k, at, end, long, from_<depth>): for each of `depths`, the place in the array where the interval of suffixes
    begins that share so many lines. They show after the first sort; the rounds behind it are done when array or splits are asked.
    splits: (rank, level, same, a, b): the suffixes at `rank` and those before them part in round `level` behind `same` equal
    elements of `parts`; a and b are a place (k, at) of each.
    """

    WIDTH, FACTOR = 64, 4

    def __init__(self, docs: DataFrame, long_words: int, depths: tuple[int, ...]):
        """docs: k, doc_id, text; depths: of WIDTH lines at most."""
        if not all(0 < d <= self.WIDTH for d in depths):
            raise ValueError(f"runs of 1 to {self.WIDTH} lines")
        sep = r"\x20\x09-\x0D"
        long = rf"^[{sep}]*(?:[^{sep}]+[{sep}]+){{{long_words - 1}}}[^{sep}]"
        lines = F.transform(_numbered(F.split(F.coalesce("text", F.lit("")), "\n", -1)), lambda s: F.struct(F.xxhash64(s["x"]).alias("h"), s["x"].rlike(long).alias("long")))
        rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "k", F.posexplode(lines).alias("at", "n")).select(*_PLACE, "n.h", "n.long")
        rows, place = staged(rows), F.struct(*_PLACE)
        twice = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("m")).filter("first < last")
        twice = staged(twice.select("h", "m"))
        rows = spread_join(rows, twice.drop("m"), twice, ["h"], ["k", "at"]).dropDuplicates(["k", "at"])
        rows = rows.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy("k").orderBy("at")))
        own = Window.partitionBy("k", "stretch")
        rows = rows.withColumns({"end": F.max("at").over(own) + 1, "size": F.count("*").over(own).cast("int")})
        rows = rows.withColumn("parts", F.collect_list("h").over(own.orderBy("at").rowsBetween(0, self.WIDTH - 1)))
        self.levels, self.step, self.array, self.splits = [staged(rows.drop("stretch", "h"))], [1], None, None
        self.intervals, self.depths = None, depths
        known = self.levels[0].withColumns({"rank": F.lit(0).cast("long"), "m": F.lit(2).cast("long")})
        self.open = self._sorted(known)

    def finish(self) -> None:
        """All rounds that are left."""
        while self.open is not None:
            self.open = self.open(self)

    def _sorted(self, rows: DataFrame):
        """Sorts the groups (equal rank, m > 1) of `rows` by their parts; the next round, if there is one.

        Equal suffixes shorter than an element of `parts` are in their place; some of them may lie in shorter stretches.
        """
        level, cover = len(self.levels) - 1, self.step[-1] * (self.FACTOR if len(self.levels) > 1 else self.WIDTH)
        groups = rows.filter((F.col("m") > 1) & (F.col("end") - F.col("at") >= self.step[-1])).groupBy("rank", "parts").agg(F.count("*").alias("m"), F.min(F.struct("k", "at")).alias("one"))
        depths = self.depths if self.intervals is None else ()
        own_from = [f"from_{d}" for d in depths]
        groups = _ordered(groups, depths)
        start = groups.groupBy("rank").agg(F.min("before").alias("base"))
        groups = staged(groups.join(start, "rank").withColumn("new", F.col("rank") + F.col("before") - F.col("base")).drop("base"))
        split = groups.filter("new > rank").select(F.col("new").alias("rank"), F.lit(level).alias("level"), _agree(F.col("prior.parts"), F.col("parts")).alias("same"), F.col("prior.one").alias("a"), F.col("one").alias("b"))
        self.splits = split if self.splits is None else self.splits.unionByName(split)
        rows = spread_join(rows, groups.select("parts", "new", F.col("m").alias("n"), *own_from), groups.select("parts", "m"), ["parts"], ["k", "at"], "left")
        kept = ["long"] if depths else []
        rows = staged(rows.select(*_PLACE, "end", "size", *kept, *own_from, F.coalesce("new", "rank").alias("rank"), F.coalesce("n", "m").alias("m")))
        if depths:
            self.intervals, rows = rows.select(*_PLACE, "end", "long", *own_from), rows.drop("long", *own_from)
        return lambda self: self._next(rows, cover)

    def _next(self, rows: DataFrame, cover: int):
        """Prepares and does the next round."""
        open_, more = F.col("size") >= cover, (F.col("m") > 1) & (F.col("end") - F.col("at") > cover)
        more = rows.agg(F.bool_or(more)).first()[0]
        done = rows.filter(~open_) if more else rows
        done = done.select(*_PLACE, "end", "rank", "m")
        self.array = done if self.array is None else self.array.unionByName(done)
        if not more:
            return None
        own = Window.partitionBy("k").orderBy("at")
        behind = [F.when(F.col("at") + i * cover < F.col("end"), F.lead("rank", i * cover).over(own)) for i in range(1, self.FACTOR)]
        rows = staged(rows.filter(open_).withColumn("parts", F.filter(F.array("rank", *behind), lambda r: r.isNotNull())))
        self.levels.append(rows.drop("rank", "m"))
        self.step.append(cover)
        return self._sorted(rows)

    def common(self) -> DataFrame:
        """(rank, lcp): how many lines the suffixes at a rank share with those before it in the array; 0 where there is no row.

        What the suffixes share behind the equal elements of their round is told by the rounds before it, which cover fewer lines.
        """
        steps = F.element_at(F.array(*[F.lit(n) for n in self.step]), F.col("level") + 1)
        rows = self.splits.withColumn("lcp", F.col("same") * steps)
        for j in range(len(self.levels) - 2, -1, -1):
            at = lambda s: self.levels[j].select(F.col("k").alias(f"{s}_k"), F.col("at").alias(f"{s}_at"), F.col("parts").alias(f"{s}_parts"))  # noqa: B023, E731
            open_ = rows.filter(F.col("level") > j)
            for s in "ab":
                open_ = open_.withColumns({f"{s}_k": F.col(f"{s}.k"), f"{s}_at": F.col(f"{s}.at") + F.col("lcp")}).join(at(s), [f"{s}_k", f"{s}_at"], "left")
            both = F.when(F.col("a_parts").isNotNull() & F.col("b_parts").isNotNull(), _agree(F.col("a_parts"), F.col("b_parts")))
            longer = F.col("lcp") + self.step[j] * F.coalesce(both, F.lit(0))  # null: one of the suffixes has ended
            rows = rows.filter(F.col("level") <= j).unionByName(staged(open_.withColumn("lcp", longer).select(*rows.columns)))
        return rows.select("rank", "lcp")

    def longest(self) -> DataFrame:
        """(k, longest): the most lines that a document has in a row which also stand at another place."""
        self.finish()
        lcp = staged(self.common())
        alone = self.array.filter("m = 1").withColumn("after", F.col("rank") + 1)  # each with a rank of its own
        alone = alone.join(lcp.withColumnRenamed("lcp", "x"), "rank", "left").join(lcp.select(F.col("rank").alias("after"), F.col("lcp").alias("y")), "after", "left")
        alone = alone.select("k", F.greatest(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("n"))
        equal = self.array.filter("m > 1").select("k", (F.col("end") - F.col("at")).alias("n"))
        return alone.unionByName(equal).groupBy("k").agg(F.max("n").cast("long").alias("longest"))

    def later(self, depth: int) -> DataFrame:
        """(k, at, long): the places whose first `depth` lines (one of `depths`) also start at an earlier place: all but the first of
        each interval of the array whose suffixes share so many lines."""
        rows = self.intervals.filter(F.col("at") + depth <= F.col("end")).select(*_PLACE, "long", F.col(f"from_{depth}").alias("interval"))
        first = staged(rows.groupBy("interval").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("m")).filter("m > 1"))
        out = spread_join(rows, first.drop("m"), first, ["interval"], ["k", "at"])
        return out.filter(F.struct(*_PLACE) > F.col("first")).select("k", "at", "long")


def dedup_lines(docs: DataFrame, depth: int = 2, long_words: int = 20, longest: bool = True) -> DataFrame:
    """The documents with n_lines, n_removed, longest_run and `text` without the later copies of repeated runs of lines.

    A run counts from `depth` lines on, and a single line from `long_words` words on; its first copy, by (doc_id, line), stays.
    Lines end at LF; blank lines are neither counted in runs nor deleted. A run may repeat in another document or in its own.
    longest_run: the most non-blank lines in a row that also stand, in a row, at another place. Without `longest` it is null, and
    the suffix array is sorted only as deep as runs of `depth` lines need.

    Defined cases: null text stays null, with 0 lines; a null doc_id counts as larger than any; rows that agree in doc_id and
    text are one document and fare alike; an empty table gives an empty result; extra columns pass through (n_lines, n_removed
    and longest_run are replaced), whatever their names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "longest_run")]
    rows = docs.select(F.col("text").cast("string").alias("text"), row_key("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("own"))
    array = Suffixes(rows.select("k", "doc_id", "text"), long_words, tuple(sorted({1, depth})))
    gone = array.later(depth).select("k", F.explode(F.sequence("at", F.col("at") + depth - 1)).alias("at")).unionByName(array.later(1).filter("long").select("k", "at"))
    found = gone.groupBy("k").agg(F.collect_set("at").alias("gone"))
    found = array.longest().join(found, "k", "left") if longest else found.withColumn("longest", F.lit(None).cast("long"))

    def kept(s):
        at = let(F.struct(_numbered(s["lines"]).alias("x"), s["gone"].alias("g")), lambda y: F.transform(y["g"], lambda p: y["x"][p]["i"]))
        return F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), at)

    def rebuilt(s):
        both = F.struct(s["lines"].alias("lines"), kept(s).alias("kept"))
        text = lambda y: F.array_join(F.transform(y["kept"], lambda i: y["lines"][i]), "\n")
        return let(both, lambda y: F.struct(text(y).alias("text"), F.size(y["kept"]).alias("n")))

    lines = F.split("text", "\n", -1)
    whole = F.struct(F.col("text").alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n"))
    cut = let(F.struct(lines.alias("lines"), F.col("gone").alias("gone")), rebuilt)
    out = rows.join(found, "k", "left").withColumn("cut", F.when(F.col("gone").isNull(), whole).otherwise(cut))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    removed = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n - F.col("cut.n"))
    own = [F.col("cut.text").alias("text") if c == "text" else F.col("own")[c].alias(c) for c in names]
    return out.select(*own, n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), (F.coalesce("longest", F.lit(0)) if longest else F.col("longest")).cast("long").alias("longest_run"))
