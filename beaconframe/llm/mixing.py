"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all rates w (copies of a document) with 0 <= w <= ``cap``, entropy balancing
takes the one nearest to keeping every document once, in relative entropy over
words, such that

- each source's words, sum(w * size), are its target, and
- the mix keeps the corpus's length: the mean of x = standardised log2(size + 1)
  over its words is that of the corpus.  This constraint is soft, as targets
  and cap can rule it out (``RIDGE`` is its penalty, in units of the mix's words).

The dual is convex, with one multiplier a source and one for length, ``tilt``; the
solution is the exponentially tilted rate w = min(cap, exp(m[source] + tilt * x)),
so documents of one source differ by their length.  Each Newton step sums
gradient and curvature over the documents, by source; the Hessian is an arrow (sources
meet length, not one another), so the step for length follows from sums over
sources, and each source's own from that.  Documents of equal source and size have
equal rates, so the steps read ``profile``, in which they are counted once.
The multipliers are a table, of which nothing is collected but sums.

Rates become whole copies without any global order: a source's documents are
dealt by hash into groups of about ``GROUP_ROWS``, and each group is walked from
the longest size class to the shortest, each document taking the number of
copies that best settles what the walk still owes.  A source that holds a third
of all rows is just more groups.  Equal rows are counted first and then dealt
apart by their number, so neither do they meet.  The outcome depends on the rows
alone, so reruns agree.

Null sources form one source, ordered last.  Null texts count 0 words.  A source
without words has target 0; a document without words takes 0 words, and as many
copies as its rounded rate says.  An empty table gives no rows.  Rows of equal id and text
take between them what the mix says; which of them is repeated is settled by
their other columns.  Texts of any length are only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, unpacked, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
GROUP_ROWS = 256
NEWTON_STEPS = 30
TOLERANCE = 1e-7
RIDGE = 0.02
#: A table of sources up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 20_000
SPAN = 4096


def sized(docs: DataFrame) -> DataFrame:
    """Id, source and number of words of each row, and a hash of id, text and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text).cast("long").alias("size"),
        row_key().alias("row_key"),
    )


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string"))


def each(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1; no array is longer than ``SPAN`` or the SPANth part of ``times``."""
    many = rows.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / SPAN))))
    return many.withColumn(number, F.explode(F.sequence(F.col("span") * SPAN + 1, F.least(F.col(times), (F.col("span") + 1) * SPAN)))).drop("span")


def with_sources(rows: DataFrame, sources: DataFrame, known: int) -> DataFrame:
    """``rows`` with the columns of their source; ``known``: how many sources there are."""
    side = F.broadcast(sources) if known <= BROADCAST_SOURCES else sources
    return rows.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", *(f"t.{c}" for c in sources.columns if c != "source"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their place, from 0, in code point order, null last: each range of sources counts its own, and adds those before it."""
    order = F.col("source").asc_nulls_last()
    ranges = cut(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("range", F.spark_partition_id()))
    sizes = sorted((r.range, r.n) for r in ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before = {k: sum(n for other, n in sizes if other < k) for k, _ in sizes}
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range")) if before else F.lit(0)
    return ranges.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + offset).drop("range")


def target_table(profile: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs and target: shares by weight, none above ``cap`` times its source's size.

    ``weights`` are dealt to the sources in code point order, null last, over and
    over.  What a stop leaves over is shared anew by weight until none is above:
    that is filling all sources to one level of words a weight, which rises as
    sources stop, until no further one does.
    """
    by_source = profile.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    limit = F.col("source_size") * F.lit(float(cap))
    weighed = cut(numbered(by_source).select("source", "source_size", "n_docs", F.element_at(table, (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).alias("weight"), limit.alias("limit")))
    pool = (weighed.agg(F.sum("source_size").alias("n")).collect()[0].n or 0) * share
    level, stopped = 0.0, -1
    while True:
        stops = F.col("limit") <= F.col("weight") * F.lit(level)
        now = weighed.agg(F.coalesce(F.sum(F.when(stops, F.col("limit"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(stops, 1)).alias("stopped")).collect()[0]
        if now.stopped == stopped or not now.weight:  # the level only rises, so sources that stop stay stopped
            break
        stopped, level = now.stopped, (pool - now.full) / now.weight
    target = F.least(F.col("limit"), F.col("weight") * F.lit(level)) if now.weight else F.col("limit")
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def balanced(profile: DataFrame, targets: DataFrame, cap: float = CAP, ridge: float = RIDGE, steps: int = NEWTON_STEPS) -> tuple[DataFrame, Column]:
    """``targets`` with each source's multiplier m, and the rate of a document by ``size`` and ``m``."""
    weighed = F.col("size") * F.col("n")
    length = F.log2(F.col("size") + F.lit(1.0))
    facts = profile.agg(F.sum(weighed).alias("words"), (F.sum(weighed * length) / F.sum(weighed)).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(weighed * length * length) / F.sum(weighed) - F.pow(F.sum(weighed * length) / F.sum(weighed), 2))).alias("spread")).collect()[0]
    known = targets.count()
    x = (length - F.lit(facts.mean or 0.0)) / F.lit(facts.spread or 1.0)
    most = F.log(F.lit(float(cap)))
    # A source at its cap keeps all of its documents at it, whatever their lengths.
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))
    at = targets.where(~full & (F.col("target") > 0)).select("source", "target", F.log(F.col("target") / F.col("source_size")).alias("m"))
    pool, tilt = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("n")).collect()[0].n, 0.0
    rows = profile.where("size > 0")
    for _ in range(steps):
        u = F.col("m") + F.lit(tilt) * x
        words = weighed * F.exp(F.least(most, u))
        bends = F.when(u < most, words).otherwise(F.lit(0.0))
        sums = with_sources(rows, at, known).groupBy("source").agg(F.first("m").alias("m"), F.first("target").alias("target"), F.sum(words).alias("a"), F.sum(words * x).alias("b"), F.sum(bends).alias("aa"), F.sum(bends * x).alias("bb"), F.sum(bends * x * x).alias("dd"))
        sums = cut(sums.withColumn("slope", F.col("a") - F.col("target")).withColumn("curve", F.col("aa") + F.col("target") * F.lit(1e-6)))
        whole = sums.agg(F.sum("b").alias("b"), F.sum("dd").alias("dd"), F.sum(F.col("bb") * F.col("slope") / F.col("curve")).alias("cross"), F.sum(F.col("bb") * F.col("bb") / F.col("curve")).alias("shared"), F.max(F.abs(F.col("slope")) / F.col("target")).alias("worst")).collect()[0]
        if whole.worst is None:
            break
        slope = whole.b + ridge * pool * tilt
        curve = max(whole.dd - whole.shared, 0.0) + ridge * pool
        step = max(-0.5, min(0.5, -(slope - whole.cross) / curve))
        if whole.worst < TOLERANCE and abs(step) < TOLERANCE:
            break
        own = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), -(F.col("slope") + F.col("bb") * F.lit(step)) / F.col("curve")))
        at = sums.select("source", "target", (F.col("m") + own).alias("m"))
        tilt += step
    done = targets.alias("t").join(at.select(F.col("source").alias("of"), "m"), F.col("t.source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("m").isNotNull(), F.exp(F.least(most, F.col("m") + F.lit(tilt) * x))).otherwise(F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0)))
    return cut(done), rate


def rounded(rows: DataFrame, table: DataFrame, rate: Column, cap: float = CAP) -> DataFrame:
    """doc_id, row_key, size, source_size, target, copies: a row for each document of ``rows``, where equal ones are counted (n)."""
    joined = each(with_sources(rows, table, table.count()).withColumn("rate", rate), "n", "number")
    groups = F.ceil(F.col("n_docs") / F.lit(GROUP_ROWS))
    grouped = joined.withColumn("part", F.pmod(F.xxhash64(F.col("number"), F.col("row_key")), groups)).groupBy("source", "part").agg(
        # size classes from the longest on, then an arbitrary but fixed order
        F.array_sort(F.collect_list(F.struct((-F.floor(F.log2(F.col("size") + 1))).alias("class"), "row_key", "number", "doc_id", "size", "rate"))).alias("rows"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
    )

    def walk(state: Column, row: Column) -> Column:
        owed = state["owed"] + row["rate"] * row["size"]
        copies = F.when(row["size"] > 0, F.greatest(F.lit(0), F.least(F.lit(int(cap)), F.floor(owed / row["size"] + 0.5).cast("int")))).otherwise(F.floor(row["rate"] + 0.5).cast("int"))
        return F.struct((owed - copies * row["size"]).alias("owed"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("copies"))
    walked = grouped.withColumn("copies", F.aggregate("rows", start, walk)["copies"])
    done = walked.select("source_size", "target", F.explode(F.arrays_zip("rows", "copies")).alias("x"))
    return done.select("x.rows.doc_id", "x.rows.row_key", "x.rows.size", "x.rows.rate", "source_size", "target", F.col("x.copies").alias("copies"))


def copies_of(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, row_key, size, rate, source_size, target, copies for each row of ``docs``."""
    rows = cut(sized(docs).groupBy("doc_id", "source", "size", "row_key").agg(F.count(F.lit(1)).alias("n")))
    profile = cut(rows.groupBy("source", "size").agg(F.sum("n").alias("n")))
    table, rate = balanced(profile, cut(target_table(profile, weights, share, cap)), cap)
    return rounded(rows, table, rate, cap)


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for each row of ``docs``."""
    return copies_of(docs, weights, share, cap).select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as in ``docs``."""
    counts = copies_of(docs, weights, share, cap).groupBy(F.col("row_key").alias("key")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    rows = packed(docs, key=row_key()).groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy(F.xxhash64("row"), F.hash("row")).rowsBetween(Window.unboundedPreceding, 0))
    share_of = lambda place: F.floor(place * F.col("copies") / F.col("rows"))
    taken = rows.withColumn("upto", upto).join(counts, "key").withColumn("times", share_of(F.col("upto")) - share_of(F.col("upto") - F.col("n")))
    return each(taken.where(F.col("times") > 0), "times", "copy").select(*unpacked(docs.columns))
