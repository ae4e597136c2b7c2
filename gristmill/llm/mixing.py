"""Mixing sources to target weights by entropy balancing. Column expressions only.

Targets. Sources share `percent` % of all words by their weights; a target stops at CAP times the
words of its source, and the excess goes to the others by weight. All shares are thus
min(weight * level, CAP * words) at one common level, which is raised until the targets add up:
each round sums what is capped and what is not, and only those sums reach the driver.

Rates. The rates nearest to one (in relative entropy) that meet a source's target, none above
CAP, are r = min(CAP, exp(lambda * x)), x being a document's words over the mean of its source.
The dual is convex with one multiplier for each source: Newton steps on all sources at once, kept
within a bracket. Documents are pre-aggregated to one row for each source and size, and a step
sums these rows by source.

Copies. Within a source, sizes in order, rates are summed up and rounded, so that the copies so
far differ from the sum of the rates by less than one; what the words then still miss is made up
by whole documents of a fitting size (REPAIRS rounds). The copies of a size are dealt evenly to its
documents, which a hash of id and text orders; sizes that more than GROUP documents share are dealt
in groups of about GROUP, so that no task gets all copies of a document.

Reruns agree: there are no random numbers, sums that decide are exact, and orders are total but for
equal rows.

Defined cases: a null or blank text has no words and is never taken; a source without words has
target 0. A null source is a source, the last one. Rows with a null or repeated doc_id are each
mixed by themselves; of rows equal in id and text, which one has more copies is not told. Columns other
than doc_id, text and source, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BROADCAST_ROWS, checkpointed, join_by_hot_key

#: Weights of the sources in order, repeating; percent of all words; most times a document is taken.
WEIGHTS, PERCENT, CAP = (5, 2, 1), 150, 2
#: Newton steps at most, relative error at which they end, rounds of repair, documents of one size dealt in a task.
STEPS, EPS, REPAIRS, GROUP = 200, 1e-8, 4, 10_000
WORD = r"[^\x20\x09-\x0D]+"


def _small(rows: DataFrame) -> DataFrame:
    """rows of a table that is written already, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def ranked(sources: DataFrame) -> DataFrame:
    """Adds nth, from 0: by code point, null last. Sources are dealt by range, so no task gets them all."""
    ranges = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each task
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranges.withColumn("nth", F.row_number().over(own)).join(F.broadcast(before), "part").withColumn("nth", F.col("nth") - 1 + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with the target of each."""
    every = F.array(*(F.lit(float(w)) for w in weights))
    rows = checkpointed(ranked(sources).withColumn("weight", F.get(every, (F.col("nth") % len(weights)).cast("int"))))
    most = cap * F.col("source_size")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while True:  # the level only rises, and a source that is capped stays so
        full = most <= F.col("weight") * level
        taken, open_, n = rows.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == before or not open_:
            break
        before, level = n, (total * percent / 100 - (taken or 0)) / open_
    return rows.select(*sources.columns, "weight", F.least(F.col("weight") * level, most.cast("double")).alias("target"))


def _rate(step: Column, x: Column, cap: int) -> Column:
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(step * x, F.lit(50.0)))))


def _total(x: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def rates(sizes: DataFrame, aims: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes (key, size, n) of all documents with words; aims (key, target, source_size, n_docs). Returns key and lam, by Newton's method."""
    mean = F.col("source_size") / F.col("n_docs")
    now = aims.select("key", "target", "source_size", mean.alias("mean"), (F.col("target") >= cap * F.col("source_size")).alias("full"), F.lit(0.0).alias("lam"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))
    now = checkpointed(now)
    few = now.count() <= BROADCAST_ROWS  # as in every step
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, cap)
        words = F.col("n") * F.col("size") * r
        state = now.select("key", "mean", "full", "lam")
        sums = sizes.join(F.broadcast(state) if few else state, "key").groupBy("key").agg(_total(words).alias("got"), _total(F.when(r < cap, words * x)).alias("slope"))
        each = checkpointed((F.broadcast(now) if few else now).join(sums, "key"))
        off = F.when(F.col("full"), F.lit(0.0)).otherwise(F.abs(F.col("got") - F.col("target")) / F.col("target"))
        if (each.agg(F.max(off)).first()[0] or 0.0) <= EPS:
            break
        lo = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        middle = F.when(hi == math.inf, F.greatest(2 * lo, F.lit(1.0))).when(lo == -math.inf, F.least(2 * hi, F.lit(-1.0))).otherwise((lo + hi) / 2)
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("lam")) < 50)
        lam = F.when(off <= EPS, F.col("lam")).when(inside, newton).otherwise(middle)
        now = each.select("key", "target", "source_size", "mean", "full", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"))
    return now.select("key", "target", "mean", "full", "lam")


def repaired(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes (key, size, n, copies, target): one copy more or less of the size that brings each source nearest to its target."""
    off = sizes.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    rows = sizes.join(_small(checkpointed(off)), "key")
    change = F.when((F.col("off") > 0) & (F.col("copies") < cap * F.col("n")), 1).when((F.col("off") < 0) & (F.col("copies") > 0), -1)
    left = F.abs(F.col("off") - change * F.col("size"))
    tried = rows.where(change.isNotNull() & (F.col("size") > 0) & (left < F.abs("off")))
    best = tried.groupBy("key").agg(F.min(F.struct(left.alias("left"), "size", change.cast("long").alias("change"))).alias("b")).select("key", "b.size", "b.change")
    now = sizes.join(_small(checkpointed(best)), ["key", "size"], "left")
    return checkpointed(now.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change"))


def copies(sizes: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes (key, size, n) with the copies that all documents of a size have together, and the target of their source."""
    rows = sizes.join(_small(checkpointed(solved)), "key")
    share = F.col("n") * _rate(F.col("lam"), F.col("size") / F.col("mean"), cap)
    upto = F.sum(share).over(Window.partitionBy("key").orderBy("size"))
    rows = rows.withColumn("upto", F.floor(upto + 0.5))
    before = F.lag("upto", 1, 0).over(Window.partitionBy("key").orderBy("size"))
    number = F.greatest(F.lit(0), F.least(F.col("upto") - before, cap * F.col("n")))
    rows = checkpointed(rows.select("key", "size", "n", number.cast("long").alias("copies"), "target"))
    for _ in range(REPAIRS):
        rows = repaired(rows, cap)
    return rows


def dealt(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """docs (key, size, h, ...) with taken: the copies of a size, dealt evenly to its documents in the order of h."""
    even = F.floor(F.col("copies") / F.col("n"))
    own = sizes.select("key", "size", "n", even.alias("each"), (F.col("copies") - even * F.col("n")).alias("extra"), F.ceil(F.col("n") / F.lit(GROUP)).alias("groups"), "target")
    rows = join_by_hot_key(docs, checkpointed(own), ["key", "size"], "n")
    alike = rows.where("extra = 0").withColumn("more", F.lit(0))
    # of the others, each group of a size gets its part of the extra copies
    rows = rows.where("extra > 0").withColumn("group", F.pmod("h", "groups"))
    at = Window.partitionBy("key", "size").orderBy("group")
    parts = rows.groupBy("key", "size", "group").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    parts = parts.withColumn("upto", F.floor(F.sum("m").over(at) * (F.col("extra") / F.col("n")) + 0.5))
    parts = parts.select("key", "size", "group", (F.col("upto") - F.lag("upto", 1, 0).over(at)).alias("quota"))
    nth = F.row_number().over(Window.partitionBy("key", "size", "group").orderBy("h"))
    picked = rows.join(parts, ["key", "size", "group"]).withColumn("more", (nth <= F.col("quota")).cast("int")).drop("group", "quota")
    return alike.unionByName(picked).withColumn("taken", (F.col("each") + F.col("more")) * F.col("size")).drop("each", "extra", "groups", "more", "n")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target (double) of its source and taken (words of all its copies) of each of docs (doc_id, text, source)."""
    if not 0 < percent <= 100 * cap:
        raise ValueError(f"percent must be over 0 and at most {100 * cap}")
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # a null source is a key of its own
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    light = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), source.alias("source"), words.alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h")))
    sizes = checkpointed(light.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")))
    sources = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_docs"))
    aims = targets(sources.select("source", "source_size", "key", "n_docs"), weights, percent, cap)
    sizes = sizes.drop("source")
    solved = rates(sizes.where("size > 0"), aims.where("source_size > 0"), cap)
    aims = checkpointed(aims)
    per_size = copies(sizes.where("size > 0"), solved, cap).unionByName(sizes.where("size = 0").join(_small(aims.select("key", "target")), "key").withColumn("copies", F.lit(0).cast("long")))
    out = dealt(light.drop("source"), per_size)
    totals = aims.select("key", "source_size", F.coalesce("n_docs", F.lit(0)).alias("copies_of_key"))
    return join_by_hot_key(out, totals, ["key"], "copies_of_key").select("doc_id", "size", "source_size", "target", "taken")
