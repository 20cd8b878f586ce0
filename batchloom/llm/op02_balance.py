"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates: per source the document rates r minimise sum(r log r - r) subject to sum(r * size) = target
and r <= 2. The optimum is r = min(2, exp(lambda * size / scale)), one multiplier per source; its
convex dual is solved by safeguarded Newton steps, each one aggregation over the histogram of
(source, size), which is all that the iterations read. Rates are rounded into whole copies
systematically along ascending size, so that a source's words miss the target by less than its
longest document; ``exact_words`` cuts or extends the copies of one document to close that gap.

Scale: documents are read once into (doc_id, source, size); the histogram pre-aggregates any hot
source. Ranks for rounding are taken inside (source, size, salt) groups, the salt growing with the
number of rows. What is broadcast is one row per source, and only when counted as small.

Defined cases: null or empty text has size 0, is taken 0 times and has rate 1; a null source is a
source of its own, ordered last; repeated rows and rows without doc_id are separate documents;
documents of equal size tie and are ordered by a hash of the row; very long texts count whole; an
empty table gives an empty result; a table without words has targets 0. Columns must be hashable
(no maps); no name can clash, since rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, discard, landed, row_keys, small_or_shuffled

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE, MAX_STEPS, STEPS_AT_ONCE = 1e-9, 81, 3
SALT_ROWS, MOST_SALTS = 16_384, 4_096


def word_count(text: Column) -> Column:
    """Words between ASCII blanks: blanks become one kind, then word ends are counted by lengths."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(plain, F.lit("[^ ]+")), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """per_source(k, source_size) -> with weight and target (water-filling under most * source_size).

    One row per source goes through one window task.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("at", F.row_number().over(Window.orderBy("k")) - 1)
    w = ranked.withColumn("weight", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("theta", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))))
    # the first source, by ratio, that the common level does not fill: all before it stop at their caps
    level = F.min(F.when(F.col("theta") <= F.col("ratio"), F.struct("ratio", "k", "theta"))).over(every)["theta"]
    return w.select("k", "source_size", "weight", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def _rate(lam: Column, size: Column, scale: Column, full: Column) -> Column:
    return F.when(full, F.lit(float(MOST))).when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(lam * size / scale, F.lit(50.0)))))


def solve(hist: DataFrame, sources: DataFrame) -> DataFrame:
    """Multipliers per source: k, source_size, target, scale, lam, full.

    hist(k, size, n) counts documents. Steps end when every source meets its target, and raise
    where they do not.
    """
    scale = hist.groupBy("k").agg((F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    p = sources.join(scale, "k").select(
        "k", "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"),
        (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"),
    )
    p = landed(p, "multipliers")
    few = p.count() <= BROADCAST_ROWS
    for _ in range(MAX_STEPS // STEPS_AT_ONCE):
        old = p
        for _ in range(STEPS_AT_ONCE):  # one job each round: steps of a source that is done change nothing
            p = _step(hist, p, few)
        p = landed(p, "multipliers")
        discard(old)
        if p.where("not done").isEmpty():
            break
    else:
        raise RuntimeError("entropy balancing did not settle")
    # ten digits: summation order no longer shows, so reruns agree
    return p.select("k", "source_size", "target", "scale", "full", F.round("lam", 10).alias("lam"))


def _step(hist: DataFrame, p: DataFrame, few: bool) -> DataFrame:
    """One safeguarded Newton step of every source's multiplier."""
    size = F.col("size")
    r = _rate(F.col("lam"), size, F.col("scale"), F.col("full"))
    step = hist.join(F.broadcast(p) if few else p, "k").groupBy("k", "source_size", "target", "scale", "full", "lam", "lo", "hi").agg(
        F.sum(F.col("n") * size * r).alias("got"), F.sum(F.when(r < MOST, F.col("n") * size * size / F.col("scale") * r).otherwise(0.0)).alias("slope")
    )
    miss = F.col("got") - F.col("target")
    low, high = F.when(miss < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")), F.when(miss >= 0, F.least("hi", "lam")).otherwise(F.col("hi"))
    step = step.withColumns({"lo2": low, "hi2": high, "newton": F.when(F.col("slope") > 0, F.col("lam") - miss / F.when(F.col("slope") > 0, F.col("slope")))})
    halved = F.when(F.col("lo2") < -9e5, F.least(F.lit(-1.0), F.col("lam") * 2 - 1)).when(F.col("hi2") > 9e5, F.greatest(F.lit(1.0), F.col("lam") * 2 + 1)).otherwise((F.col("lo2") + F.col("hi2")) / 2)
    done = F.col("full") | (F.abs(miss) <= TOLERANCE * F.col("target") + 1e-9) | (F.col("hi2") - F.col("lo2") <= 1e-13 * F.greatest(F.lit(1.0), F.abs("lam")))
    lam = F.when(done, F.col("lam")).when((F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2")), F.col("newton")).otherwise(halved)
    return step.select("k", "source_size", "target", "scale", "full", lam.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, exact_words: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, cut_words, taken, k1, k2 for every row of ``docs``.

    ``copies`` are whole copies (0 to 2); ``cut_words`` (only with ``exact_words``) are words taken
    beyond them, or left out of them if negative, on one document of a source. ``k1`` and ``k2``
    identify the row by its columns.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))
    k1, k2 = row_keys(docs)
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("k"), word_count(F.col("text").cast("string")).alias("size"), k1.alias("k1"), k2.alias("k2")
    )
    sizes = landed(base, "sizes")
    base = numbered(sizes)
    hist = landed(base.groupBy("k", "size").agg(F.count("*").alias("n")), "histogram")
    per_source = hist.groupBy("k").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    solved = landed(solve(hist, landed(targets(per_source, weights, share), "targets")), "solved")
    p = small_or_shuffled(solved)

    rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), F.col("full"))
    extra = rate - F.floor(rate)
    n_rows = sizes.count()
    salts = max(1, min(MOST_SALTS, -(-n_rows // SALT_ROWS)))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("k1", "nth", F.lit(17)), F.lit(salts)))
    fine = salted.groupBy("k", "size", "salt").agg(F.count("*").alias("n"))
    # fractions summed up to each size, then up to each salt of the size; whole numbers passed give the extra copies
    by_size = Window.partitionBy("k").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    coarse = hist.join(p, "k").select("k", "size", extra.alias("extra"), F.coalesce(F.sum(F.col("n") * extra).over(by_size), F.lit(0.0)).alias("before"))
    by_salt = Window.partitionBy("k", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = fine.withColumn("n_before", F.coalesce(F.sum("n").over(by_salt), F.lit(0))).join(coarse, ["k", "size"])
    start = F.col("before") + F.col("n_before") * F.col("extra")
    quota = quota.select("k", "size", "salt", (F.floor(start + F.col("n") * F.col("extra") + 0.5) - F.floor(start + 0.5)).alias("quota"))
    in_group = Window.partitionBy("k", "size", "salt").orderBy("k2", "k1", "nth")
    ranked = salted.withColumn("place", F.row_number().over(in_group)).join(quota, ["k", "size", "salt"])
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(rate) + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)).cast("long")
    rounded = ranked.join(p, "k").withColumns({"rate": rate, "copies": F.least(copies, F.lit(MOST))})
    if not exact_words:
        return rounded.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", F.lit(0).cast("long").alias("cut_words"), (F.col("copies") * F.col("size")).alias("taken"), "k1", "k2")
    rounded = landed(rounded.select("doc_id", "source", "k1", "k2", "k", "size", "salt", "place", "source_size", "target", "rate", "copies"), "copies")
    whole = F.col("copies") * F.col("size")
    who = lambda x: F.max(F.struct(x.alias("words"), F.col("size").alias("size"), F.col("salt").alias("salt"), F.col("place").alias("place")))
    gap = rounded.groupBy("k").agg(
        (F.round(F.max("target")).cast("long") - F.sum(whole)).alias("gap"), who(MOST * F.col("size") - whole).alias("most_room"), who(whole).alias("most_taken")
    )
    pick = F.when(F.col("gap") > 0, F.col("most_room")).otherwise(F.col("most_taken"))
    gap = gap.where("gap != 0").select("k", pick["size"].alias("size"), pick["salt"].alias("salt"), pick["place"].alias("place"), (F.signum("gap") * F.least(F.abs("gap"), pick["words"])).cast("long").alias("cut"))
    cut = F.coalesce("cut", F.lit(0)).cast("long")
    return rounded.join(small_or_shuffled(gap), ["k", "size", "salt", "place"], "left").select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", cut.alias("cut_words"), (whole + cut).alias("taken"), "k1", "k2"
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(row, k1, k2, ...)`` with nth: 0, 1, ... among the rows of equal keys.

    ``row`` is what ``monotonically_increasing_id`` gave when the table was written, so its upper bits
    tell the writing task. Equal rows are counted by task, and numbered inside each: no key's rows
    come together, however many they are.
    """
    keys = ["k1", "k2"]
    equal = landed(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "equal")
    if equal.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long")).drop("row")
    some = rows.join(small_or_shuffled(equal), keys, "left_semi").withColumn("task", F.shiftrightunsigned("row", 33))
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = some.groupBy(*keys, "task").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*keys, "task").orderBy("row")) - 1
    some = some.withColumn("inside", inside).join(small_or_shuffled(landed(tasks, "tasks")), [*keys, "task"])
    some = some.withColumn("nth", (F.col("before") + F.col("inside")).cast("long")).select(*rows.columns, "nth")
    alone = rows.join(small_or_shuffled(equal), keys, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    return alone.unionByName(some).drop("row")


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` repeated by their copies in ``mixed``, a mix of the same ``docs``.

    Copies follow the row (two hashes of all its columns), not its doc_id. Equal rows cannot be told
    apart, so any of them takes the copies of any other: as many are repeated once, and twice, as in
    the mix.
    """
    some = [F.count_if(F.col("copies") >= c).alias(f"with_{c}") for c in range(1, MOST + 1)]
    per = landed(mixed.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"), *some).where("with_1 > 0"), "copies")
    k1, k2 = row_keys(docs)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), k1.alias("k1"), k2.alias("k2"))
    alone, equal = per.where("n = 1"), per.where("n > 1").drop("n")
    copies = sum((F.when(F.col("nth") < F.col(f"with_{c}"), 1).otherwise(0) for c in range(1, MOST + 1)), F.lit(0)).alias("copies")
    out = keyed.join(small_or_shuffled(alone), ["k1", "k2"]).withColumn("nth", F.lit(0)).select("record", copies)
    if not equal.isEmpty():
        rows = landed(keyed.join(small_or_shuffled(equal.select("k1", "k2")), ["k1", "k2"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated")
        out = out.unionByName(numbered(rows).join(small_or_shuffled(equal), ["k1", "k2"]).select("record", copies)).where("copies > 0")
    return out.select("record", F.explode(F.sequence(F.lit(1), "copies"))).select("record.*")
