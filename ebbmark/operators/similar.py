"""Similar names: an index over characters names the pairs that can be alike, and their matching blocks decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def characters(name: Column) -> Column:
    """The characters of a name, the second ``o`` as ``o2`` and so on, so that what two names share is a plain intersection."""

    def numbered(at: Column) -> Column:
        before, letter = F.substring(name, F.lit(1), at), F.substring(name, at, F.lit(1))
        return F.concat(letter, (F.length(before) - F.length(F.replace(before, letter, F.lit("")))).cast("string"))

    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), numbered)).otherwise(F.array().cast("array<string>"))


# The longest block of ``x.a`` that ``x.b`` holds, the first of equals: each step makes the block longer or begins it one later.
_LONGEST = """aggregate(sequence(1, 2 * length(x.a)), named_struct('i', 1, 'n', 0, 'at', 1),
  (m, k) -> CASE WHEN m.i + m.n <= length(x.a) AND contains(x.b, substring(x.a, m.i, m.n + 1))
            THEN named_struct('i', m.i, 'n', m.n + 1, 'at', m.i) ELSE named_struct('i', m.i + 1, 'n', m.n, 'at', m.at) END)"""
# One step takes the last open pair of stretches, counts its longest block, and leaves the pairs before and behind it open.
_STEP = f"""element_at(flatten(transform(slice(acc.open, -1, 1), x -> transform(array({_LONGEST}), m -> transform(
    array(locate(substring(x.a, m.at, m.n), x.b)), j -> named_struct('total', acc.total + m.n, 'open',
      concat(slice(acc.open, 1, size(acc.open) - 1), filter(array(
        named_struct('a', substring(x.a, 1, m.at - 1), 'b', substring(x.b, 1, j - 1)),
        named_struct('a', substring(x.a, m.at + m.n), 'b', substring(x.b, j + m.n))), p -> m.n > 0 AND p.a <> '' AND p.b <> '')))))[0])), 1)"""


def matching_characters(a: str, b: str) -> Column:
    """How many characters of column ``a`` lie in its matching blocks with column ``b``.

    The blocks are the longest common one, then the longest ones on its left and on its right, and so on.
    """
    steps = f"sequence(1, 2 * least(length({a}), length({b})) + 1)"
    start = f"named_struct('total', 0, 'open', array(named_struct('a', {a}, 'b', {b})))"
    return F.expr(f"aggregate({steps}, {start}, (acc, k) -> CASE WHEN size(acc.open) = 0 THEN acc ELSE {_STEP} END, acc -> acc.total)")


def most_similar(names: DataFrame, candidates: list[str], cutoff: float) -> DataFrame:
    """``wanted, similar, ratio`` of the names in column ``wanted`` that some candidate is like; names are distinct.

    The ratio is twice the matching characters by both lengths. It needs so many shared characters that two names
    share one of their rarest; an index joins on these, the exact number of shared characters bounds the ratio, and only the pairs
    left are compared. Equal ratios go to the candidate that sorts last.
    """
    spark = names.sparkSession
    held = spark.createDataFrame([(c,) for c in candidates if c], "candidate string").select("candidate", characters(F.col("candidate")).alias("x"))
    wanted = names.where(F.length("wanted") > 0).select("wanted", characters(F.col("wanted")).alias("y"))
    rarity = {r.c: r.n for r in held.select(F.explode("x").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.create_map(*(F.lit(v) for pair in rarity.items() for v in pair)) if rarity else F.create_map(F.lit(""), F.lit(0))
    # a name of n characters shares at least n * cutoff / (2 - cutoff) with any name it is like
    part = min(1.0, max(0.0, cutoff / (2 - cutoff)))

    def rarest(own: str) -> Column:
        least = F.greatest(F.lit(1), F.ceil(F.size(own) * part - F.lit(1e-9)).cast("int"))
        sorted_ = F.array_sort(F.transform(own, lambda c: F.struct(F.coalesce(order[c], F.lit(0)).alias("n"), c.alias("c"))))
        return F.explode(F.slice(sorted_, F.lit(1), F.size(own) - least + 1))

    left = wanted.select("wanted", "y", rarest("y").alias("key")).select("wanted", "y", "key.c")
    right = held.select("candidate", "x", rarest("x").alias("key")).select("candidate", "x", "key.c")
    both = F.size("x") + F.size("y")
    pairs = left.join(right, "c").drop("c").distinct().where(2.0 * F.size(F.array_intersect("x", "y")) / both >= cutoff)
    rated = pairs.select("wanted", "candidate", (2.0 * matching_characters("candidate", "wanted") / both).alias("ratio")).where(F.col("ratio") >= cutoff)
    best = rated.groupBy("wanted").agg(F.max(F.struct("ratio", "candidate")).alias("best"))
    return best.select("wanted", F.col("best.candidate").alias("similar"), F.col("best.ratio").alias("ratio"))
