"""Row clean-up: NULL filling, dropping, duplicates and surrogate keys."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ebbmark.functions.casts import finite
from ebbmark.functions.names import col, dtype_of
from ebbmark.operators.merge import hot_keys
from ebbmark.session import stage

MEDIAN_BUCKETS = 1024
#: Error of the quantile sketch (one in so many rows), and how far the brackets tried in turn reach from the middle, as shares of all rows.
SKETCH = 2_000
BRACKETS = (0.002, 0.05)
#: Values that the frequency sketch of a column tracks, and its error as a multiple of the rows per tracked value.
TRACKED, SKETCH_ERROR = 1000, 3.5
#: Types that the frequency sketch takes.
SKETCHED = (T.BooleanType, T.IntegralType, T.FractionalType, T.StringType, T.DateType, T.TimestampType)


# ---------------------------------------------------------------- rows

def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def drop_copies(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows (NULL equals NULL).

    Copies collapse before the shuffle, so a row repeated a billion times is sent once per task.
    """
    return df.distinct()


def keep_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the first by ``order_by`` (NULLs first), then by the whole row.

    The minimum of a struct combines before the shuffle; a window would bring all rows of a hot
    key to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order_by if c not in keys]
    first = F.min(F.struct(*[col(c) for c in ranked + [c for c in rest if c not in ranked]])).alias("_first")
    kept = df.groupBy(*[col(k) for k in keys]).agg(first)
    return kept.select(*[col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns])


def surrogate_key(df: DataFrame, key: str, order_by: list[str], total_order: bool = False) -> DataFrame:
    """Number the rows 1..n by ``order_by`` (NULLs last), the number as first column.

    A global ``row_number`` would sort everything in one task. Here the rows are range-sorted over
    all tasks and written once; the scan of that table knows each row's position in its file, so
    the number is that position plus the size of the files before it.

    Rows that tie could not be split over tasks. With ``total_order`` the caller promises there
    are none. Without it the rows are written as they come first, and the place a row got there
    breaks ties.
    """
    names = df.columns
    tie = []
    if not total_order:
        df = stage(df, "unkeyed").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        tie = ["_file", "_row"]
    order = [F.asc_nulls_last(col(c)) for c in [*order_by, *tie]]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*[col(c) for c in names])
    return _numbered(ranged, key)


def distinct_surrogate_key(df: DataFrame, key: str, order_by: list[str], written: bool = False) -> DataFrame:
    """The distinct rows of ``df`` numbered as by :func:`surrogate_key`; ``order_by`` names all columns.

    The range sort that numbers the rows brings equal ones together, so the rows move once for both. Only where some
    row fills a large share of the table (a sketch of row hashes tells), copies collapse in a shuffle of their own before.
    ``df`` is scanned several times, so it is written first, unless ``written`` says that it is a scan already.
    """
    names = df.columns
    if not written:
        df = stage(df, "unkeyed")
    if hot_keys(df.select(F.xxhash64(*[col(c) for c in names]).alias("row")), "row"):
        df = drop_copies(df)
    return _numbered(_sorted_distinct(df, order_by), key)


def _sorted_distinct(df: DataFrame, order_by: list[str]) -> DataFrame:
    """The distinct rows, sorted over all tasks by ``order_by``, all columns: equal rows meet in the one range shuffle."""
    order = [F.asc_nulls_last(col(c)) for c in order_by]
    return drop_copies(df.repartitionByRange(*order)).sortWithinPartitions(*order)


def _numbered(ranged: DataFrame, key: str) -> DataFrame:
    """Rows that are sorted over all tasks, with their number as first column."""
    names = ranged.columns
    rows = stage(ranged, "keyed").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    # One row per written file; the scan reads no data column for it. File names carry the number
    # of the task and, where a task wrote several files, their count.
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    number = [F.regexp_extract("_file", pattern, 1).cast("bigint") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    before = W.orderBy(*number).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # sent to every task, being one row per file: a shuffle by file name would move the whole table
    numbered = rows.join(F.broadcast(starts), "_file")
    return numbered.select((F.col("_start") + F.col("_row") + 1).cast("bigint").alias(key), *[col(c) for c in names])


# ---------------------------------------------------------------- NULL filling

class Fill(Enum):
    """What fills the NULLs of a column."""

    MEAN = "mean"
    MEDIAN = "median"
    MODE = "mode"
    ZERO = "zero"
    TEXT = "unknown"

    @classmethod
    def of_rule(cls, logic: str | None) -> Fill:
        """The filling that a rule's logic names, with or without ``fill:`` before it; anything else fills a text."""
        words = (logic or "").lower().split()
        name = words[1] if len(words) == 2 and words[0] == "fill:" else words[0].removeprefix("fill:") if len(words) == 1 else ""
        return cls.ZERO if name == "0" else next((f for f in cls if f.value == name), cls.TEXT)


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    means = [F.avg(finite(col(c).cast("double"))).alias(str(i)) for i, c in enumerate(columns)]
    return dict(zip(columns, df.agg(*means).first()))


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value of each column, the smallest of equals; None for a column without values.

    One scan keeps a frequency sketch per column and names the values that can be the most frequent; a second
    one counts only these, so no other value is shuffled. The sketch misses no value that stands in more than twice
    its error of the rows. Where the exact counts do not pass that, and for types it does not take, every value is counted.
    """
    if not columns:
        return {}
    values = {c: _comparable(col(c), dtype_of(df, c)) for c in columns}
    rows, named = _frequent(df, {c: v for c, v in values.items() if isinstance(dtype_of(df, c), SKETCHED)})
    likely = {c: F.when(values[c].isin(found), values[c]) for c, found in named.items()}
    proven = {c: (v, n) for c, (v, n) in _counted_modes(df, likely).items() if n * TRACKED > 2 * SKETCH_ERROR * rows}
    rest = {c: v for c, v in values.items() if c not in proven}
    found = proven | _counted_modes(df, rest)
    return {c: found.get(c, (None, 0))[0] for c in columns}


def _comparable(value: Column, dtype: T.DataType) -> Column:
    """NaN is missing, and both zeros are one value."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value + F.lit(0.0).cast(dtype))
    return value


def _frequent(df: DataFrame, values: dict[str, Column]) -> tuple[int, dict[str, list]]:
    """The rows of ``df``, and by column the values that can be its most frequent one.

    Left out are columns in which no value stands often enough for the sketch to prove anything. What is named is few:
    each value holds a share of the rows that only some hundred others can hold as well.
    """
    if not values:
        return 0, {}
    tops = [F.call_function("approx_top_k", v, F.lit(TRACKED), F.lit(TRACKED)).alias(f"top{i}") for i, v in enumerate(values.values())]
    sketched = df.agg(F.count(F.lit(1)).alias("rows"), *tops).first()
    error = SKETCH_ERROR * sketched.rows / TRACKED
    named = {}
    for i, c in enumerate(values):
        top = [(x["item"], x["count"]) for x in sketched[f"top{i}"] or () if x["item"] is not None]
        most = max((n for _, n in top), default=0)
        likely = [v for v, n in top if n >= most - error]
        # a full list may have lost values that were seen less often than all in it
        if most > 2 * error and (len(likely) < len(top) or len(top) < TRACKED - 1):
            named[c] = likely
    return sketched.rows, named


def _counted_modes(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[object, int]]:
    """The most frequent value of each expression and its count, in one pass; expressions without values have none.

    Counting per value spreads over all tasks; the built-in ``mode`` keeps every value in one.
    """
    if not values:
        return {}
    kinds = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())]).schema

    def cell(i: int, value: Column) -> Column:
        """The value in its own field, so that columns of any types share a table."""
        fields = [(value if i == j else F.lit(None).cast(kind.dataType)).alias(kind.name) for j, kind in enumerate(kinds)]
        return F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), F.struct(*fields).alias("v")))

    every = F.array(*[cell(i, v) for i, v in enumerate(values.values())])
    cells = df.select(F.explode(F.array_compact(every)).alias("cell")).select("cell.*")
    counts = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(-F.col("n"), F.col("v"))
    tops = {r.i: r for r in counts.groupBy("i").agg(F.min_by("v", first).alias("v"), F.max("n").alias("n")).collect()}
    return {c: (tops[i].v[f"v{i}"], tops[i].n) for i, c in enumerate(values) if i in tops}


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians in two scans of the data, however many columns; no values of a column gather in one task.

    The first scan keeps a quantile sketch per column, whose values around the middle are a bracket. The second one counts what
    lies below the bracket and how often each value in it stands. If these exact counts show that a bracket
    misses a middle row, it is widened and counted again. What is left is done on the written counts: each pass splits the
    range that still holds the middle rows into a fixed number of buckets, so the driver gets at most ``MEDIAN_BUCKETS`` small
    rows per column, whatever the data size.
    """
    if not columns:
        return {}
    value = {c: finite(col(c).cast("double")) for c in columns}
    sketched = df.agg(*[
        F.struct(F.count(value[c]).alias("n"), F.percentile_approx(value[c], [0.5 - w for w in BRACKETS] + [0.5 + w for w in BRACKETS], SKETCH).alias("at")).alias(str(i))
        for i, c in enumerate(columns)
    ]).first()
    medians: dict[str, float | None] = {c: None for c, found in zip(columns, sketched) if not found.n}
    # the last bracket is the whole line
    brackets = {c: [*zip(found.at, found.at[len(BRACKETS):]), (None, None)] for c, found in zip(columns, sketched) if found.n}
    rows = {c: found.n for c, found in zip(columns, sketched)}
    while brackets:
        counts = stage(_bracket_counts(df, value, {c: ends[0] for c, ends in brackets.items()}), "median-counts")
        inside = F.col("v").isNotNull()
        sides = counts.groupBy("column").agg(
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("below"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("within"),
            F.min("v").alias("lo"), F.max("v").alias("hi"),
        )
        # column -> (lowest and highest value still possible, rank of the lower middle row among them, whether there are two)
        open_ranges = {}
        for side in sides.collect():
            n = rows[side.column]
            lower, upper = (n - 1) // 2, n // 2
            if not side.below <= lower or not upper < side.below + side.within:
                brackets[side.column].pop(0)
                continue
            del brackets[side.column]
            if side.lo == side.hi:
                medians[side.column] = side.lo
            else:
                open_ranges[side.column] = (side.lo, side.hi, lower - side.below, n % 2 == 0)
        while open_ranges:
            cells: dict[str, list] = {c: [] for c in open_ranges}
            for row in _bucket_counts(counts, open_ranges).collect():
                cells[row.column].append(row)
            for c, (_, _, rank, even) in list(open_ranges.items()):
                found = _locate(sorted(cells[c], key=lambda r: r.bucket), rank, even)
                if isinstance(found, float):
                    medians[c] = found
                    del open_ranges[c]
                else:
                    open_ranges[c] = (*found, even)
    return medians


def _bracket_counts(df: DataFrame, value: dict[str, Column], brackets: dict) -> DataFrame:
    """``column, v, n``: how often each value of a bracket stands, and, without a value, how many lie below it."""
    cells = []
    for c, (lo, hi) in brackets.items():
        below = F.lit(False) if lo is None else value[c] < lo
        up_to = value[c].isNotNull() if hi is None else value[c] <= hi
        cells.append(F.when(up_to, F.struct(F.lit(c).alias("column"), F.when(~below, value[c]).alias("v"))))
    flat = df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*")
    return flat.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))


def _magnitude(value: Column) -> Column:
    """An order-keeping measure of a double that grows with the logarithm of its size, on both sides of 0.

    1080 is above the logarithm's distance from 0 for the smallest double, 2^-1074.
    """
    size = F.log2(F.abs(value)) + 1080
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size)


def _bucket_counts(counts: DataFrame, ranges: dict) -> DataFrame:
    bucket = F.lit(None).cast("int")
    v = F.col("v")
    for c, (lo, hi, _, _) in ranges.items():
        narrow = lo > 0 and hi / 16 <= lo or hi < 0 and lo / 16 >= hi
        place, least, most = (f(x) for f in ((lambda x: x) if narrow else _magnitude,) for x in (v, F.lit(lo), F.lit(hi)))
        at = F.floor((place - least) / (most - least) * MEDIAN_BUCKETS).cast("int")
        at = F.least(F.greatest(at, F.lit(0)), F.lit(MEDIAN_BUCKETS - 1))
        bucket = F.when((F.col("column") == c) & v.between(lo, hi), at).otherwise(bucket)
    placed = counts.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    return placed.groupBy("column", "bucket").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _locate(cells: list, rank: int, even: bool):
    """The median, or the (lo, hi, rank) of the bucket it lies in."""
    for i, cell in enumerate(cells):
        if rank < cell.n:
            break
        rank -= cell.n
    if cell.lo == cell.hi:
        upper = cell.lo if not even or rank + 1 < cell.n else cells[i + 1].lo
        return cell.lo if upper == cell.lo else (cell.lo + upper) / 2
    if even and rank + 1 == cell.n:  # the two middle rows lie in different buckets
        return (cell.hi + cells[i + 1].lo) / 2
    return cell.lo, cell.hi, rank


def fill_nulls(df: DataFrame, logic: dict[str, str]) -> DataFrame:
    """Fill the NULLs of each named column by its logic."""
    fills = dict(zip(logic, fill_columns(df, [(c, Fill.of_rule(text)) for c, text in logic.items()])))
    return df.select(*[fills[c].alias(c) if c in fills else col(c) for c in df.columns])


def fill_columns(df: DataFrame, wanted: list[tuple[str, Fill]]) -> list[Column]:
    """The filled form of each (column, filling) pair; the statistics come from ``df`` as it is.

    Only one number or text per column reaches the driver, where it becomes a literal of the plan.
    """
    fills = [(c, _usable(c, dtype_of(df, c), fill)) for c, fill in wanted]
    statistics = {
        fill: compute(df, list(dict.fromkeys(c for c, f in fills if f is fill)))
        for fill, compute in ((Fill.MEAN, column_means), (Fill.MEDIAN, column_medians), (Fill.MODE, column_modes))
    }
    return [_filled(col(c), dtype_of(df, c), f, statistics.get(f, {}).get(c)) for c, f in fills]


def _usable(column: str, dtype: T.DataType, fill: Fill) -> Fill:
    numeric = isinstance(dtype, (T.NumericType, T.BooleanType))
    if fill is Fill.MODE or (numeric and fill is not Fill.TEXT):
        return fill
    if not isinstance(dtype, T.StringType):
        raise ValueError(f"Column '{column}' is {dtype.simpleString()} and cannot be filled with the text 'unknown'")
    return Fill.TEXT


def _filled(value: Column, dtype: T.DataType, fill: Fill, statistic) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    if fill in (Fill.MEAN, Fill.MEDIAN):
        return F.coalesce(value.cast("double"), F.lit(statistic).cast("double"))
    if fill is Fill.ZERO:
        return F.coalesce(value, F.lit(0).cast(dtype))
    if fill is Fill.MODE:
        if statistic is None and isinstance(dtype, T.StringType):
            statistic = Fill.TEXT.value
        return F.coalesce(value, F.lit(statistic).cast(dtype))
    return F.coalesce(value, F.lit(Fill.TEXT.value))
