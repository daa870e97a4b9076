"""Column values and data skipping: ordinals, multi-values, masks, slices, granules, marks and bloom filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

GRANULE = 8192


def ordinals(df: DataFrame, column: str) -> DataFrame:
    """The dictionary of a column: each distinct value with its ordinal from 0, in code point order.

    Values are sorted over ranges; each range numbers its own, and the sizes of the ranges before, one row each, are
    broadcast, so no task gets all values.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    dealt = stored(values.repartitionByRange("value").withColumn("range", F.spark_partition_id()), "ordinals")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    numbered = dealt.withColumn("own", own).join(F.broadcast(sizes.select("range", ahead.alias("ahead"))), "range")
    return numbered.select(F.col("value").alias(column), (F.col("own") + F.col("ahead")).cast("long").alias("ord"))


def set_ordinals(df: DataFrame, key: str, values: str) -> tuple[DataFrame, DataFrame]:
    """A column of arrays as sorted sets of ordinals: (key, ords), empty for rows without values, and the dictionary."""
    each = df.select(key, F.explode_outer(F.array_distinct(values)).alias("value"))
    known = ordinals(each, "value")
    return each.join(known, "value", "left").groupBy(key).agg(F.array_sort(F.collect_list("ord")).alias("ords")), known


def lookup_ord(dictionary: DataFrame, ord: int) -> DataFrame:
    """The value of an ordinal, no row if there is none."""
    return dictionary.where(F.col("ord") == ord).drop("ord")


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def sorted_numeric(values: Column) -> Column:
    return F.array_sort(F.filter(values, lambda v: v.isNotNull()))


def bulk_get(df: DataFrame, key: str, column: str, ids: DataFrame) -> DataFrame:
    """Values as doubles for given ids (a DataFrame with the key), null where there is none."""
    return ids.join(df.select(key, F.col(column).cast("double").alias("value")), key, "left")


def masked(df: DataFrame, mask: str) -> DataFrame:
    return df.where(F.col(mask) != 0).drop(mask)


def cut(df: DataFrame, order: str, offset: int, length: int) -> DataFrame:
    """Rows offset to offset + length in the order of a column."""
    return df.orderBy(order).offset(offset).limit(length)


def compared(a: Column, b: Column, nan_direction: int = 1) -> Column:
    """-1, 0 or 1; NaN is above all numbers (1) or below (-1), and equal to itself."""
    x, y = F.isnan(a), F.isnan(b)
    one = F.when(x & y, 0).when(x, nan_direction).when(y, -nan_direction)
    return one.otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)).cast("int")


def running(df: DataFrame, order: str, value: Column, into: str = "before", parts: int = 64, *more: Column) -> DataFrame:
    """df with the sum of value over all rows that come before in the order of a numeric column (then of ``more``).

    Rows are dealt into ranges by approximate quantiles (``parts`` numbers at most, the only thing the driver gets); each
    range sums by itself, and the sums of the ranges before, one row each, are broadcast.
    """
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] or []
    bounds = sorted(set(bounds))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(order))) if bounds else F.lit(0)
    dealt = df.withColumn("__range", at).withColumn("__value", value)
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(order, *more).rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    ahead = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = F.broadcast(sums.select("__range", F.coalesce(ahead, F.lit(0)).alias("__ahead")))
    out = dealt.withColumn(into, F.coalesce(inside, F.lit(0))).join(sums, "__range")
    return out.withColumn(into, F.col(into) + F.col("__ahead")).drop("__range", "__value", "__ahead")


def with_granule(df: DataFrame, order: str, size: int = GRANULE) -> DataFrame:
    """df with each row's granule by its place in the order of a numeric column with distinct values."""
    return running(df, order, F.lit(1).cast("long"), "granule").withColumn("granule", F.floor(F.col("granule") / size).cast("long"))


def min_max(granules: DataFrame, column: str) -> DataFrame:
    """The min-max index: one row a granule."""
    return granules.groupBy("granule").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("rows"))


def may_hold(index: DataFrame, lower, upper) -> DataFrame:
    """Granules that a range can have rows in; 'inside' says that all their rows are."""
    return index.where((F.col("high") >= lower) & (F.col("low") <= upper)).withColumn("inside", (F.col("low") >= lower) & (F.col("high") <= upper))


def range_count(df: DataFrame, column: str, lower, upper, include_lower: bool = True, include_upper: bool = True) -> DataFrame:
    """Rows of a range. The filter reaches the Parquet scan, where row groups outside the range are skipped."""
    c = F.col(column)
    low = c >= lower if include_lower else c > lower
    return df.where(low & (c <= upper if include_upper else c < upper)).agg(F.count("*").alias("n"))


def adaptive_marks(df: DataFrame, order: str, bytes_of: Column, limit: int) -> DataFrame:
    """Marks where the running sum of bytes passes multiples of limit: mark, first place in order, rows."""
    rows = running(df, order, bytes_of.cast("long"), "__bytes").select(F.col(order).alias("at"), F.floor(F.col("__bytes") / limit).cast("long").alias("mark"))
    return rows.groupBy("mark").agg(F.min("at").alias("first"), F.count("*").alias("rows"))


def mark_of_row(row: Column, size: int = GRANULE) -> Column:
    """The mark that a row, by its place from 0, lies behind, with granules of equal size."""
    return F.floor(row / size).cast("long")


def rows_of_marks(first: Column, end: Column, rows: Column, size: int = GRANULE) -> Column:
    """How many rows lie in the marks from first to before end, of so many rows in all."""
    return (F.least(end * size, rows) - F.least(first * size, rows)).cast("long")


def mark_starts(marks: DataFrame) -> DataFrame:
    """What adaptive_marks gives, with the place of each mark's first row and the one past its last."""
    upto = F.sum("rows").over(Window.orderBy("mark"))  # a row a mark
    return marks.withColumn("end", upto).withColumn("start", F.col("end") - F.col("rows"))


def mark_ranges(marks: DataFrame) -> DataFrame:
    """Marks to read, joined to ranges of neighbours: first, and end, one past the last."""
    group = F.col("mark") - F.row_number().over(Window.orderBy("mark"))  # a row a mark
    return marks.select("mark").distinct().withColumn("g", group).groupBy("g").agg(F.min("mark").alias("first"), (F.max("mark") + 1).alias("end")).drop("g")


def bloom(df: DataFrame, column: str, bits: int = 1 << 16, hashes: int = 4, by: str | None = None) -> DataFrame:
    """A bloom filter of a column (for each value of ``by``): the sorted bits that are set. At most ``bits`` entries."""
    keys = [F.col(by)] if by else []
    spots = df.where(F.col(column).isNotNull()).select(*keys, F.explode(F.array(*[_spot(F.col(column), i, bits) for i in range(hashes)])).alias("bit")).distinct()
    return spots.groupBy(*keys).agg(F.array_sort(F.collect_list("bit")).alias("bits"))


def _spot(value: Column, i: int, bits: int) -> Column:
    """The ith bit of a value: the first 32 bits of the md5 of its text and i."""
    text = F.concat(value.cast("string"), F.lit(f":{i}"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % bits).cast("int")


def bloom_may_hold(bits: Column, value: Column, size: int = 1 << 16, hashes: int = 4) -> Column:
    out = F.lit(True)
    for i in range(hashes):
        out = out & F.array_contains(bits, _spot(value, i, size))
    return out


def bloom_granules(granules: DataFrame, conditions: dict[str, Iterable], size: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """The granules in which all conditions may hold: column -> the values that it may equal (one, or several).

    granules: rows with their granule. Each column has one filter a granule; a granule stays if the filter of each column
    may hold one of its values. No condition leaves all granules, one without values none.
    """
    left = granules.select("granule").distinct()
    for column, values in conditions.items():
        filters = bloom(granules, column, size, hashes, by="granule")
        may = reduce(lambda a, b: a | b, [bloom_may_hold(F.col("bits"), F.lit(v), size, hashes) for v in values], F.lit(False))
        left = left.join(filters.where(may).select("granule"), "granule", "left_semi")
    return left


def set_index(granules: DataFrame, column: str, most: int = 100) -> DataFrame:
    """Extension: the distinct values of each granule, null for more than ``most`` (such a granule is always read)."""
    values = F.array_sort(F.collect_set(column))
    return granules.groupBy("granule").agg(F.when(F.count_distinct(column) <= most, values).alias("held"))


def set_granules(index: DataFrame, values: Iterable) -> DataFrame:
    """The granules that may have a row with one of the values."""
    wanted = F.array(*[F.lit(v) for v in values])
    return index.where(F.col("held").isNull() | F.arrays_overlap("held", wanted)).select("granule")


def ngrams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, none if it is shorter; null has none."""
    last = F.coalesce(F.length(text), F.lit(0)) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_granules(granules: DataFrame, column: str, needle: str, n: int = 3, size: int = 1 << 16, hashes: int = 2) -> DataFrame:
    """Extension: the granules in which a text may hold a needle, by a bloom filter of n-grams for each; all, if the needle is
    shorter than an n-gram."""
    grams = sorted({needle[i : i + n] for i in range(len(needle) - n + 1)})
    every = granules.select("granule").distinct()
    if not grams:
        return every
    filters = bloom(granules.select("granule", F.explode(ngrams(F.col(column), n)).alias("gram")), "gram", size, hashes, by="granule")
    return filters.where(reduce(lambda a, b: a & b, [bloom_may_hold(F.col("bits"), F.lit(g), size, hashes) for g in grams])).select("granule")


def bloom_merge(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def bloom_false_positives(bits: Column, size: int = 1 << 16, hashes: int = 4) -> Column:
    """The estimated rate: the share of set bits to the power of the number of hashes."""
    return F.pow(F.size(bits) / F.lit(float(size)), F.lit(float(hashes)))


# --- columns that change: each gives a new DataFrame ------------------------------------------------------------------


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df and more rows, by column name; columns that these lack are null."""
    return df.unionByName(rows, allowMissingColumns=True).select(*[f"`{c}`" for c in df.columns])


def insert_range(df: DataFrame, rows: DataFrame, order: str, start: int, n: int) -> DataFrame:
    """df and n rows of others from place ``start`` in their order."""
    return insert(df, cut(rows, order, start, n))


def pop_back(df: DataFrame, order: str, n: int) -> DataFrame:
    """df without its last n rows in the order of a column of distinct values."""
    last = df.orderBy(F.col(order).desc()).limit(n).select(order)
    return df.join(last, order, "left_anti").select(*[f"`{c}`" for c in df.columns])


def resize(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in the order of a numeric column; rows that are missing follow it and are null elsewhere."""
    have = df.agg(F.count("*").alias("n"), F.max(order).alias("last")).first()
    if have["n"] >= n:
        return df.orderBy(order).limit(n)
    more = df.sparkSession.range(1, n - have["n"] + 1).select((F.col("id") + (have["last"] if have["last"] is not None else -1)).cast(df.schema[order].dataType).alias(order))
    return insert(df, more)
