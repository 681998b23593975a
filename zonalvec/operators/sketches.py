"""Percentiles of zones from stored sketches that merge: unions of zones and arriving batches need no pixels.

A sketch (KLL, Spark's own) holds some 3 k values of a zone and band at most, whatever its size. Up to k values are kept as they are,
so percentiles of small zones are exact values of the zone; beyond that a value's rank is off by about 2.4 / k**0.94 of the size with 99 %
confidence (0.1 % for the default k), also after merging. ``exact`` takes the sketches as brackets and finds the values themselves by one
more scan, in which only the few values within a bracket are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .pool import PERCENTILES

K = 4096
#: Brackets of exact percentiles: so many times the sketch's error of 99 % to either side.
WIDE = 4


def sketched(rows: DataFrame, keys: tuple[str, ...] = ("patch_id",), k: int = K) -> DataFrame:
    """Long rows -> (keys, band, d, nans, sketch). Nulls are left out; NaN are counted, as one makes a zone's percentiles NaN."""
    v = F.col("v").cast("double")
    nan = F.coalesce(F.isnan(v), F.lit(False))
    return rows.groupBy(*keys, "band").agg(F.max("d").alias("d"), F.sum(nan.cast("long")).alias("nans"), F.kll_sketch_agg_double(F.when(~nan, v), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: tuple[str, ...] = ("patch_id",), k: int = K) -> DataFrame:
    """Sketches of parts or zones -> one a key and band: of batches that arrived, or of all zones of a region."""
    return sketches.groupBy(*keys, "band").agg(F.max("d").alias("d"), F.sum("nans").alias("nans"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def percentiles(sketches: DataFrame, keys: tuple[str, ...] = ("patch_id",), of: Iterable[float] = PERCENTILES) -> DataFrame:
    """(keys, ord, value), block-major: of each percentile the least value whose share of values up to it is no smaller. Null for no value."""
    shares = [q / 100.0 for q in of]
    n = F.kll_sketch_get_n_double("sketch")
    found = F.when(F.col("nans") > 0, F.array_repeat(F.lit(float("nan")), len(shares))).when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares))))
    cells = F.posexplode(F.coalesce(found, F.array_repeat(F.lit(None).cast("double"), len(shares))))
    return sketches.select(*keys, "band", "d", cells.alias("_i", "value")).select(*keys, (F.col("_i") * F.col("d") + F.col("band")).cast("int").alias("ord"), "value")


def _rank(n, q: float):
    """Place from 1 of the least value whose share of values up to it is no smaller than q percent, in whole numbers."""
    whole, ten = Fraction(str(q)), 100
    return F.greatest(F.lit(1).cast("long"), F.expr(f"({n} * {whole.numerator} + {whole.denominator * ten - 1}) div {whole.denominator * ten}"))


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joined on names, of which null ones are equal too; the left side's are kept."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    on = F.lit(True)
    for c in names:
        on = on & left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(other, on, how).drop(*[f"_r_{c}" for c in names])


def exact(rows: DataFrame, sketches: DataFrame, keys: tuple[str, ...] = ("patch_id",), of: Iterable[float] = PERCENTILES, k: int = K) -> DataFrame:
    """What ``percentiles`` gives, with no error: of long ``rows`` and their ``sketches`` (of size k).

    Each percentile lies between two values of its sketch, some errors below and above its share. A scan counts the values below the bracket and those of
    each different value within it, before anything is exchanged; the value at the wanted place is the percentile. A bracket that misses the place,
    which is a matter of chance, is widened to all values of its zone and band.
    """
    of, names = list(of), [*keys, "band"]
    slack = min(1.0, WIDE * 2.4 / k**0.94)
    n = F.kll_sketch_get_n_double("sketch")
    ends = [(max(0.0, q / 100.0 - slack), min(1.0, q / 100.0 + slack)) for q in of]
    at = F.array(*[F.lit(x) for pair in ends for x in pair])
    sized = sketches.select(*names, "d", "nans", n.alias("n"), F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", at)).alias("_ends"))
    wanted = F.posexplode(F.array(*[F.struct(F.get("_ends", F.lit(2 * i)).alias("low"), F.get("_ends", F.lit(2 * i + 1)).alias("high"), _rank("n", q).alias("place")) for i, q in enumerate(of)]))
    asked = written(sized.select(*names, "d", "nans", "n", wanted.alias("_i", "_q")).select(*names, "d", "nans", "n", "_i", "_q.*"), "brackets")
    values = rows.select(*names, F.col("v").cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))

    def found(brackets: DataFrame) -> DataFrame:
        """(names, _i, value): null where the place is not within the bracket."""
        own = brackets.groupBy(*names).agg(F.collect_list(F.struct("_i", "low", "high", "place")).alias("_b"))  # one entry a percentile
        seen = _joined(values, own, names).select(*names, "v", F.explode("_b").alias("b")).filter("v <= b.high")
        # What lies below the bracket is one number a percentile: its place is that of the bracket's low end, as null.
        counted = seen.groupBy(*names, F.col("b._i").alias("_i"), F.col("b.place").alias("place"), F.when(F.col("v") >= F.col("b.low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        until = F.sum("c").over(Window.partitionBy(*names, "_i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = counted.withColumn("_until", until).filter((F.col("_until") >= F.col("place")) & (F.col("_until") - F.col("c") < F.col("place")))
        return hit.select(*names, "_i", F.col("v").alias("value")).filter(F.col("value").isNotNull())

    whole = asked.filter("nans = 0 AND n > 0")
    first = written(found(whole), "percentiles")
    missed = written(_joined(whole, first, [*names, "_i"], "left_anti").withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))}), "missed")
    if not missed.isEmpty():
        first = written(first.unionByName(found(missed)), "percentiles", instead_of=first)
    value = F.when(F.col("nans") > 0, F.lit(float("nan"))).otherwise(F.col("value"))
    out = _joined(asked, first, [*names, "_i"], "left")
    return out.select(*keys, (F.col("_i") * F.col("d") + F.col("band")).cast("int").alias("ord"), value.alias("value"))
