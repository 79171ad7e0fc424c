"""Number expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The moods of a track, in the order of its mood vector.
MOODS = ("danceable", "aggressive", "happy", "party", "relaxed", "sad")


def finite(x: Column) -> Column:
    """The number, or NULL if it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def whole(text: Column) -> Column:
    """A number's text cut to an integer; NULL if it is none."""
    return finite(text.try_cast("double")).try_cast("bigint")


def duration_ms(ticks: Column, ms: Column, seconds: Column) -> Column:
    """Milliseconds from ticks of 100 ns, else from milliseconds, else from seconds (half to even); never negative."""
    from_seconds = F.bround(finite(seconds) * 1000, 0).try_cast("bigint")
    known = F.coalesce(F.floor(ticks / 10_000).cast("bigint"), ms.cast("bigint"), from_seconds)
    return F.when(known.isNotNull(), F.greatest(F.lit(0).cast("bigint"), known))


def energy(x: Column) -> Column:
    """Raw energy on a scale from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - 0.01) / 0.14))


def within_one(x: Column) -> Column:
    """A distance cut to 0..1; 1 if it is NaN or infinite."""
    return F.when(finite(x).isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def features(text: Column) -> Column:
    """name:number,... as a map; pairs without a finite number left out, names trimmed, the last of a name counts."""
    number = lambda p: F.when(p.contains(":"), finite(F.regexp_replace(p, "^[^:]*:", "").try_cast("double")))
    pairs = F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), number(p).alias("v")))
    kept = F.filter(pairs, lambda p: p["v"].isNotNull())
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def mood_vector(moods: Column, other: Column) -> Column:
    """The numbers of MOODS: from the other features, else from the moods, else 0."""
    a, b = features(other), features(moods)
    return F.array(*[F.coalesce(F.try_element_at(a, F.lit(m)), F.try_element_at(b, F.lit(m)), F.lit(0.0)) for m in MOODS])


def interval(low: Column, high: Column, q1: Column, q3: Column) -> tuple[Column, Column]:
    """The middle half, or the whole range if the quartiles are both 0."""
    flat = (q1 == 0) & (q3 == 0)
    return F.when(flat, low).otherwise(q1), F.when(flat, high).otherwise(q3)


def interval_distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """0 for an empty side; between points their difference; between apart intervals the gap; else 1 - overlap / span."""
    (a0, a1), (b0, b1) = a, b
    span = F.greatest(a1, b1) - F.least(a0, b0)
    gap, overlap = F.greatest(a0, b0) - F.least(a1, b1), F.least(a1, b1) - F.greatest(a0, b0)
    return (
        F.when(((a0 == 0) & (a1 == 0)) | ((b0 == 0) & (b1 == 0)), F.lit(0.0))
        .when((a0 == a1) & (b0 == b1), within_one(F.abs(a0 - b0)))
        .when(gap > 0, within_one(gap))
        .when(span <= 0, F.lit(0.0))
        .otherwise(within_one(1 - overlap / F.when(span > 0, span)))
    )


def range_stats(x: Column) -> list[Column]:
    """Aggregates low, high, mean, q1, q3 (linear quantiles); 0 for no value."""
    zero = F.lit(0.0)
    quantile = lambda p: F.coalesce(F.percentile(x, F.lit(p)), zero)
    return [F.coalesce(F.min(x), zero).alias("low"), F.coalesce(F.max(x), zero).alias("high"), F.coalesce(F.avg(x), zero).alias("mean"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3")]
