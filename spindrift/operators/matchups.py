"""Statistics of matchups of a product with validation data, and the metrics they are coloured by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Z = 1.959963984540054
#: Student's two-sided 95 % quantile for 1 to 30 degrees of freedom.
T95 = [
    12.706204736432095, 4.302652729911275, 3.182446305284263, 2.776445105197793, 2.570581835636314, 2.446911851144969, 2.364624251592785, 2.306004135204166, 2.262157162854099, 2.228138851964939,
    2.200985160082949, 2.178812829663418, 2.160368656461013, 2.144786687916927, 2.131449545559323, 2.119905299221011, 2.109815577833181, 2.100922040240960, 2.093024054408263, 2.085963447265837,
    2.079613844727662, 2.073873067904015, 2.068657610419041, 2.063898561628021, 2.059538552753294, 2.055529438642871, 2.051830516480283, 2.048407141795244, 2.045229642132703, 2.042272456301238,
]
#: Beyond these the quantile is _Z plus these over the powers of the degrees of freedom, to seven digits.
_BEYOND = [(_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160]


def t95(freedom: Column) -> Column:
    """Student's two-sided 95 % quantile; null without a degree of freedom."""
    far = F.lit(_Z)
    for k, x in enumerate(_BEYOND):
        far = far + x / F.pow(freedom, F.lit(k + 1))
    near = F.get(F.array(*(F.lit(t) for t in T95)), (freedom - 1).cast("int"))
    return F.when(freedom < 1, F.lit(None)).when(freedom <= len(T95), near).otherwise(far)


def regression(df: DataFrame, keys: list[str], sides: dict[str, tuple[str, str]]) -> DataFrame:
    """keys and, for each name with its (validation, product) columns: n, slope a, intercept b, correlation r and the 95 % half-widths of a and b.

    The product is regressed on the validation. Pairs with a null are left out; a half-width is null below one degree of freedom.
    """
    c = F.col
    sums = []
    for name, (x, y) in sides.items():
        both = c(x).isNotNull() & c(y).isNotNull()
        u, v = F.when(both, c(x)), F.when(both, c(y))
        sums += [F.count(u).alias(f"{name}_n"), F.regr_slope(v, u).alias(f"{name}_a"), F.regr_intercept(v, u).alias(f"{name}_b"), F.corr(u, v).alias(f"{name}_r"), F.var_pop(u).alias(f"{name}_vx"), F.var_pop(v).alias(f"{name}_vy"), F.avg(u).alias(f"{name}_mx")]
    got = df.groupBy(*keys).agg(*sums)
    out = [c(k) for k in keys]
    for name in sides:
        n, r, vx, vy, mx = (c(f"{name}_{p}") for p in ("n", "r", "vx", "vy", "mx"))
        # of the residuals; nothing is left of them where the correlation is 1 but for rounding
        width = t95(n - 2) * F.sqrt(F.try_divide(F.greatest(1 - r * r, F.lit(0.0)) * vy, vx * (n - 2)))
        out += [*(c(f"{name}_{p}") for p in ("n", "a", "b", "r")), width.alias(f"{name}_a95"), (width * F.sqrt(vx + mx * mx)).alias(f"{name}_b95")]
    return got.select(*out)


#: Colours of labels.
SOURCES = {"gps": "red", "argos": "blue", "irid": "green", "gcp": "orange"}


def colours(label: Column, table: dict[str, str] = SOURCES) -> Column:
    """The colour of a label that holds a name of the table, whatever its case; the last such name counts, black is for none."""
    out = F.lit("black")
    for name, colour in table.items():
        out = F.when(F.lower(label) == name.lower(), colour).otherwise(out)
    return out


def elapsed(t: Column, first: Column, last: Column) -> Column:
    """The part of a period that has passed at a time: from the begin of its first day to the end of its last."""
    seconds = lambda x: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x) / 1e6
    begin, end = seconds(first.cast("date").cast("timestamp_ntz")), seconds(F.date_add(last.cast("date"), 1).cast("timestamp_ntz"))
    return (seconds(t) - begin) / (end - begin)
