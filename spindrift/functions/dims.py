"""Dimension tables of flags, grids, instruments and uncertainties, as small DataFrames and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flag of processing -> flag of the final product.
FINAL_FLAG = {0: 30, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 0, 7: 0, 8: 10, 9: 10, 10: 11, 11: 0, 12: 13, 13: 21, 14: 12, 15: 4, 16: 22, 17: 20, 18: 0, 19: 23, 20: 5, 21: 24, 22: 25}
VALID, NO_FILL, REMOVED = (0, 13, 17), (1, 2, 3, 4, 5, 20), 100
#: Fixed values: (area, product, season, flag, km).
SIGMAS = [
    ("nh", "amsr", "winter", 0, 1.7), ("nh", "amsr", "winter", 13, 8.1), ("nh", "amsr", "winter", 17, 3.3),
    ("nh", "ssmi", "winter", 0, 2.3), ("nh", "ssmi", "winter", 13, 8.0), ("nh", "ssmi", "winter", 17, 3.7),
    ("nh", "wind", "summer", 0, 2.6), ("nh", "wind", "summer", 19, 1.8), ("nh", "wind", "autumn", 0, 2.9), ("nh", "wind", "autumn", 19, 2.9),
    ("nh", "wind", "winter", 0, 2.7), ("nh", "wind", "winter", 19, 2.7), ("nh", "wind", "spring", 0, 2.3), ("nh", "wind", "spring", 19, 2.3),
    ("nh", "multi", "all", 0, 2.4), ("nh", "multi", "all", 16, 3.2),
    ("sh", "amsr", "winter", 0, 2.8), ("sh", "amsr", "winter", 13, 8.3), ("sh", "amsr", "winter", 17, 5.3),
    ("sh", "ssmi", "winter", 0, 3.6), ("sh", "ssmi", "winter", 13, 8.7), ("sh", "ssmi", "winter", 17, 6.2),
    ("sh", "wind", "summer", 0, 3.0), ("sh", "wind", "summer", 19, 5.2), ("sh", "wind", "autumn", 0, 3.0), ("sh", "wind", "autumn", 19, 3.0),
    ("sh", "wind", "winter", 0, 3.0), ("sh", "wind", "winter", 19, 3.8), ("sh", "wind", "spring", 0, 3.0), ("sh", "wind", "spring", 19, 3.7),
    ("sh", "multi", "all", 0, 3.8), ("sh", "multi", "all", 16, 6.9),
]
#: Fixed values of near-real time: (area, product, season, km under flag 0, 13 and 17); wind has flags 0 and 19.
NEAR_REAL_TIME = [
    ("nh", "amsr2-gw1-bt37", "winter", 2.1, 9.0, 5.0), ("nh", "amsr2-gw1-bt37", "summer", 7.5, 100.0, 100.0), ("nh", "amsr2-gw1-bt19", "winter", 2.5, 9.0, 5.0), ("nh", "amsr2-gw1-bt19", "summer", 5.0, 100.0, 100.0),
    ("nh", "amsr-aqua-bt37", "winter", 2.5, 9.0, 5.0), ("nh", "amsr-aqua-bt37", "summer", 8.5, 100.0, 100.0), ("nh", "amsr-aqua-bt19", "winter", 3.0, 9.0, 5.0), ("nh", "amsr-aqua-bt19", "summer", 6.0, 100.0, 100.0),
    ("nh", "ssmi", "winter", 3.5, 9.0, 5.0), ("nh", "ssmi", "summer", 100.0, 100.0, 100.0), ("nh", "ascat", "winter", 3.9, 9.0, 5.0), ("nh", "ascat", "summer", 100.0, 100.0, 100.0), ("nh", "wind", "winter", 3.0, 3.0), ("nh", "wind", "summer", 5.0, 5.0),
    ("sh", "amsr2-gw1-bt37", "winter", 2.7, 9.0, 5.0), ("sh", "amsr2-gw1-bt37", "summer", 9.8, 100.0, 100.0), ("sh", "amsr2-gw1-bt19", "winter", 3.0, 9.0, 5.0), ("sh", "amsr2-gw1-bt19", "summer", 6.0, 100.0, 100.0),
    ("sh", "amsr-aqua-bt37", "winter", 3.25, 9.0, 5.0), ("sh", "amsr-aqua-bt37", "summer", 11.05, 100.0, 100.0), ("sh", "amsr-aqua-bt19", "winter", 3.6, 9.0, 5.0), ("sh", "amsr-aqua-bt19", "summer", 7.2, 100.0, 100.0),
    ("sh", "ssmi", "winter", 5.3, 9.0, 5.0), ("sh", "ssmi", "summer", 100.0, 100.0, 100.0), ("sh", "ascat", "winter", 3.1, 9.0, 5.0), ("sh", "ascat", "summer", 100.0, 100.0, 100.0), ("sh", "wind", "winter", 3.0, 3.0), ("sh", "wind", "summer", 5.0, 5.0),
]
#: Quadratic, linear and constant coefficient of the growth with hours.
TIME_GROWTH = {"cdr": (0.015, -0.005, 0.0), "amsr": (0.01948381, -0.01426112, 0.0), "ssmi": (0.01422614, -0.00535288, 0.0), "ascat": (0.01029225, 0.0052347, 0.0)}
#: Fixed values: (area id, projection, lat_0, lon_0, lat_ts, nx, ny, llx, lly, urx, ury).
GRIDS = [
    ("nh-stere-125", "stere", 90, -45, 70, 608, 896, -3856250, -5343750, 3743750, 5856250),
    ("nh-stere-625", "stere", 90, -45, 70, 119, 177, -3781250, -5281250, 3656250, 5781250),
    ("sh-stere-625", "stere", -90, 0, -70, 125, 131, -3906250, -3906250, 3906250, 4281250),
    ("nh-ease2-750", "laea", 90, 0, None, 144, 144, -5400000, -5400000, 5400000, 5400000),
    ("sh-ease2-750", "laea", -90, 0, None, 144, 144, -5400000, -5400000, 5400000, 5400000),
    ("nh-ease2-125", "laea", 90, 0, None, 864, 864, -5400000, -5400000, 5400000, 5400000),
    ("sh-ease2-125", "laea", -90, 0, None, 864, 864, -5400000, -5400000, 5400000, 5400000),
]
#: Fixed values: (instrument, platform prefix, default channel).
INSTRUMENTS = [("amsr", "aq", "37"), ("amsr2", "gw", "37"), ("ssmi", "f", "90"), ("ssmis", "f", "90"), ("ascat", "metop", "sigma0"), ("cimr", "cimr", "37")]
#: Fixed values: (instrument, bands, footprint in km, noise in K or dB, default bands).
BANDS = [
    ("ssmi", "bt19v bt19h bt22v bt37v bt37h bt85v bt85h", "70 70 60 38 38 16 16", "0.45 0.42 0.74 0.37 0.38 0.69 0.73", "bt85v bt85h"),
    ("ssmis", "bt19v bt19h bt37v bt37h bt91v bt91h", "70 70 38 38 16 16", "1 1 1 1 1 1", "bt91v bt91h"),
    ("amsr", "bt19v bt19h bt37v bt37h bt89v bt89h", "27 27 14 14 7 7", "1 1 1 1 1 1", "bt37v bt37h"),
    ("amsr2", "bt19v bt19h bt37v bt37h bt89v bt89h", "27 27 14 14 7 7", "1 1 1 1 1 1", "bt37v bt37h"),
    ("ascat", "sigma0", "25", "1", "sigma0"),
    ("seawinds", "sigma0H sigma0V", "25 25", "1 1", "sigma0H sigma0V"),
    ("miras", "btL", "15", "1", "btL"),
    ("cimr", "bt19v bt19h bt37v bt37h", "14 14 7 7", "1 1 1 1", "bt37v bt37h"),
]
#: What ranks first among trajectories in one cell.
SOURCE_RANK = {"gps": 1, "wsm": 2, "argos": 3}


def values(rows: list[tuple], names: str) -> str:
    """A SQL relation of constants."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names}))"


def grids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRIDS, "area_id string, proj string, lat_0 int, lon_0 int, lat_ts int, nx int, ny int, llx int, lly int, urx int, ury int")


def bands_of() -> list[tuple]:
    """(instrument, place, band, footprint, noise, whether it is a default) of every band."""
    return [(i, k, b, float(f), float(n), b in d.split()) for i, bs, fs, ns, d in BANDS for k, (b, f, n) in enumerate(zip(bs.split(), fs.split(), ns.split(), strict=True))]


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bands_of(), "instrument string, place int, band string, footprint double, noise double, is_default boolean")


def sigmas_of() -> list[tuple]:
    """(mode, area, product, season, flag, km) of both modes of processing."""
    flags = lambda product: (0, 19) if product == "wind" else (0, 13, 17)
    near = [("nrt", area, product, season, f, km) for area, product, season, *kms in NEAR_REAL_TIME for f, km in zip(flags(product), kms, strict=True)]
    return [("cdr", *r) for r in SIGMAS] + near


def mode_sigmas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sigmas_of(), "mode string, area string, family string, season string, flag int, sigma double")


def family(product: Column) -> Column:
    """The name that a product's uncertainties are listed under."""
    return F.when(product.startswith("ssmi"), "ssmi").when(product.startswith("amsr"), F.replace(product, F.lit("tb"), F.lit("bt"))).when(product.startswith("ascat"), "ascat").when(product.startswith("wind") | product.startswith("ecmwf"), "wind").otherwise(product)


def sigmas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGMAS, "area string, product string, season string, flag int, sigma double")


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUMENTS, "instrument string, platform_prefix string, channel string")


def final_flags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FINAL_FLAG.items()), "flag int, final_flag int")


def source_rank(source: Column) -> Column:
    """Rank of a trajectory's source; unknown ones come last."""
    out = F.lit(len(SOURCE_RANK) + 1)
    for name, rank in reversed(SOURCE_RANK.items()):
        out = F.when(source == name, rank).otherwise(out)
    return out
