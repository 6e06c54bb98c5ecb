"""Column expressions shared by the operators: time, text, hashes and geography."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
EARTH_KM = 6371.0
MERCATOR_M = 6378137.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def us(ts) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), col(ts))


def from_us(n) -> Column:
    return F.timestamp_add("MICROSECOND", col(n), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def instant(ts) -> Column:
    """A TIMESTAMP_NTZ as the instant that it would be in UTC, for watermarks; `wall` is the way back."""
    return F.timestamp_micros(us(ts))


def wall(ts) -> Column:
    return from_us(F.unix_micros(col(ts)))


def day(ts) -> Column:
    """Midnight of a time's day, as TIMESTAMP_NTZ."""
    return F.to_date(col(ts)).cast("timestamp_ntz")


def hours_between(later, earlier) -> Column:
    return (us(later) - us(earlier)) / float(HOUR_US)


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def clean(df: DataFrame) -> DataFrame:
    """Every floating column's NaN as NULL, for sources that mark missing values so."""
    return df.withColumns({n: nan_to_null(n).alias(n) for n, t in df.dtypes if t in ("double", "float")})


def text_or_null(c) -> Column:
    """NULL for blank text and for the words that stand for a missing value."""
    t = F.trim(col(c))
    return F.when(~F.lower(t).isin("", "nan", "none", "<na>", "nat"), t)


def number(c) -> Column:
    """A number, or NULL where the text is none."""
    return nan_to_null(F.expr(f"try_cast({c} as double)"))


def zfill(c, width: int) -> Column:
    """Zeros on the left up to width; longer text stays (lpad would cut it)."""
    s = col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def sha_id(*parts, size: int = 16) -> Column:
    """The first hex digits of SHA-256 over the parts joined by '_'."""
    return F.substring(F.sha2(F.concat_ws("_", *[col(p).cast("string") for p in parts]), 256), 1, size)


def normal_name(c) -> Column:
    return F.trim(F.replace(F.lower(col(c)), F.lit("°"), F.lit("")))


def named(c) -> Column:
    """A name that says something."""
    n = normal_name(c)
    return F.when(~n.isin("", "nan", "none", "unknown"), n)


def resolve(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that a column is called, whatever the case."""
    by = {c.lower(): c for c in reversed(df.columns)}
    return next((by[c.lower()] for c in candidates if c.lower() in by), None)


def month_distance(a, b) -> Column:
    """Months apart round the year, 0 to 6."""
    d = F.abs(F.month(col(a)) - F.month(col(b)))
    return F.least(d, 12 - d)


def days_apart(later, earlier) -> Column:
    """abs(floor(difference in days)): -12 h counts as 1."""
    return F.abs(F.floor((us(later) - us(earlier)) / float(DAY_US))).cast("long")


def event_time(c) -> Column:
    """ISO date or date and time -> TIMESTAMP_NTZ, NULL for anything else."""
    t = text_or_null(c)
    return F.coalesce(
        F.when(F.length(t) == 10, F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")),
        F.when(
            F.length(t) > 10,
            F.try_to_timestamp(
                F.replace(F.substring(t, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"),
            ).cast("timestamp_ntz"),
        ),
    )


def time_precision(c) -> Column:
    return F.when(event_time(c).isNull(), "UNKNOWN").when(F.length(text_or_null(c)) == 10, "DATE").otherwise("DATETIME")


def parts_date(year, month, day_) -> Column:
    """A date of its parts; a missing month or day is the first."""
    return F.when(
        col(year).isNotNull(),
        F.make_date(
            col(year).cast("int"), F.coalesce(col(month), F.lit(1)).cast("int"),
            F.when(col(month).isNotNull(), F.coalesce(col(day_), F.lit(1))).otherwise(1).cast("int"),
        ),
    )


def parts_precision(year, month, day_) -> Column:
    return F.when(col(year).isNull(), "UNKNOWN").when(col(month).isNull(), "YEAR").when(col(day_).isNull(), "MONTH").otherwise("DATE")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def mercator_x(lon) -> Column:
    return F.radians(col(lon)) * MERCATOR_M


def mercator_y(lat) -> Column:
    return F.ln(F.tan(F.lit(3.141592653589793) / 4 + F.radians(col(lat)) / 2)) * MERCATOR_M


def utm_epsg(lat, lon) -> Column:
    zone = F.least(F.greatest(F.floor((col(lon) + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(col(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def utm_xy(lat, lon, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres (north), by the Krueger series to third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    s, dl = F.sin(F.radians(col(lat))), F.radians(col(lon) - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e = eta + sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    y = xi + sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return 500000 + 0.9996 * radius * e, 0.9996 * radius * y


def circular_mean(degrees) -> Column:
    """Mean direction in [0, 360) of the non-null angles of a group."""
    r = F.radians(nan_to_null(degrees))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
