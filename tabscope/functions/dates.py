"""Date parsing over a fixed, ordered list of written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of the text -> Spark date patterns tried in this order.
# Month-first wins over day-first where both fit. Times alone and relative words
# are not dates. A shape test guards each pattern, so the parser runs at most a
# few times per value.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}$", ["yyyy-M"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", ["yyyy/M/d H:mm"]),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", ["yyyy/M/d H:mm:ss"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", ["M/d/yyyy H:mm", "d/M/yyyy H:mm"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", ["M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", ["d MMMM yyyy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ["MMM d[,] yyyy"]),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", ["MMMM d[,] yyyy"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", ["M.d.yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]$", ["M/d/yyyy h:mm[:ss][ ]a", "d/M/yyyy h:mm[:ss][ ]a"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]$", ["yyyy-M-d h:mm[:ss][ ]a"]),
    (r"^[A-Za-z]{3} \d{4}$", ["MMM yyyy"]),
    (r"^[A-Za-z]{4,9} \d{4}$", ["MMMM yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}(:\d{2})?$", ["d MMM yyyy H:mm[:ss]"]),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4} \d{1,2}:\d{2}(:\d{2})?$", ["d MMMM yyyy H:mm[:ss]"]),
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"^\d{4}$", ["yyyy"]),
]

# Fixed value: ISO date, optionally with time, fraction and zone.
ISO_SHAPE = (
    r"^\d{4}-\d{1,2}-\d{1,2}"
    r"([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?)?$"
)


# What comes before a date or stands for part of its year.
WEEKDAY = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +(?=[0-9A-Z])"
YEAR_FROM_69 = r"^(\d{1,2}/\d{1,2}/)(69|[7-9]\d)(?= |$)"
YEAR_TO_68 = r"^(\d{1,2}/\d{1,2}/)(\d{2})(?= |$)"
ZONED = r":\d{2}.*(Z|UTC|[+-]\d{2}:?\d{2})$"


def _utc(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def parse_date(text: Column) -> Column:
    """``timestamp_ntz`` of a written date, null where no known form fits.

    The session time zone has no part in it: what is written without zone stays as
    written, what is written with a zone becomes UTC. Years of two digits are
    1969 to 2068.
    """
    value = F.regexp_replace(F.trim(text), WEEKDAY, "")
    value = F.regexp_replace(F.regexp_replace(value, YEAR_FROM_69, "$1" "19$2"), YEAR_TO_68, "$1" "20$2")
    with_colon = F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(value.rlike(ZONED), _utc(with_colon.try_cast("timestamp"))).otherwise(value.try_cast("timestamp_ntz"))
    parsed = F.when(value.rlike(ISO_SHAPE), iso)
    for shape, patterns in DATE_SHAPES:
        tries = [F.try_to_timestamp(F.concat(value, F.lit(" +0000")), F.lit(f"{p} Z")) for p in patterns]
        parsed = parsed.when(value.rlike(shape), _utc(tries[0] if len(tries) == 1 else F.coalesce(*tries)))
    return parsed


def month_key(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")
