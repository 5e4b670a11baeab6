"""Texts in mixed time notations and zones to one instant in UTC, or to the reason why there is none."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Month names accepted in a date (Italian and English, short and full), with the number of the month.
MONTHS = {
    1: "gen gennaio jan january", 2: "feb febbraio february", 3: "mar marzo march", 4: "apr aprile april",
    5: "mag maggio may", 6: "giu giugno jun june", 7: "lug luglio jul july", 8: "ago agosto aug august",
    9: "set sett settembre sep sept september", 10: "ott ottobre oct october", 11: "nov novembre november",
    12: "dic dicembre dec december",
}
# Day names, Monday first.
DAYS = {1: "mon lun", 2: "tue mar", 3: "wed mer", 4: "thu gio", 5: "fri ven", 6: "sat sab", 7: "sun dom"}

_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([AaPp][Mm]))?"
_ZONE = r"(?: ?(Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?: ?\[([A-Za-z_]+(?:[/+-][A-Za-z0-9_+-]+){0,3})\])?"
_TIME = rf"(?:(?:[Tt]|,? +){_CLOCK}{_HALF}{_ZONE})?"
#: The cascade: name, anchored pattern, and what its groups are, joined by ``|`` in the order of ``PARTS``.
PARTS = ("order", "a", "b", "c", "h", "mi", "s", "f", "half", "zone", "region", "dow")
CASCADE = (
    ("year_first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$", "YMD|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE})?$", "YMD|$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    ("numeric", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}$", "SRC|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|"),
    ("day_name_month", rf"^(?:([A-Za-z]{{3}}),? +)?(\d{{1,2}})[- ]([A-Za-z]{{3,9}})\.?[- ](\d{{4}}|\d{{2}}){_TIME}$", "DNY|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11|$1"),
    ("month_name_day", rf"^(?:([A-Za-z]{{3}}),? +)?([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}){_TIME}$", "NDY|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11|$1"),
)
EPOCH = r"^\d{9,17}$"
DAY_US = 86_400_000_000


def _names(table: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, words in table.items() for w in words.split() for x in (w, k)])


def zone_names(spark: SparkSession) -> list[str]:
    """The names of the time zone database that Spark knows."""
    return spark._jvm.java.lang.String.join(" ", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(" ")


def abbreviations(spark: SparkSession, zones: list[str]) -> DataFrame:
    """(zone, offsets): for each zone a map from the abbreviations it has used since 1970 to their offset in seconds.

    From the time zone database by rule: every week is looked up, and of several offsets the latest is kept.
    """
    rows, known = [], set(zone_names(spark))
    for z in zones:
        try:
            zone = ZoneInfo(z) if z in known else None
        except (KeyError, ValueError, OSError):
            zone = None
        if zone is None:
            continue
        t, names = dt.datetime(1970, 1, 4, 12, tzinfo=dt.UTC), {}
        while t.year < 2038:
            here = t.astimezone(zone)
            names[here.tzname().upper()] = int(here.utcoffset().total_seconds())
            t += dt.timedelta(days=7)
        rows.append((z, names))
    return spark.createDataFrame(rows, "zone string, offsets map<string,int>")


def _offset_text(zone: Column) -> Column:
    """Seconds of ``Z``, ``UTC``, ``GMT`` or a numeric offset; null for other texts or offsets beyond 18 hours."""
    z = F.upper(zone)
    sign = F.regexp_extract(z, r"^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$", 1)
    hours = F.regexp_extract(z, r"^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$", 2)
    minutes = F.regexp_extract(z, r"^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$", 3)
    n = F.coalesce(F.nullif(hours, F.lit("")).cast("int"), F.lit(99)) * 3600 + F.coalesce(F.nullif(minutes, F.lit("")).cast("int"), F.lit(0)) * 60
    ok = (n <= 18 * 3600) & (F.coalesce(F.nullif(minutes, F.lit("")).cast("int"), F.lit(0)) < 60)
    return F.when(z.isin("Z", "UTC", "GMT"), 0).when((sign != "") & ok, F.when(sign == "-", -n).otherwise(n))


#: Begins a text that a pattern of the cascade has taken apart; no text is delivered with it (see ``_taken_apart``).
_MARK = "\u0001"
#: What counts as blank at the ends of a text.
_ENDS = " \t\n\u000b\f\r\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200C))
#: Sources that are sent to every executor; more are joined by Spark as it sees fit.
MOST_SOURCES = 100_000
#: Groups over which a source's rows are spread where its sources are too many to be sent.
SALTS = 64


def _taken_apart(text: Column) -> Column:
    """The parts of a text by the first notation that matches, joined by ``|`` behind a mark; other texts as they are.

    What stands in the second, third and fifth place leaves one or two notations that can match; these are tried.
    """
    t = F.translate(F.btrim(text, F.lit(_ENDS)), _MARK + "\t\n\u000b\f\r", "?     ")
    t = F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t)
    second, third, fifth = (F.substring(t, k, 1) for k in (2, 3, 5))

    def tried(*names: str) -> Column:
        out = t
        for name, pattern, parts in CASCADE:
            if name in names:
                out = F.regexp_replace(out, pattern, _MARK + parts)  # a text taken apart matches no later pattern
        return out

    marks, digit = ("-", "/", "."), lambda c: c.between("0", "9")
    return (
        F.when(digit(second) & digit(third) & fifth.isin(*marks), tried("year_first")).when(digit(second) & digit(third) & digit(fifth), tried("compact"))
        .when(second.isin(*marks) | third.isin(*marks), tried("numeric", "day_name_month")).otherwise(tried("day_name_month", "month_name_day"))
    )


def _apart(c: Column) -> Column:
    """``c``, by a lambda, which takes the projection it stands in out of whole-stage code.

    The projections here would make one generated method too long for the JVM to compile (8,000 bytes of code); on its own,
    each is cut into methods that it does compile.
    """
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def read_texts(values: DataFrame, text: str, zone: str, day_first: str, offsets: str) -> DataFrame:
    """``values`` with ``istante_us`` (bigint: microseconds since 1970 UTC) and ``esito`` of the column ``text``.

    ``zone``: column of the source's default zone; ``day_first``: whether its numeric dates have the day first;
    ``offsets``: map from the zone's abbreviations to seconds. ``esito``: ``ok``; ``nullo`` for null; ``illeggibile``
    for a text of no notation or of no existing date or time; ``inesistente`` for a wall clock that its zone skips;
    ``ambiguo`` for one that it shows twice; ``senza_zona`` if a wall clock has no known zone. Only ``ok`` has an
    instant. The first notation of the cascade that matches decides. An offset decides before a region in brackets, a
    region before the source's zone; an abbreviation is one of the source's zone. Fractions beyond microseconds are
    cut off.

    Stage after stage of projections in generated code; what a stage computes is a column of the next.
    """
    kept = values.columns
    s = values.select(*kept, _taken_apart(F.col(text)).alias("_t"))
    s = s.select(*kept, "_t", F.when(F.startswith("_t", F.lit(_MARK)), F.split(F.substring("_t", 2, 1 << 30), r"\|", -1)).alias("_f"))
    part = {name: F.get(F.col("_f"), F.lit(i)) for i, name in enumerate(PARTS)}
    s = s.select(*kept, "_t", *[c.alias(f"_{k}") for k, c in part.items()])
    s = s.select(*kept, "_t", "_zone", "_region", _apart(F.col("_dow")).alias("_dow"), *[c.alias(k) for k, c in _fields(F.col(day_first)).items()])
    sound = (F.col("_hh") <= 23) & (F.col("_mm") <= 59) & (F.col("_ss") <= 59) & (F.col("_year") >= 1)
    made = F.try_make_timestamp_ntz("_year", "_month", "_day", "_hh", "_mm", F.col("_ss").cast("decimal(16,6)"))
    s = s.select(*kept, "_t", "_zone", "_region", _apart(F.col("_dow")).alias("_dow"), F.when(sound, made).alias("_at"), ((F.col("_hh") * 3600 + F.col("_mm") * 60 + F.col("_ss")).cast("bigint") * 1_000_000 + F.col("_us")).alias("_past"))
    names = F.create_map(*[F.lit(x) for k, v in DAYS.items() for x in (k, v)])
    right = F.coalesce((F.col("_dow") == "") | F.array_contains(F.split(F.try_element_at(names, F.weekday("_at") + 1), " "), F.lower("_dow")), F.lit(True))
    wall = F.unix_date(F.col("_at").cast("date")).cast("bigint") * DAY_US + F.col("_past")
    s = s.select(*kept, "_t", "_zone", "_region", F.when(right, F.col("_at")).alias("_at"), wall.alias("_wall"))
    number, size = F.when(F.col("_t").rlike(EPOCH), F.col("_t").try_cast("bigint")), F.length("_t")
    plain = F.when(F.col("_at").isNull(), F.when(size <= 11, number * 1_000_000).when(size.between(12, 13), number * 1000).when(size >= 15, number))
    bare = F.col("_zone") == ""
    offset = F.when(~bare, F.coalesce(F.try_element_at(F.col(offsets), F.upper("_zone")), _offset_text(F.col("_zone"))))
    region = F.when(F.col("_region").isin(*zone_names(values.sparkSession)), F.col("_region")).otherwise("")
    place = F.when(F.col("_region") != "", F.nullif(region, F.lit(""))).when(bare, F.col(zone))
    s = s.select(*kept, F.col("_at").isNotNull().alias("_is"), _apart(bare & (F.col("_region") == "")).alias("_bare"), plain.alias("_plain"), offset.alias("_off"), place.alias("_z"), "_wall")
    # Only wall clocks without an offset ask a zone: the zone's offsets a day before and a day after. Each that leads
    # back to the same wall clock is an instant it may name. None: the clock skips it; two: the clock shows it twice.
    clock = F.when(F.col("_off").isNull() & F.col("_is"), F.col("_wall"))
    shift = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col("_z"))) - us
    s = s.select("*", clock.alias("_clock")).select("*", shift(F.col("_clock") - DAY_US).alias("_o1"), shift(F.col("_clock") + DAY_US).alias("_o2"))
    back = lambda o: shift(F.col("_clock") - F.col(o)) == F.col(o)
    s = s.select("*", back("_o1").alias("_b1"), F.when(F.col("_o2") != F.col("_o1"), back("_o2")).otherwise(False).alias("_b2"))
    outcome = (
        F.when(F.col(text).isNull(), "nullo")
        .when(F.col("_plain").isNotNull(), "ok")
        .when(~F.col("_is"), "illeggibile")
        .when(F.col("_off").isNotNull(), "ok")
        .when(F.col("_z").isNull(), F.when(F.col("_bare"), "senza_zona").otherwise("illeggibile"))
        .when(F.col("_b1") & F.col("_b2"), "ambiguo").when(F.col("_b1") | F.col("_b2"), "ok").otherwise("inesistente")
    )
    moved = F.coalesce(F.col("_off").cast("bigint") * 1_000_000, F.when(F.col("_b1"), F.col("_o1")).otherwise(F.col("_o2")))
    s = s.select(*kept, "_plain", (F.col("_wall") - moved).alias("_instant"), outcome.alias("_e"))
    # Conditions on the outcome stop at the generator; below it they would compute all stages once more.
    result = F.struct(F.when(F.col("_e") == "ok", F.coalesce("_plain", "_instant")).alias("istante_us"), F.col("_e").alias("esito"))
    return s.select(*kept, F.inline(F.array(result)))


def _fields(day_first: Column) -> dict[str, Column]:
    """Numbers of the parts, null where a part is none; ``_us`` are the microseconds beside the second."""
    whole = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    a, b, c, months = F.col("_a"), F.col("_b"), F.col("_c"), _names(MONTHS)
    year_first, source, day_name = (F.col("_order") == k for k in ("YMD", "SRC", "DNY"))
    h, half = F.coalesce(whole(F.col("_h")), F.lit(0)), F.lower("_half")
    return {
        "_year": F.when(year_first, whole(a)).otherwise(F.when(F.length(c) == 2, whole(c) + 2000).otherwise(whole(c))),
        "_month": F.when(year_first, whole(b)).when(source, F.when(day_first, whole(b)).when(~day_first, whole(a))).when(day_name, F.try_element_at(months, F.lower(b))).otherwise(F.try_element_at(months, F.lower(a))),
        "_day": F.when(year_first, whole(c)).when(source, F.when(day_first, whole(a)).when(~day_first, whole(b))).when(day_name, whole(a)).otherwise(whole(b)),
        "_hh": F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "pm", 12).otherwise(0)),
        "_mm": F.coalesce(whole(F.col("_mi")), F.lit(0)),
        "_ss": F.coalesce(whole(F.col("_s")), F.lit(0)),
        "_us": F.coalesce(whole(F.substring(F.rpad("_f", 6, "0"), 1, 6)), F.lit(0)),
    }


def normalise(values: DataFrame, columns: list[str], sources: DataFrame, *, row: str, source: str, zone: str, order: str) -> DataFrame:
    """One row per row and time column of ``values``: row id, ``campo``, ``testo``, ``istante_us``, ``esito``.

    ``sources`` has, for each source, its default zone and its order of numeric day and month (``DMY`` or ``MDY``);
    rows whose source is null or unknown have no default zone and no order. Repeated rows give repeated rows.
    See :func:`read_texts` for the outcomes.

    Scale: row by row in the JVM. The sources are counted; up to ``MOST_SOURCES`` of them are broadcast, so that no
    value is shuffled and a source with a third of all rows is read by all tasks. More sources join by a salted key
    that spreads each over ``SALTS`` groups. The driver reads the distinct zones
    of ``sources``, which are names of the time zone database.
    """
    spark = values.sparkSession
    zones = [r[0] for r in sources.select(zone).where(F.col(zone).isNotNull()).distinct().collect()]
    src = sources.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("_s")).agg(F.min(zone).alias("_z"), F.min(order).alias("_ord"))
    src = src.join(F.broadcast(abbreviations(spark, zones)), F.col("_z") == F.col("zone"), "left")  # a row a zone
    src = src.select("_s", F.col("zone").alias("_zona"), (F.col("_ord") == "DMY").alias("_dmy"), "offsets")
    texts = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("testo")) for c in columns])
    rows = values.select(F.col(row).alias("_row"), F.col(source).alias("_src"), texts.alias("_x"))
    if src.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        joined = rows.join(F.broadcast(src), F.col("_src") == F.col("_s"), "left")
    else:
        salted = src.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_own", F.pmod(F.xxhash64("_row", "_x"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.col("_src") == F.col("_s")) & (F.col("_own") == F.col("_salt")), "left")
    flat = joined.select("_row", "_zona", "_dmy", "offsets", F.inline("_x"))
    return read_texts(flat, "testo", "_zona", "_dmy", "offsets").select(F.col("_row").alias(row), "campo", "testo", "istante_us", "esito")
