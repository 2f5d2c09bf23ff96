"""Date checks without exceptions: nothing here throws on an impossible day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions.text import digit_map, let

# German months in order.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

#: Most and least digits of day, month and year written in numbers.
LENGTHS = ((1, 2), (1, 2), (2, 4))


def real_day(year: Column, month: Column, day: Column) -> Column:
    """True where the calendar has this day; a year below 100 counts from 2000."""
    y = F.when(year < 100, year + 2000).otherwise(year)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(month.between(1, 12) & (day >= 1) & (day <= last) & (y >= 1), F.lit(False))


def numeric_date(c: Column) -> Column:
    """True where the text is day, month and year of a real day, with a dot, slash or hyphen between each two."""

    def of(parts: Column) -> Column:
        each = [F.get(parts, k) for k in range(3)]
        digits = [F.length(p).between(*n) & (F.translate(p, "0123456789", "") == "") for p, n in zip(each, LENGTHS, strict=True)]
        day, month, year = (p.try_cast("int") for p in each)
        return (F.size(parts) == 3) & digits[0] & digits[1] & digits[2] & real_day(year, month, day)

    return c.isNotNull() & F.coalesce(let(F.split(F.translate(c, "/-", ".."), r"\.", -1), of), F.lit(False))


def corrected_numeric_date(c: Column) -> Column:
    """The value without blanks and with look-alike letters as digits, where that is a real date; else the value."""
    tight = F.regexp_replace(c, r"\s+", "")
    mapped = digit_map(tight)
    return F.when(numeric_date(c), c).when(numeric_date(tight), tight).when(numeric_date(mapped), mapped).otherwise(c)


def nearest_month(word: Column, ratio: float = 0.34) -> Column:
    """The month name nearest to ``word``, the earlier of equally near ones; null beyond ``ratio`` of its length. ``maerz`` is a way to write one."""
    plain = F.lower(word)
    options = F.array(*[F.struct(F.levenshtein(plain, F.lit(m.lower())).alias("d"), F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(MONTHS)])
    best = F.array_min(options)
    return F.when(plain == "maerz", MONTHS[2]).when(best["d"] <= F.lit(ratio) * F.greatest(F.length(plain), F.lit(1)), best["m"])


_LETTERS = "A-Za-zÄÖÜäöüß"


def _spelled_parts(c: Column) -> Column:
    """Day, month word and year of a text as struct<day, word, year>, null where it has no such parts.

    The day has two signs or one, a dot and blanks behind it or not; the year
    has two to four signs, letters in place of digits allowed. Longer days and
    month words win over shorter ones.
    """

    def choice(day: int, year: int) -> Column:
        rest = F.ltrim(F.regexp_replace(F.substr(c, F.lit(day + 1)), r"^\.", ""), F.lit(" \t\n\r\x0b\x0c"))
        return F.struct(
            F.substring(c, 1, day).alias("day"),
            F.rtrim(F.left(rest, F.greatest(F.length(rest) - year, F.lit(0))), F.lit(" \t\n\r\x0b\x0c")).alias("word"),
            F.right(rest, F.lit(year)).alias("year"),
        )

    signs = rf"^[0-9{_LETTERS}]+$"
    fits = lambda p: p["day"].rlike(signs) & p["year"].rlike(signs) & p["word"].rlike(rf"^[{_LETTERS}]{{3,}}$")
    return F.get(F.filter(F.array(*[choice(d, y) for d in (2, 1) for y in (2, 3, 4)]), fits), 0)


def corrected_spelled_date(c: Column, ratio: float = 0.34) -> Column:
    """``D. Month YYYY`` where day, month word and year become a real day; null where the text is not so written."""

    def of(p: Column) -> Column:
        day, year = digit_map(p["day"]), digit_map(p["year"])

        def told(month: Column) -> Column:
            number = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")
            fine = month.isNotNull() & real_day(year.try_cast("int"), number, day.try_cast("int"))
            return F.when(fine, F.concat(day, F.lit(". "), month, F.lit(" "), year))

        return let(nearest_month(p["word"], ratio), told)

    trimmed = F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(c.rlike(rf"[{_LETTERS}]{{3}}"), let(trimmed, lambda t: let(_spelled_parts(t), of)))


def birth_date_shape(c: Column, ratio: float = 0.34) -> Column:
    """True where the text is a real day, in numbers or with a month word near to a name; blanks do not count in numbers."""
    tight = F.regexp_replace(c, r"\s+", "")

    def of(p: Column) -> Column:
        number = F.array_position(F.array(*map(F.lit, MONTHS)), nearest_month(p["word"], ratio)).cast("int")
        digits = (F.translate(p["day"], "0123456789", "") == "") & (F.translate(p["year"], "0123456789", "") == "")
        return digits & number.isNotNull() & real_day(p["year"].try_cast("int"), number, p["day"].try_cast("int"))

    spelled = let(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")), lambda t: let(_spelled_parts(t), of))
    return numeric_date(tight) | F.coalesce(spelled, F.lit(False))


def value_date(c: Column) -> Column:
    """The day that a text names, null where it names none; month names must be written right, a year below 100 counts from 2000."""

    def made(year: Column, month: Column, day: Column) -> Column:
        y, m, d = year.try_cast("int"), month.cast("int"), day.try_cast("int")
        return F.when(real_day(y, m, d), F.make_date(F.when(y < 100, y + 2000).otherwise(y), m, d))

    def spelled(p: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(p["word"]))
        return made(p["year"], F.nullif(month, F.lit(0)), p["day"])

    tight = F.regexp_replace(c, r"\s+", "")
    parts = F.split(F.translate(tight, "/-", ".."), r"\.", -1)
    told = let(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")), lambda t: let(_spelled_parts(t), spelled))
    return F.when(numeric_date(tight), let(parts, lambda p: made(F.get(p, 2), F.get(p, 1).try_cast("int"), F.get(p, 0)))).otherwise(told)


def age_reason(day: Column, today: Column) -> Column:
    """Reason to doubt a birth date: in the future, or a hundred years ago and more; else null."""
    past = F.add_months(today, -1200)
    return F.when(day > today, "date lies in the future").when(day <= past, "age is 100 years or more")
