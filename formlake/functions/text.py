"""String functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that recognisers confuse with digits, and back.
DIGIT_FROM, DIGIT_TO = "HkGjgqoOsSrlIiBZF", "44699900555111827"
LETTER_FROM, LETTER_TO = "01245689", "oizhsgbg"

# German letters as two characters.
EXPANSIONS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def digit_map(c: Column) -> Column:
    """Replace letters that look like digits."""
    return F.translate(c, DIGIT_FROM, DIGIT_TO)


def zero_padded(c: Column, width: int) -> Column:
    """A number's text with zeros in front, up to ``width`` characters; longer ones stay whole (``lpad`` alone would cut them)."""
    digits = c.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def for_matching(c: Column) -> Column:
    """Lower case, umlauts expanded: the form in which edit distances are taken."""
    out = F.lower(c)
    for one, two in EXPANSIONS:
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def capitalised(c: Column) -> Column:
    """First letter of every part between blanks and hyphens in upper case, the rest in lower case."""
    words = F.split(c, " ")
    parts = F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "-"))
    return F.array_join(parts, " ")


def clean_name(c: Column) -> Column:
    """Digits to letters where one looks like it, other signs dropped, blanks squeezed, capitalised."""
    mapped = F.translate(c, LETTER_FROM, LETTER_TO)
    kept = F.regexp_replace(mapped, r"[^\p{L}\-'\s]", "")
    return capitalised(F.trim(F.regexp_replace(kept, r"\s+", " ")))


# The sign with which a recogniser ends its output; signs that open and close a formula.
STOP_SIGN = "<｜end▁of▁sentence｜>"
FORMULA_PAIRS = (("\\[", "\\]"), ("\\(", "\\)"), ("$$", "$$"), ("<math>", "</math>"))
# Signs in front of and behind a value that are not part of it; signs that tick a box, boxes with and without a tick.
LEADING_SIGNS, TRAILING_SIGNS = ":.-–—|_*", ":|_*"
TICKS = "xX✕✖✗✘✓✔☒×⨯"
TICKED_BOXES, EMPTY_BOXES = "☑☒", "☐□❑"
#: What counts as blank around a value.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks around struck-out text inside a segment: shift out, shift in.
STRUCK, UNSTRUCK = "\x0e", "\x0f"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` reckoned once."""
    return F.get(F.transform(F.array(value), then), 0)


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _sign(sign: str) -> str:
    """A pattern for one sign; a tag may hold attributes."""
    return sign[:-1] + "[^>]*>" if sign.startswith("<") else "".join("\\" + x for x in sign)


def formula_pattern() -> str:
    """A pair with what is between, shortest first; a single dollar closes in its line."""
    each = [rf"{_sign(o)}\s*(.*?)\s*{_sign(c)}" for o, c in FORMULA_PAIRS]
    each.insert(3, r"\$[^\S\n]*([^$\n]*?)[^\S\n]*\$")
    return "(?is)" + "|".join(each)


def without_formulas(c: Column) -> Column:
    """Formulas without their wrappers, a blank on each side, nested to any depth; then wrappers without a partner go, but a single dollar stays.

    A round takes away the outermost pairs; there are as many rounds as a text
    has opening signs, so none is left.
    """
    opening = "(?i)" + "|".join([*(_sign(o) for o, _ in FORMULA_PAIRS), r"\$"])
    stray = "(?i)" + "|".join(_sign(x) for pair in FORMULA_PAIRS if "$" not in pair[0] for x in pair)
    once = lambda x, _: F.regexp_replace(x, formula_pattern(), " $1$2$3$4$5 ")
    rounds = F.regexp_count(c, F.lit(opening))
    out = F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), c, once)).otherwise(c)
    return F.regexp_replace(out, stray, " ")


def clean_text(c: Column) -> Column:
    """Markup that is never part of a value removed: the stop sign, formulas' wrappers, a heading mark at the start, emphasis marks.

    Single underscores, backticks and line ends stay; runs of blanks, tabs and no-break blanks become one blank.
    """
    out = _stripped(without_formulas(F.replace(c, F.lit(STOP_SIGN), F.lit(" "))))
    heading = F.when(F.startswith(out, F.lit("#")), F.ltrim(F.ltrim(out, F.lit("#")), F.lit(BLANKS))).otherwise(out)
    plain = F.regexp_replace(F.replace(heading, F.lit("*"), F.lit("")), "__+", "")
    return _stripped(F.regexp_replace(plain, "[ \t\u00a0]+", " "))


def with_struck_text(c: Column) -> Column:
    """Text without the marks of what is struck out, which stays: the form in which labels are sought."""
    return F.translate(c, STRUCK + UNSTRUCK, "")


def without_struck_text(c: Column) -> Column:
    """What is struck out goes, unless nothing else is left: then it is what the writer left standing."""
    left = F.regexp_replace(c, f"{STRUCK}[^{UNSTRUCK}]*{UNSTRUCK}", " ")
    return F.when(F.contains(c, F.lit(STRUCK)) & (F.btrim(left, F.lit(" \t:.-|*")) != ""), left).otherwise(with_struck_text(c))


def clean_value(c: Column) -> Column:
    """A value without what is struck out and the signs around it; empty where only ticked or empty boxes are left."""
    kept = F.rtrim(F.ltrim(without_struck_text(c), F.lit(BLANKS + LEADING_SIGNS)), F.lit(BLANKS + TRAILING_SIGNS))
    beside_boxes = F.translate(F.regexp_replace(kept, rf"\[\s*[{TICKS}]?\s*\]", ""), TICKED_BOXES + EMPTY_BOXES + BLANKS, "")
    return F.when(beside_boxes == "", "").otherwise(_stripped(kept))


def without_added_end(original: Column, corrected: Column) -> Column:
    """``corrected`` without a final ``.``, ``!`` or ``?`` that ``original`` does not have, and the blanks before it."""
    added = corrected.rlike(r"[.!?]\z") & ~F.coalesce(original.rlike(r"[.!?]\z"), F.lit(False))
    return F.when(added, F.regexp_replace(corrected, r"\s*[.!?]\z", "")).otherwise(corrected)


def slug(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-|-$", "")


def document_number(stem: Column) -> Column:
    """The last run of digits of a file stem, null where it has none."""
    return F.nullif(F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1), F.lit("")).try_cast("bigint")


def without_blanks(c: Column) -> Column:
    """E-mail normal form: lower case, no blanks."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def email_local(c: Column) -> Column:
    """What stands before the last @ ('' without one)."""
    return F.regexp_extract(c, "^(.*)@([^@]*)$", 1)


def email_domain(c: Column) -> Column:
    """What stands behind the last @ ('' without one)."""
    return F.regexp_extract(c, "^(.*)@([^@]*)$", 2)


def html_lines(c: Column) -> Column:
    """Array of the non-blank text lines of a fragment: scripts dropped, breaks and block ends cut."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|td|th|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def text_of(c: Column, kind: str = "string") -> Column:
    """A cell as text: null and NaN empty, whole floats without their fraction."""
    if kind in ("double", "float"):
        whole = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        return F.when(c.isNull() | F.isnan(c), "").otherwise(whole)
    return F.coalesce(c.cast("string"), F.lit(""))
