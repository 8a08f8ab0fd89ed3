"""Column expressions for the text handling of vote records (all JVM-side)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Choices that are not votes for a candidate, and the party label of
# non-partisan contests (both matched case-insensitively).
NON_CANDIDATE_PATTERN = "(?i)undervote|overvote|writein"
NONPARTISAN_PATTERN = "(?i)nonpartisan"
# Fixed value: contest keys that mark propositions (no party).
PROPOSITION_PATTERN = "^prop_|_prop_"
# Fixed value: offices whose district numbers are zero-padded to three digits.
PADDED_OFFICES = ("STATE HOUSE", "STATE SENATE", "US HOUSE")

# Presidential tickets recorded with the running mate's name and the
# short name they are reported under.
TICKET_NAMES = {
    "JOSEPH KISHORE NORISSA SANTA CRUZ": "JOSEPH KISHORE",
    "JORDAN CANCER SCOTT JENNIFER TEPOOL": "JORDAN SCOTT",
    "BILL HAMMONS ERIC BODENSTAB": "BILL HAMMONS",
    "MARK CHARLES ADRIAN WALLACE": "MARK CHARLES",
    "PRINCESS KHADIJAH MARYAM JACOB FAMBRO KHADIJAH MARYAM JACOB SR": "PRINCESS KHADIJAH JACOB-FAMBRO",
    "KYLE KENLEY KOPITKE NATHAN RE VO SORENSON": "KYLE KENLEY",
    "JOE MC HUGH ELIZABETH STORM": "JOE MCHUGH",
    "BLAKE HUBER FRANK ATWOOD": "BLAKE HUBER",
    "PHIL COLLINS BILLY JOE PARKER": "PHIL COLLINS",
    "GLORIA LA RIVA SUNIL FREEMAN": "GLORIA LA RIVA",
    "DARIO HUNTER DAWN NEPTUNE ADAMS": "DARIO HUNTER",
}

# External-score seat codes and the office names they stand for.
SEAT_OFFICES = {
    "federal:house": "US HOUSE",
    "federal:president": "US PRESIDENT",
    "federal:senate": "US SENATE",
    "state:upper": "STATE SENATE",
    "state:lower": "STATE HOUSE",
    "state:education": "STATE BOARD OF EDUCATION",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def paste(*cols, sep: str = "_") -> Column:
    """join with NULL written as the text ``NA`` (never NULL)."""
    return F.concat_ws(sep, *[F.coalesce(_c(c), F.lit("NA")) for c in cols])


def str_c(*cols, sep: str = "") -> Column:
    """join that is NULL when any part is NULL."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_c(c))
    return F.concat(*parts)


def squish(col) -> Column:
    """trim and collapse inner whitespace runs to one space."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def detect(col, pattern: str, ignore_case: bool = False) -> Column:
    """regex search anywhere in the text."""
    return _c(col).rlike(("(?i)" if ignore_case else "") + pattern)


def remove_all(col, pattern: str) -> Column:
    """delete every match."""
    return F.regexp_replace(_c(col), pattern, "")


def replace_first(col, pattern: str, replacement) -> Column:
    """replace the first regex match only; ``replacement`` may be a column."""
    rep = replacement if isinstance(replacement, Column) else F.lit(replacement)
    c = _c(col)
    pos = F.regexp_instr(c, F.lit(pattern))
    found = F.regexp_extract(c, pattern, 0)
    return F.when(pos > 0, F.concat(F.substr(c, F.lit(1), pos - 1), rep,
                                    F.substr(c, pos + F.length(found)))).otherwise(c)


def replace_fixed(col, literal: str, replacement) -> Column:
    """replace the first occurrence of a fixed string (``replacement`` may be a column)."""
    rep = replacement if isinstance(replacement, Column) else F.lit(replacement)
    pos = F.instr(_c(col), literal)
    return F.when(pos > 0, F.concat(F.substr(_c(col), F.lit(1), pos - 1), rep,
                                    F.substr(_c(col), pos + len(literal)))).otherwise(_c(col))


def extract_int(col) -> Column:
    """first run of digits as a number."""
    return F.regexp_extract(_c(col), r"(\d+)", 1).cast("long")


def pad_left(col, width: int, pad: str = "0") -> Column:
    """F8: left pad that never truncates (Spark's ``lpad`` cuts longer text)."""
    c = _c(col)
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, pad))


def title_case(col) -> Column:
    """capitalise words.  ``initcap`` starts words after spaces only (a
    hyphenated word keeps its second part in lower case)."""
    return F.initcap(_c(col))


def ascii_only(col) -> Column:
    """drop every non-ASCII character."""
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]", "")


def recode(col, mapping: dict, default=None) -> Column:
    """Value recode table with default (the input value unless given).

    The table is a literal map inside the expression: no join, no shuffle."""
    c = _c(col)
    if not mapping:
        return c if default is None else F.lit(default)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(m[c], c if default is None else F.lit(default))


def republican_choice(party="party") -> Column:
    """Binary outcome of the Bernoulli models (NULL when the party is unknown)."""
    return F.when(_c(party).isNull(), F.lit(None).cast("double")) \
            .otherwise(_c(party).isin("republican", "REPUBLICAN").cast("double"))


def not_in(col, values) -> Column:
    """Negated membership that keeps NULL rows."""
    return ~F.coalesce(_c(col).isin(list(values)), F.lit(False))


def parameter_name(variable, *indices) -> Column:
    """``alpha[7]``, ``disc[1,2]`` or, without indices, the bare name; NULL indices
    are left out."""
    inner = F.concat_ws(",", *[_c(i).cast("string") for i in indices])
    return F.when(inner == "", _c(variable)).otherwise(F.concat(_c(variable), F.lit("["), inner, F.lit("]")))
