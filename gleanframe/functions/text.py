"""Text, number and date scalars as Catalyst column expressions.

Nothing here leaves the JVM: every function takes a Column and returns a Column
built from built-in functions, so it can be used in filters, projections,
higher-order lambdas and streams alike.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.binding import let

# Fixed value: the characters str.isspace() accepts, as a Java character class body.
WS_CHARS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# The coarse ranges before it settle most characters in three comparisons.
WS = rf"[\x00-\x20\x85\xA0\u1680-\u3000&&[{WS_CHARS}]]+"
# The same characters one by one, for trimming.
WS_EACH = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# An amount, and a bare date in running text.
NUMBER = rf"-?\p{{Nd}}[\p{{Nd}}{WS_CHARS}]*(?:[,.]\p{{Nd}}+)?"
DATE_IN_TEXT = rf"(?U)\b\d{{2}}\.\d{{2}}\.\d{{4}}(?:[{WS_CHARS}]+\d{{2}}:\d{{2}}(?::\d{{2}})?)?\b"

# Labels that end a labelled value in flat text.
COMMON_LABELS = (
    "Статус",
    "Статус закупки",
    "Дата",
    "Дата размещения",
    "Дата публикации",
    "Размещено",
    "Заказчик",
    "Наименование заказчика",
    "Окончание подачи заявок",
    "Дата и время окончания подачи заявок",
    "Начальная цена",
    "Начальная (максимальная) цена контракта",
    "НМЦК",
    "Артикул",
    "Код товара",
    "SKU",
)

# Longest text a labelled value may have in flat text (fixed value).
LABEL_VALUE_MAX = 240

PARSE_DECIMAL_TYPE = "decimal(38,10)"
MONEY_TYPE = "decimal(18,2)"

_ISO = (
    r"^((?!0000)\d{4}-\d{2}-\d{2})"
    r"(?:.(\d{2})(?:(:\d{2})(:\d{2}(?:\.\d{3}(?:\d{3})?)?)?)?([+-]\d{2}:\d{2}(?::\d{2})?)?)?$"
)
_DAY_FIRST = r"^(\d{1,2})\.(\d{1,2})\.(?!0000)(\d{4})(?: (\d{1,2}:\d{1,2})(:\d{1,2})?)?$"
_YEAR_FIRST = r"^((?!0000)\d{4}-\d{1,2}-\d{1,2}) (\d{1,2}:\d{1,2})(:\d{1,2})?$"


def _digit_table() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII value, from the Unicode database."""
    pairs = [
        (chr(c), str(unicodedata.decimal(chr(c))))
        for c in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_DIGITS_FROM, _DIGITS_TO = _digit_table()


def _null_where(x: Column, value: Column) -> Column:
    # ``nullif`` is planned as a test and a second copy of ``x``, which doubles with every level of
    # nesting inside lambdas and branches; here ``x`` is there once.
    return F.get(F.array_remove(F.array(x), value), F.lit(0))


def blank_to_null(x: Column) -> Column:
    return _null_where(x, F.lit(""))


def first_match(x: Column, pattern: str) -> Column:
    """The first match of a pattern, null if there is none (or an empty one)."""
    return blank_to_null(F.regexp_extract(x, pattern, 0))


def first_non_empty(*xs: Column) -> Column:
    """First argument that is neither null nor the empty string."""
    return F.coalesce(*[blank_to_null(x) for x in xs])


def first_non_zero(*xs: Column) -> Column:
    """First argument that is neither null nor zero; the last one is taken as it is."""
    return F.coalesce(*[_null_where(x, F.lit(0).cast(PARSE_DECIMAL_TYPE)) for x in xs[:-1]], xs[-1])


def clean_text(x: Column) -> Column:
    """Collapse Unicode whitespace to single spaces and strip; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), WS, " "))


def parse_decimal(x: Column) -> Column:
    """First amount in the text, with ``,`` or ``.`` as the decimal mark; null if none."""
    found = first_match(F.replace(x, F.lit("\u00a0"), F.lit(" ")), NUMBER)
    number = F.replace(F.replace(found, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    number = F.regexp_replace(number, f"{WS}$", "")
    number = F.translate(number, _DIGITS_FROM, _DIGITS_TO)
    return number.try_cast(PARSE_DECIMAL_TYPE)


def to_money(x: Column) -> Column:
    """Storage precision of an amount; null where it does not fit."""
    return x.try_cast(MONEY_TYPE)


def parse_datetime(x: Column) -> Column:
    """ISO or day-first date text as a UTC instant; text without an offset is UTC.

    The pieces are rewritten to one full ISO form with an explicit offset before the
    cast, so the result does not depend on the session time zone.
    """
    return let(F.replace(clean_text(x), F.lit("Z"), F.lit("+00:00")), _parse_clean_datetime)


def _parse_clean_datetime(text: Column) -> Column:
    def part(pattern: str, group: int, default: str) -> Column:
        return F.coalesce(blank_to_null(F.regexp_extract(text, pattern, group)), F.lit(default))

    iso = F.concat(
        F.regexp_extract(text, _ISO, 1),
        F.lit("T"),
        part(_ISO, 2, "00"),
        part(_ISO, 3, ":00"),
        part(_ISO, 4, ":00"),
        part(_ISO, 5, "+00:00"),
    )
    day_first = F.concat(
        F.regexp_replace(text, _DAY_FIRST, "$3-$2-$1T"),
        part(_DAY_FIRST, 4, "00:00"),
        part(_DAY_FIRST, 5, ":00"),
        F.lit("+00:00"),
    )
    year_first = F.concat(
        F.regexp_replace(text, _YEAR_FIRST, "$1T$2"), part(_YEAR_FIRST, 3, ":00"), F.lit("+00:00")
    )
    full = (
        F.when(text.rlike(_ISO), iso)
        .when(text.rlike(_DAY_FIRST), day_first)
        .when(text.rlike(_YEAR_FIRST), year_first)
    )
    return full.try_cast("timestamp")


def first_date(text: Column) -> Column:
    """First bare ``dd.mm.yyyy`` date in running text, with its time if there is one."""
    return first_match(text, DATE_IN_TEXT)


def date_or_first_in_text(labelled: Column, text: Column) -> Column:
    """The labelled date if there is any text for it, else the first bare date in ``text``."""
    return parse_datetime(F.coalesce(blank_to_null(labelled), first_date(text)))


def _quote(label: str) -> str:
    return "\\Q" + label.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def flat_label_pattern(label: str, labels: Iterable[str]) -> str:
    """Pattern of ``label: value`` in running text, ended by any other label or the end."""
    others = sorted((set(labels) | set(COMMON_LABELS)) - {label}, key=lambda s: (-len(s), s))
    ends = "|".join(_quote(s) for s in others)
    return (
        f"(?iu){_quote(label)}\\s*[:№-]?\\s*(.{{1,{LABEL_VALUE_MAX}}}?)"
        f"(?=\\s+(?:{ends})\\s*[:№-]|$)"
    )


def folded(x: Column) -> Column:
    """Text in one case, folding at least what a case-insensitive pattern takes as equal."""
    return F.lower(F.upper(x))


def _value_after(base: Column, label: str, labels: list[str]) -> Column:
    found = F.regexp_extract(base, flat_label_pattern(label, labels), 1)
    return blank_to_null(F.btrim(found, F.lit(" -:;")))


def flat_labeled_values(text: Column, groups: Iterable[Iterable[str]]) -> Column:
    """For each group of labels the value after the first of them that has one (null if none does).

    The text is cleaned and folded once for all groups.
    """
    groups = [list(labels) for labels in groups]

    def values(base: Column, low: Column) -> Column:
        # A text without the label has no match.
        return F.array(*[
            F.coalesce(*[
                F.when(F.contains(low, F.lit(label.upper().lower())), _value_after(base, label, labels))
                for label in labels
            ])
            for labels in groups
        ])

    return let(clean_text(text), lambda base: let(folded(base), lambda low: values(base, low)))


def flat_labeled_value(text: Column, labels: Iterable[str], cleaned: bool = False) -> Column:
    """Value after the first of ``labels`` that has one; null if none does."""
    if not cleaned:
        return F.get(flat_labeled_values(text, [labels]), F.lit(0))
    labels = list(labels)
    return F.coalesce(*[_value_after(text, label, labels) for label in labels])


def strip_number_sign(x: Column) -> Column:
    """Drop leading ``№`` signs and spaces."""
    return F.regexp_replace(x, "^[№ ]+", "")


def unique_strings(xs: Column) -> Column:
    """Distinct non-empty strings in first-seen order."""
    return F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & (x != "")))
