"""Currency tokens, signs and markers of monetary values.

A value is its number, from the first digit to the last, and what stands around it.  The surroundings are short, so one
expression over them (``before#behind``) decides at once whether token, sign, marker and parentheses stand as they may;
the sign follows from which of them are there.  The number itself is not looked at here.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import full_match, named, trim, without

#: Currency symbols and composites, then ISO codes.
SYMBOLS = ("$", "€", "£", "¥", "₹", "₩", "₪", "₿", "₺", "₽", "₴", "₫", "₦", "₱", "₭", "₲", "₡", "R$", "C$", "A$", "AU$", "NZ$", "S$", "HK$", "MX$", "CN¥")
CODES = ("USD", "EUR", "JPY", "GBP", "CNY", "CHF", "CAD", "AUD", "HKD", "SGD", "SEK", "NOK", "NZD", "MXN", "INR", "KRW", "BRL", "ZAR", "TRY", "AED")

#: Any token in lower case, longer ones first.
TOKEN = "(?:" + "|".join(sorted((re.escape(t.lower()) for t in SYMBOLS + CODES), key=lambda t: (-len(t), t))) + ")"
#: Blanks; next to the number also what groups digits.
_GAP, _BY_NUMBER = r"[\s\p{Zs}]*", r"[\s\p{Zs}']*"


def words_of_sign(cr_negative: bool) -> tuple[str, str]:
    """The words that read as negative and as positive."""
    return ("CR", "DR") if cr_negative else ("DR", "CR")


def _around(*forms: str) -> str:
    """An expression for ``before#behind``: T a token or none, TT a token, blanks anywhere in between."""
    parts = {"TT": TOKEN, "T": f"{TOKEN}?", "(": r"\(", ")": r"\)", "+": r"\+", "-": "-", "+-": "[+-]", "+?": r"\+?", "+-?": "[+-]?", "#": f"{_BY_NUMBER}#{_BY_NUMBER}"}
    return r"\A(?:" + "|".join(_GAP.join(parts.get(p, p) for p in form.split()) for form in forms) + r")\z"


_CURRENCY = ("+-? T # T", "TT +- # T", "T # - T", "T ( T # T ) T")


def _signed_forms(cr_negative: bool) -> tuple[str, ...]:
    n, p = (w.lower() for w in words_of_sign(cr_negative))
    return f"{n} #", f"# {n}", f"{p} +-? #", f"+? # {p}", "- #", "# -", "+ +-? #", "# +", "( # )", "#"


def _accounting_forms(cr_negative: bool) -> tuple[str, ...]:
    n, p = (w.lower() for w in words_of_sign(cr_negative))
    marked = f"{n} T # T", f"T # T {n}", f"{p} +-? T # T", f"{p} TT +- # T", f"+? T # T {p}", f"TT +- # T {p}"
    return *marked, "T # T -", "+ +-? T # T", "+ TT +- # T", "T # T +", "TT +- # T +", *_CURRENCY


#: Shapes of ``before#behind`` that most values have, with T for a token, which no text in lower case holds.
_SHAPES = ("#", "T#", "T #", "#T", "# T", "-#", "#-", "-T#", "-T #", "T-#", "T#-", "(#)", "(T#)", "(T #)", "(#T)", "+#", "#+", "# cr", "# dr", "cr #", "dr #")


@lru_cache
def _decided(pattern: str, negative: str) -> dict[str, tuple[str, ...]]:
    """The shapes among _SHAPES whose sign is the same with every token, by sign, as the two expressions find it; all others are left to these."""
    fits, minus = (re.compile(p.replace(r"\z", r"\Z").replace(r"\p{Zs}", "")) for p in (pattern, negative))
    found: dict[str, list[str]] = {}
    for shape in _SHAPES:
        texts = [shape.replace("T", t.lower()) for t in SYMBOLS + CODES] if "T" in shape else [shape]
        signs = {("-" if minus.search(x) else "+" if "+" in x else "") if fits.search(x) else None for x in texts}
        if len(signs) == 1 and None not in signs:
            found.setdefault(signs.pop(), []).append(shape)
    return {sign: tuple(shapes) for sign, shapes in found.items()}


class Cut(NamedTuple):
    """A value in lower case, what stands before and behind its number, and the shape of that."""

    low: Column
    before: Column
    behind: Column
    shape: Column


def _low(c: Column) -> Column:
    return F.lower(trim(c))


def _flat(low: Column) -> Column:
    """Every digit as 0, so that the first and the last one can be found."""
    return reduce(lambda text, digit: F.replace(text, F.lit(digit), F.lit("0")), "123456789", low)


def _before(low: Column, flat: Column) -> Column:
    found = F.substring(low, F.lit(1), F.greatest(F.instr(flat, "0") - 1, F.lit(0)))
    return F.when(found.endswith(".") | found.endswith(","), F.rtrim(found, F.lit(".,"))).otherwise(found)


def _behind(low: Column, flat: Column) -> Column:
    found = F.right(low, F.instr(F.reverse(flat), "0") - 1)
    return F.when(found.startswith(".") | found.startswith(","), F.ltrim(found, F.lit(".,"))).otherwise(found)


def _shape(before: Column, behind: Column) -> Column:
    """``before#behind`` with T for its token if signs, parentheses and blanks are all that stands beside that; else as it is."""
    surroundings = F.concat(before, F.lit("#"), behind)
    bare = without(surroundings, "#()+- ")
    return F.when(bare.isin(*(t.lower() for t in SYMBOLS + CODES)), F.replace(surroundings, bare, F.lit("T"))).otherwise(surroundings)


def stages(c: Column, name: str) -> tuple[Cut, list[dict[str, Column]]]:
    """The cut as references to columns, and the levels of columns to compute first."""
    own = lambda part: f"__{part}__{name}"
    ref = lambda part: named(own(part))
    low, flat = ref("low"), ref("flat")
    levels = [{own("low"): _low(c)}, {own("flat"): _flat(low)}, {own("before"): _before(low, flat), own("behind"): _behind(low, flat)}, {own("shape"): _shape(ref("before"), ref("behind"))}]
    return Cut(low, ref("before"), ref("behind"), ref("shape")), levels


def cut(c: Column) -> Cut:
    low = _low(c)
    before, behind = _before(low, _flat(low)), _behind(low, _flat(low))
    return Cut(low, before, behind, _shape(before, behind))


def _candidate(x: Cut, pattern: str, negative: str) -> Column:
    """The number with a minus if the surroundings hold one of the ``negative`` marks; the whole value if they are not in order."""
    number = F.substring(x.low, F.length(x.before) + 1, F.length(x.low) - F.length(x.before) - F.length(x.behind))
    around = F.concat(x.before, F.lit("#"), x.behind)
    sign = F.when(around.rlike(negative), "-").when(around.contains("+"), "+").otherwise("")
    # A number alone, by far the most frequent, needs no look around; a value without digits has nothing before them.
    read = F.when((x.before == "") & (x.behind == ""), x.low)
    # Most surroundings have a shape whose sign is known beforehand; the expressions are tried on the others.
    for known, shapes in _decided(pattern, negative).items():
        read = read.when(x.shape.isin(*shapes), F.concat(F.lit(known), number))
    return read.when(around.rlike(pattern), F.concat(sign, number)).otherwise(x.low)


def candidate_of(x: Cut, kind: str, cr_negative: bool = True) -> Column:
    """The number of a currency, signed or accounting value as text.

    currency: at most one token at either end, one sign (in front or behind) or parentheses.  signed: a sign or CR or DR at
    either end, or parentheses.  accounting: both; CR and DR stand outside the token and are never taken for one.
    """
    forms = {"currency": _CURRENCY, "signed": _signed_forms(cr_negative), "accounting": _accounting_forms(cr_negative)}[kind]
    return _candidate(x, _around(*forms), "[(-]" + ("" if kind == "currency" else "|" + words_of_sign(cr_negative)[0].lower()))


def currency_candidate(c: Column) -> Column:
    return candidate_of(cut(c), "currency")


def percentage_candidate(c: Column) -> Column:
    """Without the percent sign; the value is not divided."""
    bare = trim(c)
    return F.when(bare.endswith("%"), trim(F.rtrim(F.left(bare, F.length(bare) - 1), F.lit(" \t\n\v\f\r")))).otherwise(bare)


def signed_candidate(c: Column, cr_negative: bool = True) -> Column:
    return candidate_of(cut(c), "signed", cr_negative)


def accounting_candidate(c: Column, cr_negative: bool = True) -> Column:
    return candidate_of(cut(c), "accounting", cr_negative)


# What a value's notation is: all of it is read off what stands around the number, where # stands for the number


def around_stages(c: Column, name: str) -> tuple[Column, list[dict[str, Column]]]:
    """The surroundings as a reference to a column, and the levels of columns to compute first; a value without digits is all surroundings."""
    x, levels = stages(c, name)
    own = f"__around__{name}"
    return named(own), [*levels, {own: F.when(x.low.rlike("[0-9]"), F.concat(x.before, F.lit("#"), x.behind)).otherwise(x.low)}]


def around(c: Column) -> Column:
    x = cut(c)
    return F.when(x.low.rlike("[0-9]"), F.concat(x.before, F.lit("#"), x.behind)).otherwise(x.low)


def _either(cr_negative: bool) -> str:
    return "(?:" + "|".join(words_of_sign(cr_negative)).lower() + ")?"


def _token(surroundings: Column, accounting: bool, cr_negative: bool) -> tuple[Column, Column]:
    """The token that opens a value and the one that closes it, behind and before signs, parentheses on both sides and, for accounting, CR or DR; '' for none."""
    word = _either(cr_negative) if accounting else ""
    opens = rf"\A{word}{_GAP}(?:\((?=.*\){_GAP}{word}\z))?{_GAP}(?:[+-]{_GAP})?({TOKEN}){_GAP}."
    # The dot takes what it can, so that of tokens that end alike the shortest is found.
    closes = rf"\A.+({TOKEN}){_GAP}[+-]?{_GAP}\)?{_GAP}{word}\z"
    return F.regexp_extract(surroundings, opens, 1), F.regexp_extract(surroundings, closes, 1)


def currency_symbol(surroundings: Column, accounting: bool = False, cr_negative: bool = True) -> Column:
    """The token that opens the value, else the one that closes it, in upper case; null if there is none."""
    first, last = _token(surroundings, accounting, cr_negative)
    return F.upper(F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))


def symbol_position(surroundings: Column, accounting: bool = False, cr_negative: bool = True) -> Column:
    first, last = _token(surroundings, accounting, cr_negative)
    return F.when(first != "", "prefix").when(last != "", "suffix")


def token_form(symbol: Column) -> Column:
    """code: letters alone; composite: letters and others; symbol: no letter."""
    return F.when(full_match(symbol, r"\p{L}+"), "code").when(symbol.rlike(r"\p{L}"), "composite").otherwise("symbol")


def _at_either_end(word: str) -> str:
    return rf"\A{word}.|.{word}\z"


def marker_of(surroundings: Column, marker: str) -> Column:
    """The marker if the value begins or ends with it and holds more; else null."""
    return F.when(surroundings.rlike(_at_either_end(marker.lower())), marker)


def sign_notation(surroundings: Column, cr_negative: bool = True) -> Column:
    """How a value shows its sign: the first of these shapes that its surroundings have."""
    negative, positive = (_at_either_end(w.lower()) for w in words_of_sign(cr_negative))
    shapes = {"negative_marker": negative, "positive_marker": positive, "parentheses": r"\A\(.+\)\z", "leading_sign": r"\A[+-].", "trailing_sign": r".[+-]\z"}
    return F.coalesce(*(F.when(surroundings.rlike(shape), name) for name, shape in shapes.items()), F.lit("unsigned"))
