"""PII detection and masking, JVM only.

Each pass replaces the leftmost non-overlapping matches of one pattern. Where the
four digits that a mask keeps stand in fixed places, a pass is one
``regexp_replace`` with the pattern's groups (an alternation has a group in each
branch; branches that did not match add nothing). European numbers may have
separators anywhere between their digits, and an email's mask depends on the
length of its name: their matches are listed, masked one by one and put back
between the stretches that the same pattern splits the text into. Digits and white space are ASCII. Values without a digit or ``@`` pass
through untouched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import squeeze_spaces

def _each_match(c: Column, pattern: str, mask) -> Column:
    """``c`` with ``mask(match)`` in place of every match: the matches are listed,
    masked one by one and put back between what the pattern splits the text into."""
    masked = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), mask)
    put_back = F.zip_with(F.split(c, pattern, -1), masked, lambda between, m: F.concat(between, F.coalesce(m, F.lit(""))))
    return F.when(F.regexp_like(c, F.lit(pattern)), F.array_join(put_back, "")).otherwise(c)


def mask_email(c) -> Column:
    """``john@d.com`` -> ``j***@d.com``; ``a@d.com`` -> ``***@d.com``."""
    def mask(m):
        local = F.substring_index(m, "@", 1)
        head = F.when(F.length(local) > 1, F.left(local, F.lit(1))).otherwise(F.lit(""))
        return F.concat(head, F.lit("***@"), F.substring_index(m, "@", -1))
    return _each_match(F.col(c) if isinstance(c, str) else c, rules.PII_EMAIL, mask)


_START, _END, _SEP = r"(?<!\d)", r"(?!\d)", r"[\s\-.]?"
# the last group of a card number has one to four digits: the rest of the four is the end of the group before
_CARD_PASS = (rf"{_START}(?:4\d{{3}}|5[1-5]\d{{2}}|3[47]\d{{2}}|6011|(?:2131|1800|35\d{{3}}))[\s\-]?\d{{4}}[\s\-]?"
              rf"(?:\d{{4}}[\s\-]?(\d{{4}})|\d{{3}}(\d)[\s\-]?(\d{{3}})|\d{{2}}(\d{{2}})[\s\-]?(\d{{2}})|\d(\d{{3}})[\s\-]?(\d)){_END}")
_SSN_HEAD, _SSN_MIDDLE, _SSN_TAIL = rf"{_START}(?!000|666|9\d{{2}})\d{{3}}", r"(?!00)\d{2}", rf"(?!0000)(\d{{4}}){_END}"
# (pattern, replacement) in order: card, SSN with a hyphen, SSN with white space only, UK, India
MASK_PASSES = [
    (_CARD_PASS, "****-****-****-$1$2$3$4$5$6$7"),
    (rf"{_SSN_HEAD}(?:-{_SSN_MIDDLE}[-\s]|\s{_SSN_MIDDLE}-){_SSN_TAIL}", "***-**-$1"),
    (rf"{_SSN_HEAD}\s{_SSN_MIDDLE}\s{_SSN_TAIL}", "*** ** $1"),
    (rf"{_START}(?:\+44{_SEP}7\d{{3}}{_SEP}\d{{2}}(\d{{4}})|07\d{{3}}{_SEP}\d{{2}}(\d{{4}})){_END}", "***-***-$1$2"),
    (rf"{_START}\+91[\s\-]?\d{{5}}[\s\-]?\d(\d{{4}}){_END}", "***-***-$1"),
]
US_PASS = (rf"{_START}(?:\+?1{_SEP})?(?:\(?\d{{3}}\)?{_SEP})\d{{3}}{_SEP}(\d{{4}}){_END}", "***-***-$1")


def _mask_europe(c: Column) -> Column:
    return _each_match(c, rules.PII_PHONE_EU, lambda m: F.concat(F.lit("***-***-"), F.right(F.regexp_replace(m, r"\D", ""), F.lit(4))))


def mask_value(c) -> Column:
    """Ordered passes: card, SSN, UK, India, EU, US phone, email; null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    out = col
    for pattern, put in MASK_PASSES:
        out = F.regexp_replace(out, pattern, put)
    out = mask_email(F.regexp_replace(_mask_europe(out), *US_PASS))
    return F.when(col.rlike("[0-9@]"), out).otherwise(col)


# --- one value in plain Python, as the tests check the passes against -------

_CARD = re.compile(rules.PII_CARD)
_SSN = re.compile(rules.PII_SSN)
_UK = re.compile(rules.PII_PHONE_UK)
_IN = re.compile(rules.PII_PHONE_IN)
_EU = re.compile(rules.PII_PHONE_EU)
_US = re.compile(rules.PII_PHONE_US)
_EMAIL = re.compile(rules.PII_EMAIL, re.IGNORECASE)
_NONDIGIT = re.compile(r"\D")


def _last4(m: re.Match) -> str:
    return _NONDIGIT.sub("", m.group())[-4:]


def _card(m):
    return "****-****-****-" + _last4(m)


def _ssn(m):
    sep = "-" if "-" in m.group() else " "
    return f"***{sep}**{sep}{_last4(m)}"


def _phone(m):
    return "***-***-" + _last4(m)


def _email(m):
    local, domain = m.group().split("@", 1)
    return (local[0] + "***" if len(local) > 1 else "***") + "@" + domain


_PASSES = [(_CARD, _card), (_SSN, _ssn), (_UK, _phone), (_IN, _phone), (_EU, _phone), (_US, _phone),
           (_EMAIL, _email)]
_MAYBE = re.compile(r"[0-9@]")


def mask_text(s):
    """Ordered passes: card, SSN, UK, India, EU, US phone, email."""
    if not isinstance(s, str) or not _MAYBE.search(s):
        return s
    for rx, fn in _PASSES:
        s = rx.sub(fn, s)
    return s


def mask_pii(df: DataFrame, cols: list[str] | None = None, tabular: bool = False) -> DataFrame:
    """Mask PII in the given string columns (default: every string column).
    ``tabular=True`` first squeezes runs of spaces (padded table output)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    out = []
    for f in df.columns:
        if f in cols:
            src = squeeze_spaces(F.col(f)) if tabular else F.col(f)
            out.append(mask_value(src).alias(f))
        else:
            out.append(F.col(f))
    return df.select(*out)


def pii_counts(c) -> Column:
    """struct(email, phone, ssn, credit_card) hit counts in one value (JVM)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.struct(*[F.coalesce(F.size(F.regexp_extract_all(col, F.lit(p), 0)), F.lit(0)).alias(k)
                      for k, p in rules.PII_SUMMARY_KINDS])


def pii_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Totals per PII kind over all given string columns (one pass, one row)."""
    kinds = [k for k, _ in rules.PII_SUMMARY_KINDS]
    per = df.select(*[pii_counts(c).alias(f"_{i}") for i, c in enumerate(cols)])
    per = per.select(*[sum((F.col(f"_{i}.{k}") for i in range(len(cols))), F.lit(0)).alias(k) for k in kinds])
    return per.agg(*[F.sum(k).cast("long").alias(k) for k in kinds])
