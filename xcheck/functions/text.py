"""Scalar ``Column -> Column`` functions (JVM-side, codegen friendly).

Every function here builds a Catalyst expression; none of them calls Python per
row. They are the building blocks of the operators in ``xcheck.operators``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


# ---------------------------------------------------------------------------
# Labels and similarity
# ---------------------------------------------------------------------------

def _synonym_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in rules.LABEL_SYNONYMS.items() for x in kv])


def label_words(c) -> Column:
    """lower -> non ``[a-z0-9 ]`` to space -> split -> synonym map (array)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9 ]", " ")), " +")
    words = F.filter(words, lambda w: w != F.lit(""))
    syn = _synonym_map()
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(syn, w), w))


def normalize_label(c) -> Column:
    return F.array_join(label_words(c), " ")


def label_tokens(c) -> Column:
    """Distinct normalised tokens minus stop words (input may be raw or normalised)."""
    stops = F.array(*[F.lit(w) for w in rules.LABEL_STOP_WORDS])
    return F.array_except(label_words(c), stops)


def jaccard(a, b) -> Column:
    """|a ∩ b| / |a ∪ b| over two token arrays; 0 when either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def canonical_label(doc_label, db_label) -> Column:
    """The longer label; the document label wins ties."""
    d, b = _c(doc_label), _c(db_label)
    return F.when(F.length(d) >= F.length(b), d).otherwise(b)


# ---------------------------------------------------------------------------
# Numbers
# ---------------------------------------------------------------------------

def suffix_multiplier(suffix) -> Column:
    s = F.upper(F.substring(_c(suffix), 1, 1))
    out = F.lit(1.0)
    for k, v in rules.SUFFIX_MULTIPLIERS.items():
        out = F.when(s == k, F.lit(v)).otherwise(out)
    return out


def number_from_match(number, sign, suffix) -> Column:
    """Commas removed, scaled by the K/M/B/T suffix, negated by ``-`` or ``–``."""
    v = F.regexp_replace(_c(number), ",", "").cast("double") * suffix_multiplier(suffix)
    return F.when(_c(sign).isin("-", "–"), -v).otherwise(v)


def align_scale(a, b):
    """Snap the smaller of two positive values up by 1000^k when the ratio rounds
    (half-even) to k >= 1 powers of 1000. Returns ``(a', b')`` columns."""
    a, b = _c(a), _c(b)
    hi, lo = F.greatest(a, b), F.least(a, b)
    k = F.bround(F.log(hi / lo) / F.log(F.lit(1000.0)), 0)
    ok = (a > 0) & (b > 0) & (k >= 1)
    scaled = lo * F.pow(F.lit(1000.0), k)
    a2 = F.when(ok & (a < b), scaled).otherwise(a)
    b2 = F.when(ok & (a >= b), scaled).otherwise(b)
    return a2, b2


def format_number_plain(c) -> Column:
    """Thousands separators; integer form if whole, else two decimals."""
    c = _c(c)
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def is_numeric_text(c) -> Column:
    """Parses as a number after removing ``,`` ``$`` and ``%``."""
    return F.regexp_replace(
        strip_ws(_c(c).cast("string")), r"[,$%]", "").try_cast("double").isNotNull()


def numeric_like(c) -> Column:
    """Value as double after removing ``,`` and ``$`` (null when it does not parse)."""
    return F.regexp_replace(_c(c).cast("string"), r"[,$]", "").try_cast("double")


def parse_amount(c) -> Column:
    """``$2.4M`` -> 2.4e6, ``15%`` -> 15, ``3k`` -> 3000; null when it does not parse."""
    low = F.lower(strip_ws(F.regexp_replace(_c(c), r"[$,%]", "")))
    last = F.substring(low, -1, 1)
    body = F.substring(low, F.lit(1), F.length(low) - 1)
    mult = F.when(last == "k", 1e3).when(last == "m", 1e6).when(last == "b", 1e9)
    return F.when(mult.isNotNull(), body.try_cast("double") * mult).otherwise(
        low.try_cast("double"))


def strip_currency(c) -> Column:
    return F.regexp_replace(_c(c), r"[$,]", "").try_cast("double")


def strip_percent(c) -> Column:
    return F.regexp_replace(_c(c), "%", "").try_cast("double") / 100.0


# ---------------------------------------------------------------------------
# Names, hashes, ids
# ---------------------------------------------------------------------------

def clean_column_name(c) -> Column:
    """strip, lower, space -> ``_``, anything else outside ``[a-z0-9_]`` -> ``_``."""
    s = F.lower(strip_ws(_c(c)))
    return F.regexp_replace(F.regexp_replace(s, " ", "_"), "[^a-z0-9_]", "_")


def table_name_from_file(path) -> Column:
    """File stem, cleaned, at most 50 chars; empty -> ``uploaded_data``."""
    base = F.regexp_extract(_c(path), r"([^/\\]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    name = F.substring(clean_column_name(stem), 1, 50)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("uploaded_data"))


def text_hash(c) -> Column:
    return F.sha2(_c(c), 256)


def question_hash(c) -> Column:
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def pad_cik(c) -> Column:
    s = F.regexp_replace(_c(c).cast("string"), "^0+", "")
    return F.lpad(s, 10, "0")


def accession_path(c) -> Column:
    return F.regexp_replace(_c(c), "-", "")


def client_ip(forwarded, peer) -> Column:
    first = F.trim(F.split(_c(forwarded), ",").getItem(0))
    return F.coalesce(F.nullif(first, F.lit("")), _c(peer), F.lit("unknown"))


def metadata_get(json_col, key: str, fallback: str | None = None) -> Column:
    v = F.get_json_object(_c(json_col), f"$.{key}")
    if fallback:
        v = F.coalesce(v, F.get_json_object(_c(json_col), f"$.{fallback}"))
    return v


def squeeze_spaces(c) -> Column:
    return F.regexp_replace(_c(c), " {2,}", " ")


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------

def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); 0 when a norm is 0. Arrays of unequal length are
    truncated to the shorter one (as a zip does)."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    a2, b2 = F.slice(a, 1, n), F.slice(b, 1, n)
    na, nb = norm(a2), norm(b2)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a2, b2) / (na * nb))
