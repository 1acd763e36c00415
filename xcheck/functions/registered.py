"""SQL names for the library's functions.

``register_all(spark)`` makes them temporary functions of the session. All but
one are SQL functions whose bodies are expressions: Spark puts the body in place
of the call, so a query that uses them is planned as if it had been written out
(no Python worker, pushdown and code generation as usual). ``chunk_text`` walks a
text span by span and is a Python table function with Arrow transfer; call it
with ``LATERAL``. The bodies are put together from the same fixed values as the
Column functions of ``functions.text`` and give the same results.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import rules


def _q(text: str) -> str:
    """SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(r'^\s+|\s+$')}, '')"


def _words(x: str) -> str:
    synonyms = ", ".join(_q(v) for kv in rules.LABEL_SYNONYMS.items() for v in kv)
    plain = f"filter(split(trim(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ')), ' +'), w -> w <> '')"
    return f"transform({plain}, w -> coalesce(try_element_at(map({synonyms}), w), w))"


def _label(x: str) -> str:
    return f"array_join({_words(x)}, ' ')"


def _tokens(x: str) -> str:
    return f"array_except({_words(x)}, array({', '.join(map(_q, rules.LABEL_STOP_WORDS))}))"


def _number(sign: str, number: str, suffix: str) -> str:
    times = " ".join(f"WHEN {_q(k)} THEN {float(v)!r}D" for k, v in rules.SUFFIX_MULTIPLIERS.items())
    value = f"CAST(regexp_replace({number}, ',', '') AS DOUBLE) * CASE upper(substring({suffix}, 1, 1)) {times} ELSE 1.0D END"
    return f"CASE WHEN {sign} IN ('-', '–') THEN -({value}) ELSE {value} END"


def _amount(x: str) -> str:
    low = f"lower({_strip(f'regexp_replace({x}, {_q('[$,%]')}, {_q('')})')})"
    times = f"CASE substring({low}, -1, 1) WHEN 'k' THEN 1e3D WHEN 'm' THEN 1e6D WHEN 'b' THEN 1e9D END"
    return f"CASE WHEN {times} IS NOT NULL THEN try_cast(substring({low}, 1, length({low}) - 1) AS DOUBLE) * {times} ELSE try_cast({low} AS DOUBLE) END"


def _cosine(a: str, b: str) -> str:
    n = f"least(size({a}), size({b}))"
    dot = lambda x, y: f"aggregate(zip_with(slice({x}, 1, {n}), slice({y}, 1, {n}), (p, q) -> p * q), 0.0D, (s, v) -> s + coalesce(v, 0.0D))"
    return f"CASE WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN 0.0D ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END"


def _aligned(a: str, b: str) -> str:
    k = f"bround(ln(greatest({a}, {b}) / least({a}, {b})) / ln(1000.0D), 0)"
    up, ok = f"least({a}, {b}) * pow(1000.0D, {k})", f"({a} > 0 AND {b} > 0 AND {k} >= 1)"
    return f"named_struct('a', CASE WHEN {ok} AND {a} < {b} THEN {up} ELSE {a} END, 'b', CASE WHEN {ok} AND {a} >= {b} THEN {up} ELSE {b} END)"


def _each_match(x: str, pattern: str, mask: str) -> str:
    p = _q(pattern)
    put = f"zip_with(split({x}, {p}, -1), transform(regexp_extract_all({x}, {p}, 0), m -> {mask}), (between, m) -> concat(between, coalesce(m, '')))"
    return f"CASE WHEN regexp_like({x}, {p}) THEN array_join({put}, '') ELSE {x} END"


_EMAIL_MASK = "concat(CASE WHEN length(substring_index(m, '@', 1)) > 1 THEN left(m, 1) ELSE '' END, '***@', substring_index(m, '@', -1))"


def _facts(x: str, least: int = 3) -> str:
    """Distinct facts of a text, each with its place in scan order."""
    found = "concat(" + ", ".join(f"transform(regexp_extract_all({x}, {_q('(?i)' + p)}, 0), m -> named_struct('p', {k}, 'm', m))" for k, p in enumerate(rules.FACT_PATTERNS)) + ")"
    group = lambda g: "CASE f.p " + " ".join(f"WHEN {k} THEN regexp_extract(f.m, {_q('(?i)^' + p)}, {g})" for k, p in enumerate(rules.FACT_PATTERNS)) + " END"
    read = f"transform({found}, (f, i) -> named_struct('ix', i, 'm', f.m, 'g1', {group(1)}, 'g2', {group(2)}, 'g3', {group(3)}, 'g4', {group(4)}))"
    parsed = f"transform({read}, r -> named_struct('label', {_label('r.g1')}, 'value', {_number('r.g2', 'r.g3', 'r.g4')}, 'ix', r.ix, 'raw_text', {_strip('r.m')}))"
    keyed = f"transform(filter({parsed}, k -> length(k.label) >= {least}), k -> named_struct('label', k.label, 'v2', bround(k.value, 2), 'ix', k.ix, 'value', k.value, 'raw_text', k.raw_text))"
    heads = (f"aggregate(array_sort({keyed}), cast(array() as array<struct<label: string, v2: double, ix: int, value: double, raw_text: string>>), "
             "(have, k) -> CASE WHEN size(have) > 0 AND element_at(have, -1).label = k.label AND element_at(have, -1).v2 = k.v2 THEN have ELSE concat(have, array(k)) END)")
    return f"transform({heads}, k -> named_struct('ix', k.ix, 'label', k.label, 'value', k.value, 'raw_text', k.raw_text))"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, type, body)"""
    from ..operators import pii
    numbers = "s"
    for pattern, put in pii.MASK_PASSES:
        numbers = f"regexp_replace({numbers}, {_q(pattern)}, {_q(put)})"
    europe = "concat('***-***-', right(regexp_replace(m, " + _q(r"\D") + ", ''), 4))"
    return {
        "normalize_label": ("s STRING", "STRING", _label("s")),
        "label_tokens": ("s STRING", "ARRAY<STRING>", _tokens("s")),
        "jaccard_labels": ("a STRING, b STRING", "DOUBLE",
                           f"CASE WHEN size({_tokens('a')}) = 0 OR size({_tokens('b')}) = 0 THEN 0.0D ELSE "
                           f"size(array_intersect({_tokens('a')}, {_tokens('b')})) / size(array_union({_tokens('a')}, {_tokens('b')})) END"),
        "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _cosine("a", "b")),
        "align_scale": ("a DOUBLE, b DOUBLE", "STRUCT<a: DOUBLE, b: DOUBLE>", _aligned("a", "b")),
        "parse_amount": ("s STRING", "DOUBLE", _amount("s")),
        "strip_currency": ("s STRING", "DOUBLE", f"try_cast(regexp_replace(s, {_q('[$,]')}, '') AS DOUBLE)"),
        "strip_percent": ("s STRING", "DOUBLE", "try_cast(regexp_replace(s, '%', '') AS DOUBLE) / 100.0D"),
        "is_numeric_text": ("s STRING", "BOOLEAN", f"try_cast(regexp_replace({_strip('s')}, {_q('[,$%]')}, '') AS DOUBLE) IS NOT NULL"),
        "clean_column_name": ("s STRING", "STRING", f"regexp_replace(regexp_replace(lower({_strip('s')}), ' ', '_'), '[^a-z0-9_]', '_')"),
        "pad_cik": ("s STRING", "STRING", "lpad(regexp_replace(s, '^0+', ''), 10, '0')"),
        "accession_path": ("s STRING", "STRING", "regexp_replace(s, '-', '')"),
        "question_hash": ("s STRING", "STRING", "substring(sha2(s, 256), 1, 16)"),
        "client_ip": ("forwarded STRING, peer STRING", "STRING", "coalesce(nullif(trim(split(forwarded, ',')[0]), ''), peer, 'unknown')"),
        "metadata_get": ("meta STRING, name STRING, fallback STRING", "STRING",
                         "coalesce(get_json_object(meta, concat('$.', name)), get_json_object(meta, concat('$.', fallback)))"),
        "squeeze_spaces": ("s STRING", "STRING", "regexp_replace(s, ' {2,}', ' ')"),
        "vector_from_json": ("s STRING", "ARRAY<DOUBLE>", "from_json(s, 'array<double>')"),
        "mask_email": ("s STRING", "STRING", _each_match("s", rules.PII_EMAIL, _EMAIL_MASK)),
        "mask_numbers": ("s STRING", "STRING", numbers),
        "mask_europe": ("s STRING", "STRING", _each_match("s", rules.PII_PHONE_EU, europe)),
        "mask_pii": ("s STRING", "STRING", f"CASE WHEN s rlike '[0-9@]' THEN mask_email(regexp_replace(mask_europe(mask_numbers(s)), {_q(pii.US_PASS[0])}, {_q(pii.US_PASS[1])})) ELSE s END"),
        "extract_facts": ("text STRING", "ARRAY<STRUCT<ix: INT, label: STRING, value: DOUBLE, raw_text: STRING>>",
                          f"CASE WHEN text rlike '[0-9]' THEN {_facts('text')} END"),
    }


def _chunk_table():
    from ..operators.chunking import chunks_of

    class ChunkText:
        def eval(self, text: str, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP):
            yield from enumerate(chunks_of(text, size, overlap))

    return F.udtf(ChunkText, returnType="chunk_ix int, chunk string", useArrow=True)


def register_all(spark: SparkSession) -> list[str]:
    """Define every function in the session (existing ones of the name are
    replaced) and return their names."""
    for name, (arguments, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunk_text", _chunk_table())
    return [*definitions(), "chunk_text"]
