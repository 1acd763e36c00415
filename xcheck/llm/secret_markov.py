"""Secret scans in DataFrame functions only.

Fixed patterns find assigned passwords and keys, access key ids and long hex
strings. Beyond them, two character Markov models judge every long token: one of
random strings, learned from what the patterns found, one of ordinary
identifiers, learned from the other words and their upper-case forms. A token
whose log-likelihood ratio exceeds ``LEAST`` in sum and ``RATIO`` per transition
is a secret too, with or without digits: short ones must say more each. Both are counted on a
bounded hash sample of documents (``SAMPLE`` documents, about); the scan itself
reads every whole text. Scores are sums over a literal array of log ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base rules, as (kind, pattern, group, least characters of the group)
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
LEARNED = "markov"
# whole runs of 12 or more characters
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SAMPLE = 5_000
SMOOTHING = 20.0
FLOOR = 0.002           # least back-off probability of a character
LIMIT = 3.0             # bound of one transition's log ratio
RATIO = 0.4             # mean log ratio per transition (natural logarithm)
LEAST = 6.0             # log ratio of all transitions together: decides up to 16 characters

_KIND_ORDER = {k: i for i, (k, *_) in enumerate(RULES)} | {LEARNED: len(RULES)}


def _matches(text: Column, pattern: str, group: int, only: Column | None = None) -> Column:
    """array<struct<start, end, value>> of all matches (whose value is in the array
    ``only``) in code points: a match starts after the pieces between the matches
    and the matches before it."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(whole.alias("w"), value.alias("v"), gaps.alias("g"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, r):
        lo = acc["at"] + r["g"]
        hi = lo + F.length(r["w"])
        more = F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), r["v"].alias("value"))))
        return F.struct(hi.alias("at"), (more if only is None else F.when(F.array_contains(only, r["v"]), more).otherwise(acc["out"])).alias("out"))

    got = F.aggregate(F.filter(rows, lambda r: r["w"].isNotNull()), start, step)["out"]
    return F.when(text.rlike(pattern) if only is None else F.size(only) > 0, got).otherwise(empty)


def _base(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> of the base rules' spans, in order."""
    def of(kind, pattern, group, least):
        spans = F.filter(_matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        rank = F.lit(_KIND_ORDER[kind])
        return F.transform(spans, lambda m: F.struct(m["start"], rank.alias("rank"), m["end"], F.lit(kind).alias("kind"), m["value"]))

    return F.array_sort(F.concat(*[of(*rule) for rule in RULES]))


def _pairs(value: Column) -> Column:
    """Neighbouring characters as first * size + second, places in the alphabet (0: none of it)."""
    size = len(ALPHABET) + 1
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    ahead = F.slice(places, F.lit(2), F.greatest(F.length(value), F.lit(1)))
    return F.zip_with(places, ahead, lambda a, b: a * size + F.coalesce(b, F.lit(0)))


def train(docs: DataFrame, text_col: str, sample: int = SAMPLE) -> list[float]:
    """Log ratios (random over ordinary) of all transitions."""
    total = docs.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    some = docs.select(F.col(text_col).alias("t")).filter((F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < share) & F.col("t").isNotNull())
    random = some.select(F.explode(F.transform(_base(F.col("t")), lambda s: s["value"])).alias("v"), F.lit(1).alias("random")).filter("v rlike '[0-9]'")
    # ordinary: words of letters (any of the sample), identifiers with joints included
    words = F.regexp_extract_all(F.col("t"), F.lit(r"(?<![A-Za-z0-9])[A-Za-z][a-z]{3,}+(?:[_-]?[A-Z]?[a-z]{2,}+|[_-]?[0-9]++)*+(?![A-Za-z0-9])"), F.lit(0))
    ordinary = some.select(F.explode(words).alias("v"), F.lit(0).alias("random"))
    ordinary = ordinary.groupBy("v", "random").agg(F.count("*").alias("n"))      # distinct words first
    ordinary = ordinary.unionByName(ordinary.filter("v rlike '^[A-Za-z]+$'").withColumn("v", F.upper("v")))     # in capitals too
    seen = random.withColumn("n", F.lit(1).cast("long")).unionByName(ordinary.select("v", "random", "n"))
    counts = (seen.select("random", "n", F.explode(_pairs(F.col("v"))).alias("pair")).filter("n > 0")
              .groupBy("random", "pair").agg(F.sum("n").alias("n")).collect())      # two tables of the alphabet squared
    size = len(ALPHABET) + 1
    table = [[0.0] * (size * size) for _ in range(2)]
    for r in counts:
        if r.pair // size and r.pair % size:
            table[r.random][r.pair] += r.n
    digits = {1 + ALPHABET.index(c) for c in "0123456789"}
    even = 1 / 62                       # random strings come in several alphabets
    capital = {1 + ALPHABET.index(c) for c in ALPHABET if c.isupper()}

    def back_off(rows):
        seen = [sum(table[0][a * size + b] for a in rows) for b in range(size)]
        return [max(FLOOR, x / max(1.0, sum(seen[1:]))) for x in seen]

    after = {True: back_off(capital), False: back_off(set(range(1, size)) - capital)}     # after a capital, after others
    out = [0.0] * (size * size)
    for a in range(1, size):
        plain = after[a in capital]
        left = [sum(t[a * size + 1:a * size + size]) for t in table]
        for b in range(1, size):
            if a in digits and b in digits:
                continue                # a number is neither
            p0 = (table[0][a * size + b] + SMOOTHING * plain[b]) / (left[0] + SMOOTHING)
            p1 = 0.5 * even + 0.5 * (table[1][a * size + b] + SMOOTHING * even) / (left[1] + SMOOTHING)
            out[a * size + b] = max(-LIMIT, min(LIMIT, math.log(p1 / p0)))
    return out


def _literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def secret_spans(docs: DataFrame, text_col: str = "text", ratio: float = RATIO, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` plus ``__spans``: array of (start, rank, end, kind,
    value) in code points, end exclusive, ordered by start and kind. Base spans
    come first in kind order; a learned span overlaps none of them. Null and
    empty texts have no spans; rows are independent, an empty table gives an
    empty result; without samples the models are alike and add nothing."""
    model = _literal(train(docs, text_col, sample))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def summed_ratio(value):
        return F.aggregate(_pairs(value), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.try_element_at(model, (p + 1).cast("int")), F.lit(0.0)))

    def limit(value):
        return F.greatest(F.lit(LEAST), ratio * (F.length(value) - 1))

    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    plain = docs.withColumn("__base", _base(text)).withColumn("__odd", F.filter(tokens, lambda t: summed_ratio(t) > limit(t)))
    plain = plain.withColumn("__tokens", _matches(text, TOKEN, 0, F.col("__odd")))
    free = F.filter("__tokens", lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    learned = F.transform(free, lambda t: F.struct(t["start"], F.lit(_KIND_ORDER[LEARNED]).alias("rank"), t["end"], F.lit(LEARNED).alias("kind"), t["value"]))
    return plain.withColumn("__spans", F.array_sort(F.concat("__base", learned))).drop("__base", "__odd", "__tokens")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` (same columns) with every secret's characters replaced by ``mark``
    (overlapping spans by one). Texts without spans stay as they are, null too."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])     # columns go by place, whatever their names
    own = f"c{docs.columns.index(text_col)}"
    found = secret_spans(plain, own)
    text = F.col(own)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit(mark)).alias("out")))

    done = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(own, F.when(F.size("__spans") > 0, done).otherwise(text)).select(*plain.columns).toDF(*docs.columns)
