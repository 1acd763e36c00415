"""N-gram Jaccard join by vertical partitioning.

Every text becomes the set of its distinct word n-grams, as 64-bit hashes. The
hash order is the global n-gram order; it is cut into fragments, the same cuts
for all sets of a size class. Two sets whose Jaccard similarity reaches the
threshold differ in at most D n-grams, so with more than D fragments they agree
entirely on one of them: sets that share a fragment's content are candidates.
Candidates are then counted fragment by fragment, each partial overlap on its
own, and the parts summed per pair.

What keeps the work in proportion to the input:

* Texts with the same set are one class; only classes meet.
* Inside a chunk of a task a fragment key sends one posting on to its bucket,
  the others are members at once, so a bucket meets at most one posting per
  chunk in one place, whatever the size of a group of copies.
* Sets that can be linked to no other set (fewer than 6 n-grams) meet no bucket.
* A linked pair agrees on at least (filled fragments - D) keys, so a class in
  fewer shared buckets than that has no link there and leaves.
* First every member is compared with two hubs of its bucket only (as many pairs
  as members, twice). Links found join classes into components; what is left are
  pairs across components in one bucket. These are compared exhaustively, behind
  an exact length filter and an exact bitmap filter (two sets' parity bitmaps
  differ in no more bits than the sets have n-grams apart), so no link between
  different texts is lost and a component of near copies is never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import give_back, written
from .words import SPACES, byte_class, mix, ngrams_of_texts, pieces, scan, utf8

N_WORDS = 4
THRESHOLD = 85          # percent: linked when 100 * shared >= THRESHOLD * union
CLASS_STEP = 1.5        # ratio of neighbouring size classes
SPARE = 0.15            # share of fragments beyond D + 1: keys that linked sets must share
CHUNK = 1_000_000       # postings a task holds before it sends them on
FIRST_KEYS = 6          # of a node, carried along to skip pairs already met
OVERLAP_PARTS = 4       # fragments of the exact count
BLOOM_BITS = 1 << 26    # filter of nodes whose sets are fetched (8 MB, fixed)

MAPS = 8                # words of a set's parity bitmap
_MAPS = [f"b{k}" for k in range(MAPS)]

_U = np.uint64


def _sets(column, n_words: int):
    """Per piece of rows: (row range, sorted distinct n-gram hashes, first index of each row's)."""
    data, off = utf8(column)
    classes = byte_class(SPACES, True)
    for lo, hi in pieces(off):
        w = scan(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], classes)
        gram, at = ngrams_of_texts(w, n_words)
        row = np.searchsorted(w.first, at, "right") - 1
        short = np.diff(w.first)
        few = np.flatnonzero((short > 0) & (short < n_words))
        if len(few):   # fewer words than n: the whole sequence is the one element
            more = []
            for d in few:
                h = w.hash[w.first[d]:w.first[d + 1]]
                more.append(mix(np.array([int(sum(int(x) * (2 * k + 3) for k, x in enumerate(h)) + len(h)) % (1 << 64)], _U))[0])
            gram, row = np.concatenate([gram, np.array(more, _U)]), np.concatenate([row, few])
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        keep = np.ones(len(gram), bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        gram, row = gram[keep], row[keep]
        yield lo, hi, gram, np.searchsorted(row, np.arange(hi - lo + 1))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Wrapping sum of each row's slice."""
    c = np.zeros(len(x) + 1, _U)
    np.cumsum(x, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def _node(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit name of each row's set (as a signed long)."""
    return mix(_sums(mix(gram ^ _U(0x5851F42D4C957F2D)), first) ^ mix(np.diff(first).astype(_U))).view(np.int64)


def describe_sets(texts: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """(id, text_key, node, n, b0, b1, ...): the set's name, size and 512-bit parity bitmap."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, gram, first in _sets(b.column(2), n_words):
                n = np.diff(first)
                node = _node(gram, first)
                row = np.repeat(np.arange(hi - lo), n)
                maps = np.zeros((hi - lo) * MAPS, _U)
                np.bitwise_xor.at(maps, row * MAPS + (gram >> _U(6) & _U(MAPS - 1)).astype(np.int64), _U(1) << (gram & _U(63)))
                maps = maps.view(np.int64).reshape(hi - lo, MAPS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(node, mask=n == 0), pa.array(n.astype(np.int64))]
                    + [pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAPS)],
                    names=["id", "text_key", "node", "n", *_MAPS])

    cols = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")]
    return texts.select(*cols).mapInArrow(run, f"id {kind}, text_key long, node long, n long, " + ", ".join(f"{m} long" for m in _MAPS))


def most_apart(a: int, b: int, threshold: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - threshold) // (100 + threshold)


def size_classes(largest: int, threshold: int) -> np.ndarray:
    """Upper sizes of the classes, from the smallest set that can be linked to another."""
    top, out = 2 * threshold // (100 - threshold), []
    while True:
        out.append(top)
        if top >= largest * 100 / threshold + 1:
            return np.array(out, np.int64)
        top = int(top * CLASS_STEP) + 1


def _postings(gram: np.ndarray, first: np.ndarray, node: np.ndarray, threshold: int):
    """(bucket key, node, keys that a linked set shares) of every fragment of every
    set, for its own size class and, where a partner may be of the next class,
    that one too. A key's low 6 bits are the class. Sets too small to be linked
    to another set post nothing. A set with so few filled fragments that a partner
    of the same kind may agree on empty ones alone also posts its first n-grams in
    the global order, as many as make linked sets share one."""
    n = np.diff(first)
    n = np.where(n * 100 >= threshold * (n + 1), n, 0)
    if not len(n) or n.max() == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    tops = size_classes(int(n.max()), threshold)
    own = np.searchsorted(tops, n)
    keys, nodes, needs = [], [], []
    low = _U(63)
    strong = mix(gram ^ _U(0x2545F4914F6CDD1D))
    total = np.zeros(len(gram) + 1, _U)
    np.cumsum(strong, out=total[1:])
    for step in (0, 1):
        rows = np.flatnonzero((n > 0) & (own + step < len(tops)) & ((n * 100 // threshold > tops[own]) | (step == 0)))
        if not len(rows):
            continue
        tag = own[rows] + step
        apart = 2 * tops[tag] * (100 - threshold) // (100 + threshold)
        cuts = apart + 1 + np.ceil(apart * SPARE).astype(np.int64)
        size = n[rows]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[rows], size)
        owner = np.repeat(np.arange(len(rows)), size)
        part = ((gram[at] >> _U(32)) * cuts[owner].astype(_U)) >> _U(32)
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(at))
        o = owner[s]
        content = total[at[e - 1] + 1] - total[at[s]]
        label = tag.astype(_U) & low
        key = mix(content ^ mix((part[s] << _U(16)) ^ tag[o].astype(_U) ^ ((e - s).astype(_U) << _U(48))))
        filled = np.bincount(o, minlength=len(rows))
        need = np.maximum(filled - apart, 1).astype(np.int32)
        keys.append((key & ~low) | label[o]), nodes.append(node[rows][o]), needs.append(need[o])
        few = np.flatnonzero(filled <= apart)
        take = size[few] - -(-threshold * size[few] // 100) + 1
        to = np.cumsum(take) - take
        head = np.arange(take.sum()) - np.repeat(to, take) + np.repeat(first[rows[few]], take)
        keys.append((mix(mix(gram[head] + _U(0x1234567)) ^ np.repeat(tag[few], take).astype(_U)) & ~low) | np.repeat(label[few], take))
        nodes.append(np.repeat(node[rows[few]], take)), needs.append(np.ones(len(head), np.int32))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(needs)


_POSTING = "key long, node long, need int"


def _shared(key: np.ndarray, node: np.ndarray):
    """Among distinct (key, node): places of each key's first node, and of all
    nodes of keys with several; both in the given order."""
    order = np.lexsort((node, key))
    k, x = key[order], node[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    order, k = order[keep], k[keep]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    return np.sort(order[new]), np.sort(order[np.repeat(count, count) > 1])


def _batch(key, node, need) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(need)], names=["key", "node", "need"])


def bucket_members(texts: DataFrame, text_col: str, n_words: int, threshold: int) -> DataFrame:
    """(key, node, need) for the members of every bucket of two or more classes;
    a member may come more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        count, seen = 0, set()

        def out():
            key, node, need = (np.concatenate(x) for x in zip(*held))
            first, shared = _shared(key, node)      # in document order, which packs well
            yield _batch(key[first], node[first], need[first])
            yield _batch(key[shared], node[shared], -need[shared])      # members already: they need not meet

        for b in batches:
            for lo, hi, gram, first in _sets(b.column(0), n_words):
                node = _node(gram, first)
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                n = np.diff(first)
                take = np.repeat(fresh, n)
                held.append(_postings(gram[take], np.concatenate([[0], np.cumsum(n[fresh])]), node[fresh], threshold))
                count += len(held[-1][0])
                if count >= CHUNK:
                    yield from out()
                    held, count, seen = [], 0, set()
        if count:
            yield from out()
        held, seen = [], set()
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]    # the last key may go on

        def found(key, node, need):
            if len(key):
                at = _shared(key, node)[1]
                if len(at):
                    yield _batch(key[at], node[at], need[at])

        for b in batches:
            rows = [np.asarray(c) for c in b.columns]
            tied = rows[2] < 0
            if tied.any():
                yield _batch(rows[0][tied], rows[1][tied], -rows[2][tied])
            rows = [np.concatenate([x, y[~tied]]) for x, y in zip(rest, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut == 0 and len(rows[0]) > CHUNK:   # one key over many batches: a member stays to meet what comes
                yield from found(*rows)
                rest = [x[:1] for x in rows]
                continue
            rest = [x[cut:] for x in rows]
            yield from found(*[x[:cut] for x in rows])
        yield from found(*rest)
        give_back()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.select(F.col(text_col).alias("text")).mapInArrow(send, _POSTING)
    # members go anywhere; postings that have to meet come in key order
    place = F.when(F.col("need") > 0, F.col("key")).otherwise(F.xxhash64("key", "node"))
    return (sent.repartition(parts, place).sortWithinPartitions(F.col("need") > 0, "key").mapInArrow(meet, _POSTING))


def _bloom(nodes: DataFrame) -> bytes:
    """Bit filter of a node column: fixed size, whatever the number of nodes."""
    def run(batches):
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for b in batches:
            h = mix(np.asarray(b.column(0)).view(_U))
            for k in (h, h >> _U(32)):
                at = (k & _U(BLOOM_BITS - 1)).astype(np.int64)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])
    # a few words of the filter a row; merged by bitwise or, then sent as one bounded array
    got = nodes.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    words = np.zeros(BLOOM_BITS // 64, np.int64)
    table = got.toArrow()
    words[np.asarray(table["at"])] = np.asarray(table["word"])
    return words.tobytes()


def _fragments(texts: DataFrame, text_col: str, n_words: int, wanted: DataFrame) -> DataFrame:
    """(node, part, grams): the sets of the wanted nodes, cut into fragments."""
    bits = texts.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches):
        have = np.frombuffer(bits.value, np.uint8)
        seen: set[int] = set()
        for b in batches:
            for lo, hi, gram, first in _sets(b.column(0), n_words):
                node = _node(gram, first)
                h = mix(node.view(_U))
                ok = np.diff(first) > 0
                for k in (h, h >> _U(32)):
                    at = (k & _U(BLOOM_BITS - 1)).astype(np.int64)
                    ok &= (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                rows = [r for r in np.flatnonzero(ok).tolist() if not (node[r].item() in seen or seen.add(node[r].item()))]
                if len(seen) > CHUNK:
                    seen = set()
                if not rows:
                    continue
                ns, ps, values, sizes = [], [], [], []
                for r in rows:
                    g = gram[first[r]:first[r + 1]]
                    cut = np.searchsorted(g >> _U(62), np.arange(OVERLAP_PARTS + 1, dtype=_U))
                    for p in range(OVERLAP_PARTS):
                        if cut[p + 1] > cut[p]:
                            ns.append(node[r]), ps.append(p), sizes.append(cut[p + 1] - cut[p])
                            values.append(g[cut[p]:cut[p + 1]])
                flat = np.concatenate(values).view(np.int64)
                offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ns, np.int64)), pa.array(np.array(ps, np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    names=["node", "part", "grams"])
        give_back()

    got = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, part long, grams array<long>")
    return got


def _verified(pairs: DataFrame, texts: DataFrame, text_col: str, n_words: int, threshold: int, what: str) -> DataFrame:
    """Of (a, b, na, nb): the linked ones, by summed partial overlaps."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_fragments(texts, text_col, n_words, nodes), f"{what}-sets").dropDuplicates(["node", "part"])
    left = sets.select(F.col("node").alias("a"), "part", F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("part").alias("part_b"), F.col("grams").alias("gb"))
    # b (the member) is fetched first, so a hub's set is never copied along a shuffle
    both = pairs.join(right, "b").withColumnRenamed("part_b", "part").join(left, ["a", "part"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("shared"))
    return (partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
            .filter(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * threshold)
            .select("a", "b"))


def _possible(threshold: int):
    """Length and bitmap filters: both never reject a linked pair."""
    apart = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(MAPS)), F.lit(0))
    return ((F.col("x.n") * 100 >= F.col("y.n") * threshold) & (F.col("y.n") * 100 >= F.col("x.n") * threshold)
            & (apart * (100 + threshold) <= (F.col("x.n") + F.col("y.n")) * (100 - threshold)))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
                       threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, group, text_key), one row for each row of ``docs``.

    ``n_shingles`` is the size of the row's set of distinct word n-grams (words:
    runs of non-space, A-Z lower-cased; fewer than n words: the whole sequence is
    the one element), ``component_id`` the smallest id reachable over links
    (100 * shared >= threshold * union), ``group`` the component's name, ``text_key`` the
    text's hash (tells rows with one id apart).
    Null, empty or word-less text: size 0, linked with nothing, its own id.
    Repeated rows and ids each keep their row; a null id stays null in the row
    and is passed over as smallest id (a component of null ids only: null).
    Columns other than the two named are not looked at; an empty table gives an
    empty result. 64-bit hashes stand for n-grams and sets."""
    docs = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    rows = written(describe_sets(docs, id_col, text_col, n_words), "sets")
    facts = rows.filter("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *_MAPS)])
    found = written(bucket_members(docs, text_col, n_words, threshold), "buckets")
    tag = F.col("key").bitwiseAND(F.lit(63)).alias("tag")
    able = found.groupBy("node", tag).agg(F.count("*").alias("m"), F.max("need").alias("need")).filter("m >= need").select("node", "tag")
    members = written(found.select("key", "node", tag).join(able, ["node", "tag"], "left_semi").select("key", "node").distinct(), "members")
    in_buckets = written(members.select("node").distinct().join(facts, "node"), "facts")

    # 1. every member with its bucket's first and last
    ends = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    tied = (members.join(ends, "key").select(F.explode(F.array("lo", "hi")).alias("a"), F.col("node").alias("b"), "lo", "hi")
            .filter("a <> b and not (a = hi and b = lo)").select("a", "b").distinct())
    x, y = in_buckets.alias("x"), in_buckets.alias("y")
    pairs = (tied.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(_possible(threshold))
             .select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb")))
    pairs = written(pairs, "hub-pairs")
    links = written(_verified(pairs, docs, text_col, n_words, threshold, "hub"), "hub-links")
    named = connected_components(links)

    # 2. what a bucket still holds of different components
    placed = (members.select("key", "node").join(named, "node", "left")
              .withColumn("c", F.coalesce("component", "node")).drop("component"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    placed = written(placed.join(mixed, "key").distinct(), "mixed")
    # a node's first keys tell most pairs that they have met in an earlier bucket
    heads = (placed.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("heads"))   # of one text's fragments
             .join(in_buckets, "node"))
    most = placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    placed = written(placed.join(heads, "node").join(most, "key").withColumn("in_main", F.col("c") == F.col("main")).drop("main"), "placed")
    # a pair across components has a member outside the bucket's largest one
    x, y = placed.filter("not in_main").alias("x"), placed.alias("y")
    met = F.array_min(F.array_intersect("x.heads", "y.heads")) < F.col("x.key")
    across = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & (F.col("y.in_main") | (F.col("x.node") < F.col("y.node")))
                     & _possible(threshold) & ~F.coalesce(met, F.lit(False)))
              .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
                      F.when(F.col("x.node") < F.col("y.node"), F.col("x.n")).otherwise(F.col("y.n")).alias("na"),
                      F.when(F.col("x.node") < F.col("y.node"), F.col("y.n")).otherwise(F.col("x.n")).alias("nb"))
              .distinct())
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = written(across.join(known, ["a", "b"], "left_anti"), "cross-pairs")
    if not across.isEmpty():
        more = written(_verified(across, docs, text_col, n_words, threshold, "cross"), "cross-links")
        if not more.isEmpty():
            named = connected_components(links.unionAll(more))

    grouped = rows.join(named, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component", *_MAPS)
    smallest = grouped.filter("node is not null").groupBy("group").agg(F.min("id").alias("smallest"))
    return (grouped.join(smallest, "group", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"),
                    F.col("group"), F.col("text_key")))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies, all columns kept: of every linked group the
    row with the smallest id stays (null ids last; of repeated ids the smallest
    text hash, of wholly repeated rows one). Rows without words all stay."""
    found = written(ngram_jaccard_join(docs, id_col, text_col).select(F.col(id_col).alias("id"), "group", "text_key")
                    .filter("group is not null"), "found")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key"))
    best = found.groupBy("group").agg(first.alias("best"), F.count("*").alias("rows")).filter("rows > 1")
    rows = found.join(best, "group")
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))
    # per distinct (id, text): 0 = goes, 1 = stays, 2 = stays once of several equal rows
    fate = (rows.groupBy("id", "text_key").agg(F.max(same).alias("stays"), F.count("*").alias("n"))
            .select("id", "text_key", F.when(~F.col("stays"), 0).when(F.col("n") == 1, 1).otherwise(2).alias("fate"))
            .filter("fate <> 1"))
    # columns go by place, whatever their names
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    judged = plain.join(fate, own_id.eqNullSafe(F.col("id")) & (F.xxhash64(own_text) == F.col("text_key")), "left")
    judged = written(judged.filter("fate is null or fate = 2"), "judged")
    once = judged.filter("fate = 2").dropDuplicates(["id", "text_key"])
    return judged.filter("fate is null").unionAll(once).select(*plain.columns).toDF(*docs.columns)
