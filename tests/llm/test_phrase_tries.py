"""Phrase mining against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from xcheck.llm import phrase_tries as T

SCHEMA = "doc_id long, text string, lang string, source string, a string, s1 long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, min_count, keep):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i:i + k])] += 1
    out = collections.defaultdict(list)
    longer = collections.Counter()
    for (lang, p), a in counts.items():
        if a >= min_count and len(p) > 2:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[lang, p[i:j]] = max(longer[lang, p[i:j]], a)
    for (lang, p), a in counts.items():
        if a < min_count or len(p) < 2 or 100 * longer[lang, p] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(found)[:keep], 1))


def corpus(seed, docs=40):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "big", "é", "漢字", "a\x00b", "x" * 300, " "]
    out = []
    for _ in range(docs):
        t = ""
        for _ in range(rng.randrange(0, 120)):
            t += rng.choice(words if rng.random() < 0.7 else ["new york city"]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  ", " \x0b", "; "])
        out.append((t, rng.choice(["en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", "fr"), (" \n.,", "fr"), ("aa " * 400, "rep"), ("one two three four " * 50, "rep"), ("solo", "es")]


@pytest.mark.parametrize("seed, min_count, keep, shard, at_once", [(1, 3, 2000, 400_000, 3), (2, 5, 7, 40, 2)])
def test_equals_brute_force(spark, seed, min_count, keep, shard, at_once, monkeypatch):
    rows = corpus(seed)
    rows += rows[:5]
    docs = spark.createDataFrame([(i, t, lang, "s", "x", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    monkeypatch.setattr(T.frequencies, "__defaults__", (shard, at_once))
    got = T.mine_phrases(docs, min_count=min_count, keep=keep, shard=shard)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_count, keep)


def test_tasks_that_send_early(spark, monkeypatch):
    rows = corpus(9)
    docs = spark.createDataFrame([(i, t, lang, "s", "x", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).coalesce(1)
    texts = docs.selectExpr("xxhash64(coalesce(lang, 'und')) as key", "text", "coalesce(lang, 'und') as lang")
    whole = sorted(map(tuple, T.count_words(texts).collect()))
    monkeypatch.setattr(T, "HELD", 3)
    assert sorted(map(tuple, T.count_words(texts).collect())) == whole


def test_empty_table(spark):
    assert T.mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_double_array_trie():
    rng = np.random.default_rng(3)
    phrases = {tuple(rng.integers(1, 60, rng.integers(2, 5)).tolist()) for _ in range(3000)}
    phrases |= {(5, k) for k in range(1, 200)}
    table = np.zeros((len(phrases), 4), np.uint64)
    for i, p in enumerate(sorted(phrases)):
        table[i, :len(p)] = p
    trie = T.DoubleArrayTrie(table)
    used = np.flatnonzero(trie.check >= 0)
    assert len(np.unique(trie.state)) == len(phrases) and np.isin(trie.state, used).all()
    text = rng.integers(1, 62, 5000).astype(np.uint64)
    end = np.minimum((np.arange(5000) // 13 + 1) * 13, 5000)
    into = np.zeros(len(trie.check), np.int64)
    trie.count(text, end, into)
    want = collections.Counter(tuple(text[i:i + k].tolist()) for i in range(5000) for k in (2, 3, 4) if i + k <= end[i])
    for i, p in enumerate(sorted(phrases)):
        assert into[trie.state[i]] == want[p]
    again = T.DoubleArrayTrie.unpacked(trie.packed())
    assert (again.check == trie.check).all() and (again.words == trie.words).all()


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    schema = "s1 long, s2 long, s3 long, s4 long, a long"
    phrases = spark.createDataFrame([(1, 3, 0, 0, big - 1)], schema)
    words = spark.createDataFrame([(1, big), (3, big + 1)], "s1 long, n long")
    row = T.scored(phrases, phrases, words).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1)
    longer = spark.createDataFrame([(1, 3, 0, 0, big), (1, 3, 5, 0, big // 5 * 4), (5, 7, 0, 0, big), (5, 7, 9, 0, big // 5 * 4 - 1)], schema)
    assert {(r.s1, r.s2) for r in T.uncovered(longer).filter("s3 = 0").collect()} == {(5, 7)}


def test_texts_are_scanned_once_and_positions_meet_one_trie(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, lang, "s", "x", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    texts = docs.selectExpr("xxhash64(coalesce(lang, 'und')) as key", "text", "coalesce(lang, 'und') as lang")
    words = T.count_words(texts).filter("n >= 3 and word <> ''").selectExpr("name as s1")
    monkeypatch.setattr(T, "STRETCH", 7)
    runs = [np.frombuffer(r.names, np.uint64) for r in T.frequent_runs(texts, words).collect()]
    often = {r.s1 % 2 ** 64 for r in words.collect()}
    assert len(runs) > 20 and all(r[-1] == 0 and r[0] != 0 for r in runs)
    for r in runs:
        lengths = np.diff(np.flatnonzero(r == 0), prepend=-1) - 1
        assert lengths.min() >= 2 and {int(x) for x in r if x} <= often
    # a position is walked in the trie of its first two words only
    phrases = np.array([(a, b, c, 0) for a in (1, 3) for b in (5, 7, 9) for c in (0, 11)], np.uint64)
    shard = T._shard(phrases[:, 0], phrases[:, 1], 4)
    assert (shard[::2] == shard[1::2]).all()
    text, end = np.array([1, 5, 11, 3, 9, 1, 5, 0], np.uint64), np.full(8, 7)
    at = np.arange(6)
    of, found = T._shard(text[at], text[at + 1], 4), {}
    for k in range(4):
        trie = T.DoubleArrayTrie(phrases[shard == k])
        into = np.zeros(len(trie.check), np.int64)
        trie.count(text, end, into, at[of == k])
        found |= {tuple(p.tolist()): int(into[x]) for p, x in zip(phrases[shard == k], trie.state)}
    assert {p: n for p, n in found.items() if n} == {(1, 5, 0, 0): 2, (1, 5, 11, 0): 1, (3, 9, 0, 0): 1}
