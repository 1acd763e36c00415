"""N-gram Jaccard join, page operators and the pipeline against brute force."""

import collections
import random
import re

from xcheck.llm import html_blocks, url_rules
from xcheck.llm.components import connected_components
from xcheck.llm.ngram_jaccard import bucket_members, keep_one_per_group, ngram_jaccard_join

SCHEMA = "doc_id long, text string, component_id string, node long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:], w[3:])) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    return [(d, len(s), (min(low[root(i)]) if low[root(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_rows(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (6, "one two three four")]
    passage = [word() for _ in range(40)]
    for size in (8, 12, 30, 90, 300, 900):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for k in range(5):
                t = list(base)
                for _ in range(r.randint(0, max(1, size // 30))):
                    t[r.randrange(size)] = word()
                rows.append((len(rows) + 10, " ".join(t)))
            rows.append((len(rows) + 10, " ".join(base[:size // 2] + passage)))
    rows += [(len(rows) + 10 + k, rows[20 + k][1]) for k in range(10)]
    rows.append((None, rows[30][1]))
    r.shuffle(rows)
    return rows


def test_ngram_jaccard_join(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], SCHEMA).repartition(5)
    got = ngram_jaccard_join(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute(rows))
    assert ngram_jaccard_join(df.limit(0)).count() == 0


def test_short_texts_meet_no_bucket(spark):
    """Texts of few words share no key unless they share n-grams."""
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(r.randint(1, 14)))) for i in range(2500)]
    rows += [(5000 + i, rows[i][1]) for i in range(50)]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], SCHEMA).repartition(4)
    found = bucket_members(df, "text", 4, 85)
    assert found.groupBy("key").count().agg({"count": "max"}).first()[0] in (None, 2)
    got = ngram_jaccard_join(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(
        (i, max(1, len(t.split()) - 3), i - 5000 if i >= 5000 else i) for i, t in rows)


def test_few_filled_fragments(spark):
    """Links among sets of 6 to 20 n-grams, many of which fill few fragments."""
    r = random.Random(4)
    rows = []
    for k in range(400):
        words = [f"w{r.randrange(10 ** 9)}" for _ in range(r.randint(9, 22))]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, f"x{k}"])), (10 * k + 2, " ".join(words[1:]))]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], SCHEMA).repartition(3)
    got = ngram_jaccard_join(df).collect()
    assert collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == collections.Counter(brute(rows))


def test_keep_one_per_group(spark):
    rows = near_rows(5)
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], SCHEMA).repartition(3)
    kept = keep_one_per_group(df)
    assert kept.columns == df.columns
    have = collections.Counter(r.doc_id for r in kept.collect())
    want = collections.Counter()
    seen = set()
    for (d, _), (_, n, c) in zip(rows, brute(rows)):
        if n == 0:
            want[d] += 1
        elif c is not None and c not in seen:
            seen.add(c)
            want[c] += 1
    assert have == want


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        ga, gb = group.get(a, {a}), group.get(b, {b})
        both = ga | gb
        for x in both:
            group[x] = both
    assert got == {x: min(g) for x, g in group.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text<br>after</p><p title="a > b">Caf&eacute; &#8217;26<!-- no --></p>
<p>Unclosed<p>Next %s<aside>Side</aside><form>Sign up</form><div class="comments"><p>Reader says</p></div></article>
<div class="sidebar">More</div><footer>&copy; Site &middot; end</footer></body></html>"""


def page_rows():
    r = random.Random(2)
    return [(i, f"http://a.org/{i}", PAGE % " ".join(r.choice(["red", "blue", "sky", "sea"]) for _ in range(r.randint(1, 30)))) for i in range(80)]


def test_html_blocks(spark):
    rows = page_rows()
    odd = [(900, None, None), (901, "u", ""), (902, "u", "<p>no article"), (903, "u", "a < b & c"), (0, *rows[0][1:]), (None, None, rows[1][2])]
    schema = "page_id long, url string, html string, text_x string"
    df = spark.createDataFrame([(*x, "e") for x in rows + odd], schema)
    got = {r.page_id: r.text for r in html_blocks.extract_main_text(df).collect()}
    for i, _, page in rows:
        tail = re.search(r"Next (.*?)<aside>", page).group(1)
        assert got[i] == f"Head & line\n\nFirst bold text after\n\nCafé ’26\n\nUnclosed\n\nNext {tail}".rstrip()
    assert got[900] == "" and got[901] == "" and got[None] == got[1]
    assert html_blocks.extract_main_text(df.limit(0)).count() == 0


def test_html_gradient():
    """The network's gradients agree with differences."""
    import numpy as np
    g = np.random.default_rng(0)
    net = html_blocks.Labeller(1)
    x, mask = g.normal(size=(2, 4, html_blocks.INPUT)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = np.array([[1, 0, 0, 1], [0, 1, 0, 0.0]])

    def loss():
        z, _ = net.logits(x, mask)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    grad = net.gradients(x, mask, y)
    for name in ("Wf", "Ub", "bf", "V", "S"):
        flat = net.p[name].reshape(-1)
        for k in (0, len(flat) // 2, len(flat) - 1):
            keep = flat[k]
            flat[k] = keep + 1e-5
            up = loss()
            flat[k] = keep - 1e-5
            down = loss()
            flat[k] = keep
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[k]) < 1e-6


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x=1", "http://example.net/fr/2", "https://x.net", "ftp://q.org/fr/3#t",
            "http://myexample.com/de/4", "http://s.example.com/de/5", "http://bad.example.com/zz/6?spam=1", "http://ok.example.com/zz/7"]
    pages = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash"), (None, urls[4], None)]
    pages += [(1000 + i, f"http://bad.example.com/zz/{i}?spam=1", None) for i in range(100, 160)]
    pages += [(2000 + i, f"http://ok.example.com/zz/{i}", None) for i in range(200, 260)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, int(i >= 200), None) for i in [*range(100, 160), *range(200, 260)]] + [(None, 0, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    rows = url_rules.url_verdicts(df, labels).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id is not None and r.page_id < 1000}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[4] == ("example.net", "/fr/2", "net/", "block")
    assert got[5] == ("x.net", "", None, "allow")
    assert got[6] == ("q.org", "/fr/3", "org/fr/", "allow")
    assert got[7] == ("myexample.com", "/de/4", None, "allow")
    assert got[8][2:] == ("example.com/de/", "block")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    assert url_rules.url_verdicts(df.limit(0), labels).count() == 0
    assert {r.verdict for r in url_rules.url_verdicts(df, labels.limit(0)).filter("rule is null").collect()} == {"allow"}


def test_pipeline(spark):
    import corpus_pipeline as C
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, had = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "xx", None, 0)], docs.schema))
        stage(spark, odd, folder).count()
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = out
    # brute force of the stages' decisions
    with_words = [(i, t) for i, t in had.items() if t and re.search(r"[^\W\d_]", t)]
    keep = {c for d, n, c in brute(sorted(with_words)) if n}
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = pat.findall(lower(r.text))
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    dirty = set()
    for i in keep:
        w = pat.findall(lower(had[i]))
        if any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9)):
            dirty.add(i)
    got = {r.doc_id: r for r in C.run(spark, folder).collect()}
    assert set(got) == keep - dirty
    secret = re.compile(r"[0-9a-f]{24,}")
    for i, r in got.items():
        assert len(r.ids) == r.n_tokens
        if "[secret]" not in r.decoded:
            assert r.decoded == had[i]
        assert not secret.search(r.decoded)
