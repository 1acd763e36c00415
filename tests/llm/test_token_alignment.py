"""Cross-tokenizer alignment against a plain version with both libraries."""

import collections
import hashlib
import random

import numpy as np
import pytest

from xcheck.llm.token_alignment import align_tokens, shared_groups, token_groups

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, row long, c0 string"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "   ", "word", " leading", "trailing  ", "a  b\n\n c\t d", "x" * 3000, "mark ▁ in text", "<|endoftext|> <s> </s> <0x41>",
           "naïve Ünï cödé 😀👩‍👩‍👧 漢字テスト text", " nbsp　wide ", "null\x00byte\x1f end", "don't we'll I'm 12345 $%&", "word", "ﬁ ligature é"]
    alphabet = "abcdeéßñ 漢😀\n\t.,'1▁ "
    odd += ["".join(rng.choice(alphabet if k % 2 else alphabet.replace("▁", "")) for _ in range(rng.randrange(1, 80))) for k in range(120)]
    return odd + [" ".join(rng.choice(["tion", "the", "internationalization", "über", "x1"]) for _ in range(4000))]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(all_texts):
    a_model, b_model = libraries()
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in shown)}
    docs, counts = [], collections.Counter()
    for t in all_texts:
        if not t:
            docs.append(None)
            continue
        a = a_model.encode(" " + t, add_special_tokens=False).ids
        b = b_model.encode(t)
        raw_a = [bytes(shown[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        whole = (" " + t).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(None)
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x, y) for x, (lo, hi) in enumerate(spans[0]) for y, (lo2, hi2) in enumerate(spans[1]) if lo < hi2 and lo2 < hi] if len(a) < 500 else \
            sorted({(np.searchsorted([e for _, e in spans[0]], p, "right"), np.searchsorted([e for _, e in spans[1]], p, "right")) for p in range(len(whole))})
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, x, y = [], 0, 0
        for c in cuts:
            x2 = next(k for k in range(x, len(a)) if spans[0][k][1] == c) + 1
            y2 = next(k for k in range(y, len(b)) if spans[1][k][1] == c) + 1
            groups.append(",".join(map(str, a[x:x2])) + "|" + ",".join(map(str, b[y:y2])))
            x, y = x2, y2
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        docs.append((len(a), len(b), groups, pairs))
    most = collections.defaultdict(int)
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = d
            out.append((n_a, n_b, len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2e-6, 0.01])
def test_equals_brute_force(spark, hot):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in enumerate(rows)], SCHEMA).repartition(5)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in align_tokens(docs, A, B, hot=hot).collect()}
    for i, want in enumerate(brute(rows)):
        assert got[i] == want, (i, rows[i])


def test_groups_as_text(spark):
    rows = texts()[:40]
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r.groups for r in token_groups(docs, A, B).collect()}
    for i, want in enumerate(brute(rows)):
        assert (hashlib.sha256(got[i].encode()).hexdigest() if got[i] else "") == want[-1]


def test_ids_null_repeated_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "same text", "", 1, ""), (1, "same text", "", 1, ""), (1, "same text", "", 1, "")], SCHEMA)
    got = align_tokens(docs, A, B).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1 and got[0].count_sum == 3 * got[0].n_links
    assert align_tokens(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_divide_and_conquer_equals_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        parts, ends, firsts, at = rng.integers(1, 6), [[], []], [[0], [0]], 0
        for _ in range(parts):
            size = int(rng.integers(1, 60))
            for k in (0, 1):
                inner = rng.choice(np.arange(1, size), rng.integers(0, size), replace=False) if size > 1 else []
                ends[k] += sorted(at + x for x in {*[int(v) for v in inner], size})
                firsts[k].append(len(ends[k]))
            at += size
        a, b = (np.array(x) for x in ends)
        got = shared_groups(a, b, *(np.array(x) for x in firsts))
        cuts = np.intersect1d(a, b)
        starts = np.concatenate([[0], np.searchsorted(a, cuts) + 1])[:-1], np.concatenate([[0], np.searchsorted(b, cuts) + 1])[:-1]
        assert got[0].tolist() == starts[0].tolist() and got[1].tolist() == starts[1].tolist()


def test_a_worker_holds_little(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from xcheck.llm import tables
    from xcheck.llm import token_alignment as T
    rng = random.Random(5)
    column = pa.array([" ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(400)) for _ in range(300)] + [None, ""])
    size = max(len(t or "") for t in column.to_pylist())
    aligner, seen = T._aligner(A, B), []
    aligner.clear()
    got = list(aligner.column(column))
    whole = [[aligner.said_of(word[x:y]) for x, y in zip(first, first[1:])] for _, _, word, first in got]
    looked_up = aligner.stretches
    monkeypatch.setattr(aligner, "stretches", lambda data, offsets: (seen.append(len(data)), looked_up(data, offsets))[1])
    monkeypatch.setattr(T, "STEP", 4 * size)
    aligner.clear()
    small = [[aligner.said_of(word[x:y]) for x, y in zip(first, first[1:])] for _, _, word, first in aligner.column(column)]
    assert small == whole and len(seen) > 10 and max(seen) <= 4 * size + 302
    assert sum(x.nbytes for x in (aligner.hash, aligner.number, aligner.sizes, aligner.first, aligner.text_first)) < 50 * len(aligner.hash)
    monkeypatch.setitem(tables._OWN, "dir", str(tmp_path))
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    rows = spark.range(12, numPartitions=1).selectExpr("id", "array_join(transform(sequence(1, 200000), x -> sha2(concat(id, x), 256)), '') AS x")
    tables.written(rows, "large", large_rows=True)
    files = list(tmp_path.glob("llm-large-*/*.parquet"))
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) >= 4
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with tables.small_batches(spark, 3):
        sizes = spark.range(10, numPartitions=1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
    assert [r[0] for r in sizes] == [3, 3, 3, 1] and spark.conf.get(name) == before
