"""Token-id output: best-fit-decreasing packing into fixed-length rows.

Texts become ids, each closed by an end id. Documents longer than a row are
split losslessly into full rows and a remainder. Remainders are packed by best
fit, longest first: a segment tree over capacities finds the fullest open row
that still holds a piece. Every task packs what it reads, ``BUFFER_TOKENS`` at a
time, so there is no shuffle, memory is bounded and a lost executor repeats its
own tasks only; with thousands of documents in a buffer, rows are all but full.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_words import WordEncoder
from .words import utf8

ROW_LENGTH = 2048
BUFFER_TOKENS = 4_000_000
END_ID = 50256          # the free id after a 50,256-token vocabulary

_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(rank_file: str, pattern: str) -> WordEncoder:
    """Byte-level BPE of a rank file, once per worker. Its pattern starts a new
    stretch wherever white space follows a character that is none, so texts can
    be cut there (only after ASCII, as some wider characters are white space)."""
    if rank_file not in _ENCODERS:
        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        model = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]

        def alone(p: bytes) -> bool:
            # would join with a neighbour: a text's start, and white space at its end
            return not p[:1].isspace() or p[-1:].isspace() or p[-1] > 127 and p.decode()[-1].isspace()

        def encode(parts: list[bytes]):
            # elsewhere cut points are token ends, so one call serves all parts
            own = np.array([alone(p) for p in parts], bool)
            count, ids = np.zeros(len(parts), np.int64), [np.zeros(0, np.int64)] * len(parts)
            for k in np.flatnonzero(own).tolist():
                ids[k] = np.array(model.encode_ordinary(parts[k].decode()), np.int64)
            many = np.flatnonzero(~own).tolist()
            flat = np.array(model.encode_ordinary(b"".join([parts[k] for k in many]).decode()), np.int64)
            upto = np.searchsorted(np.cumsum(size[flat]), np.cumsum([len(parts[k]) for k in many], dtype=np.int64), "right")
            for k, x, y in zip(many, [0, *upto.tolist()], upto.tolist()):
                ids[k] = flat[x:y]
            count[:] = [len(x) for x in ids]
            return np.concatenate(ids), count

        space = np.zeros(256, bool)
        space[[0x20, *range(9, 14)]] = True
        plain = ~space
        plain[128:] = False
        _ENCODERS[rank_file] = WordEncoder(encode, space, plain)
    return _ENCODERS[rank_file]


class CapacityTree:
    """Segment tree over capacities 0..n: how many open rows have each, and the
    smallest capacity that is at least as large as asked."""

    def __init__(self, n: int):
        self.leaves = 1 << (n + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def at_least(self, capacity: int) -> int:
        """Smallest capacity >= the asked one with an open row, or -1."""
        k = capacity + self.leaves
        if self.count[k]:
            return capacity
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows (lists of positions in ``sizes``), each of at most ``length`` in all."""
    tree, rows = CapacityTree(length), []
    open_by: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.at_least(sizes[i])
        if room < 0:
            rows.append([])
            row, room = len(rows) - 1, length
        else:
            row = open_by[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - sizes[i]
        if left:
            tree.add(left, 1)
            open_by.setdefault(left, []).append(row)
    return rows


def pack_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = ROW_LENGTH, end_id: int = END_ID, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per packed sequence: ``pack_id``, ``ids`` (``length`` little-endian
    unsigned ids, 16 bits each if the end id fits, else 32; padded with the end
    id), ``n_tokens``, ``cu_seqlens`` (cumulative segment lengths from 0),
    ``position_resets`` (where in the row positions start anew at 0),
    ``doc_ids``, ``chunk_ix`` and ``chunk_start`` (per segment: the document, the
    number of its chunk, and that chunk's first token in the document).

    Every text's ids and its end id appear exactly once. Null and empty texts
    are a lone end id; repeated rows are packed each; a null id stays null in
    ``doc_ids``; other columns are not looked at; an empty table gives no rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def run(batches):
        held: list[tuple] = []      # (document, chunk, first token, ids)
        total = 0

        def emit(rows):
            flat = np.full(len(rows) * length, end_id, dtype)
            cu, resets, ids, chunks, starts, n = [], [], [], [], [], []
            for k, row in enumerate(rows):
                at, edge = k * length, [0]
                for _, _, _, tokens in row:
                    flat[at + edge[-1]:at + edge[-1] + len(tokens)] = tokens
                    edge.append(edge[-1] + len(tokens))
                n.append(edge[-1]), cu.append(edge), resets.append(edge[:-1])
                ids.append([x[0] for x in row]), chunks.append([x[1] for x in row]), starts.append([x[2] for x in row])
            raw, step = flat.tobytes(), length * dtype.itemsize
            return pa.RecordBatch.from_arrays(
                [pa.array([raw[k * step:(k + 1) * step] for k in range(len(rows))], pa.binary()), pa.array(n, pa.int64()),
                 pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(ids, pa.list_(id_type)),
                 pa.array(chunks, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64()))],
                names=["ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "chunk_ix", "chunk_start"])

        def flush():
            rows = best_fit_decreasing([len(x[3]) for x in held], length)
            for k in range(0, len(rows), 512):
                yield emit([[held[i] for i in row] for row in rows[k:k + 512]])

        for b in batches:
            id_type = b.column(0).type
            data, off = utf8(b.column(1))
            for lo, hi, ids, first in _encoder(rank_file, pattern).column(data, off):
                full = []
                for k, doc in enumerate(b.column(0).slice(lo, hi - lo).to_pylist()):
                    tokens = np.append(ids[first[k]:first[k + 1]], end_id).astype(dtype)
                    for c, s in enumerate(range(0, len(tokens), length)):
                        part = (doc, c, s, tokens[s:s + length])
                        if len(part[3]) == length:
                            full.append([part])
                            if len(full) == 512:
                                yield emit(full)
                                full = []
                        else:
                            held.append(part)
                            total += len(part[3])
                if full:
                    yield emit(full)
                if total >= buffer_tokens:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    schema = f"ids binary, n_tokens long, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, chunk_ix array<int>, chunk_start array<long>"
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return packed.select(F.monotonically_increasing_id().alias("pack_id"), "*")


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrices as Parquet: a fixed-width binary row per sequence."""
    packed.write.option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, chunk_ix, chunk_start, tokens) of every packed segment: the inverse, for checks and readers."""
    width = "<u2" if end_id < 1 << 16 else "<u4"
    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], width)
                for k, doc in enumerate(r["doc_ids"]):
                    out.append((doc, r["chunk_ix"][k], r["chunk_start"][k], ids[r["cu_seqlens"][k]:r["cu_seqlens"][k + 1]].tolist()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_ids").type.value_type), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int32()))],
                                             names=["doc_id", "chunk_ix", "chunk_start", "tokens"])

    return packed.drop("pack_id").mapInArrow(run, f"doc_id {kind}, chunk_ix int, chunk_start long, tokens array<int>")
