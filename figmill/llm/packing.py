"""Best-fit packing planned on a histogram of piece lengths.

Texts become pieces of at most ``size`` tokens. Best-fit decreasing runs over the
counts of each length, not over the pieces: bins with the same contents are one
pattern with a count. A piece takes its planned slot by its rank within its length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.common import saved

SIZE, END_ID = 1024, 2
_encoders: dict[str, object] = {}


def encoder(path: str):
    """Token ids of a text under the tokenizer file at ``path``, without added special tokens.

    A byte-level BPE with a rank file beside it is run from the ranks, which gives the
    same ids many times faster; texts that hold a special token's string go to the file's own tokenizer.
    """
    if path not in _encoders:
        import os

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        whole = Tokenizer.from_file(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        own = lambda text: whole.encode(text, add_special_tokens=False).ids
        ranks_path = path.rsplit(".", 1)[0] + ".tiktoken"
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _encoders[path] = lambda text: own(text) if any(s in text for s in special) else fast(text)
        else:
            _encoders[path] = own
    return _encoders[path]


def cuts(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first piece takes the rest."""
    first = length % size or size
    return [(0, first)] + [(s, size) for s in range(first, length, size)]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` of lengths.

    Returns rows (length, first rank, past rank, first sequence, offset): pieces of that
    length with ranks in the range go to consecutive sequences, at that offset.
    As one bin takes q pieces of a length before the next best bin is looked at, whole groups of bins are filled at once.
    """
    groups: list[list] = []  # [bins, slots as (length, offset)]
    room: list[tuple[int, int]] = []  # sorted (rest, -group): the tightest first, then the newest

    def put(rest: int, bins: int, slots: tuple) -> None:
        groups.append([bins, slots])
        insort(room, (rest, -(len(groups) - 1)))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(room, (length, -len(groups)))
            if i < len(room):
                rest, g = room.pop(i)
                bins, slots = groups[-g]
                groups[-g][0] = 0
            else:
                rest, bins, slots = size, max(1, -(-left // (size // length))), ()
            q = rest // length
            full = min(bins, left // q)
            extra = left - full * q if full < bins else 0
            fill = lambda k, slots=slots, rest=rest: (*slots, *((length, size - rest + j * length) for j in range(k)))
            if full:
                put(rest - q * length, full, fill(q))
            if extra:
                put(rest - extra * length, 1, fill(extra))
            if bins - full - bool(extra) and slots:
                put(rest, bins - full - bool(extra), slots)
            left -= full * q + extra
    ranks, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for bins, slots in groups:
        if bins:
            for length, offset in slots:
                rows.append((length, ranks[length], ranks[length] + bins, sequence, offset))
                ranks[length] += bins
            sequence += bins
    return rows


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place in their partition: the tokens of ``docs(doc_id, text)``, then ``end_id``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        row = part << 33
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "row")} | ({"ids": []} if with_ids else {})
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array(encode(text.as_py() or "") + [end_id], dtype="<u4")
                for n, (start, length) in enumerate(cuts(len(ids), size)):
                    raw = ids[start : start + length].tobytes()
                    one = (doc_id, n, start, length, zlib.crc32(raw), int(seen[length]), row)
                    seen[length] += 1
                    for k, v in zip(out, (*one, raw), strict=False):
                        out[k].append(v)
                row += 1
            n = len(out["doc_id"])
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()] + [pa.array([part] * n, pa.int32())], [*out, "part"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, row long" + ", ids binary" * with_ids + ", part int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all ``docs(doc_id, text)`` into few sequences of at most ``size`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, row
    (the same for all pieces of one row, so copies can be told apart) and, if
    ``with_ids``, ids (little-endian unsigned 32-bit). Null texts are
    empty: one piece with the end id alone. Repeated rows are packed each, null
    doc_ids are kept, an empty table gives no rows; other columns are ignored.
    """
    cut = saved(pieces(docs, tokenizer, size, end_id, with_ids), "pieces")
    per_part = saved(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = sorted(plan(counts, size))
    far = 1 << 40
    lows = np.array([a * far + b for a, b, *_ in table], dtype=np.int64)
    first_rank, first_seq, offsets = (np.array([r[k] for r in table], dtype=np.int64) for k in (1, 3, 4))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(lows, length.to_numpy() * far + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": first_seq[at] + rank.to_numpy() - first_rank[at], "offset": offsets[at]})

    # ranks begin, in each partition, after those of the partitions before it
    before = per_part.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as before")
    ranked = cut.join(before, ["part", "length"]).withColumn("at", slot(F.col("length"), F.col("before") + F.col("nth")))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked.select(*keep, "at.sequence_id", "at.offset", "row")
