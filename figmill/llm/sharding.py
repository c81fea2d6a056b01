"""Sharding by histogram sort.

Every document has a key of three 60-bit words: hash of the text, hash of the
doc_id, hash of the row. In key order equal texts lie side by side. Rounds of
exact counts below candidate boundaries refine the cells that hold a wanted
splitter (until a boundary lies within tolerance) or too many rows (a hot group
of copies is cut by the later words). Only then are rows exchanged, once, by cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.llm.common import saved, text_crc32

#: Bits of a word that the first and each further round look at; a word has 60.
FIRST_BITS, NEXT_BITS, WORD_BITS = 12, 8, 60
#: Bytes that each row costs beside its text.
ROW_BYTES = 8


def _root():
    return {"word": 0, "done": 0, "low": (0, 0, 0)}


def _children(keys: DataFrame, active: list[dict]) -> dict[int, list[dict]]:
    """Exact rows and bytes of the next finer cells inside each active cell, in key order."""
    frames = {}
    for word in {c["word"] for c in active}:
        for done in {c["done"] for c in active if c["word"] == word}:
            group = [(i, c) for i, c in enumerate(active) if (c["word"], c["done"]) == (word, done)]
            bits = FIRST_BITS if done == 0 else NEXT_BITS
            at = keys
            if group[0][1]["low"] != (0, 0, 0) or word or done:
                wanted = keys.sparkSession.createDataFrame([(i, *c["low"]) for i, c in group], "cell int, p0 long, p1 long, p2 long")
                # cells per round are bounded by the shards plus 1 / hot_share, so this side is small by construction
                prefix = [F.col(f"w{j}") == F.col(f"p{j}") for j in range(word)]
                if done:
                    prefix.append(F.shiftrightunsigned(f"w{word}", WORD_BITS - done) == F.shiftrightunsigned(f"p{word}", WORD_BITS - done))
                at = keys.join(F.broadcast(wanted), prefix)
            else:
                at = keys.withColumn("cell", F.lit(group[0][0]))
            digit = F.shiftrightunsigned(f"w{word}", WORD_BITS - done - bits).bitwiseAND((1 << bits) - 1)
            counted = at.groupBy("cell", digit.alias("digit")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min(f"w{word}").alias("least"), F.max(f"w{word}").alias("most"))
            for r in counted.collect():
                parent = active[r["cell"]]
                low = list(parent["low"])
                low[word] += r["digit"] << (WORD_BITS - done - bits)
                child = {"word": word, "done": done + bits, "low": tuple(low), "rows": r["rows"], "bytes": r["bytes"]}
                if r["least"] == r["most"]:  # one value: go on with the next word
                    low[word] = r["least"]
                    child |= {"word": word + 1, "done": 0, "low": tuple(low), "at": r["least"]}
                elif child["done"] >= WORD_BITS:
                    child |= {"word": word + 1, "done": 0}
                frames.setdefault(r["cell"], []).append(child)
    return {k: sorted(v, key=lambda c: c["low"]) for k, v in frames.items()}


def histogram_cells(keys: DataFrame, shards: int, tolerance: float, hot_share: float) -> tuple[list[dict], list[int]]:
    """Cells in key order and the cell index at which each shard after the first begins."""
    total_rows, total_bytes = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not total_rows:
        return [_root() | {"rows": 0, "bytes": 0}], [1] * (shards - 1)
    cells = [_root() | {"rows": total_rows, "bytes": total_bytes}]
    goals = [total_bytes * k / shards for k in range(1, shards)]
    slack = tolerance * total_bytes / shards
    while True:
        ends = np.cumsum([c["bytes"] for c in cells])
        open_cells = {i for i, c in enumerate(cells) if c["word"] < 3 and c["rows"] > max(1, hot_share * total_rows)}
        for goal in goals:
            i = int(np.searchsorted(ends, goal))
            begin = ends[i] - cells[i]["bytes"]
            if cells[i]["word"] < 3 and cells[i]["rows"] > 1 and min(goal - begin, ends[i] - goal) > slack:
                open_cells.add(i)
        if not open_cells:
            break
        order = sorted(open_cells)
        finer = _children(keys, [cells[i] for i in order])
        inside = {i: finer[k] for k, i in enumerate(order)}
        cells = [x for i, c in enumerate(cells) for x in inside.get(i, [c])]
    starts, last = [], 0
    for goal in goals:
        i = int(np.searchsorted(ends, goal))
        begin = ends[i] - cells[i]["bytes"]
        last = max(last, i if goal - begin <= ends[i] - goal else i + 1)
        starts.append(last)
    return cells, starts


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, hot_share: float = 1 / 512) -> DataFrame:
    """Deal ``docs(doc_id, text)`` into ``shards`` of near equal bytes: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 8. Splitters lie within ``tolerance``
    of a shard's bytes from the ideal place when a boundary between texts does;
    else equal texts are cut between rows. ``slot`` numbers a shard's rows from 0
    without gaps. Null texts have no bytes and CRC 0, null doc_ids are kept,
    repeated rows each take a slot, an empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    word = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 64 - WORD_BITS)
    keys = saved(
        rows.select(
            "doc_id",
            (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long").alias("size"),
            text_crc32(F.col("text")).alias("text_crc32"),
            word("text").alias("w0"),
            word("doc_id").alias("w1"),
            word(F.monotonically_increasing_id()).alias("w2"),
        ),
        "shard-keys",
    )
    cells, starts = histogram_cells(keys, shards, tolerance, hot_share)
    pack = lambda *w: np.ascontiguousarray(np.stack(w, axis=-1).astype(">u8")).view("S24").ravel()
    lows = pack(*(np.array([c["low"][j] for c in cells], dtype=np.int64) for j in range(3)))
    shard_of = np.searchsorted(np.array(starts), np.arange(len(cells)), side="right")
    before = np.concatenate([[0], np.cumsum([c["rows"] for c in cells])[:-1]])
    first = np.array([before[np.searchsorted(shard_of, s)] for s in shard_of])
    base = before - first

    @F.pandas_udf("cell int, shard int, base long")
    def placed(w0: pd.Series, w1: pd.Series, w2: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(lows, pack(w0.to_numpy(), w1.to_numpy(), w2.to_numpy()), side="right") - 1
        return pd.DataFrame({"cell": at, "shard": shard_of[at], "base": base[at]})

    at = keys.withColumn("at", placed("w0", "w1", "w2")).select("doc_id", "size", "text_crc32", "w0", "w1", "w2", "at.*")
    order = Window.partitionBy("cell").orderBy("w0", "w1", "w2")
    return at.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.row_number().over(order) - 1).cast("long").alias("slot"))
