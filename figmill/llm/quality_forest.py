"""Quality rules with an isolation forest over the rule statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.llm.common import saved

#: Trees, and the rows that each tree of an isolation forest is made of: every tree draws its own from all labelled rows.
TREES, TREE_ROWS, SEED = 128, 64, 7
#: Cells of (0, 1) by which labelled rows are counted on the way to a threshold.
CELLS = 1 << 16
#: Share of good labelled rows that the threshold may give up.
LOST_GOOD = 0.005
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_marks", "n_distinct"]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
_MARKS = b"!?.,;:-_()[]{}\"'/\\#*$%&|<>=+@^~`"


def statistics(text: str | None) -> tuple[int, ...]:
    """The rule statistics of one whole text, BASE then MORE. Words are runs without ASCII white space."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n > 3:
        k = len(codes)
        first = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        _, at, count = np.unique(first[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        twice = count[at] > 1
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        repeated = int(covered.sum())
    return (
        n,
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(raw) - len(raw.translate(None, _MARKS)),
        len(codes),
    )


def features(x: pd.DataFrame) -> np.ndarray:
    """Scale-free forest inputs: mean word length, shares of symbols and marks, distinct words against Heaps growth.

    Lengths, repeated lines and windows are left to the base rules: among good texts
    their long tails are isolated sooner than junk is.
    """
    n, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    cols = [x["word_chars"] / n, x["n_symbols"] / chars, x["n_marks"] / chars, x["n_distinct"] / n**0.8]
    return np.stack([np.asarray(c, dtype=float) for c in cols], axis=1)


def _mean_path(n: float) -> float:
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Forest:
    """Isolation forest as flat arrays: each tree's nodes hold feature, cut, children or a path length."""

    def __init__(self, parts: list[np.ndarray], seed: int = SEED):
        rng = np.random.default_rng(seed)
        rows = max(map(len, parts))
        self.scale, self.trees = _mean_path(rows) or 1.0, []
        limit = int(np.ceil(np.log2(max(rows, 2)))) + 2
        for x in parts:
            feature, cut, left, right, length = [], [], [], [], []

            def grow(part: np.ndarray, depth: int) -> int:
                me = len(feature)
                for a in (feature, left, right):
                    a.append(-1)
                cut.append(0.0)
                length.append(depth + _mean_path(len(part)))
                low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
                wide = np.flatnonzero(high > low)
                if depth < limit and len(part) > 1 and len(wide):
                    f = int(rng.choice(wide))
                    c = float(rng.uniform(low[f], high[f]))
                    feature[me], cut[me] = f, c
                    left[me] = grow(part[part[:, f] <= c], depth + 1)
                    right[me] = grow(part[part[:, f] > c], depth + 1)
                return me

            grow(x, 0)
            self.trees.append(tuple(map(np.array, (feature, cut, left, right, length))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the power of minus the mean path length over the usual one."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[every, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / self.scale)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers stirred, as splitmix64 does."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(labelled: DataFrame, names: list[str], total: int, trees: int = TREES, rows: int = TREE_ROWS) -> list[np.ndarray]:
    """The features of the rows of each tree: the first ``rows`` of all ``total`` labelled rows, in an order of the tree's own.

    Rows too late in a tree's order stay where they are, so some four times as many as the trees take reach the driver.
    """
    bound = np.uint64(min((1 << 64) - 1, int((1 << 64) * (4 * rows / max(total, 1)))))

    def early(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, x = b["h"].to_numpy().view(np.uint64), features(b)
            for tree in range(trees):
                order = _mixed(own ^ _mixed(np.uint64([SEED * 1_000_003 + tree])))
                at = np.flatnonzero(order <= bound)
                if len(at):
                    yield pd.DataFrame({"tree": tree, "place": (order[at] >> np.uint64(1)).astype(np.int64), **{f"f{k}": x[at, k] for k in range(x.shape[1])}})

    one = labelled.select(F.xxhash64("doc_id", *names).alias("h"), *names)
    few = one.mapInPandas(early, "tree int, place long, " + ", ".join(f"f{k} double" for k in range(4))).toPandas()
    few = few.sort_values(list(few.columns)).groupby("tree").head(rows)
    return [part.iloc[:, 2:].to_numpy() for _, part in few.groupby("tree")]


def calibrated(scored: DataFrame) -> float:
    """The highest threshold that catches most bad rows of ``scored(anomaly, good)`` net of good ones, losing at most LOST_GOOD of the good; half way to the next score.

    All rows count: cells of scores are summed first, and each cell then knows the rows above it.
    """
    n = [F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")]
    by_score = scored.groupBy("anomaly").agg(*n).withColumn("cell", F.floor(F.col("anomaly") * CELLS).cast("int"))
    by_score = saved(by_score, "quality-scores")
    cells = by_score.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas().sort_values("cell", ascending=False)  # CELLS + 1 rows at most
    goods, bads = int(cells["good"].sum()), max(1, int(cells["bad"].sum()))
    cells["good_above"], cells["bad_above"] = cells["good"].cumsum() - cells["good"], cells["bad"].cumsum() - cells["bad"]
    above = by_score.sparkSession.createDataFrame(cells[["cell", "good_above", "bad_above"]], "cell int, good_above long, bad_above long")
    w = Window.partitionBy("cell").orderBy(F.desc("anomaly")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = by_score.join(F.broadcast(above), "cell")
    for c in ("good", "bad"):
        cuts = cuts.withColumn(f"{c}_above", F.col(f"{c}_above") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    lost, caught = F.col("good_above") / F.lit(float(goods)), F.col("bad_above") / F.lit(float(bads))
    gain = F.when(lost <= LOST_GOOD, caught - lost).otherwise(-1.0)
    best = cuts.agg(F.max(F.struct(gain.alias("gain"), "anomaly")).alias("best")).first()["best"]["anomaly"]
    after = by_score.filter(F.col("anomaly") > F.lit(best)).agg(F.min("anomaly")).first()[0]
    return best if after is None else (best + after) / 2


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality verdict of every whole text of ``docs(doc_id, text)`` from ``labels(doc_id, quality)``.

    Returns doc_id, the statistics, base_failed (under 50 words, or over half of
    them in repeated 3-word windows), anomaly (forest score), kept. The forest
    draws the rows of each tree from all labelled rows, and all of them set the threshold, which
    gives up at most LOST_GOOD of the good ones that pass the base rules. Without labelled rows
    only the base rules decide. Null texts have no words; repeated rows are
    judged each; null labels and label rows without a document are ignored;
    other columns are ignored.
    """
    names = BASE + MORE

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t) for t in b["text"]]
            yield pd.concat([b[["doc_id"]], pd.DataFrame(rows, columns=names, index=b.index, dtype="int64")], axis=1)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(measured, "doc_id long, " + ", ".join(f"{c} long" for c in names))
    found = saved(found, "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the forest judges what the base rules pass, so only such rows calibrate it
    labelled = saved(found.filter(f"NOT ({BASE_FAILED})").join(known, "doc_id"), "quality-labelled")
    forest, threshold, total = None, 2.0, labelled.count()
    if labelled.filter("quality > 0").limit(1).count():
        forest = Forest(drawn(labelled, names, total))

        def scored_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"anomaly": forest.score(features(b)), "good": b["quality"] > 0})

        threshold = calibrated(labelled.mapInPandas(scored_only, "anomaly double, good boolean"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["anomaly"] = forest.score(features(b)) if forest and len(b) else np.zeros(len(b))
            yield b

    scored = found.mapInPandas(judged, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", anomaly double")
    return scored.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))
