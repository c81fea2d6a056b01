"""Near-duplicates by SetSketch registers.

A register keeps the truncated logarithm of the least exponential value that a set's
shingles take under one hash: registers of a union are the larger ones, and two sets
agree in a register about as often as they share shingles. Bands of registers propose
pairs; the likelihood of all registers and both set sizes drops pairs that cannot be
similar; the full sets decide. Equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.llm.bloom import build_filter, probe
from figmill.llm.common import components, numbered, release, saved

#: Bands and registers a band: a pair at similarity 0.8 is proposed by no band once in 300,000.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Pairs stay unless similarity at the threshold is this many nats less likely than the best (5 sigma).
NATS = 12.5
_rng = np.random.default_rng(2024)
_MUL = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.int64).view(np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.int64).view(np.uint64)
_word_hash: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a whole text.

    A-Z count as a-z, words are runs without ASCII white space; fewer words than
    ``width`` are one shingle, none give no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_word_hash) > 150_000:
        _word_hash.clear()
    known = _word_hash
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    span = min(width, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - span + 1, span, dtype=np.uint64)
        for i in range(span):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i])
    return np.unique(acc)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes; in blocks, so long texts need no more memory."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 512):
            np.minimum(least, (s[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=least)
    # the least of exponential values belongs to the least uniform one
    value = -np.log1p(-np.clip(least.astype(float) / 2.0**64, 1e-18, 1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)) + 20000, 0, TOP).astype(np.uint16)


def similar_enough(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Joint maximum-likelihood test of pairs: whether similarity ``least`` or more stays plausible.

    ``a`` and ``b`` are (pairs, registers). How often either register is larger and how
    often both agree follow from the similarity and both sizes.
    """
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :]
    most = np.minimum(u / v, v / u)
    jj = np.minimum(j, most)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = share(u - v * jj), share(v - u * jj)  # a larger register belongs to the set with the least value
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = up * log(p) + down * log(q) + same * log(1 - p - q)
    return np.where(j >= least - 1e-9, fit, -np.inf).max(axis=1) >= fit.max(axis=1) - NATS


def _sketched(docs: DataFrame, width: int, row: str | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cid, n, regs = [], [], []
            for t in b["text"]:
                s = shingles(t, width)
                cid.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                n.append(len(s))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "text_key": b["text_key"], "cid": pd.array(cid, dtype="Int64"), "n": n, "regs": regs})

    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(run, "row long, doc_id long, text_key long, cid long, n long, regs binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band = np.arange(BANDS)
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                regs = np.frombuffer(b"".join(part["regs"]), dtype=np.uint16).reshape(len(part), BANDS, ROWS)
                key = np.tile(band.astype(np.uint64), (len(part), 1))
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
                cid = part["cid"].to_numpy()
                yield pd.DataFrame({"band": np.tile(band, len(part)).astype(np.int8), "key": key.view(np.int64).ravel(), "cid": np.repeat(cid, BANDS), "n": np.repeat(part["n"].to_numpy(), BANDS)})

    return classes.mapInPandas(run, "band byte, key long, cid long, n long")


def _common(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Exact overlaps (a, b, n_a, n_b, common) of the pairs (a, b) of classes that may have ``percent`` in common, and the full sets used."""
    r = classes.select("cid", "n", "regs")
    both = pairs.join(r.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b")), "b").join(r.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a")), "a")

    @F.pandas_udf("boolean")
    def plausible(r_a: pd.Series, r_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        out = np.zeros(len(r_a), dtype=bool)
        for i in range(0, len(r_a), 1000):
            x, y = (np.frombuffer(b"".join(r.iloc[i : i + 1000]), dtype=np.uint16).reshape(-1, REGISTERS) for r in (r_a, r_b))
            out[i : i + 1000] = similar_enough(x, y, n_a.iloc[i : i + 1000].to_numpy(float), n_b.iloc[i : i + 1000].to_numpy(float), percent / 100)
        return pd.Series(out)

    near = saved(both.filter(plausible("r_a", "r_b", "n_a", "n_b")).select("a", "b"), "near-pairs", batch=4000)
    ids = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = saved(ids.join(classes.select("cid", "text_key"), "cid"), "near-classes")
    listed = probe(build_filter(wanted.select(F.col("text_key").alias("h"))))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t, width).tobytes() for t in b["text"]]
            own = [xxhash.xxh64_intdigest(s) - (1 << 63) == c for s, c in zip(found, b["cid"], strict=True)]
            yield pd.DataFrame({"cid": b["cid"], "s": found})[own]

    # only texts that the filter passes are moved, equal ones once: rows may lack a doc_id or repeat it, and a class needs one set
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").filter(listed(F.col("text_key")))
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text")).join(wanted, "text_key")
    full = saved(texts.select("cid", "text").mapInPandas(sets, "cid long, s binary"), "near-sets", batch=1000)
    paired = near.join(full.select(F.col("cid").alias("b"), F.col("s").alias("s_b")), "b").join(full.select(F.col("cid").alias("a"), F.col("s").alias("s_a")), "a")

    @F.pandas_udf("long")
    def overlap(s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        return pd.Series([_shared(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(s_a, s_b, strict=True)], dtype="int64")

    out = paired.select("a", "b", (F.octet_length("s_a") / 8).cast("long").alias("n_a"), (F.octet_length("s_b") / 8).cast("long").alias("n_b"), overlap("s_a", "s_b").alias("common"))
    out = saved(out, "near-overlaps", batch=500)
    release(docs.sparkSession)
    return out, full


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0


def _around_pivots(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among members of one pivot's group, found by how they differ from the pivot.

    ``pairs(a, b, n_a, n_b, c_a, c_b, meets)`` are members a near pivots b, both components
    and how central the pivot is.
    D(x), the shingles in which x differs from the pivot, gives the difference of x and y
    as D(x) + D(y) - 2 * common. If x is not linked to the pivot, x and y can only link if
    D(x) and D(y) share elements, at least as many as ``alone`` and ``beside`` below say; so
    their prefixes in order of rarity meet. Edits are rare where the pivot's own shingles are
    not, so few do. Two members are compared around the most central pivot that both are near.
    """
    beta = (100 - percent) / (100 + percent)  # most that two linked sets differ, over both sizes
    wanted = pairs.filter("c_a <> c_b").select("b").distinct()
    group = pairs.join(wanted, "b", "left_semi")
    held = group.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("s_b")), "b").join(sets.select(F.col("cid").alias("a"), F.col("s").alias("s_a")), "a")

    @F.pandas_udf("array<long>")
    def differing(s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        return pd.Series([np.setxor1d(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64), assume_unique=True) for x, y in zip(s_a, s_b, strict=True)])

    d = held.select(F.col("b").alias("pivot"), F.col("a").alias("x"), F.col("n_a").alias("n"), F.col("n_b").alias("n_pivot"), F.col("c_a").alias("c"), "meets", (F.col("c_a") != F.col("c_b")).alias("apart"), differing("s_a", "s_b").alias("d"))
    d = saved(d, "near-differences", batch=500)
    size = F.size("d")
    # elements that must be common: whatever the other member, and if the other is not linked to the pivot
    alone = F.greatest(F.lit(1), F.ceil(size - beta * F.col("n") * (1 + 100 / percent) - 1e-9))
    beside = F.greatest(alone, F.ceil((size + beta * (F.col("n_pivot") - F.col("n"))) / 2 - 1e-9))
    home = F.max_by("pivot", F.struct("meets", "pivot")).over(Window.partitionBy("x"))
    each = d.withColumn("home", home).select("pivot", "x", "n", "c", "apart", "home", size.alias("size"), (size - alone + 1).alias("long"), (size - beside + 1).alias("short"), F.explode("d").alias("token"))
    common = each.groupBy("pivot", "token").agg(F.count("*").alias("f")).filter("f > 1")
    # a token that only one member has cannot meet another, but takes its place in the prefix
    ranked = each.join(common, ["pivot", "token"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("pivot", "x").orderBy("f", "token"))
    fore = ranked.withColumn("rank", rank).filter("f > 1 AND rank <= IF(apart, long, short)")
    fore = saved(fore.select("pivot", "token", "x", "n", "c", "apart", "home", "size", (F.col("size") - F.col("rank")).alias("after"), (F.col("rank") <= F.col("short")).alias("short")), "near-prefixes")
    side = lambda k, df: df.select("pivot", "token", F.col("x").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("c", "home", "n", "size", "after")])
    # if this is their first common element, what comes after it must still hold enough
    other = f"c_a <> c_b AND (home_a <> home_b OR home_a = pivot) AND 1 + least(after_a, after_b) >= (size_a + size_b - {beta!r} * (n_a + n_b)) / 2 - 1e-9"
    loose = side("a", fore.filter("apart")).join(side("b", fore.filter("NOT apart")), ["pivot", "token"]).filter(other)
    tight = fore.filter("apart AND short")
    tight = side("a", tight).join(side("b", tight), ["pivot", "token"]).filter(f"a < b AND {other}")
    met = loose.unionByName(tight).select("pivot", "a", "b").distinct()
    sides = [d.select("pivot", F.col("x").alias(k), F.col("n").alias(f"n_{k}"), F.col("d").alias(f"d_{k}")) for k in "ab"]
    full = met.join(sides[0], ["pivot", "a"]).join(sides[1], ["pivot", "b"])

    @F.pandas_udf("long")
    def overlap(d_a: pd.Series, d_b: pd.Series) -> pd.Series:
        # as sorted signed numbers, which both sides are
        return pd.Series([_shared(np.sort(x), np.sort(y)) for x, y in zip(d_a, d_b, strict=True)], dtype="int64")

    apart_by = F.size("d_a") + F.size("d_b") - 2 * overlap("d_a", "d_b")
    shared = (F.col("n_a") + F.col("n_b") - apart_by) / 2
    return saved(full.withColumn("common", shared).filter(F.expr(_LINKED.format(percent))).select("a", "b"), "near-links")


#: Exact test on two sets' sizes and overlap.
_LINKED = "100 * common >= {} * (n_a + n_b - common)"


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """Classes of near-duplicates among ``docs(doc_id, text)``: row, doc_id, n_shingles, component_id, kept, stays.

    Texts link if ``percent`` of their united ``width``-word shingles are common.
    component_id is the smallest doc_id reachable over links. ``kept``: doc_id is
    component_id; ``stays`` holds for one row of each component even if rows
    repeat a doc_id. A text without words links with nothing. Null texts have no
    words; a row without doc_id links, but names no component unless all in it
    are null; other columns are ignored. ``row`` in the result is the column of that
    name that ``row`` gives, else a number made here.

    Every member of a band's bucket meets the bucket's pivot, the member that meets most
    others over all bands. Similarity is a metric: a member near the pivot can only link
    with members at most twice as far from it, and those that this leaves in several
    components are compared by their differences from the pivot; the few that are farther
    meet the bucket's other members that are not linked to the pivot. So a large group
    costs about its size, and no proposed pair that matters for the components goes untested.
    """
    rows = saved(_sketched(docs, width, row), "sketches", batch=1000)
    classes = saved(rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    bands = saved(_banded(classes), "bands")
    release(docs.sparkSession)
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = saved(bands.join(shared, ["band", "key"]), "bucket-members")
    central = saved(met.groupBy("cid").agg(F.sum("size").alias("meets")), "bucket-central")
    pivots = met.join(central, "cid").groupBy("band", "key").agg(F.max(F.struct("meets", "cid", "n")).alias("p")).select("band", "key", F.col("p.cid").alias("pivot"), F.col("p.n").alias("n_pivot"))
    members = saved(met.join(pivots, ["band", "key"]).select("band", "key", "cid", "n", "pivot", "n_pivot"), "bucket-pivots")
    release(docs.sparkSession)
    around = max(0, 2 * percent - 100)
    fits = lambda x, y, least: F.least(x, y) * 100 >= F.greatest(x, y) * least  # noqa: E731  sizes bound the similarity
    stars = members.filter("cid <> pivot").filter(fits(F.col("n"), F.col("n_pivot"), around)).select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    near, sets = _common(stars, classes, docs, width, around)
    links = saved(near.filter(_LINKED.format(percent)).select("a", "b"), "near-links")
    first = components(links, "near-first")
    part = lambda k: first.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
    placed = near.join(part("a"), "a", "left").join(part("b"), "b", "left").withColumns({f"c_{k}": F.coalesce(f"c_{k}", k) for k in "ab"})
    placed = placed.join(central.withColumnRenamed("cid", "b"), "b")
    more = _around_pivots(saved(placed, "near-placed"), sets, percent)
    release(docs.sparkSession)
    seen = near.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), F.expr(_LINKED.format(percent)).alias("linked"))
    open_members = members.filter("cid <> pivot").join(seen, ["cid", "pivot"], "left").filter("linked IS NULL OR NOT linked")
    open_members = saved(open_members.join(part("cid"), "cid", "left").select("band", "key", "cid", "n", F.coalesce("c_cid", "cid").alias("c"), F.col("linked").isNull().alias("far")), "bucket-open")
    far = open_members.filter("far").select("band", "key", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    others = open_members.select("band", "key", F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"), F.col("far").alias("both"))
    rest = far.join(others, ["band", "key"]).filter("c_a <> c_b AND (NOT both OR a < b)").filter(fits(F.col("n_a"), F.col("n_b"), percent))
    last, _ = _common(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, docs, width, percent)
    final = components(links.unionAll(more).unionAll(last.filter(_LINKED.format(percent)).select("a", "b")), "near-final")
    named = classes.select("cid", "doc_id").join(final.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = saved(named, "near-named")
    labels = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("cid", "component", "component_id")
    out = rows.select("row", "doc_id", "n", "cid").join(labels, "cid", "left").withColumn("component_id", F.coalesce("component_id", F.when(F.col("cid").isNull(), F.col("doc_id"))))
    out = saved(out, "near-out")
    release(docs.sparkSession)
    # a component without any doc_id has no component_id, so its rows meet under its class
    first_row = out.filter("doc_id <=> component_id AND cid IS NOT NULL").groupBy("component").agg(F.min("row").alias("first_row"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.join(first_row, "component", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), (F.col("cid").isNull() | (F.col("row") == F.col("first_row"))).alias("stays"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` without near-duplicates: of each component the row with the smallest doc_id stays, with all columns whatever their names."""
    rows, mark = numbered(docs, "near-rows")
    stays = near_duplicates(rows, width, percent, mark).filter("stays").select(F.col("row").alias(mark))
    return rows.join(stays, mark, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
