"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

A source's rows are wanted r times each on average. Every row gets floor(r)
copies; the fractions are settled in pairs: words move at random from one row to
the other until one has a whole copy or none, which keeps the source's expected
words exact. A fold settles a chunk of rows up to one undecided row; the
undecided rows of FAN_IN chunks form the next level's chunk, up to one a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.llm.common import WORD, saved, text_crc32, unused

#: Rows that one fold settles, about; undecided rows that the next level's fold takes.
FAN_IN, MOST_COPIES = 64, 3
#: The weights that the sources take in turn.
WEIGHTS = (1, 2, 3)
_EDGE = 1e-12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target of each source from ``sizes(source, source_size)``: the total shared by weight, at most ``most`` times its size.

    Filling by weight and resharing the excess until none is above has a closed
    form: in order of size / weight, a source is full if its share of what the
    ones before it leave would exceed its limit; the others share the rest.
    One row a source, so the ordered windows are over sources, not rows.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (total - F.coalesce(before, F.lit(0))) / onward)
    share = F.max(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))).over(Window.partitionBy())
    return level.withColumn("share", share).withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(F.col("share") * F.col("weight"), F.lit(0.0))))


def _settle(carry: Column, row: Column, seed: int) -> Column:
    """Both rows after one transfer: (settled, still open)."""
    a, b = carry["size"] * carry["p"], row["size"] * row["p"]
    a_left, b_left = carry["size"] - a, row["size"] - b
    up, down = F.least(a_left, b), F.least(a, b_left)
    # a hash of both rows decides, so reruns agree however rows are dealt
    dice = F.pmod(F.xxhash64(F.lit(seed), carry["h"], row["h"], carry["doc_id"], row["doc_id"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rise = dice * (up + down) < down
    with_p = lambda x, p: x.withField("p", p)
    end = lambda done, still: F.struct(done.alias("done"), still.alias("still"))
    one, none = F.lit(1.0), F.lit(0.0)
    return F.when(
        rise,
        F.when(a_left <= b, end(with_p(carry, one), with_p(row, (b - a_left) / row["size"]))).otherwise(end(with_p(row, none), with_p(carry, (a + b) / carry["size"]))),
    ).otherwise(F.when(a <= b_left, end(with_p(carry, none), with_p(row, (b + a) / row["size"]))).otherwise(end(with_p(row, one), with_p(carry, (a - b_left) / carry["size"]))))


def _fold(rows: Column, seed: int) -> Column:
    """Settle the rows of an array in turn: (rows with p 0 or 1, the one row left open)."""
    kind = "struct<h:bigint,doc_id:bigint,crc:bigint,size:bigint,times:bigint,whole:bigint,p:double>"

    def step(acc: Column, row: Column) -> Column:
        carry = acc["still"]
        whole = (carry["p"] <= _EDGE) | (carry["p"] >= 1 - _EDGE)
        both = F.when(whole, F.struct(carry.withField("p", F.round(carry["p"])).alias("done"), row.alias("still"))).otherwise(_settle(carry, row, seed))
        return F.when(carry.isNull(), F.struct(acc["done"].alias("done"), row.alias("still"))).otherwise(F.struct(F.concat(acc["done"], F.array(both["done"])).alias("done"), both["still"].alias("still")))

    return F.aggregate(rows, F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("still")), step)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 11) -> DataFrame:
    """Copies that the mix takes of every row of ``docs(doc_id, text, source)``.

    Returns doc_id, source, size (words), crc, source_size, target, nth, copies.
    A source's words in the mix differ from its target by at most half of one
    row's size, and no row is taken over ``most`` times. Rows alike in doc_id, text
    and source share their copies evenly and are told apart by ``nth`` from 1.
    Null texts have size 0; rows of size 0 are taken once. A null source is a
    source, the last. An empty table gives no rows; other columns are ignored.
    """
    same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("crc"))
    rows = saved(same.groupBy("doc_id", "source", "size", "crc").agg(F.count("*").alias("times")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n"))
    wanted = saved(targets(sizes, weights, most).select("source", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).alias("chunks")), "mix-targets")
    rate = F.col("times") * F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rows.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    ready = rated.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "crc", "size"))
    item = F.struct("h", "doc_id", "crc", "size", "times", "whole", "p")
    empty = ready.filter("size = 0").select("source", F.struct("h", "doc_id", "crc", "size", "times", F.lit(0).cast("long").alias("whole"), F.col("times").cast("double").alias("p")).alias("row"))
    level = ready.filter("size > 0").select("source", F.pmod(F.col("h"), F.col("chunks")).alias("chunk"), item.alias("row"))
    settled = [empty]
    most_chunks = wanted.agg(F.max("chunks")).first()[0] or 1
    while True:
        folded = saved(level.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(F.struct((-F.col("row.size")).alias("rank"), "row"))).alias("rows")).select("source", "chunk", _fold(F.col("rows.row"), seed).alias("x")), "mix-level")
        settled.append(folded.select("source", F.explode("x.done").alias("row")))
        level = folded.select("source", F.floor(F.col("chunk") / FAN_IN).alias("chunk"), F.col("x.still").alias("row"))
        if most_chunks <= 1:
            break
        most_chunks = -(-most_chunks // FAN_IN)
    # one row a source is left: the nearer end keeps the source within half of that row's size
    settled.append(level.select("source", F.col("row").withField("p", F.round("row.p")).alias("row")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = F.col("row.whole") + F.round("row.p").cast("long")
    each = out.select("source", "row.*", copies.alias("all")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    each = each.withColumn("copies", F.floor(F.col("all") / F.col("times")) + (F.col("nth") <= F.pmod(F.col("all"), F.col("times"))).cast("long"))
    known = wanted.select(F.col("source").alias("of"), "source_size", "target")
    return each.join(known, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "crc", "source_size", "target", "nth", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)`` as often as ``plan`` takes them, with all their columns, whatever their names."""
    mark, times, copy = (unused(docs, f"figmill_{x}") for x in ("row", "times", "copy"))
    numbered = docs.withColumn(mark, F.monotonically_increasing_id())
    keys = numbered.select(mark, F.col("doc_id").cast("long").alias("k_doc"), F.col("source").alias("k_source"), word_count(F.col("text")).alias("k_size"), text_crc32(F.col("text")).alias("k_crc"))
    keys = keys.withColumn("nth", F.row_number().over(Window.partitionBy("k_doc", "k_source", "k_size", "k_crc").orderBy(mark)).cast("long"))
    p = plan(docs, **options).select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "source", "size", "crc", "nth", "copies")])
    same = [F.col(f"k_{a}").eqNullSafe(F.col(f"p_{b}")) for a, b in (("doc", "doc_id"), ("source", "source"), ("size", "size"), ("crc", "crc"))]
    taken = keys.join(p, [*same, F.col("nth") == F.col("p_nth")]).filter("p_copies > 0").select(mark, F.col("p_copies").alias(times))
    return numbered.join(taken, mark).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
