"""Line dedup by a segment-partition edit join. DataFrame operations only.

Lines within ``edits`` edits of each other, cut into edits + 1 segments, share at least
one segment at nearly the same place. Every distinct line is entered under the hashes of
the substrings at which its own segments, or those of a line up to ``edits`` shorter, can
lie; lines that meet under a hash and whose character counts allow it are compared by a
bit-parallel automaton whose state covers only the band of 2 * edits + 1 diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.llm.common import WORD, discard, key_filter, numbered, passing, release, saved, text_crc32, unused

#: Edits that near lines may differ by, and the code points from which they may be that many; see judge_lines for shorter lines.
EDITS, LEAST_CHARS = 2, 40
#: Low bits of a line's id are its hash; the high ones order lines by how common they are, common ones first.
HASH_BITS = 57


def line_hash(line: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(line), 64 - HASH_BITS)


def windows(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): where segment i of a line that much shorter may begin in this line.

    Shifts beyond these need more edits before or after the segment than another segment's match leaves.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _keyed(lines: DataFrame, edits: int) -> DataFrame:
    """(id, key) of ``lines(id, line, chars)``: hashes of the substrings at all windows that fit.

    One row a window comes first, so the expression stays small enough to be compiled.
    """
    parts = edits + 1
    shape = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in windows(edits)])
    # where characters are bytes, parts are cut without counting from the line's beginning
    each = lines.select("id", "line", "chars", F.col("line").cast("binary").alias("raw"), (F.octet_length("line") == F.col("chars")).alias("plain"))
    each = each.withColumn("w", F.explode(shape)).select("id", "line", "chars", "raw", "plain", "w.*")
    each = each.withColumn("size", F.col("chars") - F.col("less")).withColumn("more", F.col("size") % parts).withColumn("base", ((F.col("size") - F.col("more")) / parts).cast("int"))
    start = F.col("base") * F.col("i") + F.greatest(F.lit(0), F.col("more") - parts + F.col("i")) + F.col("shift")
    each = each.withColumn("start", start).withColumn("long", F.col("base") + F.when(F.col("more") >= parts - F.col("i"), 1).otherwise(0))
    fit = each.filter("start >= 0 AND start + long <= chars AND base > 0")
    cut = lambda c: F.xxhash64(F.lit(edits), "i", "size", F.substring(c, F.col("start") + 1, F.col("long")))
    return fit.select("id", F.when(F.col("plain"), cut("raw")).otherwise(cut("line")).alias("key"))


def _states(a: Column, b: Column, edits: int) -> Column:
    """State words after ``b`` of the automaton for ``a``: one for each number of errors, one bit for each diagonal.

    Bit d after j characters of ``b`` says that the first j + d - edits characters of
    ``a`` reach them with that many errors: kept by an equal character, gained from one
    error less by a substitution, an insertion (diagonal above) or a deletion (below).
    Only the band of 2 * edits + 1 diagonals is held; dead states stay dead unread.
    """
    wide = 2 * edits + 1
    full = (1 << wide) - 1
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    top = f"r{edits}"
    start = F.struct(chars(a).alias("a"), F.lit(0).alias("j"), *[F.lit(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)])

    def step(s: Column, c: Column) -> Column:
        equal = F.lit(0)
        for d in range(wide):
            at = s["j"] + (d - edits)
            equal = equal.bitwiseOR(F.when((at >= 0) & (F.get(s["a"], at) == c), 1 << d).otherwise(0))
        seen = F.struct(s.alias("s"), equal.alias("equal"))

        def move(x: Column) -> Column:
            words = [x["s"]["r0"].bitwiseAND(x["equal"])]
            for e in range(1, edits + 1):
                less = x["s"][f"r{e - 1}"]
                words.append(x["s"][f"r{e}"].bitwiseAND(x["equal"]).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(words[-1], 1)).bitwiseAND(F.lit(full)))
            return F.struct(x["s"]["a"].alias("a"), (x["s"]["j"] + 1).alias("j"), *[w.alias(f"r{e}") for e, w in enumerate(words)])

        return F.when(s[top] == 0, s).otherwise(F.get(F.transform(F.array(seen), move), F.lit(0)))

    return F.aggregate(chars(b), start, step, lambda s: s[top])


#: Characters after the first difference that are read before the rest.
_PEEK = 16


def near_pairs(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose strings are within ``edits`` edits.

    Equal beginnings and ends never need an edit, so only what lies between them is
    compared, and its first characters first: most other pairs end there.
    """
    powers = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    least = F.least(F.length("a"), F.length("b"))

    def common(side) -> Column:
        # the longest equal beginning (or end), by halving
        def grow(n: Column, more: Column) -> Column:
            return F.when((n + more <= F.col("least")) & (side(F.col("a"), n + more) == side(F.col("b"), n + more)), n + more).otherwise(n)

        return F.aggregate(powers, F.lit(0), grow)

    out = pairs.withColumn("least", least).filter(F.abs(F.length("a") - F.length("b")) <= edits).withColumn("head", common(F.left))
    out = out.withColumn("rest_a", F.substring("a", F.col("head") + 1, F.length("a") - F.col("head"))).withColumn("rest_b", F.substring("b", F.col("head") + 1, F.length("b") - F.col("head")))
    peek = _states(F.substring("rest_a", 1, _PEEK + edits), F.substring("rest_b", 1, _PEEK), edits)
    out = out.filter((F.length("rest_b") <= _PEEK) | (peek != 0))
    diagonal = F.length("rest_a") - F.length("rest_b") + edits
    return out.filter(F.getbit(_states(F.col("rest_a"), F.col("rest_b"), edits), diagonal) == 1).drop("least", "head", "rest_a", "rest_b")


#: Disjoint sets of characters whose counts bound the edits between two strings.
BAGS = [" ", "e", "t", "a", "n", "r", "o", "i", "s", "h", "d", "l", "u", "cmg", "fwyp", "bvkjxqz"]


def bags(line: Column) -> list[Column]:
    """Counts of the character sets (255 at most), eight to a number."""
    counts = [F.least(F.lit(255), F.length(line) - F.length(F.translate(line, x, ""))).cast("long") for x in BAGS]
    packed = []
    for half in (counts[:8], counts[8:]):
        word = half[0]
        for k, c in enumerate(half[1:], 1):
            word = word.bitwiseOR(F.shiftleft(c, 8 * k))
        packed.append(word)
    return packed


def bags_fit(a: str, b: str, edits: int) -> Column:
    """One edit changes the counts by two in all at most, so pairs that differ more are no near ones."""
    terms = [f"abs((shiftright({a}{w}, {8 * k}) & 255) - (shiftright({b}{w}, {8 * k}) & 255))" for w in (0, 1) for k in range(8)]
    return F.expr(" + ".join(terms)) <= 2 * edits


def instances(docs: DataFrame, least: int, short: bool = False) -> DataFrame:
    """The lines of ``docs(row, doc_id, text)`` with ``least`` or more code points, or with ``short`` all that hold a word: row, doc_id, pos, line."""
    judged = F.col("line").rlike(WORD) if short else F.length("line") >= least
    return docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(judged)


def _shortest(k: int, edits: int, least: int) -> int:
    """Code points from which lines may differ by ``k`` edits: the share of ``least`` that k is of ``edits``."""
    return -(-k * least // edits)


def _keyed_by_length(lines: DataFrame, edits: int, least: int, short: bool) -> DataFrame:
    """_keyed with as many edits as each line's length allows; a line that is longer than such a one by its edits is keyed for both."""
    keyed = _keyed(lines.filter(F.col("chars") >= least), edits)
    for k in range(1, edits if short else 1):
        fits = F.col("chars").between(_shortest(k, edits, least), _shortest(k + 1, edits, least) - 1 + k)
        keyed = keyed.unionAll(_keyed(lines.filter(fits), k))
    return keyed


def judge_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: bool = False) -> DataFrame:
    """The distinct lines that lose copies: hash, near, first_doc.

    Lines are ordered by how many copies they have (by powers of two), then by hash.
    ``near``: an earlier line is within ``edits`` edits, so all copies go. Else the
    line is repeated and only its first copy in the document of smallest id stays.
    Lines shorter than ``least`` are left out; with ``short`` those that hold a word
    are judged too: equal ones at every length, near ones by the edits that the
    shorter line's length allows, ``edits`` at ``least`` and in proportion below.
    """
    spark = docs.sparkSession
    grouped = instances(docs, least, short).groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).withColumn("hash", line_hash(F.col("line")))
    rank = F.shiftleft(63 - F.floor(F.log2("n")), HASH_BITS)
    lines = saved(grouped.select(rank.bitwiseOR(F.col("hash")).alias("id"), "hash", "line", F.length("line").alias("chars"), "n", "first_doc"), "lines")
    release(spark)
    keyed = lambda: _keyed_by_length(lines, edits, least, short)
    shared = saved(keyed().groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "line-keys")
    release(spark)
    # lines with a shared key are few, so the second pass over all keys moves only those
    met = passing(keyed(), "key", saved(key_filter(shared, "key"), "line-key-filter")).join(shared, "key")
    met = saved(met.distinct(), "line-met")
    firsts = met.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("key", "first")
    members = saved(met.join(firsts, "key"), "line-members")
    involved = saved(members.select("id").distinct(), "line-involved")
    texts = passing(lines.select("id", "line"), "id", saved(key_filter(involved, "id"), "line-id-filter")).join(involved, "id")
    texts = saved(texts.select("id", "line", *[x.alias(f"b{i}") for i, x in enumerate(bags(F.col("line")))]), "line-texts")
    members = saved(members.join(texts.drop("line"), "id"), "line-bags")
    release(spark)
    own = lambda name: [F.col("id").alias(name), *[F.col(f"b{i}").alias(f"{name}{i}") for i in (0, 1)]]

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Later lines of (id, earlier) pairs that are near the earlier one."""
        left = pairs.join(texts.select(F.col("id").alias("earlier"), F.col("line").alias("b")), "earlier")
        near = near_pairs(left.join(texts.select("id", F.col("line").alias("a")), "id"), edits)
        shorter = F.least(F.length("a"), F.length("b"))
        allowed = (shorter >= least) | (F.levenshtein("a", "b") <= F.floor(shorter * edits / least))
        return saved(near.filter(allowed).select("id").distinct(), name)

    # all members of a key meet its first line; only those that this leaves undecided meet the others before them
    firsts = texts.select(*own("first"))
    stars = members.filter("id <> first").select("id", "first", "b0", "b1").distinct().join(firsts, "first").filter(bags_fit("b", "first", edits))
    stars = confirmed(stars.select("id", F.col("first").alias("earlier")), "line-near-first")
    open_lines = members.filter("id <> first").join(stars, "id", "left_anti").select("key", "first", *own("later"))
    met_again = open_lines.join(members.select("key", *own("earlier")), "key").filter(F.expr("earlier < later AND earlier <> first") & bags_fit("later", "earlier", edits))
    rest = met_again.select(F.col("later").alias("id"), "earlier").distinct()
    near = stars.unionAll(confirmed(rest, "line-near-rest")).distinct().withColumn("near", F.lit(True))
    out = lines.select("id", "hash", "n", "first_doc").join(near, "id", "left").filter("near OR n > 1").select("hash", F.coalesce("near", F.lit(False)).alias("near"), "first_doc")
    out = saved(out, "line-verdicts")
    discard(lines, shared, met, members, involved, texts)
    release(spark)
    return out


def clean(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` without repeated and nearly repeated lines, with row, n_lines, n_repeated and n_near added.

    Of lines with ``least`` or more code points, a line that is within ``edits`` edits
    of an earlier one (see judge_lines) goes; of equal lines the first one in the
    document of smallest doc_id stays. Rows that share that doc_id are taken for one
    document and keep theirs each; null doc_ids come last. Shorter lines stay; with
    ``short`` they are judged as well (see judge_lines), and only lines without a word
    stay whatever their length. Texts without such repeats are unchanged. Null texts stay null with no lines; an
    empty text has one line; an empty table gives no rows. Columns of ``docs`` that
    have one of the added names are replaced; others stay, whatever their names.
    """
    # a null doc_id is after all others
    added = {"row", "n_lines", "n_repeated", "n_near"}
    rows, mark = numbered(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]), "line-rows")
    keyed = rows.select(F.col(mark).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), "text")
    verdicts = judge_lines(keyed, edits, least, short)
    hashed = instances(keyed, least, short).select("row", "doc_id", "pos", line_hash(F.col("line")).alias("hash"))
    found = passing(hashed, "hash", saved(key_filter(verdicts, "hash"), "line-verdict-filter")).join(verdicts, "hash")
    # the copies of one line in one row, in order
    per_line = found.groupBy("row", "hash", "near", (F.col("doc_id") == F.col("first_doc")).alias("own")).agg(F.sort_array(F.collect_list("pos")).alias("at"))
    gone = per_line.select("row", "near", F.when(F.col("near") | ~F.col("own"), F.col("at")).otherwise(F.slice("at", 2, F.size("at"))).alias("at"))
    drops = gone.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("drops"), F.sum(F.when(F.col("near"), F.size("at")).otherwise(0)).alias("n_near"))
    drops = saved(drops.filter("size(drops) > 0"), "line-drops")
    release(docs.sparkSession)
    lines = F.split("text", "\n")
    # which lines go and how many of them are near ones, under a name that no column of docs has
    gone = unused(rows, "figmill_gone")
    at = F.map_from_entries(F.transform(F.array_sort("drops"), lambda p: F.struct(p, F.lit(True))))
    dropped = drops.select(F.col("row").alias(mark), F.struct(at.alias("at"), F.size("drops").cast("long").alias("n"), F.col("n_near").alias("near")).alias(gone))
    # no side has a size bound, so both are dealt by row at every size
    out = rows.join(dropped.hint("merge"), mark, "left")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.element_at(F.col(gone)["at"], i), F.lit(False))), "\n")
    near = F.coalesce(F.col(gone)["near"], F.lit(0)).cast("long")
    counts = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.col(gone)["n"], F.lit(0).cast("long")) - near).alias("n_repeated"), near.alias("n_near")]
    kept = [F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns if c != mark]
    return out.select(*kept, F.col(mark).alias("row"), *counts)


def digest(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: bool = False) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_lines, n_repeated, n_near, text_crc32 of what stays."""
    return clean(docs.select("doc_id", "text"), edits, least, short).select("doc_id", "n_lines", "n_repeated", "n_near", text_crc32(F.col("text")).alias("text_crc32"))
