"""Line deduplication by a segment-partition edit join.

A line is dropped when an equal one stands earlier, in the order of doc_id and line number, whatever
its length; a line of ``min_chars`` or more also when one within ``edits`` edits does. Lines of white
space alone stay. For the edits, lines are cut into edits + 1 segments,
one of which a similar line must hold unchanged, at a place that the lengths and the segment's number
narrow to a few. Segments of each length form the index; the few substrings of other lines probe it.
What meets is sifted by letter counts, which an edit changes little, and verified with a banded bit-parallel edit distance. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.llm.common import look_up, written

MIN_CHARS, EDITS = 20, 2
NO_ID = (1 << 63) - 1
#: Frequent letters, counted to tell apart lines that share a segment.
LETTERS = "eainstrolduh"
#: Buckets of the fixed-size filters that are broadcast: at most so many rows.
BUCKETS = 1 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside an expression, so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within(a: Column, b: Column, k: int) -> Column:
    """Whether two strings of k or more code points are at most k edits apart.

    Of the distance matrix only the 2k + 1 diagonals around the main one are kept, as bits of one
    number a column: where the vertical difference is +1 (vp) and -1 (vn). The score follows the
    lowest diagonal to the last row and then that row to its end.
    """
    mask, top = (1 << 2 * k + 1) - 1, 1 << 2 * k
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    zero = F.lit(0).cast("bigint")

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(mask))

    def distance(p: Column, t: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            c = F.get(t, j)
            equal = zero
            for bit in range(2 * k + 1):
                equal = equal + F.when(F.get(p, j + (bit - k)) == c, F.lit(1 << bit).cast("bigint")).otherwise(zero)

            def column(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)

                def moved(d: Column) -> Column:
                    hp, hn = vn.bitwiseOR(flip(d.bitwiseOR(vp))), d.bitwiseAND(vp)
                    row = F.lit(top).cast("bigint") / 2  # the last row's bit when the diagonal has reached it
                    at = F.size(p) - k
                    bit = F.floor(row / F.pow(F.lit(2), F.greatest(j - at, F.lit(0)))).cast("bigint")
                    down = F.when(d.bitwiseAND(top) == 0, 1).otherwise(0)
                    along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
                    half = F.shiftright(d, 1)
                    return F.struct(
                        hn.bitwiseOR(flip(half.bitwiseOR(hp))).bitwiseAND(mask).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                        (s["score"] + F.when(j < at, down).otherwise(along)).cast("int").alias("score"))

                return _let(d0, moved)

            # beyond k + k on the diagonal the score cannot come back: pass the state through
            return F.when(s["score"] > 3 * k, s).otherwise(_let(equal, column))

        start = F.struct(F.lit(mask - (1 << k) + 1).cast("bigint").alias("vp"), zero.alias("vn"), F.lit(k).alias("score"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, lambda s: s["score"])

    apart = _let(F.split(long, ""), lambda p: _let(F.split(short, ""), lambda t: distance(p, t)))
    return (F.length(long) - F.length(short) <= k) & (apart <= k)


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i of a line of this length; later segments take what is left over."""
    n = edits + 1
    base, extra = F.floor(length / n).cast("int"), (length % n).cast("int")
    return i * base + F.greatest(extra - (n - i), F.lit(0)) + 1, base + F.when(F.lit(i) >= n - extra, 1).otherwise(0)


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start, size))


def index_keys(line: Column, edits: int) -> Column:
    n = F.length(line)
    return F.array(*(_key(line, n, i, *_segment(n, i, edits)) for i in range(edits + 1)))


def probe_keys(line: Column, edits: int, min_chars: int) -> Column:
    """Substrings that could be a segment of an equally long or up to ``edits`` shorter line, equally long ones first."""
    n, out = F.length(line), []
    for gap in range(edits + 1):
        length = n - gap
        for i in range(edits + 1):
            start, size = _segment(length, i, edits)
            for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1):
                out.append(F.when(length >= min_chars, _key(line, length, i, start + shift, size)))
    return F.array(*out)


def same_length_probes(edits: int) -> int:
    """How many of ``probe_keys`` look for equally long lines."""
    return sum(2 * min(i, edits - i) + 1 for i in range(edits + 1))


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 32, five bits a letter in one long."""
    count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c))) for c in LETTERS)
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(n.bitwiseAND(31).cast("bigint"), 5 * i) for i, n in enumerate(count)))


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether letter counts leave it open that lines are within ``edits``: an edit changes at most two counts by one."""
    def apart(i: int) -> Column:
        d = (F.shiftright(a, 5 * i) - F.shiftright(b, 5 * i)).bitwiseAND(31)
        return F.least(d, 32 - d)

    return reduce(lambda x, y: x + y, map(apart, range(len(LETTERS)))) <= 2 * edits


def _id() -> Column:
    """The name of a row: doc_id and a digest of the text, as different texts may share a doc_id or have none."""
    return F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, at, line, h1, h2) of the lines that hold more than white space; h1 and h2 are 128 bits of digest."""
    lines = docs.select(_id().alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _code(at: Column, h1: Column) -> Column:
    """Number and content of a line in one long."""
    return F.shiftleft(at.cast("bigint"), 32).bitwiseOR(h1.bitwiseAND((1 << 32) - 1))


def _bucket(of: Column) -> Column:
    return F.pmod(of, F.lit(BUCKETS)).alias("_bucket")


def duplicates(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """(id, code) of every line to drop."""
    lines = lines_of(docs)
    seen = written(lines.select("h1", "h2", "id", "at"), "lines")
    firsts = seen.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("times"))
    again = written(firsts.where("times > 1").select(F.struct("h1", "h2").alias("digest"), "first", "times"), "repeated-lines")
    exact = look_up(seen.select(F.struct("h1", "h2").alias("digest"), "id", "at"), again, "digest", "times", seen.count()).where(
        F.struct("id", "at") != F.col("first")).select("id", _code(F.col("at"), F.col("digest.h1")).alias("code"))

    # every different line once, where it stands first; most occur once, and a fixed-size filter tells them apart
    repeated = F.broadcast(again.select(_bucket(F.col("digest.h1"))).distinct())  # at most BUCKETS rows
    marked = lines.where(F.length("line") >= min_chars).withColumn("_bucket", _bucket(F.col("h1")))
    place = again.select("digest.*", "first.*")
    columns = ("id", "at", "h1", "line", letter_counts(F.col("line")).alias("letters"))
    distinct = marked.join(repeated, "_bucket", "left_anti").select(*columns).unionByName(
        marked.join(repeated, "_bucket", "left_semi").join(place.hint("merge"), ["h1", "h2", "id", "at"], "left_semi").select(*columns))
    # a number for each line: what is dealt out by key stays three numbers wide
    distinct = written(distinct.withColumn("x", F.monotonically_increasing_id()), "distinct-lines")
    index = distinct.select(F.explode(index_keys(F.col("line"), edits)).alias("key"), "x", F.col("letters").alias("letters_x"))
    probe = distinct.select(F.posexplode(probe_keys(F.col("line"), edits, min_chars)).alias("nth", "key"), F.col("x").alias("y"), F.col("letters").alias("letters_y"))
    # equally long lines probe each other: one of the two meetings is enough, and none with the line itself
    once = (F.col("nth") >= same_length_probes(edits)) | (F.col("x") < F.col("y"))
    met = index.join(probe.where("key is not null").hint("merge"), "key").where(once).where(may_be_near(F.col("letters_x"), F.col("letters_y"), edits))
    pairs = written(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "line-pairs")

    refs = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).distinct()
    some = F.broadcast(refs.select(_bucket(F.xxhash64("x"))).distinct())  # at most BUCKETS rows
    wanted = distinct.withColumn("_bucket", _bucket(F.xxhash64("x"))).join(some, "_bucket", "left_semi").join(refs.hint("merge"), "x", "left_semi")
    wanted = written(wanted.select("x", "line", F.struct("id", "at", "h1").alias("place")), "pair-lines")
    other = wanted.select(F.col("x").alias("y"), F.col("line").alias("line_y"), F.col("place").alias("place_y"))
    near = pairs.join(wanted.hint("merge"), "x").join(other.hint("merge"), "y").where(within(F.col("line"), F.col("line_y"), edits))
    near = near.select(F.greatest("place", "place_y").alias("later")).select("later.id", _code(F.col("later.at"), F.col("later.h1")).alias("code"))
    return exact.unionByName(near).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """All columns of ``docs`` with the shortened text, and n_lines and n_dropped in place of any such.

    Every row stays, with the lines that are left joined again; null texts stay null and have no
    lines, and lines of white space alone stay. A null doc_id counts as the last; different texts
    that share a doc_id or have none follow each other by a digest of the text. Rows that share a doc_id
    and a text are one document and get the same result.
    """
    drops = written(duplicates(docs, min_chars, edits), "line-drops").groupBy("id").agg(F.collect_list("code").alias("_drops")).withColumnRenamed("id", "_id")
    drops = drops.withColumn("_bucket", _bucket(F.xxhash64("_id")))
    own = docs.withColumn("_id", _id()).withColumn("_bucket", _bucket(F.xxhash64("_id")))
    some = F.broadcast(drops.select("_bucket").distinct())  # at most BUCKETS rows
    whole = own.join(some, "_bucket", "left_anti").withColumn("_drops", F.lit(None).cast("array<bigint>"))
    cut = own.join(some, "_bucket", "left_semi").join(drops.drop("_bucket").hint("merge"), "_id", "left")
    lines = F.split("text", "\n")
    codes = F.array_except(F.transform(lines, lambda x, i: _code(i, F.xxhash64(x))), F.col("_drops"))
    left = _let(lines, lambda all_: F.array_join(F.transform(codes, lambda c: F.get(all_, F.shiftright(c, 32).cast("int"))), "\n"))
    out = whole.unionByName(cut).withColumn("_n", F.coalesce(F.size(lines), F.lit(0))).withColumn("_left", F.when(F.col("_drops").isNull(), F.col("_n")).otherwise(F.size(codes)))
    out = out.withColumn("text", F.when(F.col("_drops").isNull(), F.col("text")).otherwise(left))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("_n"))
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), count.cast("bigint").alias("n_lines"), (F.col("_n") - F.col("_left")).cast("bigint").alias("n_dropped"))
