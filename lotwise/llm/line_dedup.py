"""Line de-duplication: exact lines by digest, near lines by a segment-partition edit join.

A line of ``threshold + 1`` segments keeps one of them whole through any ``threshold`` edits. Segments
of every line are indexed with its length; every line looks up the substrings of its own that could be
that segment, at the few places where it can have moved to. What meets is verified by a banded
bit-parallel edit distance. All of it are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

from .decontamination import _bound

#: Rows up to which ids of lines are sent to every executor (about 24 bytes each); more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Lines under one segment of one length up to which ids meet in pairs.
SMALL_GROUP = 24
#: Lines of a larger group that are compared in one task.
LINES_PER_SALT = 2_000


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings that differ by at most ``threshold`` in length; above it, any larger number.

    Bit-parallel over the diagonals of the band (Hyyrö 2003): bit t of a column stands for the row
    t - threshold below the column's own, so a band of 2 * threshold + 1 diagonals is one long. The
    distance is followed down the lowest diagonal and then along the last row. Columns after the point
    where it can't come back to the threshold are passed over.
    """
    if not 0 < threshold <= 15:
        raise ValueError("threshold must be 1 to 15")
    width = 2 * threshold + 1
    ones, high = (1 << width) - 1, 1 << (width - 1)
    bit = lambda x: F.lit(x).cast("bigint")
    inverse = lambda x: x.bitwiseXOR(bit(ones))

    def over(chars: Column) -> Column:
        pattern, text = chars["a"], chars["b"]
        m, n = F.size(pattern), F.size(text)

        def column(state: Column, j: Column) -> Column:  # j from 1
            here = F.get(text, j - 1)
            match = bit(0)
            for t in range(width):
                match = match.bitwiseOR(F.when(F.get(pattern, j - threshold + t - 1) == here, bit(1 << t)).otherwise(bit(0)))

            def deltas(s: Column) -> Column:
                pv, nv, pm = s["pv"], s["nv"], s["pm"]
                return F.struct(pv.alias("pv"), nv.alias("nv"), ((pm.bitwiseAND(pv) + pv).bitwiseXOR(pv)).bitwiseOR(pm).bitwiseOR(nv).bitwiseAND(bit(ones)).alias("d0"))

            def moved(s: Column) -> Column:
                ph = s["nv"].bitwiseOR(inverse(s["d0"].bitwiseOR(s["pv"])))
                nh = s["d0"].bitwiseAND(s["pv"])
                return F.struct(s["d0"].alias("d0"), ph.alias("ph"), nh.alias("nh"), F.shiftright(s["d0"], 1).alias("down"))

            def stepped(s: Column) -> Column:
                last_row = F.call_function("shiftleft", bit(1), F.least(F.greatest(m - j + threshold, F.lit(0)), F.lit(62)))
                down = F.when(s["d0"].bitwiseAND(bit(high)) == 0, 1).otherwise(0)
                along = F.when(s["ph"].bitwiseAND(last_row) != 0, 1).when(s["nh"].bitwiseAND(last_row) != 0, -1).otherwise(0)
                pv = s["nh"].bitwiseOR(inverse(s["down"].bitwiseOR(s["ph"])))
                return F.struct(pv.alias("pv"), s["down"].bitwiseAND(s["ph"]).alias("nv"), (state["far"] + F.when(j + threshold <= m, down).otherwise(along)).cast("int").alias("far"))

            one = _bound(F.struct(state["pv"].alias("pv"), state["nv"].alias("nv"), match.alias("pm")), deltas)
            new = _bound(_bound(one, moved), stepped)
            # Down the diagonal the distance never falls; along the last row it may, by one for each column left.
            lost = state["far"] > 2 * threshold + (n - m)
            return F.when(lost, state).otherwise(new)

        start = F.struct(bit(ones ^ ((1 << threshold) - 1)).alias("pv"), bit(0).alias("nv"), F.lit(threshold).alias("far"))
        run = F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["far"])
        # A pattern shorter than the band has no diagonal to go down; its distance is small to work out by the built-in.
        return F.when((m < threshold + 1) | (n < 1), F.levenshtein(a, b)).when(F.abs(m - n) > threshold, F.lit(3 * threshold + 1)).otherwise(run)

    return _bound(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), over)


def _looked_up(threshold: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, move): where a line looks for the segments of lines shorter by 0 to ``threshold``.

    Segment i (from 0) can have moved by at most i places, counted from the left, and by the edits that
    are left for what follows, counted from the right.
    """
    return [
        (shorter, i, move)
        for shorter in range(threshold + 1)
        for i in range(threshold + 1)
        for move in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1)
    ]


def _with_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """(row, line_no, key, own) for every segment that a line looks up; ``own`` is 1 for its own segments, the index.

    A line of n is cut into ``threshold + 1`` segments of equal length, the last ones longer by one. One
    place is worked out at a time, so the generated code stays small enough to be compiled.
    """
    count = threshold + 1
    places = F.array(*(F.struct(F.lit(s).alias("shorter"), F.lit(i).alias("i"), F.lit(m).alias("move")) for s, i, m in _looked_up(threshold)))
    at = lines.select("row", "line_no", "line", F.char_length("line").alias("size"), F.explode(places).alias("p")).select("row", "line_no", "line", "size", "p.*")
    at = at.withColumn("other", F.greatest(F.col("size") - F.col("shorter"), F.lit(0)))
    at = at.withColumn("base", F.floor(F.col("other") / count).cast("int")).withColumn("longer", F.col("other") % count)
    extra = F.greatest(F.col("longer") - (count - F.col("i")), F.lit(0))  # longer segments before this one
    at = at.withColumn("start", F.lit(1) + F.col("base") * F.col("i") + extra + F.col("move")).withColumn("width", F.col("base") + F.when(count - F.col("i") <= F.col("longer"), 1).otherwise(0))
    inside = (F.col("start") >= 1) & (F.col("start") + F.col("width") - 1 <= F.col("size")) & (F.col("width") >= 1)
    key = F.xxhash64("other", "i", F.substring(F.col("line"), F.col("start"), F.col("width")))
    own = ((F.col("shorter") == 0) & (F.col("move") == 0)).cast("int")
    return at.where(inside).select("row", "line_no", key.alias("key"), own.alias("own"))


def _letters(text: Column) -> Column:
    """Counts of some letters: an edit changes their sum of differences by at most two."""
    return F.array(*((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).cast("int") for c in "aeionrst"))


def _letters_apart(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for i in range(8):
        out = out + F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i)))
    return out


def _within(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose (row, line_no) is in ``ids``."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return lines.join(F.broadcast(ids) if few else ids, ["row", "line_no"], "left_semi")


def near_later(lines: DataFrame, threshold: int = 2, min_chars: int = 20) -> DataFrame:
    """(row, line_no) of the lines within ``threshold`` edits of a line that is ordered before them.

    ``lines`` is a written table of row, line_no, order (a comparable struct) and line. Lines of fewer
    than ``min_chars`` code points take no part. Few lines under one segment meet as pairs of ids, and
    texts are fetched for what met. A segment that many lines of a length share is never written out as
    pairs: its lines travel in blocks with their texts, and a line leaves the join once, at the first
    earlier one that is near.
    """
    # One shuffle of the keys serves both sides of the join.
    keys = _with_keys(lines.where(F.char_length("line") >= min_chars), threshold)
    group = Window.partitionBy("key").orderBy(F.desc("own"), "row", "line_no")
    all_rows = Window.partitionBy("key").orderBy(F.desc("own"), "row", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    index = keys.withColumn("n", F.sum("own").over(all_rows)).withColumn("nth", F.row_number().over(group)).where("own = 1 and (n <= %d or nth = 1)" % SMALL_GROUP)
    index = index.select(F.col("row").alias("i_row"), F.col("line_no").alias("i_line"), F.col("key").alias("i_key"), "n")
    # Of a large group only the first line of the index is met, so that each of its lines comes once.
    order = F.struct("row", "line_no") > F.struct(F.col("i_row").alias("row"), F.col("i_line").alias("line_no"))
    differ = (F.col("row") != F.col("i_row")) | (F.col("line_no") != F.col("i_line"))
    found = keys.join(index, (F.col("key") == F.col("i_key")) & ((F.col("n") > SMALL_GROUP) | (differ & ((F.col("own") == 0) | order))))
    met = found.select("row", "line_no", "i_row", "i_line", F.when(F.col("n") > SMALL_GROUP, F.col("key")).alias("key"), F.col("own"), "n")
    met = cut_lineage(met, "met-lines")

    small = met.where("key is null").select("row", "line_no", "i_row", "i_line").distinct()
    large = met.where("key is not null").select("key", "n", "row", "line_no", "own")
    ids = met.select("row", "line_no").union(small.select("i_row", "i_line")).distinct()
    texts = _within(lines, ids).withColumn("letters", _letters(F.col("line")))
    texts = cut_lineage(texts, "met-texts")
    other = texts.select(*(F.col(c).alias(f"i_{c}") for c in ("row", "line_no", "order", "line", "letters")))
    maybe = (_letters_apart(F.col("letters"), F.col("i_letters")) <= 2 * threshold) & (F.levenshtein("i_line", "line", threshold) >= 0)
    # Letters and the built-in distance, which gives up early, thin what meets; the bit-parallel distance decides.
    near = maybe & (banded_distance(F.col("i_line"), F.col("line"), threshold) <= threshold)
    pairs = small.withColumnRenamed("i_line", "i_line_no").join(texts, ["row", "line_no"]).join(other, ["i_row", "i_line_no"]).where((F.col("order") != F.col("i_order")) & near)
    later = pairs.select(F.when(F.col("i_order") < F.col("order"), F.struct("row", "line_no")).otherwise(F.struct(F.col("i_row").alias("row"), F.col("i_line_no").alias("line_no"))).alias("l")).select("l.*")
    if large.limit(1).count():
        blocks = F.ceil(F.col("n") / LINES_PER_SALT).cast("int")
        i_side = large.where("own = 1").withColumn("salt", F.pmod(F.xxhash64("row", "line_no"), blocks).cast("int")).select(F.col("key").alias("i_key"), F.col("salt").alias("i_salt"), F.col("row").alias("i_row"), F.col("line_no").alias("i_line_no"))
        p_side = large.withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", "salt", "row", "line_no")
        p_side, i_side = p_side.join(texts, ["row", "line_no"]), i_side.join(other, ["i_row", "i_line_no"])
        close = (F.col("key") == F.col("i_key")) & (F.col("salt") == F.col("i_salt")) & near
        late_p = p_side.join(i_side, close & (F.col("i_order") < F.col("order")), "left_semi").select("row", "line_no")
        late_i = i_side.join(p_side, close & (F.col("order") < F.col("i_order")), "left_semi").select("i_row", "i_line_no")
        later = later.union(late_p).union(late_i)
    return later.distinct()


def dedup_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 20) -> DataFrame:
    """Documents with repeated lines taken out; adds n_lines, n_repeated and n_near (bigint).

    A line is a run of characters between newlines. Of equal lines, in all documents, the first stays:
    that of the least doc_id (null first), then the least hash of the text, then the topmost. A line of
    ``min_chars`` code points or more also goes if it lies within ``threshold`` edits of a different line
    whose first place is earlier. Empty lines always stay, so a document without repeats is unchanged;
    one that is all repeats becomes a text of its empty lines. Rows that repeat both doc_id and text are
    one document and all get its result. Null texts stay null; an empty table gives no rows; all columns
    stay, and reserved names start with two underscores.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    at_lines = docs.select("doc_id", key.alias("__hash"), F.posexplode_outer(F.split("text", "\n")).alias("__line_no", "line")).where("line <> ''")
    # Lines are told apart by 128 bits, so texts aren't shuffled to find equal ones.
    found = at_lines.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.struct("doc_id", "__hash", "__line_no").alias("at"))
    first = found.groupBy("a", "b").agg(F.min("at").alias("at")).select("at.*")
    firsts = first.groupBy(F.col("doc_id").alias("__doc"), F.col("__hash").alias("__of")).agg(F.sort_array(F.collect_list("__line_no")).alias("__first"))
    numbered = docs.withColumn("__hash", key)
    joined = numbered.join(firsts, numbered["doc_id"].eqNullSafe(firsts["__doc"]) & (numbered["__hash"] == firsts["__of"]), "left").drop("__doc", "__of")
    whole = cut_lineage(joined.withColumn("__row", F.monotonically_increasing_id()), "documents")

    split = F.split("text", "\n")
    own = _bound(split, lambda lines: F.transform("__first", lambda i: F.struct(i.alias("line_no"), F.get(lines, i).alias("line"))))
    opened = whole.select(F.col("__row").alias("row"), F.struct("doc_id", "__hash").alias("of"), F.explode_outer(own).alias("l")).where("l is not null")
    lines = opened.select("row", "l.line_no", F.struct("of.doc_id", "of.__hash", "l.line_no").alias("order"), "l.line")
    later = near_later(lines, threshold, min_chars)
    near = cut_lineage(later.groupBy(F.col("row").alias("__near_row")).agg(F.collect_list("line_no").alias("__near")), "near-lines")
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS // 4
    marked = whole.join(F.broadcast(near) if few else near, F.col("__row") == F.col("__near_row"), "left")

    none = F.array().cast("array<int>")

    def rebuilt(lines: Column) -> Column:
        empty = F.filter(F.transform(lines, lambda line, i: F.when(line == "", i)), lambda i: i.isNotNull())
        kept = F.array_sort(F.concat(empty, F.array_except(F.coalesce("__first", none), F.coalesce("__near", none))))
        return F.struct(F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i))).alias("text"), (F.size(lines) - F.size(empty)).cast("bigint").alias("n_lines"))

    n_near = F.size(F.coalesce("__near", none)).cast("bigint")
    done = marked.withColumn("__new", F.when(F.col("text").isNotNull(), _bound(split, rebuilt)))
    n_lines = F.coalesce(F.col("__new")["n_lines"], F.lit(0).cast("bigint"))
    out = done.withColumn("text", F.col("__new")["text"]).withColumn("n_lines", n_lines).withColumn("n_repeated", n_lines - F.size(F.coalesce("__first", none))).withColumn("n_near", n_near)
    return out.drop("__hash", "__first", "__row", "__near_row", "__near", "__new")
