"""Document fingerprints by winnowing. DataFrame functions only.

Every ``K`` code points in a row are hashed; of every ``W`` hashes in a row the least is chosen, the rightmost of equals;
what is chosen, each place once, is the fingerprint. Two texts that share ``K + W - 1`` code points in a row share a
chosen hash. Texts of fewer than ``K`` code points are one gram; an empty text has no fingerprint.

The minimum of a window comes by doubling: minima of 2, 4, 8 ... places, each from the array before and itself moved. A
hash and its place are one number, ``hash * 2^32 + (2^32 - 1 - place)``, so the least is the rightmost of equal hashes.
A text goes through in segments of ``SEGMENT`` windows, so that a very long one needs no more memory than its text and
its fingerprint.

The edited text of :func:`edited` is a document's first half and the start of another. Windows within either part have been
minimised before; only those at the seam and at the end are taken from the edited text itself.

Defined results: null text is empty; two empty fingerprints are alike by 1, an empty and another by 0; repeated rows have
each their row, and follow each other in the order of their texts' hashes; null ids come after all others; very long texts are
read whole; other columns are not looked at, whatever their names; an empty table gives an empty table. Rows of one id are
split over tasks by their texts' hashes; only rows with one id and one text share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut, small

K, W, SEGMENT = 8, 16, 4096
#: Parts that rows are dealt out to at most, whatever their number.
SEGMENTS = 1 << 17
LOW = 4294967295


def chosen(text: str) -> Column:
    """Array of ``hash * 2^32 + (2^32 - 1 - place)`` of the column ``text``, in the order of places (from 1)."""
    wide = SEGMENT + W + K - 2
    n = f"char_length({text})"
    last = f"greatest(0, floor(({n} - {K + W - 1}) / {SEGMENT}))"
    grams = f"regexp_extract_all(substring({text}, cast(j * {SEGMENT} + 1 as int), {wide}), '(?s)(?=(.{{{K}}}))', 1)"
    m = f"transform({grams}, (x, i) -> (xxhash64(x) & -4294967296) | ({LOW} - (i + 1 + j * {SEGMENT})))"
    size = 1
    while size < W:
        m = f"transform(array({m}), v -> zip_with(v, slice(v, {size + 1}, size(v)), (p, q) -> least(p, q)))[0]"
        size *= 2
    picked = f"transform(array({m}), v -> array_distinct(slice(v, 1, greatest(1, size(v) - {W - 1}))))[0]"
    whole = f"array_distinct(flatten(transform(sequence(0, cast({last} as int)), j -> {picked})))"
    short = f"array((xxhash64({text}) & -4294967296) | ({LOW} - 1))"
    return F.expr(f"case when {n} = 0 then cast(array() as array<bigint>) when {n} < {K} then {short} else {whole} end")


def hashes(picked: str) -> Column:
    """The chosen hashes as ints, in the order of places."""
    return F.expr(f"transform({picked}, x -> cast(shiftright(x, 32) as int))")


def places(picked: str) -> Column:
    """The chosen places, from 1."""
    return F.expr(f"transform({picked}, x -> {LOW}L - (x & {LOW}L))")


def printed(ints: str) -> Column:
    """Hashes in hex, by spaces."""
    return F.expr(f"array_join(transform({ints}, x -> lower(hex(x & {LOW}L))), ' ')")


def alike(a: str, b: str) -> Column:
    """Shared hashes over all hashes."""
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0D else size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) as double) end")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``doc_id, text, picked``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    return rows.select("doc_id", "text", chosen("text").alias("picked"), *keep)


def _segments(ids: DataFrame, tie_rows: int) -> DataFrame:
    """One row of arrays that say where a row goes: ``bounds`` of ids, and of each bucket between them ``first`` and ``pieces``.

    Bounds are quantiles of the ids; an id that is several of them has a bucket of its own, as null ids do. A bucket of one
    id and more than ``tie_rows`` rows is cut into pieces of equal ranges of the texts' hashes. All is bounded by ``SEGMENTS``,
    whatever the number of rows; beyond SEGMENTS * tie_rows rows, segments grow.
    """
    spark, total = ids.sparkSession, ids.count()
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(SEGMENTS, max(session, -(-total // tie_rows)))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = (ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * buckets))).first()[0] if shares else []) or []
    bounds = sorted({int(x) for x in bounds} | {int(x) - 1 for x, y in zip(bounds, bounds[1:], strict=False) if x == y})
    one = spark.createDataFrame([(bounds,)], "bounds array<long>")
    counts = ids.crossJoin(F.broadcast(one)).groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("one_id"))
    counts = {r["bucket"]: r for r in counts.collect()}  # at most 2 * SEGMENTS rows
    room = max(tie_rows, -(-total // SEGMENTS))
    pieces = [max(1, -(-counts[k]["n"] // room) if k in counts and counts[k]["one_id"] else 1) for k in range(len(bounds) + 2)]
    first, at = [0] * len(pieces), 0
    for k in reversed(range(len(pieces))):  # large ids come first, null ids, of bucket 0, last
        first[k], at = at, at + pieces[k]
    return spark.createDataFrame([(bounds, first, pieces, at)], "bounds array<long>, first array<int>, pieces array<int>, segments int")


def _bucket() -> Column:
    """0 for null ids, else one more than the number of ``bounds`` below ``doc_id``, by halving."""
    steps = "aggregate(sequence(20, 0, -1), 0, (k, i) -> if(k + shiftleft(1, i) <= size(bounds) and bounds[least(k + shiftleft(1, i), size(bounds)) - 1] < doc_id, k + shiftleft(1, i), k))"
    return F.expr(f"case when doc_id is null then 0 when size(bounds) = 0 then 1 else {steps} + 1 end")


def neighbours(docs: DataFrame, *, tie_rows: int = 4000) -> DataFrame:
    """``doc_id, text, picked, next_text, next_picked``: the next row is that of the next smaller id, after the last the first.

    Rows are dealt out by ranges of ids, whose bounds come from all ids; rows of one id by ranges of their texts' hashes. The
    first row of every segment is repeated, as a mark, at the end of the segment before it, so no window spans more than a
    segment.
    """
    where = _segments(docs.select(F.col("doc_id").cast("long").alias("doc_id")), tie_rows)
    segments = where.first()["segments"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = texts.crossJoin(F.broadcast(where)).withColumn("bucket", _bucket())
    # the ranges of the hash that the pieces of a bucket take
    piece = F.expr("cast(greatest(0, least(pieces[bucket] - 1, floor((cast(tie as double) / 18446744073709551616.0D + 0.5D) * pieces[bucket]))) as int)")
    placed = placed.withColumn("segment", F.expr("first[bucket]") + piece).select("doc_id", "text", "tie", "segment")

    # each segment's first row in the order: the greatest id, nulls last, then the least hash
    tops = placed.groupBy("segment").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-1 - F.col("tie")).alias("tie"))).alias("top"))
    around = Window.orderBy("segment")  # as many rows as there are segments
    last = F.max("segment").over(Window.partitionBy())
    tops = cut(tops.select(F.coalesce(F.lag("segment").over(around), last).alias("to"), F.col("top.doc_id").alias("top"), (-1 - F.col("top.tie")).alias("top_tie")), "segment-tops", rows=segments)
    same = placed["doc_id"].eqNullSafe(tops["top"]) & (placed["tie"] == tops["top_tie"])
    marks = placed.join(small(tops, segments), same).select("doc_id", "text", "tie", F.col("to").alias("segment")).dropDuplicates(["segment"])
    marks = cut(marks, "segment-marks", rows=segments)

    # only texts are dealt out; what is chosen of them comes after, so no hash is written to disk
    order = ["mark", F.col("doc_id").desc_nulls_last(), "tie"]
    rows = placed.withColumn("mark", F.lit(0)).unionByName(marks.withColumn("mark", F.lit(1)))
    rows = rows.repartitionById(segments, "segment").sortWithinPartitions("segment", *order)
    rows = fingerprints(rows, keep=["segment", "mark", "tie"])
    w = Window.partitionBy("segment").orderBy(*order)
    held = rows.withColumn("next", F.lead(F.struct("text", "picked")).over(w)).filter("mark = 0")
    return held.select("doc_id", "text", "picked", F.col("next.text").alias("next_text"), F.col("next.picked").alias("next_picked"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and how alike they are."""
    rows = neighbours(docs).withColumn("n", F.char_length("text"))
    rows = rows.withColumn("a", F.expr("n - n div 2").cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, a), substring(next_text, 1, cast(n - a as int)))"))
    # the last windows that lie within the first part, and within the second
    rows = rows.withColumn("p", F.col("a") - (K + W - 2)).withColumn("e", F.char_length("edited")).withColumn("q", F.col("e") - F.col("a") - (K + W - 2))
    rows = rows.withColumn("s", F.expr(f"greatest(1, p - {W - 2})")).withColumn("t", F.expr(f"a + greatest(1, q - {W - 2})"))
    whole = F.col("e") < 4 * (K + W)
    rows = rows.withColumns(
        {
            "seam": F.when(whole, F.col("edited")).otherwise(F.expr(f"substring(edited, s, a + {W + K - 1} - s)")),
            "tail": F.when(whole | (F.col("q") < 1), F.lit("")).otherwise(F.expr("substring(edited, t, e)")),
            "seam_at": F.when(whole, F.lit(0)).otherwise(F.col("s") - 1),
        }
    )
    # places come first in these numbers, so that sorting them is sorting by place
    flip = lambda col, by: f"transform({col}, x -> shiftleft({LOW}L - (x & {LOW}L) + {by}, 32) | (shiftright(x, 32) & {LOW}L))"
    rows = rows.withColumns({"seam_picked": chosen("seam"), "tail_picked": chosen("tail")})
    own = f"case when e < {4 * (K + W)} then cast(array() as array<bigint>) else filter({flip('picked', '0')}, x -> shiftright(x, 32) <= p) end"
    other = f"case when e < {4 * (K + W)} then cast(array() as array<bigint>) else filter({flip('next_picked', 'a')}, x -> shiftright(x, 32) <= a + q) end"
    both = f"sort_array(array_distinct(concat({own}, {flip('seam_picked', 'seam_at')}, {other}, {flip('tail_picked', '(t - 1)')})))"
    rows = rows.select("doc_id", "n", "edited", "picked", "next_picked", F.expr(both).alias("by_place"))
    rows = rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hashes("picked").alias("fp"),
        F.expr("transform(by_place, x -> cast(shiftright(shiftleft(x, 32), 32) as int))").alias("edited_fp"),
        hashes("next_picked").alias("next_fp"),
        places("picked").alias("fingerprint_places"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed("fp").alias("fingerprint"),
        printed("edited_fp").alias("edited_fingerprint"),
        alike("fp", "edited_fp").alias("near_edited"),
        alike("fp", "next_fp").alias("near_next"),
        "fingerprint_places",
    )
