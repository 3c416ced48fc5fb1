"""Secret scans: three fixed kinds of matches, and random strings found by a battery of tests. DataFrame functions only.

The battery takes all maximal runs of ``[A-Za-z0-9+/_=-]`` of at least 20 characters that hold a digit and a letter,
whether or not they lie in a fixed match; what it finds is added as spans of the kind ``random``. The alphabet is inferred: ``hex`` (one case), ``base32`` (upper case and digits), ``alnum`` or
``base64``. If a string is random over its alphabet, three statistics are about standard normal: the chi-squared of its
symbol counts against uniform (Wilson-Hilferty), the number of runs of symbols of the upper and lower half of the
alphabet (Wald-Wolfowitz), and the lag-1 serial correlation of symbol values. Their sum of squares gives a p-value.

Random strings have uniform p-values and words have p-values near 0. So per alphabet and class of length, twice the
candidates with p above 1/2 (one at least) estimate the random ones, and what exceeds them above a threshold is falsely found. The
threshold is the smallest of which the share of false ones stays within ``fdr``; a class in which there is none has no
find. Short classes, in which words look random more often, so get stricter thresholds. Classes of few candidates are
judged by those of their alphabet, or of all.

Defined results: null text is empty and has no spans; offsets are code points, end exclusive; very long texts are scanned
whole, in time about linear in their matches; null ids and repeated rows are scanned each on its own; other columns are not
looked at, whatever their names, unless they are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import erfc
from lumenfold.plans.tables import cut

#: The patterns of the fixed kinds. (kind, pattern, group whose length counts, least length)
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The alphabets in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
BINS = 64
#: Candidates that a class needs for a threshold of its own; numbers of a block of sums; characters that are masked at a time.
FEW, BLOCK, PIECE = 32, 64, 4096


def sums_before(numbers: Column, levels: int = 3) -> Column:
    """For each number of an array the sum of those before it.

    Blocks of ``BLOCK`` numbers are summed one by one, their totals in the same way; so the work stays about linear.
    """
    if levels == 1:
        run = F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(run, 1, F.size(numbers))
    last = F.floor(F.greatest(F.size(numbers) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda t, x: t + x))
        return F.flatten(F.zip_with(parts, sums_before(totals, levels - 1), lambda p, start: F.transform(sums_before(p, 1), lambda x: x + start)))

    return F.transform(F.array(blocks), joined)[0]  # blocks are made once


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, kind, text) of a pattern's leftmost non-overlapping matches.

    Gaps between matches and matches alternate, so sums of their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    rows = F.zip_with(F.zip_with(found, counted, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))), gaps, lambda m, gap: F.struct(m["m"].alias("m"), m["g"].alias("g"), F.length(gap).alias("gap")))

    def placed(r: Column) -> Column:
        ends = sums_before(F.transform(r, lambda x: x["gap"] + F.length(x["m"])))
        spans = F.zip_with(r, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"), x["g"].alias("g")))
        return F.transform(F.filter(spans, lambda x: x["g"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text")))

    none = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    return F.when(text.rlike(pattern), F.transform(F.array(rows), placed)[0]).otherwise(none)


def _battery(df: DataFrame) -> DataFrame:
    """Adds ``code`` (alphabet), ``p`` and the three statistics to rows with ``token``."""
    token, n = F.col("token"), F.col("n")
    body = F.regexp_replace("token", "=+$", "")
    code = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z0-9]+$"), "base32").when(token.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    )
    df = df.withColumn("code", code).withColumn("token", F.when(F.col("code") == "hex", F.lower(token)).otherwise(body)).withColumn("n", F.length("token").cast("double"))
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])[F.col("code")]
    df = df.withColumn("alphabet", alphabet).withColumn("a", F.length("alphabet").cast("double"))
    squares = F.aggregate(
        F.split("alphabet", ""), F.lit(0.0), lambda acc, c: acc + F.pow((F.length("token") - F.length(F.replace(F.col("token"), c, F.lit("")))).cast("double"), F.lit(2.0))
    )
    values = F.transform(F.split("token", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1)
    df = df.withColumn("chi2", squares * F.col("a") / n - n).withColumn("v", values)
    df = df.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n)
    last = F.slice("v", 2, F.size("v"))
    pairs = F.slice(F.arrays_zip(F.col("v").alias("x"), last.alias("y")), 1, F.greatest(F.size("v") - 1, F.lit(0)))
    half = (F.col("a") - 1) / 2
    df = df.withColumns(
        {
            "high": F.aggregate("v", F.lit(0.0), lambda s, x: s + F.when(x > half, 1.0).otherwise(0.0)),
            "runs": F.aggregate(pairs, F.lit(1.0), lambda s, xy: s + F.when((xy["x"] > half) != (xy["y"] > half), 1.0).otherwise(0.0)),
            "cov": F.aggregate(pairs, F.lit(0.0), lambda s, xy: s + (xy["x"] - F.col("mean")) * (xy["y"] - F.col("mean"))),
            "var": F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean"), F.lit(2.0))),
        }
    )
    dof, low = F.col("a") - 1, n - F.col("high")
    z_chi = (F.cbrt(F.col("chi2") / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    both = 2 * F.col("high") * low
    expected, spread = both / n + 1, both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(spread > 0, (F.col("runs") - expected) / F.sqrt(spread)).otherwise(9.0)
    z_corr = F.when(F.col("var") > 0, (F.col("cov") / F.col("var") + 1 / n) * F.sqrt(n)).otherwise(9.0)
    df = df.withColumns({"z_chi": F.greatest(z_chi, F.lit(0.0)), "z_runs": z_runs, "z_corr": z_corr})
    t = F.pow("z_chi", F.lit(2.0)) + F.pow("z_runs", F.lit(2.0)) + F.pow("z_corr", F.lit(2.0))
    df = df.withColumn("_t", F.least(t, F.lit(200.0)))
    p = erfc(F.sqrt(F.col("_t") / 2)) + F.sqrt(2 * F.col("_t") / 3.141592653589793) * F.exp(-F.col("_t") / 2)
    return df.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def _thresholds(tested: DataFrame, fdr: float) -> DataFrame:
    """``code, class, least``: at most (alphabets x classes x bins) rows are counted, however many candidates there are.

    A class of fewer than ``FEW`` candidates takes the counts of its whole alphabet; if these are too few, those of all.
    """
    counts = tested.groupBy("code", "class", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    counts = cut(counts, "p-values", rows=1)

    def pooled(name: str, *by: str) -> DataFrame:
        bins = counts.groupBy(*by, "bin").agg(F.sum("count").alias("count"))
        return bins.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias(name), F.sum("count").alias(f"{name}_n"))

    per = pooled("h", "code", "class").join(pooled("hc", "code"), "code").crossJoin(pooled("ha"))  # at most as many rows as classes, by one
    per = per.withColumn("h", F.when(F.col("h_n") >= FEW, F.col("h")).when(F.col("hc_n") >= FEW, F.col("hc")).otherwise(F.col("ha")))
    at = lambda b: F.coalesce(F.col("h")[b], F.lit(0))
    upper = F.aggregate(F.sequence(F.lit(BINS // 2), F.lit(BINS - 1)), F.lit(0).cast("bigint"), lambda s, b: s + at(b))
    per = per.withColumn("random", F.greatest(2.0 * upper, F.lit(1.0)))
    above = lambda b: F.aggregate(F.sequence(b, F.lit(BINS - 1)), F.lit(0).cast("bigint"), lambda s, x: s + at(x))
    good = F.filter(F.sequence(F.lit(1), F.lit(BINS // 2)), lambda b: (above(b) > 0) & (above(b) - F.col("random") * (1 - b / BINS) <= fdr * above(b)))
    return per.select("code", "class", (F.array_min(good) / BINS).alias("least")).filter("least IS NOT NULL")


def tested(tokens: DataFrame) -> DataFrame:
    """``token, code, class, p`` of distinct candidates; classes of length are powers of the square root of 2."""
    rows = _battery(tokens.withColumn("raw", F.col("token")).withColumn("n", F.length("token").cast("double")))
    return rows.select(F.col("raw").alias("token"), "code", "p", F.floor(2 * F.log2("n")).cast("int").alias("class"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fdr: float = 0.05, keep: list[str] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep``, and ``spans``: all finds as (start, end, kind, text) in the order of start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k[0], i)])
    kept = [f"keep_{c}" for c in keep]
    base = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"keep_{c}") for c in keep], body.alias("text"))
    fixed = F.concat(*[matches(F.col("text"), pattern, kind, group, least) for kind, pattern, group, least in KINDS])
    runs = F.filter(matches(F.col("text"), CANDIDATE, "random"), lambda r: r["text"].rlike("[0-9]") & r["text"].rlike("[A-Za-z]"))
    # the number of a written row names it from here on
    found = cut(base.select("doc_id", *kept, fixed.alias("fixed"), runs.alias("runs"), F.monotonically_increasing_id().alias("row")), "secrets")
    odd = found.filter(F.size("runs") > 0)
    battery = cut(tested(odd.select(F.explode("runs.text").alias("token")).distinct()), "battery")
    # thresholds are as many as classes: four alphabets times two for each doubling of length
    secret = battery.join(F.broadcast(_thresholds(battery, fdr)), ["code", "class"]).filter("p >= least").select("token")
    # only rows with candidates meet the finds; the others have nothing to look up
    hits = odd.select("row", F.explode("runs").alias("r")).join(secret.withColumnRenamed("token", "secret"), F.col("r.text") == F.col("secret"), "left_semi")
    hits = hits.groupBy("row").agg(F.collect_list("r").alias("extra"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,text:string>>)")
    with_extra = odd.join(hits, "row", "left").select("doc_id", *kept, F.concat("fixed", F.coalesce("extra", none)).alias("both"))
    both = found.filter(F.size("runs") == 0).select("doc_id", *kept, F.col("fixed").alias("both")).unionByName(with_extra)
    rank = lambda s: F.coalesce(order[s["kind"]], F.lit(len(KINDS)))
    sortable = F.transform("both", lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    spans = F.transform(F.array_sort(sortable), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return both.select("doc_id", *[F.col(f"keep_{c}").alias(c) for c in keep], spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (in the order of starts) replaced by ``mark``; overlapping spans give one mark.

    A text is taken in pieces of ``PIECE`` characters, each with the spans that touch it, so no step looks at all of it.
    """

    def cleaned(piece: Column, i: Column) -> Column:
        low, high = i * PIECE, (i + 1) * PIECE
        zero = F.struct(low.alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, acc["at"] - low + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            new = F.concat(acc["out"], gap, F.when(s["start"] >= F.greatest(acc["at"], low), F.lit(mark)).otherwise(F.lit("")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

        touching = F.filter(spans, lambda s: (s["start"] < high) & (s["end"] > low))
        done = F.aggregate(touching, zero, step)
        return F.when(F.size(touching) == 0, piece).otherwise(F.concat(done["out"], F.substring(piece, done["at"] - low + 1, PIECE)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(pieces, cleaned), ""))
