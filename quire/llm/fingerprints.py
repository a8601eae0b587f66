"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a non-empty part of a text between line feeds; a document's set
holds the 64-bit digest of each distinct one.  Every digest goes to one cell of
each of three sub-tables; a cell keeps a count, the XOR of its digests and the
XOR of their check hashes.  The sketches of two versions subtract cell by cell,
and peeling cells of one digest recovers the digests that differ, hence the
Jaccard likeness of the sets.  Where the 33 cells of a fingerprint don't peel, the
digests are dealt to stripes of about 14, and each stripe gets a sketch of 33
cells, then of 66, 132 and so on with new hashes, until it peels.

Everything is DataFrame expressions.  Texts move once, to buckets of neighbouring
ids; all sketches are made and peeled within their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 11
TABLES = 3
ROUNDS = 10
RETRIES = 10
STRIPE_DIGESTS = 14
BUCKET_DOCS = 2000
RANGES = 256
LEAST = -(1 << 63)
CELL = "struct<c:int,x:bigint,k:bigint>"
FOUND = "struct<x:bigint,c:int>"


def paragraphs(text: Column) -> Column:
    """Distinct digests of the non-empty paragraphs."""
    parts = F.filter(F.split(text, "\n"), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _in_cell(x: Column, at: Column, side: Column, salt: Column | None) -> Column:
    """Whether digest x goes to that place (t, p) of that sub-table."""
    h = x if salt is None else F.xxhash64(x, salt)
    return F.pmod(F.call_function("shiftrightunsigned", h, at["t"] * 20), side) == at["p"]


def _cells(side: Column) -> Column:
    """(sub-table, place) of every cell."""
    return F.transform(F.sequence(F.lit(0), side * TABLES - 1), lambda i: F.struct(F.floor(i / side).cast("int").alias("t"), (i % side).alias("p")))


def sketch(digests: Column, side: Column | int = SIDE, salt: Column | None = None) -> Column:
    """The cells of a set of digests: array<struct<c, x, k>>; ``salt`` renews the hashes."""
    side = F.lit(side) if isinstance(side, int) else side

    def cell(at: Column) -> Column:
        own = F.filter(digests, lambda x: _in_cell(x, at, side, salt))
        zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("k"))
        add = lambda a, x: F.struct((a["c"] + 1).alias("c"), a["x"].bitwiseXOR(x).alias("x"), a["k"].bitwiseXOR(F.xxhash64(x)).alias("k"))
        return F.aggregate(own, zero, add)

    return F.transform(_cells(side), cell)


def subtract(a: Column, b: Column) -> Column:
    """Cell-by-cell difference of two sketches of one size."""
    return F.zip_with(a, b, lambda p, q: F.struct((p["c"] - q["c"]).alias("c"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["k"].bitwiseXOR(q["k"]).alias("k")))


def peel(cells: Column, side: Column | int = SIDE, salt: Column | None = None) -> Column:
    """struct<ok, found>: the digests left in a difference, with their side (1 or -1)."""
    side = F.lit(side) if isinstance(side, int) else side
    empty = F.array().cast(f"array<{FOUND}>")
    at = _cells(side)

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda v: (F.abs(v["c"]) == 1) & (v["k"] == F.xxhash64(v["x"])))
        some = F.array_distinct(F.transform(pure, lambda v: F.struct(v["x"].alias("x"), v["c"].alias("c"))))

        def removed(one: Column) -> Column:
            def drop(v: Column, place: Column) -> Column:
                take = lambda a, s: F.when(_in_cell(s["x"], place, side, salt), F.struct((a["c"] - s["c"]).alias("c"), a["x"].bitwiseXOR(s["x"]).alias("x"), a["k"].bitwiseXOR(F.xxhash64(s["x"])).alias("k"))).otherwise(a)
                return F.aggregate(one, v, take)

            return F.struct(F.zip_with(state["cells"], at, drop).alias("cells"), F.concat(state["found"], one).alias("found"))

        # The one-element array binds ``some``, so that it is made once.
        return F.when(F.size(pure) == 0, state).otherwise(F.element_at(F.transform(F.array(some), removed), 1))

    start = F.struct(cells.cast(f"array<{CELL}>").alias("cells"), empty.alias("found"))
    clean = lambda s: F.forall(s["cells"], lambda v: (v["c"] == 0) & (v["x"] == 0) & (v["k"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.struct(clean(s).alias("ok"), s["found"].alias("found")))


def _or_else(tried: Column, more: Column) -> Column:
    """The digests that ``tried`` found, or ``more`` where it failed."""
    return F.element_at(F.transform(F.array(tried), lambda r: F.when(r["ok"], r["found"]).otherwise(more)), 1)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: the one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _larger(a: Column, b: Column) -> Column:
    """The retry: digests in stripes, each with ever larger sketches until its difference peels."""
    count = F.greatest(F.ceil((F.size(a) + F.size(b)) / STRIPE_DIGESTS), F.lit(1))
    dealt = lambda d, side: F.transform(d, lambda x: F.struct(F.pmod(F.xxhash64(x, F.lit(5)), count).alias("s"), F.lit(side).alias("c"), x.alias("x")))
    none = F.struct(F.lit(False).alias("ok"), F.array().cast(f"array<{FOUND}>").alias("found"))
    fault = F.raise_error(F.lit("a stripe of digests does not peel"))

    def solve(own: Column) -> Column:
        part = lambda c: F.transform(F.filter(own, lambda v: v["c"] == c), lambda v: v["x"])

        def retry(two: Column) -> Column:
            def tried(state: Column, k: Column) -> Column:
                side = F.call_function("shiftleft", F.lit(SIDE), k)
                return F.when(state["ok"], state).otherwise(peel(subtract(sketch(two["p"], side, k), sketch(two["q"], side, k)), side, k))

            return F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), none, tried, lambda s: F.when(s["ok"], s["found"]).otherwise(fault.cast(f"array<{FOUND}>")))

        return _once(F.struct(part(1).alias("p"), part(-1).alias("q")), retry)

    def stripes(ordered: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["s"] != F.get(ordered, i - 1)["s"]))
        return _once(first, lambda at: F.flatten(F.transform(at, lambda i, n: solve(F.slice(ordered, i + 1, F.coalesce(F.get(at, n + 1), F.size(ordered)) - i)))))

    every = F.sort_array(F.concat(dealt(a, 1), dealt(b, -1)))
    return F.when(F.size(a) + F.size(b) == 0, F.array().cast(f"array<{FOUND}>")).otherwise(_once(every, stripes))


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Digests in one set only, as array<struct<x, c>> (c 1: in a, -1: in b)."""
    return _or_else(peel(subtract(sketch_a, sketch_b)), _larger(a, b))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Jaccard likeness from the set sizes and what peeling found; 1 for two empty sets."""
    both = (F.size(a) + F.size(b) - F.size(found)) / 2
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def code(cells: Column) -> Column:
    """A sketch as text: count, XOR and check of each cell in hexadecimal, an empty cell as nothing."""
    cell = lambda v: F.when(v["c"] == 0, "").otherwise(F.concat_ws(":", F.hex(v["c"]), F.hex(v["x"]), F.hex(v["k"])))
    return F.lower(F.array_join(F.transform(cells, cell), ";"))


def decoded(text: Column) -> Column:
    """The cells of a fingerprint, for subtract() and peel()."""
    number = lambda parts, i: F.coalesce(F.conv(F.get(parts, F.lit(i)), 16, -10).cast("bigint"), F.lit(0).cast("bigint"))
    cell = lambda parts: F.struct(number(parts, 0).cast("int").alias("c"), number(parts, 1).alias("x"), number(parts, 2).alias("k"))
    return F.transform(F.split(text, ";"), lambda v: _once(F.split(F.nullif(v, F.lit("")), ":"), cell))


def _buckets(ids: DataFrame) -> tuple[Column, int]:
    """A bucket expression for ``id``: about BUCKET_DOCS neighbours, in id order.

    RANGES quantile bounds at most reach the driver; each range is cut evenly.
    """
    probe = [i / RANGES for i in range(1, RANGES)]
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.percentile_approx("id", probe, 1000).alias("q")).first()
    if not row["n"]:
        return F.lit(0).cast("bigint"), 1
    bounds = sorted({row["lo"], *row["q"]})
    cuts = max(1, -(-row["n"] // (BUCKET_DOCS * len(bounds))))
    if row["n"] < BUCKET_DOCS * len(bounds):
        keep = max(1, -(-row["n"] // BUCKET_DOCS))
        bounds = sorted({bounds[i * len(bounds) // keep] for i in range(keep)})
    edges = F.array(*[F.lit(b) for b in bounds])
    nth = F.size(F.filter(edges, lambda e: e <= F.col("id")))
    if cuts == 1:
        return nth.cast("bigint"), cuts
    ends = F.array(*[F.lit(b) for b in [*bounds[1:], row["hi"] + 1]])
    low, high = F.element_at(edges, nth).cast("double"), F.element_at(ends, nth).cast("double")
    inner = F.least(F.floor((F.col("id").cast("double") - low) / (high - low) * cuts), F.lit(cuts - 1))
    return nth.cast("bigint") * cuts + inner, cuts


def with_next(docs: DataFrame) -> DataFrame:
    """id, doc_id, text, next_text: the next document by descending id (after the last: the first).

    Rows with one id are ordered by text.  Texts move once: a copy of the largest
    row of each bucket joins the bucket above it, so each look-back stays within
    its bucket.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.select("id")
    bucket, cuts = _buckets(ids)
    dealt = base.withColumn("bucket", bucket)
    tops = ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("id").alias("id")).withColumn("range", F.floor(F.col("bucket") / cuts))
    # The bucket above: in the same range, else the first of the next one; there are RANGES ranges at most.
    first = tops.groupBy("range").agg(F.min("bucket").alias("first"))
    first = first.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("further"))
    up = F.coalesce(F.lead("bucket").over(Window.partitionBy("range").orderBy("bucket")), F.col("further"))
    above = tops.join(F.broadcast(first), "range").withColumn("above", up).select("id", "above")
    ghosts = base.join(above, "id").groupBy("above").agg(F.max("text").alias("text")).select(F.col("above").alias("bucket"), "text", F.lit(True).alias("ghost"))
    rows = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    before = Window.partitionBy("bucket").orderBy(F.col("ghost").desc(), "id", "text")
    return rows.withColumn("next_text", F.lag("text").over(before)).filter("not ghost").select("doc_id", "text", "next_text")


def compared(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document.

    Columns: doc_id, n_chars, text, edited, fingerprint, edited_fingerprint,
    edits and gaps (the digests that peeling recovers, with their side),
    near_edited, near_next.  A null text is empty.  A single document is its own
    next one.  A null id comes before all others.  Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    rows = rows.withColumns({"a": paragraphs(F.col("text")), "b": paragraphs(F.col("edited")), "n": paragraphs(F.col("next_text"))}).drop("next_text")
    rows = rows.withColumns({f"s{c}": sketch(F.col(c)) for c in "abn"})
    rows = rows.withColumns({"edits": difference(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")), "gaps": difference(F.col("a"), F.col("n"), F.col("sa"), F.col("sn"))})
    return rows.select(
        "doc_id",
        "n_chars",
        "text",
        "edited",
        code(F.col("sa")).alias("fingerprint"),
        code(F.col("sb")).alias("edited_fingerprint"),
        "edits",
        "gaps",
        likeness(F.col("a"), F.col("b"), F.col("edits")).alias("near_edited"),
        likeness(F.col("a"), F.col("n"), F.col("gaps")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents."""
    out = compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
