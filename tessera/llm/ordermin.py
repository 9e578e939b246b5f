"""Document fingerprints by order min-hash, in DataFrame and SQL functions only.

A text's k-mers are pairs of neighbouring tokens (runs of at most eight characters that are
not white space).  Equal k-mers are told apart by their occurrence number, hashed with it, and laid on a
ring.  Each of ``PLACES`` points of the ring, evenly spaced, is one rotation of the order: its
two first k-mers from the point on are its minimal ones.  They are put back in text order and
their tuple is hashed, so a signature place agrees only if the same k-mers come in the same order:
the share of places that agree falls with edit distance, moved passages included.

One sort serves all rotations.  Hash and position share a long (36 and 28 bits), so sorts
are of primitive longs.  Arrays are bound to lambda variables once, never recomputed per element.

Defined results: null texts count as empty; texts without tokens have a signature of zeros, alike to
each other; repeated rows are documents of their own, neighbours in an order by id and text hash;
rows without doc_id come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 64
POSITION = (1 << 28) - 1
HIGH = ~POSITION
#: Rows of one ordering bucket on average, and buckets at most.
BUCKET_ROWS = 2000
BUCKETS = 20_000


def steps(n: int) -> str:
    return "array(" + ",".join(str(1 << b) for b in range(n - 1, -1, -1)) + ")"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def signature_sql(text: str) -> str:
    """SQL for the signature of a text expression: an array of ``PLACES`` 24-bit numbers."""
    kmer = "shiftright(x, 28)"
    ring = "shiftright({}, 58)"
    hashes = f"transform(regexp_extract_all({text}, '\\\\S{{1,8}}', 0), x -> xxhash64(x))"
    packed = let(hashes, "h", f"sort_array(transform(h, (x, j) -> (xxhash64(x, get(h, j + 1)) & {HIGH}L) | cast(j as bigint)))")
    back = "if(k - a - b >= 0 and shiftright(get(s, k - a - b), 28) = shiftright(x, 28), a + b, a)"
    run = " ".join(f"when size(s) <= {1 << n} then aggregate({steps(n)}, 0, (a, b) -> {back})" for n in (6, 10, 16))
    run = f"case {run} else aggregate({steps(28)}, 0, (a, b) -> {back}) end"
    rehashed = f"(xxhash64({kmer}, coalesce({run}, 0)) & {HIGH}L) | (x & {POSITION}L)"
    numbered = let(packed, "s", f"sort_array(transform(s, (x, k) -> if(k = 0 or shiftright(get(s, k - 1), 28) != {kmer}, x, {rehashed})))")
    least = let(numbered, "s", f"filter(s, (x, k) -> k < 2 or {ring.format('get(s, k - 2)')} != {ring.format('x')})")
    ordered = "if((x & {0}L) <= (y & {0}L), xxhash64(shiftright(x, 28), shiftright(y, 28)), xxhash64(shiftright(y, 28), shiftright(x, 28)))".format(POSITION)
    value = let("get(t, cast((k + 1) % size(t) as int))", "y", f"cast(shiftright({ordered}, 40) & 16777215 as int)")
    firsts = f"filter(transform(t, (x, k) -> if(k = 0 or {ring.format('get(t, k - 1)')} != {ring.format('x')}, named_struct('p', cast({ring.format('x')} + {PLACES // 2} as int), 'v', {value}), null)), e -> e is not null)"
    filled = let(firsts, "f", f"concat(flatten(transform(f, (e, k) -> array_repeat(e.v, e.p - coalesce(if(k = 0, -1, get(f, k - 1).p), -1)))), array_repeat(f[0].v, {PLACES - 1} - f[size(f) - 1].p))")
    return let(least, "t", f"if(size(t) = 0, array_repeat(0, {PLACES}), {filled})")


def signature(text: str) -> Column:
    """Signature of a string column that is not null."""
    return F.expr(signature_sql(text))


def likeness(a: str, b: str) -> Column:
    """Share of places on which two signature columns agree."""
    return F.expr(f"cast(size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) as double) / {PLACES}")


def as_text(sig: str) -> Column:
    return F.expr(f"array_join(transform({sig}, v -> lpad(lower(hex(v)), 6, '0')), '')")


def order_buckets(docs: DataFrame) -> Column:
    """Number of the id range that ``doc_id`` is in; ranges are equal shares of the rows."""
    n, ids = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    buckets = min(BUCKETS, -(-n // BUCKET_ROWS))
    if buckets < 2 or not ids:
        return F.lit(0)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 5 * buckets)).alias("b")).first()["b"]
    bounds = sorted(set(bounds))
    literal = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    n = len(bounds).bit_length()
    return F.expr(let(literal, "bounds", f"aggregate({steps(n)}, 0, (a, b) -> if(a + b <= size(bounds) and get(bounds, a + b - 1) < doc_id, a + b, a))"))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text) with ``_next`` (the next document's text) and the window that gives later columns of it.

    Documents are put in ranges of ids and sorted there; the first document of the following range is
    added to each range as a last row (``_copy``), so no task sees more than its range.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("_bucket", order_buckets(base)).withColumn("_tie", F.xxhash64("text"))
    firsts = base.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie", "text")).alias("f"))
    numbers = base.select("_bucket").distinct()
    by_number = Window.orderBy("_bucket")
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = numbers.select("_bucket", F.coalesce(F.lag("_bucket").over(by_number), F.last("_bucket").over(whole)).alias("_before"))
    copies = firsts.join(before, "_bucket").select(F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), F.col("_before").alias("_bucket"), F.col("f._tie").alias("_tie"), F.lit(True).alias("_copy"))
    rows = base.withColumn("_copy", F.lit(False)).unionByName(copies)
    order = Window.partitionBy("_bucket").orderBy("_copy", F.asc_nulls_first("doc_id"), "_tie")
    return rows.withColumn("_next", F.lead("text").over(order)), order


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to neighbours."""
    rows, order = with_next(docs)
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - char_length(text) div 2 as int))"), F.expr("substring(_next, 1, cast(char_length(text) div 2 as int))"))
    rows = rows.select("doc_id", "_bucket", "_tie", "_copy", "text", n.cast("long").alias("n_chars"), F.when(F.col("_copy"), F.lit("")).otherwise(edited).alias("_edited"))
    signed = rows.select("doc_id", "_bucket", "_tie", "_copy", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), signature("text").alias("_sig"), signature("_edited").alias("_edited_sig"))
    signed = signed.withColumn("_next_sig", F.lead("_sig").over(order)).where(~F.col("_copy"))
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", as_text("_sig").alias("fingerprint"), as_text("_edited_sig").alias("edited_fingerprint"),
        likeness("_sig", "_edited_sig").alias("near_edited"), likeness("_sig", "_next_sig").alias("near_next"),
    )
