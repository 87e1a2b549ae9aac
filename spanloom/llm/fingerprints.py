"""Order MinHash fingerprints of documents, in DataFrame functions alone.

A text is cut into pieces: words of at most 12 characters as they are, and longer
runs without white space by their content, after vowels, low digits and marks, and
around every character beyond ASCII, so that an edit moves no cut but those beside
it. Every three neighbouring pieces form a k-mer, numbered by its occurrence, so
that repeats differ. The hash of a numbered k-mer picks one of 64 sketches and its
order within it. A sketch keeps its two least k-mers, puts them back in text
order and hashes the tuple: texts agree in a sketch if they share the k-mers and
their order. The fingerprint has four hexadecimal digits for each sketch.

Arrays hold 64-bit numbers with a hash in the upper 40 bits and a position in
the lower 24, so that sorting them is sorting by hash. Beyond 16.7 million pieces
several neighbours share a position, and of those the order is not told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.shared import let, table

_END = r"aeioAEIO0-4=+/.,;:_-"
_PLAIN = rf"[\x00-\x7F&&[^\s]&&[^{_END}]]"
PIECE = rf"(?<!\S)\S{{1,12}}(?!\S)|[^\x00-\x7F]|{_PLAIN}{{0,30}}[{_END}]|{_PLAIN}{{1,31}}"
KMER, SKETCH_BITS, SHIFT = 3, 6, 24
_PLACE = (1 << SHIFT) - 1


def _pack(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(h, SHIFT), SHIFT).bitwiseOR(F.coalesce(place.cast("long").bitwiseAND(F.lit(_PLACE)), F.lit(0)))


def _runs(values: Column, bits: int) -> Column:
    """Indices where the upper bits of sorted values change."""
    at = lambda i: F.shiftright(F.get(values, i), bits)
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))


def _numbered(kmers: Column) -> Column:
    """Sorted hashes of k-mers with their occurrence number, from sorted hashes of k-mers."""

    def number(starts: Column) -> Column:
        def run(first: Column, j: Column) -> Column:
            size = F.coalesce(F.get(starts, j + 1), F.size(kmers)) - first
            own = F.shiftright(F.get(kmers, first), SHIFT)
            return F.transform(F.sequence(F.lit(0), size - 1), lambda o: _pack(F.xxhash64(own, o), F.get(kmers, first + o)))

        return F.sort_array(F.flatten(F.transform(starts, run)))

    return let(_runs(kmers, SHIFT), number)


def _tuple(x: Column, y: Column) -> Column:
    """Hash, from 1 to 65535, of one or two k-mers in text order."""
    place = lambda v: v.bitwiseAND(F.lit(_PLACE))
    a, b = F.shiftright(x, SHIFT), F.shiftright(y, SHIFT)
    both = F.when(y.isNull(), F.xxhash64(a)).when(place(x) <= place(y), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
    return (F.pmod(both, F.lit(65535)) + 1).cast("int")


def _sketches(numbered: Column) -> Column:
    upper, half = 64 - SKETCH_BITS, 1 << (SKETCH_BITS - 1)

    def pick(starts: Column) -> Column:
        def one(first: Column, j: Column) -> Column:
            after = F.coalesce(F.get(starts, j + 1), F.size(numbered))
            return _tuple(F.get(numbered, first), F.when(first + 1 < after, F.get(numbered, first + 1)))

        names = F.transform(starts, lambda i: F.shiftright(F.get(numbered, i), upper).cast("int") + half)
        filled = lambda n, t: F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), lambda b: F.coalesce(F.get(t, F.array_position(n, b).cast("int") - 1), F.lit(0)))
        return let(names, lambda n: let(F.transform(starts, one), lambda t: filled(n, t)))

    return let(_runs(numbered, upper), pick)


def sketches(text: Column) -> Column:
    """The 64 sketches of text as an array of int; 0 for a sketch without k-mers, all 0 for texts without pieces."""

    def of(pieces: Column) -> Column:
        last = F.greatest(F.size(pieces) - KMER, F.lit(0))
        step = F.floor(F.size(pieces) / (1 << SHIFT)) + 1
        hashed = lambda i: _pack(F.xxhash64(*(F.get(pieces, i + k) for k in range(KMER))), F.floor(i / step))
        kmers = F.sort_array(F.transform(F.sequence(F.lit(0), last), hashed))
        none = F.array_repeat(F.lit(0), 1 << SKETCH_BITS)
        return F.when(F.size(pieces) == 0, none).otherwise(let(kmers, lambda s: let(_numbered(s), _sketches)))

    return let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), of)


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches in use on either side that agree; 1 where neither side has any."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda v: v))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda v: v))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def _next_bucket(buckets: DataFrame, width: int, depth: int) -> DataFrame:
    """(bucket, next): the next lower bucket in the table, the highest after the lowest. No task sees more than a width of them, but for the top."""
    if depth == 0:
        order = Window.orderBy(F.desc("bucket"))
        ends = Window.partitionBy(F.lit(0))
        return buckets.select("bucket", F.coalesce(F.lead("bucket").over(order), F.max("bucket").over(ends)).alias("next"))
    grouped = buckets.select("bucket", F.floor(F.col("bucket") / width).alias("g"))
    inside = grouped.select("g", "bucket", F.lead("bucket").over(Window.partitionBy("g").orderBy(F.desc("bucket"))).alias("inner"))
    tops = grouped.groupBy("g").agg(F.max("bucket").alias("top"))
    onward = _next_bucket(tops.select(F.col("g").alias("bucket")), width, depth - 1)
    onward = onward.join(tops.select(F.col("g").alias("next"), "top"), "next").select(F.col("bucket").alias("g"), "top")
    return inside.join(onward, "g").select("bucket", F.coalesce("inner", "top").alias("next"))


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 128) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last half is replaced by as many first characters of the next
    document in descending key order (by text where keys repeat). Null texts
    count as empty, and two empty texts are alike. Rows without a key have no
    next document: the empty text stands for it. Of an only document the next
    is itself. An empty table gives an empty result; other columns are not read.
    """
    low, high, n = docs.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long")), F.count(key)).first()
    if n:  # buckets of about as many documents each, however far apart keys lie
        width = max(width, (high - low + 1) * width // n)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("s", sketches(F.col("t"))).withColumn("bucket", F.floor(F.col("id") / width))
    keyed = rows.where("id is not null")
    order = Window.partitionBy("bucket").orderBy(F.desc("id"), "t")
    led = keyed.select("id", "t", "s", "bucket", F.row_number().over(order).alias("rn"), F.lead("t").over(order).alias("t2"), F.lead("s").over(order).alias("s2"))
    heads = led.where("rn = 1").select(F.col("bucket").alias("next"), F.col("t").alias("t3"), F.col("s").alias("s3"))
    links = _next_bucket(docs.where(F.col(key).isNotNull()).select(F.floor(F.col(key).cast("long") / width).alias("bucket")).distinct(), 1024, 2)
    full = led.join(links.join(heads, "next").select("bucket", "t3", "s3"), "bucket")
    near = full.select("id", "t", "s", F.coalesce("t2", "t3").alias("u"), F.coalesce("s2", "s3").alias("v"))
    lone = rows.where("id is null").select("id", "t", "s", F.lit("").alias("u"), sketches(F.lit("")).alias("v"))
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", 1, F.length("t") - half), F.substring("u", 1, half))
    both = near.union(lone).select("id", F.length("t").cast("long").alias("n_chars"), "s", "v", edited.alias("e"))
    done = both.select("id", "n_chars", "s", "v", F.sha2("e", 256).alias("edited_sha256"), sketches(F.col("e")).alias("w"))
    return done.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("w")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("w")).alias("near_edited"), likeness(F.col("s"), F.col("v")).alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
