"""Line dedup over content-defined chunks of lines, with DataFrame functions alone.

Each line has a hash; a rolling hash over the hashes of a few lines in a row decides whether a chunk ends there, so an
inserted line moves only the boundaries near it, and a run of lines that many texts share falls into the same chunks
in each of them. Chunks of at least two lines with something on them that occur more than once in the table, in one
text or in several, are removed but for their first occurrence (by smallest id, then place), once their bytes are found
equal to those of the first.

No step gathers the occurrences of a chunk: digests are counted with partial aggregation, and the first occurrence's
text is joined back to the others, a join that adaptive execution splits where one chunk is frequent.

Defined results: a null text stays null and an empty one empty; rows that are equal in id and text are one document,
so their chunks aren't copies of each other; ids that differ in text only are told apart by it; null ids come first; a
text that loses all its lines becomes empty; an empty table gives an empty one. Columns of the input are kept, but for
those whose names the results take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: A chunk ends, on average, after this many lines; lines that the rolling hash covers; lines of a chunk at least.
MEAN_LINES, WINDOW, LEAST_LINES = 3, 2, 2
#: The rolling hash's factor; hashes of lines have 28 bits.
FACTOR = 31
#: Bits of the bitmap of repeated digests: 16 MB in 4,096 rows at most, whatever the input.
MARK_BITS = 1 << 27


def chunks(text: Column, mean: int = MEAN_LINES, window: int = WINDOW) -> Column:
    """The chunks of ``text`` as an array of strings: their lines, each after the mark ``=``, joined by newlines.

    Every array here is gone through once and none is looked into from within a lambda, so the work is linear. A line
    ``#`` is set after each line that ends a chunk; as all others start with ``=``, splitting there is exact.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))

    def add(power: int):
        return lambda a, b: a + b * power  # null past the last line

    rolled = hashes
    for back in range(1, window):  # the hash of the line ``back`` lines above comes in with that power of the factor
        rolled = F.zip_with(rolled, F.concat(F.array_repeat(F.lit(0).cast("long"), back), hashes), add(FACTOR**back))
    marked = F.zip_with(lines, rolled, lambda x, r: F.when(r % mean == 0, F.concat(F.lit("="), x, F.lit("\n#"))).otherwise(F.concat(F.lit("="), x)))
    return F.split(F.regexp_replace(F.array_join(marked, "\n"), r"\n#\z", ""), "\n#\n", -1)


def unmarked(chunk: Column) -> Column:
    """The text of marked lines."""
    return F.replace(F.substring(chunk, 2, 2**31 - 1), F.lit("\n="), F.lit("\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_LINES, window: int = WINDOW) -> DataFrame:
    """``docs`` with its text less the repeated chunks, and n_lines, n_removed (lines) of the text as it was.

    Moves: a digest of 32 characters for each chunk, the bodies of repeated chunks, and each text once. The bitmap of
    repeated digests is broadcast; its size is fixed.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*keep).withColumns({"__a": F.xxhash64(F.col(id_col).cast("string"), text_col), "__b": F.xxhash64(text_col, F.col(id_col).cast("string"))})
    each = keyed.select(F.col(id_col).alias("__id"), "__a", "__b", F.posexplode(chunks(F.col(text_col), mean, window)).alias("__at", "__body"))
    each = each.filter(F.size(F.filter(F.split("__body", "\n", -1), lambda x: F.trim(x) != "=")) >= LEAST_LINES)
    each = each.withColumn("__digest", F.md5(F.col("__body").cast("binary")))
    place = F.struct("__id", "__a", "__b", "__at")
    repeated = each.groupBy("__digest").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).filter("__first < __last").select("__digest", "__first")
    repeated = materialize(repeated, "line-repeated")
    # bodies are moved for digests that a bitmap of fixed size has; its false positives go in the join with the digests
    bit = F.conv(F.substring("__digest", 8, 7), 16, 10).cast("long") % MARK_BITS
    marks = repeated.select(bit.alias("__bit")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__marks"))
    each = each.withColumn("__bit", bit).withColumn("__bucket", F.bitmap_bucket_number("__bit")).join(F.broadcast(marks), "__bucket")
    position = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring(F.col("__marks"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    each = each.filter(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0)
    occurrences = materialize(each.select("__digest", place.alias("__place"), "__body").join(repeated, "__digest"), "line-occurrences")
    firsts = occurrences.filter("__place = __first").groupBy("__digest").agg(F.min("__body").alias("__bytes"))
    copies = occurrences.filter("__place > __first").join(firsts, "__digest").filter(F.col("__body") == F.col("__bytes"))
    gone = copies.groupBy("__place.__a", "__place.__b", "__place.__at").agg(F.max(F.size(F.split("__body", "\n", -1))).alias("__lines"))
    gone = gone.groupBy("__a", "__b").agg(F.collect_list("__at").alias("__gone"), F.sum("__lines").alias("__removed"))
    marked = keyed.join(gone.hint("shuffle_hash"), ["__a", "__b"], "left")
    left = F.filter(chunks(F.col(text_col), mean, window), lambda c, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(unmarked(F.array_join(left, "\n")))
    n_lines = F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), 0).otherwise(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1)
    return marked.select(*(text.alias(c) if c == text_col else c for c in keep), n_lines.cast("long").alias("n_lines"), F.coalesce("__removed", F.lit(0)).cast("long").alias("n_removed"))
