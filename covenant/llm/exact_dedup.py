"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical without ASCII white space. Candidates
narrow from what is cheap to what is dear:

1. every text's normalised length and a hash of its first `PREFIX` normalised
   characters are written once, as two numbers a row;
2. lengths that only one row has leave, counted on these numbers;
3. of the others, pairs of length and prefix hash that only one row has leave;
4. texts are read again, and the full content is hashed (SHA-256) only where
   length and prefix survive. Rows of equal hash are a group.

What survives goes to the scanning tasks as a table of bits, `BITS` of them
whatever the input, so no text is shuffled and nothing broadcast grows with the
rows; a bit that another key has set only means that a hash is taken in vain. Rows
that join their group are narrow. Groups of more than one in `HOT` of all rows, so
at most `HOT` of them, are joined by broadcast, so one large group is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import materialize

#: Deleted from a text before it is compared.
SPACE = " \t\n\x0b\x0c\r"
#: Normalised characters of the prefix; bits of the table of survivors (8 MB).
PREFIX, BITS = 64, 1 << 26
#: Bits of a row of that table, and rows' share from which a group is hot.
ROW_BITS, HOT = 1 << 15, 1000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def survivors(rows: DataFrame, *by: str) -> DataFrame:
    """``(bucket, bits)``: bits of the values of ``by`` that several rows have."""
    several = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    place = F.pmod(F.xxhash64(*by), F.lit(BITS))
    placed = several.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(ROW_BITS - 1).alias("place"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def surviving(rows: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``survives``, whether the bit of their ``by`` is set."""
    place = F.pmod(F.xxhash64(*by), F.lit(BITS))
    at = place.bitwiseAND(ROW_BITS - 1).cast("int")
    held = rows.withColumn("bucket", F.shiftright(place, 15)).join(F.broadcast(table), "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1
    return held.withColumn("survives", F.coalesce(bit, F.lit(False))).drop("bucket", "bits")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """``(key, keep_id, group_size, kept, chars, full)``, a row for each row.

    Of equal texts the row with the most code points stays (``kept``), then the one
    of least id, null last; of rows that agree in both, any one. ``full`` is the
    SHA-256 of the normalised text, null where none was needed; ``digest`` asks for
    all, which changes no group. Null counts as empty; all empty texts and those of
    white space alone are one group. An empty table gives an empty one; other
    columns of ``df`` do not matter.
    """
    rows = df.select(F.col(key).alias("id"), F.char_length(F.coalesce(df[text], F.lit(""))).alias("chars"), normalised(df[text]).alias("norm"))
    seen = rows.withColumns({"length": F.octet_length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX))})
    sketch = materialize(seen.select("length", "prefix"), "exact-sketch")
    of_length = surviving(sketch, survivors(sketch, "length"), "length").where("survives")
    told = surviving(seen, survivors(of_length, "length", "prefix"), "length", "prefix")
    full = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    told = told.select("id", "chars", "length", F.when(F.col("survives"), full).alias("hash"), (full if digest else F.lit(None).cast("binary")).alias("digest"))
    told = materialize(told.withColumn("row", F.monotonically_increasing_id()), "exact-rows")

    first = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("unknown"), "id", "row"))
    groups = told.where("hash IS NOT NULL").groupBy("length", "hash").agg(F.count("*").alias("size"), first.alias("first")).where("size > 1")
    groups = materialize(groups.select("length", "hash", "size", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "exact-groups")
    total = told.count()
    hot = groups.where(F.col("size") * HOT > total)
    met = told.join(F.broadcast(hot), ["length", "hash"], "left")
    settled = F.col("size").isNotNull() | F.col("hash").isNull()
    rest = met.where(~settled).drop("size", "first_id", "first_row").join(groups, ["length", "hash"], "left")
    out = met.where(settled).unionByName(rest)
    several = F.col("size").isNotNull()
    return out.select(
        F.col("id").alias(key), F.when(several, F.col("first_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (~several | (F.col("row") == F.col("first_row"))).alias("kept"), "chars", F.lower(F.hex(F.coalesce("hash", "digest"))).alias("full"),
    )


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Rows without an id
    stay; an id that several rows have stays with all of them if one of them does."""
    found = classes(df, text, key).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max("kept").alias("__kept")).where("NOT __kept")
    return df.join(found, df[key] == F.col("__id"), "left_anti")
