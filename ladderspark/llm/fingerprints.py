"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderspark.llm.common import query, table, whole_text
from ladderspark.storage import materialize

# A paragraph is a line; in long lines it ends with a sentence after 80 letters at least.
PARAGRAPH = r"[^\n]{80,}?[.!?](?=\s)|[^\n]+"
TABLES = 3  # a digest stands in one cell of each
CELLS = 24  # of a published fingerprint
CYCLES = 4  # of peeling all tables before a larger sketch is tried
GROWTH = 4
BLOCK = 256  # ids in a block of neighbours


def paragraph_digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(0xFFFFFFFF)


def _cell(digest: Column, sub: Column, cells: Column) -> Column:
    """Cell of a digest in sub-table `sub`."""
    width = F.floor(cells / TABLES).cast("int")
    return (sub * width + F.pmod(F.xxhash64(digest, sub), width)).cast("int")


def _sketch(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, cells, digest, sign) -> key, cells, cell, count, ids, checks without empty cells."""
    placed = rows.select(*key, "cells", "digest", "sign", F.explode(F.array(*[F.lit(i) for i in range(TABLES)])).alias("sub"))
    placed = placed.select(*key, "cells", _cell(F.col("digest"), F.col("sub"), F.col("cells")).alias("cell"), F.col("sign").alias("count"), F.col("digest").alias("ids"), _check(F.col("digest")).alias("checks"))
    return _summed(placed, key)


def _summed(cells: DataFrame, key: list[str]) -> DataFrame:
    s = cells.groupBy(*key, "cells", "cell").agg(F.sum("count").alias("count"), F.bit_xor("ids").alias("ids"), F.bit_xor("checks").alias("checks"))
    return s.where((F.col("count") != 0) | (F.col("ids") != 0) | (F.col("checks") != 0))


def fingerprint(rows: DataFrame, key: list[str], digests: str) -> DataFrame:
    """key and fingerprint: cell:count:ids:checks of the cells in use, ids and checks in hexadecimal.

    Rows must be partitioned by a part of the key already, so nothing is shuffled here. Equal sets of digests have equal fingerprints.
    """
    each = rows.select(*key, F.explode(digests).alias("digest"), F.lit(1).alias("sign"), F.lit(CELLS).alias("cells"))
    cells = _sketch(each, key)
    one = F.struct("cell", "count", "ids", "checks")
    listed = F.transform(F.sort_array(F.collect_list(one)), lambda c: F.concat_ws(":", c["cell"].cast("string"), c["count"].cast("string"), F.lower(F.hex(c["ids"])), F.lower(F.hex(c["checks"]))))
    return cells.groupBy(*key).agg(F.array_join(listed, ",").alias("fingerprint"))


def _peel(cells: DataFrame, key: list[str], sub: int) -> DataFrame:
    """Take the digests that stand alone in a cell of one sub-table out of all tables. A digest has one cell in a sub-table, so none is taken twice.
    Those only on the first side are counted in cell -1, those only on the second in cell -2."""
    width = F.floor(F.col("cells") / TABLES)
    alone = (F.col("cell") >= 0) & (F.floor(F.col("cell") / width) == sub) & (F.abs("count") == 1) & (_check(F.col("ids")) == F.col("checks")) & (_cell(F.col("ids"), F.lit(sub), F.col("cells")) == F.col("cell"))

    def row(cell, count, ids, checks):
        return F.struct(cell.cast("int").alias("cell"), count.cast("long").alias("count"), ids.cast("long").alias("ids"), checks.cast("long").alias("checks"))

    zero = F.lit(0)
    taken = [row(F.when(F.col("count") > 0, F.lit(-1)).otherwise(F.lit(-2)), F.lit(1), zero, zero)]
    taken += [row(_cell(F.col("ids"), F.lit(j), F.col("cells")), -F.col("count"), F.col("ids"), F.col("checks")) for j in range(TABLES) if j != sub]
    same = row(F.col("cell"), F.col("count"), F.col("ids"), F.col("checks"))
    after = cells.select(*key, "cells", F.inline(F.when(alone, F.array(*taken)).otherwise(F.array(same))))
    return _summed(after, key)


def differences(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(rid, kind, first, second: arrays of distinct digests) -> rid, kind, only_first, only_second: how many digests one side has alone.

    The sketches are subtracted (digests of the second side count negative) and peeled; a pair that isn't empty at the end
    is tried again with a sketch GROWTH times as large. The first sketch is at least as large as the difference of the sizes needs.
    """
    key = ["rid", "kind"]
    todo = pairs.select(*key, first, second).withColumn("cells", F.lit(CELLS))
    gap = F.abs(F.size(first) - F.size(second)) * 2
    todo = todo.withColumn("cells", F.when(gap > CELLS, (F.ceil(gap / TABLES) * TABLES).cast("int")).otherwise(F.col("cells")))
    done = []
    while True:
        placed = todo.repartition("rid")
        each = placed.select(*key, "cells", F.size(first).alias("n"), F.posexplode(F.concat(first, second)).alias("pos", "digest"))
        each = each.select(*key, "cells", "digest", F.when(F.col("pos") < F.col("n"), F.lit(1)).otherwise(F.lit(-1)).alias("sign"))
        cells = _sketch(each, key)
        for i in range(CYCLES * TABLES):
            cells = _peel(cells, key, i % TABLES)
        count = lambda cell: F.coalesce(F.sum(F.when(F.col("cell") == cell, F.col("count"))), F.lit(0))
        ends = cells.groupBy(*key).agg(count(-1).alias("only_first"), count(-2).alias("only_second"), F.max((F.col("cell") >= 0).cast("int")).alias("left"))
        ends = materialize(ends, "peeled")
        done.append(ends.where("left = 0").drop("left"))
        failed = ends.where("left = 1").select(*key)
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = todo.join(failed, key).withColumn("cells", F.col("cells") * GROWTH)


def likeness(n_first: Column, n_second: Column, only_first: Column) -> Column:
    """Common digests as a share of all; two texts without paragraphs are alike."""
    joint = n_second + only_first
    return F.when(joint == 0, F.lit(1.0)).otherwise((n_first - only_first) / joint)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Every row with the text and digests of the next one by doc_id; after the last comes the first.

    Rows are dealt out by blocks of ids. The first row of a block is also put behind the block before, as a guest, so one window in a
    block sees all it needs and the texts are shuffled once.
    """
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select("doc_id", d.alias("d"), whole_text().alias("text")).withColumn("h", F.xxhash64("text")).withColumn("block", F.floor(F.col("d") / BLOCK))
    firsts = rows.groupBy("block").agg(F.min(F.struct("d", "h")).alias("f"))
    firsts = materialize(firsts.select("block", "f.*", F.floor(F.col("block") / 4096).alias("outer")), "blocks")
    inner = Window.partitionBy("outer").orderBy("block")
    ends = firsts.groupBy("outer").agg(F.max("block").alias("last"))
    every = Window.partitionBy()
    ends = ends.select("outer", F.coalesce(F.lag("last").over(Window.orderBy("outer")), F.max("last").over(every)).alias("end_before"))
    before = firsts.withColumn("b", F.lag("block").over(inner)).join(ends, "outer").select("d", "h", F.coalesce("b", "end_before").alias("to_block"))
    before = materialize(before, "blocks")
    keyed = rows.withColumn("digests", paragraph_digests(F.col("text")))
    guests = rows.join(before, ["d", "h"]).dropDuplicates(["d", "h"]).withColumn("digests", paragraph_digests(F.col("text")))
    both = keyed.withColumn("guest", F.lit(0)).unionByName(guests.drop("block").withColumnRenamed("to_block", "block").withColumn("guest", F.lit(1)))
    order = Window.partitionBy("block").orderBy("guest", "d", "h")
    led = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_digests", F.lead("digests").over(order))
    return led.where("guest = 0").select("doc_id", "text", "digests", "next_text", "next_digests")


def versions(docs: DataFrame) -> DataFrame:
    """Stored: rid, doc_id, n_chars, edited_sha256 and the digests of each text, of its edited form and of the next text.

    Edited: the last floor(n / 2) code points are replaced by the first as many of the next text by doc_id (all, if it has fewer).
    """
    rows = _neighbours(docs).withColumn("n", F.char_length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    return materialize(rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digests",
        paragraph_digests(F.col("edited")).alias("edited"), F.col("next_digests").alias("next")), "versions")


def compare_versions(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null counts as empty; a text without paragraphs has the fingerprint of no digests (empty string) and likeness 1 to another such text. Rows with equal doc_id follow
    each other by a hash of their text, null ids come last; a single row is its own next one. Other columns are ignored.
    """
    v = versions(docs)
    n = v.select("rid", "doc_id", "n_chars", "edited_sha256", F.size("digests").alias("n"), F.size("edited").alias("n_edited"), F.size("next").alias("n_next"))
    placed = v.repartition("rid")
    both = placed.select("rid", F.inline(F.array(F.struct(F.lit(0).alias("version"), F.col("digests").alias("own")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("own")))))
    prints = fingerprint(both, ["rid", "version"], "own").groupBy("rid").agg(
        F.max(F.when(F.col("version") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("version") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    pairs = v.select("rid", "digests", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("edited").alias("other")), F.struct(F.lit(1).alias("kind"), F.col("next").alias("other")))))
    found = differences(pairs, "digests", "other")
    side = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    found = found.groupBy("rid").agg(side(0, "only_first").alias("e1"), side(1, "only_first").alias("x1"))
    out = n.join(prints, "rid", "left").join(found, "rid", "left").fillna(0, ["e1", "x1"]).fillna("", ["fingerprint", "edited_fingerprint"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("n"), F.col("n_edited"), F.col("e1")).alias("near_edited"), likeness(F.col("n"), F.col("n_next"), F.col("x1")).alias("near_next"))


@query("op2_fingerprints")
def op2_fingerprints(spark, sf_dir):
    return compare_versions(table(spark, sf_dir, "documents"))
