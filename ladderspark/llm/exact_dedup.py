"""Exact deduplication by content sort: equal texts become neighbours, neighbours are compared in full."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderspark.llm.common import query, table, whole_text
from ladderspark.storage import materialize

BLANKS = " \t\n\x0b\x0c\r"
SPLITTER = 64  # letters of a text in the key of its range
_RUNS = "pid int, run long, lead boolean, keep_id long, group_size long, text_sha256 string, head binary, tail binary"


def _walk(names: list[str], n_carried: int, keep_rows: bool):
    """Batches in which equal texts are neighbours, longer originals first -> each row with its run of equal texts inside this partition.

    A run is written when it ends, since only then its size is known; only identifiers wait, never texts.
    """
    import pyarrow as pa

    def rows(batches):
        pid = TaskContext.get().partitionId()
        text, sha, run, first_id, size, started = None, None, -1, None, 0, False
        waiting: list = []

        def closed(last: bool):
            n = len(lead)
            cols = [pa.array([pid] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array(lead, pa.bool_()), pa.array([first_id] * n, pa.int64()),
                    pa.array([size] * n, pa.int64()), pa.array([sha] * n, pa.string()),
                    pa.array([text if i == 0 and run == 0 else None for i in range(n)], pa.binary()),
                    pa.array([text if i == 0 and last else None for i in range(n)], pa.binary())]
            return cols

        done: list[pa.RecordBatch] = []
        held = 0
        lead: list[bool] = []
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            ids = batch.column(1).to_pylist()
            shas = batch.column(3).to_pylist()
            carried = [batch.column(5 + i) for i in range(n_carried)]
            begin = 0
            for i, t in enumerate(texts):
                if started and t == text:
                    lead.append(False)
                    size += 1
                    continue
                if started:
                    waiting.append((carried, ids, begin, i))
                    done.append(_joined(pa, names, closed(False), waiting, n_carried, keep_rows))
                    held += done[-1].num_rows
                    waiting = []
                text, sha, run, first_id, size, started, lead, begin = t, shas[i], run + 1, ids[i], 1, True, [True], i
                if held >= 2000:
                    yield from done
                    done, held = [], 0
            if texts:
                if keep_rows:  # of a waiting run only the leading row is needed in full
                    carried = [c.slice(begin, len(texts) - begin) if not waiting else c.slice(begin, 0) for c in carried]
                    waiting.append((carried, ids[begin:], 0, len(texts) - begin))
                else:
                    waiting.append((carried, ids, begin, len(texts)))
        if started:
            done.append(_joined(pa, names, closed(True), waiting, n_carried, keep_rows))
        yield from done

    return rows


def _joined(pa, names, run_columns, waiting, n_carried, keep_rows):
    ids = pa.array([x for _, ids, a, b in waiting for x in ids[a:b]], pa.int64())
    columns = [ids, *run_columns]
    if keep_rows:
        carried, _, a, _ = waiting[0]
        for i in range(n_carried):
            one = carried[i].slice(a, 1)
            columns.append(pa.concat_arrays([one, pa.nulls(len(ids) - 1, one.type)]))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _runs(docs: DataFrame, keep_rows: bool) -> tuple[DataFrame, list[str]]:
    """Rows in content order with their runs, stored; with keep_rows the leading row of a run carries all columns of docs."""
    own = [f"c{i}" for i in range(len(docs.columns))] if keep_rows else []
    keyed = docs.select(
        F.translate(whole_text(), BLANKS, "").alias("norm"), F.col("doc_id").cast("long").alias("id"), F.char_length(whole_text()).cast("long").alias("n"),
        *[docs[c].alias(o) for c, o in zip(docs.columns, own)])
    keyed = keyed.withColumn("sha", F.sha2("norm", 256)).withColumn("start", F.substring("norm", 1, SPLITTER))
    keyed = keyed.select("norm", "id", "n", "sha", "start", *own)
    # The splitters, which the driver samples, see the start of the text and its digest: bounded, and equal for equal texts alone. Length and id
    # take part, so a large group of equal texts is cut, too.
    order = [F.col("start"), F.col("sha"), F.col("n").desc(), F.col("id").asc_nulls_last()]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "id long, " + _RUNS + "".join(f", {o} {t}" for o, (_, t) in zip(own, docs.dtypes))
    names = [f.split(" ")[0] for f in ("id long, " + _RUNS).split(", ")] + own
    return materialize(placed.mapInArrow(_walk(names, len(own), keep_rows), schema), "dedup-runs"), own


def _across(runs: DataFrame) -> DataFrame:
    """Runs at the edges of partitions -> (pid, run, first, all_keep, all_size) of the group they belong to.

    Two rows per partition at most; the windows see their keys only, the texts meet in a join of neighbours.
    """
    edges = runs.where(F.col("head").isNotNull() | F.col("tail").isNotNull()).select("pid", "run", "keep_id", "group_size", "head", "tail")
    order = Window.orderBy("pid", "run")
    keys = edges.select("pid", "run").withColumn("p_pid", F.lag("pid").over(order)).withColumn("p_run", F.lag("run").over(order))
    before = edges.select(F.col("pid").alias("p_pid"), F.col("run").alias("p_run"), F.col("tail").alias("p_tail"))
    linked = (
        edges.join(keys, ["pid", "run"]).join(before, ["p_pid", "p_run"], "left")
        .select("pid", "run", "keep_id", "group_size", F.coalesce((F.col("pid") != F.col("p_pid")) & (F.col("head") == F.col("p_tail")), F.lit(False)).alias("goes_on"))
    )
    chain = linked.withColumn("chain", F.sum((~F.col("goes_on")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = chain.groupBy("chain").agg(F.min_by("keep_id", F.struct("pid", "run")).alias("all_keep"), F.sum("group_size").alias("all_size"))
    return chain.join(total, "chain").select("pid", "run", (~F.col("goes_on")).alias("first"), "all_keep", "all_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after deleting the blanks [\\x20\\x09-\\x0D]. The longest original (code points), then the smallest
    doc_id stays; null ids come last, and of repeated rows one stays. Null counts as empty, and all empty texts are equal.
    An empty table gives an empty result; other columns are ignored.
    """
    runs, _ = _runs(docs, keep_rows=False)
    at = runs.join(_across(runs), ["pid", "run"], "left")
    return at.select(
        F.col("id").alias("doc_id"), F.when(F.col("first").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"), (F.col("lead") & F.coalesce("first", F.lit(True))).alias("kept"), "text_sha256")


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    runs, own = _runs(docs, keep_rows=True)
    kept = runs.where("lead").join(_across(runs), ["pid", "run"], "left").where(F.coalesce("first", F.lit(True)))
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])


SQL_1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, length(t) AS n, count(*) OVER (PARTITION BY norm) AS group_size,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query("op1_exact_dedup", SQL_1)
def op1_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
