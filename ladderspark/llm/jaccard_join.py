"""N-gram Jaccard join: exact metric-space join of shingle sets around pivots.

Distance 1 - similarity is a metric, but nearly all pairs of texts have distance 1, where no pivot separates anything. So the regions are made
where distances are below 1: a text belongs to the region of a pivot if both hold one of the shingles that decide about it. With the shingles
of a set ordered from rare to frequent, two sets of the wanted similarity share one among the first n - ceil(0.75 n) + 1 of each. One text
around each such shingle is its pivot, the texts around all shingles of a pivot are its region, and a text at a border stands in several regions.

Inside a region texts link to the pivot by their distance. Texts of the pivot's class need no further comparison with each other. The
others become pivots in turn, round by round, against the texts that the triangle inequality through the pivot leaves (in the form of
_window). It ends when every text outside of the pivot's class has been a pivot, so no link between different classes can be missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderspark.llm import tokens as T
from ladderspark.llm.common import drop_caches, free_name, query, release_memory, table, whole_text
from ladderspark.llm.graph import components
from ladderspark.storage import materialize

WIDTH = 5
PERCENT = 75
TOKENS_PER_RANGE = 2_000_000
TEXTS_PER_BUCKET = 10_000
LOW = np.uint64((1 << 48) - 1)

_SENT = "part int, base long, texts binary, sizes binary, counts binary, tokens binary"
_BACK = "bucket int, uids binary, sizes binary, ids binary, counts binary, tokens binary, classes binary"
_SETS = "h long, doc_id long, row_key binary, n long, set_key binary, prefix array<long>, tokens array<long>"


def row_key() -> Column:
    """16 bytes that tell rows with equal doc_id and different texts apart."""
    return F.unhex(F.md5(whole_text().cast("binary")))


def _bucket_of(uids: np.ndarray, buckets: int) -> np.ndarray:
    return (T.mixed(uids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _sends(ranges: int, buckets: int, width: int):
    """Texts -> for each range of shingle hashes the hashes of all texts of a batch, and for each bucket of texts their ids, keys and sizes.

    A hash is 48 bits within its range. uid numbers the rows: task and place. The size of a row without an id is sent as its complement.
    """
    def rows(batches):
        import pyarrow as pa

        drop_caches()
        release_memory()
        uid = TaskContext.get().partitionId() << 33
        empty = b""
        for batch in T.parts(batches):
            n_texts = batch.num_rows
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), "V16")
            found = []
            for first, h, bounds in T.words(batch.column(1)):
                tok, text = T.shingles(h, bounds, width)
                found.append((tok, text + first))
            tok, text = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int32)
            sizes = np.bincount(text, minlength=n_texts).astype(np.int32)
            signed = np.where(nameless, ~sizes, sizes)
            out = []
            home = _bucket_of(uid + np.arange(n_texts), buckets)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            for q in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[q]:cuts[q + 1]]
                out.append((ranges + q, uid, own.astype(np.int32).tobytes(), signed[own].tobytes(), keys[own].tobytes(), ids[own].tobytes()))
            part = ((tok >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            tok, text, part = tok[order], text[order], part[order]
            packed = np.ascontiguousarray((tok & LOW).view(np.uint8).reshape(-1, 8)[:, :6])
            new = np.ones(len(tok), bool)
            new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(tok))).astype(np.int32)
            cuts, head_cuts = np.searchsorted(part, np.arange(ranges + 1)), np.searchsorted(part[heads], np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(head_cuts[r], head_cuts[r + 1])
                who = text[heads[own]]
                out.append((r, uid, who.tobytes(), empty, counts[own].tobytes(), packed[cuts[r]:cuts[r + 1]].tobytes()))
            uid += n_texts
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["part", "base", "texts", "sizes", "counts", "tokens"])

    return rows


def _all(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _answers(ranges: int, buckets: int):
    """One range of hashes -> back to the buckets: the hashes that more than one text has, with the class of their number (its log 2)."""
    def group(key, t):
        import pyarrow as pa

        part = key[0].as_py()
        at = [len(x) // 4 for x in t.column("texts").to_pylist()]
        uids = _all(t.column("texts"), np.int32) + np.repeat(np.array(t.column("base").to_pylist(), np.int64), at)
        out = []
        if part >= ranges:
            out.append((part - ranges, uids.tobytes(), *(b"".join(t.column(c).to_pylist()) for c in ("sizes", "tokens", "counts")), b"", b""))
        else:
            counts = _all(t.column("counts"), np.int32)
            raw = _all(t.column("tokens"), np.uint8).reshape(-1, 6)
            tok = np.zeros((len(raw), 8), np.uint8)
            tok[:, :6] = raw
            tok = tok.view(np.uint64)[:, 0]
            order = np.argsort(tok)
            new = np.ones(len(tok), bool)
            new[1:] = tok[order][1:] != tok[order][:-1]
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(tok)))
            shared = np.empty(len(tok), np.uint8)
            shared[order] = np.repeat(np.log2(times).astype(np.uint8), times)
            entry = np.repeat(np.arange(len(uids)), counts)
            keep = np.flatnonzero(shared)
            entry, tok, shared = entry[keep], tok[keep] | np.uint64(part) << np.uint64(48), shared[keep]
            home = _bucket_of(uids, buckets)[entry]
            order = np.argsort(home, kind="stable")
            entry, tok, shared, home = entry[order], tok[order], shared[order], home[order]
            cuts = np.searchsorted(home, np.arange(buckets + 1))
            for q in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[q], cuts[q + 1]
                who, n = np.unique(entry[a:b], return_counts=True)
                by_entry = np.argsort(entry[a:b], kind="stable")
                out.append((q, uids[who].tobytes(), b"", b"", n.astype(np.int32).tobytes(), tok[a:b][by_entry].tobytes(), shared[a:b][by_entry].tobytes()))
        kinds = [pa.int32()] + [pa.binary()] * 6
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in _BACK.split(", ")])

    return group


def _sets(percent: int):
    """One bucket of texts -> every text with its size; those that can have a partner also with the shingles others share with them
    and the part of them that decides (prefix); set_key where all shingles are shared, so that a copy may exist."""
    def group(t):
        import pyarrow as pa

        uids, sizes, ids = _all(t.column("uids"), np.int64), _all(t.column("sizes"), np.int32), _all(t.column("ids"), np.int64)
        homes = [len(i) // 8 for i in t.column("ids").to_pylist()]
        lengths = [len(u) // 8 for u in t.column("uids").to_pylist()]
        is_home = np.repeat(np.array([h > 0 for h in homes], bool), lengths)
        split = [[c for c, h in zip(t.column("counts").to_pylist(), homes) if (h > 0) == home] for home in (True, False)]
        row_keys, counts = np.frombuffer(b"".join(split[0]), "V16"), np.frombuffer(b"".join(split[1]), np.int32)
        mine, who = uids[is_home], np.repeat(uids[~is_home], counts)
        tok, cls = _all(t.column("tokens"), np.uint64), _all(t.column("classes"), np.uint8)
        order = np.lexsort((tok, cls, who))
        who, tok, cls = who[order], tok[order], cls[order]
        by = np.argsort(mine)
        mine, sizes, ids, row_keys = mine[by], sizes[by], ids[by], row_keys[by]
        nameless, sizes = sizes < 0, np.where(sizes < 0, ~sizes, sizes)
        a, b = np.searchsorted(who, mine, "left"), np.searchsorted(who, mine, "right")
        # A text whose shingles are in many texts is near to many: it makes the better pivot and gets the smaller number.
        sums = np.append(0, np.cumsum(cls, dtype=np.int64))
        central = (sums[b] - sums[a]) / np.maximum(sizes, 1)
        rank = 255 - np.minimum(255, central * 12).astype(np.uint64)
        nodes = (rank << np.uint64(55) | (mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << 55) - 1))).astype(np.int64)
        keys, prefixes, sets = [], [], []
        for n, i, j in zip(sizes.tolist(), a.tolist(), b.tolist()):
            alone = n - (j - i)
            deciding = n - (percent * n + 99) // 100 + 1 - alone
            if n == 0 or deciding <= 0:
                keys.append(None), prefixes.append(None), sets.append(None)
                continue
            own = np.sort(tok[i:j])
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if alone == 0 else None)
            prefixes.append(tok[i:i + deciding].view(np.int64))
            sets.append(own.view(np.int64))
        longs = pa.list_(pa.int64())
        return pa.table([pa.array(nodes), pa.array(ids, mask=nameless), pa.array([k.tobytes() for k in row_keys], pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(prefixes, longs), pa.array(sets, longs)],
                        names=["h", "doc_id", "row_key", "n", "set_key", "prefix", "tokens"])

    return group


def shared_shingles(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Stored: h, doc_id, row_key, n, set_key, prefix, tokens of every row (see _sets). Two shuffles, both of packed arrays: hashes by range, and what
    is shared of them back by text. A shingle that no other text has can't be part of a link, so it is only counted."""
    spark = docs.sparkSession
    n_docs, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(parts, chars // 5 // TOKENS_PER_RANGE), 1 << 20)
    buckets = max(parts, n_docs // TEXTS_PER_BUCKET)
    sent = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), row_key().alias("row_key")).mapInArrow(_sends(ranges, buckets, width), _SENT)
    back = sent.groupBy("part").applyInArrow(_answers(ranges, buckets), _BACK)
    return materialize(back.groupBy("bucket").applyInArrow(_sets(percent), _SETS), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) -> x, y, common, joint; stored."""
    x = sets.select(F.col("h").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    y = sets.select(F.col("h").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    common = F.size(F.array_intersect("tx", "ty")).cast("long")
    both = pairs.join(x, "x").join(y, "y").select("x", "y", common.alias("common"), (F.col("nx") + F.col("ny")).alias("sum"))
    return materialize(both.select("x", "y", "common", (F.col("sum") - F.col("common")).alias("joint")), "jaccard-pairs")


def _window(first: str, second: str, percent: int):
    """Can two texts be similar enough, by what each has in common with the pivot? (n: shingles, c: those that other texts share, i: those of the pivot)

    They have at most min(i, i') shingles of the pivot and min(c - i, c' - i') others in common. This is the triangle inequality
    |d(x, p) - d(q, p)| <= d(x, q) on the sets themselves, and sharper, for it also sees shingles that no one shares.
    """
    n, c, i, m, d, j = (F.col(f"{p}{k}") for p in (first, second) for k in ("n", "c", "i"))
    common = F.least(i, j) + F.least(c - i, d - j)
    return common * 100 >= (n + m - common) * percent


def classes_of(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(h, n, prefix, tokens) of texts with different sets -> (node, component) of every text that has a link.

    h numbers the texts, central ones first: the smallest h around a shingle is its pivot, and the same one for shingles that go together.
    """
    postings = sets.select("h", F.explode("prefix").alias("root"))
    roots = postings.groupBy("root").agg(F.count("*").alias("texts"), F.min("h").alias("pivot")).where("texts > 1").select("root", "pivot")
    region = postings.join(roots, "root").where(F.col("h") != F.col("pivot"))
    checked = _verified(region.select(F.col("h").alias("x"), F.col("pivot").alias("y")).distinct(), sets)
    near = F.col("common") * 100 >= F.col("joint") * percent
    region = checked.select(F.col("x").alias("h"), F.col("y").alias("pivot"), F.col("common").alias("i")).join(sets.select("h", "n", F.size("tokens").cast("long").alias("c")), "h")
    region = materialize(region, "jaccard-regions")
    # Labels join texts that are known to be of one class; they need not be complete.
    first = checked.where(near).groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label"))
    second = first.select(F.col("node").alias("label"), F.col("label").alias("further"))
    label = first.join(second, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    label = materialize(sets.select(F.col("h").alias("node")).join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "jaccard-labels")
    past, width = None, 16
    while True:
        at = region.join(label.select(F.col("node").alias("h"), "label"), "h").join(label.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot")
        outside = at.where(F.col("label") != F.col("pivot_label"))
        if past is not None:
            outside = outside.join(past, "pivot").where(F.col("h") > F.col("upto"))
        place = F.row_number().over(Window.partitionBy("pivot").orderBy("h"))
        chosen = outside.withColumn("k", place).where(F.col("k") <= width)
        chosen = materialize(chosen.select("pivot", F.col("h").alias("q"), F.col("n").alias("q_n"), F.col("c").alias("q_c"), F.col("i").alias("q_i"), F.col("label").alias("q_label")), "jaccard-pivots")
        if chosen.isEmpty():
            break
        pairs = at.join(chosen, "pivot").where((F.col("label") != F.col("q_label")) & _window("", "q_", percent))
        pairs = pairs.select(F.greatest("h", "q").alias("x"), F.least("h", "q").alias("y")).distinct()
        fresh = _verified(pairs.join(checked.select("x", "y"), ["x", "y"], "left_anti"), sets)
        checked = checked.unionByName(fresh)
        hook = _label_pairs(fresh.where(near), label).groupBy(F.col("a").alias("label")).agg(F.min("b").alias("less"))
        label = materialize(label.join(hook, "label", "left").select("node", F.coalesce("less", "label").alias("label")), "jaccard-labels")
        past, width = chosen.groupBy("pivot").agg(F.max("q").alias("upto")), width * 8
    edges = label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(edges.union(_label_pairs(checked.where(near), label)))


def _label_pairs(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links between texts -> (a, b): distinct pairs of different labels, the larger one first."""
    lx, ly = (label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("x", "y"))
    pairs = links.join(lx, "x").join(ly, "y").where(F.col("lx") != F.col("ly"))
    return pairs.select(F.greatest("lx", "ly").alias("a"), F.least("lx", "ly").alias("b")).distinct()


def near_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Stored: one row per row of docs (doc_id, text): h (a number of the row), doc_id, row_key, n_shingles, class, tied (is there another row in the class)."""
    sets = shared_shingles(docs, width, percent)
    first = sets.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("h").alias("rep"))
    copies = sets.select("h", "set_key").join(first, "set_key").where(F.col("h") != F.col("rep"))
    copies = materialize(copies.select("h", "rep"), "set-copies")
    single = sets.where(F.col("prefix").isNotNull()).select("h", "n", "prefix", "tokens").join(copies.select("h"), "h", "left_anti")
    classes = classes_of(materialize(single, "jaccard-sets"), percent)
    ids = sets.select("h", "doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("set_key").isNotNull().alias("copied"))
    ids = ids.join(copies, "h", "left").withColumn("node", F.coalesce("rep", "h")).join(classes, "node", "left")
    tied = F.col("copied") | F.col("component").isNotNull()
    return materialize(ids.select("h", "doc_id", "row_key", "n_shingles", F.coalesce("component", "node").alias("class"), tied.alias("tied")), "near-rows")


def near_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Sets of distinct shingles of `width` words (A-Z lower-cased, blanks [\\x20\\x09-\\x0D] between words) link if 100 * common >=
    percent * joint; shingles count by 64-bit hashes. component_id is the smallest doc_id that links reach. Null and empty texts have
    no shingles and no links. A row with a null doc_id is linked like any other; component_id is null if no row of the class has an id. Repeated rows are
    rows of one class. Ties need no rule; other columns are ignored.
    """
    rows = near_rows(docs, width, percent)
    # Stored, so that the join reads two plain exchanges and a class of very many rows can be split at runtime.
    least = materialize(rows.where("tied").groupBy("class").agg(F.min("doc_id").alias("component_id")), "near-least")
    apart = rows.where("not tied").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return apart.union(rows.where("tied").join(least, "class").select("doc_id", "n_shingles", "component_id"))


def without_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without all but one of each class: the smallest doc_id stays (null ids last; of rows with one id any one).

    Rows are told apart by doc_id and text, so an id that repeats with another text is another row. Of rows with equal id and text only one stays, which one doesn't matter
    to the class. Rows without links stay, empty texts and repeats of them too. An empty table gives an empty result.
    """
    rows = near_rows(docs.select("doc_id", "text"), width, percent).where("tied")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "row_key")
    first = materialize(rows.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first"), "near-first")
    gone = rows.join(first, "class").where(F.col("h") != F.col("first.h")).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    stays = first.select(F.col("first.doc_id").alias("stays_id"), F.col("first.row_key").alias("stays_key"))
    same = lambda a, b: a[a.columns[0]].eqNullSafe(b[b.columns[0]]) & (a[a.columns[1]] == b[b.columns[1]])
    repeated = materialize(stays.join(gone, same(stays, gone)).select("stays_id", "stays_key"), "near-repeated")
    gone = materialize(gone, "near-gone")
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    is_row = lambda b: keyed["doc_id"].eqNullSafe(b[b.columns[0]]) & (keyed[key] == b[b.columns[1]])
    kept = keyed.join(gone, is_row(gone), "left_anti")
    if not repeated.isEmpty():
        kept = kept.union(keyed.join(repeated, is_row(repeated), "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))
