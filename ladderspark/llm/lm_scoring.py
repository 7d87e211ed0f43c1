"""LM scoring: difference of the cross-entropies under a target and a background bigram model."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.llm import tokens as T
from ladderspark.llm.common import query, table, whole_text

ALPHA = 0.1  # added to every count, for both models
TOKENS_PER_RANGE = 2_000_000
LOW = np.uint64((1 << 40) - 1)
START = np.uint64(0x53544152543A3A31)  # stands before the first word

_SENT = "part int, base long, target boolean, texts binary, sizes binary, counts binary, tokens binary, times binary"
_BACK = "base long, texts binary, sizes binary, ids binary, losses binary"
_SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _range_of(tok: np.ndarray, ranges: int) -> np.ndarray:
    return ((tok >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _packed(tok: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((tok & LOW).view(np.uint8).reshape(-1, 8)[:, :5])


def _distinct(tok: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text and token: (tokens, texts, times)."""
    edges = np.searchsorted(text, np.arange(int(text[-1]) + 2 if len(text) else 1))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        tok[a:b].sort()
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    return tok[heads], text[heads], np.diff(np.append(heads, len(tok))).astype(np.int32)


def _grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, texts, times): the bigrams of each text and, with the lowest bit set, the words they follow."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1][counts > 0]] = START
    pair = T.mixed(before * np.uint64(0x9E3779B97F4A7C15) + h * np.uint64(0xC2B2AE3D27D4EB4F)) & ~np.uint64(1)
    a, b = _distinct(pair, text), _distinct(before | np.uint64(1), text)
    tok, text, times = (np.concatenate(x) for x in zip(a, b))
    order = np.argsort(text, kind="stable")
    return tok[order], text[order], times[order]


def _vocabulary(ranges: int):
    """Distinct words of a batch, by range."""
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.unique(h) for _, h, _ in T.words(batch.column(0))]
            if found:
                tok = np.unique(np.concatenate(found))  # sorted, so ranges are slices
                cuts = np.searchsorted(_range_of(tok, ranges), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cuts)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([_packed(tok[cuts[r]:cuts[r + 1]]).tobytes() for r in some], pa.binary())], names=["part", "tokens"])

    return rows


def _unpacked(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64)[:, 0]


def _count_distinct(t):
    import pyarrow as pa

    return pa.table({"n": pa.array([len(np.unique(_unpacked(t.column("tokens"))))], pa.int64())})


def _sends(ranges: int):
    """Texts -> the counts of their grams by range of hashes, and their ids and sizes (a part below 0). A batch has its own base. A gram is 40 bits within its range."""
    def rows(batches):
        import pyarrow as pa

        uid = TaskContext.get().partitionId() << 33
        kinds = [pa.int32(), pa.int64(), pa.bool_()] + [pa.binary()] * 5
        names = [f.split(" ")[0] for f in _SENT.split(", ")]
        for batch in T.parts(batches):
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            target = batch.column(2).to_numpy(zero_copy_only=False)
            found, sizes = [], np.zeros(batch.num_rows, np.int32)
            for first, h, bounds in T.words(batch.column(1)):
                tok, text, times = _grams(h, bounds)
                found.append((tok, text + first, times))
                sizes[first:first + len(bounds) - 1] = np.diff(bounds)
            tok, text, times = (np.concatenate(x) for x in zip(*found))
            out = []
            own = np.flatnonzero(~target)
            if len(own):
                out.append((-1 - ((uid >> 33) + uid // len(own)) % ranges, uid, False, own.astype(np.uint16).tobytes(), sizes[own].tobytes(), known[own].tobytes(), ids[own].tobytes(), b""))
            part = _range_of(tok, ranges) * 2 + target[text]
            order = np.argsort(part.astype(np.uint16) if ranges < 1 << 15 else part, kind="stable")
            tok, text, times, part = tok[order], text[order], times[order], part[order]
            packed = _packed(tok)
            new = np.ones(len(tok), bool)
            new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(tok))).astype(np.int32)
            cuts, head_cuts = np.searchsorted(part, np.arange(2 * ranges + 1)), np.searchsorted(part[heads], np.arange(2 * ranges + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(head_cuts[r], head_cuts[r + 1])
                a, b = cuts[r], cuts[r + 1]
                out.append((r // 2, uid, bool(r % 2), text[heads[own]].astype(np.uint16).tobytes(), b"", counts[own].tobytes(), packed[a:b].tobytes(), times[a:b].tobytes()))
            uid += batch.num_rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows


def _answers(alpha: float, words: int):
    """One range of grams -> counts under both models, and from them each text's share of both losses, back to its batch."""
    def group(key, t):
        import pyarrow as pa

        out = []
        bases, texts = t.column("base").to_pylist(), t.column("texts").to_pylist()
        lengths = [len(x) // 2 for x in texts]
        if key[0].as_py() < 0:
            out = list(zip(bases, texts, t.column("sizes").to_pylist(), [i + k for i, k in zip(t.column("tokens").to_pylist(), t.column("counts").to_pylist())], [b""] * len(bases)))
        else:
            counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int32)
            times = np.frombuffer(b"".join(t.column("times").to_pylist()), np.int32)
            target = np.repeat(np.array(t.column("target").to_pylist(), bool), lengths)
            tok = _unpacked(t.column("tokens"))
            entry = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(tok)
            new = np.ones(len(tok), bool)
            new[1:] = tok[order][1:] != tok[order][:-1]
            number = np.empty(len(tok), np.int64)
            number[order] = np.cumsum(new) - 1
            is_target = target[entry]
            n = int(new.sum())
            c_target = np.bincount(number[is_target], times[is_target], n)
            c_back = np.bincount(number[~is_target], times[~is_target], n)
            follows = (tok[order][new] & np.uint64(1)).astype(bool)
            add = np.where(follows, alpha * words, alpha)  # a context's count stands below, a bigram's above the line
            sign = np.where(follows, 1.0, -1.0)
            mine = np.flatnonzero(~is_target)
            losses = []
            for c in (c_target, c_back):
                each = (sign * np.log(c + add))[number[mine]] * times[mine]
                losses.append(np.bincount(entry[mine], each, len(counts)))
            both = np.stack(losses, 1).astype(np.float32)
            at = 0
            for base, own, n, goal in zip(bases, texts, lengths, t.column("target").to_pylist()):
                if not goal:
                    out.append((base, own, b"", b"", both[at:at + n].tobytes()))
                at += n
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, [pa.int64()] + [pa.binary()] * 4)], names=[f.split(" ")[0] for f in _BACK.split(", ")])

    return group


def _scores(t):
    """One batch of texts -> both losses per word and their difference."""
    import pyarrow as pa

    rows = list(zip(*(t.column(c).to_pylist() for c in ("texts", "sizes", "ids", "losses"))))
    home = [r for r in rows if r[1]]
    join = lambda xs, kind: np.frombuffer(b"".join(xs), kind)
    uid, size = join([r[0] for r in home], np.uint16), join([r[1] for r in home], np.int32)
    ids = np.concatenate([np.frombuffer(r[2][:8 * (len(r[1]) // 4)], np.int64) for r in home]) if home else np.zeros(0, np.int64)
    known = np.concatenate([np.frombuffer(r[2][8 * (len(r[1]) // 4):], bool) for r in home]) if home else np.zeros(0, bool)
    order = np.argsort(uid)
    uid, size, ids, known = uid[order], size[order], ids[order], known[order]
    who = np.searchsorted(uid, join([r[0] for r in rows if r[3]], np.uint16))
    losses = join([r[3] for r in rows], np.float32).reshape(-1, 2).astype(float)
    empty = size == 0
    per_word = [np.bincount(who, losses[:, i], len(uid)) / np.maximum(size, 1) for i in (0, 1)]
    target, back = (pa.array(x, pa.float64(), mask=empty) for x in per_word)
    return pa.table([pa.array(ids, pa.int64(), mask=~known), pa.array(size.astype(np.int64)), target, back, pa.array(per_word[0] - per_word[1], pa.float64(), mask=empty)],
                    names=[f.split(" ")[0] for f in _SCORED.split(", ")])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, target_loss, background_loss, score = target_loss - background_loss.

    Losses are nats per word under bigram models with `alpha` added to each count: one counted over all texts of `target` (text), one over all
    of docs. Both share one vocabulary, the distinct words of either, in any number; words are runs without the blanks [\\x20\\x09-\\x0D], A-Z lower-cased. A low
    score means nearer to the target. Null and empty texts have n_tokens 0 and null losses. Repeated rows count and are scored as often as they
    stand there, null ids pass through, other columns are ignored.

    The log of a conditional probability is that of the bigram less that of its context, so each gram is looked up alone, where its hash range is
    counted; only sums of losses go back to the texts. Hashes have 40 bits within a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.lit(False).alias("target"))
    rows = rows.union(target.select(F.lit(None).cast("long"), whole_text(), F.lit(True)))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(parts, chars // 3 // TOKENS_PER_RANGE), 1 << 20)
    seen = rows.select("text").mapInArrow(_vocabulary(ranges), "part int, tokens binary")
    words = seen.groupBy("part").applyInArrow(_count_distinct, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sent = rows.mapInArrow(_sends(ranges), _SENT)
    back = sent.groupBy("part").applyInArrow(_answers(alpha, max(words, 1)), _BACK)
    return back.groupBy("base").applyInArrow(_scores, _SCORED)


@query("op6_lm_scoring")
def op6_lm_scoring(spark, sf_dir):
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
