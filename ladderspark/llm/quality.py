"""Quality classifier: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import free_name, query, table, whole_text

MAX_LABELLED = 3000  # documents the field is fitted on at most; the smallest hashes of their ids
SEGMENT = 32  # lines of a training sequence
ACCEPT = 0.3
OWN, NEAR = 14, (2, 3, 6, 7, 9, 11)  # features of a line; those also taken from the lines before and after
WIDTH = OWN + 2 * len(NEAR) + 2

_KINDS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b".,;:?'\"()-", 4), (b"!#$%&*+/<=>@[\\]^_`{|}~", 5), (bytes(range(128, 256)), 6)):
    _KINDS[list(_chars)] = _kind


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, weight of each line: its length and one). An empty text is one empty line."""
    own, weights, seen = [], [], set()
    for line in text.encode("utf-8").split(b"\n"):
        n = len(line)
        _, upper, lower, digit, point, symbol, beyond = np.bincount(_KINDS[np.frombuffer(line, np.uint8)], minlength=7).tolist()
        words = line.split()
        k = len(words) or 1
        letters = upper + lower + beyond or 1
        repeats = sum(map(eq, words, words[1:]))
        own.append((
            1.0, math.log1p(n), upper / letters, min(symbol / k, 4.0), digit / (n + 1), point / k, len(set(words)) / k, repeats / k,
            min(n / k, 30.0), line.count(b"|") / k, float(line in seen and n > 0), line.count(b"!") / k, float(not words), math.log1p(k),
        ))
        seen.add(line)
        weights.append(n + 1)
    x = np.zeros((len(own), WIDTH))
    x[:, :OWN] = own
    near = x[:, list(NEAR)]
    x[1:, OWN:OWN + len(NEAR)] = near[:-1]
    x[:-1, OWN + len(NEAR):OWN + 2 * len(NEAR)] = near[1:]
    x[0, -2], x[-1, -1] = 1.0, 1.0
    return x, np.array(weights, float)


@dataclass(frozen=True)
class LineField:
    """Weights of the field: `line` gives the log-odds of a good line by itself, `step[i][j]` what a change from state i to j counts;
    slope and shift turn the share of good lines into the score."""

    mean: np.ndarray
    scale: np.ndarray
    line: np.ndarray
    step: np.ndarray
    slope: float
    shift: float

    def good_lines(self, x: np.ndarray) -> np.ndarray:
        """Marginal probability of good for every line, forward and backward."""
        odds = np.clip(((x - self.mean) / self.scale) @ self.line, -30, 30)
        up = np.exp(odds).tolist()
        (a, b), (c, d) = np.exp(self.step).tolist()
        n, bad, good = len(up), 1.0, up[0]
        forward = [good / (bad + good)]
        for u in up[1:]:
            g = forward[-1]
            bad, good = (1 - g) * a + g * c, ((1 - g) * b + g * d) * u
            forward.append(good / (bad + good))
        back_bad, back_good, out = 1.0, 1.0, [0.0] * n
        for t in range(n - 1, -1, -1):
            g = forward[t]
            p_good, p_bad = g * back_good, (1 - g) * back_bad
            out[t] = p_good / (p_good + p_bad)
            u = up[t]
            back_bad, back_good = a * back_bad + b * u * back_good, c * back_bad + d * u * back_good
            s = back_bad + back_good
            back_bad, back_good = back_bad / s, back_good / s
        return np.array(out)

    def share(self, text: str) -> float:
        """Length-weighted share of good lines, as log-odds."""
        x, weights = line_features(text)
        p = float(np.clip((self.good_lines(x) * weights).sum() / weights.sum(), 1e-6, 1 - 1e-6))
        return math.log(p / (1 - p))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(min(self.slope * self.share(text) + self.shift, 50.0), -50.0)))


def _segments(docs: list[np.ndarray], labels: list[int]):
    parts, ys = [], []
    for x, y in zip(docs, labels):
        for at in range(0, len(x), SEGMENT):
            parts.append(x[at:at + SEGMENT])
            ys.append(y)
    out, mask = np.zeros((len(parts), SEGMENT, WIDTH)), np.zeros((len(parts), SEGMENT))
    for i, p in enumerate(parts):
        out[i, :len(p)], mask[i, :len(p)] = p, 1.0
    return out, mask, np.array(ys)


def _gradient(line, step, x, mask, y, weight):
    """Gradient of the mean log-likelihood; every line of a document carries its label."""
    s, t, _ = x.shape
    odds = np.clip(x @ line, -30, 30)
    node = np.stack([np.zeros_like(odds), odds], 2)
    fwd = np.zeros((s, t, 2))
    fwd[:, 0] = node[:, 0]
    lse = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
    for i in range(1, t):
        fwd[:, i] = np.where(mask[:, i, None] > 0, node[:, i] + lse(fwd[:, i - 1, :, None] + step, 1), fwd[:, i - 1])
    total = lse(fwd[:, -1], 1)
    back = np.zeros((s, t, 2))
    pairs = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        nxt = (node[:, i + 1] + back[:, i + 1])[:, None, :] + step
        live = mask[:, i + 1, None] > 0
        back[:, i] = np.where(live, lse(nxt, 2), back[:, i + 1])
        joint = np.exp(fwd[:, i, :, None] + nxt - total[:, None, None]) * (mask[:, i + 1] * weight)[:, None, None]
        pairs += joint.sum(0)
    good = np.exp(fwd[:, :, 1] + back[:, :, 1] - total[:, None])
    w = mask * weight[:, None]
    g_line = (((y[:, None] - good) * w)[:, :, None] * x).sum((0, 1))
    steps = (mask[:, 1:] * weight[:, None]).sum(1)
    seen = np.array([[(steps * (y == 0)).sum(), 0.0], [0.0, (steps * (y == 1)).sum()]])
    n = w.sum()
    return g_line / n, (seen - pairs) / n


def fit_field(examples: list[tuple[str, int]], rounds: int = 150) -> LineField:
    """Fit on (text, label). With fewer than two labels the score is the share of label 1 (0.5 without examples)."""
    flat = LineField(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0, 0.0)
    labels = [y for _, y in examples]
    if len(set(labels)) < 2:
        rate = min(max(sum(labels) / len(labels), 0.01), 0.99) if labels else 0.5
        return LineField(flat.mean, flat.scale, flat.line, flat.step, 0.0, math.log(rate / (1 - rate)))
    docs = [line_features(t)[0] for t, _ in examples]
    rows = np.concatenate(docs)
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    mean[0], scale[0] = 0.0, 1.0
    x, mask, y = _segments([(d - mean) / scale for d in docs], labels)
    share = np.array([sum(1 - v for v in labels), sum(labels)]) / len(labels)
    weight = (0.5 / share)[y] / np.maximum(mask.sum(1), 1)  # both labels and all documents count alike
    line, step = np.zeros(WIDTH), np.zeros((2, 2))
    moments = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    for r in range(1, rounds + 1):
        g_line, g_step = _gradient(line, step, x, mask, y, weight)
        for i, (value, grad) in enumerate(((line, g_line - 1e-4 * line), (step, g_step - 1e-3 * step))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += 0.05 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    field = LineField(mean, scale, line, step, 1.0, 0.0)
    z, target = np.array([field.share(t) for t, _ in examples]), np.array(labels, float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit, held back a little
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        h = p * (1 - p) + 1e-6
        a = np.array([[(h * z * z).sum() + 1.0, (h * z).sum()], [(h * z).sum(), h.sum() + 1.0]])
        g = np.array([((target - p) * z).sum() - (slope - 1.0), (target - p).sum() - shift])
        d = np.linalg.solve(a, g)
        slope, shift = slope + d[0], shift + d[1]
    return LineField(mean, scale, line, step, max(float(slope), 0.0), float(shift))


def held_out():
    """Rows kept apart from fitting: crc32 of the id as text is a multiple of 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LineField:
    """Fit on labelled documents that are not held out, at most max_labelled of them (the smallest hashes of their ids)."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id"), whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # max_labelled rows at most
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_labelled)
    return fit_field([(r.text, int(r.label)) for r in rows.collect()])


def with_score(docs: DataFrame, field: LineField, text: str = "text", score: str = "score") -> DataFrame:
    """docs and the score of each row's whole text (0 to 1); a column of that name is replaced. Null counts as empty, an empty text
    as one empty line; rows stand alone, so repeats, ties and null ids pass through."""
    passed = [c for c in docs.columns if c != score]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in passed] + [f"`{score}` double"])

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [field.score(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*passed, score])

    return docs.select(*passed, F.col(text).alias(free_name(docs, "text_in"))).mapInArrow(rows, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, fitted on labels (doc_id, quality)."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
