"""Fill-in-the-middle transformation by block rotations in one buffer, and its inversion.

The text gets its three sentinels where it is cut, `<P>`prefix`<M>`middle`<S>`suffix, and the blocks change places by rotations, each made of three
reversals: [middle][suffix] for the form psm, then [prefix][suffix] for spm. The inverse finds the sentinels, rotates back and removes them.
A text that holds a sentinel stays plain. No sentinel can arise at a seam, since it starts with `<` and holds no other, so the inverse is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import free_name, query, table, whole_text

P, S, M = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
SEED = "1:"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 text -> (bytes where units start, bytes where code points start). A unit is a run of letters A-Z or a-z, or one other code point."""
    b = np.frombuffer(raw, np.uint8)
    point = (b & 0xC0) != 0x80
    letter = _LETTER[b]
    inside = np.zeros(len(b), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(point & ~inside), np.flatnonzero(point)


def rotate(buf: bytearray, a: int, b: int, c: int) -> int:
    """Exchange the neighbouring blocks [a, b) and [b, c) by three reversals; returns where the first block now starts."""
    for lo, hi in ((a, b), (b, c), (a, c)):
        part = buf[lo:hi]
        part.reverse()
        buf[lo:hi] = part
    return a + c - b


def to_form(raw: bytes, low: int, high: int, form: str) -> bytes:
    """The text cut before bytes low and high, in the given form (psm or spm)."""
    buf = bytearray(raw)
    buf[high:high] = S
    buf[low:low] = M
    buf[0:0] = P
    middle, suffix = low + len(P), high + len(P) + len(M)
    at = rotate(buf, middle, suffix, len(buf))
    if form == "spm":
        rotate(buf, 0, middle, at)
    return bytes(buf)


def from_form(raw: bytes, form: str) -> bytes:
    """The text that to_form made this of; plain texts come back as they are."""
    if form == "plain":
        return raw
    buf = bytearray(raw)
    at = buf.index(M)
    if form == "spm":
        rotate(buf, 0, buf.index(P), at)
    suffix = buf.index(S)
    suffix = rotate(buf, suffix, at, len(buf))
    for place, mark in ((suffix, S), (buf.index(M), M), (0, P)):
        assert buf[place:place + len(mark)] == mark
        del buf[place:place + len(mark)]
    return bytes(buf)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the columns fim_units (long), fim_form (plain, psm or spm), fim_prefix and fim_middle (code points, null if plain) and fim_text;
    further underscores are put before a name that docs already has.

    Cuts and form come from the sha256 of `1:` and the decimal id. Null counts as empty, and empty texts are plain; a null id counts as the empty
    text. Each row stands alone: repeated rows are alike and ties can't occur. All columns of docs stay, an empty table stays empty.
    """
    draw = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    added = [("fim_units", "long"), ("fim_form", "string"), ("fim_prefix", "long"), ("fim_middle", "long"), ("fim_text", "string")]
    names = [free_name(docs, n) for n, _ in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {t}" for n, (_, t) in zip(names, added)])
    columns = docs.columns + names

    def one(raw: bytes, sha: str):
        units, points = unit_starts(raw)
        n = len(units)
        h1, h2, h3, h4 = (int(sha[i:i + 8], 16) for i in range(0, 32, 8))
        if not raw or P in raw or S in raw or M in raw or h3 % 100 >= PLAIN_FROM:
            return n, "plain", None, None, raw
        low, high = (int(units[k]) if k < n else len(raw) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = "spm" if h4 % 100 < SPM_BELOW else "psm"
        first, second = np.searchsorted(points, (low, high)).tolist()
        return n, form, first, second - first, to_form(raw, low, high, form)

    def rows(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                texts, shas = part.column(part.num_columns - 2).cast(pa.binary()), part.column(part.num_columns - 1)
                made = [one(t, h) for t, h in zip(texts.to_pylist(), shas.to_pylist())]
                new = [pa.array(list(c), k) for c, k in zip(list(zip(*made)) or [()] * 5, kinds)]
                new[4] = new[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *new], names=columns)

    return docs.select(*docs.columns, whole_text(text).alias(free_name(docs, "fim_in")), draw.alias(free_name(docs, "fim_draw"))).mapInArrow(rows, schema)


def restore(docs: DataFrame, text: str = "fim_text", form: str = "fim_form", to: str = "restored") -> DataFrame:
    """docs with the text before the transformation in the column `to` (with underscores before it, if docs has that name); null text or form gives null."""
    name = free_name(docs, to)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{name}` string"])
    columns = [*docs.columns, name]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                texts, forms = part.column(part.num_columns - 2).cast(pa.binary()), part.column(part.num_columns - 1)
                back = [None if t is None or f is None else from_form(t, f) for t, f in zip(texts.to_pylist(), forms.to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(back, pa.binary()).cast(pa.string())], names=columns)

    return docs.select(*docs.columns, F.col(text).alias(free_name(docs, "fim_in")), F.col(form).alias(free_name(docs, "fim_form_in"))).mapInArrow(rows, schema)


SQL_12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
k AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
    array_to_string(u[greatest(c1, c2) + 1:n], '') AS c FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_middle", SQL_12)
def op12_fill_middle(spark, sf_dir):
    back = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix").alias("prefix_chars"), F.col("fim_middle").alias("middle_chars"),
        digest("fim_text").alias("output_sha256"), digest("restored").alias("restored_sha256"))
