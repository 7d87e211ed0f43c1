"""License scans: exact phrases, and short notices with a few edits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ladderspark.llm.common import query, table, whole_text

# Words of the base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices that are searched with edits: words as they stand after normalising.
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
LETTERS_PER_EDIT = 14
# Labels that only the last word tells apart: it has no edits there.
LAST_WORD_EXACT = ("cc-by-nc", "cc-by-sa")

_WORD = b"0-9a-z\x80-\xff"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, end: long, edits: int>>"
)


class Scanner:
    """Phrases and notices compiled once per task."""

    def __init__(self, phrases, notices):
        import ahocorasick
        import regex

        self.phrases = [(re.compile(b"(?<![%s])%s(?![%s])" % (_WORD, b" +".join(p.encode().split()), _WORD)), max(p.split(), key=len).encode(), label) for p, label in phrases]
        self.notices, seeds = [], {}
        for text, label in notices:
            k = max(1, len(text) // LETTERS_PER_EDIT)
            # Of k + 1 pieces at least one is free of edits if there are at most k.
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((len(self.notices), a))
            head = text.rpartition(" ")[0] if label in LAST_WORD_EXACT else text
            self.notices.append((regex.compile(r"(?b)(?<![^ ])(?:%s){e<=%d}%s(?![^ ])" % (regex.escape(head, literal_spaces=True), k, regex.escape(text[len(head):], literal_spaces=True))), len(text), k, label))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def exact(self, norm: bytes) -> list[tuple[int, str]]:
        """(byte, label) of every place of a base phrase."""
        return sorted((m.start(), label) for pattern, rare, label in self.phrases if rare in norm for m in pattern.finditer(norm))

    def fuzzy(self, flat: str) -> list[tuple[int, int, int, str]]:
        """(start, end, edits, label) in the words joined by single blanks."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, places) in self.seeds.iter(flat):
            for notice, offset in places:
                _, length, k, _ = self.notices[notice]
                at = end - n + 1 - offset
                windows.setdefault(notice, []).append((at - k, at + length + k))
        found = []
        for notice, spans in windows.items():
            pattern, length, k, label = self.notices[notice]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([max(a, 0), b])
            while merged:
                a, b = merged.pop()
                if b < len(flat) and flat[b] != " ":
                    b = flat.rfind(" ", a, b)  # the pattern takes b for the end of the text, so it has to be the end of a word
                # The best match comes first; worse ones may stand on both sides of it.
                if b - a >= length - k and (m := pattern.search(flat, a, b)) is not None:
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts), label))
                    merged += [[a, max(m.start() - 1, a)], [max(m.end(), a + 1), b]]
        return sorted(found)

    def scan(self, text: str):
        raw = text.encode("utf-8")
        norm = raw.translate(_TABLE)
        words = norm.split()
        exact = self.exact(norm)
        flat = b" ".join(words)
        fuzzy = self.fuzzy(flat.decode("utf-8"))
        spans, starts = [], []
        for at, label in exact:
            starts.append(len(norm[:at].split()))
        base = sorted({label for _, label in exact})
        if fuzzy:
            ends = [m.span() for m in re.finditer(b"[^ ]+", norm)]
            line = flat.decode("utf-8")
            for a, b, edits, label in fuzzy:
                first, last = line.count(" ", 0, a), line.count(" ", 0, max(a, b - 1))
                start, end = ends[first][0], ends[min(last, len(ends) - 1)][1]
                spans.append({"label": label, "start": len(raw[:start].decode("utf-8")), "end": len(raw[:end].decode("utf-8")), "edits": edits})
        score = 1.0 if exact else max([1 - edits / max(b - a, 1) for a, b, edits, _ in fuzzy], default=0.0)
        return (len(words), len(exact), min(starts, default=None), max(starts, default=None), ",".join(base),
                ",".join(sorted({*base, *(f[3] for f in fuzzy)})), float(min(max(score, 0.0), 1.0)), spans)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of docs (doc_id, text): words, places of the base phrases, labels, score and the spans of the notices (code points).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A notice may differ by one edit in 14 letters
    (at least one; none in the last word of LAST_WORD_EXACT); its spans start and end with whole words and don't overlap for one notice. Null counts as empty: no words, no labels, score 0, null word places. The score is 1 with a base
    phrase, else 1 - edits / length of the best notice. Rows stand alone, so repeats and null ids pass through; other columns are ignored.
    """
    def rows(batches):
        import pyarrow as pa

        scanner = Scanner(phrases, notices)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))]
        names = [f.split(" ")[0] for f in _SCHEMA.split(", ")[:8]] + ["spans"]
        for batch in batches:
            if batch.num_rows:
                found = list(zip(*map(scanner.scan, batch.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(list(c), t) for c, t in zip(found, types)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(rows, _SCHEMA)


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("spans")
