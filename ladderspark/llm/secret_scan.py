"""Secret scans: strong patterns by themselves, weak parts only where complementary parts stand close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import query, table, whole_text
from ladderspark.storage import materialize

# The base kinds in their order, each with its pattern; least length of the match or of group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
# A run that is long enough is found whole by these; shorter ones would be dropped anyway.
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
LONG_HEX = r"[0-9a-f]{16,}"

# Weak parts of a credential: an identifier of who, a secret, and where it is used.
WEAK_ID = r"(?:AKIA|ASIA)[A-Z0-9]{4,}|(?i:\b(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"
WEAK_SECRET = r"(?i:\b(?:pwd|pass|pass_?phrase|credential|auth|bearer|private_?key|client_?key))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 256
_MARK = "\ue000"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, hit>>, in code points.

    Matches are set in marks, the text is cut there, and the lengths of the pieces are added up: every second piece is a match. The mark is
    a private character that the text no longer holds (it was replaced one for one).
    """
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>").alias("found"))

    def step(acc, piece):
        at, end = acc["at"], acc["at"] + F.char_length(piece["p"])
        hit = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece["p"].alias("hit"))
        return F.struct(end.alias("at"), F.when(piece["i"] % 2 == 1, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), F.aggregate(numbered, empty, step, lambda acc: acc["found"])).otherwise(none)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def found_parts(docs: DataFrame) -> DataFrame:
    """rid, doc_id, base (spans of the base kinds), weak (spans of the weak kinds with `alone`: no base span overlaps); stored, one row per row of docs.

    An assignment whose value is too short for the base kind is a weak secret.
    """
    text = F.translate(whole_text(), _MARK, "\ufffd")
    t = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("assign", _spans(F.col("text"), ASSIGN, 0))
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2))
    base = F.concat(_bare(F.filter("assign", lambda s: value(s) >= ASSIGN_MIN)), _bare(_spans(F.col("text"), LONG_ACCESS, 1)), _bare(_spans(F.col("text"), LONG_HEX, 2)))
    short = F.transform(F.filter("assign", lambda s: value(s) < ASSIGN_MIN), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end")))
    weak = F.concat(short, _bare(_spans(F.col("text"), WEAK_ID, 3)), _bare(_spans(F.col("text"), WEAK_SECRET, 4)), _bare(_spans(F.col("text"), ENDPOINT, 5)))
    parts = t.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.array_sort(base).alias("base"), F.array_distinct(weak).alias("weak"))
    alone = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    marked = F.transform("weak", lambda w: F.struct(w["start"].alias("start"), w["kind"].alias("kind"), w["end"].alias("end"), alone(w).alias("alone")))
    return materialize(parts.withColumn("weak", marked), "secret-parts")


def _blocks(margin: int) -> Column:
    """The blocks of SCOPE code points that a span covers, from `margin` before it to `margin` after it."""
    return F.explode(F.sequence(F.floor((F.col("start") - margin) / SCOPE), F.floor((F.col("end") + margin) / SCOPE)))


def _near(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of df with a row of other in the same text that overlaps or has at most SCOPE code points between; a row may come several times.

    An interval join: a span stands in every block it covers, other also in those within SCOPE, so a join on (text, block) sees every
    partner. A span of n code points has n / SCOPE + 4 blocks at most, and a block holds at most one span of a kind per two code points.
    """
    left = df.withColumn("cell", _blocks(0))
    spread = other.select(F.col("rid").alias("o_rid"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), _blocks(SCOPE).alias("o_cell"))
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    return left.join(spread, (F.col("rid") == F.col("o_rid")) & (F.col("cell") == F.col("o_cell")) & (gap <= SCOPE), "left_semi")


def linked_parts(found: DataFrame) -> DataFrame:
    """rid, links: the weak spans that are reported.

    An identifier or endpoint is reported with a secret near it, a weak secret with an identifier or endpoint near it. Base spans
    take part as they are: access as identifier, assign and hex as secret. A weak span that overlaps a base span is a partner of others
    but is not reported, as the base span is.
    """
    whole = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(False).alias("alone")))
    every = F.concat(whole, F.col("weak"))
    secret = F.exists(every, lambda s: s["kind"].isin(0, 2, 4))
    partner = F.exists(every, lambda s: s["kind"].isin(1, 3, 5))
    parts = found.where(F.exists("weak", lambda w: w["alone"]) & secret & partner).select("rid", F.inline(every))
    secrets, partners = parts.where(F.col("kind").isin(0, 2, 4)), parts.where(F.col("kind").isin(1, 3, 5))
    kept = _near(secrets.where("alone"), partners).unionByName(_near(partners.where("alone"), secrets))
    return kept.groupBy("rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("links"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, base and spans, arrays of (start, kind, end) by start and kind; ends are exclusive.

    Null and empty texts have no spans. Rows stand alone: repeats, ties and null ids pass through. Other columns are ignored.
    """
    found = found_parts(docs)
    links = linked_parts(found).withColumnRenamed("rid", "l_rid")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = found.join(links, F.col("rid") == F.col("l_rid"), "left")
    return out.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("links", none)))).alias("spans"))


def written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
