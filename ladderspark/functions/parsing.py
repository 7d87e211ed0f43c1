"""Text fields with a small grammar: fault tokens, course data, run descriptions, round keys."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.functions.names import lookup, squeeze, strip
from ladderspark.functions.values import SIZES, canon_discipline, canon_size, parse_float

# Breed names that get glued to another field, and breeds cut by line wrapping.
BREEDS = [
    "Australian Kelpie", "Australian Shepherd", "Belgian Shepherd Dog", "Border Collie", "Border Terrier",
    "Cairn Terrier", "Chinese Crested Dog", "Cocker Spaniel", "Croatian Sheepdog", "Dutch Shepherd Dog",
    "German Spitz", "Hungarian Pumi", "Jack Russel Terrier", "Japanese Spitz", "Kromfohrländer",
    "Miniature American Shepherd", "Miniature Pinscher", "Miniature Schnauzer", "Mudi",
    "Nova Scotia Duck Tolling Retriever", "Papillon", "Parson Russell Terrier", "Pembroke Welsh Corgi", "Poodle",
    "Pyrenean Sheepdog", "Rough Collie", "Shetland Sheepdog", "Spanish Water Dog", "Bohemian Shepherd Dog",
    "Cocker Spaniel (English)", "Miniature American", "Belgian Shepherd Dog (Groenendael)",
]
BREED_FIXES = {
    "Australian": "Australian Shepherd", "Shetland": "Shetland Sheepdog", "Croatian": "Croatian Sheepdog",
    "Miniature American": "Miniature American Shepherd",
    "Nova Scotia Duck Tolling": "Nova Scotia Duck Tolling Retriever", "Spanish Water": "Spanish Water Dog",
    "Belgian Shepherd": "Belgian Shepherd Dog",
}
# Day names that prefix a round key.
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun",
        "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _count(arr: Column, token: str) -> Column:
    return F.size(F.filter(arr, lambda p: p == token)).cast("bigint")


def _late_value(late: Column) -> Column:
    last = F.try_element_at(late, F.lit(-1))
    return parse_float(F.substring(last, F.lit(2), F.length(last)))


def parse_fault_tokens(c: Column) -> Column:
    """Struct of faults, refusals and time_faults from "R, 5, T0.806" or relay tokens "C | 5" (P22)."""
    t = F.coalesce(c, F.lit(""))
    relay = F.contains(t, F.lit("|"))
    parts = F.transform(F.split(t, F.when(relay, F.lit(r"\|")).otherwise(F.lit(","))), lambda p: strip(p))
    late = F.filter(parts, lambda p: p.startswith("T") & parse_float(F.substring(p, F.lit(2), F.length(p))).isNotNull())
    value = _late_value(late)
    return F.struct(
        _count(parts, "5").alias("faults"),
        _count(parts, "R").alias("refusals"),
        F.when(relay, 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("time_faults"),
    )


def sum_fault_tokens(c: Column) -> Column:
    """Variant of P22 that adds up the numeric tokens."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.upper(strip(p)))
    late = F.filter(parts, lambda p: p.startswith("T"))
    numbers = F.filter(parts, lambda p: ~p.startswith("T") & parse_float(p).isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, p: acc + parse_float(p))
    return F.struct(
        total.alias("faults"),
        _count(parts, "R").alias("refusals"),
        _late_value(late).alias("time_faults"),
    )


def parse_triple(c: Column) -> Column:
    """Faults and refusals of "X-Y-Z" (P23)."""
    pattern = r"^(\d+)-(\d+)-(\d+)$"
    t = strip(c)

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("bigint")

    return F.struct(part(1).alias("faults"), part(2).alias("refusals"))


def _number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")


def parse_course_spec(c: Column) -> Column:
    """Standard time, maximum time and length of "SCT: 39 secs, MCT: 68 secs, 202m" (P24)."""
    return F.struct(
        _number(c, r"SCT:\s*([\d.]+)").alias("sct"),
        _number(c, r"MCT:\s*([\d.]+)").alias("mct"),
        _number(c, r"(\d+)m\b").alias("course_length"),
    )


def parse_labelled_meta(c: Column) -> Column:
    """Course data of a text with labels (P24): ring, discipline, size, judge, times, length, participants."""
    # Labels of the source format.
    ring = r"Ring\s+(\d+)\s*[•·]\s*([\w-]+)\s*[•·]\s*(\w+)"
    text = lambda pattern, i: F.nullif(strip(F.regexp_extract(c, pattern, i)), F.lit(""))
    return F.struct(
        text(ring, 1).cast("bigint").alias("ring"),
        text(ring, 2).alias("discipline"),
        text(ring, 3).alias("size"),
        text(r"Judge:\s*(.+?)(?:\n|$)", 1).alias("judge"),
        _number(c, r"SCT:\s*([\d.]+)\s*s").alias("sct"),
        _number(c, r"MCT:\s*([\d.]+)\s*s").alias("mct"),
        _number(c, r"Length:\s*([\d.]+)\s*m").alias("course_length"),
        text(r"#\s*Participants:\s*(\d+)", 1).cast("bigint").alias("participants"),
    )


# Patterns of run descriptions.
_GRAND = r"(?i)^(?:GRAND|SOFT)\s+FINAL\s+(.+)"
_FINAL = r"(?i)^Final\s+(?:Individual|Team(?:\s+Relay)?)\s+(.+)"
_KIND = r"(?i)^(Agility|Jumping)\s+(Individual|Team)\s+(.+)"
_NUMBERED = r"(?i)^(Agility|Jumping)\s+(\d+)\s+(.+)"


def parse_description(c: Column, source: str = "numbered") -> Column:
    """Struct of discipline, size_raw, is_team and number of a run description, null if excluded (P25).

    ``source="sponsored"`` drops a trailing "by sponsor" and knows no grand finals or numbers.
    """
    d = strip(c)
    if source == "sponsored":
        d = F.regexp_replace(strip(F.regexp_replace(d, r"\s+by\s+.+$", "")), '^"+|"+$', "")
    team_word = F.contains(F.lower(d), F.lit("team"))

    def out(discipline: Column, size: Column, team: Column, number: Column) -> Column:
        return F.struct(discipline.alias("discipline"), strip(size).alias("size_raw"),
                        team.alias("is_team"), number.cast("bigint").alias("number"))

    none = F.lit(None).cast("string")
    final = F.lit("Final")
    kind = F.initcap(F.regexp_extract(d, _KIND, 1))
    like = lambda p: F.regexp_like(d, F.lit(p))
    by_final = out(final, F.regexp_extract(d, _FINAL, 1), team_word, none)
    if source == "sponsored":
        by_kind = out(kind, F.regexp_extract(d, _KIND, 3), team_word, none)
        return F.when(like(_FINAL), by_final).when(like(_KIND), by_kind)
    by_kind = out(kind, F.regexp_extract(d, _KIND, 3), F.lower(F.regexp_extract(d, _KIND, 2)) == "team", none)
    number = F.regexp_extract(d, _NUMBERED, 2)
    by_number = out(F.initcap(F.regexp_extract(d, _NUMBERED, 1)), F.regexp_extract(d, _NUMBERED, 3), team_word,
                    F.nullif(number, F.lit("")))
    return (
        F.when(F.lower(d).startswith("warm up"), F.lit(None))
        .when(like(_GRAND), out(final, F.regexp_extract(d, _GRAND, 1), team_word, none))
        .when(like(_FINAL), by_final)
        .when(like(_KIND), by_kind)
        .when(like(_NUMBERED), by_number)
    )


def size_from_code(c: Column) -> Column:
    """Size of a raw class code such as "IA1 & IA2" or "XSA1 & SA1" (P25)."""
    t = strip(c)
    letter = F.regexp_extract(t, r"^(XS|I|L|M|S)(?:A\d|$|\s)", 1)
    return (
        F.when(lookup(SIZES, t).isNotNull(), canon_size(t))
        .when(letter != "", canon_size(letter))
        .when(t.startswith("XS"), "Small")
        .otherwise(t)
    )


def round_key(is_team: Column, discipline: Column, size: Column) -> Column:
    """Base round key such as ind_agility_large."""
    return F.concat_ws("_", F.when(is_team, "team").otherwise("ind"), F.lower(discipline), F.lower(size))


def normalize_round_key(key: Column, size: Column, discipline: Column, is_team: Column) -> Column:
    """Canonical round key from an existing one: standard, date-prefixed, day-prefixed or other."""
    k = strip(key)
    parts = F.split(k, "_")
    disc, sz = canon_discipline(discipline), canon_size(size)
    prefixed = k.startswith("ind_") | k.startswith("team_")
    rest = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))
    own = F.concat_ws("_", round_key(parts[0] == "team", disc, sz), F.nullif(F.array_join(rest, "_"), F.lit("")))
    base = round_key(is_team, disc, sz)
    clean = lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]+", "")
    p1, p2 = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    dated = F.regexp_like(parts[0], F.lit(r"^\d{8}$")) & F.regexp_like(p1, F.lit(r"^-?\d+$"))
    by_date = F.concat_ws("_", base, parts[0], p1, F.nullif(clean(p2), F.lit("")))
    by_day = F.concat_ws("_", base, F.array_join(F.filter(F.transform(parts, clean), lambda p: p != ""), "_"))
    digits = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_like(p, F.lit(r"^\d+$")))
    number = F.try_element_at(digits, F.lit(1)).try_cast("bigint")
    by_number = F.concat_ws("_", base, F.when(number != 0, number).cast("string"))
    return (
        F.when(prefixed, own)
        .when(F.size(parts) < 3, k)
        .when(dated, by_date)
        .when(F.lower(parts[0]).isin(DAYS), by_day)
        .otherwise(by_number)
    )


def cut_known_suffix(c: Column, known: list[str] | None = None) -> Column:
    """Struct of rest and suffix: a known value that is the whole text, its start, or its longest end.

    A value at the start takes the whole text, because the rest cannot be split reliably.
    """
    names = BREEDS if known is None else known
    at_start = F.coalesce(*[F.when(c.startswith(n), F.lit(n)) for n in names])
    by_len = sorted(names, key=len, reverse=True)
    at_end = F.coalesce(*[F.when(c.endswith(n), F.lit(n)) for n in by_len])
    empty = F.lit("")
    rest = F.substring(c, F.lit(1), F.length(c) - F.length(at_end))
    return (
        F.when(at_start.isNotNull(), F.struct(empty.alias("rest"), at_start.alias("suffix")))
        .when(at_end.isNotNull(), F.struct(strip(rest).alias("rest"), at_end.alias("suffix")))
        .otherwise(F.struct(c.alias("rest"), empty.alias("suffix")))
    )


def _ends(text: Column, lengths: Column, from_start: bool) -> Column:
    """The beginnings or ends of a text of the given lengths."""
    fits = F.filter(lengths, lambda n: n <= F.length(text))
    return F.transform(fits, lambda n: F.substring(text, F.lit(1) if from_start else F.length(text) - n + 1, n))


def cut_known_suffix_of(df: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``cut_known_suffix`` with a dictionary of any size: adds ``rest`` and ``suffix`` to df.

    ``known`` has ``value`` and ``place``; of values at the start the one with the lowest place counts, of those at the end the longest. A text can only end
    with a value of a length that occurs, so it asks for its beginnings and ends of these few lengths, by an equality join. Every distinct text is looked up once.
    Null and empty values are left out; null texts give null.
    """
    words = known.filter("value <> ''").groupBy("value").agg(F.min("place").alias("place"))
    found = words.agg(F.sort_array(F.collect_set(F.length("value")))).first()[0]  # no more numbers than the longest value has letters
    lengths = F.array(*[F.lit(n) for n in found]).cast("array<int>")
    texts = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    asked = texts.select("_t", F.explode(F.concat(
        F.transform(_ends(F.col("_t"), lengths, True), lambda v: F.struct(F.lit(True).alias("at_start"), v.alias("value"))),
        F.transform(_ends(F.col("_t"), lengths, False), lambda v: F.struct(F.lit(False).alias("at_start"), v.alias("value"))))).alias("a"))
    hits = asked.select("_t", "a.at_start", "a.value").join(words, "value").groupBy("_t").agg(
        F.min_by("value", F.when(F.col("at_start"), F.struct("place", "value"))).alias("_start"),
        F.max_by("value", F.when(~F.col("at_start"), F.length("value"))).alias("_end"))
    rest = strip(F.expr("substring(_t, 1, length(_t) - length(_end))"))
    found = hits.select("_t", F.when(F.col("_start").isNotNull(), "").otherwise(rest).alias("_rest"), F.coalesce("_start", "_end").alias("_suffix"))
    d = df.join(found, df[text] == found["_t"], "left").drop("_t")
    return d.withColumn("rest", F.coalesce("_rest", text)).withColumn("suffix", F.when(F.col(text).isNotNull(), F.coalesce("_suffix", F.lit("")))).drop("_rest", "_suffix")


def fix_truncated(c: Column) -> Column:
    """Full form of a value cut by line wrapping."""
    return lookup(BREED_FIXES, c, c)
