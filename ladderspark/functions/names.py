"""Name cleaning and comparison as column expressions."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition and their plain form.
SPECIAL_LETTERS = {"Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ø": "O", "ø": "o", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t"}
# Title prefixes and metadata suffixes of entity names.
TITLE_PREFIX = r"(?i)^(A3Ch|Ag\.?\s*Ch\.?|AGCh|MACH\d*|PACH\d*|GCh|C\.A\.C\.T)\s+"
METADATA_SUFFIX = r"(?i)\s*\((cp|FCI|FCI registration|AKC|KC|UKC|CKC|None)\)\s*$"
NOT_CALL_NAMES = ["fci", "fci registration", "akc", "kc", "ukc", "ckc", "cp", "none"]
# Manual aliases of the batch rating job.
HANDLER_ALIASES = {"katka tercova": "katerina tercova", "adrian alonso bajo": "adrian bajo"}
CALL_ALIASES = {
    "sayonara": "seeya", "sayonara seeya": "seeya", "black swan": "chilli",
    "finrod frances": "cis", "pszenik": "psenik", "eglan tine": "rey",
}
REGISTERED_ALIASES = {
    "clever and fastvof youwentis": "clever and fast of youwentis",
    "nnl sayonara": "never never land sayonara",
    "never never land s'sayonara": "never never land sayonara",
}
REGISTERED_TO_CALL = {
    "(tray) zunerry aeddan tray": "tray",
    "a3ch zunerry aeddan tray": "tray",
    "a3ch zunerry aeddan": "tray",
    "zunerry aeddan tray": "tray",
    "zunerry aeddan": "tray",
    "night magic alfa fortuna": "beat",
    "olympia misty highland": "olinka",
    "frisky fantine z certovy kazatelny": "fanta",
    "shepworld i want it all": "katniss",
    "shepworld i'm on fire": "brant",
    "finrod frances wonderfull dream": "cis",
    "a3ch finrod frances wonderfull dream": "cis",
    "finrod frances wonderfull dream cis": "cis",
    "a3ch libby granting pleasure": "psenik",
    "libby granting pleasure": "psenik",
    "clever and fast of youwentis": "carrie",
    "clever and fastvof youwentis": "carrie",
    "never never land sayonara": "seeya",
    "black swan gates of heaven": "chilli",
    "galactic breez almondjoy": "twist",
    'a3ch flank "ray" ballarat': "ray",
    "a3ch farid fort fox": "shani",
    "eglan tine koryfej rey": "rey",
    "eglan tine koryfej": "rey",
}

# White space of all scripts, spelled out: the (?U) classes are several times slower.
SPACE = r"\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# The same characters one by one.
_SPACE_LETTERS = " \t\n\x0b\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A run of white space that is not one plain blank.
SPACES = f" *[{SPACE}&&[^ ]][{SPACE}]*| {{2,}}"


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed dictionary, else ``default`` (null if not given)."""
    table = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for long expressions that use it many times."""
    return F.transform(F.array(value), body)[0]


def _accent_table() -> tuple[str, str]:
    """All letters below U+3000 whose canonical decomposition is one base letter plus marks."""
    src, dst = [], []
    for code in range(0xC0, 0x3000):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    for ch, plain in SPECIAL_LETTERS.items():
        src.append(ch)
        dst.append(plain)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    plain = F.translate(F.replace(c, F.lit("ß"), F.lit("ss")), _ACCENTED, _PLAIN)
    # Most texts are plain ASCII and skip the letter table.
    return F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), F.regexp_replace(plain, r"\p{Mn}+", "")).otherwise(c)


def squeeze(c: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def strip(c: Column) -> Column:
    """Without white space at the ends. Only those are looked at; a pattern would be tried at every letter."""
    return F.trim(c, F.lit(_SPACE_LETTERS))


def _blank(c: Column) -> Column:
    return c.isNull() | ~F.regexp_like(c, F.lit(f"[^{SPACE}]"))


def swap_last_first(c: Column) -> Column:
    """"Last, First" to "First Last" when there is exactly one comma."""
    parts = F.split(c, ",", -1)
    swapped = F.concat(strip(parts[1]), F.lit(" "), strip(parts[0]))
    return F.when(F.size(parts) == 2, swapped).otherwise(c)


def normalize_name(c: Column) -> Column:
    """Matching form of a name."""
    quotes = F.translate(c, "“”‘’-`", "\"\"'' '")
    # Each step uses its input several times; let() keeps long texts from being worked through again.
    plain = let(let(quotes, swap_last_first), strip_accents)
    words = squeeze(F.lower(plain))
    t = F.regexp_replace(words, r"(?<!\S)(\S++)(?: \1(?!\S))+", "$1")
    return F.when(_blank(c), F.lit("")).otherwise(t)


def clean_display_name(c: Column) -> Column:
    """Display form of a name: order and spacing fixed, case and accents kept."""
    return F.when(_blank(c), c).otherwise(squeeze(swap_last_first(strip(c))))


def sorted_token_key(c: Column, aliases: dict | None = None) -> Column:
    """Order-free name key."""
    t = F.lower(strip_accents(c))
    t = squeeze(F.regexp_replace(t, r"^([^,]*),", "$1 "))
    key = F.array_join(F.array_sort(F.split(t, " ")), " ")
    return lookup(HANDLER_ALIASES if aliases is None else aliases, key, key)


def _keep_nonempty(stripped: Column, original: Column) -> Column:
    return F.when(F.length(stripped) > 0, stripped).otherwise(strip(original))


def strip_titles(c: Column) -> Column:
    """Without a leading title."""
    return F.when(_blank(c), c).otherwise(_keep_nonempty(F.regexp_replace(strip(c), TITLE_PREFIX, ""), c))


def strip_suffixes(c: Column) -> Column:
    """Without a trailing metadata tag (P5)."""
    return F.when(_blank(c), c).otherwise(_keep_nonempty(F.regexp_replace(strip(c), METADATA_SUFFIX, ""), c))


def clean_entity_name(c: Column) -> Column:
    """Without title and tag, spacing fixed."""
    return F.when(_blank(c), c).otherwise(squeeze(strip_suffixes(strip_titles(c))))


def extract_call_name(c: Column) -> Column:
    """Struct of call_name and registered_name from a trailing "x" or (x)."""
    name = strip(c)
    none = F.lit(None).cast("string")
    quoted = strip(F.regexp_extract(name, r'"([^"]+)"\s*$', 1))
    before_quote = strip(F.regexp_replace(strip(F.regexp_replace(name, r'"[^"]+"\s*$', "")), r'"+$', ""))
    inner = strip(F.regexp_extract(name, r"\(([^()]+)\)\s*$", 1))
    before_paren = strip(F.regexp_replace(name, r"\([^()]+\)\s*$", ""))

    def usable(x: Column) -> Column:
        return (F.length(x) >= 2) & ~F.lower(x).isin(NOT_CALL_NAMES)

    def pair(call: Column, registered: Column) -> Column:
        reg = F.when(F.length(registered) > 0, registered)
        return F.struct(call.alias("call_name"), reg.alias("registered_name"))

    by_paren = usable(inner) & ~F.lower(inner).startswith("fci")
    return (
        F.when(usable(quoted), pair(quoted, before_quote))
        .when(by_paren, pair(inner, before_paren))
        .otherwise(F.struct(none.alias("call_name"), none.alias("registered_name")))
    )


def _words(c: Column) -> Column:
    return F.when(squeeze(c) == "", 0).otherwise(F.size(F.split(squeeze(c), " ")))


def _registered(c: Column) -> Column:
    t = squeeze(F.lower(c))
    return lookup(REGISTERED_ALIASES, t, t)


def _named(call: Column, rest: Column) -> Column:
    def build(reg: Column) -> Column:
        return F.struct(
            lookup(CALL_ALIASES, call, call).alias("call_name"),
            F.when(_words(reg) > 2, reg).otherwise(F.lit("")).alias("registered_name"),
        )

    return let(_registered(rest), build)


def _unmarked(text: Column) -> Column:
    def build(name: Column) -> Column:
        short = _words(name) <= 2
        return F.struct(
            F.when(short, name).otherwise(lookup(REGISTERED_TO_CALL, name, F.lit(""))).alias("call_name"),
            F.when(short, F.lit("")).otherwise(name).alias("registered_name"),
        )

    reg = let(text, _registered)
    return let(let(reg, lambda r: lookup(CALL_ALIASES, r, r)), build)


def _by_marker(text: Column, pattern: str, otherwise) -> Column:
    """Call name in a marker at the end; "cp" (fixed value) is a technical suffix and is dropped."""

    def build(m: Column) -> Column:
        call, rest = m["call"], m["rest"]
        base = F.when(call == "cp", rest).otherwise(m["text"])
        return F.when((call != "") & (call != "cp"), _named(call, rest)).otherwise(otherwise(base))

    found = F.struct(
        text.alias("text"),
        F.lower(strip(F.regexp_extract(text, pattern, 1))).alias("call"),
        strip(F.regexp_replace(text, pattern, "")).alias("rest"),
    )
    return let(found, build)


def parse_entity_name(c: Column) -> Column:
    """Struct of call_name and registered_name, batch-job rules (P7): parentheses first, then quotes."""
    text = F.translate(strip(strip_accents(c)), "“”‘’", "\"\"''")
    by_quote = lambda t: _by_marker(t, r'"([^"]+)"\s*$', _unmarked)
    return let(text, lambda t: _by_marker(t, r"\(([^)]+)\)\s*$", by_quote))


def identity_key(handler: Column, entity: Column) -> Column:
    """Handler key and entity name joined by three pipes."""
    parsed = parse_entity_name(F.coalesce(entity, F.lit("")))
    who = let(parsed, lambda p: F.when(p["call_name"] != "", p["call_name"]).otherwise(p["registered_name"]))
    return F.concat_ws("|||", sorted_token_key(handler), who)


def call_name_from_blob(c: Column) -> Column:
    """Call name from a damaged text: last (...), else an open tail, at most three words."""
    groups = F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), F.lit(1))
    tail = F.regexp_extract(c, r"\(([^()]*)\s*$", 1)
    raw = F.when(F.size(groups) > 0, F.try_element_at(groups, F.lit(-1))).otherwise(tail)
    t = squeeze(F.regexp_replace(raw, r"(?U)[^\w\s'\-’]", ""))
    return F.when(_words(t) <= 3, t).otherwise(F.lit(""))


def slugify(c: Column) -> Column:
    """URL slug (P10)."""
    t = F.replace(normalize_name(c), F.lit(" "), F.lit("-"))
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\-]", ""), r"-{2,}", "-")
    return F.regexp_replace(t, r"^-+|-+$", "")


def name_rotations(c: Column) -> Column:
    """Rotations of a normalized name: swap of two tokens, else last-to-front and first-to-back."""
    p = F.filter(F.split(c, " "), lambda w: w != "")
    n = F.size(p)
    # Lengths are clamped: slice does not accept a negative one, and every branch is evaluated.
    last = F.slice(p, F.greatest(n, F.lit(1)), F.lit(1))
    first = F.slice(p, F.lit(1), F.lit(1))
    right = F.array_join(F.concat(last, F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0)))), " ")
    left = F.array_join(F.concat(F.slice(p, F.lit(2), F.greatest(n - 1, F.lit(0))), first), " ")
    return (
        F.when(n < 2, F.array().cast("array<string>"))
        .when(n == 2, F.array(right))
        .otherwise(F.array_distinct(F.array(right, left)))
    )


def word_contained(a: Column, b: Column) -> Column:
    """The shorter name (3+ letters) is made of whole words of the longer one."""
    a_first = F.length(a) <= F.length(b)
    short = F.when(a_first, a).otherwise(b)
    long = F.when(a_first, b).otherwise(a)
    pattern = F.concat(F.lit(r"(?iu)(?<![\w])\Q"), short, F.lit(r"\E(?![\w])"))
    return (F.lower(a) != F.lower(b)) & (F.length(short) >= 3) & F.regexp_like(long, pattern)


def size_compatible(a: Column, b: Column) -> Column:
    """Same or adjacent size: S with M, I with L."""
    small = a.isin("S", "M") & b.isin("S", "M")
    tall = a.isin("I", "L") & b.isin("I", "L")
    return (a == b) | small | tall


def prefix_overlap(a: Column, b: Column) -> Column:
    """Three equal words from the start, or with an offset of one or two words on one side."""
    wa, wb = F.split(squeeze(a), " "), F.split(squeeze(b), " ")

    def at(words: Column, offset: int) -> Column:
        return F.slice(words, offset + 1, 3)

    hits = [(at(wa, i) == at(wb, 0)) & (F.size(at(wb, 0)) == 3) for i in range(3)]
    hits += [(at(wa, 0) == at(wb, i)) & (F.size(at(wa, 0)) == 3) for i in (1, 2)]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def split_pair(c: Column, sep: str = " & ") -> Column:
    """Handler and entity split once."""
    parts = F.split(strip(c), "\\Q" + sep + "\\E", 2)
    return F.struct(strip(parts[0]).alias("handler"), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit("")).alias("entity"))


def natural_key(c: Column) -> Column:
    """Sort key that puts _2 before _10 (P30): text and digit runs in turn, a run led by its length."""
    v = F.coalesce(c, F.lit(""))
    runs = F.regexp_extract_all(v, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    padded = F.transform(runs, lambda x: F.when(F.regexp_like(x, F.lit(r"^\d")), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x))
    return F.when(F.regexp_like(v, F.lit(r"^\d")), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def label_order(c: Column, order: list[str]) -> Column:
    """Position in a preferred order, unknown labels last."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), c)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order)).otherwise(at - 1)


def entity_display(call: Column, registered: Column) -> Column:
    """"Registered (Call)", or the one that is there."""
    both = F.concat(registered, F.lit(" ("), call, F.lit(")"))
    return F.when((registered != "") & (call != ""), both).when(registered != "", registered).otherwise(call)


def initials(c: Column) -> Column:
    """First letters of the words, upper case."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def pair_display(handler: Column, entity: Column) -> Column:
    return F.concat(handler, F.lit(" & "), entity)


def diacritics_score(c: Column) -> Column:
    """Number of non-ASCII characters."""
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def display_case(c: Column) -> Column:
    """Title case when nothing better is known."""
    return F.initcap(c)
