"""Value maps: sizes, disciplines, flags, countries, numbers, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderspark.functions.names import lookup, squeeze, strip

# Size labels.
SIZES = {
    "S": "Small", "Small": "Small", "small": "Small",
    "M": "Medium", "Medium": "Medium", "medium": "Medium",
    "I": "Intermediate", "In": "Intermediate", "Inter": "Intermediate",
    "Intermediate": "Intermediate", "intermediate": "Intermediate",
    "L": "Large", "Large": "Large", "large": "Large",
    "XS": "Small", "Xs": "Small", "XS & S": "Small", "Xs+S": "Small", "xs": "Small", "xs+s": "Small",
}
# Discipline labels.
DISCIPLINES = {
    "Jumping": "Jumping", "jumping": "Jumping", "JUMPING": "Jumping",
    "Agility": "Agility", "agility": "Agility", "AGILITY": "Agility",
    "A1": "Agility", "A2": "Agility", "A3": "Agility",
    "Final": "Final", "final": "Final", "FINAL": "Final",
    "Grand Final": "Final", "GRAND FINAL": "Final", "SOFT FINAL": "Final", "Final Team Relay": "Final",
}
# Height categories of the organizations; a null size with excluded=True is not rated.
CATEGORIES = {
    "FCI": {"S": "S", "SMALL": "S", "XS": "S", "M": "M", "MEDIUM": "M", "I": "I", "INTERMEDIATE": "I", "L": "L", "LARGE": "L"},
    "AKC": {"8": "S", "12": "S", "16": "M", "20": "I", "24": "L"},
    "USDAA": {"12": "S", "16": "M", "22": "L", "26": "L"},
    "WAO": {"250": "S", "300": "M", "400": "I", "500": "L", "600": "L"},
    "UKI": {"S": "S", "M": "M", "I": "I", "L": "L"},
    "IFCS": {"S": "S", "M": "M", "L": "L"},
}
# Country names of the canonical format.
COUNTRY_NAMES = {
    "argentina": "ARG", "australia": "AUS", "austria": "AUT", "belgium": "BEL", "brasil": "BRA", "brazil": "BRA",
    "bulgaria": "BGR", "canada": "CAN", "chile": "CHL", "china": "CHN", "colombia": "COL", "costa rica": "CRI",
    "croatia": "HRV", "czech republic": "CZE", "czechia": "CZE", "denmark": "DNK", "estonia": "EST",
    "finland": "FIN", "france": "FRA", "francie": "FRA", "germany": "DEU", "greece": "GRC", "hungary": "HUN",
    "iceland": "ISL", "ireland": "IRL", "israel": "ISR", "italy": "ITA", "japan": "JPN", "latvia": "LVA",
    "lithuania": "LTU", "luxembourg": "LUX", "mexico": "MEX", "netherlands": "NLD", "norway": "NOR",
    "poland": "POL", "portugal": "PRT", "romania": "ROU", "russia": "RUS", "serbia": "SRB", "slovakia": "SVK",
    "slovenia": "SVN", "south korea": "KOR", "spain": "ESP", "sweden": "SWE", "switzerland": "CHE",
    "ukraine": "UKR", "united kingdom": "GBR", "united states": "USA", "usa": "USA",
}
# Two-letter codes of the canonical format.
ISO2 = {
    "AT": "AUT", "BE": "BEL", "BR": "BRA", "CA": "CAN", "CH": "CHE", "CL": "CHL", "CN": "CHN", "CO": "COL",
    "CR": "CRI", "CZ": "CZE", "DE": "DEU", "DK": "DNK", "EE": "EST", "ES": "ESP", "EU": "EUR", "FI": "FIN",
    "FR": "FRA", "GB": "GBR", "GR": "GRC", "HR": "HRV", "HU": "HUN", "IE": "IRL", "IL": "ISR", "IT": "ITA",
    "JP": "JPN", "LT": "LTU", "LU": "LUX", "LV": "LVA", "MX": "MEX", "NL": "NLD", "NO": "NOR", "PL": "POL",
    "PT": "PRT", "RO": "ROU", "RS": "SRB", "SE": "SWE", "SI": "SVN", "SK": "SVK", "UA": "UKR", "US": "USA",
    "UY": "URY",
}
# Two-letter codes, code aliases and spellings of the free-text rule.
TEXT_ISO2 = {
    "AT": "AUT", "AU": "AUS", "BE": "BEL", "BG": "BGR", "BR": "BRA", "CA": "CAN", "CH": "CHE", "CL": "CHL",
    "CN": "CHN", "CO": "COL", "CR": "CRI", "CY": "CYP", "CZ": "CZE", "DE": "DEU", "DK": "DNK", "EE": "EST",
    "ES": "ESP", "FI": "FIN", "FR": "FRA", "GB": "GBR", "GR": "GRC", "HR": "HRV", "HU": "HUN", "IE": "IRL",
    "IL": "ISR", "IS": "ISL", "IT": "ITA", "JP": "JPN", "LT": "LTU", "LU": "LUX", "LV": "LVA", "MX": "MEX",
    "NL": "NLD", "NO": "NOR", "PL": "POL", "PT": "PRT", "RO": "ROU", "RS": "SRB", "SE": "SWE", "SI": "SVN",
    "SK": "SVK", "UA": "UKR", "US": "USA",
}
TEXT_CODE_ALIASES = {"DEN": "DNK", "GER": "DEU", "SLO": "SVN", "UK": "GBR"}
TEXT_NAME_ALIASES = {"Luxemburg": "Luxembourg", "Filand": "Finland"}
# Country names of the free-text rule.
TEXT_COUNTRIES = {
    "Afghanistan": "AFG", "Albania": "ALB", "Algeria": "DZA", "Andorra": "AND", "Argentina": "ARG",
    "Armenia": "ARM", "Australia": "AUS", "Austria": "AUT", "Azerbaijan": "AZE", "Bahrain": "BHR",
    "Bangladesh": "BGD", "Belarus": "BLR", "Belgium": "BEL", "Bolivia": "BOL", "Bosnia and Herzegovina": "BIH",
    "Brazil": "BRA", "Bulgaria": "BGR", "Cambodia": "KHM", "Canada": "CAN", "Chile": "CHL", "China": "CHN",
    "Colombia": "COL", "Costa Rica": "CRI", "Croatia": "HRV", "Cuba": "CUB", "Cyprus": "CYP",
    "Czech Republic": "CZE", "Denmark": "DNK", "Dominican Republic": "DOM", "Ecuador": "ECU", "Egypt": "EGY",
    "El Salvador": "SLV", "Estonia": "EST", "Finland": "FIN", "France": "FRA", "Georgia": "GEO",
    "Germany": "DEU", "Greece": "GRC", "Guatemala": "GTM", "Honduras": "HND", "Hong Kong": "HKG",
    "Hungary": "HUN", "Iceland": "ISL", "India": "IND", "Indonesia": "IDN", "Iran": "IRN", "Iraq": "IRQ",
    "Ireland": "IRL", "Israel": "ISR", "Italy": "ITA", "Jamaica": "JAM", "Japan": "JPN", "Jordan": "JOR",
    "Kazakhstan": "KAZ", "Kenya": "KEN", "Kuwait": "KWT", "Latvia": "LVA", "Lebanon": "LBN",
    "Lithuania": "LTU", "Luxembourg": "LUX", "Malaysia": "MYS", "Malta": "MLT", "Mexico": "MEX",
    "Moldova": "MDA", "Monaco": "MCO", "Mongolia": "MNG", "Montenegro": "MNE", "Morocco": "MAR",
    "Netherlands": "NLD", "New Zealand": "NZL", "Nicaragua": "NIC", "Nigeria": "NGA", "North Macedonia": "MKD",
    "Norway": "NOR", "Oman": "OMN", "Pakistan": "PAK", "Palestine": "PSE", "Panama": "PAN", "Paraguay": "PRY",
    "Peru": "PER", "Philippines": "PHL", "Poland": "POL", "Portugal": "PRT", "Qatar": "QAT", "Romania": "ROU",
    "Russia": "RUS", "Saudi Arabia": "SAU", "Serbia": "SRB", "Singapore": "SGP", "Slovakia": "SVK",
    "Slovenia": "SVN", "South Africa": "ZAF", "South Korea": "KOR", "Spain": "ESP", "Sri Lanka": "LKA",
    "Sweden": "SWE", "Switzerland": "CHE", "Taiwan": "TWN", "Thailand": "THA", "Tunisia": "TUN",
    "Turkey": "TUR", "Ukraine": "UKR", "United Arab Emirates": "ARE", "United Kingdom": "GBR",
    "United States of America": "USA", "United States": "USA", "Uruguay": "URY", "Uzbekistan": "UZB",
    "Venezuela": "VEN", "Vietnam": "VNM",
}
# Microchip number prefixes.
CHIP_COUNTRIES = {
    "380": "ITA", "250": "FRA", "276": "DEU", "705": "SVN", "203": "CZE", "756": "CHE", "040": "AUT",
    "826": "GBR", "967": "GBR", "941": "AUS", "528": "NLD", "616": "POL", "246": "FIN", "752": "SWE",
    "578": "NOR", "348": "HUN", "191": "HRV", "703": "SVK", "642": "ROU", "100": "BGR", "724": "ESP",
    "620": "PRT", "056": "BEL", "208": "DNK", "372": "IRL", "840": "USA", "124": "CAN", "900": "AUT",
    "985": "ITA", "981": "ITA", "982": "ITA", "688": "SRB",
}
# Countries that can be shown as a flag.
FLAGS = {
    "CZE": "CZ", "GBR": "GB", "DEU": "DE", "FRA": "FR", "AUT": "AT", "POL": "PL", "SWE": "SE", "NOR": "NO",
    "HUN": "HU", "ESP": "ES", "ITA": "IT", "NLD": "NL", "BEL": "BE", "SVK": "SK", "HRV": "HR", "USA": "US",
    "CAN": "CA", "AUS": "AU", "JPN": "JP", "FIN": "FI", "DNK": "DK", "CHE": "CH", "LUX": "LU", "SVN": "SI",
    "ROU": "RO", "PRT": "PT", "IRL": "IE", "BRA": "BR", "MEX": "MX", "ISR": "IL", "RUS": "RU", "UKR": "UA",
    "BGR": "BG", "SRB": "RS", "LTU": "LT", "LVA": "LV", "EST": "EE",
}
# Words that mark a major event.
MAJOR_WORDS = ["world championship", "awc", "european open", "fmbb", "wao", "ifcs"]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FLAG_LETTERS = "".join(chr(0x1F1E6 + i) for i in range(26))


def category_table(spark: SparkSession) -> DataFrame:
    """Mapping table (org, category, mapped)."""
    rows = [(org, cat, size) for org, cats in CATEGORIES.items() for cat, size in cats.items()]
    return spark.createDataFrame(rows, "org string, category string, mapped string")


def map_category(org: Column, category: Column) -> Column:
    """Struct of mapped size and excluded flag for an organization's category."""
    o = F.upper(strip(F.coalesce(org, F.lit(""))))
    o = F.when(o == "", F.lit("FCI")).otherwise(o)
    cat = strip(category)
    inches = o.isin("AKC", "USDAA")
    key = F.when(inches, F.regexp_replace(cat, '^"+|"+$', "")).when(o == "WAO", cat).otherwise(F.upper(cat))
    flat = {f"{a}|{c}": s for a, cats in CATEGORIES.items() for c, s in cats.items()}
    excluded = (o == "AKC") & F.contains(F.lower(cat), F.lit("preferred"))
    mapped = F.when(~excluded, lookup(flat, F.concat(o, F.lit("|"), key)))
    return F.struct(mapped.alias("mapped"), excluded.alias("excluded"))


def canon_size(c: Column) -> Column:
    t = strip(c)
    return lookup(SIZES, t, t)


def canon_discipline(c: Column) -> Column:
    t = strip(c)
    return lookup(DISCIPLINES, t, t)


def canon_bool(c: Column) -> Column:
    """True for the spellings of true."""
    return F.coalesce(strip(c).isin("True", "true", "1", "yes"), F.lit(False))


def canon_eliminated(c: Column) -> Column:
    """True for the spellings of an elimination."""
    return F.coalesce(strip(c).isin("True", "true", "1", "yes", "DIS", "DISQ", "-", "DNS", "DNF", "NP"), F.lit(False))


def country_iso3(c: Column) -> Column:
    """Three-letter country code; unknown values stay."""
    t = strip(c)
    two = F.when(F.regexp_like(t, F.lit(r"^[A-Za-z]{2}$")), lookup(ISO2, F.upper(t)))
    return F.when(F.regexp_like(t, F.lit(r"^[A-Z]{3}$")), t).otherwise(
        F.coalesce(two, lookup(COUNTRY_NAMES, F.lower(t)), t)
    )


def country_from_text(c: Column) -> Column:
    """Country code from free text, empty if none is found."""
    t = strip(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" ")))
    t = strip(F.split(t, " - ", 2)[0])
    t = strip(F.regexp_replace(t, r"(?i)^team\s+", ""))
    t = lookup(TEXT_NAME_ALIASES, t, t)
    lower = {k.lower(): v for k, v in TEXT_COUNTRIES.items()}
    code = F.replace(F.upper(t), F.lit("."), F.lit(""))
    two = F.regexp_like(code, F.lit("^[A-Z]{2}$"))
    three = F.regexp_like(code, F.lit("^[A-Z]{3}$"))
    first = F.upper(F.regexp_extract(t, "[A-Za-z]+", 0))
    by_two = F.when(F.length(first) == 2, lookup(TEXT_ISO2, first))
    alias = lookup(TEXT_CODE_ALIASES, first, first)
    by_three = F.when((F.length(first) == 3) & alias.isin(sorted(set(TEXT_COUNTRIES.values()))), alias)
    # Names are tried from long to short; the first one that occurs as words counts.
    low = F.lower(t)
    inside = F.coalesce(*[
        F.when(F.regexp_like(low, F.lit(rf"\b{name.lower()}\b")), F.lit(TEXT_COUNTRIES[name]))
        for name in sorted(TEXT_COUNTRIES, key=len, reverse=True)
    ])
    return (
        F.when(t == "", "")
        .when(lookup(lower, low).isNotNull(), lookup(lower, low))
        .when(two, lookup(TEXT_ISO2, code, F.lit("")))
        .when(three, lookup(TEXT_CODE_ALIASES, code, code))
        .otherwise(F.coalesce(by_two, by_three, inside, F.lit("")))
    )


def country_from_chip(c: Column) -> Column:
    """Country from the first three digits of a chip number, else from a trailing code."""
    t = strip(F.coalesce(c, F.lit("")))
    tail = F.upper(F.regexp_extract(t, r"\S\s+([A-Za-z]{3})$", 1))
    return F.when(F.length(t) < 3, "").otherwise(lookup(CHIP_COUNTRIES, F.substring(t, 1, 3), tail))


def country_from_licence(c: Column, codes: dict, digits_default: str = "CHE") -> Column:
    """Country from the leading letters of a licence; digits only means the home country."""
    t = F.upper(strip(F.coalesce(c, F.lit(""))))
    letters = F.regexp_extract(t, "^([A-Z]{3})", 1)
    return F.when(letters != "", lookup(codes, letters, F.lit(""))).when(
        F.regexp_like(t, F.lit(r"^\d+$")), digits_default
    ).otherwise("")


def flag_to_iso2(c: Column) -> Column:
    """Two letters of a flag symbol, empty unless there are exactly two (P20)."""
    only = F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\x{1F1E6}-\\x{1F1FF}]", "")
    return F.when(F.length(only) == 2, F.translate(only, FLAG_LETTERS, LETTERS)).otherwise("")


def iso3_to_flag(c: Column) -> Column:
    """Flag symbol of a country code; the code itself if unknown (P20)."""
    two = F.when(F.length(c) == 2, F.upper(c)).when(F.length(c) == 3, lookup(FLAGS, F.upper(c)))
    flag = F.translate(two, LETTERS, FLAG_LETTERS)
    return F.when(c.isNull() | (c == ""), "").otherwise(F.coalesce(flag, c))


def parse_float(c: Column) -> Column:
    """Number with a decimal comma or point, null if it is none."""
    t = F.replace(strip(c), F.lit(","), F.lit("."))
    return F.when(F.regexp_like(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), t.cast("double"))


def parse_int(c: Column) -> Column:
    """Whole number, also from "5.0" (P21)."""
    return parse_float(c).cast("bigint")


def derive_speed(length: Column, time: Column) -> Column:
    """Speed in m/s with two decimals."""
    return F.round(F.when(length != 0, length) / F.nullif(time, F.lit(0.0)), 2)


def derive_time_faults(total: Column, faults: Column, refusals: Column) -> Column:
    """Time faults as the rest of the total, not below zero."""
    return F.when(total.isNotNull() & faults.isNotNull() & refusals.isNotNull(),
                  F.greatest(F.round(total - faults * 5 - refusals * 5, 2), F.lit(0.0)))


def format_date_range(start: Column, end: Column, long: bool = True) -> Column:
    """Label of a date range (P33). ``long`` uses dashes without blanks and drops a repeated year."""
    full = "MMM d, yyyy"
    one = F.date_format(start, full)
    same_year = F.year(start) == F.year(end)
    same_month = same_year & (F.month(start) == F.month(end))
    dash = "–" if long else "-"
    in_month = F.concat(F.date_format(start, "MMM d"), F.lit(dash), F.day(end).cast("string"), F.date_format(start, ", yyyy"))
    label = F.when(end.isNull() | (start == end), one).when(same_month, in_month)
    if long:
        in_year = F.concat(F.date_format(start, "MMM d"), F.lit(dash), F.date_format(end, "MMM d"), F.date_format(start, ", yyyy"))
        return label.when(same_year, in_year).otherwise(F.concat(one, F.lit(dash), F.date_format(end, full)))
    return label.otherwise(F.concat(F.date_format(start, "MMM d"), F.lit(" - "), F.date_format(end, "MMM d, yyyy")))


def is_major(c: Column) -> Column:
    """The name contains a word of a major event."""
    return F.regexp_like(F.lower(c), F.lit("|".join(MAJOR_WORDS)))


def words(c: Column) -> Column:
    return F.size(F.split(squeeze(c), " "))
