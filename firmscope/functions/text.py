"""Names and other short texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide which names are equal.
LEGAL_WORDS = ["llc", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "pc", "pllc", "pa", "lp", "llp", "plc", "gmbh", "the"]
UPPER_WORDS = ["LLC", "PC", "PLLC", "PA", "LLP", "LP", "DDS", "DMD", "MD", "DVM", "II", "III", "IV", "USA", "US", "UK", "CNC", "HVAC"]
FILLER_WORDS = ["and", "the", "of", "a", "an"]
ABBREVIATIONS = {
    "mfg": "manufacturing", "mfr": "manufacturing", "mfrs": "manufacturing", "intl": "international", "svc": "service", "svcs": "service",
    "sys": "system", "tech": "technology", "technologies": "technology", "prods": "product", "assoc": "associates",
}
GENERIC_WORDS = [
    "and", "the", "of", "valve", "valves", "company", "manufacturing", "mfg", "products", "product", "industries", "industrial", "industry",
    "corp", "corporation", "co", "group", "systems", "system", "controls", "control", "usa", "america", "american", "international",
    "division", "llc", "inc", "technologies", "technology", "solutions", "equipment", "supply", "service", "services",
]
COMMON_NAME_WORDS = ["the", "and", "company", "group", "services", "systems", "solutions", "industries", "international", "dental", "clinic", "center", "medical"]
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
BATCH_TAG = r"\s*\((?:[A-Z][0-9]{2}|[A-Z][a-z]+\s[0-9]{4})\)\s*$"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
EMAIL_GONE = "[email removed]"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(text: Column) -> Column:
    r"""The text as a literal inside a pattern; an \E in it can't end the quotation."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def normal_words(name) -> Column:
    """Lower-case ASCII words of a name, "&" as "and", without its batch tag and legal words."""
    plain = F.lower(F.regexp_replace(F.coalesce(_col(name), F.lit("")), BATCH_TAG, ""))
    found = F.regexp_extract_all(F.replace(plain, F.lit("&"), F.lit(" and ")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(LEGAL_WORDS))


def normalize_name(name) -> Column:
    return F.array_join(normal_words(name), " ")


def display_name(name) -> Column:
    """A readable name: only one that is all upper case is recased, word by word."""
    plain = F.regexp_replace(F.trim(F.coalesce(_col(name), F.lit(""))), BATCH_TAG, "")
    parts = F.regexp_extract_all(plain, F.lit("[A-Za-z']+|[^A-Za-z']+"), F.lit(0))
    cased = F.transform(parts, lambda w: F.when(F.upper(w).isin(UPPER_WORDS), F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.when((plain == F.upper(plain)) & (plain != F.lower(plain)), F.array_join(cased, "")).otherwise(plain)


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def region_code(value) -> Column:
    """The two letters of a state by code or full name; other values in upper case; null for none."""
    v = F.nullif(_col(value), F.lit(""))
    return F.coalesce(F.try_element_at(_map(STATES), F.lower(F.trim(v))), F.upper(F.trim(v)))


def name_tokens(name) -> Column:
    """Distinct words for matching: filler dropped, abbreviations written out, then plurals folded."""
    kept = F.filter(normal_words(name), lambda w: ~w.isin(FILLER_WORDS))
    full = F.transform(kept, lambda w: F.coalesce(F.try_element_at(_map(ABBREVIATIONS), w), w))
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.array_distinct(F.transform(full, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def like_literal(text) -> Column:
    """Text that is safe in a remote filter: letters, digits and some marks, upper case."""
    return F.upper(F.trim(F.regexp_replace(_col(text), "[^A-Za-z0-9 &.,'/-]", "")).cast("string"))


def vendor_pattern(name) -> Column:
    """A LIKE pattern of a name's telling words in order, or "" without any."""
    words = F.filter(normal_words(name), lambda w: ~w.isin(GENERIC_WORDS) & (F.length(w) >= 3))
    return F.when(F.size(words) > 0, F.concat(F.lit("%"), F.array_join(F.transform(words, F.upper), "%"), F.lit("%"))).otherwise(F.lit(""))


def distinctive_tokens(name) -> Column:
    return F.array_distinct(F.filter(normal_words(name), lambda w: (F.length(w) >= 4) & ~w.isin(COMMON_NAME_WORDS)))


def plant_name(name, city) -> Column:
    """The name without the city (and plant, facility or site) that filers put at its end; never empty."""
    name, city = _col(name), F.coalesce(_col(city), F.lit(""))
    tail = F.concat(F.lit(r"(?i)[\s\-–,]*\b"), quoted(city), F.lit(r"\b(\s+(plant|facility|site))?\s*$"))
    cut = F.regexp_replace(F.regexp_replace(name, tail, F.lit("")), r"^[ \-–,]+|[ \-–,]+$", "")
    return F.when((city == "") | (cut == ""), name).otherwise(cut)


def title_name(title, domain) -> Column:
    """The part of a page title with most words in the domain's first label; of equals the shortest, then the first."""
    stem = F.replace(F.split_part(_col(domain), F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    parts = F.filter(F.transform(F.split(F.coalesce(_col(title), F.lit("")), r"\s+[|\-–—:]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    inside = lambda p: F.size(F.filter(F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.contains(stem, t)))
    ranked = F.transform(parts, lambda p, i: F.struct((-inside(p)).alias("a"), F.length(p).alias("b"), i.alias("c"), p.alias("p")))
    return F.coalesce(F.array_min(ranked)["p"], F.initcap(stem))


def label_bound(label) -> Column:
    """Upper bound of a size label: its largest number; one less after "less than"; 1e9 for "or more"; null without a number."""
    text = F.lower(_col(label))
    most = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9][0-9,]*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long")))
    return F.when(F.contains(text, F.lit("or more")) & most.isNotNull(), F.lit(1_000_000_000).cast("long")).when(F.contains(text, F.lit("less than")), most - 1).otherwise(most)


def batch_year(batch) -> Column:
    return F.expr("int(null)") if batch is None else F.nullif(F.regexp_extract(_col(batch), "([0-9]{4})", 1), F.lit("")).cast("int")


def redact_emails(text) -> Column:
    return F.regexp_replace(_col(text), "(?U)" + EMAIL, EMAIL_GONE)


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def money(value) -> Column:
    return F.concat(F.lit("$"), F.format_number(_col(value), 0))


def place(city, region, country) -> Column:
    return F.concat_ws(", ", *[F.nullif(_col(c), F.lit("")) for c in (city, region, country)])


def seen_in(name, blob) -> Column:
    """Whether the whole name stands in lower-cased text between other characters than letters and digits."""
    low = F.lower(_col(name))
    return (low != "") & F.rlike(_col(blob), F.concat(F.lit("(?<![a-z0-9])"), quoted(low), F.lit("(?![a-z0-9])")))


def pattern_hits(text, patterns: list[str]) -> Column:
    """The patterns that match somewhere, whatever the case."""
    t = F.coalesce(_col(text), F.lit(""))
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(*[F.when(t.rlike("(?iu)" + p), F.lit(p)).otherwise(none) for p in patterns])) if patterns else F.array().cast("array<string>")


def headings(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1))


def ellipsis(text, most: int = 50) -> Column:
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 2))), F.lit("…"))).otherwise(t)


def tolerant_double(text) -> Column:
    return _col(text).try_cast("double")


def tolerant_int(text) -> Column:
    return _col(text).try_cast("double").cast("double").try_cast("int")


def with_tail(items: Column, most: int) -> Column:
    """The first few joined by commas, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))
