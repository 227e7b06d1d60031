"""Text and parsing column functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that must match for equal results: words that carry no identity in a name, direction
#: words with what they stand for, and tokens that only tell fields of one name apart.
STOPWORDS = [
    "aerodrome", "airfield", "terrain", "ulm", "altisurface", "altiport",
    "de", "du", "des", "la", "le", "les", "sur", "en", "st", "saint",
]
DIRECTIONS = {
    "north": "n", "nord": "n", "n": "n",
    "south": "s", "sud": "s", "sued": "s", "s": "s",
    "east": "e", "est": "e", "e": "e",
    "west": "w", "ouest": "w", "o": "w", "w": "w",
}
NUMBERS = ["1", "2", "3", "4"]
CODE_TOKEN = "^(lf|ls|li)[0-9]*[a-z0-9]{2,4}$"


def clean(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), '^"+|"+$', ""))


def parse_float(c) -> Column:
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def parse_coord(c, is_lat: bool) -> Column:
    """``DDMM.mmmN`` / ``DDDMM.mmmE`` to degrees, else a plain decimal; south and west are negative."""
    d, hemi = (2, "NS") if is_lat else (3, "EW")
    pattern = rf"^(\d{{{d}}})(\d{{2}}\.\d+)([{hemi}])$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    deg = part(1).try_cast("double") + part(2).try_cast("double") / 60
    signed = F.when(part(3).isin("S", "W"), -deg).otherwise(deg)
    return F.when(F.regexp_like(c, F.lit(pattern)), signed).otherwise(parse_float(c))


def format_cup_coord(c, is_lat: bool) -> Column:
    """The inverse, with minutes of three decimals."""
    width, plus, minus = (2, "N", "S") if is_lat else (3, "E", "W")
    total = F.floor(F.abs(c) * 60000 + 0.5).cast("long")
    deg, milli = F.floor(total / 60000), F.pmod(total, F.lit(60000))
    minutes = F.concat(F.lpad(F.floor(milli / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad(F.pmod(milli, F.lit(1000)).cast("string"), 3, "0"))
    return F.concat(F.lpad(deg.cast("string"), width, "0"), minutes, F.when(c < 0, minus).otherwise(plus))


def parse_length_m(c) -> Column:
    """``600m``, ``2000 ft`` to metres; feet are converted; no unit means metres."""
    pattern = r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|ft|feet)?\s*$"
    n = parse_float(F.regexp_extract(F.lower(c), pattern, 1))
    return F.bround(F.when(F.regexp_extract(F.lower(c), pattern, 2).isin("ft", "feet"), n * 0.3048).otherwise(n), 1)


def parse_width_m(c) -> Column:
    """The second number of ``NNN x NN``."""
    return parse_float(F.regexp_extract(c, r"[0-9]{2,4}\s*[xX]\s*([0-9]{1,3})", 1))


def parse_heading_deg(c) -> Column:
    """Runway designators up to 36 stand for tens of degrees; other numbers up to 360 for themselves."""
    n = F.regexp_extract(c, r"(^|[^0-9])([0-9]{1,3})([^0-9]|$)", 2).try_cast("int")
    return F.when(n <= 36, n * 10).when(n <= 360, n)


def ascii_fold(c) -> Column:
    """Letters without their accents; what is not ASCII then goes.

    Spark has no decomposition of characters, so the letters of the Latin blocks are laid side by
    side with their first decomposed character, worked out from Unicode once.
    """
    return F.regexp_replace(F.translate(c, *_folding()), "[^ -~]", "")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    letters = [chr(x) for x in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F))]
    pairs = [(x, d[0]) for x in letters if (d := unicodedata.normalize("NFKD", x))[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(x for x, _ in pairs), "".join(d for _, d in pairs)


def slugify(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: Small letters that several capitals stand for, or that got one in Unicode 16, and the one letter
#: that stands for each where a letter stays a letter: its capital or title form, else itself.
SEVERAL = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x11000)) if len(c.upper()) > 1} | {"\u00df": "\u1e9e"} | {
    c: c for c in "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
}


def upper_each(c: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it; ``upper`` writes a sharp s as two letters."""
    special = "".join(SEVERAL)
    one = lambda p: F.when(F.regexp_like(p, F.lit(f"^[{special}]")), F.translate(p, special, "".join(SEVERAL.values()))).otherwise(F.upper(p))
    apart = F.array_join(F.transform(F.split(c, f"(?<=[{special}])|(?=[{special}])"), one), "")
    return F.when(F.regexp_like(c, F.lit(f"[{special}]")), apart).otherwise(F.upper(c))


#: Spaces of every width, which ``trim`` alone leaves.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trim_spaces(c) -> Column:
    """Without spaces of any width at the ends."""
    return F.btrim(c, F.lit(SPACES))


def match_name(c, strip_directions: bool = False) -> Column:
    """A name as it is compared: folded, lower case, without a leading ordinal, codes and stopwords."""
    low = F.regexp_replace(F.lower(ascii_fold(c)), "^#?[0-9]+[ ]+", "")
    drop = STOPWORDS + (list(DIRECTIONS) + NUMBERS if strip_directions else [])
    words = F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(drop) & ~F.regexp_like(w, F.lit(CODE_TOKEN))), " ")


def direction_tokens(c) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    words = F.split(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: alias[w]), lambda w: w.isNotNull())))


def directions_conflict(a, b) -> Column:
    x, y = direction_tokens(a), direction_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def words(c) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def token_jaccard(a, b) -> Column:
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def mine_frequencies(c) -> Column:
    """Distinct radio frequencies between 118 and 137 MHz in a text, ascending."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![0-9])(1[1-3][0-9][.,][0-9]{1,3})(?![0-9])"), F.lit(1))
    mhz = F.transform(found, lambda s: F.regexp_replace(s, ",", ".").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(mhz, lambda x: x.between(118, 137))))


#: What a frequency is for, the first of these that stands near it.
FREQ_LABELS = ["AFIS", "TWR", "TOUR", "A/A", "AUTO", "INFO", "APP", "ATIS", "ATF", "CTAF", "UNICOM"]


def labelled_frequencies(c, near: int = 24) -> Column:
    """Radio frequencies of a text as ``array<struct<mhz, type>>``, each once, in the order they stand.

    A label is looked for in the ``near`` characters before and after; empty without one. What lies
    before a frequency is caught by a look-behind that starts that far back, or at the text's start;
    it is only tried where a frequency follows, as it tries every length.
    """
    pattern = rf"(?s)(?<![0-9])(?=1[1-3][0-9][.,][0-9])(?<=(^.{{0,{near}}}|.{{{near}}}))(1[1-3][0-9][.,][0-9]{{1,3}})(?![0-9])(?=(.{{0,{near}}}))"
    before, number, after = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))

    def entry(x) -> Column:
        around = F.upper(F.concat(x["b"], x["n"], x["a"]))
        kind = F.coalesce(*[F.when(F.contains(around, F.lit(label)), label) for label in FREQ_LABELS], F.lit(""))
        return F.struct(F.regexp_replace(x["n"], ",", ".").try_cast("double").alias("mhz"), kind.alias("type"))

    zipped = F.arrays_zip(before.alias("b"), number.alias("n"), after.alias("a"))
    inside = F.filter(F.transform(zipped, entry), lambda x: x["mhz"].between(118, 137))
    # as the one element of an array, the list is worked out once and not again for each of its entries
    once = lambda found: F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["mhz"]), x["mhz"]) == i + 1)
    return F.get(F.transform(F.array(inside), once), 0)


def format_freq(mhz, kind) -> Column:
    label = F.when(F.regexp_like(kind, F.lit("^[0-9]+$")) | F.upper(kind).isin("OTHER", "UNKNOWN", "N/A", "NA", ""), F.lit(None)).otherwise(kind)
    return F.concat_ws(" ", F.format_string("%.3f", mhz), label)


def difficulty_label(c) -> Column:
    up = F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[{}]", "")))
    return F.when(up.isin("A", "B", "C", "D"), up).when(up.isin("UNKNOWN", ""), "?").otherwise(F.lower(up))


def unescape(c) -> Column:
    """Character references resolved, each once: the named ones of HTML 4, decimal and hexadecimal ones.
    Unknown names stay as they are."""
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    parts = F.regexp_extract_all(c, F.lit(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]++|&"), F.lit(0))

    def char(number: Column) -> Column:
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def one(x: Column) -> Column:
        body = F.regexp_extract(x, "^&(.*);$", 1)
        decimal = F.regexp_extract(body, r"^#(\d+)$", 1).try_cast("long")
        hexa = F.conv(F.nullif(F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]+)$", 1), F.lit("")), 16, 10).cast("long")
        number = F.coalesce(decimal, hexa)
        return F.when(number.isNotNull(), char(number)).otherwise(F.coalesce(F.try_element_at(names, body), x))

    return F.array_join(F.transform(parts, one), "")


def _untagged(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")


def strip_html(c) -> Column:
    """A page without tags, six common references resolved, white space single."""
    s = _untagged(c)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return norm_space(s)


def page_text(c) -> Column:
    """The text of a page: scripts, styles and tags go, all character references are resolved."""
    return unescape(_untagged(c))


def norm_space(c) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def extract_codes(c, pattern: str = r"\b(L[FSO][A-Z]{2})\b") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(pattern), F.lit(1))))


#: Names of countries that the first two letters would get wrong, and media files.
COUNTRY_NAMES = {
    "FRANCE": "FR", "SWITZERLAND": "CH", "SCHWEIZ": "CH", "SUISSE": "CH", "ITALY": "IT", "ITALIA": "IT",
    "SPAIN": "ES", "ESPAÑA": "ES", "ESPANA": "ES", "ESPAGNE": "ES",
}
MEDIA_FILES = r"(?i)\.(jpg|jpeg|png|webp|pdf)$"
MINTED = r"_M?\d+P\d+_M?\d+P\d+$"


#: How the codes of a country's places begin.
ICAO_PREFIXES = {"FR": ["LF"], "CH": ["LS"], "IT": ["LI"], "ES": ["LE", "GC", "GE"]}


def country_from_icao(c) -> Column:
    """The country whose codes begin like this one; empty where none does."""
    begins = [(land, F.startswith(F.upper(clean(c)), F.lit(p))) for land, prefixes in ICAO_PREFIXES.items() for p in prefixes]
    return F.coalesce(*[F.when(hit, land) for land, hit in begins], F.lit(""))


def is_country_icao(c, countries: list[str]) -> Column:
    """Whether a code of four characters is one of these countries'."""
    return F.regexp_like(F.upper(clean(c)), F.lit("^[A-Z0-9]{4}$")) & country_from_icao(c).isin([x.upper() for x in countries])


def norm_country(c) -> Column:
    """A country's code from its code or name."""
    up = F.upper(clean(c))
    names = F.create_map(*[F.lit(x) for kv in COUNTRY_NAMES.items() for x in kv])
    return F.coalesce(names[up], F.substring(up, 1, 2))


def display_code(c) -> Column:
    """A code as shown: one that was made from a position is not."""
    return F.when(F.regexp_like(c, F.lit(MINTED)), "").otherwise(F.coalesce(c, F.lit("")))


def media_refs(c) -> Column:
    """Base names of the media files listed in a text."""
    parts = F.filter(F.split(c, r"[;|,\s]+"), lambda x: F.regexp_like(x, F.lit(MEDIA_FILES)))
    return F.transform(parts, lambda x: F.substring_index(F.replace(x, F.lit("\\"), F.lit("/")), "/", -1))


#: What a tag of a guide says about a field, and the tags of places made for aircraft.
GRADES = {
    "aerodrome": "A", "terrain": "A", "altiport": "A", "velisurface": "A", "facile": "A",
    "normal": "B", "difficile": "C", "tres_difficile": "D",
}
AIRFIELD_TAGS = ["aerodrome", "terrain", "altiport", "velisurface"]
#: Particles that are not capitalised inside a name.
PARTICLES = ["de", "du", "des", "la", "le", "les", "sur", "en", "au", "aux", "d", "l"]


def raw_difficulty(tagged, style) -> Column:
    """The first known ``{tag}`` of a text; without one, style 5 stands for an aerodrome."""
    tags = F.transform(F.regexp_extract_all(tagged, F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda t: F.lower(F.trim(t)))
    known = F.filter(tags, lambda t: t.isin(list(GRADES)))
    return F.coalesce(F.get(known, 0), F.when(clean(style) == "5", "aerodrome"), F.lit("unknown"))


def grade(raw) -> Column:
    """The grade of a raw difficulty, A to D or UNKNOWN."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])[raw], F.lit("UNKNOWN"))


def site_kind(raw, code) -> Column:
    return F.when(raw.isin(AIRFIELD_TAGS) | F.regexp_like(F.upper(F.coalesce(code, F.lit(""))), F.lit("^LF[A-Z]{2}$")), "airfield").otherwise("outlanding")


def strip_tags(notes) -> Column:
    return F.trim(F.regexp_replace(notes, r"\s*\{[^}]+\}\s*", " "))


def clean_display_name(c) -> Column:
    """A name as it is shown: without ordinals and codes around it, particles small, words capitalised."""
    s = F.trim(F.regexp_replace(clean(c), r"^(?:#?\d+\s+)+", ""))
    s = F.trim(F.regexp_replace(s, r"^(?:LF|LS|LI)[A-Z0-9]{2,4}\b\s+(?=\S)", ""))
    s = F.trim(F.regexp_replace(s, r"(?i)\s+\b(?:LF|LS|LI)[A-Z0-9]{2,4}\b\s*$", ""))
    pieces = F.regexp_extract_all(s, F.lit(r"(\s+|-|[^\s-]+)"), F.lit(1))
    words = F.zip_with(pieces, F.sequence(F.lit(0), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    plain = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000)))

    def shown(x) -> Column:
        w = x["w"]
        even = (w == F.upper(w)) | (w == F.lower(w)) | (w == plain(w))
        return (
            F.when(F.regexp_like(w, F.lit(r"^(\s+|-)$")), w)
            .when(F.lower(w) == "sued", "Sud")
            .when(F.lower(w).isin(PARTICLES) & (x["i"] > 0), F.lower(w))
            .when(even, plain(w))
            .otherwise(w)
        )

    return F.array_join(F.transform(words, shown), "")


def safe_filename(c) -> Column:
    """The last part of a path with nothing in it that a file system could mind."""
    return F.regexp_replace(F.substring_index(c, "/", -1), "[^a-zA-Z0-9._-]+", "_")


def rewrite_phrases(c, rules: list[tuple[str, str]], hint: str | None = None) -> Column:
    """A text with patterns replaced in their order, whatever the case; with a ``hint``, only texts
    that match it (they are in the rules' language, it seems) are touched."""
    out = c
    for pattern, by in rules:
        out = F.regexp_replace(out, f"(?iu){pattern}", by)
    return out if hint is None else F.when(F.regexp_like(c, F.lit(f"(?iu){hint}")), out).otherwise(c)


def stamp_chart_keys(media, prefix: str = "") -> Column:
    """Media (structs with ``url``) with a ``chart_key``: what follows ``docs/`` in a chart's address; null for others."""
    key = lambda u: F.nullif(F.regexp_extract(clean(u), r"(?i)(?:^|/)docs/(vac/[^/]+\.pdf)$", 1), F.lit(""))
    return F.transform(media, lambda m: m.withField("chart_key", F.concat(F.lit(prefix), key(m["url"]))))


def share_media_urls(media, root: str = "../_shared/", columns: tuple[str, ...] = ("url", "thumbnail_url")) -> Column:
    """Media whose relative addresses lead to the shared folder; absolute and shared ones stay, so twice is once."""

    def moved(u) -> Column:
        own = (clean(u) != "") & ~F.contains(u, F.lit("://")) & ~F.startswith(clean(u), F.lit(root))
        return F.when(own, F.concat(F.lit(root), clean(u))).otherwise(u)

    def item(m) -> Column:
        for name in columns:
            m = m.withField(name, moved(m[name]))
        return m

    return F.transform(media, item)


def longest_strip(c) -> Column:
    """``struct(length_m, width_m)`` of the longest of strips ``600 m x 50 m / 430 x 25 m``, the first of equals; null without any."""
    pattern = r"(\d+)\s*(?:m\s*)?(?:[x×]\s*(\d+)\s*m?)?"

    def strip(s, i) -> Column:
        part = lambda n: F.regexp_extract(s, pattern, n).try_cast("double")
        return F.struct(part(1).alias("length_m"), (-i).alias("at"), part(2).alias("width_m"))

    best = F.array_max(F.filter(F.transform(F.split(c, "/"), strip), lambda x: x["length_m"].isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["length_m"].alias("length_m"), best["width_m"].alias("width_m")))


def extract_record(c) -> Column:
    """A landing site's record in the text of one page of a printed guide, as a struct; null without its heading.

    Notes in the margin, ten blanks or more to the right, are cut off. Labels begin a line, the first
    of a kind counts; remarks run to the next blank line, without radio frequencies.
    """
    body = F.regexp_replace(c, r"(?m)[ \t]{10,}[^\r\n]*$", "")
    header = r"(?m)^([EF]\d{1,2})\s*/\s*(AERO|ULM|CHAMPS?)\s*[–-]\s*(.+)$"
    head = lambda i: F.trim(F.regexp_extract(body, header, i))
    line = lambda label: F.trim(F.regexp_extract(body, rf"(?m)^[ \t]*{label}[ \t]*:[ \t]*(.*)$", 1))
    place = r"N\s*(\d{1,2})°\s*(\d{1,2}),(\d{1,3})['’]?\s*[–-]\s*([EW])\s*(\d{1,3})°\s*(\d{1,2}),(\d{1,3})"
    at = lambda i: F.regexp_extract(line("Position"), place, i)
    degrees = lambda d, m, f: at(d).try_cast("double") + F.concat(at(m), F.lit("."), at(f)).try_cast("double") / 60
    lon = degrees(5, 6, 7)
    told = norm_space(F.regexp_extract(body, r"(?ms)^[ \t]*Observations[ \t]*:[ \t]*(.*?)(?:\r?\n[ \t]*\r?\n|\z)", 1))
    remarks = F.regexp_replace(told, r"(?:\b[A-Z]{4}\s*-\s*)?Fréq\.?\s*=?\s*[\d.,]+(?:\s*/\s*[\d.,]+)*\s*MHz\.?\s*", "")
    size = longest_strip(line("Longueur"))
    record = F.struct(
        head(1).alias("id"), head(2).alias("type"), head(3).alias("name"),
        F.regexp_extract(told, r"\b(L[EF][A-Z]{2})\s*-\s*(?=Fréq)", 1).alias("code"),
        degrees(1, 2, 3).alias("lat"), F.when(at(4) == "W", -lon).otherwise(lon).alias("lon"),
        F.regexp_extract(line("Altitude"), r"(\d+)\s*m", 1).try_cast("int").alias("elev_m"),
        F.transform(F.regexp_extract_all(line("Orientation"), F.lit(r"(\d{1,3})\s*°"), F.lit(1)), lambda d: d.try_cast("int")).alias("directions"),
        size["length_m"].alias("length_m"), size["width_m"].alias("width_m"),
        norm_space(line("État surface")).alias("surface"), norm_space(remarks).alias("remarks"),
    )
    return F.when(head(1) != "", record)
