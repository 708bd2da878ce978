"""Citations, designations and numbers of laws as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import roman

#: Fixed value: the year since which the gazette has parts.
PARTS_SINCE = 1997


#: An organ's series, its part, and the number with its year, out of ``BGBl. I Nr. 84/2001`` and the like.
_CITATION = r"(?i)^\s*(\p{L}+)\D*?(?:\s(I{1,3})\b\D*)?(\d+)(?:/(\d{4}))?\s*$"


def citation(organ: Column, number: Column) -> Column:
    """Struct (series, part, number, year) of a citation, its part and year null where it has none."""
    field = lambda i: F.nullif(F.regexp_extract(F.concat_ws(" ", organ, number), _CITATION, i), F.lit(""))
    return F.struct(F.lower(field(1)).alias("series"), F.lower(field(2)).alias("part"), field(3).alias("number"), field(4).try_cast("int").alias("year"))


def dated(cited: Column) -> Column:
    """A citation with the part that its year implies: the gazette's first part where it was left out, none before it had parts."""
    implied = F.when(cited["year"] >= PARTS_SINCE, F.coalesce(cited["part"], F.lit("i")))
    return cited.withField("part", F.when((cited["series"] == "bgbl") & cited["year"].isNotNull(), implied).otherwise(cited["part"]))


def same(x: Column, y: Column) -> Column:
    """Whether two structs of ``citation`` are one citation; what is none is equal to nothing."""
    return x.eqNullSafe(y) & x["number"].isNotNull()


def same_exact(a: Column, a_number: Column, b: Column, b_number: Column) -> Column:
    """Same series, part, number and year: the strictest rule."""
    return same(citation(a, a_number), citation(b, b_number))


def same_stored(stored: Column, stored_number: Column, cited: Column, cited_number: Column) -> Column:
    """A citation against a stored one that names its part exactly."""
    return same(citation(stored, stored_number), dated(citation(cited, cited_number)))


def same_cited(a: Column, a_number: Column, b: Column, b_number: Column) -> Column:
    """Two texts' citations, each completed by the part that the other names."""
    x, y = citation(a, a_number), citation(b, b_number)
    return same(x.withField("part", F.coalesce(x["part"], y["part"])), y.withField("part", F.coalesce(y["part"], x["part"])))


def expanded(span: Column) -> Column:
    """Designations of a span: ``5 bis 8`` gives 5, 6, 7, 8; ``7a bis 7c`` gives 7a, 7b, 7c; ``3 und 9`` both; anything else itself.

    A span runs over numbers, or over letters of one number; backwards or mixed ones are not expanded.
    """
    ends = r"^(\d+)([a-z]?)\s*(?:bis|–|-)\s*(\d+)([a-z]?)$"
    part = lambda i: F.regexp_extract(F.trim(span), ends, i)
    n1, l1, n2, l2 = part(1).try_cast("int"), part(2), part(3).try_cast("int"), part(4)
    numbers = F.transform(F.sequence(n1, F.greatest(n1, n2)), lambda i: i.cast("string"))
    letters = F.transform(F.sequence(F.ascii(l1), F.greatest(F.ascii(l1), F.ascii(l2))), lambda i: F.concat(n1.cast("string"), F.char(i)))
    one = F.split(F.trim(span), r"\s*(?:,|\bund\b)\s*")
    return F.when(n1.isNull() | (n2 < n1), one).when((l1 == "") & (l2 == "") & (n1 <= n2), numbers).when((l1 != "") & (l2 != "") & (n1 == n2) & (l1 <= l2), letters).otherwise(one)


def short_title(name: Column) -> Column:
    """A title's name before its year and its list of amended laws: what stands before a comma, ``und`` or a year at the end."""
    cut = F.regexp_replace(F.trim(name), r"\s*[,;(–].*$", "")
    return F.regexp_replace(F.regexp_replace(cut, r"\s+(?:und|sowie)\s+.*$", ""), r"\s+\d{4}$", "")


def record_class(title: Column) -> Column:
    """gesetz, verordnung or other, by the words of a record's title; an ordinance to a law is an ordinance."""
    low = F.lower(title)
    return F.when(low.rlike("verordnung|ordinance"), "verordnung").when(low.rlike("gesetz|\\bact\\b|\\blaw\\b"), "gesetz").otherwise("other")


def grouped_number(n: Column) -> Column:
    """A whole number with a point every three digits."""
    return F.translate(F.format_number(n, 0), ",", ".")


def counted_label(n: Column, one: str, many: str) -> Column:
    """``1 <one>`` or ``n <many>``."""
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(grouped_number(n), F.lit(f" {many}")))


def percent_of(part: Column, whole: Column) -> Column:
    """Whole percent, half up; never 0 for some or 100 for not all; null without a whole."""
    exact = F.floor(100 * part / whole + 0.5).cast("long")
    return F.when(whole > 0, F.when((part > 0) & (exact == 0), 1).when((part < whole) & (exact == 100), 99).otherwise(exact))


def percent_position(value: Column, low: Column, high: Column) -> Column:
    """Where a value stands between two ends, as 0 to 100, clipped; the middle where the ends meet."""
    return F.when(high == low, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100.0 * (value - low) / (high - low), 1))))


def day_label(day: Column) -> Column:
    """``5. 1. 2024``."""
    return F.concat_ws(". ", F.dayofmonth(day).cast("string"), F.month(day).cast("string"), F.year(day).cast("string"))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes in 64 bits, as 16 hex digits.

    The product with the 64-bit prime is a shift and a product with a small number, both wrapping; done in two halves so that
    no product leaves a long.
    """
    low32 = (1 << 32) - 1
    begin = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        mixed = h["lo"].bitwiseXOR(byte)
        # The prime is 2**40 + 0x1B3.
        low = mixed * 0x1B3
        high = h["hi"] * 0x1B3 + F.shiftright(low, 32) + F.shiftleft(mixed, 8)
        return F.struct(high.bitwiseAND(F.lit(low32)).alias("hi"), low.bitwiseAND(F.lit(low32)).alias("lo"))

    hashed = F.when(F.octet_length(text) > 0, F.aggregate(octets, begin, step)).otherwise(begin)
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.concat(half(hashed["hi"]), half(hashed["lo"]))


#: Quotation marks, which no search honours.
QUOTES = "\"'„“”‚‘’»«›‹"


def search_terms(raw: Column, most: int = 6) -> Column:
    """Terms (text, prefix) of a search: the first ``most`` different words of two characters or more; a star at the end asks for words that begin so."""
    asked = F.regexp_extract_all(F.translate(F.lower(raw), QUOTES, ""), F.lit(r"(?<!\S)\S*[^\s*]{2}\*?(?!\S)"), F.lit(0))
    texts = F.transform(asked, lambda w: F.regexp_extract(w, r"^(.*?)\*?$", 1))
    first = F.transform(F.array_distinct(texts), lambda t: F.element_at(asked, F.array_position(texts, t).cast("int")))
    return F.slice(F.transform(first, lambda w: F.struct(F.regexp_extract(w, r"^(.*?)\*?$", 1).alias("text"), w.endswith("*").alias("prefix"))), 1, most)


def within_caps(raw: Column, chars: int = 1000, words: int = 100) -> Column:
    """Whether a search is within the lists' caps; beyond them it finds nothing."""
    return (F.length(raw) <= chars) & (F.size(F.filter(F.split(raw, r"[^\p{L}\p{N}]+"), lambda w: w != "")) <= words)


def cited_item(kind: str, citation: Column, period: Column) -> Column:
    """``RV 525 BlgNR 28. GP`` of ``525 d.B.`` and a Roman period; null where either is something else."""
    number = F.regexp_extract(F.trim(citation), r"^(\d+)\s*d\.\s*B\.?$", 1)
    value = roman(period)
    return F.when((number != "") & value.isNotNull(), F.concat(F.lit(f"{kind} "), number, F.lit(" BlgNR "), value.cast("string"), F.lit(". GP")))


def cited_draft(citation: Column, period: Column) -> Column:
    """``Ministerialentwurf 115/ME XXVIII. GP``."""
    return F.concat(F.lit("Ministerialentwurf "), citation, F.lit(" "), period, F.lit(". GP"))


def name_rank(name: Column, full: str, token: str, not_with: str) -> Column:
    """How firmly a document's name says what it is: 2 for the full word, 1 for its abbreviation as a token of a name that is no bundle, else 0."""
    return F.when(name.rlike(f"(?i){full}"), 2).when(name.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}]){token}(?![\p{{L}}\p{{N}}])") & ~name.rlike(f"(?i){not_with}"), 1).otherwise(0)
