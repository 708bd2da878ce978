"""Text functions as Column expressions: folding, search, display, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marked letters and what they fold to, in natural order.
_MARKED = "àáâãåçèéêëìíîïñòóôõøùúûýÿ"
_PLAIN = "aaaaaceeeeiiiinooooouuuyy"
#: The named character references that are decoded.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Search form: lower case, umlauts and their digraphs to the bare vowel, marks off, everything else to single spaces."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    bare = F.translate(F.replace(F.translate(lower, "äöü", "aou"), F.lit("ß"), F.lit("ss")), _MARKED, _PLAIN)
    for digraph, vowel in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        bare = F.replace(bare, F.lit(digraph), F.lit(vowel))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Blank-separated tokens without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def matches_all(haystack: Column, query: str) -> Column:
    """AND of the query's tokens as substrings, in the raw lower-cased or in the folded reading.

    A query without a searchable token matches everything; a null haystack is empty.
    """
    raw = [w for w in query.lower().split() if any(c.isalnum() for c in w)]
    if not raw:
        return F.lit(True)
    plain, folded = F.lower(F.coalesce(haystack, F.lit(""))), fold(haystack)
    by_raw, by_fold = F.lit(True), F.lit(True)
    for w in raw:
        by_raw = by_raw & F.contains(plain, F.lit(w))
        by_fold = by_fold & F.contains(folded, fold(F.lit(w)))
    return by_raw | by_fold


def haystack(*parts: Column) -> Column:
    """Searchable text of several columns; nulls are skipped."""
    return F.concat_ws(" ", *parts)


def title_tokens(title: Column, stop_words: list[str], least: int = 2) -> Column:
    """Lower-cased distinct words of a title without stop words and short ones, in order."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^\\p{L}\\p{N}§]+", " "), " ")
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w)))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` lower-cased letter/digit/§ words; a shorter text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}§]+"), lambda w: w != "")
    return _let(words, lambda ws: F.when(F.size(ws) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.array_join(F.slice(ws, i, width), " ")))).otherwise(F.array().cast("array<string>")))


def run_hashes(text: Column, width: int = 5) -> Column:
    """64-bit hashes of the distinct ``shingles`` of a text: the words are hashed, no run is ever put together."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}§]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.when(F.size(h) >= width, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))).otherwise(F.array().cast("array<bigint>")))


def html_text(html: Column) -> Column:
    """Text of an HTML page: comments, scripts and styles out, tags to spaces, entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_links(html: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), 1)


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def guarded_url(url: Column, hosts: list[str] | None = None) -> Column:
    """The URL as https if it is http(s), has a host and, if given, the host is allowed; else null."""
    host = url_host(url)
    ok = F.coalesce(url, F.lit("")).rlike("(?i)^https?://") & (host != "")
    if hosts is not None:
        ok = ok & host.isin(hosts)
    return F.when(ok, F.regexp_replace(url, "(?i)^http://", "https://"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://([^/?#:]+)", 1))


def snippet(text: Column, needle: str, radius: int = 90) -> Column:
    """The first hit with ``radius`` characters around it, cut at word borders, an ellipsis where text is missing; null without a hit."""
    at = F.locate(needle.lower(), F.lower(text))
    begin = F.greatest(at - radius, F.lit(1))
    end = F.least(at + len(needle) + radius - 1, F.length(text))
    cut = F.substring(text, begin, end - begin + 1)
    # A word is cut only if the character beyond the border goes on with it.
    head = F.when(F.substring(text, begin - 1, F.lit(1)).rlike(r"\s"), cut).otherwise(F.regexp_replace(cut, r"^\S*\s", ""))
    cut = F.when(begin > 1, F.concat(F.lit("…"), F.ltrim(head))).otherwise(cut)
    tail = F.when(F.substring(text, end + 1, F.lit(1)).rlike(r"\s"), cut).otherwise(F.regexp_replace(cut, r"\s\S*$", ""))
    cut = F.when(end < F.length(text), F.concat(F.rtrim(tail), F.lit("…"))).otherwise(cut)
    return F.when(at > 0, cut)


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut before a blank where there is one, with an ellipsis."""
    head = F.regexp_extract(text, rf"(?s)^.{{0,{most - 1}}}(?=\s)", 0)
    return F.when(F.length(text) <= most, text).when(head != "", F.concat(F.rtrim(head), F.lit("…"))).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def typographic(text: Column) -> Column:
    """One form for invisible characters, quotes, dashes and blanks."""
    out = F.regexp_replace(text, "[\\u00AD\\u200B\\u200C\\u200D\\uFEFF]", "")
    out = F.regexp_replace(out, "[„“”«»]", '"')
    out = F.regexp_replace(out, "[‚‘’]", "'")
    out = F.regexp_replace(out, "[–—−]", "-")
    return F.trim(F.regexp_replace(out, "[\\s\\u00A0]+", " "))


def compare_key(text: Column) -> Column:
    """Equality key: typographic form without blanks and hyphens, but a hyphen before a number stays."""
    return F.regexp_replace(F.regexp_replace(typographic(text), r"-(?!\d)", ""), r"\s+", "")


def same_wording_key(text: Column) -> Column:
    """Equality key of the words alone: punctuation goes unless it stands between digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(typographic(text)), r"(?<!\d)[^\p{L}\p{N}\s§]|[^\p{L}\p{N}\s§](?!\d)", " "), r"\s+", " "))


def xml_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def ics_escape(text: Column) -> Column:
    for char, name in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def designation(text: Column) -> Column:
    """The number of a paragraph heading: ``§ 285b.`` gives ``285b``; null without one."""
    return F.nullif(F.regexp_extract(text, r"§+\s*(\d+[a-z]*)", 1), F.lit(""))


def natural_order(identifier: Column) -> list[Column]:
    """Sort keys under which 22 comes before 197 and 285b before 285c."""
    return [F.regexp_extract(identifier, r"^\d*", 0).try_cast("int"), identifier]


def roman(text: Column) -> Column:
    """Value of a Roman numeral from I to MMMCMXCIX; null for anything else."""
    value = F.create_map(*[x for k, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in (F.lit(k), F.lit(v))])
    digits = F.transform(F.split(text, ""), lambda c: F.coalesce(value[c], F.lit(0)))
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, d: F.struct((s["sum"] + d - F.when(s["last"] < d, 2 * s["last"]).otherwise(0)).alias("sum"), d.alias("last")))["sum"]
    return F.when(text.rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


#: How a decimal digit is written in each place.
_ROMAN = (["", "M", "MM", "MMM"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])


def to_roman(number: Column) -> Column:
    """Roman numeral of a whole number from 1 to 3999; null for anything else."""
    digit = lambda place, power: F.element_at(F.array(*map(F.lit, place)), (F.floor(number / power) % 10 + 1).cast("int"))
    return F.when(number.between(1, 3999), F.concat(*[digit(place, 10 ** (3 - i)) for i, place in enumerate(_ROMAN)]))


def citations(text: Column) -> Column:
    """Cited numbers of the form ``12/1999`` or ``2011/92``, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{1,4}/\d{2,4})\b"), 1))


def decoded(data: Column, charset: str) -> Column:
    """Bytes as text: UTF-8 where valid, else the given charset."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, charset))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits, as bigint."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


def fingerprint(values: Column) -> Column:
    """One hash for a set of strings: order and repeats do not matter."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), " "), 256)
