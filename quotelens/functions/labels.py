"""Identifiers, references and display texts of findings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelens.functions.profiles import INVISIBLE, SPACES, squeeze

COLORS = ("red", "yellow", "orange", "lightBlue", "green")


def content_of_brace(text: Column) -> Column:
    return squeeze(F.translate(text, "\0", " "))


def normal_for_id(text: Column) -> Column:
    squeezed = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\0", " "), SPACES, " ")
    return F.trim(F.regexp_replace(squeezed, r"[\p{Punct}،؛؟«»“”‘’﴾﴿…]", ""))


def fnv1a32(text: Column) -> Column:
    """The 32-bit FNV-1a hash over UTF-16 units, in hexadecimal. Its offset and prime are fixed values."""
    units = F.filter(F.transform(F.split(text, ""), lambda c: F.when(F.length(c) > 0, F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))), lambda u: u.isNotNull())
    step = lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step)), 8, "0"))


def finding_id(text: Column, claimed: Column, matched: Column, path: Column) -> Column:
    key = F.concat_ws("|", normal_for_id(text), F.coalesce(claimed, F.lit("")), F.coalesce(matched, F.lit("")), F.coalesce(path, F.lit("")))
    return F.concat(fnv1a32(key), F.lit("-"), F.lower(F.conv(F.length(key).cast("string"), 10, 36)))


# What changes in a context between visits (relative times, presence, unread counts; times of day stay, since they tell equal messages apart).
VOLATILE = (
    r"(?i)\b\d+\s*(?:seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s*ago\b",
    r"(?i)\bjust\s*now\b",
    r"(?i)\b(?:yesterday|today)\b",
    r"(?i)\b(?:online|offline|typing\.{0,3}|last\s+seen\s+[^.\n]{0,40})\b",
    r"(?i)\b\d+\s*(?:new|unread)\b",
)


def scrub_volatile(text: Column) -> Column:
    for pattern in VOLATILE:
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def bare_ref(ref: Column) -> Column:
    return squeeze(F.regexp_replace(ref, r"[\[\](){}«»﴿﴾]", ""))


def group_of_ref(ref: Column) -> Column:
    return F.trim(F.regexp_extract(bare_ref(ref), r"^(.*)[:：][^:：]*$", 1))


def corrected_ref(old: Column, new: Column) -> Column:
    """The new reference in the brackets of the old one."""
    opens, closes = F.regexp_extract(old, r"^\s*([\[({«﴿]?)", 1), F.regexp_extract(old, r"([\])}»﴾]?)\s*$", 1)
    return F.concat(opens, bare_ref(new), closes)


def reference_text(name: Column, first: Column, last: Column | None = None) -> Column:
    last = first if last is None else last
    return F.concat(F.lit("("), name, F.lit(":"), first.cast("string"), F.when(last > first, F.concat(F.lit("-"), last.cast("string"))).otherwise(F.lit("")), F.lit(")"))


def ref_link(base: str, group: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), group.cast("string"), F.lit("/"), first.cast("string"), F.when(last > first, F.concat(F.lit("-"), last.cast("string"))).otherwise(F.lit("")))


def url_key(url: Column) -> Column:
    """A URL without its fragment, parameters in order."""
    whole = F.regexp_replace(url, r"#.*$", "")
    base, query = F.regexp_extract(whole, r"^[^?]*", 0), F.regexp_extract(whole, r"\?(.*)$", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(base, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(F.lit("")))


def text_fragment(text: Column, limit: int = 300) -> Column:
    encoded = F.replace(F.url_encode(F.substring(squeeze(text), 1, limit)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("#:~:text="), F.replace(encoded, F.lit("-"), F.lit("%2D")))


def escaped(text: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def diff_html(diff: Column) -> Column:
    """diff: array of (op, cited, authentic)."""
    segment = lambda d: (
        F.when(d["op"] == "keep", escaped(d["cited"]))
        .when(d["op"] == "sub", F.concat(F.lit("<del>"), escaped(d["cited"]), F.lit("</del> <ins>"), escaped(d["authentic"]), F.lit("</ins>")))
        .when(d["op"] == "extra", F.concat(F.lit("<del>"), escaped(d["cited"]), F.lit("</del>")))
        .otherwise(F.concat(F.lit("<ins>"), escaped(d["authentic"]), F.lit("</ins>")))
    )
    return F.array_join(F.transform(diff, segment), " ")


def tooltip(verdict: Column, matched: Column, claimed: Column) -> Column:
    matched, claimed = F.coalesce(bare_ref(matched), F.lit("")), F.coalesce(bare_ref(claimed), F.lit(""))
    return (
        F.when(verdict == "green", F.format_string("Verified: %s", claimed))
        .when(verdict == "lightBlue", F.format_string("Verified without a reference: %s", matched))
        .when(verdict == "yellow", F.format_string("Wording differs from %s", matched))
        .when(verdict == "orange", F.format_string("Cited as %s, found at %s", claimed, matched))
        .when(verdict == "red", F.lit("Not found in the canon"))
    )


def severity(verdict: Column) -> Column:
    """3 for red, 2 for yellow, 1 for orange, else 0."""
    return F.when(verdict == "red", 3).when(verdict == "yellow", 2).when(verdict == "orange", 1).otherwise(0)


def in_claimed_spelling(matched: Column, claimed: Column, form) -> Column:
    """The matched reference with its group's name as the claim writes it, if both are one name in comparison form."""
    name = F.trim(F.regexp_extract(bare_ref(claimed), r"^([^:：]*)[:：]", 1))
    own, number = F.regexp_extract(matched, r"^([^:：]*)[:：]", 1), F.regexp_extract(matched, r"^[^:：]*[:：]\s*(.*)$", 1)
    return F.when((name != "") & (form(name) == form(own)), F.concat(name, F.lit(":"), number)).otherwise(matched)


def verdict_of_tier(tier: Column) -> Column:
    """What a suggestion's tier says of the text that it was asked for."""
    return F.when(tier == 0, "green").when(tier == 1, "yellow").when(tier.isNotNull(), "red")
