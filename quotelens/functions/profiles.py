"""What depends on the script of a corpus: how text is normalised, and which letters its spelling may drop or add."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(*ranges: tuple[int, int]) -> str:
    """A regular expression's class of code points, in ranges."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


# Code points of the Arabic rules (combining marks and spaces by number, letters as they are).
MARK_RANGES = ((0x610, 0x61A), (0x64B, 0x65F), (0x6D6, 0x6ED), (0x8D3, 0x8FF), (0x640, 0x640))
MARKS, MARKS_AND_SMALL_ALEF = chars(*MARK_RANGES), chars(*MARK_RANGES, (0x670, 0x670))
SPACES = chars((0x9, 0xD), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)) + "+"
INVISIBLE = chars((0x61C, 0x61C), (0x200B, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069), (0xFEFF, 0xFEFF))
LETTER_RANGES = ((0x621, 0x63A), (0x641, 0x64A), (0x66E, 0x66F), (0x671, 0x6D3), (0x6FA, 0x6FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
ALEF, HAMZA, YEH, HEH = "ا", "ء", "ي", "ه"
OTHER_ALEFS, CARRIERS = "\u0670آٱ", "ؤئأإ"
MAQSURA, MARBUTA = "ى", "ة"
DRIFT = "اويء"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def arabic_form(text: Column) -> Column:
    """The form in which Arabic wording is compared: no marks, one form of alef, hamza and final letters, no doubled letters."""
    text = F.translate(F.regexp_replace(text, MARKS, ""), OTHER_ALEFS, 3 * ALEF)
    text = F.replace(text, F.lit(HAMZA + ALEF), F.lit(ALEF))
    text = F.translate(text, CARRIERS + MAQSURA + MARBUTA, 4 * HAMZA + YEH + HEH)
    return squeeze(F.regexp_replace(text, "(" + chars((0x621, 0x64A)) + r")\1+", "$1"))


def latin_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@dataclass(frozen=True)
class Profile:
    """form: the comparison form of a text; drift: letters that spelling may drop or add; ignored: marks that make no word."""

    name: str
    form: Callable[[Column], Column]
    drift: str = ""
    ignored: str = ""

    def words(self, form: Column) -> Column:
        return F.filter(F.split(form, " "), lambda w: w != "")

    def skeleton(self, form: Column) -> Column:
        return F.translate(form, self.drift, "") if self.drift else form

    def cited(self, text: Column) -> Column:
        """The comparison form of a quotation, in which an asterisk parts words."""
        return self.form(F.replace(text, F.lit("*"), F.lit(" ")))

    def has_content(self, token: Column) -> Column:
        return F.length(F.regexp_replace(token, self.ignored, "") if self.ignored else token) > 0

    def deviation(self, cited: Column, authentic: Column) -> Column:
        """How a cited text of equal form differs from the authentic one in writing."""
        marks = MARKS_AND_SMALL_ALEF if self.ignored else r"[^\p{L}\p{N}\s]"
        bare = lambda c: squeeze(F.regexp_replace(c, marks, ""))
        return F.when(cited == authentic, "none").when(bare(cited) == bare(authentic), "tashkeelOnly").otherwise("spellingDrift")

    def same_word(self, a: Column, b: Column) -> Column:
        """Whether two words differ in spelling only: one drift letter for another, or up to two drift letters left out."""
        if not self.drift:
            return a == b
        apart = F.abs(F.length(a) - F.length(b))
        return (a == b) | ((self.skeleton(a) == self.skeleton(b)) & (apart <= 2) & (F.levenshtein(a, b) <= F.greatest(F.lit(1), apart)))


ARABIC = Profile("arabic", arabic_form, DRIFT, MARKS)
LATIN = Profile("latin", latin_form)


def split_vocative(text: Column) -> Column:
    """The vocative that canonical writing joins to the next word, as a word of its own."""
    joined = f"^{YEH}{chars((0x64E, 0x650))}*{chr(0x670)}"
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.regexp_replace(w, joined, YEH + chr(0x64E) + ALEF + " ")), " ")


def script_share(text: Column, among: int = 2000) -> Column:
    """The share of characters of the Arabic block in the first characters of a text."""
    head = F.substring(text, 1, among)
    return F.coalesce(F.try_divide(F.regexp_count(head, F.lit(chars((0x600, 0x6FF)))), F.length(head)), F.lit(0.0))
