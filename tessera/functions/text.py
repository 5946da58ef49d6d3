"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tokens without weight in a tag name; endings that only look like plurals.
NOISE_TOKENS = ("a", "an", "the", "of", "for", "and", "to", "in", "on")
FALSE_PLURAL = r"(ss|is|us|as|ys)$"
# Title forms, most explicit first; lines that are no title; salutations; the end of a title.
# (?mdU): ^ and $ at line feeds only, Unicode white space.
TITLE_FORMS = (
    r"(?mdU)^\s*#{1,6}\s*([^\n#]{3,120})",
    r"(?mdU)^\s*\*\*([^*\n]{3,120})\*\*\s*:?\s*$",
    r"(?mdU)^\s*__([^_\n]{3,120})__\s*:?\s*$",
)
NON_TITLE = r"(?dU)^(```|~~~|\||[-=_*\s]+$)"
SALUTATION = r"(?dUi)^\s*(dear\b|to whom it may concern|hello\b|hi\b|greetings\b|subject\s*:|re\s*:)"
TITLE_STOP = r"(?dU)[.!?]\s"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MARKS = " :*_#-"
MOST_TITLES = 14


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row; lambdas would otherwise repeat it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def strip_marks(c: Column | str, marks: str = MARKS) -> Column:
    """Without any of ``marks`` at both ends."""
    return F.btrim(_col(c), F.lit(marks))


def truncate(c: Column | str, limit: int) -> Column:
    """First ``limit`` code points; null counts as empty."""
    return F.substring(F.coalesce(_col(c), F.lit("")), 1, limit)


def singularize(t: Column | str) -> Column:
    t = _col(t)
    n = F.length(t)
    return (
        F.when((n <= 3) | ~t.endswith("s") | t.rlike(FALSE_PLURAL), t)
        .when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .otherwise(F.substring(t, F.lit(1), n - 1))
    )


def normalize_tag(c: Column | str) -> Column:
    """Lower-cased words of a-z and 0-9, single-spaced and singular; empty for null or no word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(words, singularize), " ")


def tag_tokens(tag: Column | str) -> Column:
    """Distinct tokens of a normalised tag, noise left out, in order of occurrence."""
    return F.array_distinct(F.filter(F.split(_col(tag), " "), lambda t: (t != "") & ~t.isin(*NOISE_TOKENS)))


def tokenize(c: Column | str) -> Column:
    """All runs of a letter and at least one more letter or digit of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z][a-z0-9]+"), F.lit(0))


def words(c: Column | str) -> Column:
    """Runs of two or more letters, digits or underscores of the lower-cased text, accents stripped first."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(_col(c), F.lit("")))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def bigrams(tokens: Column | str) -> Column:
    """Pairs of neighbouring tokens, joined by a space."""
    t = _col(tokens)
    return F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def char_grams(c: Column | str, least: int = 3, most: int = 5) -> Column:
    """Character n-grams inside space-padded words of the lower-cased text."""
    padded = F.transform(F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"(?U)\S+"), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.greatest(F.length(w), F.lit(least)))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(padded, of))


def _accent_table() -> tuple[str, str]:
    """Letters with marks and their base letters, made from the canonical decompositions of Latin and Greek blocks."""
    import unicodedata

    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x386, 0x3D0), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFKD", chr(cp))
        base = "".join(x for x in d if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTS = _accent_table()


def strip_accents(c: Column | str) -> Column:
    """Letters without diacritics (precomposed letters and loose combining marks)."""
    return F.regexp_replace(F.translate(_col(c), *_ACCENTS), r"[\u0300-\u036f]", "")


def dedupe_ignoring_case(a: Column) -> Column:
    """First of equal strings (ignoring case), in order."""
    return let(F.struct(a.alias("a"), F.transform(a, F.lower).alias("low")), lambda v: F.filter(v["a"], lambda x, i: F.array_position(v["low"], F.lower(x)) == i + 1))


def headings(c: Column | str, window: int = 400) -> Column:
    """Candidate titles of a text, most explicit first."""

    def explicit(head: Column) -> Column:
        found = F.concat(*[F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in TITLE_FORMS])
        return F.filter(F.transform(found, strip_marks), lambda h: (h != "") & ~h.rlike(NON_TITLE))

    def title_of(raw: Column) -> Column:
        line = strip_marks(raw, MARKS + "\t")
        first = strip(F.element_at(F.split(line, TITLE_STOP, 2), 1))
        usable = ~raw.rlike(NON_TITLE) & (F.length(line) >= 3) & ~line.rlike(SALUTATION)
        return F.when(usable, F.when(F.length(first).between(3, 120), first).otherwise(F.lit(""))).otherwise(F.lit(None).cast("string"))

    def all_of(v: Column) -> Column:
        before = lambda i: F.size(F.filter(F.slice(v["lines"], F.lit(1), i), lambda x: x != ""))
        kept = F.filter(v["lines"], lambda x, i: (x != "") & ((i == 0) | (F.size(v["explicit"]) + before(i) < MOST_TITLES)))
        return F.concat(v["explicit"], kept)

    def candidates(head: Column) -> Column:
        # a skipped line is null; a usable line without a title is "", and still ends the search once enough titles are found
        lines = F.filter(F.transform(F.transform(F.split(head, LINE_BREAK), strip), title_of), lambda x: x.isNotNull())
        return let(F.struct(explicit(head).alias("explicit"), lines.alias("lines")), all_of)

    return dedupe_ignoring_case(let(truncate(c, max(window, 64)), candidates))


def position(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.locate(part, text) - 1 if isinstance(part, str) else F.call_function("instr", text, part) - 1


def uid_key(c: Column | str) -> Column:
    """Standard spelling of a uid: ``u`` and its digits without leading zeros, filled up to nine; null if it has no digit."""
    digits = F.regexp_replace(F.translate(_col(c), "０１２３４５６７８９", "0123456789"), "[^0-9]", "")
    short = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.length(digits) > 0, F.concat(F.lit("u"), F.when(F.length(short) < 9, F.lpad(short, 9, "0")).otherwise(short)))
