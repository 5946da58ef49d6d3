"""Personal information inside free text (problem 5): detection and typed placeholders.

Mentions of names, e-mail addresses, phone numbers, personal identity numbers and street addresses are detected with
place and kind. ``surrogates`` gives each entity its replacement; ``redact`` puts typed placeholders instead.

Defined results: null, empty and blank texts have no mention and stay as they are; overlapping finds are resolved in
the order e-mail, address, identity number, phone, name; repeated rows are handled alike. Name parts of under four
letters count only with a capital.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "address", "id_number", "phone", "name")
SP = r"[ \t ]"

# --- e-mail addresses -----------------------------------------------------------------------------------------------
_AT = re.compile(r"[@\[({<](?:(?<=@)|\s?[aA][tT]\s?[\])}>])")  # begins with a set of characters, which a search skips to
_AT_WORD = re.compile(r"(?<=\w)\s[aA][tT]\s(?=[\w-]+\s(?:[dD][oO][tT])\s)")
_LOCAL_MARKS = frozenset(".+%'’-_")
_DOT = rf"(?:\.|{SP}?[\[({{]\s?[dD][oO][tT]\s?[\])}}]{SP}?|{SP}[dD][oO][tT]{SP})"
_DOMAIN = re.compile(rf"\s{{0,2}}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+")

# --- street addresses -----------------------------------------------------------------------------------------------
_N = r"[^\W\d_][\w'’-]*"  # a word of a street or town name
_GAP = rf"(?:[,;]?{SP}{{1,2}}|[,;]?{SP}?\r?\n{SP}?)"
_WAY = r"(?:Street|Avenue|Road|Lane|Court|Terrace|Drive|Close|Crescent|Gardens|Place|Square|Way|Parkway|Boulevard|Highway|Row|Walk|Mews|Hill|Grove|(?:Rd|Blvd|Ln|Dr|Ct|Pl|Ter|Sq|Hwy|Cres)\b\.?|(?:St|Ave|Pkwy)\b(?:\.(?=[,;]|\s+(?:Apt|Unit|Suite|Flat|#)))?)"
_FLAT_NO = rf"(?:{_GAP}(?:(?:Apt|Unit|Suite|Ste|Flat|Apartment)\b\.?{SP}?\w+|\#{SP}?\w+))?"
_STATE = r"(?:[A-Z]{2}|[A-Z][a-z]+(?:\s[A-Z][a-z]+)?)"
_TOWN = rf"{_N}(?:{SP}{_N}){{0,2}}"
_US = rf"{_GAP}{_TOWN},?{SP}{{1,2}}{_STATE}{SP}{{1,2}}\d{{5}}(?:-\d{{4}})?\b"
_UK = rf"{_GAP}{_TOWN},?{SP}{{1,2}}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{SP}{{1,2}}\d[A-Z]{{2}}\b"
# Words that begin or end the name of a town of two words.
_SECOND = r"(?:Vale|Bay|Hill|Bridge|Harbour|Cross|Green|Park|Heath|Point|Springs|City|Falls)"
_FIRST = r"(?:Lower|Upper|Port|New|Old|North|South|East|West|Great|Little|Saint|St\.?|San|Santa|Bad|Alt|Neu|Le|La|Les|El|Los|Las)"
_EU = rf"{_GAP}\d{{5}}{SP}{{1,2}}(?:{_FIRST}{SP}(?-i:(?=[^\W\d_a-zà-ÿ])))?[^\W\d_]\w+(?:-\w+)*(?:{SP}{_SECOND}\b)?"
_FLAT = re.compile(rf"(?<!\w)Flat{SP}\d+\w?,?{SP}\Z", re.IGNORECASE)
_LETTER = re.compile(r"[^\W\d_]")
#: How a house number before a street begins.
_HOUSE = re.compile(rf"\d(?<![\w#/.]\d)\d{{0,4}}[A-Za-z]?,?{SP}{{1,2}}(?=[^\W\d_])", re.IGNORECASE)
_ADDRESSES = tuple(  # (words of which one must occur, words at one of which the pattern begins, else at a house number or None: anywhere behind "box"; pattern)
    (words, at, re.compile(p, re.IGNORECASE))
    for words, at, p in (
        (("box", "p.o"), None, rf"(?<!\w)P\.?{SP}?O\.?{SP}?Box{SP}\d+(?:{_US}|{_UK})?"),
        (
            ("rue ", "avenue ", "chemin ", "place ", "boulevard ", "impasse ", "allée ", "quai ", "route ", "cours "),
            (),
            rf"(?<![\w#/.])\d{{1,4}}(?:{SP}(?:bis|ter|quater)\b)?,?{SP}{{1,2}}(?:rue|avenue|chemin|place|boulevard|impasse|allée|quai|route|cours){SP}(?:(?:des|du|de{SP}la|de|d['’]){SP})?{_N}(?:{SP}(?-i:[A-ZÀ-Ý])[\w'’-]*)?(?:{_EU})?",
        ),
        (
            ("calle ", "c/", "avda", "avenida ", "plaza ", "paseo ", "camino "),
            ("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino"),
            rf"(?<!\w)(?:C/|Calle\b|Avda\b\.?|Avenida\b|Plaza\b|Paseo\b|Camino\b){SP}(?:(?:del|de{SP}la|de{SP}los|de{SP}las|de){SP})?{_N}(?:{SP}{_N})?,?{SP}\d{{1,4}}\b(?:,{SP}?(?:bajo\b|ático\b|\d{{1,2}}\.?{SP}?[ºª°o]{SP}?\w?\b))?(?:{_EU})?",
        ),
        (
            ("straße ", "strasse ", "gasse ", "allee ", "weg ", "platz ", "ufer ", "ring ", "damm ", "postfach "),
            ("straße", "strasse", "gasse", "allee", "weg", "platz", "ufer", "ring", "damm", "postfach"),
            rf"(?:(?<=[^\W\d_])(?:straße|strasse|gasse|allee|weg|platz|ufer|ring|damm)|(?<!\w)Postfach){SP}\d{{1,4}}(?:{SP}?[a-z]\b)?(?:{_EU})?",
        ),
        (
            ("street", "avenue", "road", "lane", "court", "terrace", "drive", "close", "crescent", "gardens", "place", "square", "way", "boulevard", "row", "walk", "mews", "hill", "grove", " rd", " blvd", " ln", " dr", " ct", " st", " ave", "pkwy"),
            (),
            rf"(?<![\w#/.])\d{{1,5}}[A-Za-z]?,?{SP}{{1,2}}(?:{_N}{SP}{{1,2}}){{1,2}}{_WAY}(?!\w){_FLAT_NO}(?:{_US}|{_UK})?",
        ),
    )
)

# --- numbers --------------------------------------------------------------------------------------------------------
_B = r"[ \xa0]"
_SURE = (  # forms that only personal numbers have, unless a word of _OTHER stands before
    rf"\d{{3}}(?P<sep>[-. \xa0])\d{{2}}(?P=sep)\d{{4}}|[A-Z]{{2}}/\d{{4}}/\d{{3}}|[A-Z]\d{{3}}-\d{{4}}-\d{{2}}|\d{{4}}-\d{{4}}-\d{{4}}-\d|\d{{6}}/\d{{4}}"
    rf"|\d{{2}}{_B}\d{{3}}{_B}\d{{3}}{_B}\d{{3}}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}|[A-Z]{{2}}{_B}\d{{2}}{_B}\d{{2}}{_B}\d{{2}}(?:{_B}[A-D]\b)?"
)
_END = r"(?![\w]|[/-]\w)"
_ID_SURE = re.compile(rf"(?:{_SURE}){_END}", re.IGNORECASE)
_ID_LABELLED = re.compile(rf"(?:{_SURE}|\d{{8,9}}[A-Z]?|[XYZ]\d{{7,8}}[A-Z]?|[A-Z]{{1,2}}\d{{6,8}}[A-Z]?|\d{{3}}{_B}\d{{3}}{_B}\d{{3}}|\d{{5,12}}[A-Z]?){_END}", re.IGNORECASE)
# What stands before a personal number, and before a number of another kind.
ID_LABELS = tuple(
    "ssn,mrn,tax id,tax number,tax no,passport,passport no,passport number,driving licence,driving license,driving licence no,driver's license,drivers license,national id,patient id,patient no,patient number,social security,social security number,"
    "number on the card,the card,identidad,identité,ausweisnummer,personalausweis,steuernummer,steuer-id,steuerid,reisepass,pasaporte,passeport,dni,nie,nhs number,nhs no, id,(id,identity number,identity no,id no,id number,id card".split(",")
)
OTHER_LABELS = tuple(
    x + y
    for x in "ticket,invoice,reference,ref,account,case,batch,form,shelf,version,release,template,rechnung,akte,dossier,expediente,referencia,référence,order,booking,vorgang,referenz,aktenzeichen,hoja,pièce,blatt,konto,cuenta,compte,file,replaces,replaced".split(",")
    for y in ("", " no", " nr", " number")
)
_CODE = re.compile(r"(?<![^\W_])[A-Z]{2}[ -]\Z")  # a series of tickets or files before a number
_EXT = rf"(?:{SP}?(?:\(ext\.?{SP}?\d{{1,5}}\)|(?:,{SP}?)?(?:ext\.?|extension|x){SP}?\d{{1,5}}\b))?"
_PHONE = re.compile(
    (
        r"(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,7}){1,5}"
        r"|00\d{2}[ .-](?:\(0\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,7}){1,5}|00(?:1|44|33|49|61|34)\d{8,11}"
        r"|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}"
        r"|\(0\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
        r"|0\d{2}[ -]?\d{4}[ -]\d{4}|0\d{1,4}/\d{5,9}|0\d(?:[ .-]?\d{2}){4}|0\d{3,4}[ -]?\d{3}[ -]\d{3}|0\d{4}[ -]?\d{6}|0\d[ -]\d{4}[ -]\d{4})"
    ).replace("[ ", r"[ \xa0")
    + rf"{_EXT}(?![\w]|[/-]\d|\.\d)",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d[\d ./\xa0()-]{5,}")
_RUN = re.compile(r"\d+")

# --- names ----------------------------------------------------------------------------------------------------------
_JOIN = re.compile(rf"(?:\s++|-|(?<={SP})[^\W\d_]\.?(?={SP})|(?:von{SP}der|van{SP}der|van{SP}den|von|van|de{SP}la|del|de|der|den|da|di|du|la|le)(?=\s)|al-|el-|o['’]|d['’])++", re.IGNORECASE)
_BEFORE = re.compile(rf"(?<![\w.@])(?:(?-i:[A-ZÀ-Þ])\.{SP}{{0,2}})*(?:(?:von{SP}der|van{SP}der|von|van|de{SP}la|del|de|der){SP}{{1,2}}|al-|el-|o['’]|d['’])?\Z", re.IGNORECASE)
_PARTICLE_ENDS = ("von", "van", "der", "del", "de", "la")  # of what _BEFORE finds before a space
_BARE_INITIAL = re.compile(rf"(?<![\w.'’])(?-i:[B-HJ-ZÀ-Þ]){SP}{{1,2}}\Z")
_NAME_LABEL = re.compile(rf"\n{SP}*(?:Name|Full{SP}name|Patient|Applicant|Holder|Contact{SP}person|Signed{SP}by|Signed){SP}?(?::|-|){SP}{{1,2}}(?P<v>[^\W\d_][^\n\r\d,:@]+?(?:,{SP}[^\W\d_][^\n\r\d,:@.]+)?)(?={SP}*(?:[\n\r]|$|{SP}{SP}))")
_NAMELIKE = re.compile(rf"(?:(?-i:[A-ZÀ-Þ])\.?{SP})?[^\W\d_]{{3,}}(?:(?:{SP}|-)(?:(?:von|der|van|de|la){SP})*(?:(?-i:[A-ZÀ-Þ])\.?{SP})?(?:al-|o['’])?[^\W\d_]{{3,}}){{0,3}}(?:,{SP}[^\W\d_]{{3,}})?", re.IGNORECASE)


def _local_start(t: str, at: int) -> int:
    """Where the part of an e-mail address before ``at`` begins, of any length; -1 if there is none."""
    end = at
    while end and at - end < 2 and t[end - 1].isspace():
        end -= 1
    start = end
    while start and (t[start - 1].isalnum() or t[start - 1] in _LOCAL_MARKS):
        start -= 1
    while start < end and not (t[start].isalnum() or t[start] == "_"):
        start += 1
    return start if start < end else -1


def _label_before(t: str, at: int) -> str:
    """The words right before a number, lower-cased, without the marks and spaces between, however many."""
    while at and (t[at - 1].isspace() or t[at - 1] in ":.,#(-"):
        at -= 1
    return " ".join(t[max(0, at - 64) : at].split()).lower()


def name_model(parts: list[tuple[str, str]]) -> dict[str, str]:
    """Role (g, f or b for both) of every name part, the known ones and those of the same build.

    ``parts``: (part, role given/family), a reference list. Parts are cut into stem and ending where both recur most;
    stems and endings that recur combine to parts that the incomplete list lacks.
    """
    out: dict[str, str] = {}
    for role in ("given", "family"):
        own = sorted({p.strip().lower() for p, r in parts if p and r == role and p.strip()})
        stems: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        long = [p for p in own if len(p) > 3]
        for p in long:
            for i in range(2, len(p) - 1):
                stems[p[:i]] += 1
                ends[p[i:]] += 1
        best_stems: Counter[str] = Counter()
        best_ends: Counter[str] = Counter()
        for p in long:
            i = max(range(2, max(3, len(p) - 1)), key=lambda k: (min(stems[p[:k]], ends[p[k:]]), len(p[k:])))
            best_stems[p[:i]] += 1
            best_ends[p[i:]] += 1
        made = {s + e for s, n in best_stems.items() if n > 2 for e, m in best_ends.items() if m > 4}
        for p in {*own, *made}:
            out[p] = "b" if p in out and out[p] != role[0] else role[0]
    return out


def _matches(t: str, low: str, starts: list[int] | None, words: tuple[str, ...], pattern: re.Pattern) -> Iterator[re.Match]:
    """What ``pattern.finditer(t)`` gives if one of ``words`` is in ``low``; tried only at ``starts``, if it can begin nowhere else."""
    end, ok = 0, False
    for m in pattern.finditer(t) if starts is None else map(pattern.match, repeat(t), starts):
        if m and m.start() >= end:
            ok = ok or any(w in low for w in words)
            if not ok:
                return
            end = m.end()
            yield m


def _may_have_before(t: str, at: int) -> bool:
    """Whether ``_BEFORE`` can find an initial or a particle that ends at ``at``."""
    if not at:
        return False
    if t[at - 1] not in " \t\xa0":
        return t[at - 1] in ".-'’"
    while at and t[at - 1] in " \t\xa0":
        at -= 1
    return t[at - 1 : at] == "." or t[max(0, at - 3) : at].lower().endswith(_PARTICLE_ENDS)


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    for x, y in spans:
        if x <= at < y:
            return True
    return False


def _letter(c: str) -> bool:
    """What names are made of: a word character that is no decimal digit or underscore."""
    return c.isalpha() or c.isalnum() and not c.isdecimal()


#: Which pattern of _ADDRESSES can begin at a word, or can occur only with it.
_STARTS = {"box": 0} | {w: k for k, (_, at, _) in enumerate(_ADDRESSES) for w in at or ()}


class Detector:
    """Finds mentions; ``model`` as of ``name_model``."""

    def __init__(self, model: dict[str, str]):
        import ahocorasick

        self.model = model
        self.word = re.compile(rf"[^\W\d_]{{{min(map(len, model), default=4)},}}")
        self.parts = ahocorasick.Automaton()
        for w, k in _STARTS.items():
            self.parts.add_word(w, (len(w), "", k))
        for p, r in model.items():
            self.parts.add_word(p, (len(p), r, _STARTS.get(p, -1)))
        self.parts.make_automaton()

    def known(self, t: str, low: str) -> tuple[list[tuple[int, int, str]], list[list[int] | None]]:
        """(start, end, role) of the whole words that are name parts, in order; where each pattern of ``_ADDRESSES`` can begin.

        ``low``: ``t`` in lower case.
        """
        n, found, starts = len(t), [], [[] for _ in _ADDRESSES]
        if len(low) != n:  # some letter has no lower case of one letter
            found = [(m.start(), m.end(), r) for m in self.word.finditer(t) if (r := self.model.get(m[0].lower()))]
            starts = [None] * len(starts)
        else:
            for last, (k, r, at) in self.parts.iter(low):
                a, b = last + 1 - k, last + 1
                if at >= 0:
                    starts[at].append(a)
                if r and (b == n or not _letter(low[b])) and (not a or not _letter(low[a - 1])):
                    found.append((a, b, r))
            houses = [m.start() for m in _HOUSE.finditer(t)]
            odd = "ſ" in t or "ı" in t  # letters that a pattern takes for s and i, which lower() doesn't
            starts = [houses if at == () else None if odd or at is None and own else own for own, (_, at, _) in zip(starts, _ADDRESSES)]
        return [w for w in found if w[1] - w[0] > 3 or t[w[0]].isupper()], starts

    def names(self, t: str, words: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        i = 0
        while i < len(words):
            a, b, role = words[i]
            if _inside(taken, a):
                i += 1
                continue
            roles = role
            j = i + 1
            while j < len(words):
                c, d, r = words[j]
                if _inside(taken, c):
                    break
                joins = _JOIN.fullmatch(t, b, c)
                gap = t[b:c] if joins or c - b == 2 else ""
                hyphen = gap.strip() == "-"
                if joins and not (r == "g" and "f" in roles) and not ("\n" in gap and (roles[-1] == "f" or t[b : b + 1] in ".,")):
                    if roles[-1] == "f" and r == "f" and not hyphen and not re.search(r"[a-z]", gap, re.IGNORECASE):
                        break
                elif gap in (", ", ",\xa0") and "g" not in roles and r in "gb" and not (j + 1 < len(words) and words[j + 1][2] == "f" and _JOIN.fullmatch(t, d, words[j + 1][0])):
                    pass  # family name, given name
                else:
                    break
                b, roles, j = d, roles + r, j + 1
            m = _BEFORE.search(t, max(0, a - 64), a) if _may_have_before(t, a) else None
            if m and m.start() < a:
                a = m.start()
            elif "g" not in roles and (m := _BARE_INITIAL.search(t, max(0, a - 4), a)):
                a = m.start()
            out.append((a, b))
            i = j
        for m in _NAME_LABEL.finditer("\n" + t):
            a, b = (x - 1 for x in m.span("v"))
            v = t[a:b].rstrip(" .\xa0")
            b = a + len(v)
            if not _NAMELIKE.fullmatch(v) or any(x < b and a < y for x, y in taken):
                continue
            inside = [k for k, (x, y) in enumerate(out) if x < b and a < y]
            if inside and any(out[k] == (a, b) for k in inside):
                continue
            if inside or (v[:1].isupper() and len(v.split()) <= 5):
                out = [s for k, s in enumerate(out) if k not in inside] + [(a, b)]
        return out

    def numbers(self, t: str, at: int, upto: int, add) -> None:
        """Personal and phone numbers that begin in a stretch of digits and marks."""
        end = 0
        for run in _RUN.finditer(t, at, upto):
            start = at = run.start()
            if at < end:
                continue
            if at and t[at - 1].isalpha() and t[at - 1].isascii():
                start = at - 2 if at > 1 and t[at - 2].isalpha() else at - 1
                if start and (t[start - 1].isalnum() or t[start - 1] == "_"):
                    start = -1
            elif at > 2 and t[at - 1] in " /\xa0" and t[at - 3 : at - 1].isalpha() and t[at - 3 : at - 1].isascii() and (at == 3 or not t[at - 4].isalnum()):
                start = at - 3
            if start >= 0:
                for s in (start, at) if start != at else (at,):
                    if s and (t[s - 1].isdigit() or t[s - 1] in "/.-" and s > 1 and t[s - 2].isalnum()):
                        continue
                    p = s - 1 if s and t[s - 1] in "+(" else s
                    if p and t[p - 1] == "+":
                        p -= 1
                    labelled = _ID_LABELLED.match(t, s)
                    if not labelled and (s != at or not _PHONE.match(t, p)):  # a sure form is a labelled one too
                        continue
                    tail = _label_before(t, s)
                    if labelled and tail.endswith(ID_LABELS):
                        add(s, end := labelled.end(), "id_number")
                        break
                    if tail.endswith(OTHER_LABELS):
                        continue
                    if labelled and not _CODE.search(t, max(0, s - 4), s) and (m := _ID_SURE.match(t, s)):
                        add(s, end := m.end(), "id_number")
                        break
                    if s == at and (m := _PHONE.match(t, p)):
                        add(p, end := m.end(), "phone")
                        break

    def find(self, t: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all mentions, in order."""
        out: list[tuple[int, int, str]] = []
        if not t:
            return out
        taken: list[tuple[int, int]] = []

        def add(a: int, b: int, kind: str) -> None:
            if a < b:
                for x, y in taken:
                    if x < b and a < y:
                        return
                taken.append((a, b))
                out.append((a, b, kind))

        low = t.lower()
        ats = list(_AT.finditer(t))
        if " dot " in low:
            ats += _AT_WORD.finditer(t)
        for m in ats:
            left = _local_start(t, m.start())
            right = _DOMAIN.match(t, m.end())
            if left >= 0 and right:
                add(left, right.end(), "email")
        known, starts = self.known(t, low)
        for at, (words, _, pattern) in zip(starts, _ADDRESSES):
            if at == []:
                continue
            for m in _matches(t, low, at, words, pattern):
                a, b = m.span()
                begin = a
                while a and _LETTER.match(t, a - 1) and _LETTER.match(t, a):  # the whole word that the street's kind ends
                    a -= 1
                if a < begin and a and (t[a - 1].isdigit() or t[a - 1] == "_"):
                    continue
                if t[a].isdigit() and (f := _FLAT.search(t, max(0, a - 64), a)):
                    a = f.start()
                add(a, b, "address")
        for region in _DIGITS.finditer(t):
            self.numbers(t, *region.span(), add)
        for a, b in self.names(t, known, taken):
            out.append((a, b, "name"))
        out.sort()
        return out


def collect_model(name_parts: DataFrame, most: int = 100_000) -> dict[str, str] | DataFrame:
    """Name model of the reference list (name_part, role); a list of over ``most`` rows stays a table, for ``with_roles``."""
    rows = name_parts.select("name_part", "role").limit(most + 1).collect()
    return name_parts if len(rows) > most else name_model([(r.name_part, r.role) for r in rows])


def with_roles(df: DataFrame, name_parts: DataFrame, key: str, text: str) -> DataFrame:
    """``df(key, same, text)`` with ``roles``: the part of the name model that the row's own words need.

    The same model as ``name_model``, by joins: a list of any size is on no driver and in no task as a whole.
    """
    given = F.col("role") == "given"
    own = name_parts.filter(F.col("role").isin("given", "family")).select(F.lower(F.trim("name_part")).alias("word"), F.when(given, "g").otherwise("f").alias("r")).filter("word <> ''").distinct()
    cut = lambda d: d.filter(F.length("word") > 3).select("*", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("i")).select("*", F.expr("substring(word, 1, i)").alias("stem"), F.expr("substring(word, i + 1)").alias("end"))
    cuts = cut(own)
    n = cuts.join(cuts.groupBy("r", "stem").agg(F.count("*").alias("a")), ["r", "stem"]).join(cuts.groupBy("r", "end").agg(F.count("*").alias("b")), ["r", "end"])
    best = n.groupBy("r", "word").agg(F.max_by(F.struct("stem", "end"), F.struct(F.least("a", "b"), F.length("end"))).alias("c")).select("r", "c.*")
    stems, ends = (best.groupBy("r", c).agg(F.count("*").alias("n")).filter(F.col("n") > k).drop("n") for c, k in (("stem", 2), ("end", 4)))
    words = df.select(key, "same", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W\d_]+"), F.lit(0)))).alias("word"))
    each = words.select("word").distinct()
    made = cut(each).join(stems, "stem").join(ends, ["r", "end"]).select("word", "r")
    roles = each.join(own, "word").select("word", "r").unionByName(made).groupBy("word").agg(F.when(F.count_distinct("r") > 1, "b").otherwise(F.min("r")).alias("role"))
    per = words.join(roles, "word").groupBy(key, "same").agg(F.map_from_entries(F.collect_set(F.struct("word", "role"))).alias("roles"))
    return df.join(per, [key, "same"], "left")


def rows_for(df: DataFrame, model: dict[str, str] | DataFrame, key: str, text: str) -> DataFrame:
    """(key, same, text[, roles]) for the tasks that detect; ``same`` tells texts of one key apart."""
    rows = df.select(key, F.xxhash64(text).alias("same"), text)
    return with_roles(rows, model, key, text).select(key, "same", text, "roles") if isinstance(model, DataFrame) else rows


def detectors(model: dict[str, str]) -> Callable[[pa.RecordBatch], Iterator[Detector]]:
    """One detector for all rows of a batch of ``rows_for``."""
    one = Detector(model)
    return lambda b: repeat(one, b.num_rows)


def per_row(b: pa.RecordBatch) -> Iterator[Detector]:
    """A detector for each row, by its own roles."""
    return (Detector(dict(m or ())) for m in b.column(3).to_pylist())


def mentions(df: DataFrame, model: dict[str, str] | DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos, kind) of every mention."""
    by_list, model = model, None if isinstance(model, DataFrame) else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = detectors(model) if model is not None else per_row
        for b in batches:
            found = [d.find(t) for d, t in zip(of(b), b.column(2).to_pylist())]
            owner = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array([m[0] for f in found for m in f], pa.int64()), pa.array([m[1] for f in found for m in f], pa.int64()), pa.array([m[2] for f in found for m in f], pa.string())], names=[key, "start_pos", "end_pos", "kind"])

    return rows_for(df, by_list, key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, start_pos bigint, end_pos bigint, kind string")


def redact(df: DataFrame, model: dict[str, str] | DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, text) with a typed placeholder such as ``[EMAIL]`` instead of each mention; null texts stay null."""
    by_list, model = model, None if isinstance(model, DataFrame) else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = detectors(model) if model is not None else per_row
        for b in batches:
            out = []
            for d, t in zip(of(b), b.column(2).to_pylist()):
                for x, y, k in reversed(d.find(t)):
                    t = f"{t[:x]}[{k.upper()}]{t[y:]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return rows_for(df, by_list, key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")
