"""Sentence boundaries across languages and scripts (problem 8).

Method: ordered break and no-break pairs of regular expressions, kept in tables by language and script that cascade
(language, then script, then common); the first pair that matches before and after a position decides it.

A text is first cut into blocks at blank lines and blocks into lines. A line that isn't running prose (heading, list
item, table row, label with value, note without full stop) is one unit; prose lines that were wrapped are joined. The
rules then run over the candidate positions of each stretch of prose: the ends of terminator runs with the closing
quotes and brackets that follow. Thai stretches are cut at spaces not next to digits.

Defined results: null and blank texts have no sentences; positions count code points, the end is exclusive and
surrounding white space is left out. The language is found from the text; the ``lang`` column isn't trusted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CLOSE = "”’»\"')\\]）」』】〉》“"
CLOSE_EAST = CLOSE[:-1]  # where the last mark only opens
OPEN = "“„«\"'(\\[（「『【¿¡‘"

# Abbreviations. ``never`` never end a sentence, ``maybe`` end it before a capital.
ABBREVIATIONS = {
    "en": (
        "Dr Mr Mrs Ms Prof Rev Hon St Mt Fig Figs No Nos Vol Sec App Col Ch Art Eq p pp vs e.g i.e approx sec app col fig no vol art arts para paras cl pt par ch ed eds cf viz ca esp incl resp min max"
        " Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Gen Lt Capt Sgt attn Attn tel Tel ext Ext dr mr mrs ms prof st jan feb mar apr jun jul aug sep sept oct nov dec",
        "Inc Ltd Corp Co Bros etc a.m p.m U.S U.K U.N Ph.D M.D B.A M.A Jr Sr Ave Rd Blvd dept Dept inc ltd corp co u.s u.k ph.d",
    ),
    "de": (
        "Dr Prof Hr Fr Nr Abs Art Bd S s Anm Anl ca bzw bspw evtl ggf inkl vgl z.B z. B u.a u. a d.h d. h z. B i.d.R sog Tel Str str St Ing Dipl max min zzgl Abb Kap Ziff nr abs dr",
        "usw etc Co u.v.m ff f",
    ),
    "fr": ("M MM Mlle Dr Me Pr p pp n art env cf fig chap vol ex av apr p.ex éd réf tél St Ste dr", "etc S.A S.A.R.L S.A.S Cie"),
    "es": ("Sr Sra Srta Sres Dr Dra D Dª pág págs art arts aprox núm n.º nº p.ej p. ej fig cap vol Ud Uds tel Av Avda Gral Lic Ing sr sra dr dra EE", "etc UU EE. UU S. L S.L S.A S. A Cía Ltda"),
    "ru": ("г-н г-жа ул д кв п пп ст стр с т.е т. е т.к т. к т.н напр см им тыс млн млрд просп пр пер обл гл рис табл проф акад корп стр", "г гг руб коп др пр т.д т. д т.п т. п т.г в вв"),
    "el": ("κ κα κκ π.χ σελ αρ αριθ τηλ δηλ βλ κεφ παρ άρθρ λ.χ Δρ", "κ.λπ κλπ κ.ά κτλ"),
    "ar": ("د م أ ص ج هـ ت ط", ""),
    "hi": ("डॉ सं श्री प्रो पं कृ", ""),
}

_LATIN_WORDS = {
    "de": "der die das und den dem ist nicht hat wir bis im am zum laut ein eine für mit von wurde bitte wo liegt firma",
    "fr": "le la les des du est une un que qui dans pour avec selon voir ce pas ne été sera avant société mme",
    "es": "el la los las del que en una un con por para según ha no se está más falta empresa pasó dónde",
    "en": "the of and to in is was for on a by an be or from with not at this that",
}
_WORD_SETS = {k: frozenset(v.split()) for k, v in _LATIN_WORDS.items()}


def _abbreviated(names: str) -> str:
    """Pattern of any of the names right before the position, its last dot included."""
    parts, out = names.split(), []
    i = 0
    while i < len(parts):  # "z. B" counts as one name
        if i + 1 < len(parts) and parts[i].endswith("."):
            out.append(rf"{regex.escape(parts[i])}\s?{regex.escape(parts[i + 1])}")
            i += 2
        else:
            out.append(regex.escape(parts[i]))
            i += 1
    return r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(sorted(out, key=len, reverse=True)) + r")\.$"


# Closing and opening marks of quotations.
_PAIRS = (("”", "“"), ("»", "«"), ("」", "「"), ("』", "『"), ("“", "„"), ("’", "‘"))
# a quotation with its own full stop that a colon or comma leads in, and one that nothing leads in
_QUOTED = "|".join(rf"{o}[^{o}]*[.!?…。！？।॥؟;][^{o}\p{{L}}\p{{N}}]*{c}" for c, o in _PAIRS)
LED_IN = rf"[:,：，]\s{{0,3}}(?:{_QUOTED})$"
NOT_LED_IN = rf"(?<![:,：，]\s{{0,3}})(?:{_QUOTED})$"


def _rules() -> dict[str, list[tuple[bool, str, str]]]:
    """Tables of (break?, before, after)."""
    t: dict[str, list[tuple[bool, str, str]]] = {}
    goes_on = r"[,;:–—、，と-]"
    t["quotes"] = [(True, LED_IN, rf"\s*(?!{goes_on})[^\s\p{{Ll}}]")]
    t["quotes-uncased"] = [(True, LED_IN, rf"\s*(?!{goes_on})\S"), (False, NOT_LED_IN, r"\s+\p{Ll}")]
    t["quotes-unspaced"] = [(True, LED_IN, rf"\s*(?!{goes_on})\S"), (False, NOT_LED_IN, r"\s*\p{L}")]
    t["quotes-ko"] = [(True, LED_IN, rf"\s+(?!{goes_on})\S"), (False, NOT_LED_IN, r"\p{L}")]
    upper = rf"\s+[{OPEN}]*(?:\p{{Lu}}|\p{{N}})"
    for lang, (never, maybe) in ABBREVIATIONS.items():
        t[lang] = [(False, _abbreviated(never), r"\s*\S")]
        if maybe:
            t[lang] += [(True, _abbreviated(maybe), rf"\s+[{OPEN}]*\p{{Lu}}"), (False, _abbreviated(maybe), r"\s*\S")]
    t["en"] = [(True, rf"[.!?…][{CLOSE}]*$", r"\s+(?:e-\p{Ll}|i\p{Lu})")] + t["en"]
    t["de"] += [
        (False, r"(?<!\p{L})(?:am|vom|zum|bis|im|der|dem|den|des|die|das|seit|ab|beim|Der|Die|Das|Am|Im|und|jeder|jedem|jeden)\s+\d{1,2}\.$", r"\s+\p{L}"),
        (False, r"\d{1,2}\.$", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Stock|Etage|Jahrhundert|Quartal)"),
    ]
    t["fr"] += [(False, rf"[.!?…]\s?[»”\"]+$", r"\s*(?:\p{Ll}|[,;:–—-])")]
    t["es"] += [(False, r"EE\.$", r"\s*UU")]
    t["cased"] = [
        (False, r"\d\.$", r"\d"),
        (False, r"(?<![\p{L}\p{M}\p{N}.])\p{Lu}\.$", r"[\s-]*\p{Lu}"),  # initials
        (False, r"(?<![\p{L}\p{M}\p{N}.])\p{L}\.$", r"\s?\p{L}\."),
        (False, r"(?:^|[^\p{L}\p{N}])(?:\p{L}\.){1,}\p{L}\.$", r"\s*[^\s\p{Lu}]"),
        (True, rf"(?:…|\.\.+)[{CLOSE}]*$", rf"\s*[{OPEN}]*\p{{Lu}}"),
        (False, rf"(?:…|\.\.+)[{CLOSE}]*$", r"\s*\S"),
        (False, rf"[.!?;…]\s?[”’»\"'“]+$", r"\s*(?:[,;:–—-]|\p{Ll})"),  # quotation within a sentence
        (False, rf"[.!?][)\]]+$", r"\s*(?:[,;:–—-]|\p{Ll})"),
        (False, rf"[.!?;]$", r"\s*[,;:!?.)\]]"),
        (True, r"[!?;][!?]*$", r"\s+\p{Ll}"),
        (False, rf"\.[{CLOSE}]*$", r"\s*\p{Ll}"),
        (True, rf"[.!?;…]\s?[{CLOSE}]*$", rf"\s+[{OPEN}\p{{L}}\p{{N}}*#$£€&—–+-]"),
        (True, rf"(?:[\p{{Ll}}\p{{N}})%][.!?;]|[.!?])[{CLOSE}]*$", rf"[{OPEN}]*\p{{Lu}}(?:\p{{Ll}}|['’\s.-])"),  # missing space
        (True, rf"[!?;][{CLOSE}]*$", rf"[{OPEN}]+\p{{L}}"),
        (False, r"$", ""),
    ]
    # a text typed without capitals: any letter may begin a sentence
    t["uncased"] = [
        (False, r"\d\.$", r"\d"),
        (False, r"(?<![\p{L}\p{M}\p{N}.])\p{L}\.$", r"\s*\p{L}\."),
        (False, r"(?<![\p{L}\p{M}\p{N}.])\p{L}\.\s?\p{L}\.$", r"\s*\p{L}"),
        (False, rf"(?:…|\.\.+)[{CLOSE}]*$", r"\s*[^\s“\"«„¿¡(]"),
        (False, rf"[.!?;…]\s?[”’»\"'“)\]]+$", r"\s*[,;:–—-]"),
        (False, rf"[.!?;]$", r"\s*[,;:!?.)\]]"),
        (True, rf"[.!?;…]\s?[{CLOSE}]*$", r"\s+\S"),
        (False, r"$", ""),
    ]
    t["cjk"] = [
        (False, r"(?:…+|\.\.\.+)$", r"\s*\S"),
        (False, rf"[。！？!?.][{CLOSE_EAST}]+$", r"(?:と|って|라고|고|이라고|的)"),
        (False, r"\d\.$", r"\d"),
        (False, r"(?<!\p{L})\p{Lu}\.$", r"\s*\p{L}"),
        (True, rf"[。！？][{CLOSE_EAST}]*$", r"\s*\S"),
        (True, rf"[!?][{CLOSE_EAST}]*$", r"\s*\S"),
        (True, rf"\.[{CLOSE_EAST}]*$", r"\s+\S"),
        (False, r"$", ""),
    ]
    t["ko"] = [(False, rf"[.!?…][{CLOSE_EAST}]+$", r"\p{L}")]
    t["indic"] = [
        (False, r"(?:…+|\.\.\.+)$", r"\s*\S"),
        (True, rf"[।॥?!][{CLOSE_EAST}]*$", r"\s*\S"),
        (False, r"$", ""),
    ]
    t["arabic"] = [
        (False, r"(?:…+|\.\.\.+)$", r"\s*\S"),
        (False, r"\d\.$", r"\d"),
        (False, r"(?<![\p{L}\p{M}])\p{L}\.$", r"\s*\S"),
        (True, rf"[!؟?][{CLOSE_EAST}]*$", r"\s*\S"),
        (True, rf"\.[{CLOSE_EAST}]*$", r"\s+\S"),
        (True, rf"[\p{{L}}]\.[{CLOSE_EAST}]*$", r"\p{L}"),
        (False, r"$", ""),
    ]
    return t


CASCADE = {
    **{k: ("quotes", k, "cased") for k in ("en", "de", "fr", "es", "ru", "el")},
    **{f"{k}-low": ("quotes-uncased", k, "uncased") for k in ("en", "de", "fr", "es", "ru", "el")},
    "zh": ("quotes-unspaced", "cjk"), "ja": ("quotes-unspaced", "cjk"), "ko": ("quotes-ko", "ko", "cjk"), "hi": ("quotes-unspaced", "hi", "indic"), "ar": ("quotes-unspaced", "ar", "arabic"),
}
_TABLES: dict[str, list[tuple[bool, object, object]]] = {}


_QUOTE_ENDS = frozenset(c for c, _ in _PAIRS)


def _last(before: str) -> frozenset[str] | None:
    """The characters a match of ``before`` can end with, None if any."""
    return frozenset(".") if before.endswith(r"\.$") else _QUOTE_ENDS if before in (LED_IN, NOT_LED_IN) else None


def _rules_for(lang: str, c: str):
    """The rules of a language that can match before a position behind the character ``c``, in order."""
    if (lang, c) not in _FOR:
        _FOR[lang, c] = [(brk, b, a) for brk, b, a, ends in _table(lang) if ends is None or c in ends]
    return _FOR[lang, c]


_FOR: dict[tuple[str, str], list] = {}


def _table(lang: str):
    if lang not in _TABLES:
        rules = _rules()
        # what stands before is read backwards, from the position on
        _TABLES[lang] = [(brk, regex.compile(b, regex.REVERSE), regex.compile(a), _last(b)) for name in CASCADE[lang] for brk, b, a in rules[name]]
    return _TABLES[lang]


TERMINATOR = {
    "cased": regex.compile(rf"[.!?…]+(?:\s?[»”\"](?=[\s,;:.–—-]|$)|[{CLOSE}])*"),
    "el": regex.compile(rf"[.!?;…]+[{CLOSE}]*"),
    "cjk": regex.compile(rf"[.!?…。！？]+[{CLOSE_EAST}]*"),
    "indic": regex.compile(rf"[.!?…।॥]+[{CLOSE_EAST}]*"),
    "arabic": regex.compile(rf"[.!?…؟]+[{CLOSE_EAST}]*"),
}
_FAMILY = {"el": "el", "el-low": "el", "zh": "cjk", "ja": "cjk", "ko": "cjk", "hi": "indic", "ar": "arabic"}
_SCRIPTS = [("th", r"\p{Thai}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ko", r"\p{Hangul}"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"), ("ru", r"\p{Cyrillic}"), ("el", r"\p{Greek}")]
_SCRIPT_RE = [(k, regex.compile(p)) for k, p in _SCRIPTS]
_NON_LATIN = regex.compile(r"[Ͱ-\U0010ffff]")
_WORDS = re.compile(r"[^\W\d_]+")


_OF_CHAR: dict[str, str] = {}


def _script_of(c: str) -> str:
    """Script of a letter as far as the rules tell them apart, ``letter`` for others, empty for no letter."""
    if c not in _OF_CHAR:
        _OF_CHAR[c] = next((k for k, r in _SCRIPT_RE if r.match(c)), "letter" if c.isalpha() else "")
    return _OF_CHAR[c]


_LANGUAGES_OF: dict[str, tuple[str, ...]] = {w: tuple(k for k, ws in _WORD_SETS.items() if w in ws) for ws in _WORD_SETS.values() for w in ws}


def language(text: str) -> str:
    """Rule set of a stretch of prose."""
    if _NON_LATIN.search(text):
        counts: Counter[str] = Counter()
        for c, n in Counter(text).items():
            counts[_script_of(c)] += n
        marks = sum(n for c, n in Counter(text).items() if _script_of(c) and not c.isalpha())
        letters = sum(n for k, n in counts.items() if k) - marks
        east = counts["ja"] + counts["zh"]
        k = max((k for k, _ in _SCRIPTS), key=lambda k: counts[k])
        if east >= max(counts[k], 1) and east * 3 >= letters - east:
            return "ja" if counts["ja"] * 8 >= east else "zh"
        if counts[k] * 2 >= letters - counts[k] and counts[k]:
            if k not in ("ru", "el"):
                return k
            return k if regex.search(r"\p{Lu}", text) else f"{k}-low"
    words = _WORDS.findall(text)
    seen: Counter[str] = Counter()
    for w in map(str.lower, words):
        if w in _LANGUAGES_OF:
            seen.update(_LANGUAGES_OF[w])
    best = max(_WORD_SETS, key=lambda k: (seen[k], k == "en"))
    return best if not words or any(w[0].isupper() for w in words) else f"{best}-low"


LINE = regex.compile(r"[^\r\n\x85\u2028\u2029]+|\r\n|[\r\n\x85\u2028\u2029]")
UNIT = regex.compile(
    r"\s*(?:#{1,6}\s|>|[-*•‣◦·–—+]\s|\[[ xX]?\]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][)]\s|\||```|~~~|[-=_*|\s]+$|\*\*.*\*\*:?\s*$|__.*__:?\s*$)"
)
LABEL = regex.compile(r"\s*\p{L}[\p{L}\p{M}\s/'’-]{0,28}:\s+\S")
ENDED = regex.compile(rf"[.!?…。！？।॥؟;:][{CLOSE}]*\s*$")
USUAL = (71, 110)  # of texts with too few line breaks to learn from: a line this short wasn't wrapped, one this long wasn't either
LEAST_WIDTH, LEAST_BREAKS = 50, 4  # what a learned width needs
Width = tuple[int, int]  # a line stays under the first with the next word, or is over the second: its break was meant


def _first_word(line: str) -> str:
    return line.split(None, 1)[0] if line.strip() else ""


def wrap_width(text: str, lines: list) -> Width:
    """The width at which a text's prose was wrapped, learned from its line breaks.

    A wrapped line fits the width, as the next one does, but not with the next line's first word: each break inside a
    block allows a range of widths. The width that most breaks allow is taken if there are enough of them, more than half
    of all between lines of that length, and if most of the lines that follow don't begin with a capital.
    """
    spans = []
    for one, two in zip(lines, lines[1:]):
        if one is None or two is None:
            continue
        x, y = text[one[0] : one[1]].rstrip(), text[two[0] : two[1]].rstrip()
        if not _hard_unit(y):
            spans.append((max(len(x), len(y)), len(x) + len(_first_word(y)), len(x), y.lstrip()[:1].isupper()))
    if len(spans) < LEAST_BREAKS:
        return USUAL
    steps: Counter[int] = Counter()
    for low, high, *_ in spans:
        if high >= max(low, LEAST_WIDTH):
            steps[max(low, LEAST_WIDTH)] += 1
            steps[high + 1] -= 1
    most, at, width = 0, 0, 0
    for w in sorted(steps):
        at += steps[w]
        if at > most:
            most, width = at, w
    capitals = sum(c for low, high, _, c in spans if low <= width <= high)
    if most < LEAST_BREAKS or 2 * most <= sum(n > width // 2 for _, _, n, _ in spans) or 3 * capitals > 2 * most:
        return USUAL
    return width, width


def _wrapped(line: str, following: str, width: Width) -> bool:
    """True if the line break only wraps running prose: the next word wouldn't have fitted."""
    n = len(line.rstrip())
    return n + 1 + len(_first_word(following)) > width[0] and n <= width[1]


def _is_notes(text: str, lines: list, i: int, width: Width) -> bool:
    """True for a block without any full stop in which not every line fills the width: notes, one a line."""
    own = []
    while i < len(lines) and lines[i] is not None:
        own.append(text[lines[i][0] : lines[i][1]])
        i += 1
    own = [x for x in own if not UNIT.match(x)]
    return not any(_STOP.search(x) for x in own) and not all(_wrapped(x, y, width) for x, y in zip(own, own[1:]))


_STOP = regex.compile(r"[.!?…。！？।؟](?:\s|$)")


def stretches(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is_unit) of units and of stretches of running prose."""
    lines: list = []
    for m in LINE.finditer(text):
        if m[0][0] in "\r\n\x85\u2028\u2029":
            if not lines or lines[-1] is not None and lines[-1][2]:
                lines.append(None)
            elif lines[-1] is not None:
                lines[-1] = (*lines[-1][:2], True)
        elif m[0].strip():
            lines.append((m.start(), m.end(), False))
        else:
            # white space only: the line break that follows makes a blank line
            if lines and lines[-1] is not None:
                lines[-1] = (*lines[-1][:2], True)
    start = end = prev = None
    notes = False
    width = wrap_width(text, lines)
    for i, ln in enumerate(lines):
        if ln is None:
            if start is not None:
                yield start, end, False
            start = prev = None
            continue
        a, b, _ = ln
        s = text[a:b]
        if i == 0 or lines[i - 1] is None:
            notes = _is_notes(text, lines, i, width)
        if start is not None and not notes and _wrapped(text[prev[0] : prev[1]], s, width) and not _hard_unit(s):
            end = b
        else:
            if start is not None:
                yield start, end, False
            start = None
            nxt = lines[i + 1] if i + 1 < len(lines) and lines[i + 1] is not None else None
            goes_on = not notes and nxt is not None and _wrapped(s, text[nxt[0] : nxt[1]], width) and not _hard_unit(text[nxt[0] : nxt[1]])
            if UNIT.match(s) or not goes_on and LABEL.match(s) and not ENDED.search(s):
                yield a, b, True
            else:
                start, end = a, b
        prev = ln
    if start is not None:
        yield start, end, False


_HARD = regex.compile(r"\s*(?:#{1,6}\s|\||```|~~~|[•‣◦]\s|\[[ xX]?\]\s|[-*]\s|\d{1,2}\)\s|\*\*.*\*\*:?\s*$|__.*__:?\s*$)")


def _hard_unit(line: str) -> bool:
    return bool(_HARD.match(line))


def boundaries(s: str, lang: str) -> list[int]:
    """End positions of the sentences inside a stretch of prose."""
    if lang == "th":
        out = []
        for m in regex.finditer(r"\s+", s):
            a, b = m.span()
            if a and b < len(s) and not s[a - 1].isdigit() and not s[b].isdigit() and not (s[a - 1].isascii() and s[b].isascii() and s[b].isalnum()):
                out.append(a)
        return out
    fam = _FAMILY.get(lang, "cased")
    out, begin = [], 0
    for m in TERMINATOR[fam].finditer(s):
        p = m.end()
        if p >= len(s):
            break
        for brk, b, a in _rules_for(lang, s[p - 1]):
            if b.search(s, begin, p) and a.match(s, p):
                if brk:
                    out.append(p)
                    begin = p
                break
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, in order."""
    out: list[tuple[int, int]] = []
    if not text or not text.strip():
        return out
    for a, b, unit in stretches(text):
        s = text[a:b]
        cuts = [] if unit else boundaries(s, language(s))
        for x, y in zip([0, *cuts], [*cuts, len(s)]):
            piece = s[x:y]
            if piece.strip():
                lead = len(piece) - len(piece.lstrip())
                out.append((a + x + lead, a + x + len(piece.rstrip())))
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos) of every sentence."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sentences(t) for t in b.column(1).to_pylist()]
            owner = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array([x for f in found for x, _ in f], pa.int64()), pa.array([y for f in found for _, y in f], pa.int64())], names=[key, "start_pos", "end_pos"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, start_pos bigint, end_pos bigint")
