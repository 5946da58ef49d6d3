"""Surrogate generation for detected personal information (problem 5).

Every entity (a name part, or the value of another kind without case and spacing) receives a keyed replacement of its own
kind: digits for digits, letters of the same script and class (vowel, consonant) for letters, in the format of the
original. Name parts keep role, script and gender; their initial depends only on the original initial, so that
``T. Ostwold`` and ``Tamina Ostwold`` stay one person. Country codes of phone numbers and the notation of e-mail addresses
stay. Gender comes from the titles before a name's mentions, by majority over the whole corpus, else from its ending.

Equal entities get equal replacements everywhere (coreference). A collision check over all entities makes those that
collide try again, with one more letter or digit every eight attempts, until every replacement belongs to one entity of
its kind and is no entity itself (distinctness); so none ever equals an original. Nearly all entities keep their first
replacement, which the task that found the mention makes; only the others, with the mentions they are in, are looked at
again.

Defined results: null, blank and empty texts have no mention; a row whose key and text occur again is one row; a value
without any letter or digit gets a letter appended.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.runtime import materialize
from .pii import detectors, per_row, rows_for

# The alphabets that have vowels and consonants (vowels, consonants for new words, all letters), and the
# endings of invented names by gender and role.
ALPHABETS = {
    "LATIN": ("aeiou", "bcdfghjklmnprstvz", "abcdefghijklmnopqrstuvwxyz"),
    "CYRILLIC": ("аеиоу", "бвгджзклмнпрстфх", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    "GREEK": ("αειου", "βγδζθκλμνπρστφχ", "αβγδεζηθικλμνξοπρστυφχψω"),
}
ENDINGS = {
    ("LATIN", "f"): ("a", "elle", "ine", "isse"), ("LATIN", "m"): ("o", "en", "mar", "us"), ("LATIN", ""): ("berg", "mann", "sen", "well", "ton", "field", "ley", "ski"),
    ("CYRILLIC", "f"): ("а", "ина", "ия"), ("CYRILLIC", "m"): ("ан", "ор", "ий"), ("CYRILLIC", ""): ("енко", "ук", "ич", "ян"),
    ("GREEK", "f"): ("α", "ινα", "ουλα"), ("GREEK", "m"): ("ος", "ης", "ας"), ("GREEK", ""): ("ου", "ακη", "ιδη"),
}
FEMALE_ENDINGS = ("a", "e", "elle", "isse", "eth", "а", "я", "α", "η")
TITLES = {"f": "ms mrs miss frau mme madame mlle sra señora g-жа г-жа κα", "m": "mr herr mister m monsieur sr señor г-н κ κος"}
_TITLE_GENDER = {w: g for g, ws in TITLES.items() for w in ws.split()}
#: Country codes of one and of two digits; all others have three.
_SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
PARTICLES = frozenset("von van der den de del la le al el da di du bis ter".split())
_UNIT = re.compile(r"[^\W\d_]{2,}")
_SINGLE = re.compile(r"(?<!\w)[^\W\d_](?![\w'’])")
_AT = re.compile(r"@|\[at\]|\(at\)|\{at\}|<at>|at(?=[\w-]+dot)")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"\s+|\S+")
LONGER = 8  # attempts of one length
FEW = 10_000  # attempts of open entities that are made at once and settled by the driver; more are settled by joins, one attempt at a time


@lru_cache(100_000)
def _script(c: str) -> tuple[str, str]:
    """Script of a letter, and the plain lower-case letter without marks."""
    low = unicodedata.normalize("NFD", c.lower())[0]
    return unicodedata.name(low, "LATIN").split()[0], low


@lru_cache(4096)
def _neighbours(block: int, script: str, category: str) -> str:
    return "".join(c for c in map(chr, range(block, block + 128)) if unicodedata.category(c) == category and unicodedata.name(c, "").startswith(script))


@lru_cache(100_000)
def _letters(c: str) -> str:
    """The letters that may replace ``c``: of its alphabet and class, or of its place in a script without classes."""
    script, low = _script(c)
    if script in ALPHABETS:
        vowels, consonants, _ = ALPHABETS[script]
        return vowels if low in vowels else consonants
    return _neighbours(ord(c) & ~127, script, unicodedata.category(c)) or c


class _Pools(dict):
    """By character of a value that is no name: its replacement for each keyed byte; empty if it stays."""

    def __missing__(self, c: str) -> str:
        p = "0123456789" if c.isdigit() else _letters(c) if c.isalpha() else ""
        self[c] = out = p and "".join(p[x % len(p)] for x in range(256))
        return out


_POOLS = _Pools()


def _bytes(secret: bytes, n: int, *parts: str) -> Iterator[int]:
    """``n`` keyed bytes at least."""
    own = "\x1f".join(parts)
    if n < 64:
        return iter(hashlib.blake2b(f"0\x1f{own}".encode(), key=secret).digest())
    return iter(b"".join(hashlib.blake2b(f"{k}\x1f{own}".encode(), key=secret).digest() for k in range(n // 64 + 1)))


@lru_cache(100_000)
def initial(secret: bytes, c: str) -> str:
    """Replacement of an initial: a keyed permutation of its alphabet."""
    script, low = _script(c)
    every = ALPHABETS[script][2] if script in ALPHABETS else _neighbours(ord(low) & ~127, script, unicodedata.category(low))
    order = sorted(every, key=lambda x: hashlib.blake2b(x.encode(), key=secret).digest())
    return order[every.index(low)] if low in every else order[next(_bytes(secret, 1, "initial", c)) % len(order)] if order else "x"


def gender(given: str) -> str:
    """By the name's ending."""
    return "f" if given.endswith(FEMALE_ENDINGS) else "m"


def units(kind: str, value: str, roles: dict[str, str]) -> list[tuple[str, str]]:
    """Entities of a mention: its name parts (``given`` or ``family``), or the value itself without case and spacing."""
    if kind != "name":
        return [(kind, _SPACE.sub("", value).lower())]
    return [("given" if roles.get(w, "f") == "g" else "family", w) for w in map(str.lower, _UNIT.findall(value)) if w not in PARTICLES]


def surrogate(kind: str, canon: str, secret: bytes, attempt: int = 0, sex: str = "") -> str:
    """Replacement of one entity in canonical form."""
    more = attempt // LONGER
    s = _bytes(secret, len(canon) + 2 * more + 8, kind, canon, str(attempt))
    if kind in ("given", "family"):
        script, _ = _script(canon[0])
        out = [initial(secret, canon[0])]
        if script not in ALPHABETS:
            return out[0] + "".join((lambda p: p[next(s) % len(p)])(_letters(c)) for c in (canon[1:] or canon) + canon[-1] * more)
        vowels, consonants, _ = ALPHABETS[script]
        for _ in range(2 + more):
            out += vowels[next(s) % len(vowels)], consonants[next(s) % len(consonants)]
        ends = ENDINGS[script, "" if kind == "family" else sex or gender(canon)]
        return "".join(out) + ends[next(s) % len(ends)]
    keep = 0
    if kind == "phone" and canon[:1] == "+" or canon[:2] == "00":
        at = 1 if canon[0] == "+" else 2
        keep = at + next((n for n in (1, 2) if canon[at : at + n] in _SHORT_CODES), 3)
    made = list(canon[:keep])
    if not keep and canon[:1].isdigit():
        made.append("0" if canon[0] == "0" else "123456789"[next(s) % 9])
    made += [p[next(s)] if (p := _POOLS[c]) else c for c in canon[len(made) :]]
    extra = [str(next(s) % 10) if kind in ("phone", "id_number") else "abcdefghij"[next(s) % 10] for _ in range(more)]
    if kind == "email":  # the notation of "at" stays readable; the domain is one that can't exist
        at = _AT.search(canon)
        upto, sign = (at.start(), at[0]) if at else (len(canon), "@")
        return "".join([*made[:upto], *extra, sign, "example.invalid"])
    return "".join(made + extra)


def _styled(like: str, text: str) -> str:
    return text.upper() if like.isupper() and len(like) > 1 else text.capitalize() if like[:1].isupper() else text


def rewrite(kind: str, value: str, made: list[str], secret: bytes) -> str:
    """A mention with its entities replaced by ``made``, in the order of ``units``, in the format of the original."""
    if kind == "name":
        it = iter(made)
        done = _UNIT.sub(lambda m: m[0] if m[0].lower() in PARTICLES else _styled(m[0], next(it)), value)
        return _SINGLE.sub(lambda m: _styled(m[0], initial(secret, m[0].lower())), done)
    if kind == "email":
        return made[0]
    new, at, out = made[0], 0, []
    for part in _PARTS.findall(value):
        if part[0].isspace():
            out.append(part)
            continue
        own = new[at : at + len(part)]
        at += len(part)
        if part.isupper():
            own = own.upper()
        elif part[0].isupper() and not any(map(str.isupper, part[1:])):
            own = own[:1].upper() + own[1:]
        elif any(map(str.isupper, part)):
            own = "".join(x.upper() if c.isupper() else x for c, x in zip(part, own))
        out.append(own)
    return "".join(out) + new[at:]


def _title(text: str, start: int) -> str:
    before = text[max(0, start - 12) : start].split()
    return _TITLE_GENDER.get(before[-1].rstrip(".").lower(), "") if before and text[start - 1].isspace() else ""


def _found(key: str, kind_of_key: str, model: dict[str, str] | None, secret: bytes) -> tuple:
    """Mentions with their entities and first replacements; without a ``model`` each row has its own roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_row = detectors(model) if model is not None else per_row
        first = lru_cache(100_000)(lambda k, c: surrogate(k, c, secret))

        @lru_cache(50_000)
        def of_name(value: str, hint: str, roles: tuple) -> tuple[list[str], str]:
            own = units("name", value, dict(roles) if model is None else model)
            made = [first(*u) for u in own]
            ents = [f"{u}\x1f{c}\x1f{gender(c)}\x1f{hint}\x1f{m}" if u == "given" else f"{u}\x1f{c}\x1f\x1f\x1f{m}" for (u, c), m in zip(own, made)]
            return ents, rewrite("name", value, made, secret)

        def of(kind: str, value: str) -> tuple[list[str], str]:  # these hardly occur again
            ((_, c),) = units(kind, value, {})
            made = surrogate(kind, c, secret)
            return [f"{kind}\x1f{c}\x1f\x1f\x1f{made}"], rewrite(kind, value, [made], secret)

        for b in batches:
            owner, start, end, kinds, values, ents, at, repl = [], [], [], [], [], [], [0], []
            for i, (d, t) in enumerate(zip(of_row(b), b.column(2).to_pylist())):
                roles = tuple(d.model.items()) if model is None else ()
                for x, y, k in d.find(t):
                    v = t[x:y]
                    own, new = of_name(v, _title(t, x), roles) if k == "name" else of(k, v)
                    owner.append(i)
                    start.append(x)
                    end.append(y)
                    kinds.append(k)
                    values.append(v)
                    repl.append(new)
                    ents += own
                    at.append(len(ents))
            who, offsets = pa.array(owner, pa.int64()), pa.array(at, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ents, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), lists, pa.array(repl, pa.string())], names=[key, "same", "start_pos", "end_pos", "kind", "value", "entities", "replacement"])

    return run, f"{key} {kind_of_key}, same bigint, start_pos bigint, end_pos bigint, kind string, value string, entities array<string>, replacement string"


def settled(tries: Iterable[tuple[str, str, str, int]]) -> list[tuple[str, str, str]]:
    """(kind, canon, made) of ``tries(kind, canon, made, attempt)``: attempt by attempt, the first entity by name takes a replacement."""
    kept: dict[tuple[str, str], str] = {}
    used: set[tuple[str, str]] = set()
    for _, kind, canon, made in sorted((n, k, c, m) for k, c, m, n in tries):
        if (kind, canon) not in kept and (kind, made) not in used:
            kept[kind, canon] = made
            used.add((kind, made))
    return [(k, c, m) for (k, c), m in kept.items()]


def exceptions(entities: DataFrame, secret: bytes) -> DataFrame:
    """(kind, canon, made) of the entities that can't keep their first replacement.

    ``entities(kind, canon, made, given, sex)``: distinct, with the first replacement, the gender it was made for and the
    gender decided on. Only those still open are looked at again; each round writes what it settled.
    """

    @F.pandas_udf(T.StringType())
    def again(kind: pd.Series, canon: pd.Series, sex: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, secret, int(a), s) for k, c, s, a in zip(kind, canon, sex, attempt)], dtype=object)

    spark = entities.sparkSession
    # one pass over hashes finds the replacements that two entities share or that are an entity; they are few, and one too many only tries again
    fits = entities.filter("given = sex")
    of = lambda c, made, own: (F.xxhash64("kind", c).alias("h"), F.lit(made).alias("n"), F.lit(own).alias("o"))
    both = fits.select(*of("made", 1, 0)).unionByName(entities.select(*of("canon", 0, 1)))
    clash = materialize(both.groupBy("h").agg(F.sum("n").alias("n"), F.sum("o").alias("o")).filter("n > 1 or n > 0 and o > 0").select("h"), "clash")
    lost = fits.withColumn("h", F.xxhash64("kind", "made")).join(clash, "h", "left_semi").select("kind", "canon", "sex")
    originals = entities.select("kind", F.col("canon").alias("made"))
    open_ = materialize(lost.unionByName(entities.filter("given <> sex").select("kind", "canon", "sex")), "open")
    schema = "kind string, canon string, made string"
    done = spark.createDataFrame([], schema)
    attempt = 0
    while n := open_.count():
        width = max(1, min(LONGER, FEW // n))
        tried = open_.select("*", F.explode(F.sequence(F.lit(attempt), F.lit(attempt + width - 1))).alias("attempt"))
        tried = materialize(tried.withColumn("made", again("kind", "canon", "sex", "attempt")), "tried")
        taken = originals.unionByName(entities.select("kind", "made")).unionByName(done.select("kind", "made"))
        bad = taken.join(tried.select("kind", "made").distinct(), ["kind", "made"], "left_semi").distinct()
        free = tried.join(bad, ["kind", "made"], "left_anti")
        if n > FEW:
            won = free.groupBy("kind", "made").agg(F.min("canon").alias("canon")).select("kind", "canon", "made")
        else:
            won = spark.createDataFrame(settled(free.select("kind", "canon", "made", "attempt").collect()), schema)
        won = materialize(won, "settled")
        done = done.unionByName(won)
        open_ = materialize(open_.join(won, ["kind", "canon"], "left_anti"), "open")
        attempt += width
    return done


def replacements(df: DataFrame, model: dict[str, str] | DataFrame, secret: str, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, same, start_pos, end_pos, kind, value, replacement) of every mention; ``same`` tells texts of one key apart."""
    k = hashlib.blake2b(secret.encode()).digest()
    run, schema = _found(key, df.schema[key].dataType.simpleString(), None if isinstance(model, DataFrame) else model, k)
    rows = rows_for(df.filter(F.col(text).isNotNull()), model, key, text)
    found = materialize(rows.mapInArrow(run, schema), "mentions")
    part = lambda e, i: F.split(e, "\x1f")[i]
    long = found.select(F.explode("entities").alias("e")).select(*(part("e", i).alias(c) for i, c in enumerate(("kind", "canon", "given", "hint", "made"))))
    per = long.groupBy("kind", "canon", "made", "given").agg(F.count_if(F.col("hint") == "f").alias("nf"), F.count_if(F.col("hint") == "m").alias("nm"))
    sex = F.when(F.col("nf") > F.col("nm"), "f").when(F.col("nm") > F.col("nf"), "m").otherwise(F.col("given"))
    entities = materialize(per.select("kind", "canon", "made", "given", sex.alias("sex")), "entities")
    other = materialize(exceptions(entities, k), "exceptions")
    at = found.select(key, "same", "start_pos", F.posexplode("entities").alias("i", "e")).select(key, "same", "start_pos", "i", part("e", 0).alias("kind"), part("e", 1).alias("canon"))
    fixes = materialize(at.join(other, ["kind", "canon"]).groupBy(key, "same", "start_pos").agg(F.map_from_entries(F.collect_set(F.struct("i", "made"))).alias("fix")), "fixes")

    @F.pandas_udf(T.StringType())
    def rewritten(kind: pd.Series, value: pd.Series, made: pd.Series) -> pd.Series:
        return pd.Series([rewrite(a, v, list(m), k) for a, v, m in zip(kind, value, made)], dtype=object)

    cols = [key, "same", "start_pos", "end_pos", "kind", "value"]
    fixes = fixes.hint("shuffle_hash")  # a part of them is small, and the mentions needn't be sorted
    whole = found.join(fixes, [key, "same", "start_pos"], "left_anti").select(*cols, "replacement")
    fixed = F.transform("entities", lambda e, i: F.coalesce(F.element_at("fix", i), part(e, 4)))
    return whole.unionByName(found.join(fixes, [key, "same", "start_pos"]).select(*cols, rewritten("kind", "value", fixed).alias("replacement")))


def pseudonymize(df: DataFrame, model: dict[str, str] | DataFrame, secret: str, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, text) with each mention replaced by its surrogate. Null texts stay null."""
    spans = replacements(df, model, secret, key, text).groupBy(key, "same").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "replacement"))).alias("spans"))
    rows = df.select(key, text, F.xxhash64(text).alias("same")).join(spans, [key, "same"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, sp in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for m in reversed(sp or ()):
                    t = t[: m["start_pos"]] + m["replacement"] + t[m["end_pos"] :]
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return rows.select(key, text, "spans").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")
