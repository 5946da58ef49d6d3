"""Mapping of free-entered values to the entries of a reference list (problem 1).

Method: prefix-filter set-similarity join. Distinct typed values and list entries become sets of character
2-grams; grams are ordered by global rarity; only the rare prefixes are joined, under the length and positional
filters; Jaccard is verified exactly on the surviving pairs. A pair counts only if its words can be aligned (typos,
abbreviations, changed order, words run together, look-alike letters); of those the highest Jaccard is kept. Values are handled once each, however many rows carry them.

Words of any script count. What often stands beside an entry without meaning it (remarks in brackets, single letters,
words with a digit, ``NOISE_WORDS``) may stay without a partner at no cost, but where the entry has such a word it must
be the same: ``form 990`` isn't ``form 1040``.

Defined results: null and blank values are left out; letter-for-letter entries are left out (``unmatched_only``);
a value without an accepted entry gets ``none``; ties go to the entry with more of the
typed marks, to the better alignment, then to the smaller reference id; null
entries are no entries; an empty list gives ``none`` for every value; columns named like those used here may occur.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.runtime import materialize

JACCARD = 0.35  # least gram similarity of a candidate
LEAST = 0.45  # least alignment
NONE = "none"
BLANK = r"^[\s\p{Z}\p{Cc}]*$"

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "авеікмнорстухѕјԁһԛԝіαβεηικνορτυχγ",
    "abeikmhopctyxsjdhqwiabenikvoptuxy",
)
_LOOKALIKE = frozenset(map(chr, LOOKALIKES))
# Words that often stand beside an entry.
NOISE_WORDS = frozenset({"copy", "new", "draft", "old", "final"})
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_REMARK = regex.compile(r"\([^)]*\)|\[[^\]]*\]")
_LATIN = regex.compile(r"[a-z]")
_DIGIT = regex.compile(r"\p{N}")


def _plain(value: str) -> str:
    """Lower case, without accents."""
    s = unicodedata.normalize("NFKD", value)
    return unicodedata.normalize("NFC", "".join(c for c in s if not unicodedata.combining(c))).lower()


def _latin(word: str, whole: bool) -> str:
    """Look-alike letters made Latin in a word that mixes scripts, or has nothing else (``whole``)."""
    mixed = _LATIN.search(word) or whole and all(c in _LOOKALIKE or c.isdigit() for c in word)
    return word.translate(LOOKALIKES) if mixed else word


def _is_mark(word: str) -> bool:
    return len(word) == 1 and word.isascii() or bool(_DIGIT.search(word)) or _stem(word) in NOISE_WORDS


def fold_entry(value: str) -> str:
    """Words of a list entry."""
    s = _plain(value)
    return " ".join(_latin(w, False) for w in _WORDS.findall(s))


def fold(value: str) -> list[str]:
    """``words|marks`` of a typed value; two readings if all its letters could be Latin as well as not."""
    s = _plain(value)
    latin = bool(_LATIN.search(s))
    out = []
    letters = [c for c in s if c.isalpha()]
    for whole in (False, True) if not latin and letters and all(c in _LOOKALIKE for c in letters) else (latin,):
        words = [_latin(w, whole) for w in _WORDS.findall(_REMARK.sub(" ", s))]
        beside = [_latin(w, whole) for m in _REMARK.findall(s) for w in _WORDS.findall(m)]
        own, marks = [w for w in words if not _is_mark(w)], [w for w in words if _is_mark(w)] + beside
        if not own:
            own, marks = words or beside, beside if words else []
        out.append(f"{' '.join(own)}|{' '.join(marks)}")
    return out


def _stem(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def grams(folded: str) -> list[str]:
    """Distinct 2-grams of the words, each word marked at both ends."""
    return list(dict.fromkeys(p[i : i + 2] for w in folded.split() for p in [f"^{_stem(w)}$"] for i in range(len(p) - 1)))


def _edits(a: str, b: str, most: int) -> int:
    """Optimal-string-alignment distance, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, cur[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            cur.append(v)
        if min(cur) > most + 1:
            return most + 1
        two, one = one, cur
    return one[-1]


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def word_score(typed: str, entry: str) -> float:
    """How well one typed word stands for one entry word: 0 (not at all) to 1."""
    t, e = _stem(typed), _stem(entry)
    if t == e:
        return 1.0
    if _DIGIT.search(typed) or _DIGIT.search(entry):
        return 0.0
    most = 1 if min(len(t), len(e)) < 5 else 2
    if len(e) > 2 and len(t) > 2 and (d := _edits(t, e, most)) <= most and d < max(len(t), len(e)) / 2:
        return 1 - 0.15 * d
    if len(t) >= 3 and e.startswith(t):
        return 0.8
    if 4 <= len(t) < len(e) and _edits(t, e[: len(t)], 1) <= 1:
        return 0.65
    if any(2 <= len(x) < len(y) and x[0] == y[0] and x[-1] == y[-1] and _subsequence(x, y) for x, y in ((t, e), (typed, entry))):
        return 0.7  # consonants kept: rpt, agrmt, bkg
    if len(t) >= 3 and len(t) < len(e) and t[0] == e[0] and _subsequence(t, e):
        return 0.55
    return 0.0


def run_together(typed: str, words: list[str], any_order: bool, cut: bool) -> float:
    """How well ``typed`` is the words run together, in their or in any order; with ``cut`` it may break off early.

    Orders are built word by word and given up as soon as no continuation can be near enough, so that their number
    doesn't matter.
    """
    total, n = sum(map(len, words)), len(typed)
    spread = max(1, total // 7)
    have, want = Counter(typed), Counter("".join(words))
    extra, missing = sum((have - want).values()), sum((want - have).values())
    if extra > spread or not cut and missing > spread:
        return 0.0
    best = 0.0

    def may_break(first: int) -> bool:
        return cut and first > 0 and n >= max(first + 3, 0.6 * total)

    def go(left: Counter, at: int, before: str, two: list[int] | None, one: list[int], first: int) -> None:
        nonlocal best
        if at == total or may_break(first) and at >= n:
            d = one[n]
            if d <= max(1, at // 7):
                best = max(best, (1 - d / max(n, at)) * (0.9 if at < total else 1))
            return
        for w in list(left) if any_order else [words[len(words) - left.total()]]:
            part = w[: n - at] if may_break(first or len(w)) else w
            prev, row, last = two, one, before
            for x in part:
                cur = [row[0] + 1]
                for j, y in enumerate(typed, 1):
                    v = min(row[j] + 1, cur[-1] + 1, row[j - 1] + (x != y))
                    if prev and j > 1 and x == typed[j - 2] and last == y:
                        v = min(v, prev[j - 2] + 1)
                    cur.append(v)
                prev, row, last = row, cur, x
                if min(cur) > spread + 1:
                    break
            else:
                go(left - Counter([w]), at + len(part), last, prev, row, first or len(w))

    go(Counter(words), 0, "", None, list(range(n + 1)), 0)
    return best


def align(typed: str, entry: str) -> tuple[float, float, int]:
    """(share of agreement, Jaccard, number of marks used) of a typed value (as of ``fold``) and an entry.

    The share is 0 unless every typed word finds its own entry word. The Jaccard is that of the words and the used marks.
    """
    own, _, beside = typed.partition("|")
    a, b = own.split(), entry.split()
    if not a or not b:
        return 0.0, 0.0, 0
    n_own = len(a)
    # marks count where the entry has them
    free = Counter(map(_stem, b)) - Counter(map(_stem, a))
    open_ = []
    for w in beside.split():
        if free[_stem(w)] > 0:
            free[_stem(w)] -= 1
            a.append(w)
        else:
            open_.append(w)
    lone = [w for w, k in free.items() if k > 0]
    for alike in (lambda w: bool(_DIGIT.search(w)), lambda w: len(w) == 1):
        if any(map(alike, open_)) and any(map(alike, lone)):
            return 0.0, 0.0, 0
    best_whole = run_together("".join(a), b, len(a) < len(b), len(a) == 1 < len(b))
    score, free = 0.0, list(b)
    for w in sorted(a, key=len, reverse=True):
        s, pick = max(((word_score(w, x), x) for x in free), default=(0.0, ""))
        if s == 0.0:
            score = 0.0
            break
        free.remove(pick)
        score += s
    if len(b) > 1 and len(a) == 1:
        score = 0.0  # one word of several is not enough
    x, y = set(grams(" ".join(a))), set(grams(entry))
    return max(best_whole, score / max(len(a), len(b)) if score else 0.0), len(x & y) / len(x | y), len(a) - n_own


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_udf(v: pd.Series) -> pd.Series:
    return v.map(lambda x: [] if x is None else fold(x))


@F.pandas_udf(T.StringType())
def fold_entry_udf(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else fold_entry(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def grams_udf(v: pd.Series) -> pd.Series:
    return v.map(lambda x: [] if x is None else grams(x))


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("jaccard", T.DoubleType()), T.StructField("marks", T.IntegerType())]))
def align_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [align(x or "", y or "") for x, y in zip(a, b)]
    return pd.DataFrame({"score": pd.Series([x[0] for x in found], dtype="float64"), "jaccard": pd.Series([x[1] for x in found], dtype="float64"), "marks": pd.Series([x[2] for x in found], dtype="int32")})


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``left(lid, toks)`` and ``right(rid, toks)`` whose token sets have Jaccard of at least ``threshold``.

    Result: lid, rid, jaccard. Exact: any pair at the threshold shares a token among both rarest prefixes.
    """
    both = left.select(F.lit(0).alias("side"), F.col("lid").alias("id"), "toks").unionByName(right.select(F.lit(1).alias("side"), F.col("rid").alias("id"), "toks"))
    both = materialize(both.filter(F.size("toks") > 0), "tokens")
    long = both.select("side", "id", F.explode("toks").alias("tok"))
    freq = long.groupBy("tok").agg(F.count("*").alias("df"))
    ranked = long.join(freq, "tok").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    ranked = materialize(ranked.select("side", "id", F.transform("o", lambda x: x["tok"]).alias("toks"), F.size("o").alias("n")), "ranked")
    pre = ranked.withColumn("p", F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("side", "id", "n", "toks", F.posexplode(F.slice("toks", F.lit(1), F.col("p").cast("int"))).alias("pos", "tok"))
    a = pre.filter("side = 0").select(F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("pos").alias("lp"), "tok", F.col("toks").alias("lt"))
    b = pre.filter("side = 1").select(F.col("id").alias("rid"), F.col("n").alias("rn"), F.col("pos").alias("rp"), "tok", F.col("toks").alias("rt"))
    need = F.ceil((F.col("ln") + F.col("rn")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    cand = a.join(b, "tok").filter((F.col("rn") >= F.col("ln") * threshold) & (F.col("ln") >= F.col("rn") * threshold) & (F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) + F.least("lp", "rp") >= need))
    cand = cand.groupBy("lid", "rid").agg(F.first("lt").alias("lt"), F.first("rt").alias("rt"))
    both_n = F.size(F.array_intersect("lt", "rt"))
    return cand.withColumn("jaccard", both_n / (F.size("lt") + F.size("rt") - both_n)).filter(F.col("jaccard") >= threshold).select("lid", "rid", "jaccard")


def map_values(values: DataFrame, entries: DataFrame, threshold: float = JACCARD, least: float = LEAST) -> DataFrame:
    """Best entry for each row of ``values([field,] value)`` (distinct, not blank) among ``entries([field,] ref_id, entry)``.

    Values meet the entries of their own field only. Result: [field,] value, ref_id (``none`` if no entry is meant),
    score (null for none).
    """
    spark = values.sparkSession
    one = "field" not in values.columns
    if one:
        values, entries = values.withColumn("field", F.lit("")), entries.withColumn("field", F.lit(""))
    v = materialize(values.select("field", "value", fold_udf("value").alias("readings")), "folded").select("field", "value", F.explode_outer("readings").alias("folded"))
    e = materialize(entries.select("field", "ref_id", fold_entry_udf("entry").alias("words")), "entries")
    sides = F.split(F.col("folded"), r"\|")
    # a typed value is looked for without its marks, and with them
    sets = F.array_distinct(F.array(sides[0], F.concat_ws(" ", sides[0], sides[1])))
    tag = lambda field, g: F.transform(g, lambda t: F.concat(F.col(field), F.lit("\x1f"), t))
    left = v.select("field", "folded").distinct().select("field", "folded", F.posexplode(sets).alias("k", "words"))
    left = left.select(F.concat_ws("\x1f", "field", "folded", F.col("k").cast("string")).alias("lid"), tag("field", grams_udf("words")).alias("toks"))
    right = e.select("field", "words").distinct().select(F.concat_ws("\x1f", "field", "words").alias("rid"), tag("field", grams_udf("words")).alias("toks"))
    pairs = set_similarity_join(left, right, threshold)
    at = lambda c, i: F.split(F.col(c), "\x1f")[i]
    pairs = pairs.select(at("lid", 0).alias("field"), at("lid", 1).alias("folded"), at("rid", 1).alias("words")).distinct()
    # few rows, costly each: spread over all tasks whatever their bytes
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    aligned = pairs.repartition(spread).withColumn("a", align_udf("folded", "words")).select("field", "folded", "words", "a.*")
    scored = materialize(aligned, "scored").filter(F.col("score") >= least)
    full = scored.join(e, ["field", "words"])
    best = full.groupBy("field", "folded").agg(F.min_by(F.struct("ref_id", "score", "jaccard", "marks"), F.struct(-F.col("jaccard"), -F.col("marks"), -F.col("score"), "ref_id")).alias("b"))
    out = v.join(best, ["field", "folded"], "left").groupBy("field", "value").agg(F.min_by("b", F.struct(F.col("b").isNull(), -F.col("b.jaccard"), -F.col("b.marks"), -F.col("b.score"), F.col("b.ref_id"))).alias("b"))
    return out.select(*["field"] * (not one), "value", F.coalesce("b.ref_id", F.lit(NONE)).alias("ref_id"), F.col("b.score").alias("score"))


def typed_values(df: DataFrame, fields: dict[str, tuple[DataFrame, str, str]], key: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, distinct values, entries) in long form: ([key,] field, value), (field, value, n_rows, exact_id), (field, ref_id, entry)."""
    refs = None
    for name, (ref, ref_id, entry) in fields.items():
        r = ref.select(F.lit(name).alias("field"), F.col(ref_id).alias("ref_id"), F.col(entry).alias("entry")).filter(F.col("entry").isNotNull())
        refs = r if refs is None else refs.unionByName(r)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in fields])).alias("c")
    own = [F.col(key).alias("__k")] if key is not None else []
    rows = df.select(*own, cells).select(*["__k"] * len(own), "c.field", "c.value").filter(F.col("value").isNotNull() & ~F.col("value").rlike(BLANK))
    exact = refs.groupBy("field", F.col("entry").alias("value")).agg(F.min("ref_id").alias("exact_id"))
    values = rows.groupBy("field", "value").agg(F.count("*").alias("n_rows")).join(exact, ["field", "value"], "left")
    return rows, materialize(values, "values"), refs


def map_fields(df: DataFrame, key: str, fields: dict[str, tuple[DataFrame, str, str]], unmatched_only: bool = True) -> DataFrame:
    """One row (key, field_name, ref_id) for each row and field typed otherwise than its list has it.

    ``fields``: column name -> (list table, id column, entry column). With ``unmatched_only`` false, rows that
    are letter for letter an entry come out too.
    """
    rows, values, refs = typed_values(df, fields, key)
    known = map_values(values.filter("exact_id is null").select("field", "value"), refs).select("field", "value", "ref_id")
    if not unmatched_only:
        known = known.unionByName(values.filter("exact_id is not null").select("field", "value", F.col("exact_id").alias("ref_id")))
    return rows.join(materialize(known, "known"), ["field", "value"]).select(F.col("__k").alias(key), F.col("field").alias("field_name"), "ref_id")


def unmatched(df: DataFrame, fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(field_name, value, n_rows) of the typed values that mean no entry."""
    _, values, refs = typed_values(df, fields)
    best = map_values(values.filter("exact_id is null").select("field", "value"), refs)
    return best.filter(F.col("ref_id") == NONE).join(values, ["field", "value"]).select(F.col("field").alias("field_name"), "value", "n_rows")
