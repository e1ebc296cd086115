"""Text expressions: Python-faithful normalization, token overlap and degeneration tests, all native columns.

Only ``nfkc`` and ``sequence_ratio`` cross into Python (Arrow batches); everything else stays
inside whole-stage code generation or array lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.strip and split see it.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
INK = r"[^\p{IsWhite_Space}\x1c-\x1f]"
DIACRITICS = "[\u064B-\u065F\u0670\u0640]"
CJK = "[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF]"
PROCLITICS = "وفبكل"
REASONS = ("generation_error", "empty_answer", "foreign_script_heavy", "role_marker", "code_fence", "heavy_repetition")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def ws_split(c: Column) -> Column:
    """Words between white space; no word for a blank text."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


#: Characters beyond ASCII that compatibility composition leaves as they are, whatever is beside them; the Arabic marks among them are dropped anyway.
STABLE = (
    "\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    "\u0400-\u0482\u048a-\u052f\u0600-\u060f\u061b-\u064a\u064b-\u0652\u0660-\u0674\u0679-\u06d3\u06d5"
    "\u2010\u2012-\u2016\u2018-\u2023\u2030-\u2032\u2039-\u203b\u3001-\u3029\u3030-\u3035\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
)


def ascii_only(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


@F.pandas_udf(T.StringType())
def _nfkc(s):  # noqa: ANN001, ANN201
    return s.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Compatibility composition, which Spark lacks. Only texts with a character outside STABLE have to go to Python.

    ASCII is told first: it would be compared with all ranges of STABLE, one by one, and most characters are.
    """
    return F.coalesce(_nfkc(F.when(~ascii_only(c) & c.rlike(rf"[[^\x00-\x7f]&&[^{STABLE}]]"), c)), c)


def normalize_arabic(c: Column, compatibility: bool = True, lower: bool = True) -> Column:
    """Compatibility composition, Arabic letter variants folded, diacritics dropped, non-word characters turned to single spaces."""
    c = nfkc(c) if compatibility else c
    c = F.when(ascii_only(c), c).otherwise(F.translate(F.regexp_replace(c, DIACRITICS, ""), "أإآىة", "ااايه"))
    c = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))
    return F.lower(c) if lower else c


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def overlap_f1(left: Column, right: Column) -> Column:
    """F1 of two arrays of distinct tokens; 0 without overlap."""
    both = F.size(F.array_intersect(left, right))
    return F.when(both > 0, 2.0 * both / (F.size(left) + F.size(right))).otherwise(0.0)


def token_f1(left: Column, right: Column, compatibility: bool = True, lower: bool = True) -> Column:
    bag = lambda c: F.array_distinct(words(normalize_arabic(text_or_empty(c), compatibility, lower)))
    return overlap_f1(bag(left), bag(right))


def gold_variants(gold: Column) -> Column:
    """Reference variants of a delimited field; a comma between digits is a decimal point."""
    kept = F.regexp_replace(gold, r"(?U)(?<=\d),(?=\d)", "\x01")
    parts = F.transform(F.split(kept, r"[,;|،]"), lambda x: F.replace(ws_trim(x), F.lit("\x01"), F.lit(",")))
    parts = F.filter(parts, lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(ws_trim(gold)))


def forms(token: Column) -> Column:
    """A token, and without one and two leading proclitic letters as long as more than three letters are left."""
    def loose(t: Column) -> Column:
        return (F.length(t) > 3) & F.substring(t, 1, 1).isin(*PROCLITICS)

    one = F.substring(token, 2, 1 << 30)
    two = F.substring(token, 3, 1 << 30)
    return F.when(~loose(token), F.array(token)).when(~loose(one), F.array(token, one)).otherwise(F.array(token, one, two))


def token_coverage(answer: Column, gold: Column) -> Column:
    """The largest share of a variant's tokens of which the answer holds a form."""
    known = F.flatten(F.transform(words(normalize_arabic(answer)), forms))
    # variants part before composition, which goes to Python and so can't be inside a lambda; nothing composes across \x02
    composed = F.split(nfkc(F.array_join(gold_variants(gold), "\x02")), "\x02")
    variants = F.transform(composed, lambda v: F.array_distinct(words(normalize_arabic(v, compatibility=False))))
    # both sides go in as arguments: a lambda can't hold what comes from Python
    share = lambda v, k: F.size(F.filter(v, lambda t: F.arrays_overlap(forms(t), k))) / F.size(v)
    best = lambda s: F.array_max(F.transform(F.filter(s["v"], lambda v: F.size(v) > 0), lambda v: share(v, s["k"])))
    return F.coalesce(F.transform(F.array(F.struct(known.alias("k"), variants.alias("v"))), best)[0], F.lit(0.0))


def heavy_foreign_script(c: Column, least: int = 3, density: float = 0.1) -> Column:
    count = lambda kind: F.length(F.regexp_replace(c, f"[^{kind}]+", ""))  # noqa: E731 - regexp_count makes an array of every match
    foreign, letters = count(CJK[1:-1]), count(r"\p{L}")
    return ~ascii_only(c) & c.rlike(CJK) & (foreign >= least) & (letters > 0) & (foreign >= density * letters)  # most texts have none, and aren't counted


def heavy_repetition(normalized: Column, repeats: int = 4) -> Column:
    """Whether a run of one to three words occurs ``repeats`` times in a row. Words are taken whole (possessively), so that none is tried letter by letter."""
    again = "{%d}" % (repeats - 1)
    return F.concat(F.lit(" "), normalized).rlike(rf" ([^ ]++)(?:(?: \1){again}|( [^ ]++)(?:(?: \1\2){again}|( [^ ]++)(?: \1\2\3){again}))(?= |$)")


def degeneration_reasons(answer: Column, error: Column) -> Column:
    """Mechanical faults of an answer, in a fixed order."""
    tests = (
        ws_trim(error) != "",
        ~answer.rlike(INK),
        heavy_foreign_script(answer),
        answer.rlike(rf"(?i)(?:^|\n){WS}*(?:assistant|user|system){WS}*:"),
        answer.contains("```"),
        heavy_repetition(normalize_arabic(answer)),
    )
    return F.filter(F.array(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS))), lambda x: x.isNotNull())


def score_answer(answer: Column, gold: Column, error: Column) -> Column:
    """struct(coverage, decision, reasons); coverage never decides."""
    reasons = degeneration_reasons(answer, error)
    return F.struct(token_coverage(answer, gold).alias("coverage"), F.when(F.size(reasons) > 0, "degeneration").otherwise("defer").alias("decision"), reasons.alias("reasons"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of normalized texts as a share of the longer; 0 for two empty ones."""
    a, b = normalize_arabic(a), normalize_arabic(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a, b):  # noqa: ANN001, ANN201
    """difflib's similarity of two texts."""
    import difflib

    import pandas as pd

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def qc_flags(source: Column, candidate: Column, back: Column, drift_below: float = 0.5, unchanged_from: float = 0.95) -> Column:
    """Translation flags: MEANING_DRIFT, BARELY_TRANSLATED, TOO_LONG, LATIN_TEXT; ``back`` is a similarity or null."""
    tests = (
        (back < drift_below, "MEANING_DRIFT"),
        (token_f1(source, candidate) >= unchanged_from, "BARELY_TRANSLATED"),
        (F.size(ws_split(candidate)) > 2 * F.size(ws_split(source)), "TOO_LONG"),
        (candidate.rlike("[A-Za-z]{3,}"), "LATIN_TEXT"),
    )
    return F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())


def fixed(c: Column, places: int) -> Column:
    """Text of a number, rounded by its exact binary value as Python's format does; null of null."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clipped to [-1, 1]; null if one is null or zero; lengths that differ are an error."""
    same = F.assert_true(F.coalesce(F.size(a) == F.size(b), F.lit(True)), "vectors of different length")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(same.isNull() & value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def parse_scores(text: Column, names: tuple[str, ...] = ("quality", "fluency", "coherence", "understandability")) -> Column:
    """struct of the first number on the last line that begins with each name; null unless all are there."""
    lines = F.split(text, "\n")

    def of(name: str) -> Column:
        return F.filter(lines, lambda x: F.lower(ws_trim(x)).startswith(name) & x.rlike(r"\d"))

    got = []
    for n in names:
        mine = of(n)
        got.append(F.regexp_extract(F.try_element_at(mine, F.lit(-1)), r"(\d+(?:\.\d+)?)", 1).try_cast("double").alias(n))
    every = got[0].isNotNull()
    for g in got[1:]:
        every = every & g.isNotNull()
    return F.when(every, F.struct(*got))
