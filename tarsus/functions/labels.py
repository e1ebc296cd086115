"""Label and decision expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_trim

TAGS = ("Named-Entity Hallucination", "Temporal/Number Hallucination", "Factual Contradiction", "Conflict Hallucination", "K0wledge Source Conflict", "Grammar Hallucination", "Generic/Imprecise Hallucination", "Instruction Inconsistency", "Code-Switching")
CLASSES = ("clean", "factual_hallucination", "degeneration")


def resolve_threshold(stated: float, override: float | None, acknowledged: bool) -> float:
    """The threshold a scorer was made with; another one needs an acknowledgement."""
    if override is None or override == stated:
        return stated
    if not acknowledged:
        raise ValueError(f"threshold {override} differs from the scorer's {stated}; acknowledge the override")
    return override


def final_decision(route: Column, probability: Column, threshold: float) -> Column:
    """struct(decision, label, failure) of a routed answer; an unknown route is an error."""
    row = lambda d, label, f: F.struct(F.lit(d).alias("decision"), F.lit(label).cast("int").alias("label"), F.lit(f).alias("failure"))
    return (
        F.when(route == "degeneration", row("degeneration", None, 1))
        .when((route == "defer") & (probability >= threshold), row("factual_hallucination", 1, 1))
        .when((route == "defer") & (probability < threshold), row("clean", 0, 0))
        .otherwise(F.raise_error(F.concat(F.lit("no decision for route "), F.coalesce(route, F.lit("null")))).cast("struct<decision:string,label:int,failure:int>"))
    )


def decision(combined: Column, mechanical: Column) -> Column:
    """The combined decision, or the mechanical one where that is missing."""
    return F.coalesce(F.nullif(combined, F.lit("")), F.nullif(mechanical, F.lit("")))


def factual_label(d: Column) -> Column:
    return F.when(d == "clean", 0).when(d.isin("factual_hallucination", "hallucinated"), 1)


def is_degenerate(d: Column, reasons: Column) -> Column:
    """Also a clean row with reasons, which keeps its label."""
    return (F.coalesce(d, F.lit("")) == "degeneration") | (F.coalesce(reasons, F.lit("")) != "")


def audit_route(d: Column) -> Column:
    return F.when(d == "degeneration", "layer1_degeneration").when(d == "clean", "layer2_clean").when(d == "factual_hallucination", "layer2_hallucination").otherwise(F.raise_error(F.concat(F.lit("no audit route for "), F.coalesce(d, F.lit("null")))))


def threshold_band(p: Column, threshold: Column) -> Column:
    away = F.abs(p - F.coalesce(threshold, F.lit(0.5)))
    return F.when(p.isNull(), "not_applicable").when(away <= 0.05, "near_0.05").when(away <= 0.20, "near_0.20").otherwise("far")


def judge_route(p: Column) -> Column:
    return F.when(p.isNotNull(), "layer2").otherwise("layer1")


def review_state(choice: Column, rewrite: Column) -> Column:
    """approved, rewritten, dropped or unreviewed; a rewrite text beats everything but an approval."""
    c = F.upper(ws_trim(F.coalesce(choice, F.lit(""))))
    return F.when(c.startswith("A"), "approved").when(c.startswith("R") | (ws_trim(F.coalesce(rewrite, F.lit(""))) != ""), "rewritten").when(c.startswith("D"), "dropped").otherwise("unreviewed")


def provenance(state: Column) -> Column:
    return F.when(state == "approved", "machine").otherwise("human_rewrite")


def binary_annotation(label: Column) -> Column:
    """0, 1 or null of a validator's entry, with older and newer names; degeneration has none."""
    v = F.lower(ws_trim(label))
    return F.when(v.isin("1", "hallucinated", "hallucination", "h", "factual_hallucination"), 1).when(v.isin("0", "clean", "correct", "c"), 0)


def class_annotation(label: Column) -> Column:
    v = F.lower(ws_trim(label))
    return F.when(v.isin("0", "clean", "correct", "c"), "clean").when(v.isin("1", "hallucinated", "hallucination", "h", "factual_hallucination", "factual"), "factual_hallucination").when(v.isin("2", "degeneration", "degenerate", "d", "invalid"), "degeneration")


def valid_tags(tags: list[Column]) -> Column:
    return F.forall(F.array(*(ws_trim(F.coalesce(t, F.lit(""))) for t in tags)), lambda t: t.isin("", "0", "1"))


def binary_label(tags: list[Column], supplied: Column | None = None) -> Column:
    """1 if any tag is set; a supplied label must be 0 or 1 and agree."""
    any_ = F.exists(F.array(*(ws_trim(F.coalesce(t, F.lit(""))) for t in tags)), lambda t: t == "1").cast("int") if tags else None
    if supplied is None:
        return any_
    s = ws_trim(F.coalesce(supplied, F.lit("")))
    ok = s.isin("0", "1") if any_ is None else s.isin("0", "1") & (s == any_.cast("string"))
    return F.when(ok, s.cast("int")).otherwise(F.raise_error(F.concat(F.lit("label disagrees with tags: "), s)).cast("int"))


def fluency(c: Column) -> Column:
    """A number or null; blank, zero and unreadable ones are null."""
    return F.nullif(ws_trim(c).try_cast("double"), F.lit(0.0))


def positive_probability(l0: Column, l1: Column) -> Column:
    """Softmax of two logits, the second one's share."""
    return 1.0 / (1.0 + F.exp(l0 - l1))


def arm_seed(seed: int, *keys: Column) -> Column:
    """The first 16 hexadecimal digits of a SHA-256 as an unsigned decimal text."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256), 1, 16), 16, 10)


def chat(*turns: tuple[str, Column]) -> Column:
    """array of struct(role, content)."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def judge_input(variant: str, question: Column, gold: Column, answer: Column) -> Column:
    """The text pair for a judge: struct(context, answer). A blank question is an error where it is used."""
    if variant == "answer_only":
        context = F.lit("")
    elif variant == "gold_answer":
        context = gold
    elif variant == "question_gold_answer":
        asked = F.when(ws_trim(F.coalesce(question, F.lit(""))) != "", question).otherwise(F.raise_error(F.lit("blank question")))
        context = F.concat(asked, F.lit("\n"), gold)
    else:
        raise ValueError(f"unknown input variant {variant}")
    return F.struct(context.alias("context"), answer.alias("answer"))
