"""Prompts for translation and generation, worded here; each stage takes others instead."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import chat
from .text import ws_trim

#: What the varieties are called in prompts.
DIALECTS = {"gulf": "Gulf Arabic", "egyptian": "Egyptian Arabic", "levantine": "Levantine Arabic", "sudanese": "Sudanese Arabic"}


@dataclass(frozen=True)
class Translation:
    """System texts of a translator and of a back-translator; {speaker}, {dialect} and {spelling} are filled in."""

    system: str = "As a native speaker of {speaker}, put each question into everyday {dialect}. Keep its meaning, names, numbers and dates unchanged, and its answer too. {spelling}Reply with the question alone and do not answer it."
    spelling: str = "Spell by the CODA convention, in Arabic script and without vowel marks. "
    back: str = "Put each {dialect} question into Modern Standard Arabic without changing what it asks. Reply with the question alone."

    def translator(self, dialect: str, sub_variety: str = "", coda: bool = True) -> str:
        name = DIALECTS[dialect]
        return self.system.format(speaker=f"{sub_variety} {name}" if sub_variety else name, dialect=name, spelling=self.spelling if coda else "")

    def back_translator(self, dialect: str) -> str:
        return self.back.format(dialect=DIALECTS[dialect])


@dataclass(frozen=True)
class Conditions:
    """System texts by condition; {variety} is the row's. The direct condition has none; a pivot first asks for ``pivot`` and then answers as ``msa_answer``."""

    system: dict[str, str] = field(default_factory=lambda: {
        "msa_answer": "اكتب الجواب بالفصحى الحديثة مهما كانت لهجة السؤال.",
        "dialect_aware": "لهجة السؤال الآتي: {variety}. افهمه بلهجته ثم أجب بدقة.",
        "msa_restate": "اكتب السؤال بالفصحى أولا ثم اكتب جوابه الدقيق تحته.",
        "msa_pivot": "اكتب الجواب بالفصحى الحديثة مهما كانت لهجة السؤال.",
    })
    pivot: str = "انقل السؤال إلى الفصحى الحديثة بلا تغيير في معناه، واكتب السؤال وحده."

    def messages(self, condition: Column, variety: Column, question: Column) -> Column:
        """array of struct(role, content); a condition without a text is the question alone."""
        out = chat(("user", question))
        for name, text in self.system.items():
            system = F.replace(F.lit(text), F.lit("{variety}"), variety)
            out = F.when(condition == name, chat(("system", system), ("user", question))).otherwise(out)
        return out

    def pivot_messages(self, condition: Column, question: Column) -> Column:
        """What is asked for first in a pivot, else null."""
        return F.when(condition == "msa_pivot", chat(("system", F.lit(self.pivot)), ("user", question)))


def few_shot(system: str, exemplars: list[tuple[str, str]], question: Column) -> Column:
    """The system text, exemplars as earlier turns, and the question. The exemplars are a few hand-written pairs."""
    turns = [("system", F.lit(system))]
    for asked, said in exemplars:
        turns += [("user", F.lit(asked)), ("assistant", F.lit(said))]
    return chat(*turns, ("user", ws_trim(question)))
