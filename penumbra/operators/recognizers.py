"""Recognizers: a pattern, a test of what it matches, a test of its surroundings and a score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import patterns as P
from ..functions.spans import scan

ENTITY = "struct<entity_type:string,rec_order:int,start:int,end:int,cstart:int,cend:int,score:float,source:string,value:string>"
NONE = "array<" + ENTITY + ">"


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    score: Callable[[Column], Column] | None = None
    around: Callable[[Column, Column, Column], Column] | None = None  # (text, cstart, value)
    gate: Callable[[Column], Column] | None = None
    order: int = 100

    def entities(self, text: Column, threshold: float | None = None) -> Column:
        """Array of ENTITY in text order; scores are floats and the threshold is one too."""
        score = self.score or (lambda v: F.lit(P.SCORE[self.entity_type]))

        def entity(s: Column) -> Column:
            return F.struct(
                F.lit(self.entity_type).alias("entity_type"), F.lit(self.order).alias("rec_order"), s["start"].alias("start"), s["end"].alias("end"),
                s["cstart"].alias("cstart"), s["cend"].alias("cend"), score(s["value"]).cast("float").alias("score"), F.lit("TierA").alias("source"), s["value"].alias("value"),
            )

        found = scan(text, self.entity_type, self.pattern, self.valid)
        if self.around:
            found = F.filter(found, lambda s: self.around(text, s["cstart"], s["value"]))
        made = F.transform(found, entity)
        if threshold is not None:
            made = F.filter(made, lambda e: e["score"] >= F.lit(threshold).cast("float"))
        gate = self.gate(text) if self.gate else text.isNotNull()
        return F.when(gate, made.cast(NONE)).otherwise(F.array().cast(NONE))


def _gate(entity_type: str):
    held, pattern = P.GATE[entity_type]
    return (lambda t: F.contains(t, F.lit(held))) if held else (lambda t: t.rlike(f"(?U){pattern}"))


def _make(entity_type: str, **more) -> Recognizer:
    return Recognizer(entity_type, P.PATTERN[entity_type], gate=_gate(entity_type), order=P.ORDER.index(entity_type), **more)


DEFAULT = (
    _make("FR_NIR", valid=checks.nir),
    _make("EMAIL_ADDRESS"),
    _make("US_SSN", valid=checks.ssn),
    _make("IBAN_CODE", valid=checks.iban),
    _make("CREDIT_CARD", valid=checks.card),
    _make("PHONE_NUMBER", valid=checks.phone),
    _make("EU_VAT", valid=lambda v: checks.vat_score(v).isNotNull(), score=checks.vat_score),
    _make("FR_SIRET", valid=checks.siret, around=lambda t, at, v: checks.grouped(v) | checks.labelled(t, at)),
    _make("FR_SIREN", valid=checks.siren, around=lambda t, at, v: checks.labelled(t, at)),
)


def chosen(entities: list[str] | None = None, more: tuple[Recognizer, ...] = ()) -> list[Recognizer]:
    """Recognizers to run: all for None, none for an empty list; unknown names are ignored. Others are not planned."""
    return [r for r in (*DEFAULT, *more) if entities is None or r.entity_type in entities]
