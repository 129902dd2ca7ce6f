"""SQL functions: the same expressions as the DataFrame operators, written out as SQL for the session's SQL users."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import checks

#: Operators that an expression names like functions; SQL wants them quoted there.
_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\b(?:and|or|not)(?=\()|(?:<=>|<=|>=|<>|!=|[=<>+\-*/%!])(?=\()")

#: Checks and measures of one value v: name, result and expression.
CHECKS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "pii_digits": ("STRING", checks.digits),
    "pii_luhn": ("BOOLEAN", checks.luhn_only),
    "pii_mod97": ("INT", lambda v: checks.mod97(checks.digits(v))),
    "pii_nir": ("BOOLEAN", checks.nir),
    "pii_ssn": ("BOOLEAN", checks.ssn),
    "pii_iban": ("BOOLEAN", checks.iban),
    "pii_card": ("BOOLEAN", checks.card),
    "pii_issuer": ("STRING", lambda v: checks.issuer(checks.digits(v))),
    "pii_phone": ("BOOLEAN", checks.phone),
    "pii_vat_score": ("DOUBLE", checks.vat_score),
    "pii_siret": ("BOOLEAN", checks.siret),
    "pii_siret_grouped": ("BOOLEAN", checks.grouped),
    "pii_siren": ("BOOLEAN", checks.siren),
}


def sql_of(expression: Column) -> str:
    """An expression as SQL text."""
    quoted = lambda m: m[0] if m[0].startswith("'") else f"`{m[0]}`"
    return _TOKEN.sub(quoted, expression._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for this session and returns their names.

    Beside CHECKS: pii_entities(t), an array of what is found in a text; pii_mask(t), the text masked; pii_detect(t), a
    table of what is found, for LATERAL; pii_emails(t), a table of addresses.
    """
    from ..operators.detect import entities_of
    from ..operators.mask import mask_places
    from ..operators.recognizers import NONE

    for name, (kind, of) in CHECKS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {sql_of(of(F.col('v')))}")
    found = sql_of(entities_of(F.col("t")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_entities(t STRING) RETURNS {NONE} RETURN {found}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_blocked(t STRING, e {NONE}) RETURNS STRING RETURN {sql_of(mask_places(F.col('t'), F.col('e')))}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pii_mask(t STRING) RETURNS STRING RETURN pii_blocked(t, pii_entities(t))")
    fields = ["entity_type", "rec_order", "start", "end", "cstart", "cend", "score", "source", "value"]
    kinds = "entity_type STRING, rec_order INT, start INT, `end` INT, cstart INT, cend INT, score FLOAT, source STRING, value STRING"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_detect(t STRING) RETURNS TABLE ({kinds}) RETURN SELECT {', '.join(f'e.`{f}`' for f in fields)} FROM (SELECT explode({found}) AS e)")
    emails = sql_of(entities_of(F.col("t"), ["EMAIL_ADDRESS"]))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_emails(t STRING) RETURNS TABLE (value STRING) RETURN SELECT e.value FROM (SELECT explode({emails}) AS e)")
    return [*CHECKS, "pii_entities", "pii_blocked", "pii_mask", "pii_detect", "pii_emails"]
