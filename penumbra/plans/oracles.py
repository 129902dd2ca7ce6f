"""Oracle SQL: the same detections written for a relational engine whose patterns are ASCII's.

There the text is matched in a shadow where every letter or mark outside ASCII is an underscore: a word character that
keeps places and is in no digit or upper-case class.
"""

from __future__ import annotations

from ..functions import patterns as P

LETTERS = "[\\x{00aa}\\x{00b5}\\x{00ba}\\x{00c0}-\\x{00d6}\\x{00d8}-\\x{00f6}\\x{00f8}-\\x{02ff}\\x{0300}-\\x{1fff}\\x{2c00}-\\x{2dff}\\x{3040}-\\x{d7ff}]"
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    n = f"CAST(substr(reverse({d}), i, 1) AS INT)"
    return f"(coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {n} ELSE 2 * {n} - CASE WHEN {n} > 4 THEN 9 ELSE 0 END END)), 0) % 10 = 0)"


def digit_sum(d: str) -> str:
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CAST(substr({d}, i, 1) AS INT)))"


def number(x: str) -> str:
    return f"TRY_CAST({x} AS BIGINT)"


def nir() -> str:
    s = "upper(regexp_replace(v, '[ .-]', '', 'g'))"
    base = f"replace(replace(substr({s}, 1, 13), '2A', '19'), '2B', '18')"
    return f"(length({s}) = 15 AND regexp_matches({base}, '^[0-9]{{13}}$') AND 97 - {number(base)} % 97 = {number(f'substr({s}, 14, 2)')})"


def ssn() -> str:
    return f"(length({DIGITS}) = 9 AND substr({DIGITS}, 1, 3) NOT IN ('000', '666') AND substr({DIGITS}, 1, 1) <> '9' AND substr({DIGITS}, 4, 2) <> '00' AND substr({DIGITS}, 6, 4) <> '0000')"


def iban() -> str:
    s = "upper(regexp_replace(v, '\\s', '', 'g'))"
    turned = f"(substr({s}, 5) || substr({s}, 1, 4))"
    code = f"ascii(substr({turned}, i, 1))"
    told = f"list_aggregate(list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN {code} >= 65 THEN CAST({code} - 55 AS VARCHAR) ELSE substr({turned}, i, 1) END), 'string_agg', '')"
    rest = "list_reduce(list_transform(string_split(n, ''), lambda c: CAST(c AS BIGINT)), lambda a, c: (a * 10 + c) % 97)"
    return f"(length({s}) BETWEEN 15 AND 34 AND regexp_matches({s}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]*$') AND {rest.replace('(n,', f'({told},')} = 1)"


def issuer(d: str) -> str:
    arms = " ".join(f"WHEN {number(f'substr({d}, 1, {n})')} BETWEEN {low} AND {high} THEN CASE WHEN length({d}) IN ({', '.join(map(str, lengths))}) THEN '{name}' END" for name, n, low, high, lengths in P.ISSUERS)
    return f"(CASE {arms} END)"


def card() -> str:
    return f"(length({DIGITS}) BETWEEN 13 AND 19 AND {issuer(DIGITS)} IS NOT NULL AND {luhn(DIGITS)})"


def phone() -> str:
    return f"(length({DIGITS}) BETWEEN 7 AND 15 AND length(v) > length({DIGITS}))"


def vat() -> str:
    """The score."""
    c, b = "upper(substr(v, 1, 2))", "upper(regexp_replace(substr(v, 3), '^[ \\x{00a0}]', ''))"
    weighted = " + ".join(f"{9 - i} * {number(f'substr({b}, {i + 1}, 1)')}" for i in range(8))
    arms = [
        f"WHEN {c} = 'FR' THEN CASE WHEN regexp_matches({b}, '^[0-9]{{11}}$') THEN CASE WHEN (12 + 3 * ({number(f'substr({b}, 3, 9)')} % 97)) % 97 = {number(f'substr({b}, 1, 2)')} THEN 1.0 END WHEN regexp_matches({b}, '^[A-Z0-9]{{2}}[0-9]{{9}}$') THEN 0.8 END",
        f"WHEN {c} = 'BE' THEN CASE WHEN regexp_matches({b}, '^[0-9]{{10}}$') AND 97 - {number(f'substr({b}, 1, 8)')} % 97 = {number(f'substr({b}, 9, 2)')} THEN 1.0 END",
        f"WHEN {c} = 'NL' THEN CASE WHEN regexp_matches({b}, '^[0-9]{{9}}B[0-9]{{2}}$') AND ({weighted}) % 11 = {number(f'substr({b}, 9, 1)')} THEN 1.0 END",
        f"WHEN {c} = 'LU' THEN CASE WHEN regexp_matches({b}, '^[0-9]{{8}}$') AND {number(f'substr({b}, 1, 6)')} % 89 = {number(f'substr({b}, 7, 2)')} THEN 1.0 END",
        *(f"WHEN {c} = '{k}' THEN CASE WHEN regexp_matches({b}, '^{shape}$') THEN 0.8 END" for k, shape in P.VAT_FORMS.items()),
    ]
    return f"(CASE {' '.join(arms)} END)"


LABEL = f"regexp_matches(substr(text, greatest(cstart - {P.LABEL_REACH - 1}, 1), least(cstart, {P.LABEL_REACH})), '(?i)(?:{P.LABELS})')"
SIRET = f"(CASE WHEN substr({DIGITS}, 1, 9) = '{P.LA_POSTE}' THEN {digit_sum(DIGITS)} % 5 = 0 ELSE {luhn(DIGITS)} END AND (regexp_matches(v, '^\\d{{3}}[ .]\\d{{3}}[ .]\\d{{3}}[ .]\\d{{5}}$') OR {LABEL}))"
SIREN = f"({luhn(DIGITS)} AND {LABEL})"
VALID = {"FR_NIR": nir(), "EMAIL_ADDRESS": "true", "US_SSN": ssn(), "IBAN_CODE": iban(), "CREDIT_CARD": card(), "PHONE_NUMBER": phone(), "EU_VAT": f"{vat()} IS NOT NULL", "FR_SIRET": SIRET, "FR_SIREN": SIREN}


def found(entity: str, source: str, id_col: str = "doc_id", text_col: str = "text", valid: str | None = None) -> str:
    """SELECT of (id, entity_type, rec_order, start, end, cstart, cend, score, v) over a table or subquery."""
    pattern = P.PATTERN[entity].replace("\\u00a0", "\\x{00a0}").replace("'", "''")
    shadow = text_col if entity == "EMAIL_ADDRESS" else f"regexp_replace({text_col}, '{LETTERS}', '_', 'g')"
    score = vat() if entity == "EU_VAT" else str(P.SCORE[entity])
    return f"""SELECT {id_col}, '{entity}' AS entity_type, {P.ORDER.index(entity)} AS rec_order, CAST(strlen(substr(text, 1, cstart)) AS INTEGER) AS start,
  CAST(strlen(substr(text, 1, cstart)) + strlen(v) AS INTEGER) AS "end", CAST(cstart AS INTEGER) AS cstart, CAST(cstart + length(v) AS INTEGER) AS cend, CAST({score} AS DOUBLE) AS score, v
FROM (SELECT {id_col}, text, a[i] AS v, CAST(coalesce(list_sum(list_transform(a[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS cstart
      FROM (SELECT {id_col}, text, a, unnest(range(2, len(a) + 1, 2)) AS i
            FROM (SELECT {id_col}, {text_col} AS text, string_split(regexp_replace({shadow}, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS a FROM {source})))
WHERE {valid or VALID[entity]}"""


def everything(source: str, id_col: str = "doc_id", text_col: str = "text", entities=P.ORDER) -> str:
    return "\nUNION ALL\n".join(f"({found(e, source, id_col, text_col)})" for e in entities)


def masked(source: str, id_col: str = "doc_id", text_col: str = "text", entities=P.ORDER) -> str:
    """SELECT of (id, redacted, n_entities): blocks over the union of spans, as islands and gaps."""
    return f"""WITH s AS ({everything(source, id_col, text_col, entities)}),
m AS (SELECT {id_col}, cstart, cend, max(cend) OVER (PARTITION BY {id_col} ORDER BY cstart, cend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR cstart > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {id_col} ORDER BY cstart, cend ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT {id_col}, min(cstart) AS a, max(cend) AS b FROM g GROUP BY {id_col}, g),
o AS (SELECT {id_col}, a, b, coalesce(lag(b) OVER (PARTITION BY {id_col} ORDER BY a), 0) AS before FROM u),
j AS (SELECT o.{id_col}, string_agg(substr(t.{text_col}, CAST(before + 1 AS BIGINT), CAST(a - before AS BIGINT)) || repeat('{P.BLOCK}', CAST(b - a AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last
      FROM o JOIN {source} t ON t.{id_col} = o.{id_col} GROUP BY o.{id_col}),
n AS (SELECT {id_col}, count(*) AS n FROM s GROUP BY {id_col})
SELECT t.{id_col}, CASE WHEN j.head IS NULL THEN t.{text_col} ELSE j.head || substr(t.{text_col}, CAST(j.last + 1 AS BIGINT)) END AS redacted, CAST(coalesce(n.n, 0) AS INTEGER) AS n_entities
FROM {source} t LEFT JOIN j ON j.{id_col} = t.{id_col} LEFT JOIN n ON n.{id_col} = t.{id_col}"""
