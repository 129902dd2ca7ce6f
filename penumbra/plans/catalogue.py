"""The registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, sqlfuncs
from ..functions import patterns as P
from ..functions.spans import byte_offset, find_all, scan, scanned_values, snapped
from ..operators import external, image, layout
from ..operators.detect import counts, detect, entities_of
from ..operators.engine import Readers, redact_files
from ..operators.mask import audit_json as audit
from ..operators.mask import mask, mask_bytes, mask_places, merged, output
from ..sources import ingest
from ..sources.tables import table
from . import oracles as O
from . import filetexts, synthetic

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def made(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spark.sql(synthetic.rows(kind).replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


SPAN_COLUMNS = ["entity_type", "start", "end", "cstart", "cend"]


def spans_of(df: DataFrame, id_col: str, text_col: str, entities: list[str]) -> DataFrame:
    found = detect(df, [id_col], text_col, entities)
    return found.select(id_col, *SPAN_COLUMNS, F.round(F.col("score").cast("double"), 2).alias("score"))


def spans_oracle(source: str, id_col: str, text_col: str, entities) -> str:
    return f'SELECT {id_col}, entity_type, start, "end", cstart, cend, score FROM ({O.everything(source, id_col, text_col, entities)})'


SOURCES = {"": ("documents", "doc_id", "text"), "_html": ("pages", "page_id", "html")}
for short, entity in (("email", "EMAIL_ADDRESS"), ("card", "CREDIT_CARD"), ("phone", "PHONE_NUMBER")):
    for end, (source, key, col) in SOURCES.items():
        query(f"{short}_spans{end}", spans_oracle(source, key, col, [entity]))(lambda spark, d, source=source, key=key, col=col, entity=entity: spans_of(table(spark, d, source), key, col, [entity]))

for end, (source, key, col) in SOURCES.items():  # with a number behind each text, since there are none

    def _vat(spark, d, source=source, key=key, col=col):
        rows = spark.sql(synthetic.behind("vat_fr", "{rows}", key, col), rows=table(spark, d, source))
        return spans_of(rows, key, col, ["EU_VAT"])

    query(f"vat_spans{end}", spans_oracle(f"({synthetic.behind('vat_fr', source, key, col)})", key, col, ["EU_VAT"]))(_vat)


@query("iban_long_run", spans_oracle(f"({synthetic.LONG_RUN})", "doc_id", "text", ["IBAN_CODE"]))
def iban_long_run(spark, sf_dir):
    """A candidate of any length takes all that it covers."""
    rows = spark.sql(synthetic.LONG_RUN.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))
    return spans_of(rows, "doc_id", "text", ["IBAN_CODE"])


MADE = {"nir_validate": ("nir", "FR_NIR"), "ssn_validate": ("ssn", "US_SSN"), "iban_validate": ("iban", "IBAN_CODE"), "vat_fr": ("vat_fr", "EU_VAT"), "vat_be": ("vat_be", "EU_VAT"), "vat_nl": ("vat_nl", "EU_VAT"), "vat_lu": ("vat_lu", "EU_VAT"), "vat_format_only": ("vat_form", "EU_VAT"), "siret_validate": ("siret", "FR_SIRET"), "siren_validate": ("siren", "FR_SIREN")}
for name, (kind, entity) in MADE.items():
    query(name, spans_oracle(f"({synthetic.rows(kind)})", "doc_id", "text", [entity]))(lambda spark, d, kind=kind, entity=entity: spans_of(made(spark, d, kind), "doc_id", "text", [entity]))

KINDS = list(synthetic.TEXT)
ALL_MADE = "(" + " UNION ALL ".join(f"SELECT doc_id * {len(KINDS)} + {i} AS doc_id, text FROM ({synthetic.rows(k)})" for i, k in enumerate(KINDS)) + ")"


def all_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for i, k in enumerate(KINDS):
        part = made(spark, sf_dir, k).select((F.col("doc_id") * len(KINDS) + i).alias("doc_id"), "text")
        out = part if out is None else out.unionByName(part)
    return out


@query("detect_all", f'SELECT doc_id, rec_order, entity_type, start, "end", cstart, cend, score FROM ({O.everything("documents")}) UNION ALL SELECT -1 - doc_id, rec_order, entity_type, start, "end", cstart, cend, score FROM ({O.everything(ALL_MADE)})')
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recognizers over documents and over made identifiers, whose ids are below zero."""
    both = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(all_made(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return detect(both, ["doc_id"]).select("doc_id", "rec_order", *SPAN_COLUMNS, F.round(F.col("score").cast("double"), 2).alias("score"))


def masked_rows(df: DataFrame, key: str, col: str) -> DataFrame:
    found = df.select(key, F.col(col).alias("text"), entities_of(col).alias("e"))
    return found.select(key, mask_places(F.col("text"), F.col("e")).alias("redacted"), F.size("e").alias("n_entities"))


for name, (source, key, col) in {"mask_documents": SOURCES[""], "mask_pages": SOURCES["_html"]}.items():
    query(name, O.masked(source, key, col))(lambda spark, d, source=source, key=key, col=col: masked_rows(table(spark, d, source), key, col))


@query("mask_identifiers", O.masked(ALL_MADE))
def mask_identifiers(spark, sf_dir):
    return masked_rows(all_made(spark, sf_dir), "doc_id", "text")


@query("redact_documents", f"SELECT m.doc_id, m.redacted, m.n_entities, coalesce(t.types, '') AS types FROM ({O.masked('documents')}) m LEFT JOIN (SELECT doc_id, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM ({O.everything('documents')}) GROUP BY doc_id) t ON t.doc_id = m.doc_id")
def redact_documents(spark, sf_dir):
    """The flagship: every document masked, with what was found in it."""
    found = table(spark, sf_dir, "documents").select("doc_id", "text", entities_of("text").alias("e"))
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("e", lambda e: e["entity_type"]))), ",")
    return found.select("doc_id", mask_places(F.col("text"), F.col("e")).alias("redacted"), F.size("e").alias("n_entities"), types.alias("types"))


@query("redact_conversations", "SELECT conv_id, turn, text AS redacted, CAST(0 AS INTEGER) AS n_entities FROM conversations")
def redact_conversations(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", entities_of("text").alias("e"))
    return found.select("conv_id", "turn", mask_places(F.col("text"), F.col("e")).alias("redacted"), F.size("e").alias("n_entities"))


# ---- filters, counts, audits

TWO = ["EMAIL_ADDRESS", "CREDIT_CARD"]


@query("entity_filter", spans_oracle("documents", "doc_id", "text", TWO))
def entity_filter(spark, sf_dir):
    """An allow-list; unknown names do nothing."""
    return spans_of(table(spark, sf_dir, "documents"), "doc_id", "text", [*TWO, "NO_SUCH_TYPE"])


def over(threshold: float):
    return lambda spark, d: detect(table(spark, d, "documents"), ["doc_id"], score_threshold=threshold).select("doc_id", *SPAN_COLUMNS)


for name, threshold in {"score_threshold_095": 0.95, "score_threshold_exact": 0.9}.items():
    query(name, f'SELECT doc_id, entity_type, start, "end", cstart, cend FROM ({O.everything("documents")}) WHERE score >= {threshold}')(over(threshold))


@query("entity_counts", f"SELECT entity_type, count(*) AS n FROM ({O.everything('documents')}) GROUP BY entity_type")
def entity_counts(spark, sf_dir):
    return counts(detect(table(spark, sf_dir, "documents"), ["doc_id"]))


@query("entity_counts_by_lang", f"SELECT d.lang, s.entity_type, count(*) AS n, count(DISTINCT s.doc_id) AS n_docs FROM ({O.everything('documents')}) s JOIN documents d ON d.doc_id = s.doc_id GROUP BY ALL")
def entity_counts_by_lang(spark, sf_dir):
    return detect(table(spark, sf_dir, "documents"), ["doc_id", "lang"]).groupBy("lang", "entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("docs_with_pii", f"SELECT d.source, count(*) AS n_docs, count(s.doc_id) AS n_with FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({O.everything('documents')})) s ON s.doc_id = d.doc_id GROUP BY d.source")
def docs_with_pii(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("source", F.size(entities_of("text")).alias("n"))
    return found.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") > 0).alias("n_with"))


@query("labels_vs_pii", f"SELECT l.quality, l.toxic, count(*) AS n_docs, count(s.doc_id) AS n_with FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM ({O.everything('documents')})) s ON s.doc_id = l.doc_id GROUP BY ALL")
def labels_vs_pii(spark, sf_dir):
    with_any = table(spark, sf_dir, "documents").filter(F.size(entities_of("text")) > 0).select("doc_id", F.lit(1).alias("seen"))
    return table(spark, sf_dir, "labels").join(with_any, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.count("seen").alias("n_with"))


CANDIDATES = f"SELECT doc_id, v, {O.DIGITS} AS d FROM ({O.found('CREDIT_CARD', 'documents', valid='true')})"


def candidates(spark, sf_dir) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(find_all(F.col("text"), P.PATTERN["CREDIT_CARD"])).alias("s"))
    return found.select("doc_id", checks.digits(F.col("s.value")).alias("d"))


@query("card_issuer_breakdown", f"SELECT coalesce({O.issuer('d')}, 'none') AS issuer, CAST(length(d) AS INTEGER) AS n_digits, count(*) AS n, count(*) FILTER (WHERE {O.luhn('d')}) AS n_luhn FROM ({CANDIDATES}) GROUP BY ALL")
def card_issuer_breakdown(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(F.coalesce(checks.issuer(F.col("d")), F.lit("none")).alias("issuer"), F.length("d").alias("n_digits"), checks.luhn(F.col("d")).alias("ok"))
    return rows.groupBy("issuer", "n_digits").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_luhn"))


@query("card_luhn_vs_valid", f"SELECT count(*) AS n, count(*) FILTER (WHERE {O.luhn('d')}) AS n_luhn, count(*) FILTER (WHERE {O.luhn('d')} AND {O.issuer('d')} IS NOT NULL AND length(d) BETWEEN 13 AND 19) AS n_valid FROM ({CANDIDATES})")
def card_luhn_vs_valid(spark, sf_dir):
    return candidates(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(checks.luhn(F.col("d"))).alias("n_luhn"), F.count_if(checks.card(F.col("d"))).alias("n_valid"))


PLACE = "start % 200"


@query("audit_json", f"""SELECT doc_id, '{{"entity_type":"' || entity_type || '","span":{{"start":' || start || ',"end":' || "end" || '}},"score":' || CAST(score AS VARCHAR) ||
CASE WHEN start % 2 = 0 THEN ',"bbox":{{"page":1,"x":' || {PLACE} || '.0,"y":' || {PLACE} || '.5,"width":10.0,"height":5.0}}' ELSE '' END || ',"source":"TierA"}}' AS value FROM ({O.everything('documents')})""")
def audit_json(spark, sf_dir):
    """Every entity with its score, half of them with a place."""
    at = F.col("start") % 200
    box = F.struct(F.lit(1).alias("page"), at.cast("float").alias("x"), (at + 0.5).cast("float").alias("y"), F.lit(10.0).cast("float").alias("width"), F.lit(5.0).cast("float").alias("height"))
    found = detect(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("bbox", F.when(F.col("start") % 2 == 0, box))
    return audit(found, "doc_id")


# ---- SQL functions

SQL_CHECKS = {"FR_NIR": ("pii_nir(v)", O.nir()), "US_SSN": ("pii_ssn(v)", O.ssn()), "IBAN_CODE": ("pii_iban(v)", O.iban()), "CREDIT_CARD": ("pii_card(v)", O.card()), "PHONE_NUMBER": ("pii_phone(v)", O.phone()), "EU_VAT": ("pii_vat_score(v) IS NOT NULL", f"{O.vat()} IS NOT NULL"), "FR_SIREN": ("pii_siren(v)", O.luhn(O.DIGITS))}


@query("sql_checks", " UNION ALL ".join(f"SELECT doc_id, entity_type, v, coalesce({sql}, false) AS ok FROM ({O.found(entity, ALL_MADE, valid='true')})" for entity, (_, sql) in SQL_CHECKS.items()))
def sql_checks(spark, sf_dir):
    """Every candidate of made identifiers, right or wrong, through the functions that SQL users have."""
    sqlfuncs.register(spark)
    made_ = all_made(spark, sf_dir)
    found = None
    for entity in SQL_CHECKS:
        one = made_.select("doc_id", F.lit(entity).alias("entity_type"), F.explode(scanned_values(F.col("text"), entity, P.PATTERN[entity])).alias("v"))
        found = one if found is None else found.unionByName(one)
    arms = " ".join(f"WHEN '{entity}' THEN {call}" for entity, (call, _) in SQL_CHECKS.items())
    return spark.sql(f"SELECT doc_id, entity_type, v, coalesce(CASE entity_type {arms} END, false) AS ok FROM {{found}}", found=found)


@query("sql_detect", f'SELECT doc_id, rec_order, entity_type, start, "end", cstart, cend, score FROM ({O.everything(ALL_MADE)})')
def sql_detect(spark, sf_dir):
    sqlfuncs.register(spark)
    return spark.sql("SELECT t.doc_id, e.rec_order, e.entity_type, e.start, e.end, e.cstart, e.cend, round(CAST(e.score AS DOUBLE), 2) AS score FROM {made} t, LATERAL pii_detect(t.text) e", made=all_made(spark, sf_dir))


@query("sql_mask", O.masked("documents"))
def sql_mask(spark, sf_dir):
    sqlfuncs.register(spark)
    return spark.sql("SELECT doc_id, pii_mask(text) AS redacted, size(pii_entities(text)) AS n_entities FROM {documents}", documents=table(spark, sf_dir, "documents"))


# ---- spans given from outside

SPANS = """SELECT doc_id, k, CAST((doc_id * 13 + k * 17) % (n_chars + 5) AS INTEGER) AS cstart, CAST((doc_id * 13 + k * 17) % (n_chars + 5) + (doc_id + 5 * k) % 23 AS INTEGER) AS cend
FROM (SELECT doc_id, n_chars, 0 AS k FROM {documents} UNION ALL SELECT doc_id, n_chars, 1 AS k FROM {documents} UNION ALL SELECT doc_id, n_chars, 2 AS k FROM {documents})"""
SPANS_ORACLE = "(" + SPANS.replace("{documents}", "documents") + ")"


def given_spans(spark, sf_dir) -> DataFrame:
    return spark.sql(SPANS, documents=table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars")))


@query("span_union", f"""WITH m AS (SELECT doc_id, cstart, cend, max(cend) OVER (PARTITION BY doc_id ORDER BY cstart, cend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {SPANS_ORACLE} WHERE cstart < cend),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR cstart > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cstart, cend ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT doc_id, min(cstart) AS cstart, max(cend) AS cend FROM g GROUP BY doc_id, g""")
def span_union(spark, sf_dir):
    return merged(given_spans(spark, sf_dir), ["doc_id"], "cstart", "cend")


def grouped_spans(spark, sf_dir) -> DataFrame:
    spans = given_spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("cstart", "cend")).alias("spans"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(spans, "doc_id", "left")



@query("mask_overlap", f"""WITH s AS (SELECT s.doc_id, greatest(cstart, 0) AS a, least(cend, length(d.text)) AS b FROM {SPANS_ORACLE} s JOIN documents d ON d.doc_id = s.doc_id),
m AS (SELECT doc_id, a, b, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE a < b),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, g),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
j AS (SELECT o.doc_id, string_agg(substr(d.text, CAST(before + 1 AS BIGINT), CAST(a - before AS BIGINT)) || repeat('█', CAST(b - a AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last FROM o JOIN documents d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(head || substr(d.text, CAST(last + 1 AS BIGINT)), d.text) AS redacted FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id""")
def mask_overlap(spark, sf_dir):
    return grouped_spans(spark, sf_dir).select("doc_id", mask(F.col("text"), F.col("spans")).alias("redacted"))


@query("char_to_byte", f"SELECT s.doc_id, s.k, CAST(strlen(substr(d.text, 1, s.cstart)) AS INTEGER) AS start, CAST(strlen(substr(d.text, 1, s.cend)) AS INTEGER) AS \"end\" FROM {SPANS_ORACLE} s JOIN documents d ON d.doc_id = s.doc_id")
def char_to_byte(spark, sf_dir):
    spans = given_spans(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return spans.select("doc_id", "k", byte_offset(F.col("text"), F.col("cstart")).alias("start"), byte_offset(F.col("text"), F.col("cend")).alias("end"))


@query("byte_mask_is_char_mask", "SELECT doc_id, true AS same FROM documents")
def byte_mask_is_char_mask(spark, sf_dir):
    """Masking by bytes, after turning characters into bytes, equals masking by characters."""
    rows = grouped_spans(spark, sf_dir)
    in_bytes = F.transform("spans", lambda s: F.struct(byte_offset(F.col("text"), s["cstart"]).alias("start"), byte_offset(F.col("text"), s["cend"]).alias("end")))
    return rows.select("doc_id", (mask_bytes(F.col("text"), in_bytes) == mask(F.col("text"), F.col("spans"))).alias("same"))


def external_spans(spark, sf_dir) -> DataFrame:
    score = F.when(F.col("k") == 0, 0.5).otherwise(0.9).cast("float")
    return given_spans(spark, sf_dir).select("doc_id", F.lit("PERSON").alias("entity_type"), "cstart", "cend", score.alias("score"))


RAW = "substr(hex(encode(d.text)), CAST(2 * ({n}) + 1 AS BIGINT), 1) IN ('8', '9', 'A', 'B')"


@query("snapped_bytes", f"""SELECT doc_id, k, CAST(CASE WHEN n = 0 OR n = size OR NOT in0 THEN n WHEN NOT in1 THEN n - 1 WHEN NOT in2 THEN n - 2 ELSE n - 3 END AS INTEGER) AS n FROM
(SELECT d.doc_id, s.k, least(s.cend, strlen(d.text)) AS n, strlen(d.text) AS size, {RAW.format(n='least(s.cend, strlen(d.text))')} AS in0, {RAW.format(n='least(s.cend, strlen(d.text)) - 1')} AS in1, {RAW.format(n='least(s.cend, strlen(d.text)) - 2')} AS in2
 FROM {SPANS_ORACLE} s JOIN documents d ON d.doc_id = s.doc_id)""")
def snapped_bytes(spark, sf_dir):
    """Byte places anywhere, also within characters and beyond the end, go back to a character's start."""
    rows = given_spans(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw")), "doc_id")
    return rows.select("doc_id", "k", snapped(F.col("raw"), F.col("cend")).alias("n"))


@query("output_choice", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE lang END AS native, CASE WHEN doc_id % 3 = 1 THEN text ELSE lang END AS markdown FROM documents")
def output_choice(spark, sf_dir):
    """What is asked for where it's there, else the other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    shown = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 1, F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("lang"))).alias("text"), F.when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("markdown"))
    both = shown.select("doc_id", output(shown, "native").alias("native"), output(shown, "markdown").alias("shown"))
    swapped = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("text")).alias("markdown"), F.col("lang").alias("text"))
    return both.select("doc_id", "native").join(swapped.select("doc_id", output(swapped, "markdown").alias("markdown")), "doc_id")


FOUND_HERE = f"({O.everything('documents')})"


@query("external_merge", f"""WITH a AS {FOUND_HERE}, e AS (SELECT s.doc_id, 'PERSON' AS entity_type, CAST(strlen(substr(d.text, 1, s.cstart)) AS INTEGER) AS start, CAST(strlen(substr(d.text, 1, s.cend)) AS INTEGER) AS "end", CASE WHEN s.k = 0 THEN 0.5 ELSE 0.9 END AS score
FROM {SPANS_ORACLE} s JOIN documents d ON d.doc_id = s.doc_id)
SELECT doc_id, entity_type, start, "end", 'TierA' AS source FROM a
UNION ALL SELECT doc_id, entity_type, start, "end", 'TierB' FROM e WHERE score >= 0.6 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = e.doc_id AND a.start < e."end" AND e.start < a."end")""")
def external_merge(spark, sf_dir):
    """External spans after those found here, without those that overlap one or score too low."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = external.with_external(docs, external_spans(spark, sf_dir), score_threshold=0.6)
    # the threshold is for external spans: none found here scores less; a plain explode would have a filter on its
    # input pushed below, and with it all scans worked out again
    return both.select("doc_id", F.explode_outer("entities").alias("e")).filter("e is not null").select("doc_id", "e.entity_type", "e.start", "e.end", "e.source")


@query("external_merge_spans", ORACLES["external_merge"])
def external_merge_spans(spark, sf_dir):
    """The same from two tables of spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = external.merge_external(detect(docs, ["doc_id"]), external.in_bytes(external_spans(spark, sf_dir), docs), score_threshold=0.6)
    return both.select("doc_id", "entity_type", "start", "end", "source")


# ---- layout

WORDS_SQL = "SELECT conv_id, turn, CAST(i AS INTEGER) AS idx, word FROM (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))"


def words(spark, sf_dir) -> DataFrame:
    """Tokens of turns on made pages: ten to a line, forty to a page."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word")).withColumn("idx", F.col("i") + 1)
    at = F.col("i")
    return rows.select("conv_id", "turn", "idx", "word", (F.floor(at / 40) + 1).cast("int").alias("page"), (at % 10 * 50).cast("float").alias("x"), (F.floor(at % 40 / 10) * 20).cast("float").alias("y"), (F.length("word") * 4).cast("float").alias("width"), F.lit(12.0).cast("float").alias("height"))


@query("text_assembly", "SELECT conv_id, turn, regexp_replace(text, '^ +', '') AS text FROM conversations")
def text_assembly(spark, sf_dir):
    texts, _ = layout.assemble(words(spark, sf_dir), ["conv_id", "turn"], ["idx"])
    return texts


SPANS_OF_WORDS = f"""SELECT conv_id, turn, idx, word, CAST(coalesce(sum(strlen(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM ({WORDS_SQL})"""


@query("word_spans", f'SELECT conv_id, turn, idx, start, CAST(start + strlen(word) AS INTEGER) AS "end" FROM ({SPANS_OF_WORDS})')
def word_spans(spark, sf_dir):
    _, spans = layout.assemble(words(spark, sf_dir), ["conv_id", "turn"], ["idx"])
    return spans.select("conv_id", "turn", "idx", "start", "end")


BOXES_ORACLE = f"""WITH w AS (SELECT conv_id, turn, idx, start AS ws, start + strlen(word) AS we, (idx - 1) // 40 + 1 AS page, (idx - 1) % 10 * 50.0 AS x, (idx - 1) % 40 // 10 * 20.0 AS y, length(word) * 4.0 AS width FROM ({SPANS_OF_WORDS})),
e AS (SELECT conv_id, turn, k, 30 * k + 5 AS s, 30 * k + 65 AS t FROM conversations, (SELECT unnest([0, 3, 9]) AS k)),
h AS (SELECT e.conv_id, e.turn, e.k, w.* EXCLUDE (conv_id, turn), first_value(page) OVER (PARTITION BY e.conv_id, e.turn, e.k ORDER BY idx) AS p FROM e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn AND e.s < w.we AND w.ws < e.t),
b AS (SELECT conv_id, turn, k, CAST(min(page) AS INTEGER) AS page, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + 12) - min(y) AS height FROM h WHERE page = p GROUP BY conv_id, turn, k)"""


def boxed(spark, sf_dir) -> DataFrame:
    _, spans = layout.assemble(words(spark, sf_dir), ["conv_id", "turn"], ["idx"])
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(F.lit(0), F.lit(3), F.lit(9))).alias("k"))
    entities = turns.select("conv_id", "turn", "k", F.when(F.col("k") == 9, "LATE").otherwise("EARLY").alias("entity_type"), (F.col("k") * 30 + 5).alias("start"), (F.col("k") * 30 + 65).alias("end"))
    return layout.union_boxes(entities, spans, ["conv_id", "turn"], ["k"])


@query("union_boxes", BOXES_ORACLE + " SELECT e.conv_id, e.turn, CAST(e.k AS INTEGER) AS k, page, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM e LEFT JOIN b ON b.conv_id = e.conv_id AND b.turn = e.turn AND b.k = e.k")
def union_boxes(spark, sf_dir):
    return boxed(spark, sf_dir).select("conv_id", "turn", "k", "bbox.page", *(F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")))


@query("unplaceable_types", BOXES_ORACLE + " SELECT e.conv_id, e.turn, string_agg(DISTINCT CASE WHEN e.k = 9 THEN 'LATE' ELSE 'EARLY' END, ',' ORDER BY CASE WHEN e.k = 9 THEN 'LATE' ELSE 'EARLY' END) AS types FROM e LEFT JOIN b ON b.conv_id = e.conv_id AND b.turn = e.turn AND b.k = e.k WHERE b.k IS NULL GROUP BY e.conv_id, e.turn")
def unplaceable_types(spark, sf_dir):
    return layout.unplaceable(boxed(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("types", ",").alias("types"))


@query("tile_grid", """WITH s AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(200 + p_partkey % 977 AS INTEGER) AS w, CAST(100 + p_partkey % 613 AS INTEGER) AS h FROM part),
t AS (SELECT k, w, h, i // 2 AS r, i % 2 AS c, w // 2 AS tw, h // 2 AS th, CAST(trunc(CAST(w // 2 AS FLOAT) * CAST(0.15 AS FLOAT)) AS INTEGER) AS px, CAST(trunc(CAST(h // 2 AS FLOAT) * CAST(0.15 AS FLOAT)) AS INTEGER) AS py FROM s, (SELECT unnest(range(4)) AS i)),
e AS (SELECT k, r, c, greatest(c * tw - px, 0) AS x, least((c + 1) * tw + px, w) AS x2, greatest(r * th - py, 0) AS y, least((r + 1) * th + py, h) AS y2 FROM t)
SELECT k, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(x2 - x AS INTEGER) AS width, CAST(y2 - y AS INTEGER) AS height FROM e""")
def tile_grid(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), (F.col("p_partkey") % 977 + 200).cast("int").alias("w"), (F.col("p_partkey") % 613 + 100).cast("int").alias("h"))
    return sizes.select("k", F.explode(layout.tiles(F.col("w"), F.col("h"))).alias("t")).select("k", "t.*")


@query("pixel_rects", """WITH b AS (SELECT CAST(p_partkey AS BIGINT) AS k, (p_partkey % 97) * 6.0 - 30 AS x, (p_partkey % 89) * 9.0 - 24 AS y, (p_partkey % 31) * 12.0 AS w, (p_partkey % 7) * 6.0 AS h FROM part)
SELECT k, CAST(trunc(greatest(x * 150 / 72, 0)) AS INTEGER) AS x0, CAST(trunc(greatest(y * 150 / 72, 0)) AS INTEGER) AS y0, CAST(least(trunc(greatest((x + w) * 150 / 72, 0)), 1240) AS INTEGER) AS x1, CAST(least(trunc(greatest((y + h) * 150 / 72, 0)), 1754) AS INTEGER) AS y1 FROM b""")
def pixel_rects(spark, sf_dir):
    k = F.col("p_partkey")
    box = F.struct(((k % 97) * 6.0 - 30).cast("float").alias("x"), ((k % 89) * 9.0 - 24).cast("float").alias("y"), ((k % 31) * 12.0).cast("float").alias("width"), ((k % 7) * 6.0).cast("float").alias("height"))
    return table(spark, sf_dir, "part").select(k.cast("bigint").alias("k"), layout.pixels(box, F.lit(1240), F.lit(1754), 150).alias("r")).select("k", "r.*")


@query("box_dedup", """WITH b AS (SELECT CAST(c_custkey AS BIGINT) AS k, i, 100 * (c_custkey % 3 + i % 2) AS x, CASE WHEN (c_custkey + i) % 5 = 0 THEN 'A' ELSE 'B' END AS t, (c_custkey + i) % 7 = 0 AS gone FROM customer, (SELECT unnest(range(4)) AS i))
SELECT k, CAST(count(DISTINCT CASE WHEN i = 0 THEN '0' ELSE x || t END) FILTER (WHERE i = 0 OR (NOT gone AND NOT EXISTS (SELECT 1 FROM b o WHERE o.k = b.k AND o.i = 0 AND NOT o.gone AND o.x = b.x AND o.t = b.t))) AS INTEGER) AS n FROM b GROUP BY k""")
def box_dedup(spark, sf_dir):
    """One found entity and three of a second pass, on clusters that are far apart."""
    k = F.col("c_custkey")

    def entity(i: int):
        box = F.struct(F.lit(1).alias("page"), (F.lit(100.0) * (k % 3 + i % 2)).cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(10.0).cast("float").alias("width"), F.lit(10.0).cast("float").alias("height"))
        return F.struct(F.when((k + i) % 5 == 0, "A").otherwise("B").alias("entity_type"), F.when((k + i) % 7 != 0, box).alias("bbox"))

    both = layout.merge_by_box(F.array(entity(0)), F.array(*(entity(i) for i in (1, 2, 3))))
    return table(spark, sf_dir, "customer").select(k.cast("bigint").alias("k"), F.size(both).alias("n"))


# ---- sources

NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.PNG' WHEN 2 THEN 'c.png' WHEN 3 THEN 'd.docx' WHEN 4 THEN 'e.csv' WHEN 5 THEN 'f' WHEN 6 THEN 'dir.v2/g.xlsx' ELSE 'h.txt' END"


@query("kind_sniff", f"""SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 3 = 0 OR n LIKE '%.pdf' THEN 'pdf' WHEN n LIKE '%.png' THEN 'image' WHEN n LIKE '%.docx' OR n LIKE '%.csv' OR n LIKE '%.xlsx' THEN 'document' ELSE 'text' END AS kind,
CASE WHEN n LIKE '%.docx' THEN 'docx' WHEN n LIKE '%.csv' THEN 'csv' WHEN n LIKE '%.xlsx' THEN 'excel' END AS format FROM (SELECT p_partkey, {NAMES} AS n FROM part)""")
def kind_sniff(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAMES).alias("n"), F.when(F.col("p_partkey") % 3 == 0, "%PDF-1.7").otherwise("plain").cast("binary").alias("content"))
    return named.select(F.col("p_partkey").cast("bigint").alias("k"), ingest.kind_of(F.col("n"), F.col("content")).alias("kind"), ingest.format_of(F.col("n")).alias("format"))


@query("box_shift", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey % 7 + p_partkey % 40 * 12 AS DOUBLE) AS x, CAST(p_partkey % 11 + p_partkey % 31 * 24 AS DOUBLE) AS y FROM part")
def box_shift(spark, sf_dir):
    """Boxes read in a tile, in units of the whole image: 25 pixels are 12 units."""
    k = F.col("p_partkey")
    box = F.struct(F.lit(1).alias("page"), (k % 7).cast("float").alias("x"), (k % 11).cast("float").alias("y"), F.lit(1.0).cast("float").alias("width"), F.lit(1.0).cast("float").alias("height"))
    rows = table(spark, sf_dir, "part").select(k.cast("bigint").alias("k"), layout.shifted(box, k % 40 * 25, k % 31 * 50).alias("b"))
    return rows.select("k", F.col("b.x").cast("double").alias("x"), F.col("b.y").cast("double").alias("y"))


@query("csv_to_markdown", "SELECT CAST(n_nationkey AS BIGINT) AS k, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) AS text FROM nation")
def csv_to_markdown(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.concat(F.lit("key,name\n"), F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('"\n')).cast("binary").alias("content"), F.lit("document").alias("kind"), F.lit("csv").alias("format"))
    return ingest.extracted(files).select("k", "text")


@query("lossy_text", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'caf' || chr(65533) || ' ' || n_name || ' ' || chr(65533) AS text FROM nation")
def lossy_text(spark, sf_dir):
    """Bytes that are no UTF-8 are shown as such."""
    raw = F.concat(F.unhex(F.lit("636166E920")), F.col("n_name").cast("binary"), F.unhex(F.lit("20C3")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), ingest.decoded(raw).alias("text"))


def office_file(format: str, key: int, name: str) -> bytes:
    """A small document of a format that says: Nation, then key and name."""
    import io
    import zipfile

    parts = {
        "docx": {"word/document.xml": f'<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>Nation</w:t></w:r></w:p><w:p><w:r><w:t>{key} </w:t></w:r><w:r><w:t>{name}</w:t></w:r></w:p></w:body></w:document>'},
        "pptx": {"ppt/slides/slide1.xml": '<p:sld xmlns:p="u" xmlns:a="v"><a:p><a:r><a:t>Nation</a:t></a:r></a:p></p:sld>', "ppt/slides/slide2.xml": f'<p:sld xmlns:p="u" xmlns:a="v"><a:p><a:r><a:t>{key} {name}</a:t></a:r></a:p></p:sld>'},
        "odt": {"content.xml": f'<o:d xmlns:o="u" xmlns:text="t"><text:h>Nation</text:h><text:p>{key} <text:span>{name}</text:span></text:p></o:d>'},
        "odp": {"content.xml": f'<o:d xmlns:o="u" xmlns:text="t"><text:p>Nation</text:p><text:p>{key} {name}</text:p></o:d>'},
        "ods": {"content.xml": f'<o:d xmlns:o="u" xmlns:table="b" xmlns:text="t"><table:table><table:table-row><table:table-cell><text:p>Nation</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell><text:p>{key}</text:p></table:table-cell><table:table-cell><text:p>{name}</text:p></table:table-cell></table:table-row></table:table></o:d>'},
        "epub": {"a.xhtml": f"<html><body><h1>Nation</h1><p>{key} {name}</p></body></html>"},
        "excel": {"xl/sharedStrings.xml": f'<sst xmlns="u"><si><t>Nation</t></si><si><t>{name}</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="u"><sheetData><row><c t="s"><v>0</v></c></row><row><c><v>{key}</v></c><c t="s"><v>1</v></c></row></sheetData></worksheet>'},
    }
    if format == "rtf":
        return f"{{\\rtf1\\ansi Nation\\par {key} {name}}}".encode()
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for at, text in parts[format].items():
            z.writestr(at, text)
    return made.getvalue()


NL = "chr(10)"
PLAIN_OFFICE = f"'Nation' || {NL} || {NL} || n_nationkey || ' ' || n_name"
TABLE_OFFICE = f"'| Nation |  |' || {NL} || '| --- | --- |' || {NL} || '| ' || n_nationkey || ' | ' || n_name || ' |' || {NL}"
OFFICE = {"docx": PLAIN_OFFICE, "pptx": PLAIN_OFFICE, "odp": PLAIN_OFFICE, "odt": f"'# ' || {PLAIN_OFFICE}", "epub": f"'# ' || {PLAIN_OFFICE}", "ods": TABLE_OFFICE, "excel": TABLE_OFFICE, "rtf": f"'Nation' || {NL} || n_nationkey || ' ' || n_name"}


@query("office_text", " UNION ALL ".join(f"SELECT CAST(n_nationkey AS BIGINT) AS k, '{f}' AS format, {text} AS text FROM nation" for f, text in OFFICE.items()))
def office_text(spark, sf_dir):
    """The text of documents of every format that is read here."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name", F.explode(F.array(*map(F.lit, OFFICE))).alias("format"))

    def make(frames):
        for f in frames:
            yield f.assign(content=[office_file(*r) for r in zip(f["format"], f["k"], f["n_name"], strict=True)], kind="document")[["k", "content", "kind", "format"]]

    return ingest.extracted(rows.mapInPandas(make, "k long, content binary, kind string, format string")).select("k", "format", "text")


def _scan_of(picture):
    return [{"word": "scan", "x": 1, "y": 1, "width": 20, "height": 8}, {"word": "a@b.io", "x": 25, "y": 1, "width": 20, "height": 8}]


def _two_pages(content):
    return [{"word": "one", "page": 1, "x": 1, "y": 1, "width": 9, "height": 5}, {"word": content.decode()[5:], "page": 2, "x": 2, "y": 3, "width": 40, "height": 5}], 2


KIND_OF = "CASE n_nationkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'document' WHEN 2 THEN 'image' WHEN 3 THEN 'pdf' ELSE 'none' END"


def kinds(spark, sf_dir, output_: str) -> DataFrame:
    """A table of texts, spreadsheets, pictures, PDFs and files that nobody can read, redacted."""
    import numpy as np

    blank = image.png_encode(np.full((40, 120, 3), 255, np.uint8))
    content = "CASE kind WHEN 'text' THEN CAST('mail ' || n_name || '@b.io' AS BINARY) WHEN 'document' THEN CAST('name,' || n_name || '@b.io' AS BINARY) WHEN 'pdf' THEN CAST('%PDF ' || n_name || '@b.io' AS BINARY) END"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.regexp_replace("n_name", " ", "").alias("n_name"), F.expr(KIND_OF).alias("kind")).withColumn("content", F.coalesce(F.expr(content), F.when(F.col("kind") == "image", F.lit(blank)), F.lit(b"?")))
    files = rows.select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("kind") == "none", "image").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "document", "csv").alias("format"), "content")
    readers = Readers(ocr=_scan_of, pages=_two_pages, render=lambda c, dpi: [np.full((dpi, dpi, 3), 255, np.uint8)] * 2)
    return redact_files(files, output_, readers=readers)


ADDRESS = "replace(n_name, ' ', '') || '@b.io'"
HIDDEN = f"repeat('{P.BLOCK}', length({ADDRESS}))"


@query("redact_kinds_markdown", f"""SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey % 5 WHEN 0 THEN 'mail ' || {HIDDEN} WHEN 1 THEN '| name | ' || {HIDDEN} || ' |' || chr(10) || '| --- | --- |' || chr(10) WHEN 2 THEN 'scan ██████' WHEN 3 THEN 'one ' || {HIDDEN} END AS markdown,
CAST(CASE n_nationkey % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INTEGER) AS page_count, CASE WHEN n_nationkey % 5 < 4 THEN 'EMAIL_ADDRESS' END AS types, n_nationkey % 5 = 4 AS failed FROM nation""")
def redact_kinds_markdown(spark, sf_dir):
    rows = kinds(spark, sf_dir, "markdown")
    return rows.select("k", F.col("redacted_markdown").alias("markdown"), "page_count", F.array_join(F.transform("entities", lambda e: e["entity_type"]), ",").alias("types"), F.col("error").isNotNull().alias("failed"))


@query("redact_kinds_native", f"""SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey % 5 WHEN 0 THEN 'mail ' || {HIDDEN} END AS text, CASE n_nationkey % 5 WHEN 2 THEN '89504E47' WHEN 3 THEN '25504446' END AS magic,
CAST(CASE n_nationkey % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INTEGER) AS page, CAST(CASE n_nationkey % 5 WHEN 2 THEN 25 WHEN 3 THEN 2 END AS DOUBLE) AS x, CASE n_nationkey % 5 WHEN 1 THEN 'Unsupported' WHEN 4 THEN 'RedactError' END AS error FROM nation""")
def redact_kinds_native(spark, sf_dir):
    rows = kinds(spark, sf_dir, "native")
    box = F.element_at("entities", 1)["bbox"]
    return rows.select("k", F.col("redacted_text").alias("text"), F.hex(F.substring("redacted_bytes", 1, 4)).alias("magic"), box["page"].alias("page"), box["x"].cast("double").alias("x"), F.substring_index("error", ":", 1).alias("error"))


# ---- documents written into files and read back

def as_files(spark, sf_dir, kind: str, write) -> DataFrame:
    """Every document in a file of its own: (doc_id, content, format, kind).

    The kind is a literal above the Python step, so the plan drops the engine's branches for other kinds, each of which would
    write all files anew.
    """

    def run(frames):
        for f in frames:
            made = [write(int(i), filetexts.one_line(t)) for i, t in zip(f["doc_id"], f["text"], strict=True)]
            yield f[["doc_id"]].assign(content=[m[0] for m in made], format=[m[1] for m in made])

    return table(spark, sf_dir, "documents", costly=True).select("doc_id", "text").mapInPandas(run, "doc_id long, content binary, format string").withColumn("kind", F.lit(kind))


def masked_files(files: DataFrame, **options) -> DataFrame:
    done = redact_files(files, "markdown", **options)
    return done.select("doc_id", F.col("redacted_markdown").alias("redacted"), F.size("entities").alias("n_entities"))


@query("office_redacted", O.masked(filetexts.OFFICE_TEXTS))
def office_redacted(spark, sf_dir):
    """Documents with addresses behind tabs, breaks and cells, in eight formats."""

    def write(i: int, text: str):
        form = filetexts.FORMATS[i % 8]
        return filetexts.office_file(form, text, i), form

    return masked_files(as_files(spark, sf_dir, "document", write))


@query("pdf_redacted", O.masked(filetexts.PDF_TEXTS))
def pdf_redacted(spark, sf_dir):
    """Documents as PDFs, read word by word from their text layer."""
    files = as_files(spark, sf_dir, "pdf", lambda i, text: (synthetic.text_pdf(text, i % 2 == 1), None))
    return masked_files(files, strategy="layout")


@query("pdf_word_boxes", """SELECT CAST(p_partkey AS BIGINT) AS k, 'P' || p_partkey AS word, 1 AS page, CAST(1000 * (40 + p_partkey % 400) AS BIGINT) AS x, CAST(1000 * (800 - 100 - p_partkey % 600) - 800 * (8 + p_partkey % 5) AS BIGINT) AS y,
CAST((667 + 556 * length(CAST(p_partkey AS VARCHAR))) * (8 + p_partkey % 5) AS BIGINT) AS width, CAST(1000 * (8 + p_partkey % 5) AS BIGINT) AS height FROM part""")
def pdf_word_boxes(spark, sf_dir):
    """A word at a known place on a page of its own, in thousandths of a unit."""
    from ..sources import pdf

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for k in f["p_partkey"].tolist():
                show = f"BT /F {8 + k % 5} Tf {40 + k % 400} {100 + k % 600} Td (P{k}) Tj ET".encode()
                objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(show), show)]
                words, _, _ = pdf.words(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>")
                out += [(k, w["word"], w["page"], *(round(1000 * w[c]) for c in ("x", "y", "width", "height"))) for w in words]
            yield pd.DataFrame(out, columns=["k", "word", "page", "x", "y", "width", "height"])

    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey")).mapInPandas(run, "k long, word string, page int, x long, y long, width long, height long")
