"""The given tables seen as papers, records, measurements and model answers.

Each view exists twice: as a DataFrame built from ``Tables`` and, under the same name, as DuckDB SQL.

documents            papers with their text          customer   papers of the record versions
orders               versions of records             lineitem   measured values of a record
part                 model answers, materials        supplier   authors
events               job events and corrections      conversations, pages   pages of documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.filters import likely

SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}

START = "2024-01-01 00:00:00"


def files(t) -> DataFrame:
    """Documents as scanned files: the text is the content."""
    from foliomill.sources.files import fingerprint

    size = F.octet_length("text").cast("bigint")
    return fingerprint(t.documents.select(F.col("doc_id").alias("path"), size.alias("length"), "text"), "text")


SQL["files"] = """
SELECT doc_id AS path, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS file_size FROM documents"""


def registry(t) -> DataFrame:
    """Labelled documents as the papers already known."""
    labelled = t.files.join(t.labels.select(F.col("doc_id").alias("path"), "quality"), "path")
    return labelled.select(
        "file_hash",
        F.col("path").cast("string").alias("paper_id"),
        F.when(F.col("quality") == 1, F.lit("extracted")).otherwise(F.lit("failed")).alias("status"),
    )


SQL["registry"] = """
SELECT sha256(text) AS file_hash, CAST(doc_id AS VARCHAR) AS paper_id,
 CASE WHEN quality = 1 THEN 'extracted' ELSE 'failed' END AS status
FROM documents JOIN labels USING (doc_id)"""


def papers(t) -> DataFrame:
    """Documents as papers."""
    return t.documents.selectExpr(
        "doc_id AS paper_id",
        "concat(source, '/', lang, '_', CAST(doc_id AS STRING), '.pdf') AS original_filename",
        r"CASE WHEN lang <> 'es' THEN split_part(text, '\n', 1) END AS title",
        "CASE WHEN lang <> 'de' THEN concat('10.', CAST(1000 + length(source) AS STRING), '/j.', source, '.', "
        "CAST(doc_id AS STRING)) END AS doi",
        "CAST(NULL AS STRING) AS abstract",
        "CASE WHEN lang <> 'fr' THEN CAST(1985 + n_chars % 50 AS INT) END AS publication_year",
        "CASE WHEN n_chars > 400 THEN source END AS journal_name",
        "CASE n_chars % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'parsing' WHEN 2 THEN 'parsed' WHEN 3 THEN 'extracting' "
        "WHEN 4 THEN 'extracted' WHEN 5 THEN 'review_needed' ELSE 'failed' END AS status",
        "n_chars AS file_size_bytes",
        "text AS raw_text",
        f"timestampadd(MINUTE, CAST(doc_id AS INT), TIMESTAMP_NTZ '{START}') AS created_at",
        f"timestampadd(MINUTE, CAST(n_chars AS INT), TIMESTAMP_NTZ '{START}') AS updated_at",
    )


SQL["papers"] = f"""
SELECT doc_id AS paper_id, concat(source, '/', lang, '_', CAST(doc_id AS VARCHAR), '.pdf') AS original_filename,
 CASE WHEN lang <> 'es' THEN split_part(text, chr(10), 1) END AS title,
 CASE WHEN lang <> 'de' THEN concat('10.', CAST(1000 + length(source) AS VARCHAR), '/j.', source, '.', CAST(doc_id AS VARCHAR)) END AS doi,
 CAST(NULL AS VARCHAR) AS abstract,
 CASE WHEN lang <> 'fr' THEN CAST(1985 + n_chars % 50 AS INTEGER) END AS publication_year,
 CASE WHEN n_chars > 400 THEN source END AS journal_name,
 CASE n_chars % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'parsing' WHEN 2 THEN 'parsed' WHEN 3 THEN 'extracting'
  WHEN 4 THEN 'extracted' WHEN 5 THEN 'review_needed' ELSE 'failed' END AS status,
 n_chars AS file_size_bytes, text AS raw_text,
 TIMESTAMP '{START}' + to_minutes(doc_id) AS created_at, TIMESTAMP '{START}' + to_minutes(n_chars) AS updated_at
FROM documents"""


def front(t) -> DataFrame:
    """Each paper's text behind a front page with title, DOI, year, abstract heading and keywords."""
    return t.papers.selectExpr(
        "paper_id",
        r"concat(coalesce(title, 'short'), '\nDOI: ', coalesce(doi, 'none'), '. Received ', "
        r"coalesce(CAST(publication_year AS STRING), 'n/a'), '\n\nAbstract\n', replace(raw_text, '\n', ' '), "
        r"'\n\nKeywords: ', coalesce(journal_name, '')) AS text",
    )


NEEDS["front"] = ("papers",)
SQL["front"] = """
SELECT paper_id, concat(coalesce(title, 'short'), chr(10), 'DOI: ', coalesce(doi, 'none'), '. Received ',
 coalesce(CAST(publication_year AS VARCHAR), 'n/a'), chr(10), chr(10), 'Abstract', chr(10), replace(raw_text, chr(10), ' '),
 chr(10), chr(10), 'Keywords: ', coalesce(journal_name, '')) AS text FROM papers"""


def turns(t) -> DataFrame:
    """Conversation turns as pages; what users wrote counts as native text, and all of every third conversation."""
    native = (F.col("conv_id") % 3 == 0) | ((F.col("conv_id") % 3 == 1) & (F.col("role") == "user"))
    return t.conversations.select(
        F.col("conv_id").alias("paper_id"),
        F.col("turn").alias("page_number"),
        "text",
        F.when(native, F.lit("native")).otherwise(F.lit("ocr")).alias("method"),
    )


SQL["turns"] = """
SELECT conv_id AS paper_id, turn AS page_number, text,
 CASE WHEN conv_id % 3 = 0 OR (conv_id % 3 = 1 AND role = 'user') THEN 'native' ELSE 'ocr' END AS method
FROM conversations"""


def readings(t) -> DataFrame:
    """Documents as a reader left them: some blank, some with an error, some with both."""
    return t.documents.select(
        F.col("doc_id").alias("paper_id"),
        F.when(F.col("doc_id") % 7 == 3, F.lit(" \n\t")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 11 == 5, F.concat(F.lit("Parse error: page "), F.col("doc_id"))).alias("error"),
    )


SQL["readings"] = """
SELECT doc_id AS paper_id, CASE WHEN doc_id % 7 = 3 THEN ' ' || chr(10) || chr(9) ELSE text END AS text,
 CASE WHEN doc_id % 11 = 5 THEN 'Parse error: page ' || doc_id END AS error FROM documents"""


def web_pages(t) -> DataFrame:
    """Web pages with two candidate texts: the page's title, the page itself, or nothing, beside all text between the tags
    or nothing."""
    kind, title = F.col("page_id") % 5, F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return t.pages.select(
        F.col("page_id").alias("paper_id"),
        F.when(kind == 1, F.col("html")).when(kind == 2, F.lit("")).otherwise(title).alias("native_text"),
        F.when(kind != 3, F.regexp_replace("html", r"<[^>]*>", " ")).otherwise(F.lit("")).alias("ocr_text"),
    )


SQL["web_pages"] = r"""
SELECT page_id AS paper_id, CASE page_id % 5 WHEN 1 THEN html WHEN 2 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS native_text,
 CASE page_id % 5 WHEN 3 THEN '' ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS ocr_text FROM pages"""


def responses(t) -> DataFrame:
    """Model answers made of parts, ten chunks to a paper: empty, prose, wrapped, invalid and good ones."""
    body = (
        """concat('{"summary":"', p_name, '","materials":[{"name":"', upper(p_brand), '","composition":"', p_type, """
        """'","evidence":{"source_text":"', p_name, '","confidence":0.5}},{"name":"', p_brand, '"}],"""
        """"process_conditions":[{"parameter_name":"size","value_numeric":', CAST(p_size AS STRING), ',"variable_role":"', """
        """CASE WHEN p_size BETWEEN 13 AND 16 THEN 'banana' ELSE 'input' END, '","evidence":{"section":"', p_type, '"}}],"""
        """"measurement_methods":[{"technique_name":"', p_type, '"}],"result_properties":[{"property_name":"price","""
        """"value_numeric":', CAST(p_retailprice AS STRING), ',"unit":"$","evidence":{"section":"results"}}],"""
        """"fields_needing_review":[', CASE WHEN p_size > 25 THEN concat('"', p_type, '"') ELSE '' END, ']}')"""
    )
    # Answers are written by many tasks; the one file they are made of here is spread likewise.
    parts = t.part.repartition(t.spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.selectExpr(
        "p_partkey AS record_id",
        "CAST(floor(p_partkey / 10) AS BIGINT) AS paper_id",
        "CAST(p_partkey - 10 * CAST(floor(p_partkey / 10) AS BIGINT) AS INT) AS chunk_no",
        "CASE WHEN p_size <= 4 THEN '' WHEN p_size <= 8 THEN 'no structured answer' "
        """WHEN p_size <= 12 THEN concat('Here it is: {"summary":"', p_name, '","materials":null} thanks') """
        rf"ELSE concat('```json\n', {body}, '\n```') END AS raw",
    )


SQL["responses"] = """
SELECT p_partkey AS record_id, CAST(floor(p_partkey / 10) AS BIGINT) AS paper_id,
 CAST(p_partkey - 10 * CAST(floor(p_partkey / 10) AS BIGINT) AS INTEGER) AS chunk_no, p_name, p_brand, p_type, p_size, p_retailprice,
 CASE WHEN p_size <= 4 THEN '' WHEN p_size <= 8 THEN 'no structured answer'
 WHEN p_size <= 12 THEN concat('Here it is: {"summary":"', p_name, '","materials":null} thanks')
 ELSE concat('```json', chr(10), '{"summary":"', p_name, '","materials":[{"name":"', upper(p_brand), '","composition":"', p_type,
  '","evidence":{"source_text":"', p_name, '","confidence":0.5}},{"name":"', p_brand, '"}],"process_conditions":[{"parameter_name":"size","value_numeric":',
  CAST(p_size AS VARCHAR), ',"variable_role":"', CASE WHEN p_size BETWEEN 13 AND 16 THEN 'banana' ELSE 'input' END,
  '","evidence":{"section":"', p_type, '"}}],"measurement_methods":[{"technique_name":"', p_type,
  '"}],"result_properties":[{"property_name":"price","value_numeric":', CAST(p_retailprice AS VARCHAR),
  ',"unit":"$","evidence":{"section":"results"}}],"fields_needing_review":[',
  CASE WHEN p_size > 25 THEN concat('"', p_type, '"') ELSE '' END, ']}', chr(10), '```') END AS raw
FROM part"""

# What the decoder and the contract make of each answer, read off the JSON text.
NEEDS["decoded"] = ("responses",)
SQL["decoded"] = r"""
SELECT record_id, paper_id, chunk_no, raw, stripped,
 CASE WHEN json_valid(stripped) THEN stripped WHEN json_valid(span) THEN span END AS body,
 CASE WHEN stripped = '' THEN 'empty response' WHEN NOT json_valid(stripped) AND span = '' THEN 'no JSON found'
  WHEN NOT json_valid(stripped) AND NOT json_valid(span) THEN 'invalid JSON' END AS reject_reason
FROM (SELECT *, regexp_extract(stripped, '\{(?s:.*)\}', 0) AS span FROM
 (SELECT *, trim(regexp_replace(regexp_replace(trim(raw), '(?m)^```(?:json)?\s*', '', 'g'), '(?m)```\s*$', '', 'g'), ' ' || chr(10)) AS stripped
  FROM responses))"""

NEEDS["checked"] = ("decoded",)
SQL["checked"] = r"""
SELECT record_id, paper_id, chunk_no, reject_reason, body,
 CASE WHEN reject_reason IS NOT NULL THEN NULL
  WHEN json_extract_string(body, '$.process_conditions[0].variable_role') NOT IN ('input', 'output', 'contextual') THEN 'process_conditions[].variable_role'
  WHEN json_type(body, '$.materials') = 'NULL' THEN 'materials' ELSE '' END AS violations
FROM decoded"""

NEEDS["settled"] = ("checked",)
SQL["settled"] = r"""
SELECT record_id, paper_id, chunk_no, body, violations, outcome,
 CASE outcome WHEN 'rejected' THEN NULL WHEN 'minimal' THEN 'Extraction failed – manual review required.'
  ELSE trim(json_extract_string(body, '$.summary')) END AS summary,
 CASE WHEN outcome = 'valid' THEN body END AS good,
 CASE outcome WHEN 'rejected' THEN NULL WHEN 'valid' THEN coalesce(CAST(json_extract_string(body, '$.fields_needing_review[*]') AS VARCHAR[]), [])
  ELSE ['full_record'] END AS reviews,
 CASE WHEN outcome IN ('recovered', 'minimal') THEN ['Validation error (partial extraction): ' || violations] ELSE [] END AS warnings
FROM (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN violations = '' THEN 'valid'
  WHEN violations = 'materials' THEN 'recovered' ELSE 'minimal' END AS outcome FROM checked)"""


def versions(t) -> DataFrame:
    """Orders as record versions of customers."""
    return t.orders.selectExpr(
        "o_orderkey AS record_id",
        "o_custkey AS paper_id",
        "o_orderdate AS created_at",
        "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'needs_review' ELSE 'failed' END AS status",
        "o_orderpriority AS summary_text",
        "CAST(NULL AS STRING) AS input_variables",
        "CAST(NULL AS STRING) AS output_variables",
        "CAST(NULL AS STRING) AS contextual_notes",
        "CAST(o_totalprice AS STRING) AS raw_response",
    )


SQL["versions"] = """
SELECT o_orderkey AS record_id, o_custkey AS paper_id, o_orderdate AS created_at,
 CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'needs_review' ELSE 'failed' END AS status,
 o_orderpriority AS summary_text, CAST(o_totalprice AS VARCHAR) AS raw_response FROM orders"""

NEEDS["canon"] = ("versions",)
SQL["canon"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, record_id DESC) AS rn FROM versions)
WHERE rn = 1"""


def customers(t) -> DataFrame:
    """Customers as papers."""
    return t.customer.selectExpr(
        "c_custkey AS paper_id",
        "c_name AS title",
        "concat('10.1234/', CAST(c_custkey AS STRING)) AS doi",
        "1990 + c_nationkey AS publication_year",
        "CASE WHEN c_acctbal > 0 THEN sha2(concat('journal~', c_mktsegment), 256) END AS journal_id",
    )


SQL["customers"] = """
SELECT c_custkey AS paper_id, c_name AS title, concat('10.1234/', CAST(c_custkey AS VARCHAR)) AS doi,
 CAST(1990 + c_nationkey AS INTEGER) AS year, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS journal FROM customer"""


def segments(t) -> DataFrame:
    """Market segments as journals."""
    from foliomill.operators.biblio import upsert_journals

    none = t.spark.createDataFrame([], "journal_id string, name string")
    return upsert_journals(none, t.customer.select(F.col("c_mktsegment").alias("name")))


CONDITION_EXPR = {
    "parameter_name": "CASE l_linenumber WHEN 1 THEN 'Annealing Temperature' WHEN 2 THEN 'annealing temperature' "
    "WHEN 3 THEN 'Film Thickness' ELSE 'Pressure' END",
    "value_numeric": "CASE WHEN l_tax > 0.01 THEN l_quantity END",
    "value_text": "CASE WHEN l_tax <= 0.01 THEN l_returnflag END",
    "unit": "CASE WHEN l_linenumber <= 2 THEN 'C' WHEN l_linenumber = 3 THEN 'nm' ELSE 'Pa' END",
    "variable_role": "CASE l_returnflag WHEN 'A' THEN 'contextual' WHEN 'N' THEN 'input' ELSE 'output' END",
    "confidence": "l_discount * 10",
    "is_inferred": "l_linestatus = 'F'",
}
RESULT_EXPR = {
    "property_name": "CASE l_returnflag WHEN 'A' THEN 'TMR ratio' WHEN 'N' THEN 'Coercivity' ELSE 'bandgap' END",
    "value_numeric": "CASE WHEN l_discount > 0.01 THEN l_extendedprice END",
    "value_text": "CASE WHEN l_discount <= 0.01 THEN l_linestatus END",
    "value_min": "l_extendedprice * 0.5",
    "value_max": "l_extendedprice * 2",
    "unit": "'%'",
    "conditions": "CASE WHEN l_linestatus = 'F' THEN 'at 300 K' END",
    "variable_role": "CASE WHEN l_tax < 0.07 THEN 'output' ELSE 'contextual' END",
    "confidence": "l_tax * 10",
    "is_inferred": "l_linestatus = 'O'",
    "needs_review": "l_quantity > 40",
}
# Position of a value within its record; the order is total.
ORDINAL = "struct(l_linenumber, l_partkey, l_suppkey, l_shipdate) AS ordinal"


def _of_lineitem(expressions: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in expressions.items()]


def conditions(t) -> DataFrame:
    """Line items as process conditions of an order taken as a paper with one record."""
    keys = ["l_orderkey AS record_id", "l_orderkey AS paper_id", ORDINAL]
    return t.lineitem.selectExpr(*keys, *_of_lineitem(CONDITION_EXPR))


def results(t) -> DataFrame:
    """Line items as result properties of an order taken as a paper with one record."""
    keys = ["l_orderkey AS record_id", "l_orderkey AS paper_id", ORDINAL]
    return t.lineitem.selectExpr(*keys, *_of_lineitem(RESULT_EXPR))


for _name, _exprs in (("conditions", CONDITION_EXPR), ("results", RESULT_EXPR)):
    SQL[_name] = (
        "SELECT l_orderkey AS record_id, l_orderkey AS paper_id, "
        "row(l_linenumber, l_partkey, l_suppkey, l_shipdate) AS ordinal, l_linenumber, l_partkey, l_suppkey, l_shipdate, "
        + ", ".join(_of_lineitem(_exprs))
        + " FROM lineitem"
    )


def of_versions(children: DataFrame, versions: DataFrame) -> DataFrame:
    """Children of the given record versions, with the version's paper as their paper."""
    return likely(children.drop("paper_id"), versions, "record_id").join(versions.select("record_id", "paper_id"), "record_id")


def version_conditions(t) -> DataFrame:
    from foliomill.operators.records import canonical

    return of_versions(t.conditions, canonical(t.versions.select("record_id", "paper_id", "created_at")))


def version_results(t) -> DataFrame:
    from foliomill.operators.records import canonical

    return of_versions(t.results, canonical(t.versions.select("record_id", "paper_id", "created_at")))


for _name in ("conditions", "results"):
    NEEDS[f"version_{_name}"] = (_name, "canon")
    SQL[f"version_{_name}"] = (
        f"SELECT x.* EXCLUDE (paper_id), canon.paper_id FROM {_name} x JOIN canon USING (record_id)"
    )


def materials(t, versions: DataFrame | None = None) -> DataFrame:
    """Ordered parts as materials of an order, or of the given record versions and a few others."""
    parts = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    lines = t.lineitem.selectExpr("l_orderkey AS record_id", "l_orderkey AS paper_id", ORDINAL, "l_partkey AS p_partkey")
    lines = lines if versions is None else likely(lines, versions, "record_id")
    return lines.join(parts, "p_partkey").selectExpr(
        "record_id",
        "paper_id",
        "ordinal",
        "p_brand AS name",
        "p_name AS composition",
        "CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS substrate",
        "p_type AS crystal_structure",
    )


SQL["materials"] = """
SELECT l_orderkey AS record_id, l_orderkey AS paper_id, row(l_linenumber, l_partkey, l_suppkey, l_shipdate) AS ordinal, p_brand AS name,
 p_name AS composition, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS substrate, p_type AS crystal_structure
FROM lineitem JOIN part ON p_partkey = l_partkey"""


def authors(t) -> DataFrame:
    """Suppliers as authors."""
    return t.supplier.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("full_name"))


def links(t) -> DataFrame:
    """Suppliers of an order as the authors of a paper."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_suppkey").alias("author_id"),
        F.col("l_linenumber").alias("position"),
    )


def event_records(t) -> DataFrame:
    """Events as record versions of the paper named by the user id."""
    return t.events.selectExpr(
        "event_id AS record_id",
        "user_id AS paper_id",
        "ts AS created_at",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'needs_review' ELSE 'complete' END AS status",
        "props AS summary_text",
        "CAST(NULL AS STRING) AS review_notes",
        "false AS human_edited",
    )


SQL["event_records"] = """
SELECT event_id AS record_id, user_id AS paper_id, ts AS created_at,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'needs_review' ELSE 'complete' END AS status, props AS summary_text
FROM events"""


def job_events(t) -> DataFrame:
    """Events as jobs."""
    return t.events.selectExpr(
        "event_id AS job_id",
        "user_id AS paper_id",
        "ts AS created_at",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' "
        "WHEN 'purchase' THEN 'success' ELSE 'retrying' END AS status",
    )


SQL["job_events"] = """
SELECT event_id AS job_id, user_id AS paper_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued'
 WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'success' ELSE 'retrying' END AS status FROM events"""
