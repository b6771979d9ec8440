"""Files, pages, documents, chunks, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import rules
from foliomill.functions import text as tx
from foliomill.operators import chunking, dedup, inference, parsing
from foliomill.sources import files as fs
from foliomill.sources import registry as reg
from foliomill.sources.prompts import USER_TEMPLATE
from workload.base import query

# Whitespace as DuckDB's regular expressions spell it.
WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
STRIP = rf"^[{WS}]+|[{WS}]+$"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "folder_inventory",
    """SELECT source, count(*) AS n_files, count(*) FILTER (doc_id % 3 = 0) AS n_pdfs, coalesce(sum(strlen(text)), 0)::BIGINT AS total_bytes,
 count(*) FILTER (doc_id % 3 = 0 OR doc_id % 4 <> 1) = 0 AS is_empty_fallback FROM documents GROUP BY source""",
)
def folder_inventory(t):
    """Documents as files in a folder per source: PDFs, texts and place-holders."""
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id"), F.lit(".Pdf"))).when(F.col("doc_id") % 4 == 1, F.lit(".gitkeep")).otherwise(F.lit("notes.txt"))
    listed = t.documents.select("source", F.concat_ws("/", F.col("source"), F.col("doc_id"), name).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("length"))
    return fs.folder_inventory(listed, "source")


@query(
    "corpus_dedup",
    "SELECT min(path) AS path, file_hash, min(file_size) AS file_size FROM files GROUP BY file_hash",
    ("files",),
)
def corpus_dedup(t):
    return dedup.dedup_batch(t.files, order=F.col("path")).select("path", "file_hash", "file_size")


@query(
    "known_files",
    "SELECT path, file_hash FROM files WHERE file_hash NOT IN (SELECT file_hash FROM registry)",
    ("files", "registry"),
)
def known_files(t):
    return dedup.drop_known(t.files, t.registry).select("path", "file_hash")


@query(
    "duplicates_of",
    """SELECT path, file_hash, existing_id, status FROM files JOIN
(SELECT file_hash, min(paper_id) AS existing_id, arg_min(status, paper_id) AS status FROM registry GROUP BY file_hash) USING (file_hash)""",
    ("files", "registry"),
)
def duplicates_of(t):
    return dedup.duplicates_of(t.files, t.registry).select("path", "file_hash", "existing_id", "status")


OUTCOMES = """(SELECT path, file_hash, error, CASE WHEN error IS NOT NULL THEN 'failed' WHEN file_hash IN (SELECT file_hash FROM registry) THEN 'skipped'
 WHEN path = min(path) OVER (PARTITION BY file_hash) THEN 'ingested' ELSE 'skipped' END AS outcome FROM
 (SELECT path, CASE WHEN path % 13 <> 4 THEN file_hash END AS file_hash, CASE WHEN path % 13 = 4 THEN 'unreadable ' || path END AS error FROM files))"""


def scanned(t):
    """Files of which some could not be read."""
    bad = F.col("path") % 13 == 4
    broken = t.files.withColumn("error", F.when(bad, F.concat(F.lit("unreadable "), F.col("path"))))
    return broken.withColumn("file_hash", F.when(~bad, F.col("file_hash")))


@query("scan_outcomes", f"SELECT path, file_hash, error, outcome FROM {OUTCOMES}", ("files", "registry"))
def scan_outcomes(t):
    return dedup.scan_outcomes(scanned(t), t.registry, order=F.col("path")).select("path", "file_hash", "error", "outcome")


@query(
    "scan_summary",
    f"""SELECT count(*) AS found, count(*) FILTER (outcome = 'skipped') AS skipped_duplicates,
 count(*) FILTER (outcome = 'ingested') AS ingested, count(*) FILTER (outcome = 'failed') AS failed FROM {OUTCOMES}""",
    ("files", "registry"),
)
def scan_summary(t):
    return dedup.scan_counts(dedup.scan_outcomes(scanned(t), t.registry, order=F.col("path")))


@query(
    "register_papers",
    """SELECT file_hash, coalesce(known_id, sha256('paper~' || file_hash)) AS paper_id, CAST(path AS VARCHAR) AS original_filename,
 'uploaded' AS status, known_id IS NULL AS is_new FROM (SELECT min(path) AS path, file_hash FROM files GROUP BY file_hash)
 LEFT JOIN (SELECT file_hash, min(paper_id) AS known_id FROM registry GROUP BY file_hash) USING (file_hash)""",
    ("files", "registry"),
)
def register_papers(t):
    firsts = dedup.dedup_batch(t.files, order=F.col("path")).withColumn("path", F.col("path").cast("string"))
    rows = reg.register_papers(firsts, t.registry)
    return rows.select("file_hash", "paper_id", "original_filename", "status", "is_new")


@query(
    "word_count",
    rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS INTEGER) AS words FROM documents",
)
def word_count(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query(
    "choose_page_text",
    rf"""SELECT paper_id, method, CASE WHEN method = 'ocr' THEN ocr_text ELSE native_text END AS text,
 CAST(len(regexp_extract_all(CASE WHEN method = 'ocr' THEN ocr_text ELSE native_text END, '[^{WS}]+')) AS INTEGER) AS word_count
FROM (SELECT *, CASE WHEN length(regexp_replace(native_text, '{STRIP}', '', 'g')) < 200
 AND length(regexp_replace(ocr_text, '{STRIP}', '', 'g')) > length(regexp_replace(native_text, '{STRIP}', '', 'g'))
 THEN 'ocr' ELSE 'native' END AS method FROM web_pages)""",
    ("web_pages",),
)
def choose_page_text(t):
    return parsing.choose_page_text(t.web_pages).select("paper_id", "method", "text", "word_count")


@query(
    "assemble_document",
    """SELECT paper_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) AS text, count(*) AS page_count,
 CASE WHEN count(DISTINCT method) > 1 THEN 'hybrid' ELSE max(method) END AS parse_method FROM turns GROUP BY paper_id""",
    ("turns",),
)
def assemble_document(t):
    return parsing.assemble_document(t.turns).select("paper_id", "text", "page_count", "parse_method")


@query(
    "page_stats",
    """SELECT paper_id, 'parsed' AS status, sum(n)::BIGINT AS page_count, CASE WHEN min(low) <> max(high) THEN 'hybrid' ELSE max(high) END AS parse_method,
 CAST(sum(chars) + 2 * (sum(n) - 1) AS BIGINT) AS text_length FROM
 (SELECT paper_id, count(*) AS n, min(method) AS low, max(method) AS high, sum(length(text)) AS chars FROM turns GROUP BY ALL) GROUP BY paper_id""",
    ("turns",),
)
def page_stats(t):
    return parsing.page_stats(t.turns)


@query(
    "parse_stats",
    rf"""SELECT paper_id, CASE WHEN regexp_matches(text, '[^{WS}]') THEN 'parsed' ELSE 'failed' END AS status, page_count, parse_method,
 length(text)::BIGINT AS text_length FROM (SELECT paper_id, string_agg(CASE WHEN paper_id % 7 = 3 THEN ' ' ELSE text END, chr(10) || chr(10)) AS text,
  count(*) AS page_count, CASE WHEN count(DISTINCT method) > 1 THEN 'hybrid' ELSE max(method) END AS parse_method FROM turns GROUP BY paper_id)""",
    ("turns",),
)
def parse_stats(t):
    blanked = F.when(F.col("paper_id") % 7 == 3, F.lit(" ")).otherwise(F.col("text"))
    return parsing.parse_stats(parsing.parse_outcome(parsing.assemble_document(t.turns.withColumn("text", blanked))))


@query(
    "parse_outcome",
    rf"""SELECT paper_id, CASE WHEN parse_error IS NULL THEN 'parsed' ELSE 'failed' END AS status, parse_error FROM (SELECT paper_id,
 coalesce(error, CASE WHEN NOT regexp_matches(text, '[^{WS}]') THEN 'PDF parsing yielded empty text' END) AS parse_error FROM readings)""",
    ("readings",),
)
def parse_outcome(t):
    return parsing.parse_outcome(t.readings).select("paper_id", "status", "parse_error")


@query(
    "require_text",
    rf"""SELECT paper_id, length(text)::INTEGER AS chars,
 CASE WHEN NOT regexp_matches(text, '[^{WS}]') THEN 'PDF parsing yielded empty text' END AS parse_error FROM readings""",
    ("readings",),
)
def require_text(t):
    kept, blank = parsing.require_text(t.readings.select("paper_id", "text"))
    both = kept.withColumn("parse_error", F.lit(None).cast("string")).unionByName(blank)
    return both.select("paper_id", F.length("text").alias("chars"), "parse_error")


@query(
    "mine_title",
    f"""SELECT paper_id, list_filter(lines[1:10], lambda l: length(l) BETWEEN 21 AND 299)[1] AS title FROM
 (SELECT paper_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '{STRIP}', '', 'g')), lambda l: l <> '') AS lines FROM front)""",
    ("front",),
)
def mine_title(t):
    return t.front.select("paper_id", tx.mine_title(F.col("text")).alias("title"))


@query(
    "mine_doi",
    r"""SELECT paper_id, rtrim(nullif(regexp_extract(substr(text, 1, 5000), '(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9a-z]+)', 1), ''), '.,;)>') AS doi
FROM front""",
    ("front",),
)
def mine_doi(t):
    return t.front.select("paper_id", tx.mine_doi(F.col("text")).alias("doi"))


@query(
    "mine_year",
    r"""SELECT paper_id, list_filter(list_transform(regexp_extract_all(substr(text, 1, 3000), '\b(?:19|20)[0-9]{2}\b'), lambda y: CAST(y AS INTEGER)),
 lambda y: y BETWEEN 1990 AND 2030)[1] AS year FROM front""",
    ("front",),
)
def mine_year(t):
    return t.front.select("paper_id", tx.mine_year(F.col("text")).alias("year"))


@query(
    "mine_abstract",
    rf"""SELECT paper_id, CASE WHEN length(a) BETWEEN 100 AND 3000 THEN a END AS abstract FROM (SELECT paper_id, regexp_replace(
 regexp_extract(text, '(?is)abstract[:\s]*\n?(.*?)(?:\n\n|\n(?:Keywords|Introduction|1\.))', 1), '{STRIP}', '', 'g') AS a FROM front)""",
    ("front",),
)
def mine_abstract(t):
    return t.front.select("paper_id", tx.mine_abstract(F.col("text")).alias("abstract"))


AUTHORS = rf"""list_filter(list_transform(string_split(replace(text, ';', ','), ','), lambda a: regexp_replace(a, '{STRIP}', '', 'g')), lambda a: a <> '')"""


@query(
    "split_authors",
    f"SELECT conv_id, turn, len({AUTHORS})::INTEGER AS n_authors, array_to_string({AUTHORS}, '|') AS authors FROM conversations",
)
def split_authors(t):
    names = tx.split_authors(F.col("text"))
    return t.conversations.select(
        "conv_id", "turn", F.size(names).alias("n_authors"), F.array_join(names, "|").alias("authors")
    )


@query(
    "split_names",
    rf"""SELECT name, w[len(w)] AS last_name, CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') END AS first_name
FROM (SELECT DISTINCT p_name AS name, regexp_extract_all(p_name, '[^{WS}]+') AS w FROM part)""",
)
def split_names(t):
    name = F.col("name")
    return t.part.select(F.col("p_name").alias("name")).distinct().select(
        "name", tx.last_name(name).alias("last_name"), tx.first_name(name).alias("first_name")
    )


def chunk_twin(source: str, key: str, text: str, limit: int, separator: str) -> str:
    """Greedy chunking as a fold over a list in DuckDB."""
    return rf"""SELECT {key}, CAST(unnest(generate_series(0, len(chunks) - 1)) AS INTEGER) AS chunk_no, unnest(chunks) AS chunk FROM
(SELECT {key}, CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE list_append(f.done, f.cur) END AS chunks FROM
 (SELECT {key}, {text}, list_reduce(list_transform(regexp_split_to_array({text}, '{separator}'),
   lambda p: {{'done': CAST([] AS VARCHAR[]), 'cur': p, 'n': CAST(length(p) AS BIGINT)}}),
   lambda a, p: CASE WHEN a.n + p.n > {limit} THEN {{'done': list_append(a.done, a.cur), 'cur': p.cur, 'n': p.n}}
   ELSE {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || p.cur, 'n': a.n + p.n}} END) AS f FROM {source}))"""


@query("chunk_text", chunk_twin("documents", "doc_id", "text", 500, r"\n+"))
def chunk_text(t):
    docs = t.documents.select("doc_id", "text")
    return chunking.chunk_text(docs, max_chars=500, separator=r"\n+")


@query("chunk_paragraphs", chunk_twin("front", "paper_id", "text", 1000, r"\n{2,}"), ("front",))
def chunk_paragraphs(t):
    return chunking.chunk_text(t.front, max_chars=1000)


@query("build_prompt", f"SELECT doc_id, sha256(replace({quoted(USER_TEMPLATE)}, '{{paper_text}}', text)) AS prompt_hash FROM documents")
def build_prompt(t):
    prompts = inference.build_prompt(t.documents.select("doc_id", "text"), chunk="text")
    return prompts.select("doc_id", "prompt_hash")


EVENT_ERROR = "CASE event_type WHEN 'error' THEN concat('API_KEY ', props) WHEN 'click' THEN concat('timeout ', props) END"


@query(
    "classify_errors",
    f"""SELECT event_id, CASE WHEN e IS NULL THEN NULL WHEN regexp_matches(lower(e), 'authentication|api_key') THEN 'final' ELSE 'retryable' END AS error_class
FROM (SELECT event_id, {EVENT_ERROR} AS e FROM events)""",
)
def classify_errors(t):
    return t.events.select("event_id", inference.classify_error(F.expr(EVENT_ERROR)).alias("error_class"))


def _answers(t):
    """Events as an append-only log of answers to prompts named by user, event type and payload."""
    rows = t.events.select(
        F.col("user_id").alias("paper_id"),
        F.lit(0).alias("chunk_no"),
        F.col("props").alias("prompt_hash"),
        F.col("ts").alias("called_at"),
        F.col("event_type").alias("response"),
        F.expr(EVENT_ERROR).alias("error"),
    )
    return rows.withColumn("error_class", inference.classify_error(F.col("error")))


SQL_ANSWERS = f"(SELECT user_id AS paper_id, props AS prompt_hash, ts AS called_at, event_type AS response, {EVENT_ERROR} AS error FROM events)"


@query(
    "latest_responses",
    f"""SELECT paper_id, prompt_hash, response, error FROM (SELECT *, row_number() OVER
 (PARTITION BY paper_id, prompt_hash ORDER BY (error IS NULL) DESC, called_at DESC, response DESC) AS rn FROM {SQL_ANSWERS}) WHERE rn = 1""",
)
def latest_responses(t):
    return inference.latest_responses(_answers(t)).select("paper_id", "prompt_hash", "response", "error")


@query(
    "pending_prompts",
    f"""SELECT DISTINCT paper_id, prompt_hash FROM {SQL_ANSWERS} a WHERE NOT EXISTS (SELECT 1 FROM {SQL_ANSWERS} b
 WHERE a.paper_id = b.paper_id AND a.prompt_hash = b.prompt_hash AND (b.error IS NULL OR lower(b.error) LIKE '%api_key%'))""",
)
def pending_prompts(t):
    answers = _answers(t)
    return inference.pending(answers.select(*inference.KEY).distinct(), answers).select("paper_id", "prompt_hash")


OFFERED = """(SELECT * REPLACE (CASE paper_id % 4 WHEN 1 THEN publication_year - 200 WHEN 2 THEN publication_year + 60 ELSE publication_year END AS publication_year,
 CASE paper_id % 3 WHEN 1 THEN replace(original_filename, '.pdf', '.PDF') WHEN 2 THEN original_filename || '.txt' ELSE original_filename END AS original_filename,
 CASE WHEN paper_id % 5 = 4 THEN file_size_bytes + 104857600 ELSE file_size_bytes END AS file_size_bytes) FROM papers)"""


@query(
    "file_quality",
    rf"""SELECT paper_id, regexp_matches(coalesce(doi, ''), '^10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9a-z]+$') AS doi_ok,
 coalesce(nullif(trim(regexp_replace(original_filename, '[^\pL\pN_\-. ]', '', 'g')), ''), 'unnamed') AS safe_name,
 CASE WHEN publication_year BETWEEN 1900 AND 2030 THEN publication_year END AS checked_year,
 coalesce(publication_year BETWEEN 1900 AND 2100, true) AS biblio_year_ok,
 (lower(original_filename) LIKE '%.pdf' AND file_size_bytes <= 104857600) AS upload_ok FROM {OFFERED}""",
    ("papers",),
)
def file_quality(t):
    id_, year, name, size = (F.col(c) for c in ("paper_id", "publication_year", "original_filename", "file_size_bytes"))
    # Uploads as they come: years out of range, other extensions, files above the limit.
    offered = t.papers.withColumns(
        {
            "publication_year": F.when(id_ % 4 == 1, year - 200).when(id_ % 4 == 2, year + 60).otherwise(year),
            "original_filename": F.when(id_ % 3 == 1, F.replace(name, F.lit(".pdf"), F.lit(".PDF")))
            .when(id_ % 3 == 2, F.concat(name, F.lit(".txt")))
            .otherwise(name),
            "file_size_bytes": F.when(id_ % 5 == 4, size + 104857600).otherwise(size),
        }
    )
    return offered.select(
        "paper_id",
        rules.valid_doi(F.col("doi")).alias("doi_ok"),
        rules.safe_filename(F.col("original_filename")).alias("safe_name"),
        rules.checked_year(year).alias("checked_year"),
        rules.valid_biblio_year(year).alias("biblio_year_ok"),
        rules.acceptable_upload(F.col("original_filename"), F.col("file_size_bytes")).alias("upload_ok"),
    )


@query(
    "item_rules",
    """SELECT record_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, (confidence IS NULL OR confidence * 1.5 BETWEEN 0 AND 1) AS confidence_ok,
 coalesce(CASE WHEN unit = 'nm' THEN 'banana' WHEN unit = 'Pa' AND value_text IS NOT NULL THEN NULL ELSE variable_role END IN ('input', 'output', 'contextual'), false) AS role_ok, trim(coalesce(value_text, '')) <> '' AS text_given FROM conditions""",
    ("conditions",),
)
def item_rules(t):
    gone = (F.col("unit") == "Pa") & F.col("value_text").isNotNull()
    role = F.when(F.col("unit") == "nm", F.lit("banana")).when(~gone, F.col("variable_role"))
    return t.conditions.select(
        "record_id",
        "ordinal.*",
        rules.valid_confidence(F.col("confidence") * 1.5).alias("confidence_ok"),
        rules.valid_role(role).alias("role_ok"),
        rules.valid_summary(F.col("value_text")).alias("text_given"),
    )


@query(
    "named_items",
    """SELECT l_orderkey AS record_id, bool_and(l_tax >= 0.02) AS all_named, count(*) AS n_items FROM lineitem GROUP BY l_orderkey""",
)
def named_items(t):
    """Line items as the items of a record, some without the name they must have."""
    name = F.when(F.col("l_tax") >= 0.02, F.col("l_returnflag"))
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list(F.struct(name.alias("parameter_name"))).alias("items"))
    return items.select("record_id", rules.all_named(F.col("items"), "parameter_name").alias("all_named"), F.size("items").cast("bigint").alias("n_items"))
