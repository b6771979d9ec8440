"""Bibliographic merging, record versions, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as tx
from foliomill.operators import biblio, corrections, records
from workload.base import query


def mined(t):
    """Bibliographic values mined from each paper's front page."""
    text = F.col("text")
    return t.front.select(
        "paper_id",
        tx.mine_title(text).alias("title"),
        tx.mine_doi(text).alias("doi"),
        tx.mine_abstract(text).alias("abstract"),
        tx.mine_year(text).alias("publication_year"),
        F.length("text").alias("page_count"),
        text.alias("raw_text"),
        F.lit("native").alias("parse_method"),
    )


MINED_SQL = """(SELECT paper_id, rtrim(nullif(regexp_extract(substr(text, 1, 5000), '(?i)\\b(10\\.[0-9]{4,9}/[-._;()/:A-Z0-9a-z]+)', 1), ''), '.,;)>') AS doi,
 list_filter(list_transform(regexp_extract_all(substr(text, 1, 3000), '\\b(?:19|20)[0-9]{2}\\b'), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2030)[1] AS year,
 text FROM front)"""


@query(
    "fill_missing_biblio",
    f"""SELECT p.paper_id, coalesce(nullif(p.doi, ''), m.doi) AS doi, coalesce(nullif(p.publication_year, 0), m.year) AS publication_year
FROM papers p LEFT JOIN {MINED_SQL} m USING (paper_id)""",
    ("front",),
)
def fill_missing_biblio(t):
    filled = biblio.fill_missing(t.papers, mined(t), ["doi", "publication_year"])
    return filled.select("paper_id", "doi", "publication_year")


@query(
    "merge_parse",
    f"""SELECT p.paper_id, coalesce(nullif(p.doi, ''), m.doi) AS doi, CAST(length(m.text) AS INTEGER) AS page_count, m.text AS raw_text, 'parsed' AS status
FROM papers p LEFT JOIN {MINED_SQL} m USING (paper_id)""",
    ("front",),
)
def merge_parse(t):
    base = t.papers.withColumns({"page_count": F.lit(None).cast("int"), "parse_method": F.lit(None).cast("string")})
    merged = biblio.merge_parse(base, mined(t))
    return merged.select("paper_id", "doi", "page_count", "raw_text", "status")


@query(
    "merge_biblio",
    """SELECT p.paper_id, coalesce(nullif(p.title, ''), nullif(b.role, '')) AS title, coalesce(b.volume, 'old') AS volume,
 CASE WHEN nullif(b.role, '') IS NOT NULL THEN sha256('journal~' || b.role) ELSE 'none' END AS journal_id FROM papers p LEFT JOIN
 (SELECT conv_id AS paper_id, arg_min(role, turn) AS role, CAST(count(*) AS VARCHAR) AS volume FROM conversations GROUP BY conv_id) b USING (paper_id)""",
    ("papers",),
)
def merge_biblio(t):
    base = t.papers.select(
        "paper_id",
        "title",
        "doi",
        "abstract",
        "publication_year",
        F.lit("old").alias("volume"),
        F.lit(None).cast("string").alias("issue"),
        F.lit(None).cast("string").alias("pages"),
        F.lit(None).cast("array<string>").alias("keywords"),
        F.lit("none").alias("journal_id"),
    )
    none = F.lit(None).cast("string")
    update = t.conversations.groupBy(F.col("conv_id").alias("paper_id")).agg(
        F.min_by("role", "turn").alias("title"), F.count(F.lit(1)).cast("string").alias("volume")
    )
    update = update.withColumns(
        {
            "journal": F.col("title"),
            "doi": none,
            "abstract": none,
            "year": F.lit(None).cast("int"),
            "issue": none,
            "pages": none,
            "keywords": F.lit(None).cast("array<string>"),
        }
    )
    return biblio.merge_biblio(base, update).select("paper_id", "title", "volume", "journal_id")


@query(
    "finalize_papers",
    """SELECT paper_id, CASE WHEN l.doc_id IS NOT NULL THEN '1.0.0' END AS schema_version,
 CASE WHEN l.doc_id IS NOT NULL THEN 'extracted' ELSE status END AS status FROM papers LEFT JOIN labels l ON l.doc_id = paper_id""",
    ("papers",),
)
def finalize_papers(t):
    base = t.papers.select("paper_id", "status", F.lit(None).cast("string").alias("schema_version"))
    done = t.labels.select(F.col("doc_id").alias("paper_id"), F.lit("1.0.0").alias("schema_version"))
    return biblio.finalize_papers(base, done).select("paper_id", "schema_version", "status")


@query(
    "journals_dim",
    """SELECT sha256('journal~' || name) AS journal_id, name, origin FROM (SELECT name, CASE WHEN bool_or(known) THEN 'known' END AS origin FROM
 (SELECT c_mktsegment AS name, true AS known FROM customer UNION ALL SELECT journal_name, false FROM papers WHERE journal_name <> '') GROUP BY name)""",
    ("papers",),
)
def journals_dim(t):
    known = t.segments.withColumn("origin", F.lit("known"))
    return biblio.upsert_journals(known, t.papers.select(F.col("journal_name").alias("name")))


@query(
    "authors_dim",
    """SELECT sha256('author~' || n) AS author_id, n AS full_name, CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') END AS first_name, w[len(w)] AS last_name
FROM (SELECT DISTINCT p_name AS n, string_split(p_name, ' ') AS w FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 25))
UNION ALL SELECT DISTINCT 'known ' || p_name, p_name, 'as', 'stored' FROM part WHERE p_size > 25""",
)
def authors_dim(t):
    """Names of the larger parts are known under ids of their own; the others are new."""
    name = F.col("p_name")
    stored = t.part.where("p_size > 25").select(name.alias("full_name")).distinct()
    known = stored.select(F.concat(F.lit("known "), "full_name").alias("author_id"), "full_name", F.lit("as").alias("first_name"), F.lit("stored").alias("last_name"))
    return biblio.upsert_authors(known, t.part.select(name.alias("full_name")))


WORDS = "string_split(p_name, ' ')"


@query(
    "author_links",
    f"""SELECT paper_id, sha256('author~' || name) AS author_id, name AS full_name, CAST(min(i) - 1 AS INTEGER) AS position FROM
 (SELECT p_partkey AS paper_id, unnest(list_concat({WORDS}, {WORDS}, [p_brand])) AS name,
  unnest(generate_series(1, CAST(2 * len({WORDS}) + 1 AS BIGINT))) AS i FROM part) GROUP BY paper_id, name""",
)
def author_links(t):
    words = F.split("p_name", " ")
    listed = t.part.select(
        F.col("p_partkey").alias("paper_id"), F.concat(words, words, F.array("p_brand")).alias("authors")
    )
    return biblio.author_links(listed)


@query(
    "replace_links",
    """SELECT l_orderkey AS paper_id, l_suppkey AS author_id, l_linenumber AS position FROM lineitem WHERE l_orderkey NOT IN (SELECT conv_id FROM conversations)
UNION ALL SELECT conv_id, turn, CAST(turn AS INTEGER) FROM conversations""",
)
def replace_links(t):
    new = t.conversations.select(
        F.col("conv_id").alias("paper_id"), F.col("turn").alias("author_id"), F.col("turn").cast("int").alias("position")
    )
    return biblio.replace_links(t.links, new)


@query(
    "canonical_records",
    "SELECT record_id, paper_id, created_at, status FROM canon",
    ("canon",),
)
def canonical_records(t):
    return records.canonical(t.versions).select("record_id", "paper_id", "created_at", "status")


@query(
    "canonical_events",
    """SELECT record_id, paper_id, status, summary_text FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, record_id DESC) AS rn
 FROM event_records) WHERE rn = 1""",
    ("event_records",),
)
def canonical_events(t):
    return records.canonical(t.event_records).select("record_id", "paper_id", "status", "summary_text")


@query(
    "delete_cascade",
    """SELECT 'papers' AS table_name, paper_id, NULL::BIGINT AS row_id, title AS shown FROM papers WHERE paper_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'records', paper_id, record_id, status FROM event_records WHERE paper_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'links', l_orderkey, l_suppkey, l_linenumber::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    ("papers", "event_records"),
)
def delete_cascade(t):
    gone = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("paper_id"))
    kept = corrections.delete_papers({"papers": t.papers, "records": t.event_records, "links": t.links}, gone)
    none = F.lit(None).cast("bigint")
    shown = {"papers": (none, "title"), "records": (F.col("record_id"), "status"), "links": (F.col("author_id"), "position")}
    parts = [
        rows.select(F.lit(name).alias("table_name"), "paper_id", shown[name][0].alias("row_id"), F.col(shown[name][1]).cast("string").alias("shown"))
        for name, rows in kept.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "apply_failures",
    """SELECT paper_id, CASE WHEN e.paper_id IS NOT NULL THEN 'failed' ELSE status END AS status, parse_error, extraction_error FROM papers LEFT JOIN
 (SELECT user_id AS paper_id, arg_max(props, row(ts, props)) FILTER (event_type = 'error') AS parse_error, arg_max(props, row(ts, props)) FILTER (event_type = 'signup') AS extraction_error
  FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id) e USING (paper_id)""",
    ("papers",),
)
def apply_failures(t):
    none = F.lit(None).cast("string")
    base = t.papers.select("paper_id", "status", none.alias("parse_error"), none.alias("extraction_error"))
    errors = t.events.where(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").alias("paper_id"),
        F.when(F.col("event_type") == "error", F.lit("parse")).otherwise(F.lit("extract")).alias("stage"),
        F.col("props").alias("error"),
        F.col("ts").alias("failed_at"),
    )
    return corrections.apply_failures(base, errors)


# Payload number of an event.
PAYLOAD = "CAST(get_json_object(props, '$.k') AS INT)"
SQL_PAYLOAD = "CAST(json_extract(props, '$.k') AS INTEGER)"


def paper_patches(t):
    return t.events.selectExpr(
        "user_id AS paper_id",
        "event_id AS patch_id",
        "ts AS patched_at",
        "CASE WHEN event_type = 'click' THEN concat('title ', props) END AS title",
        f"CASE WHEN event_type IN ('view', 'error') THEN 1890 + {PAYLOAD} END AS publication_year",
        "CASE WHEN event_type IN ('purchase', 'error') THEN concat('10.5555/', CAST(event_id AS STRING)) END AS doi",
    )


@query(
    "patched_papers",
    f"""SELECT p.paper_id, coalesce(n.title, p.title) AS title, coalesce(n.publication_year, p.publication_year) AS publication_year, coalesce(n.doi, p.doi) AS doi FROM papers p LEFT JOIN
 (SELECT paper_id, arg_max(title, row(ts, event_id)) AS title, arg_max(publication_year, row(ts, event_id)) AS publication_year, arg_max(doi, row(ts, event_id)) AS doi FROM
  (SELECT user_id AS paper_id, ts, event_id, CASE WHEN event_type = 'click' THEN concat('title ', props) END AS title,
   CASE WHEN event_type IN ('view', 'error') THEN 1890 + {SQL_PAYLOAD} END AS publication_year,
   CASE WHEN event_type IN ('purchase', 'error') THEN concat('10.5555/', CAST(event_id AS VARCHAR)) END AS doi FROM events)
  WHERE publication_year IS NULL OR publication_year BETWEEN 1900 AND 2100 GROUP BY paper_id) n USING (paper_id)""",
    ("papers",),
)
def patched_papers(t):
    patched = corrections.apply_patches(t.papers, paper_patches(t))
    return patched.select("paper_id", "title", "publication_year", "doi")


@query(
    "patched_records",
    f"""SELECT r.record_id, coalesce(n.summary_text, r.summary_text) AS summary_text, n.review_notes AS review_notes, n.record_id IS NOT NULL AS human_edited,
 CASE WHEN n.record_id IS NOT NULL AND status <> 'needs_review' THEN 'complete' ELSE status END AS status FROM event_records r LEFT JOIN
 (SELECT record_id, arg_max(summary_text, row(ts, event_id)) AS summary_text, arg_max(review_notes, row(ts, event_id)) AS review_notes FROM
  (SELECT {SQL_PAYLOAD} AS record_id, ts, event_id, CASE WHEN event_type = 'click' THEN event_type || props END AS summary_text,
   CASE WHEN event_type = 'view' THEN 'seen ' || props END AS review_notes FROM events) GROUP BY record_id) n USING (record_id)""",
    ("event_records",),
)
def patched_records(t):
    edits = t.events.selectExpr(
        f"{PAYLOAD} AS record_id",
        "event_id AS patch_id",
        "ts AS patched_at",
        "CASE WHEN event_type = 'click' THEN concat(event_type, props) END AS summary_text",
        "CASE WHEN event_type = 'view' THEN concat('seen ', props) END AS review_notes",
    )
    patched = corrections.apply_record_patches(t.event_records, edits)
    return patched.select("record_id", "summary_text", "review_notes", "human_edited", "status")


@query(
    "reprocess_selection",
    "SELECT paper_id, status FROM papers WHERE raw_text <> '' AND paper_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    ("papers",),
)
def reprocess_selection(t):
    wanted = t.labels.where(F.col("quality") == 0).select(F.col("doc_id").alias("paper_id"))
    return corrections.select_for_reprocess(t.papers, "extract", wanted).select("paper_id", "status")


@query(
    "latest_status",
    "SELECT paper_id, arg_max(status, row(created_at, job_id)) AS status, max(created_at) AS ts FROM job_events GROUP BY paper_id",
    ("job_events",),
)
def latest_status(t):
    from foliomill.streaming.status import latest_status as newest

    return newest(_status_events(t))


def _status_events(t):
    return t.job_events.select("paper_id", F.col("job_id").alias("event_id"), F.col("created_at").alias("ts"), "status")


@query(
    "live_counts",
    """SELECT s.status, count(l.paper_id) AS n FROM (VALUES ('queued'), ('running'), ('success'), ('failed'), ('retrying'), ('cancelled')) s(status) LEFT JOIN
 (SELECT paper_id, arg_max(status, row(created_at, job_id)) AS status FROM job_events GROUP BY paper_id) l USING (status) GROUP BY s.status""",
    ("job_events",),
)
def live_counts(t):
    from foliomill import config
    from foliomill.streaming.status import live_counts as counts

    return counts(_status_events(t), config.JOB_STATUSES)
