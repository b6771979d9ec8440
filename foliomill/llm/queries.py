"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from foliomill.llm import op11_conversation_repair as conversations
from foliomill.llm import op12_collocations as collocations
from foliomill.llm.op01_language_id import op1_language_id
from foliomill.llm.op02_minhash_dedup import op2_minhash_dedup
from foliomill.llm.op03_decontamination import op3_decontamination
from foliomill.llm.op04_warc import op4_warc
from foliomill.llm.op05_token_counts import op5_token_counts
from foliomill.llm.op06_context_tree import op6_context_tree
from foliomill.llm.op07_embedding_dedup import op7_embedding_dedup
from foliomill.llm.op08_html_text import op8_html_text
from foliomill.llm.op09_substring_dedup import op9_substring_dedup
from foliomill.llm.op10_packing import op10_packing
from foliomill.llm.op13_records import op13_records

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_minhash_dedup,
        op3_decontamination,
        op4_warc,
        op5_token_counts,
        op6_context_tree,
        op7_embedding_dedup,
        op8_html_text,
        op9_substring_dedup,
        op10_packing,
        conversations.op11_conversation_repair,
        collocations.op12_collocations,
        op13_records,
    )
}
# Of op4 SQL says digests, sizes and which of equal payloads is stored.
TWINS: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
            CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM f""",
    "op11_conversation_repair": conversations.twin(),
    "op12_collocations": collocations.TWIN,
}
