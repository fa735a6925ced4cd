"""The queries of this subpackage and the SQL that says the same, for the entry point at the repository's top."""

from __future__ import annotations

from lattica.llm.decontaminate import op4_decontaminate
from lattica.llm.divergence import OP13_SQL, op13_divergence
from lattica.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from lattica.llm.html_extract import op7_html_extract
from lattica.llm.langid import op10_language_id
from lattica.llm.line_dedup import OP6_SQL, op6_line_dedup
from lattica.llm.minhash_dedup import OP8_SQL, op8_minhash_dedup
from lattica.llm.packing import op5_packing
from lattica.llm.phrases import OP12_SQL, op12_phrases
from lattica.llm.sharding import OP11_SQL, op11_sharding
from lattica.llm.toxicity import op1_toxicity
from lattica.llm.url_filter import OP2_SQL, op2_url_filter
from lattica.llm.warc import OP9_SQL, op9_warc_revisits

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_extract": op7_html_extract,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_language_id": op10_language_id,
    "op11_sharding": op11_sharding,
    "op12_phrases": op12_phrases,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op2_url_filter": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op9_warc_revisits": OP9_SQL,
    "op11_sharding": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
