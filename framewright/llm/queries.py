"""One query per operator of this subpackage, with SQL where SQL can express it."""

from __future__ import annotations

from .byte_repeats import OP5_SQL, op5_byte_repeats
from .cap_filters import op10_cap_filters
from .chat_format import OP13_SQL, op13_chat_format
from .conversation_repair import op12_conversation_repair
from .decontaminate import op6_benchmark_decontamination
from .language_id import op7_language_id
from .mixing import op3_source_mixing
from .ngram_join import OP4_SQL, op4_ngram_jaccard_join
from .pii import op1_pii
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .tables import table
from .token_store import op2_token_store
from .url_filter import OP9_SQL, op9_url_filter
from .window_dedup import OP8_SQL, op8_window_dedup


def queries() -> dict:
    def over(operator, *names):
        return lambda spark, sf_dir: operator(*(table(spark, sf_dir, n) for n in names))

    return {
        "op1_pii": over(op1_pii, "documents"),
        "op2_token_store": over(op2_token_store, "documents"),
        "op3_source_mixing": over(op3_source_mixing, "documents"),
        "op4_ngram_jaccard_join": over(op4_ngram_jaccard_join, "documents"),
        "op5_byte_repeats": over(op5_byte_repeats, "documents"),
        "op6_benchmark_decontamination": over(op6_benchmark_decontamination, "documents", "benchmark"),
        "op7_language_id": over(op7_language_id, "documents"),
        "op8_window_dedup": over(op8_window_dedup, "documents"),
        "op9_url_filter": over(op9_url_filter, "pages"),
        "op10_cap_filters": over(op10_cap_filters, "embeddings"),
        "op11_prefix_trie": over(op11_prefix_trie, "conversations"),
        "op12_conversation_repair": over(op12_conversation_repair, "conversations"),
        "op13_chat_format": over(op13_chat_format, "conversations"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4_SQL, "op5_byte_repeats": OP5_SQL, "op8_window_dedup": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_chat_format": OP13_SQL}
