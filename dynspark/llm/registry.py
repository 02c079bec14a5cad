"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from dynspark.llm import bpe, byte_cnn, chat, embedding_dedup, exact_dedup, hard_negatives, html_extract, lexical_search, mixing, simhash, substring_dedup, token_counts, token_output

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_output": token_output.op3_token_output,
    "op4_simhash": simhash.op4_simhash,
    "op5_html": html_extract.op5_html,
    "op6_quality": byte_cnn.op6_quality,
    "op7_bpe": bpe.op7_bpe,
    "op8_embeddings": embedding_dedup.op8_embeddings,
    "op9_substrings": substring_dedup.op9_substrings,
    "op10_chat": chat.op10_chat,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op8_embeddings": embedding_dedup.OP8_SQL,
    "op9_substrings": substring_dedup.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
