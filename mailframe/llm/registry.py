"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from . import chat_format, decontaminate, language, minhash, mixing, quality, simhash, toxicity, url_filter, wrapper

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_wrapper": wrapper.query,
    "op3_mixing": mixing.query,
    "op4_chat_format": chat_format.query,
    "op5_language": language.query,
    "op6_decontaminate": decontaminate.query,
    "op7_simhash": simhash.query,
    "op8_toxicity": toxicity.query,
    "op9_quality": quality.query,
    "op10_minhash": minhash.query,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op3_mixing": mixing.SQL,
    "op4_chat_format": chat_format.SQL,
}
