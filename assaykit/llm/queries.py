"""Queries over the operators of this subpackage, and the SQL that some of them must equal."""

from __future__ import annotations

from . import conversations, decontamination, embeddings, licenses, media, minhash, mixing, quality, spelling, substrings, tokens, url_filter, warc

#: query -> module; each module has a function of the query's name.
MODULES = {
    "op1_quality": quality,
    "op2_warc": warc,
    "op3_url_filter": url_filter,
    "op4_licenses": licenses,
    "op5_media": media,
    "op6_substrings": substrings,
    "op7_token_orc": tokens,
    "op8_decontamination": decontamination,
    "op9_minhash": minhash,
    "op10_mixing": mixing,
    "op11_spelling": spelling,
    "op12_conversations": conversations,
    "op13_embeddings": embeddings,
}
#: query -> name of its SQL in its module, where SQL can express it.
SQL = {"op2_warc": "OP2_SQL", "op3_url_filter": "OP3_SQL", "op6_substrings": "OP6_SQL", "op10_mixing": "OP10_SQL", "op11_spelling": "OP11_SQL", "op12_conversations": "OP12_SQL", "op13_embeddings": "OP13_SQL"}


def queries() -> dict:
    return {q: getattr(MODULES[q], q) for q in MODULES}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(MODULES[q], name) for q, name in SQL.items()}
