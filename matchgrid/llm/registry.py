"""Queries and oracles of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from matchgrid.llm import exact_dedup, html_text, katz, lattice_join, ngram_join, packing, secrets, token_files, toxicity, trie_bpe


def queries():
    return {
        "op1_katz": katz.op1_katz,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_trie_bpe": trie_bpe.op4_trie_bpe,
        "op5_lattice_join": lattice_join.op5_lattice_join,
        "op6_html_text": html_text.op6_html_text,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_packing": packing.op8_packing,
        "op9_token_files": token_files.op9_token_files,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    out = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return out | {
        "op3_ngram_join": ngram_join.SQL,
        "op5_lattice_join": lattice_join.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
    }
