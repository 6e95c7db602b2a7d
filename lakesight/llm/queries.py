"""Queries of the pipeline operators and their SQL equivalents."""

from __future__ import annotations

import corpus_pipeline
from lakesight.llm import bpe, conversation_repair, exact_dedup, hard_negatives, language, licenses, line_dedup, mixing, secret_scan, simhash, sketches, suffix_dedup, trie_bpe
from lakesight.plans.registry import Registry

training = Registry()
training.register(name="op1_line_dedup")(line_dedup.op1_line_dedup)
training.register(name="op2_secrets")(secret_scan.op2_secrets)
training.register(name="op3_fingerprints")(sketches.op3_fingerprints)
training.register(name="op4_language")(language.op4_language)
training.register(name="op5_byte_bpe")(bpe.op5_byte_bpe)
training.register(name="op6_simhash")(simhash.op6_simhash)
training.register(name="op7_repeated_strings")(suffix_dedup.op7_repeated_strings)
training.register(name="op8_licenses")(licenses.op8_licenses)
training.register(oracle=exact_dedup.OP9_SQL, name="op9_exact_dedup")(exact_dedup.op9_exact_dedup)
training.register(name="op10_mix_sources")(mixing.op10_mix_sources)
training.register(name="op11_conversation_repair")(conversation_repair.op11_conversation_repair)
training.register(name="op12_trie_bpe")(trie_bpe.op12_trie_bpe)
training.register(name="op13_hard_negatives")(hard_negatives.op13_hard_negatives)
training.register(oracle=corpus_pipeline.ORACLE_SQL, name="pipeline")(corpus_pipeline.run)
