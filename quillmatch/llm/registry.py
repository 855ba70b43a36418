"""The registered queries of this folder and the SQL that gives the same rows."""

from quillmatch.llm import bpe, decontamination, html_text, language_id, near_dedup, ogg, periodic_runs, prefix_trie, quality, secrets_scan, substring_dedup, suffix_dedup, toxicity

MODULES = [substring_dedup, language_id, near_dedup, html_text, bpe, toxicity, ogg, decontamination, secrets_scan, suffix_dedup, prefix_trie, periodic_runs, quality]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
