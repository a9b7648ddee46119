"""All queries of this subpackage and their SQL twins."""

from attestor.llm import byte_bpe, dedup, licenses, line_join, mixing, pii, prefix_trie, quality, repair, simhash, token_files, toxicity, url_rules

MODULES = (toxicity, token_files, dedup, url_rules, pii, line_join, simhash, quality, byte_bpe, mixing, licenses, prefix_trie, repair)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
