"""The registered queries of the training-data operators, and oracle SQL of those that SQL can express; tests hold all against brute force."""

from __future__ import annotations

from postlake.llm import collision_search, cover_tree, html_text, language, mixing, pieces, prefix_trie, quartile_digest, sharding, simhash, spelling, toxicity, warc

QUERIES = {
    "op1_collision_search": collision_search.op1_collision_search,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_cover_tree": cover_tree.op4_cover_tree,
    "op5_warc": warc.op5_warc,
    "op6_main_text": html_text.op6_main_text,
    "op7_pieces": pieces.op7_pieces,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language": language.op9_language,
    "op10_shards": sharding.op10_shards,
    "op11_fingerprints": quartile_digest.op11_fingerprints,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES: dict[str, str] = {
    "op4_cover_tree": cover_tree.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op11_fingerprints": quartile_digest.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
