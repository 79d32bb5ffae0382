"""The queries of this package for the driver: one for each operator, and the SQL where it can express them."""

from corelev.llm import ann, chat, decontam, langid, line_dedup, lm, merkle, ngram_join, packing, sharding, tokens, toxicity, variants

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_token_output": tokens.op7_token_output,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_langid": langid.op12_langid,
    "op13_variants": variants.op13_variants,
}

ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_variants": variants.ORACLE,
}
