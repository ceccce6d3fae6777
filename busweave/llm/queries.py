"""Registered queries of the training-data operators and their SQL."""

from busweave.llm import bpe, cotrain, exact, html_blocks, lexical, mixing, runs, simhash, substring, tokenfiles, toxicity, vafile, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_top_k": vafile.op3_top_k,
    "op4_quality": cotrain.op4_quality,
    "op5_bpe": bpe.op5_bpe,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_files": tokenfiles.op8_token_files,
    "op9_html_text": html_blocks.op9_html_text,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_warc": warc.op12_warc,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
SQL = {
    "op2_exact_dedup": exact.SQL,
    "op3_top_k": vafile.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_warc": warc.SQL,
}
