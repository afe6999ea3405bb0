"""The registered queries of the training-data operators and their SQL."""

from rungwise.llm import bagminhash, bpe, divergence, embeddings, lines, mixing, pii, quality, resampling, tokencounts, toxicity, urls, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_feistel_pii": pii.op2_feistel_pii,
    "op3_embedding_dedup": embeddings.op3_embedding_dedup,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_warc": warc.op5_warc,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_line_quality": quality.op7_line_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bagminhash_dedup": bagminhash.op9_bagminhash_dedup,
    "op10_url_filter": urls.op10_url_filter,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_token_counts": tokencounts.op13_token_counts,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_embedding_dedup": embeddings.OP3_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_line_quality": quality.OP7_SQL,
    "op9_bagminhash_dedup": bagminhash.OP9_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
