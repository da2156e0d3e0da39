"""Registered queries of the operators, and SQL for those that SQL can express."""

from modelsift.llm import (
    bpe,
    collocations,
    conversations,
    embeddings,
    minhash,
    mixing,
    packing,
    personal_data,
    quality_model,
    quality_rules,
    sharding,
    tool_calls,
    toxicity,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_hilbert_shards": sharding.op5_hilbert_shards,
    "op6_minhash_odd_sketch": minhash.op6_minhash_odd_sketch,
    "op7_tool_chat": tool_calls.op7_tool_chat,
    "op8_itq_near_vectors": embeddings.op8_itq_near_vectors,
    "op9_toxicity_cnn": toxicity.op9_toxicity_cnn,
    "op10_personal_data": personal_data.op10_personal_data,
    "op11_tiled_collocations": collocations.op11_tiled_collocations,
    "op12_rank_array_bpe": bpe.op12_rank_array_bpe,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op1_quality_rules": quality_rules.SQL,
    "op4_mix_sources": mixing.SQL,
    "op5_hilbert_shards": sharding.SQL,
    "op11_tiled_collocations": collocations.SQL,
}
