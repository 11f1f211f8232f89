"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from docquarry.llm import bpe, digest, forest_dedup, materialise, mixing, quality, secrets, sharding, simhash, spelling, urlgraph, warc
from docquarry.llm.shared import table


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_feistel_shards(spark, sf_dir):
    import public_tokenizers

    return materialise.materialised(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_boosted_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_virtual_slots(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op5_improbable_digest(spark, sf_dir):
    return digest.compared(table(spark, sf_dir, "documents"))


def op6_link_trust(spark, sf_dir):
    return urlgraph.judged(table(spark, sf_dir, "pages"))


def op7_covering_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_warc_history(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_secret_forest(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_weighted_mix(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_spelling_bands(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lsh_forest(spark, sf_dir):
    return forest_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_feistel_shards": op2_feistel_shards, "op3_boosted_quality": op3_boosted_quality, "op4_virtual_slots": op4_virtual_slots, "op5_improbable_digest": op5_improbable_digest, "op6_link_trust": op6_link_trust, "op7_covering_simhash": op7_covering_simhash, "op8_warc_history": op8_warc_history, "op9_secret_forest": op9_secret_forest, "op10_weighted_mix": op10_weighted_mix, "op11_spelling_bands": op11_spelling_bands, "op12_lsh_forest": op12_lsh_forest}

ORACLE_SQL: dict[str, str] = {"op6_link_trust": urlgraph.judged_sql(), "op8_warc_history": warc.ARCHIVED_SQL, "op10_weighted_mix": mixing.TAKEN_SQL, "op11_spelling_bands": spelling.VARIANTS_SQL, "op12_lsh_forest": forest_dedup.NEAR_SQL}
