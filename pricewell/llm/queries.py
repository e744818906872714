"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, line_dedup, mixing, ngram_join, pieces, prefix_trie, quality_rules, quote_links, secret_scan, sharding, turn_repair, url_filter, warc
from .common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op2_hash_tree_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op3_quality_decision_list(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_template_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), short_docs=5)


def op6_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op7_spaced_seed_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_forest(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op9_quotation_linking(spark, sf_dir):
    """The table holds no quotes, so each message quotes an earlier one of its conversation first."""
    return quote_links.link_quotes(quote_links.with_quotes(table(spark, sf_dir, "conversations")))


def op10_dictionary_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_piece_encoding(spark, sf_dir):
    import public_tokenizers

    return pieces.digests(pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op13_turn_repair(spark, sf_dir):
    return turn_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join, op2_hash_tree_sharding, op3_quality_decision_list, op4_source_mixing, op5_template_line_dedup, op6_url_filter, op7_spaced_seed_decontamination,
            op8_secret_forest, op9_quotation_linking, op10_dictionary_warc, op11_prefix_trie, op12_piece_encoding, op13_turn_repair,
        )
    }


def oracle_sql():
    return {"op4_source_mixing": mixing.SQL, "op6_url_filter": url_filter.SQL, "op9_quotation_linking": quote_links.SQL, "op10_dictionary_warc": warc.SQL}
