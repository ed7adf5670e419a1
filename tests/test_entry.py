"""Driver contract: entry, registry and oracle keys."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "pre", "tag", "is_main"]
    rows = df.collect()
    assert rows and all(r["is_main"] in (0, 1) for r in rows)


PLANNED = """dom_nodes csv_roundtrip page_scan blocks_csv page_allowlist gold_lines text_blocks
class_select attr_select subtree_mark class_remove attr_remove unwrap lca block_mark contradictions
own_text_search subtree_text render label_by_class label_by_attr label_block_by_attr label_by_text
label_block_by_text label_corpus label_corpus_attr label_corpus_block_attr gold_keys gold_candidates gold_align attach_predictions
parse_sequences vocab encode fold_pad_mask split_parts unpad_explode attention_mask seq_len
pool_mean pool_max pool_first combine context class_weights emissions_nb transitions decode
sequence_loss fit_predict model_reload eval_metrics eval_report tag_map clean_text match_tiers
match_resolve annotate highlight label_pages eval_pairs""".split()


def test_oracles_cover_queries():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert set(PLANNED) <= set(qs)
    # rows-only by design: the MLlib solver path
    assert set(PLANNED) - set(sqls) <= {"fit_predict"}
