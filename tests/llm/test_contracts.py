"""The columns that each numbered query returns, and that it does so over a whole table."""

import pytest

from tracklane.llm import queries

WANT = {
    "op1": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3": "query_id bigint, rank int, vec_id bigint, score double",
    "op4": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8": "page_id bigint, host string, path string, rule string, verdict string",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11": "lang string, source string, part string, item string, value bigint, rank int",
    "op12": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op13": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op")))
def test_columns(spark, name):
    types = dict(queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    for column in WANT[name.split("_")[0]].split(", "):
        c, kind = column.split()
        assert types[c] == kind, c
