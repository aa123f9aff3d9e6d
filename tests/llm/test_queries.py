"""Every registered query of the subpackage on the smallest tables: against its SQL, or against what its contract says of rows and columns."""

import os

import duckdb
import pytest

from docspark.llm import queries
from tests.test_queries import DIR, TABLES, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")

COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_quality_classifier": "doc_id held_out score predicted",
    "op3_simhash_dedup": "doc_id fingerprint component_id",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_minhash_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_source_mix": "doc_id size source_size target taken",
    "op7_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_lexical_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_media_chunks": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op10_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_source_divergence": "lang source part item value rank",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_url_rules": "page_id host path rule verdict",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_all_are_named():
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name in queries.ORACLE:
        expected = duck.sql(queries.ORACLE[name])
        assert rows_of(df.columns, rows) == rows_of(expected.columns, expected.fetchall())
        return
    ids = sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())
    if name == "op8_lexical_packing":
        assert sorted({r.doc_id for r in rows}) == ids
        total, size = {}, {}
        for r in rows:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
        assert all(total[r.doc_id] == r.doc_tokens for r in rows) and all(n == 2048 or n & (n - 1) == 0 for n in size.values())
    else:
        assert sorted(r.doc_id for r in rows) == ids
    if name == "op6_source_mix":
        per_source = {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            key = (r.source_size, r.target)
            per_source[key] = per_source.get(key, 0) + r.taken
        assert all(abs(n - target) <= max(2, 0.001 * target) for (_, target), n in per_source.items())
    if name == "op3_simhash_dedup":
        assert all(r.component_id <= r.doc_id and len(r.fingerprint) == 16 for r in rows)
    if "score" in df.columns and name != "op10_lm_scores":
        assert all(0 <= r.score <= 1 for r in rows)
