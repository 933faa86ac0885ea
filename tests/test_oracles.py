import pytest

from smishlake.plans.oracles import ORACLES
from smishlake.plans.queries import QUERIES
from tests.helpers import assert_same, connect

#: One query of each kind; the driver compares all of them.
NAMES = ["intake_rejects", "text_normalised", "ioc_all", "ioc_blocklist", "url_findings", "url_verdicts", "evidence_long", "brand_decisions", "manipulation", "dna_traits", "conv_results", "conv_transitions", "next_step", "augment_fixed", "template_groups", "split_overlap", "macro_f1", "label_centroids", "exact_duplicates", "text_log", "message_records", "campaign_store", "campaign_members", "augment_random", "embedding_pairs", "key_violations"]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLES[name])


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
