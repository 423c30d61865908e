"""Folding orders in several micro-batches gives the batch cohort tables."""
from pyspark.sql import functions as F

from retentio.operators import cohort as co
from retentio.plans.common import cleaned, lookup, raw_orders
from retentio.schema import ORDERS_SCHEMA
from retentio.session import scratch_path
from retentio.sources.tables import TEST_CUTOFF
from retentio.streaming import CohortState, start_cohort_stream
from tests.conftest import SF_SMALL
from tests.helpers import rows


def test_stream_equals_batch(spark):
    src = scratch_path(spark, "stream-src")
    raw = raw_orders(spark, SF_SMALL)
    # three files, later orders in later files
    for i, (lo, hi) in enumerate([(0, 2000), (2000, 4000), (4000, 10**9)]):
        part = raw.filter((F.col("order_id") >= lo) & (F.col("order_id") < hi))
        part.write.mode("overwrite").parquet(f"{src}/part{i}")
    stream = (spark.readStream.schema(ORDERS_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    state = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF)
    q = start_cohort_stream(stream, state)
    q.awaitTermination(300)
    assert state.version is not None and state.version >= 1
    act_s, cnt_s = state.cohort_tables()
    act_b, cnt_b = co.cohort_tables(cleaned(spark, SF_SMALL))
    assert rows(act_s) == rows(act_b)
    assert rows(cnt_s) == rows(cnt_b)


def test_state_resumes_after_restart(spark):
    from retentio.plans.common import cleaned
    raw = raw_orders(spark, SF_SMALL)
    state = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF)
    state.merge_batch(raw.filter("order_id < 3000"), 0)
    state.merge_batch(raw.filter("order_id >= 3000"), 1)
    again = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF, root=state.root)
    assert again.version == 1
    act_s, cnt_s = again.cohort_tables()
    act_b, cnt_b = co.cohort_tables(cleaned(spark, SF_SMALL))
    assert rows(act_s) == rows(act_b) and rows(cnt_s) == rows(cnt_b)


def test_replayed_batch_counts_once(spark):
    """A batch replayed after its snapshot was written (failure before the
    stream committed it) must not fold its orders in twice."""
    from retentio.plans.common import cleaned
    raw = raw_orders(spark, SF_SMALL)
    state = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF)
    first, second = raw.filter("order_id < 3000"), raw.filter("order_id >= 3000")
    state.merge_batch(first, 0)
    state.merge_batch(second, 1)
    state.merge_batch(second, 1)          # replay
    act_s, cnt_s = state.cohort_tables()
    act_b, cnt_b = co.cohort_tables(cleaned(spark, SF_SMALL))
    assert rows(act_s) == rows(act_b) and rows(cnt_s) == rows(cnt_b)


def test_ties_split_across_batches(spark):
    from tests.test_semantics import order, orders
    lk = spark.createDataFrame([(1, "MD")], "zip int, state_id string")
    b0 = orders(spark, [order(1, 7, "2019-03-05T10:00:00.000Z", source="web")])
    b1 = orders(spark, [order(2, 7, "2019-03-05T10:00:00.000Z", source="ios"),
                        order(3, 8, "2019-04-01T10:00:00.000Z")])
    b2 = orders(spark, [order(4, 7, "2019-05-01T10:00:00.000Z", source="partner")])
    state = CohortState(spark, lk, None)
    for i, b in enumerate((b0, b1, b2)):
        state.merge_batch(b, i)
    act_s, cnt_s = state.cohort_tables()
    from retentio.operators.clean import clean_orders
    act_b, cnt_b = co.cohort_tables(clean_orders(b0.unionByName(b1).unionByName(b2), lk, None))
    assert rows(cnt_s) == rows(cnt_b) and rows(act_s) == rows(act_b)
    # customer 7: two tied first orders (web, ios), the later partner order is no first order
    assert sorted(r.source for r in cnt_s.filter("cohort_id = '2019-03-01'").collect()) == ["ios", "web"]


def test_compaction_then_more_batches(spark):
    from retentio.plans.common import cleaned
    raw = raw_orders(spark, SF_SMALL)
    state = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF)
    state.merge_batch(raw.filter("order_id < 2000"), 0)
    state.merge_batch(raw.filter("order_id >= 2000 AND order_id < 4000"), 1)
    state.compact()
    state.merge_batch(raw.filter("order_id >= 2000 AND order_id < 4000"), 1)   # replay before base
    state.merge_batch(raw.filter("order_id >= 4000"), 2)
    again = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF, root=state.root)
    assert again.base == 1 and again.version == 2
    act_b, cnt_b = co.cohort_tables(cleaned(spark, SF_SMALL))
    for st_ in (state, again):
        act_s, cnt_s = st_.cohort_tables()
        assert rows(act_s) == rows(act_b) and rows(cnt_s) == rows(cnt_b)
