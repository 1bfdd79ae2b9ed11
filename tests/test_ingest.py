"""Feeds made of whole tables."""

from beaconry.plans import ingest
from beaconry.session import table

SF = "/root/testdata/sf0.001"


def test_every_line_and_every_event_is_taken(spark):
    lines = table(spark, SF, "lineitem").where("l_orderkey % 20 = 0 or l_shipdate >= timestamp '2000-01-01'").count()
    assert ingest.s06_all_lines(spark, SF).count() == lines > ingest.s06_catalog(spark, SF).count()
    events = table(spark, SF, "events").selectExpr("concat_ws(':', event_type, props) as key").distinct().count()
    assert ingest.s20_upsert_all_events(spark, SF).count() == events
