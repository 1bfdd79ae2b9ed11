"""Reports over the driver's tables."""

from beaconry.plans import reports, roles

SF = "/root/testdata/sf0.001"


def test_the_contract_is_checked_on_every_signal(spark):
    got = reports.q06_all_signals(spark, SF).where("field = 'tier'").count()
    assert got == roles.signals(spark, SF).where("tier is null").count() > reports.q06_contract(spark, SF).where("field = 'tier'").count()
