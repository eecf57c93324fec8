from datetime import datetime

from costlens.api import SpendReports
from costlens.session import work_dir
from costlens.sources.testdata import load_tables
from tests.conftest import AS_OF, SF0001, rows, sha


def test_facade_matches_operators_and_one_key(spark):
    t = load_tables(spark, SF0001)
    root = work_dir(spark, "t-api")
    t.logs.write.parquet(f"{root}/logs")
    t.keys.write.parquet(f"{root}/keys")
    r = SpendReports.from_parquet(spark, f"{root}/logs", f"{root}/keys", as_of=AS_OF)
    assert r.summary("week").count() == t.keys.count()
    one = r.for_key("Bearer sk-user-7")
    bm = one.by_model("month").collect()
    assert bm and {x["api_key"] for x in bm} == {sha("sk-user-7")}
    spends = [x["spend"] for x in bm]
    assert spends == sorted(spends, reverse=True)
    days = [x["date"] for x in one.daily("month").collect()]
    assert days == sorted(days, reverse=True)
    assert one.budget().count() == 1
    assert rows(r.management_spend(start=datetime(2024, 1, 10))) == \
        rows(r.management_spend(start=datetime(2024, 1, 10)))
    assert r.management_spend().count() == 705
