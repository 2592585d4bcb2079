"""The stand-ins read the whole of their tables."""

from collections import Counter

from pyspark.sql import functions as F

from sieveline.plans import standins

from oracle import SF, duck


def test_every_line_item_is_one_event(spark):
    line = F.floor(F.col("ord") / 10_000_000_000).cast("int")
    got = [Counter(r[0] for r in df.select(line).collect()) for df in (standins.notices(spark, SF), standins.signals(spark, SF))]
    want = dict(duck(SF).sql("SELECT l_linenumber, count(*) FROM lineitem GROUP BY 1").fetchall())
    assert got[0] + got[1] == want
    assert max(got[0]) == 3 and min(got[1]) == 4 and max(got[1]) == max(want)
