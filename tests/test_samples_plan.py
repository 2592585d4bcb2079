"""Plans and values that hold at size: bootstrap samples, tokens."""

from pyspark.sql import functions as F

from sieveline.functions import scalars as S
from sieveline.operators import metrics


def test_what_is_drawn_is_never_broadcast(spark):
    df = spark.createDataFrame([("a", i, i % 2, i / 7) for i in range(9)], "g string, ord long, label int, score double")
    out = metrics.samples(df, ["g"], 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    assert "BroadcastExchange" not in plan.split("MapInArrow")[0].split("ShuffledHashJoin")[1]
    assert out.count() == 9 * 20


def test_tokens_take_one_pass(spark):
    texts = ["", None, "Ab abc-DEF  x1yéézz9 \U0001f600ok123\n", "aa bbb" * 3]
    t = S.tokenize(F.col("t"))
    assert "filter(" not in spark.range(1).select(S.tokenize(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    clean = lambda x: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in (x or "").lower())
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(t).collect()]
    assert got == [[w for w in clean(x).split() if len(w) > 2] for x in texts]
