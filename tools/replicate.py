"""Derive a k-times larger copy of the test tables (for scaling probes only).

Usage: python tools/replicate.py SRC_DIR DST_DIR K [FILES] [--hot-third]

Copy i of every order, customer and line item gets its keys shifted by
i * (max key + 1), so customers, orders and shops all grow k times while
dates, nations and the dirt pattern keep their shape.  Each table is written
as FILES Parquet files so scans run in parallel.  ``--hot-third`` then gives
every third order to customer 1 (the skew probe: one customer with a third
of all orders).
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    hot_third = "--hot-third" in sys.argv
    src, dst, k = args[0], args[1], int(args[2])
    files = int(args[3]) if len(args) > 3 else 16
    from pyspark.sql import functions as F
    from retentio.session import build_session
    from retentio.sources.tables import _table
    spark = build_session("local[8]", 16)
    copies = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__copy")
    o, c, li, n = (_table(spark, src, t) for t in ("orders", "customer", "lineitem", "nation"))
    ok = o.agg(F.max("o_orderkey")).first()[0] + 1
    ck = c.agg(F.max("c_custkey")).first()[0] + 1
    o2 = (o.select("*", copies)
           .withColumn("o_orderkey", F.col("o_orderkey") + F.col("__copy") * ok)
           .withColumn("o_custkey", F.col("o_custkey") + F.col("__copy") * ck).drop("__copy"))
    if hot_third:
        o2 = o2.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1))
                           .otherwise(F.col("o_custkey")))
    c2 = (c.select("*", copies)
           .withColumn("c_custkey", F.col("c_custkey") + F.col("__copy") * ck).drop("__copy"))
    l2 = (li.select("*", copies)
            .withColumn("l_orderkey", F.col("l_orderkey") + F.col("__copy") * ok).drop("__copy"))
    for name, df in (("orders", o2), ("customer", c2), ("lineitem", l2), ("nation", n)):
        df.repartition(files if name != "nation" else 1).write.mode("overwrite").parquet(
            f"{dst}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
