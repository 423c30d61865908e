"""Random dirty orders tables: the cleaning stage and the cohort tables equal
an independent pandas rendering of the reference's rules."""
import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retentio.operators import cohort as co
from retentio.operators import retention as rt
from retentio.operators.clean import clean_orders
from retentio.schema import ORDERS_SCHEMA

ZIPS = [(1, "MD"), (2, "NY"), (2, "NJ")]          # zip 2 is duplicated: fans out
CUTOFF = "2019-06-01"

order_st = st.fixed_dictionaries({
    "customer": st.one_of(st.none(), st.integers(1, 6)),
    "day": st.integers(0, 200),
    "hour": st.sampled_from([0, 8, 8, 23]),         # repeats make first-order ties
    "date_missing": st.sampled_from([False] * 9 + [True]),
    "source": st.sampled_from(["ios", "web", "partner"]),
    "promo": st.one_of(st.none(), st.integers(0, 3)),
    "state": st.sampled_from(["MD", "VA", "", None]),
    "postal": st.sampled_from([1, 2, 3]),
    "pay": st.sampled_from(["credit", "cash", "/"]),
})


def build(rows):
    out = []
    for i, r in enumerate(rows):
        d = dt.date(2019, 1, 1) + dt.timedelta(days=r["day"])
        ts = "" if r["date_missing"] else f"{d.isoformat()}T{r['hour']:02d}:00:00.000Z"
        out.append((i + 1, r["source"], ts, "Delivery", r["pay"], r["promo"], 10.0,
                    r["customer"], 7, r["state"], r["postal"]))
    return out


def brute(rows):
    df = pd.DataFrame(build(rows), columns=[f.name for f in ORDERS_SCHEMA.fields])
    df = df[df.date_purchased.fillna("").str.len() > 0]
    df = df[df.customer.notna()]
    miss = df.state.isna() | (df.state == "")
    zips = pd.DataFrame(ZIPS, columns=["zip", "state_id"])
    fixed = df[miss].merge(zips, left_on="postal_code", right_on="zip").assign(state=lambda x: x.state_id)
    df = pd.concat([df[~miss], fixed[df.columns]], ignore_index=True)
    df["order_date"] = pd.to_datetime(df.date_purchased.str[:10]).dt.date
    df = df[df.order_date < dt.date.fromisoformat(CUTOFF)]
    df["order_month"] = df.order_date.map(lambda d: d.replace(day=1))
    df["has_promo_value"] = df.promo_value.map(lambda p: None if pd.isna(p) else p != 0)
    first = df.groupby("customer").date_purchased.transform("min")
    cid = df.groupby("customer").order_month.transform("min")
    cohort = df[df.date_purchased == first].assign(cohort_id=cid)[
        ["customer", "cohort_id", "source", "has_promo_value", "promo_value"]]
    months = df[["customer", "order_month"]].drop_duplicates()
    act = months.merge(cohort, on="customer")
    def fill(t):
        return t.assign(promo_value=t.promo_value.map(lambda v: -1 if pd.isna(v) else int(v)),
                        has_promo_value=t.has_promo_value.map(lambda v: "na" if v is None or v != v else v))
    keys = ["order_month", "cohort_id", "source", "promo_value", "has_promo_value"]
    activity = fill(act).groupby(keys).size()
    counts = fill(cohort).groupby(["cohort_id", "source", "has_promo_value", "promo_value"]).size()
    act_all = act.groupby(["order_month", "cohort_id"]).size()
    size_all = cohort.groupby("cohort_id").size()
    rates = {k: v / size_all[k[1]] for k, v in act_all.items()}
    return len(df), activity.to_dict(), counts.to_dict(), rates


def spark_side(spark, rows):
    raw = spark.createDataFrame(build(rows), ORDERS_SCHEMA)
    lk = spark.createDataFrame(ZIPS, "zip int, state_id string")
    df = clean_orders(raw, lk, CUTOFF)
    act, counts = co.cohort_tables(df)

    def key(r, cols):
        return tuple(-1 if (c == "promo_value" and r[c] is None) else
                     ("na" if (c == "has_promo_value" and r[c] is None) else r[c]) for c in cols)
    a = {key(r, ["order_month", "cohort_id", "source", "promo_value", "has_promo_value"]):
         r.active_customers for r in act.collect()}
    c = {key(r, ["cohort_id", "source", "has_promo_value", "promo_value"]): r.cohort_count
         for r in counts.collect()}
    rates = {(r.order_month, r.cohort_id): r.retention_rate
             for r in rt.retention(act, counts).collect()}
    return df.count(), a, c, rates


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(order_st, min_size=1, max_size=40))
def test_random_orders_match_reference_rules(spark, rows):
    n_b, act_b, cnt_b, rate_b = brute(rows)
    n_s, act_s, cnt_s, rate_s = spark_side(spark, rows)
    assert n_s == n_b
    assert act_s == act_b
    assert cnt_s == cnt_b
    assert rate_s == rate_b
