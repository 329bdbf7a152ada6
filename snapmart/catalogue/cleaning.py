"""Cleaning operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.functions import dates as D
from snapmart.functions import encode as E
from snapmart.functions import numbers as N
from snapmart.functions import text as X
from snapmart.operators import cleaning as C
from snapmart.operators import modeling as M
from snapmart.operators import order_stats as O
from snapmart.operators.joins import flag_source
from snapmart.plans.features import encode_categories


@query(
    "q_enforce_schema",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS Customer_ID,
           TRY_CAST(CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS FLOAT) AS amount,
           CAST(trunc(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal ELSE c_nationkey END) AS INTEGER) AS level,
           c_mktsegment
    FROM customer
    """,
)
def enforce_schema(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        k.alias("Customer_ID"),
        F.when(k % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("amount"),
        F.when(k % 4 == 0, F.col("c_acctbal").cast("string"))
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("level"),
        "c_mktsegment",
    )
    return C.enforce_schema(raw, {"Customer_ID": "string", "amount": "float", "level": "int"})


@query(
    "q_strip_chars",
    f"""
    WITH {R.RAW_ATTRIBUTES}, {R.RAW_FINANCIALS}
    SELECT Customer_ID, rtrim(Age, '_') AS age_text, trim(Annual_Income, '_') AS income_text
    FROM raw_attributes JOIN raw_financials USING (Customer_ID)
    """,
)
def strip_chars(spark, d):
    both = R.raw_attributes(spark, d).select("Customer_ID", "Age").join(
        R.raw_financials(spark, d).select("Customer_ID", "Annual_Income"), "Customer_ID"
    )
    return both.select(
        "Customer_ID",
        X.strip_padding(F.col("Age"), "right").alias("age_text"),
        X.strip_padding(F.col("Annual_Income")).alias("income_text"),
    )


@query(
    "q_placeholder_null",
    f"""
    WITH {R.RAW_FINANCIALS}
    SELECT Customer_ID, nullif(Credit_Mix, '_') AS Credit_Mix,
           nullif(Payment_of_Min_Amount, 'NM') AS Payment_of_Min_Amount,
           CASE WHEN Payment_Behaviour NOT IN ('!@9#%8', '') THEN Payment_Behaviour END AS Payment_Behaviour
    FROM raw_financials
    """,
)
def placeholder_null(spark, d):
    return R.raw_financials(spark, d).select(
        "Customer_ID",
        X.null_if(F.col("Credit_Mix"), "_").alias("Credit_Mix"),
        X.null_if(F.col("Payment_of_Min_Amount"), "NM").alias("Payment_of_Min_Amount"),
        X.null_if(F.col("Payment_Behaviour"), S.BEHAVIOUR_PLACEHOLDER, "").alias("Payment_Behaviour"),
    )


@query(
    "q_numeric_coercion",
    f"""
    WITH {R.RAW_FINANCIALS}
    SELECT Customer_ID, TRY_CAST(Annual_Income AS FLOAT) AS raw_income,
           TRY_CAST(trim(Annual_Income, '_') AS FLOAT) AS income,
           CAST(trunc(TRY_CAST(trim(Outstanding_Debt, '_') AS DOUBLE)) AS INTEGER) AS debt,
           TRY_CAST(Num_of_Loan AS INTEGER) AS loans
    FROM raw_financials
    """,
)
def numeric_coercion(spark, d):
    c = F.col
    return R.raw_financials(spark, d).select(
        "Customer_ID",
        N.to_number(c("Annual_Income"), "float").alias("raw_income"),
        N.to_number(X.strip_padding(c("Annual_Income")), "float").alias("income"),
        N.to_number(X.strip_padding(c("Outstanding_Debt")), "int").alias("debt"),
        N.to_number(c("Num_of_Loan"), "int").alias("loans"),
    )


@query(
    "q_range_rules",
    """
    SELECT c_custkey,
           CASE WHEN c_acctbal >= 0 AND c_acctbal <= 5000 THEN c_acctbal END AS closed,
           CASE WHEN c_acctbal >= 100 THEN c_acctbal END AS lower_only,
           CASE WHEN c_acctbal <= 600 THEN c_acctbal END AS upper_only,
           CASE WHEN c_acctbal < 9000 THEN c_acctbal END AS upper_open,
           CASE WHEN c_acctbal > -500 AND c_acctbal < 500 THEN c_acctbal END AS open_both
    FROM customer
    """,
)
def range_rules(spark, d):
    rules = {
        "closed": S.Range(0, 5000),
        "lower_only": S.Range(low=100),
        "upper_only": S.Range(high=600),
        "upper_open": S.Range(high=9000, high_open=True),
        "open_both": S.Range(-500, 500, low_open=True, high_open=True),
    }
    raw = table(spark, d, "customer").select(
        "c_custkey", *[F.col("c_acctbal").alias(name) for name in rules]
    )
    return C.apply_ranges(raw, rules)


@query(
    "q_duration_months",
    rf"""
    WITH {R.RAW_FINANCIALS}
    SELECT Customer_ID,
           TRY_CAST(regexp_extract(Credit_History_Age, '(\d+)\s+Years?', 1) AS INTEGER) * 12
             + TRY_CAST(regexp_extract(Credit_History_Age, '(\d+)\s+Months?', 1) AS INTEGER) AS months,
           TRY_CAST(regexp_extract(Credit_History_Age, '^(\d+)\s+Years?\s+and\s+(\d+)\s+Months?', 1) AS INTEGER) * 12
             + TRY_CAST(regexp_extract(Credit_History_Age, '^(\d+)\s+Years?\s+and\s+(\d+)\s+Months?', 2) AS INTEGER)
             AS strict_months
    FROM raw_financials
    """,
)
def duration_months(spark, d):
    age = F.col("Credit_History_Age")
    return R.raw_financials(spark, d).select(
        "Customer_ID",
        X.duration_months(age).alias("months"),
        X.duration_months(age, strict=True).alias("strict_months"),
    )


@query(
    "q_text_ordinals",
    f"""
    WITH {R.RAW_FINANCIALS}
    SELECT Customer_ID,
           CASE WHEN contains(Payment_Behaviour, 'Low_spent') THEN 0
                WHEN contains(Payment_Behaviour, 'High_spent') THEN 1 END AS spending_level,
           CASE WHEN contains(Payment_Behaviour, 'Small_value') THEN 0
                WHEN contains(Payment_Behaviour, 'Medium_value') THEN 1
                WHEN contains(Payment_Behaviour, 'Large_value') THEN 2 END AS payment_value_level
    FROM raw_financials
    """,
)
def text_ordinals(spark, d):
    b = F.col("Payment_Behaviour")
    return R.raw_financials(spark, d).select(
        "Customer_ID",
        X.level_by_content(b, S.SPENDING_LEVELS).alias("spending_level"),
        X.level_by_content(b, S.PAYMENT_VALUE_LEVELS).alias("payment_value_level"),
    )


def _count_sql(items: str, item: str) -> str:
    return f"CAST(len(list_filter({items}, lambda x: trim(x) = '{item}')) AS INTEGER)"


_LIST_SQL = r"regexp_split_to_array(regexp_replace(coalesce({c}, ''), ',?\s*and\s+', ', ', 'g'), ',\s*')"
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "q_multi_value_counts",
    f"""
    WITH lists AS (
      SELECT o_orderkey, {_LIST_SQL.format(c='txt')} AS items FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0
          THEN concat(o_orderpriority, ', ', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '2-HIGH' END,
                      ', and ', o_orderstatus) END AS txt
        FROM orders))
    SELECT o_orderkey,
           {", ".join(f"{_count_sql('items', p)} AS n_{i + 1}" for i, p in enumerate(_PRIORITIES))},
           {_count_sql('items', 'F')} AS n_f
    FROM lists
    """,
)
def multi_value_counts(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    text = F.when(
        k % 9 != 0,
        F.concat(
            p, F.lit(", "), F.when(k % 2 == 0, p).otherwise(F.lit("2-HIGH")),
            F.lit(", and "), F.col("o_orderstatus"),
        ),
    )
    lists = table(spark, d, "orders").select(k, X.list_items(text).alias("items"))
    items = F.col("items")
    return lists.select(
        "o_orderkey",
        *[X.item_count(items, v).alias(f"n_{i + 1}") for i, v in enumerate(_PRIORITIES)],
        X.item_count(items, "F").alias("n_f"),
    )


@query(
    "q_encode_map",
    f"""
    SELECT c_custkey,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 END AS segment_code,
           CASE CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'NM' END
             WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS min_payment_code
    FROM customer
    """,
)
def encode_map(spark, d):
    k = F.col("c_custkey")
    paid = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("NM")
    return table(spark, d, "customer").select(
        "c_custkey",
        E.encode_map(F.col("c_mktsegment"), {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2}).alias(
            "segment_code"
        ),
        E.encode_map(paid, S.MIN_PAYMENT_CODES).alias("min_payment_code"),
    )


_TYPED_FINANCIALS = f"""
WITH {R.RAW_FINANCIALS},
typed AS (
  SELECT Customer_ID,
         TRY_CAST(trim(Annual_Income, '_') AS FLOAT) AS Annual_Income,
         TRY_CAST(Monthly_Inhand_Salary AS FLOAT) AS Monthly_Inhand_Salary,
         TRY_CAST(Num_Bank_Accounts AS INTEGER) AS Num_Bank_Accounts,
         TRY_CAST(Num_Credit_Card AS INTEGER) AS Num_Credit_Card,
         TRY_CAST(Interest_Rate AS INTEGER) AS Interest_Rate,
         TRY_CAST(trim(Num_of_Loan, '_') AS INTEGER) AS Num_of_Loan,
         TRY_CAST(Delay_from_due_date AS INTEGER) AS Delay_from_due_date,
         TRY_CAST(trim(Num_of_Delayed_Payment, '_') AS INTEGER) AS Num_of_Delayed_Payment,
         TRY_CAST(trim(Changed_Credit_Limit, '_') AS FLOAT) AS Changed_Credit_Limit,
         TRY_CAST(Num_Credit_Inquiries AS INTEGER) AS Num_Credit_Inquiries,
         nullif(Credit_Mix, '_') AS Credit_Mix,
         TRY_CAST(trim(Outstanding_Debt, '_') AS FLOAT) AS Outstanding_Debt,
         TRY_CAST(Credit_Utilization_Ratio AS FLOAT) AS Credit_Utilization_Ratio,
         TRY_CAST(regexp_extract(Credit_History_Age, '(\\d+)\\s+Years?', 1) AS INTEGER) * 12
           + TRY_CAST(regexp_extract(Credit_History_Age, '(\\d+)\\s+Months?', 1) AS INTEGER) AS Credit_History_Age,
         nullif(Payment_of_Min_Amount, 'NM') AS Payment_of_Min_Amount,
         TRY_CAST(Total_EMI_per_month AS FLOAT) AS Total_EMI_per_month,
         TRY_CAST(trim(Amount_invested_monthly, '_') AS FLOAT) AS Amount_invested_monthly,
         TRY_CAST(trim(Monthly_Balance, '_') AS FLOAT) AS Monthly_Balance,
         snapshot_date,
         CASE WHEN contains(Payment_Behaviour, 'Low_spent') THEN 0
              WHEN contains(Payment_Behaviour, 'High_spent') THEN 1 END AS spending_level,
         CASE WHEN contains(Payment_Behaviour, 'Small_value') THEN 0
              WHEN contains(Payment_Behaviour, 'Medium_value') THEN 1
              WHEN contains(Payment_Behaviour, 'Large_value') THEN 2 END AS payment_value_level,
         {_LIST_SQL.format(c='Type_of_Loan')} AS items
  FROM raw_financials
),
ruled AS (
  SELECT * REPLACE (
    CASE WHEN Num_Bank_Accounts BETWEEN 0 AND 20 THEN Num_Bank_Accounts END AS Num_Bank_Accounts,
    CASE WHEN Num_Credit_Card BETWEEN 0 AND 20 THEN Num_Credit_Card END AS Num_Credit_Card,
    CASE WHEN Interest_Rate BETWEEN 0 AND 50 THEN Interest_Rate END AS Interest_Rate,
    CASE WHEN Num_of_Loan BETWEEN 0 AND 10 THEN Num_of_Loan END AS Num_of_Loan,
    CASE WHEN Num_of_Delayed_Payment >= 0 THEN Num_of_Delayed_Payment END AS Num_of_Delayed_Payment,
    CASE WHEN Num_Credit_Inquiries BETWEEN 0 AND 20 THEN Num_Credit_Inquiries END AS Num_Credit_Inquiries,
    CASE WHEN Total_EMI_per_month <= 600 THEN Total_EMI_per_month END AS Total_EMI_per_month,
    CASE WHEN Amount_invested_monthly < 10000 THEN Amount_invested_monthly END AS Amount_invested_monthly,
    CASE WHEN Monthly_Balance > -10000 AND Monthly_Balance < 10000 THEN Monthly_Balance END AS Monthly_Balance)
  FROM typed
),
featured AS (
  SELECT * EXCLUDE (items),
    {", ".join(f"{_count_sql('items', t)} AS {name}" for t, name in S.LOAN_TYPE_COLUMNS.items())},
    Num_Bank_Accounts + Num_Credit_Card + Num_of_Loan AS num_fin_products,
    CAST(CAST(Total_EMI_per_month AS DOUBLE) / nullif(CAST(Monthly_Inhand_Salary AS DOUBLE), 0) AS FLOAT) AS emi_to_salary,
    CAST(CAST(Outstanding_Debt AS DOUBLE) / nullif(CAST(Monthly_Inhand_Salary AS DOUBLE), 0) AS FLOAT) AS debt_to_salary,
    Monthly_Inhand_Salary - Total_EMI_per_month AS repayment_ability,
    CAST(CAST(Num_of_Loan AS DOUBLE) / nullif(Num_Bank_Accounts + Num_Credit_Card + 1, 0) AS FLOAT) AS loans_per_credit_item,
    CAST(CAST(Outstanding_Debt AS DOUBLE) / nullif(CAST(Annual_Income AS DOUBLE), 0) AS FLOAT) AS debt_to_income,
    CAST(CASE WHEN Annual_Income > -1 THEN ln(1 + CAST(Annual_Income AS DOUBLE)) END AS FLOAT) AS log_annual_income,
    CAST(CAST(Amount_invested_monthly AS DOUBLE) / nullif(CAST(Monthly_Inhand_Salary AS DOUBLE), 0) AS FLOAT) AS investment_rate,
    CAST(CAST(Num_Credit_Inquiries AS DOUBLE) / nullif(Num_of_Loan + 1, 0) AS FLOAT) AS inq_per_loan,
    CAST(Changed_Credit_Limit <> 0 AS INTEGER) AS has_credit_limit_change
  FROM ruled
)
"""


@query("q_silver_financials", f"{_TYPED_FINANCIALS} SELECT * FROM featured")
def silver_financials(spark, d):
    return C.clean_financials(R.raw_financials(spark, d))


@query(
    "q_ratios",
    f"{_TYPED_FINANCIALS} SELECT Customer_ID, {', '.join(S.RATIO_FEATURES)} FROM featured",
)
def ratios(spark, d):
    return C.clean_financials(R.raw_financials(spark, d)).select("Customer_ID", *S.RATIO_FEATURES)


_SILVER_ATTRIBUTES = f"""
WITH {R.RAW_ATTRIBUTES},
attributes AS (
  SELECT Customer_ID,
         CASE WHEN TRY_CAST(rtrim(Age, '_') AS INTEGER) BETWEEN 18 AND 100
              THEN TRY_CAST(rtrim(Age, '_') AS INTEGER) END AS Age,
         nullif(Occupation, '_______') AS Occupation, snapshot_date
  FROM raw_attributes
)
"""


@query("q_silver_attributes", f"{_SILVER_ATTRIBUTES} SELECT * FROM attributes")
def silver_attributes(spark, d):
    return C.clean_attributes(R.raw_attributes(spark, d))


@query(
    "q_pii_drop",
    f"WITH {R.RAW_ATTRIBUTES} SELECT Customer_ID, Age, Occupation, snapshot_date FROM raw_attributes",
)
def pii_drop(spark, d):
    return C.drop_pii(R.raw_attributes(spark, d))


@query(
    "q_silver_clickstream",
    """
    SELECT CAST(user_id AS VARCHAR) AS Customer_ID,
           CAST(trunc(value) AS INTEGER) AS fe_1,
           TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS fe_2,
           CAST(ts AS DATE) AS snapshot_date
    FROM events
    """,
)
def silver_clickstream(spark, d):
    raw = table(spark, d, "events").select(
        F.col("user_id").alias("Customer_ID"),
        F.col("value").cast("string").alias("fe_1"),
        F.regexp_extract("props", r"(\d+)", 1).alias("fe_2"),
        F.col("ts").alias("snapshot_date"),
    )
    types = {c: S.CLICK_TYPES_OF_COLUMNS[c] for c in raw.columns}
    return C.enforce_schema(raw, types)


@query(
    "q_gold_encoding",
    f"""
    {_SILVER_ATTRIBUTES}
    SELECT Customer_ID, Age,
           CASE Occupation WHEN 'Mechanic' THEN 9 WHEN 'Engineer' THEN 4 END AS Occupation, snapshot_date
    FROM attributes
    """,
)
def gold_encoding(spark, d):
    return encode_categories(C.clean_attributes(R.raw_attributes(spark, d)))


@query(
    "q_fill_zero",
    """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END, 0) AS price,
           coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, 0) AS customer,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status
    FROM orders
    """,
)
def fill_zero(spark, d):
    k = F.col("o_orderkey")
    return C.fill_zero(
        table(spark, d, "orders").select(
            "o_orderkey",
            F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"),
            F.when(k % 3 != 0, F.col("o_custkey")).alias("customer"),
            F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"),
        )
    )


@query(
    "q_median_fill",
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders)
    SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM o)) AS price FROM o
    """,
)
def median_fill(spark, d):
    holes = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price")
    )
    return M.impute_median(holes, ["price"])


@query(
    "q_missing_flag",
    """
    SELECT c_custkey, CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS has_events
    FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON c_custkey = user_id
    """,
)
def missing_flag(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    return flag_source(joined, "n", "has_events")


@query(
    "q_fixed_bins",
    """
    SELECT c_custkey,
           CASE WHEN c_acctbal > 0 AND c_acctbal <= 2000 THEN 0 WHEN c_acctbal > 2000 AND c_acctbal <= 4000 THEN 1
                WHEN c_acctbal > 4000 AND c_acctbal <= 6000 THEN 2 WHEN c_acctbal > 6000 AND c_acctbal <= 8000 THEN 3
           END AS balance_bin,
           CASE WHEN c_nationkey > 0 AND c_nationkey <= 9 THEN '1-9' WHEN c_nationkey > 9 AND c_nationkey <= 24 THEN '10-24'
           END AS nation_bin
    FROM customer
    """,
)
def fixed_bins(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        N.fixed_bin(F.col("c_acctbal"), [0, 2000, 4000, 6000, 8000]).alias("balance_bin"),
        N.fixed_bin(F.col("c_nationkey"), [0, 9, 24], ["1-9", "10-24"]).alias("nation_bin"),
    )


@query(
    "q_quantile_bins",
    """
    WITH q AS (SELECT quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1]) AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity,
           CASE WHEN l_quantity >= e[1] AND l_quantity <= e[2] THEN 0 WHEN l_quantity > e[2] AND l_quantity <= e[3] THEN 1
                WHEN l_quantity > e[3] AND l_quantity <= e[4] THEN 2 WHEN l_quantity > e[4] AND l_quantity <= e[5] THEN 3
           END AS quartile
    FROM lineitem, q
    """,
)
def quantile_bins(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    edges = O.quantile_table(lines, ["l_quantity"], [0.0, 0.25, 0.5, 0.75, 1.0])["l_quantity"]
    return lines.withColumn("quartile", N.quantile_bin(F.col("l_quantity"), edges))


@query(
    "q_clip",
    "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_tax, 0.03) AS tax, greatest(l_discount, 0.05) AS discount FROM lineitem",
)
def clip(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.clip_low(F.col("l_tax"), 0.03).alias("tax"),
        N.clip_low(F.col("l_discount"), 0.05).alias("discount"),
    )


@query(
    "q_column_roles",
    f"WITH {R.CLICKS_SQL} SELECT {', '.join(R.CLICKS)} FROM clicks",
)
def column_roles(spark, d):
    df = R.clicks(spark, d)
    return df.select(*M.feature_columns(df, prefix="fe_"))


@query(
    "q_tag_rename",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS Customer_ID, c_acctbal AS model_predictions,
           'balance_model' AS model_name, DATE '2024-06-01' AS snapshot_date,
           CASE WHEN c_acctbal > 0 THEN 'Has balance' ELSE 'No balance' END AS state
    FROM customer
    """,
)
def tag_rename(spark, d):
    tagged = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("Customer_ID"), "c_acctbal",
        (F.col("c_acctbal") > 0).cast("int").alias("state"),
    )
    return tagged.withColumnRenamed("c_acctbal", "model_predictions").withColumns(
        {
            "model_name": F.lit("balance_model"),
            "snapshot_date": F.lit("2024-06-01").cast("date"),
            "state": E.relabel(F.col("state"), {0: "No balance", 1: "Has balance"}),
        }
    )


@query(
    "q_scalar_text",
    r"""
    SELECT doc_id,
           regexp_replace(text, '_+$', '') AS right_stripped,
           regexp_replace(lang, '^[a-z]', 'x', 'g') AS replaced,
           regexp_extract(source, '([a-z]+)(\d+)', 2) AS src_number,
           regexp_matches(source, '^src[0-3]$') AS anchored,
           regexp_split_to_array(concat(lang, ', ', source), ',\s*')[2] AS second,
           trim(concat('  ', lang, ' ')) AS trimmed,
           contains(text, 'the') AS has_the,
           starts_with(source, 'src1') AS starts,
           rtrim(concat(lang, '__'), '_') AS rtrimmed,
           CASE WHEN lang = 'en' THEN 'english' ELSE coalesce(nullif(lang, 'fr'), 'none') END AS chosen
    FROM documents
    """,
)
def scalar_text(spark, d):
    c = F.col
    return table(spark, d, "documents").select(
        "doc_id",
        F.regexp_replace("text", r"_+$", "").alias("right_stripped"),
        F.regexp_replace("lang", "^[a-z]", "x").alias("replaced"),
        F.regexp_extract("source", r"([a-z]+)(\d+)", 2).alias("src_number"),
        c("source").rlike("^src[0-3]$").alias("anchored"),
        F.split(F.concat("lang", F.lit(", "), "source"), r",\s*")[1].alias("second"),
        F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("trimmed"),
        c("text").contains("the").alias("has_the"),
        c("source").startswith("src1").alias("starts"),
        F.rtrim(F.concat("lang", F.lit("__")), F.lit("_")).alias("rtrimmed"),
        F.when(c("lang") == "en", "english")
        .otherwise(F.coalesce(F.nullif("lang", F.lit("fr")), F.lit("none")))
        .alias("chosen"),
    )


@query(
    "q_scalar_collections",
    r"""
    SELECT o_orderkey,
           CAST(len(list_filter(regexp_split_to_array(o_orderpriority, '[- ]'), lambda x: length(x) > 2)) AS INTEGER) AS long_words,
           CAST(len(regexp_split_to_array(o_orderpriority, '[- ]')) AS INTEGER) AS words,
           CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status_code
    FROM orders
    """,
)
def scalar_collections(spark, d):
    words = F.split("o_orderpriority", "[- ]")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.size(F.filter(words, lambda x: F.length(x) > 2)).alias("long_words"),
        F.size(words).alias("words"),
        E.encode_map(F.col("o_orderstatus"), {"F": 1, "O": 2}).alias("status_code"),
    )


@query(
    "q_scalar_math",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(ceil(l_quantity / nullif(l_tax, 0)) AS BIGINT) AS ceiled,
           round(ln(1 + l_quantity), 9) AS log1p_quantity,
           abs(l_discount - 0.05) AS abs_gap,
           sqrt(l_quantity) AS root,
           round(ln(l_quantity), 9) AS log_quantity,
           round(l_quantity / 7, 4) AS rounded,
           CAST(l_tax <> 0 AS INTEGER) AS has_tax,
           TRY_CAST(concat(CAST(l_linenumber AS VARCHAR), CASE WHEN l_linenumber = 3 THEN 'x' ELSE '' END) AS INTEGER) AS tried
    FROM lineitem
    """,
)
def scalar_math(spark, d):
    c = F.col
    text = F.concat(c("l_linenumber").cast("string"), F.when(c("l_linenumber") == 3, "x").otherwise(""))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.ceil(N.ratio(c("l_quantity"), c("l_tax"))).alias("ceiled"),
        F.round(F.log1p("l_quantity"), 9).alias("log1p_quantity"),
        F.abs(c("l_discount") - 0.05).alias("abs_gap"),
        F.sqrt("l_quantity").alias("root"),
        F.round(F.log("l_quantity"), 9).alias("log_quantity"),
        N.half_up(c("l_quantity") / 7, 4).alias("rounded"),
        (c("l_tax") != 0).cast("int").alias("has_tax"),
        text.try_cast("int").alias("tried"),
    )


@query(
    "q_scalar_dates",
    """
    SELECT o_orderkey,
           TRY_CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS parsed,
           CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_orderkey % 13 AS INTEGER)) AS DATE) AS earlier,
           CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 DAY AS DATE) AS day_before,
           CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
           CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month_start,
           strftime(o_orderdate, '%Y-%m') AS month_text,
           CAST(o_orderdate AS DATE) AS named
    FROM orders
    """,
)
def scalar_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    name = F.concat(F.lit("silver_loan_"), F.date_format(day, "yyyy_MM_dd"), F.lit(".parquet"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.try_to_date(F.date_format(day, "yyyy-MM-dd"), "yyyy-MM-dd").alias("parsed"),
        D.months_before(day, F.col("o_orderkey") % 13).alias("earlier"),
        F.date_sub(day, 1).alias("day_before"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        D.month_start(day).alias("month_start"),
        D.month_text(day).alias("month_text"),
        D.date_in_name(name).alias("named"),
    )
