"""Feature tables built from the given tables, and the same tables as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.frame import Features, from_columns
from pipegrid.operators.split import holdout_fraction
from pipegrid.plans.space import CLASSIFIERS, SCALERS
from pipegrid.plans.space import FEATURE_PREPROCESSORS as STEPS
from workload.registry import keep

SEED = 123

ORDER_COLUMNS = ["n_lines", "sum_qty", "avg_discount", "avg_tax", "max_price", "total_price"]
DOC_COLUMNS = ["n_chars", "n_words", "mean_word", "letter_share", "digit_share", "distinct_share"]
EMB_COLUMNS = [f"f_{j}" for j in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_ROWS = 200_000  # rows of a task whose rows grow hundredfold


def spread(scan: DataFrame) -> DataFrame:
    """A scan of a small file uses one core; give costly row-wise work all of them, and no task too many rows.

    Inputs that have more partitions than that stay as they are.
    """
    needed = tasks_for(scan)
    return scan.repartition(needed) if scan.rdd.getNumPartitions() < needed else scan


def tasks_for(scan: DataFrame) -> int:
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // SPREAD_ROWS))


# ---------------------------------------------------------------- order features


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with aggregated lines; orders without lines have NULL features."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_discount"),
            F.round(F.avg("l_tax"), 6).alias("avg_tax"),
            F.max("l_extendedprice").alias("max_price"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"),
        *ORDER_COLUMNS[:5],
        F.col("o_totalprice").alias("total_price"),
    )


ORDERS_CTE = """
lines as (
  select l_orderkey, cast(count(*) as double) as n_lines, sum(l_quantity) as sum_qty, round(avg(l_discount), 6) as avg_discount,
         round(avg(l_tax), 6) as avg_tax, max(l_extendedprice) as max_price
  from lineitem group by l_orderkey),
raw as (
  select o_orderkey as row_id, cast(o_orderpriority in ('1-URGENT', '2-HIGH') as integer) as label,
         n_lines, sum_qty, avg_discount, avg_tax, max_price, o_totalprice as total_price
  from orders left join lines on o_orderkey = l_orderkey)"""


def bits_sql(salt: str, key: str) -> str:
    return f"cast('0x' || substr(md5('{salt}' || {key}), 1, 8) as ubigint)"


def uniform_sql(salt: str, key: str) -> str:
    return f"(cast({bits_sql(salt, key)} as double) / 4294967296.0::double)"


def normal_sql(salt: str, key: str) -> str:
    u1, u2 = uniform_sql(salt + "a:", key), uniform_sql(salt + "b:", key)
    return f"(sqrt(-2.0::double * ln(1.0::double - {u1})) * cos(2.0::double * pi() * {u2}))"


def split_sql(source: str, seed: int = SEED, key: str = "row_id", size: str | None = None) -> str:
    size = size or "ceil(cast(0.33 as double) * count(*) over ())"
    return (
        f"select *, case when row_number() over (order by {bits_sql(f'split:{seed}:', key)}, {key}) <= {size} "
        f"then 'test' else 'train' end as split from {source}"
    )


# `data`: raw order features with the split; `filled`: after mean imputation
ORDERS_SPLIT_CTE = ORDERS_CTE + f",\ndata as ({split_sql('raw')})"
ORDERS_FILLED_CTE = (
    ORDERS_SPLIT_CTE
    + ",\nmeans as (select "
    + ", ".join(f"avg({c}) as {c}" for c in ORDER_COLUMNS)
    + " from data where split = 'train'),\nfilled as (select d.row_id, d.label, d.split, "
    + ", ".join(f"coalesce(d.{c}, m.{c}) as {c}" for c in ORDER_COLUMNS)
    + " from data d cross join means m)"
)


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the order features, enough to find a holdout's cut."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))


def split_orders(spark: SparkSession, sf_dir: str) -> Features:
    rows = holdout_fraction(order_features(spark, sf_dir), 0.33, SEED, keys=order_keys(spark, sf_dir))
    return from_columns(keep(rows), ORDER_COLUMNS)


def filled_orders(spark: SparkSession, sf_dir: str) -> Features:
    from pipegrid.operators.impute import fit_mean_imputer

    raw = split_orders(spark, sf_dir)
    return fit_mean_imputer(raw.train()).apply(raw)


# ---------------------------------------------------------------- document features


def document_features(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.col(target).cast("int").alias("label")
    )
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")
    chars = F.greatest(F.length("text"), F.lit(1))
    n_words = F.greatest(F.size("words"), F.lit(1))
    measured = (
        spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
        .withColumn("words", words)
        .select(
            F.col("doc_id").alias("row_id"),
            F.col("n_chars").cast("double").alias("n_chars"),
            F.size("words").cast("double").alias("n_words"),
            (F.length(F.concat_ws("", "words")) / n_words).alias("mean_word"),
            (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / chars).alias("letter_share"),
            (F.length(F.regexp_replace("text", "[^0-9]", "")) / chars).alias("digit_share"),
            (F.size(F.array_distinct("words")) / n_words).alias("distinct_share"),
        )
    )
    # the texts shrink to six numbers before the join, so no text is shuffled
    return measured.join(labels, "row_id").select("row_id", "label", *DOC_COLUMNS)


DOCS_CTE = f"""
docs as (
  select d.doc_id, cast(l.quality as integer) as label, d.n_chars, d.text,
         list_filter(regexp_split_to_array(d.text, '[ \\t\\n\\r]+'), lambda w: w <> '') as words
  from documents d join labels l on d.doc_id = l.doc_id),
raw as (
  select doc_id as row_id, label, cast(n_chars as double) as n_chars, cast(len(words) as double) as n_words,
         length(array_to_string(words, '')) / greatest(len(words), 1)::double as mean_word,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1)::double as letter_share,
         length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::double as digit_share,
         len(list_distinct(words)) / greatest(len(words), 1)::double as distinct_share
  from docs),
data as ({split_sql('raw')})"""


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the document features, without their texts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id")).join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")), "row_id"
    )


def split_documents(spark: SparkSession, sf_dir: str) -> Features:
    rows = holdout_fraction(document_features(spark, sf_dir), 0.33, SEED, keys=document_keys(spark, sf_dir))
    return from_columns(keep(rows), DOC_COLUMNS)


# ---------------------------------------------------------------- embeddings


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") >= 5).cast("int").alias("label"),
        *[F.col("embedding")[j].cast("double").alias(f"f_{j}") for j in range(64)],
    )


EMB_CTE = (
    "raw as (select vec_id as row_id, cast(label >= 5 as integer) as label, "
    + ", ".join(f"cast(embedding[{j + 1}] as double) as f_{j}" for j in range(64))
    + f" from embeddings),\ndata as ({split_sql('raw')})"
)


def split_embeddings(spark: SparkSession, sf_dir: str) -> Features:
    rows = holdout_fraction(embedding_features(spark, sf_dir), 0.33, SEED)
    return from_columns(keep(rows), EMB_COLUMNS)


# ---------------------------------------------------------------- run log


def _pick(names: list[str], key, none_first: bool):
    """names[key % n], with slot 0 meaning none when ``none_first``."""
    slots = [None, *names] if none_first else names
    values = F.array(*[F.lit(n).cast("string") for n in slots])
    return F.element_at(values, (F.pmod(key, F.lit(len(slots))) + 1).cast("int"))


def _pick_sql(names: list[str], key: str, none_first: bool) -> str:
    slots = ["null", *[f"'{n}'" for n in names]] if none_first else [f"'{n}'" for n in names]
    return f"([{', '.join(slots)}])[{key} % {len(slots)} + 1]"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per event."""
    k = F.get_json_object("props", "$.k").cast("double")
    success = F.col("status") == "success"
    events = table(spark, sf_dir, "events").withColumn(
        "status",
        F.when(F.col("event_type").isin("purchase", "click", "view"), "success")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("timeout"),
    )
    key = F.col("event_id")
    return events.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("ds_"), F.pmod("user_id", F.lit(15)).cast("string")).alias("dataset"),
        F.lit("SKLSimpleImpute").alias("imputer"),
        _pick(SCALERS, key, True).alias("scaler"),
        _pick(STEPS, key, True).alias("feature_preprocessor"),
        _pick(CLASSIFIERS, key, False).alias("classifier"),
        "status",
        F.when(success, (k + 100.0) / 200.0).alias("train_accuracy"),
        F.when(success, k / 100.0).alias("valid_accuracy"),
        F.when(success, (k + 50.0) / 150.0).alias("train_balanced_accuracy"),
        F.when(success, k / 125.0).alias("valid_balanced_accuracy"),
        F.col("value").alias("seconds"),
        F.col("ts").alias("started_at"),
    )


RUNS_CTE = f"""
ev as (
  select *, cast(json_extract(props, '$.k') as double) as k,
         case when event_type in ('purchase', 'click', 'view') then 'success'
              when event_type = 'error' then 'failed' else 'timeout' end as status
  from events),
runs as (
  select event_id as run_id, 'ds_' || cast(user_id % 15 as varchar) as dataset, 'SKLSimpleImpute' as imputer,
         {_pick_sql(SCALERS, 'event_id', True)} as scaler,
         {_pick_sql(STEPS, 'event_id', True)} as feature_preprocessor,
         {_pick_sql(CLASSIFIERS, 'event_id', False)} as classifier, status,
         case when status = 'success' then (k + 100.0::double) / 200.0::double end as train_accuracy,
         case when status = 'success' then k / 100.0::double end as valid_accuracy,
         case when status = 'success' then (k + 50.0::double) / 150.0::double end as train_balanced_accuracy,
         case when status = 'success' then k / 125.0::double end as valid_balanced_accuracy,
         value as seconds, ts as started_at
  from ev)"""


def case_sql(column: str, names: dict[str, str]) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in names.items())
    return f"case {column} {arms} end"


def add_all(parts):
    return reduce(lambda a, b: a + b, parts)
