"""Labels, dictionaries, unions, samples, ids and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.catalog.shape import r, registry, table
from wattloom.functions.order_keys import order_key
from wattloom.operators import encode as enc
from wattloom.operators import folds as cv
from wattloom.operators.ensemble import one_hot
from wattloom.operators.metadata import aligned_union, diagonal_union, of_ids, of_sampled, renumbered, with_suffix
from wattloom.operators.ranking import dense_ids, first_ids, first_k, random_ids
from wattloom.operators.statistics import columns_containing, distinct_count, feature_columns
from wattloom.plans.jobs import folds_of_targets, read_gold, write_gold
from wattloom.session import scratch_path
from wattloom.sources import write
from wattloom.sources.tables import table_profile, typed_labels

QUERIES, SQL, query = registry()

TARGETS = ["building_stock_type", "in_vintage_com", "in_heating_fuel_com", "in_bedrooms_res", "in_tenure_res"]


def customer_labels(spark, folder):
    """Customers as labelled buildings: two market segments are commercial, some targets are missing."""
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 0).otherwise(1)
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("bldg_id"),
        kind.alias("building_stock_type"),
        F.when((kind == 0) & (F.col("c_acctbal") >= 0), F.col("c_nationkey") % 8).alias("in_vintage_com"),
        F.when(kind == 0, key % 5).cast("int").alias("in_heating_fuel_com"),
        F.when(kind == 1, F.floor(key / 7) % 5).cast("int").alias("in_bedrooms_res"),
        F.when((kind == 1) & (F.col("c_acctbal") >= 0), (F.col("c_acctbal") > 5000).cast("int")).alias("in_tenure_res"),
    )


CUSTOMER_LABELS = """
kinds AS (SELECT *, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END AS kind FROM customer),
labelled AS (
  SELECT c_custkey AS bldg_id, kind AS building_stock_type,
         CASE WHEN kind = 0 AND c_acctbal >= 0 THEN c_nationkey % 8 END AS in_vintage_com,
         CASE WHEN kind = 0 THEN c_custkey % 5 END AS in_heating_fuel_com,
         CASE WHEN kind = 1 THEN CAST(floor(c_custkey / 7) AS BIGINT) % 5 END AS in_bedrooms_res,
         CASE WHEN kind = 1 AND c_acctbal >= 0 THEN CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END END AS in_tenure_res
  FROM kinds
),
long_labels AS (
"""
CUSTOMER_LABELS += "  UNION ALL\n".join(
    f"  SELECT bldg_id, '{target}' AS target, CAST({target} AS BIGINT) AS code FROM labelled"
    + ("" if target == "building_stock_type" else f" WHERE {target} IS NOT NULL AND building_stock_type {'=' if target.endswith('com') else '<>'} 0")
    + "\n"
    for target in TARGETS
)
CUSTOMER_LABELS += ")"


@query("target_population", f"WITH {CUSTOMER_LABELS} SELECT bldg_id, target, code FROM long_labels")
def target_population(spark, folder):
    """Every (building, target) in the population of the target."""
    return cv.long_labels(customer_labels(spark, folder), TARGETS)


# --- folds: the order key is the same MD5 text in both engines


def dealt(source: str, partition: str, stratum: str, identity: str = "bldg_id", seed: str = "0") -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    return f"CAST((row_number() OVER ({over}ORDER BY {stratum}md5('{seed}:' || {identity})) - 1) % 5 AS BIGINT)"


@query(
    "stratified_folds",
    f"SELECT c_custkey AS bldg_id, c_mktsegment, {dealt('customer', '', 'c_mktsegment, ', 'c_custkey')} AS fold FROM customer",
)
def stratified_folds(spark, folder):
    """Folds balanced per market segment and overall."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id"), "c_mktsegment")
    return cv.stratified_folds(rows, "c_mktsegment")


@query("random_folds", f"SELECT c_custkey AS bldg_id, {dealt('customer', '', '', 'c_custkey')} AS fold FROM customer")
def random_folds(spark, folder):
    return cv.random_folds(table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id")))


@query(
    "labelset_folds",
    """
WITH tagged AS (
  SELECT c_custkey AS bldg_id, c_mktsegment, c_nationkey,
         'c_mktsegment=' || c_mktsegment || '|c_nationkey=' || c_nationkey AS label_set FROM customer
),
sizes AS (SELECT label_set, c_mktsegment, c_nationkey, count(*) AS n FROM tagged GROUP BY ALL),
members AS (
  SELECT label_set, n, 'c_mktsegment=' || c_mktsegment AS label FROM sizes
  UNION ALL SELECT label_set, n, 'c_nationkey=' || c_nationkey FROM sizes
),
frequency AS (SELECT label, sum(n) AS label_n FROM members GROUP BY label),
rarest AS (
  SELECT label_set, label, row_number() OVER (PARTITION BY label_set ORDER BY label_n, label) AS place
  FROM members JOIN frequency USING (label) WHERE n < 5
),
strata AS (
  SELECT t.*, coalesce('pool:' || r.label, t.label_set) AS stratum
  FROM tagged t LEFT JOIN rarest r ON t.label_set = r.label_set AND r.place = 1
)
SELECT bldg_id, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || bldg_id)) - 1
        + CAST('0x' || substr(md5(stratum), 1, 4) AS INTEGER)) % 5 AS BIGINT) AS fold
FROM strata""",
)
def labelset_folds(spark, folder):
    """Folds balanced per combination of labels, rare combinations pooled."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id"), "c_mktsegment", "c_nationkey")
    return cv.label_set_folds(rows, ["c_mktsegment", "c_nationkey"])


FOLD_TEXT = "concat_ws(', ', " + ", ".join(f"CASE WHEN fold = {s} THEN 'v' ELSE 't' END" for s in range(5)) + ")"
FOLDS_OF_TARGETS = f"""
WITH {CUSTOMER_LABELS},
dealt AS (SELECT *, {dealt('long_labels', 'target', 'code, ')} AS fold FROM long_labels),
folds AS (SELECT *, {FOLD_TEXT} AS fold_info FROM dealt)"""


@query("fold_info", f"{FOLDS_OF_TARGETS} SELECT bldg_id, target, code, fold, fold_info FROM folds")
def fold_info(spark, folder):
    """Folds of all targets in one plan, with the split text."""
    return folds_of_targets(customer_labels(spark, folder), TARGETS)


@query(
    "fold_split",
    f"""{FOLDS_OF_TARGETS}
SELECT bldg_id, target, code, CAST(split AS BIGINT) AS split, split_part(fold_info, ', ', CAST(split + 1 AS INTEGER)) AS current_fold
FROM folds, range(5) splits(split) WHERE split_part(fold_info, ', ', CAST(split + 1 AS INTEGER)) = 'v'""",
)
def fold_split(spark, folder):
    """Validation rows of every split of all targets."""
    rows = folds_of_targets(customer_labels(spark, folder), TARGETS)
    splits = [cv.fold_split(rows, split)[1].withColumn("split", F.lit(split)) for split in range(5)]
    return diagonal_union(*splits).select("bldg_id", "target", "code", "split", "current_fold")


@query(
    "leakage_check",
    """SELECT 'train' AS side, CAST(count(DISTINCT c_custkey) AS BIGINT) AS shared FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
         AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def leakage_check(spark, folder):
    """Customers on both sides of a split of the orders."""
    orders = table(spark, folder, "orders").withColumn("bldg_id", F.col("o_custkey"))
    shared = cv.leakage(orders.filter(F.col("o_orderstatus") == "F"), orders.filter(F.col("o_orderstatus") == "O"))
    return shared.agg(F.count(F.lit(1)).alias("shared")).withColumn("side", F.lit("train"))


# --- joins


ORDER_FEATURES = f"SELECT o_custkey AS bldg_id, {r('sum(o_totalprice)', 3)} AS total, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1"


def order_features(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("bldg_id")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("orders")
    )


@query(
    "label_feature_join",
    f"WITH {CUSTOMER_LABELS} SELECT bldg_id, target, code, total, orders FROM long_labels JOIN ({ORDER_FEATURES}) USING (bldg_id)",
    digits=3,
)
def label_feature_join(spark, folder):
    """Labels joined with one feature row per building."""
    labels = cv.long_labels(customer_labels(spark, folder), TARGETS)
    return labels.join(order_features(spark, folder), "bldg_id", "inner")


@query(
    "gold_write_read",
    f"""{FOLDS_OF_TARGETS}
SELECT bldg_id, target, code, fold_info, total, orders FROM folds JOIN ({ORDER_FEATURES}) USING (bldg_id)""",
    digits=3,
)
def gold_write_read(spark, folder):
    """Features and folds written as the gold layer, every target read back."""
    path = scratch_path(spark, "gold")
    write_gold(order_features(spark, folder), folds_of_targets(customer_labels(spark, folder), TARGETS), path, TARGETS)
    rows = [read_gold(spark, path, name).withColumnRenamed(name, "code").withColumn("target", F.lit(name)) for name in TARGETS]
    return diagonal_union(*rows)


@query("typed_labels", f"WITH {CUSTOMER_LABELS} SELECT bldg_id, {', '.join(f'CAST(coalesce({t}, -1) AS BIGINT) AS {t}' for t in TARGETS)} FROM labelled")
def typed_labels_(spark, folder):
    """Label codes read from text, as integers (none is shown as -1)."""
    labels = customer_labels(spark, folder)
    typed = typed_labels(labels.select("bldg_id", *[F.col(target).cast("string").alias(target) for target in TARGETS]), TARGETS)
    return typed.na.fill(-1)


@query("submission_write", f"WITH {CUSTOMER_LABELS} SELECT bldg_id, CAST(coalesce(in_bedrooms_res, -1) AS BIGINT) AS in_bedrooms_res, CAST(coalesce(in_vintage_com, -1) AS BIGINT) AS in_vintage_com FROM labelled")
def submission_write(spark, folder):
    """The sorted submission, written and read back (none is shown as -1)."""
    path = scratch_path(spark, "submission")
    write.submission(customer_labels(spark, folder).select("bldg_id", "in_bedrooms_res", "in_vintage_com"), path)
    return spark.read.parquet(path).na.fill(-1)


@query(
    "table_profile",
    """
SELECT 'nation' AS table_name, 'n_nationkey,n_name,n_regionkey' AS "columns", CAST(3 AS BIGINT) AS n_columns, count(*) AS n_rows FROM nation
UNION ALL SELECT 'orders', 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', 6, count(*) FROM orders""",
)
def table_profile_(spark, folder):
    """Names and number of columns and number of rows of two tables."""
    return diagonal_union(*[table_profile(table(spark, folder, name), name) for name in ("nation", "orders")])


@query("semi_join_ids", "SELECT o_orderkey, o_custkey AS bldg_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_join_ids(spark, folder):
    """Orders of a set of customers of any size."""
    ids = table(spark, folder, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("bldg_id"))
    return of_ids(table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("bldg_id")), ids)


# --- metadata of two kinds


def metadata(spark, folder):
    """Customers as residential and suppliers as commercial metadata."""
    residential = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("bldg_id"), F.col("c_name").alias("in_name"), F.col("c_mktsegment").alias("in_segment")
    )
    commercial = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("bldg_id"), F.col("s_name").alias("in_name"), F.col("s_nationkey").cast("string").alias("in_nation")
    )
    return with_suffix(residential, "res", "residential"), with_suffix(commercial, "com", "commercial")


METADATA = """
metadata AS (
  SELECT c_custkey AS bldg_id, c_name AS in_name_res, c_mktsegment AS in_segment_res, 'residential' AS build_type,
         NULL AS in_name_com, NULL AS in_nation_com FROM customer
  UNION ALL
  SELECT s_suppkey, NULL, NULL, 'commercial', s_name, CAST(s_nationkey AS VARCHAR) FROM supplier
)"""


@query("diagonal_union", f"WITH {METADATA} SELECT * FROM metadata")
def diagonal_union_(spark, folder):
    """Two schemas united by name."""
    return diagonal_union(*metadata(spark, folder))


@query(
    "aligned_union",
    "SELECT c_custkey AS bldg_id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def aligned_union_(spark, folder):
    """Additional rows cut to the columns of the first table."""
    first = table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id"), F.col("c_name").alias("name"))
    more = table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), "s_acctbal", F.col("s_suppkey").alias("bldg_id")
    )
    return aligned_union(first, more)


@query(
    "metadata_join",
    f"""WITH {METADATA},
sampled AS (SELECT DISTINCT o_custkey AS bldg_id, 'residential' AS build_type FROM orders WHERE o_orderstatus = 'P'
            UNION SELECT l_suppkey, 'commercial' FROM lineitem WHERE l_quantity > 49)
SELECT m.* FROM metadata m JOIN sampled USING (bldg_id, build_type)""",
)
def metadata_join(spark, folder):
    """Metadata of the sampled buildings; repeated ids in the sample do not multiply rows."""
    residential = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("bldg_id"), F.lit("residential").alias("build_type")
    )
    commercial = table(spark, folder, "lineitem").filter(F.col("l_quantity") > 49).select(
        F.col("l_suppkey").alias("bldg_id"), F.lit("commercial").alias("build_type")
    )
    return of_sampled(diagonal_union(*metadata(spark, folder)), residential.unionByName(commercial))


NUMBERED = f"""WITH {METADATA},
keys AS (SELECT DISTINCT build_type, bldg_id FROM metadata),
numbered AS (SELECT *, CAST(29999 + row_number() OVER (ORDER BY build_type || bldg_id, build_type, bldg_id) AS BIGINT) AS new_id FROM keys)"""


@query("dense_ids", f"{NUMBERED} SELECT build_type, bldg_id, new_id FROM numbered")
def dense_ids_(spark, folder):
    """Consecutive ids in the order of the concatenated key."""
    return dense_ids(diagonal_union(*metadata(spark, folder)), ["build_type", "bldg_id"])


@query(
    "renumbered_metadata",
    f"""{NUMBERED} SELECT new_id AS bldg_id, build_type, in_name_res, in_segment_res, in_name_com, in_nation_com
FROM metadata JOIN numbered USING (build_type, bldg_id)""",
)
def renumbered_metadata(spark, folder):
    return renumbered(diagonal_union(*metadata(spark, folder)))[0]


@query(
    "sample_per_group",
    """SELECT state, bldg_id FROM (
  SELECT state, bldg_id, row_number() OVER (PARTITION BY state ORDER BY bldg_id) AS place
  FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS state, o_custkey AS bldg_id FROM orders JOIN customer ON o_custkey = c_custkey)
) WHERE place <= 20""",
)
def sample_per_group(spark, folder):
    """The first 20 building ids per state."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return first_ids(orders.select(F.col("c_nationkey").alias("state"), F.col("o_custkey").alias("bldg_id")), ["state"], 20)


@query(
    "random_per_group",
    """SELECT state, bldg_id FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS state, c_custkey AS bldg_id,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey) AS place
  FROM customer
) WHERE place <= 15""",
)
def random_per_group(spark, folder):
    """15 pseudo-random buildings per state, the same in every run."""
    ids = table(spark, folder, "customer").select(F.col("c_nationkey").alias("state"), F.col("c_custkey").alias("bldg_id"))
    return random_ids(ids, ["state"], 15, seed=7)


@query(
    "largest_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders
) WHERE place <= 2""",
    digits=3,
)
def largest_per_group(spark, folder):
    """First k rows of every group."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return first_k(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2, "o_orderkey")


SQL["largest_per_group"] = SQL["largest_per_group"].replace(
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (", f"SELECT o_custkey, o_orderkey, {r('o_totalprice', 3)} AS o_totalprice FROM (", 1
)


# --- dictionaries

DICTIONARY = """
dictionary AS (
  SELECT 'p_brand' AS "column", p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 25 AND p_type <> 'SMALL')
  UNION ALL
  SELECT 'p_type', p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 25 AND p_type <> 'SMALL')
)"""


def part_dictionary(spark, folder):
    """Fitted on some parts only, so that others have values the dictionary does not know."""
    fitted = table(spark, folder, "part").filter((F.col("p_size") < 25) & (F.col("p_type") != "SMALL"))
    return enc.fit_codes(fitted, ["p_brand", "p_type"])


@query("category_dictionary", f"WITH {DICTIONARY} SELECT \"column\", value, code FROM dictionary".replace(" WHERE p_size < 25 AND p_type <> 'SMALL'", ""))
def category_dictionary(spark, folder):
    """Sorted distinct values of several columns of the whole table, numbered per column."""
    return enc.fit_codes(table(spark, folder, "part"), ["p_brand", "p_type"])


ENCODED = f"""WITH {DICTIONARY}
SELECT p_partkey AS bldg_id, coalesce(b.code, -1) AS p_brand, coalesce(t.code, -1) AS p_type
FROM part LEFT JOIN dictionary b ON b."column" = 'p_brand' AND b.value = p_brand
          LEFT JOIN dictionary t ON t."column" = 'p_type' AND t.value = p_type"""


def part_values(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("bldg_id"), "p_brand", "p_type")


def visible_unknown(df):
    return df.withColumns({name: F.coalesce(F.col(name).cast("long"), F.lit(-1)) for name in ("p_brand", "p_type")})


@query("category_encode", ENCODED)
def category_encode(spark, folder):
    """Codes from literal maps; unknown values have none (shown as -1)."""
    return visible_unknown(enc.encode(part_values(spark, folder), enc.as_maps(part_dictionary(spark, folder))))


@query("category_encode_join", ENCODED)
def category_encode_join(spark, folder):
    """The same by joins, for dictionaries of any size."""
    return visible_unknown(enc.encode_by_join(part_values(spark, folder), part_dictionary(spark, folder), ["p_brand", "p_type"]))


@query(
    "category_decode",
    "SELECT p_partkey AS bldg_id, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size < 25 AND p_type <> 'SMALL') THEN p_brand END AS p_brand, CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size < 25 AND p_type <> 'SMALL') THEN p_type END AS p_type FROM part",
)
def category_decode(spark, folder):
    """Encode and decode: known values come back."""
    maps = enc.as_maps(part_dictionary(spark, folder))
    return enc.decode(enc.encode(part_values(spark, folder), maps), maps)


@query(
    "category_decode_long",
    f"""WITH {DICTIONARY},
predicted AS (SELECT p_partkey AS bldg_id, 'p_brand' AS target, p_partkey % 30 AS code FROM part)
SELECT p.bldg_id, p.target, p.code, d.value FROM predicted p LEFT JOIN dictionary d ON d."column" = p.target AND d.code = p.code""",
)
def category_decode_long(spark, folder):
    """Predicted codes in long form joined to the inverse dictionary."""
    predicted = table(spark, folder, "part").select(
        F.col("p_partkey").alias("bldg_id"), F.lit("p_brand").alias("target"), (F.col("p_partkey") % 30).alias("code")
    )
    return enc.decode_long(predicted, part_dictionary(spark, folder))


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "ordinal_encode",
    "SELECT o_orderkey AS bldg_id, CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS BIGINT) AS o_orderpriority, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS o_orderstatus FROM orders",
)
def ordinal_encode(spark, folder):
    """Ordinal columns take their fixed order, the others the alphabetical one."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("bldg_id"), "o_orderpriority", "o_orderstatus")
    codes = enc.with_ordinal_order(enc.fit_codes(rows), enc.ordinal_codes(spark, {"o_orderpriority": PRIORITIES}))
    return enc.encode(rows, enc.as_maps(codes))


@query(
    "lookup_keep_original",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders",
)
def lookup_keep_original(spark, folder):
    """Dictionary replacement that keeps values the dictionary does not know."""
    status = enc.lookup_or_keep({"F": "final", "O": "open"}, F.col("o_orderstatus"))
    return table(spark, folder, "orders").select("o_orderkey", status.alias("status"))


@query(
    "one_hot",
    "SELECT c_custkey AS bldg_id, "
    + ", ".join(f"CAST(c_mktsegment = '{v}' AS BIGINT) AS c_mktsegment_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " FROM customer",
)
def one_hot_(spark, folder):
    """0/1 column per category."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id"), "c_mktsegment")
    return one_hot(rows, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).drop("c_mktsegment")


@query(
    "distinct_count_with_null",
    f"WITH {CUSTOMER_LABELS} SELECT CAST(count(DISTINCT in_vintage_com) + max(CASE WHEN in_vintage_com IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM labelled",
)
def distinct_count_with_null(spark, folder):
    """Number of classes, null counting as one."""
    return distinct_count(customer_labels(spark, folder), "in_vintage_com")


@query(
    "feature_list_projection",
    f"SELECT p_partkey AS bldg_id, {r('p_retailprice')} AS p_retailprice, CAST(p_size AS BIGINT) AS p_size FROM part",
)
def feature_list_projection(spark, folder):
    """Columns chosen by leaving some out and by parts of their names."""
    part = table(spark, folder, "part").withColumn("bldg_id", F.col("p_partkey"))
    features = feature_columns(part, ["bldg_id", "p_partkey", "p_name", "p_brand", "p_type"])
    assert features == columns_containing(part, ["size", "price"])
    return part.select("bldg_id", *features)


@query("order_key", "SELECT c_custkey AS bldg_id, md5('3:' || c_custkey) AS order_key FROM customer")
def order_key_(spark, folder):
    """The repeatable pseudo-random key that folds and samples sort by."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id"), order_key(3, "c_custkey").alias("order_key"))
