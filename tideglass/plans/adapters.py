"""The benchmark tables read as telemetry.

``events`` stands for flow records (user = source, event type = port and label,
value and ``props.k`` = byte counts, ``error`` = attack), ``lineitem`` for packets
and for a second flow set, ``embeddings`` for feature vectors and logits,
``labels`` for truth and prediction, ``documents`` for classes of unequal size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.scores import softmax
from tideglass.operators.windows import net_window_features, window_features
from tideglass.session import task_count

HOUR = 3_600
DAY = 86_400
# Months of hourly windows per time bucket of a source.
BUCKET = 30 * DAY

EVENT_STAGES = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
HORIZONS = [("IMMINENT", 3 * HOUR), ("NEAR-TERM", 12 * HOUR), ("ELEVATED", 30 * HOUR)]
WINDOW_COLUMNS = ["orig_bytes", "resp_bytes", "flow_count", "distinct_ports"]
VECTOR = [f"f{i}" for i in range(64)]
# Events whose gap-filled windows (ten times as many on the benchmark tables) one task holds.
TASK_EVENTS = 30_000
# Packets whose connections one task puts together.
TASK_PACKETS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_flows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("uid"),
        F.col("user_id").cast("string").alias("src_ip"),
        F.col("event_type").alias("dst_port"),
        F.col("event_type").alias("label"),
        F.col("value").alias("orig_bytes"),
        F.get_json_object("props", "$.k").alias("resp_bytes"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_flows(table(spark, sf_dir, "events"))


def window_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for gap-filled windows, in proportion to the events."""
    return task_count(table(spark, sf_dir, "events"), TASK_EVENTS)


def packet_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for connections, in proportion to the packets."""
    return task_count(table(spark, sf_dir, "lineitem"), TASK_PACKETS)


def windows(spark: SparkSession, sf_dir: str, gap_fill: bool = True) -> DataFrame:
    return window_features(
        flows(spark, sf_dir),
        width=HOUR,
        means=["orig_bytes", "resp_bytes"],
        port_name="distinct_ports",
        gap_fill=gap_fill,
        bucket_seconds=BUCKET,
    )


def net_windows(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Hourly windows of the whole network, or of each source as its own capture."""
    return net_window_features(
        flows(spark, sf_dir),
        by,
        "ts",
        HOUR,
        counted="uid",
        syn=(F.col("label") == "click").cast("int"),
        size="orig_bytes",
        duration=F.col("resp_bytes").try_cast("double"),
        fwd=F.col("resp_bytes").try_cast("long"),
        bwd=F.length("label"),
        rate=F.col("orig_bytes") / 2,
        attack=(F.col("label") == "error").cast("int"),
        bucket_seconds=BUCKET,
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with traffic as predictions: probability from bytes, stage from ``k``."""
    rows = windows(spark, sf_dir, gap_fill=False)
    return rows.select(
        "src_ip",
        "ts",
        (F.floor("resp_bytes") % 5).cast("int").alias("stage"),
        F.least(F.lit(100.0), F.col("orig_bytes") * 2).alias("threat_prob"),
        (F.lit(100.0) - F.least(F.lit(100.0), F.col("orig_bytes") / 2)).alias("confidence"),
        "flow_count",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as packets of one connection per order."""
    li = table(spark, sf_dir, "lineitem")
    seconds = F.col("l_linenumber") * F.col("l_linenumber") + F.col("l_suppkey") % 7
    return li.select(
        F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + seconds).alias("ts"),
        F.col("l_orderkey").alias("uid"),
        F.col("l_suppkey").cast("string").alias("src_ip"),
        F.col("l_partkey").cast("string").alias("dst_ip"),
        (F.col("l_linenumber") % 2 == 1).alias("is_orig"),
        F.when(F.col("l_linestatus") == "F", 4).otherwise(6).alias("ip_version"),
        F.col("l_quantity").cast("int").alias("ttl"),
        (F.col("l_partkey") % 1_500).cast("int").alias("ip_len"),
        (F.col("l_returnflag") != "R").alias("is_tcp"),
        (F.col("l_partkey") % 64).cast("int").alias("tcp_flags"),
        (F.col("l_suppkey") % 1_000).cast("int").alias("tcp_win"),
        F.col("l_quantity").cast("int").alias("frame_len"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as connection records."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("uid"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").cast("string").alias("src_ip"),
        (key % 60_000).cast("int").alias("src_port"),
        (key % 251).cast("string").alias("dst_ip"),
        (F.col("o_custkey") % 10 + 80).cast("int").alias("dst_port"),
        F.when(F.col("o_orderstatus") == "P", "udp").otherwise("tcp").alias("proto"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("ssl"), F.lit("http")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("dns")))
        .when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>")).alias("service"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("duration"),
        F.floor("o_totalprice").alias("orig_bytes"),
        (key % 5_000).alias("resp_bytes"),
        (F.col("o_custkey") % 4).alias("orig_pkts"),
        (key % 3).alias("resp_pkts"),
        F.when(F.col("o_orderstatus") == "F", "ShADtFf").when(F.col("o_orderstatus") == "O", "ShADadT").alias("history"),
    )


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of one capture, with microsecond times."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("src_ip"),
        (F.col("event_type") != "view").alias("is_tcp"),
        F.when(F.col("event_type") == "click", 2).otherwise(16).alias("tcp_flags"),
        F.get_json_object("props", "$.k").cast("int").alias("frame_len"),
        # Signups come by IPv6, and every seventh error is no IP packet.
        F.when(F.col("event_type") == "signup", 6)
        .when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), F.lit(None))
        .otherwise(4).alias("ip_version"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with one double column per dimension."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)]
    )


def scored_vectors(spark: SparkSession, sf_dir: str, classes: int = 10) -> DataFrame:
    """Sums of all dimensions, dealt out in turn, as logits of the classes."""
    emb = table(spark, sf_dir, "embeddings")

    def logit(c):
        own = F.filter("embedding", lambda v, i: i % classes == c)
        return F.aggregate(own, F.lit(0.0), lambda total, v: total + v.cast("double")) * 10

    logits = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), logit)
    return emb.select("vec_id", "label", logits.alias("logits")).withColumn("probs", softmax("logits"))


def text(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)
