"""Class dictionaries. All of them are small, fixed tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

# --- fixed values ----------------------------------------------------------------

STAGE_NAMES = {
    0: "Normal",
    1: "Reconnaissance",
    2: "Initial Access",
    3: "Lateral Movement",
    4: "Command & Control",
}

RISK_CLASSES = {"NORMAL": 0, "ELEVATED": 1, "NEAR-TERM": 2, "IMMINENT": 3}

# Upper bounds, in seconds, of the time to the next attack.
RISK_HORIZONS = [("IMMINENT", 30), ("NEAR-TERM", 120), ("ELEVATED", 300)]
NO_RISK = "NORMAL"

# Ground-truth flow label to attack stage.
FLOW_LABEL_STAGES = {
    "BENIGN": 0,
    "Benign": 0,
    "PortScan": 1,
    "FTP-Patator": 2,
    "SSH-Patator": 2,
    "FTP-BruteForce": 2,
    "SSH-Bruteforce": 2,
    "Web Attack \x96 Brute Force": 2,
    "Web Attack - Brute Force": 2,
    "Brute Force -Web": 2,
    "Brute Force -XSS": 2,
    "Web Attack \x96 XSS": 2,
    "Web Attack - XSS": 2,
    "Web Attack \x96 Sql Injection": 2,
    "Web Attack - Sql Injection": 2,
    "SQL Injection": 2,
    "Heartbleed": 2,
    "Infiltration": 3,
    "Infilteration": 3,
    "Bot": 4,
    "DDoS": 4,
    "DDOS attack-LOIC-UDP": 4,
    "DDOS attack-HOIC": 4,
    "DDoS attacks-LOIC-HTTP": 4,
    "DoS slowloris": 4,
    "DoS attacks-Slowloris": 4,
    "DoS Slowhttptest": 4,
    "DoS attacks-SlowHTTPTest": 4,
    "DoS Hulk": 4,
    "DoS attacks-Hulk": 4,
    "DoS GoldenEye": 4,
    "DoS attacks-GoldenEye": 4,
}

# Known attacker addresses to attack stage, per capture.
ATTACKER_STAGES_2018 = {
    "18.218.115.60": 2,
    "18.219.9.1": 4,
    "18.219.32.43": 4,
    "18.218.55.126": 4,
    "52.14.136.135": 4,
    "18.219.193.20": 2,
    "18.219.211.138": 2,
    "18.217.165.70": 2,
    "172.31.69.28": 3,
    "172.31.69.25": 4,
    "18.217.42.52": 2,
    "18.221.16.50": 4,
    "18.219.119.219": 1,
    "18.111.49.153": 1,
}
ATTACKER_STAGES_CTU13 = {"147.32.84.165": 4}

# --- as tables ---------------------------------------------------------------------


def flow_label_stages() -> dict[str, int]:
    """Flow labels with the dash as cp1252 byte, en dash, or UTF-8 read bytewise."""
    out = dict(FLOW_LABEL_STAGES)
    for dash in ("–", "–".encode().decode("iso-8859-1")):
        for text, stage in FLOW_LABEL_STAGES.items():
            out[text.replace("\x96", dash)] = stage
    return out


def attackers(spark: SparkSession, stages: dict[str, int]) -> DataFrame:
    """Address dictionary as a two-column table."""
    return spark.createDataFrame(sorted(stages.items()), "src_ip string, stage int")


def intervals(spark: SparkSession, pairs: list[tuple[datetime, datetime]]) -> DataFrame:
    return spark.createDataFrame(pairs, "start timestamp, end timestamp")
