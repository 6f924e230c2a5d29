"""Sessions of packets: five-tuples with an idle gap, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds without a packet after which a UDP session has ended; fixed value.
IDLE = 30
#: TCP flags; fixed values.
FIN, SYN, RST = 1, 2, 4


def directed(packets: DataFrame) -> DataFrame:
    """With both directions of a flow under one key: the lower end first; `up` tells packets from it."""
    a, b = (F.struct(F.col(f"{x}_ip").alias("ip"), F.col(f"{x}_port").alias("port")) for x in ("src", "dst"))
    up = a <= b
    return packets.withColumns({"up": up, "end_a": F.when(up, a).otherwise(b), "end_b": F.when(up, b).otherwise(a)})


def sessions(packets: DataFrame, *, time_column: str = "ts", idle: int = IDLE, watermark: str | None = None) -> DataFrame:
    """A row for each flow and stretch without a gap of `idle` seconds.

    packets: ts, src_ip, src_port, dst_ip, dst_port, ip_protocol, len, tcp_flags. For a stream, watermark says how late
    packets may come; sessions come out once it has passed their end.
    """
    flows = directed(packets.where("src_ip is not null and dst_ip is not null"))
    if watermark:
        flows = flows.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, watermark)
    flag = lambda bit: F.max(F.coalesce((F.col("tcp_flags").bitwiseAND(bit) != 0), F.lit(False)))
    grouped = flows.groupBy(F.session_window(time_column, f"{idle} seconds").alias("session"), "ip_protocol", "end_a", "end_b").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"),
        F.sum(F.when(F.col("up"), F.col("len")).otherwise(0)).alias("bytes_up"), F.sum(F.when(F.col("up"), 0).otherwise(F.col("len"))).alias("bytes_down"),
        F.min(time_column).alias("first"), F.max(time_column).alias("last"),
        flag(SYN).alias("opened"), (flag(FIN) | flag(RST)).alias("closed"),
    )
    seconds = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    return grouped.select("ip_protocol", F.col("end_a.ip").alias("ip_a"), F.col("end_a.port").alias("port_a"), F.col("end_b.ip").alias("ip_b"), F.col("end_b.port").alias("port_b"), "packets", "bytes", "bytes_up", "bytes_down", "first", "last", "opened", "closed", seconds.alias("duration"), F.when(seconds > 0, F.col("bytes") * 8 / seconds).alias("bps"))
