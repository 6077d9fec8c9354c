"""Column expressions that turn one flow into a token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Bucket edges, flag letters and the numeric columns a token reads.
DURATION_EDGES = [
    0, 1, 10, 100, 1_000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000, 120_000_000,
]
PACKET_EDGES = [0, 1, 2, 5, 10, 20, 50, 100, 1_000, 10_000, 100_000, 300_000]
BYTE_EDGES = [
    0, 1, 64, 512, 4_096, 65_536, 1_048_576, 10_485_760, 104_857_600, 524_288_000, 700_000_000,
]
RATE_EDGES = [0, 1, 10, 100, 1_000, 10_000, 100_000, 1_000_000, 10_000_000]
FLAG_LETTERS = {
    "fin_flag_count": "F",
    "syn_flag_count": "S",
    "rst_flag_count": "R",
    "psh_flag_count": "P",
    "ack_flag_count": "A",
    "urg_flag_count": "U",
}
TOKEN_MEASURES = [
    "flow_duration",
    "total_fwd_packets",
    "total_backward_packets",
    "total_length_of_fwd_packets",
    "total_length_of_bwd_packets",
    "flow_packets_s",
    *FLAG_LETTERS,
]


def bucket(value: str, edges: Sequence[float], prefix: str) -> Column:
    """Name of the half-open bucket holding ``value``; the last name for everything else.

    ``value`` is a SQL expression. ``edges`` ascend, so the first upper edge above the
    value decides.
    """
    last = f"'{prefix}B{len(edges) - 1}'"
    arms = [f"WHEN {value} < {float(edges[0])}D THEN {last}"]
    for number, upper in enumerate(edges[1:]):
        arms.append(f"WHEN {value} < {float(upper)}D THEN '{prefix}B{number}'")
    return F.expr(f"CASE {' '.join(arms)} ELSE {last} END")


def flag_letters() -> Column:
    """Letters of the flags that were seen, ``N`` for none."""
    letters = ", ".join(f"if({name} > 0, '{letter}', '')" for name, letter in FLAG_LETTERS.items())
    return F.expr(f"coalesce(nullif(concat({letters}), ''), 'N')")


def flow_token() -> Column:
    """Protocol, port, five bucketed measures and the flags, joined by ``|``."""
    byte_count = "(total_length_of_fwd_packets + total_length_of_bwd_packets)"
    return F.concat_ws(
        "|",
        F.expr("concat('PR_', protocol)"),
        F.expr("concat('DP_', destination_port)"),
        bucket("flow_duration", DURATION_EDGES, "DUR_"),
        bucket("total_fwd_packets", PACKET_EDGES, "FWD_"),
        bucket("total_backward_packets", PACKET_EDGES, "BWD_"),
        bucket(byte_count, BYTE_EDGES, "BYT_"),
        bucket("flow_packets_s", RATE_EDGES, "PPS_"),
        F.concat(F.lit("FL_"), flag_letters()),
    )


def tail(array: str, n: int) -> Column:
    """The last ``n`` elements of an array column."""
    items = F.col(array)
    return F.slice(items, F.greatest(F.size(items) - F.lit(n - 1), F.lit(1)), F.lit(n))
