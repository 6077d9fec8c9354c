"""Column expressions: labels, time windows, entity and group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

BENIGN = "BENIGN"
MISSING = "NA"

# Columns that make up an entity, by mode.
ENTITY_MODES = {
    "dst_plus_svc": ["destination_ip", "destination_port", "protocol"],
    "src_plus_svc": ["source_ip", "destination_port", "protocol"],
    "src_plus_dst": ["source_ip", "destination_ip", "protocol"],
    "src_plus_dst_plus_svc": ["source_ip", "destination_ip", "destination_port", "protocol"],
}


def attack_label(label: str = "label") -> Column:
    """0 for the benign label (blanks around it ignored), 1 for anything else or null."""
    return F.when(F.trim(F.col(label)) == BENIGN, F.lit(0)).otherwise(F.lit(1))


def window_id(ts: str, seconds: int) -> Column:
    """Number of the tumbling window of ``seconds`` since the epoch."""
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds))


def graph_key(day: str = "day", window: str = "window_id") -> Column:
    return F.concat_ws("_", F.col(day), F.col(window).cast("string"))


def text_or_missing(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def entity_key(mode: str | Sequence[str]) -> Column:
    """Entity of a flow: one of ``ENTITY_MODES`` or any list of columns."""
    columns = ENTITY_MODES[mode] if isinstance(mode, str) else mode
    return F.concat_ws("::", *[text_or_missing(c) for c in columns])


def split_group_key(day: str = "day", entity: str = "entity") -> Column:
    return F.concat_ws("::", F.col(day), F.col(entity))


def sequence_key(day: str = "day", window: str = "window_id", entity: str = "entity") -> Column:
    return F.concat_ws("_", F.col(day), F.col(window).cast("string"), F.col(entity))


def flow_identifier() -> Column:
    """The flow id, or endpoints and ports joined by dashes where it is missing."""
    parts = ["source_ip", "destination_ip", "source_port", "destination_port", "protocol"]
    return F.coalesce(F.col("flow_id"), F.concat_ws("-", *[text_or_missing(c) for c in parts]))


def seeded_hash(seed: int, *names: str) -> Column:
    """Reproducible stand-in for a random draw: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def unit_interval(digest: Column, start: int = 1) -> Column:
    """A number in [0, 1) from eight hex digits of a digest."""
    digits = F.substring(digest, start, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)
