"""Schemas of the raw flow files."""

from __future__ import annotations

from pyspark.sql import types as T

# The 77 flow statistics of a raw record, in file order, blanks as delivered.
FLOW_STATISTICS = [
    " Flow Duration", " Total Fwd Packets", " Total Backward Packets",
    "Total Length of Fwd Packets", " Total Length of Bwd Packets",
    " Fwd Packet Length Max", " Fwd Packet Length Min", " Fwd Packet Length Mean",
    " Fwd Packet Length Std", "Bwd Packet Length Max", " Bwd Packet Length Min",
    " Bwd Packet Length Mean", " Bwd Packet Length Std", "Flow Bytes/s", " Flow Packets/s",
    " Flow IAT Mean", " Flow IAT Std", " Flow IAT Max", " Flow IAT Min", "Fwd IAT Total",
    " Fwd IAT Mean", " Fwd IAT Std", " Fwd IAT Max", " Fwd IAT Min", "Bwd IAT Total",
    " Bwd IAT Mean", " Bwd IAT Std", " Bwd IAT Max", " Bwd IAT Min", "Fwd PSH Flags",
    " Bwd PSH Flags", " Fwd URG Flags", " Bwd URG Flags", " Fwd Header Length",
    " Bwd Header Length", "Fwd Packets/s", " Bwd Packets/s", " Min Packet Length",
    " Max Packet Length", " Packet Length Mean", " Packet Length Std",
    " Packet Length Variance", "FIN Flag Count", " SYN Flag Count", " RST Flag Count",
    " PSH Flag Count", " ACK Flag Count", " URG Flag Count", " CWE Flag Count",
    " ECE Flag Count", " Down/Up Ratio", " Average Packet Size", " Avg Fwd Segment Size",
    " Avg Bwd Segment Size", " Fwd Header Length.1", "Fwd Avg Bytes/Bulk",
    " Fwd Avg Packets/Bulk", " Fwd Avg Bulk Rate", " Bwd Avg Bytes/Bulk",
    " Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate", "Subflow Fwd Packets",
    " Subflow Fwd Bytes", " Subflow Bwd Packets", " Subflow Bwd Bytes",
    "Init_Win_bytes_forward", " Init_Win_bytes_backward", " act_data_pkt_fwd",
    " min_seg_size_forward", "Active Mean", " Active Std", " Active Max", " Active Min",
    "Idle Mean", " Idle Std", " Idle Max", " Idle Min",
]
ENDPOINTS = [
    ("Flow ID", "string"),
    (" Source IP", "string"),
    (" Source Port", "int"),
    (" Destination IP", "string"),
    (" Destination Port", "int"),
    (" Protocol", "int"),
    (" Timestamp", "timestamp"),
]
LABEL = " Label"
TAGS = ["day", "time_of_day"]
DUPLICATE = " Fwd Header Length.1"
# The early surveys of the same files number the two equal header columns.
SURVEY_NAMES = {
    " Fwd Header Length": " Fwd Header Length40",
    " Fwd Header Length.1": " Fwd Header Length61",
}

TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def flow_schema(
    variant: str = "traffic",
    stage: str = "raw",
    survey: bool = False,
    timestamps_as_text: bool = False,
) -> T.StructType:
    """Schema of a flow file.

    ``variant``: ``traffic`` has endpoints and a timestamp, ``statistics`` only the
    destination port. ``stage``: ``raw`` as delivered, ``full`` with the day tags,
    ``clean`` without the duplicate header column.
    """
    endpoints = {"traffic": ENDPOINTS, "statistics": [(" Destination Port", "int")]}[variant]
    columns = [*endpoints, *[(name, "double") for name in FLOW_STATISTICS], (LABEL, "string")]
    if stage in ("full", "clean"):
        columns += [(name, "string") for name in TAGS]
    elif stage != "raw":
        raise ValueError(f"unknown stage {stage!r}")
    if stage == "clean":
        columns = [c for c in columns if c[0] != DUPLICATE]
    if survey:
        columns = [(SURVEY_NAMES.get(name, name), kind) for name, kind in columns]
    if timestamps_as_text:
        columns = [(n, "string" if kind == "timestamp" else kind) for n, kind in columns]
    return T.StructType([T.StructField(name, TYPES[kind], True) for name, kind in columns])
