"""Graphs, sequences and encodings on hand-made flows."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import encoding, graphs, scoring, sequences, validation
from flowloom.plans.ordered import group_sizes
from flowloom.plans.staging import stage

FLOW_SCHEMA = (
    "flow_id string, source_ip string, source_port int, destination_ip string,"
    "destination_port int, protocol int, timestamp timestamp, day string, label string, v double"
)


def flow(i, second, src="a", dst="b", port=80, label="BENIGN", flow_id=None):
    from datetime import datetime, timedelta, timezone

    when = None
    if second is not None:
        when = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)
    return (flow_id or f"f{i:02d}", src, 1, dst, port, 6, when, "Mon", label, float(i))


def flow_frame(spark, flows):
    return spark.createDataFrame(flows, FLOW_SCHEMA)


@pytest.fixture(params=[None, "2"])
def task_limit(spark, request):
    """Both the one-window plans and the chunked ones."""
    if request.param:
        spark.conf.set("flowloom.taskRows", request.param)
    yield
    spark.conf.unset("flowloom.taskRows")


def test_nodes_and_edges(spark, task_limit):
    flows = [
        flow(0, 0), flow(1, 0, src="c"), flow(2, 5, dst="x"), flow(3, 9, src="c", port=22),
        flow(4, None), flow(5, 400, label=" BENIGN "), flow(6, 10, label="Bot"),
    ]
    keyed = graphs.keyed_flows(flow_frame(spark, flows), 300)
    nodes = graphs.number_nodes(keyed)
    ids = {r["flow_id"]: (r["graph_id"].split("_")[1], r["node_id"]) for r in nodes.collect()}
    window = 1704067200 // 300
    assert ids == {
        "f00": (str(window), 0), "f01": (str(window), 1), "f02": (str(window), 2),
        "f03": (str(window), 3), "f06": (str(window), 4), "f05": (str(window + 1), 0),
    }
    by_src = {(r["src"], r["dst"]) for r in graphs.chain_edges(nodes, "src", 1).collect()}
    assert by_src == {(0, 2), (2, 4), (1, 3)}
    edges = graphs.graph_edges(nodes, "src+dst+svc", 5)
    got = {(r["src"], r["dst"]) for r in edges.collect()}
    forward = {(0, 2), (0, 4), (2, 4), (1, 3)}  # source
    forward |= {(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4)}  # destination b
    forward |= {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}  # service
    assert got == forward | {(b, a) for a, b in forward}
    assert edges.count() == len(got)
    summary = {r["graph_id"]: r for r in graphs.graph_summary(keyed).collect()}
    first = summary[f"Mon_{window}"]
    assert (first["graph_y"], first["n_nodes"], first["n_pos_nodes"]) == (1, 5, 1)
    assert summary[f"Mon_{window + 1}"]["graph_y"] == 0
    assert all(r["is_contiguous"] for r in graphs.node_id_check(nodes).collect())


def test_repeated_flow_ids_get_different_nodes(spark, task_limit):
    flows = [flow(i, 0, flow_id="same") for i in range(6)]
    nodes = graphs.number_nodes(graphs.keyed_flows(flow_frame(spark, flows), 300))
    assert sorted(r["node_id"] for r in nodes.collect()) == list(range(6))


def test_neighbour_means(spark):
    nodes = spark.createDataFrame(
        [("g", 0, 1.0), ("g", 1, 3.0), ("g", 2, 8.0), ("h", 0, 5.0)],
        "graph_id string, node_id int, v double",
    )
    pairs = [("g", 0, 1), ("g", 1, 0), ("g", 1, 2), ("g", 2, 1)]
    edges = spark.createDataFrame(pairs, "graph_id string, src int, dst int")
    rows = graphs.neighbour_mean_two_hops(nodes, edges, ["v"]).collect()
    got = {(r["graph_id"], r["node_id"]): (r["nb1_v"], r["nb2_v"]) for r in rows}
    assert got == {
        ("g", 0): (3.0, 4.5), ("g", 1): (4.5, 3.0), ("g", 2): (3.0, 4.5), ("h", 0): (None, None),
    }


def test_chain_means_are_neighbour_means(spark, task_limit):
    """Windows alone give the means over the edges; a neighbour of several chains counts once."""
    flows = [flow(i, 7 * i, src="ac"[i % 2], dst="bx"[i % 3 == 0], port=80 + i % 2) for i in range(9)]
    flows += [flow(20, 400, src="a"), flow(21, 900)]
    nodes = stage(graphs.number_nodes(graphs.keyed_flows(flow_frame(spark, flows), 300)).withColumn(
        "v", F.when(F.col("node_id") != 2, F.col("node_id") * 10.0)
    ))
    edges = graphs.graph_edges(nodes, k=2)
    want = graphs.neighbour_mean_two_hops(nodes, edges, ["v"])
    got = graphs.context_means(nodes, ["v"], group_sizes(nodes, ["graph_id"]), k=2)
    columns = ["graph_id", "node_id", "nb1_v", "nb2_v"]
    rows = [[(*r[:2], *(v and round(v, 9) for v in r[2:])) for r in df.select(*columns).collect()]
            for df in (got, want)]
    assert len(rows[0]) == 11 and sorted(rows[0], key=str) == sorted(rows[1], key=str)


def test_work_in_graphs_has_partitions_by_rows(spark):
    """Partitions of nodes follow from their number and are not merged by their compressed bytes."""
    table = spark.range(1000).select(F.lit("g").alias("graph_id"), "id")
    text = graphs.by_graph(table, (1_000_000, 40 * graphs.TASK_NODES))._jdf.queryExecution().toString()
    assert ", 40), REPARTITION_BY_NUM" in text
    edges = graphs.graph_edges(
        spark.createDataFrame(
            [("g", None, 0, "a", "b", 1, 6)],
            "graph_id string, timestamp timestamp, node_id int, source_ip string, "
            "destination_ip string, destination_port int, protocol int",
        ), largest=1,
    )
    # No table of distinct edges is kept in memory.
    lines = edges._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line and "dst#" in line for line in lines)


def measured(df):
    names = [
        "flow_duration", "total_fwd_packets", "total_backward_packets",
        "total_length_of_fwd_packets", "total_length_of_bwd_packets", "flow_packets_s",
        "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
        "ack_flag_count", "urg_flag_count",
    ]
    return df.withColumns({c: F.col("v") for c in names})


def test_attack_lost_by_the_cap(spark, task_limit):
    """Tokens keep the label of the whole sequence, trajectories that of the kept tail."""
    flows = [flow(0, 0, label="Bot"), *[flow(i, i) for i in range(1, 6)]]
    df = flow_frame(spark, flows)
    tokens = sequences.token_sequences(
        sequences.token_events(measured(df), "src_plus_dst_plus_svc", 300), cap=4
    ).first()
    assert (tokens["seq_y"], tokens["seq_len"], tokens["full_seq_len"]) == (1, 4, 6)
    assert tokens["was_truncated"] and tokens["n_flows"] == 6
    assert "FWD_B2" in tokens["tokens"][0] and len(tokens["tokens"]) == 4
    built = sequences.trajectories(
        sequences.trajectory_events(df, "dst_plus_svc", ["v"], 300), cap=4
    )
    row = built.first()
    assert (row["seq_y"], row["n_attack_events"], row["full_n_attack_events"]) == (0, 0, 1)
    assert row["x"] == [[2.0], [3.0], [4.0], [5.0]]
    assert [t - row["t"][0] for t in row["t"]] == [0, 1, 2, 3]
    counts = sequences.preparation_counts(built, 5).first()
    assert counts["sequences_dropped_short"] == 1 and counts["n_split_groups"] == 0
    counts = sequences.preparation_counts(built, 4).first()
    assert counts["truncated_attack_events_removed"] == 1
    assert counts["n_benign_split_groups"] == 1
    assert validation.trajectory_integrity(built).first()["passed"]


def test_integrity_sees_every_fault(spark):
    good = (2, 2, 1, 1, [0, 1], 2, 1)
    bad = [
        (2, 2, 3, 1, [0, 1], 2, 3), (2, 3, 1, 1, [0, 1], 3, 1), (2, 2, 0, 1, [0, 1], 2, 1),
        (2, 2, 1, 0, [0, 1], 2, 1), (2, 2, 1, 1, [0, 1], 1, 1), (2, 2, 1, 1, [0, 1], 2, 0),
    ]
    schema = (
        "n_events int, seq_len int, n_attack_events int, seq_y int, y_seq array<int>,"
        "full_seq_len long, full_n_attack_events long"
    )
    assert validation.trajectory_integrity(spark.createDataFrame([good], schema)).first()["passed"]
    for row in bad:
        report = validation.trajectory_integrity(spark.createDataFrame([good, row], schema))
        assert not report.first()["passed"], row


def test_vocabulary_and_encoding(spark, no_broadcast):
    rows = [("s1", ["a", "b", "a"]), ("s2", ["b", "c", "zz"]), ("s3", [])]
    df = spark.createDataFrame(rows, "seq_id string, tokens array<string>")
    vocab = encoding.vocabulary(df.where("seq_id <> 's3'"), min_freq=1)
    ids = {r["token"]: r["id"] for r in vocab.where("token <> 'zz'").collect()}
    assert ids == {"[PAD]": 0, "[UNK]": 1, "[MASK]": 2, "[CLS]": 3, "a": 4, "b": 5, "c": 6}
    encoded = encoding.encode_tokens(df, vocab.where("token <> 'zz'"), 4)
    got = {r["seq_id"]: (r["input_ids"], r["attention_mask"]) for r in encoded.collect()}
    assert got == {
        "s1": ([3, 4, 5, 4], [1, 1, 1, 1]), "s2": ([3, 5, 6, 1], [1, 1, 1, 1]),
        "s3": ([3, 0, 0, 0], [1, 0, 0, 0]),
    }
    short = encoding.encode_tokens(df, vocab, 3).where("seq_id = 's1'").first()
    assert short["input_ids"] == [3, 5, 4]
    with pytest.raises(ValueError, match="max_len"):
        encoding.encode_tokens(df, vocab, 1)


def test_masking(spark):
    rows = [(f"s{i}", [3, *[4 + (i + j) % 6 for j in range(i % 9)]]) for i in range(300)]
    rows = [(s, ids + [0] * (9 - len(ids))) for s, ids in rows]
    df = spark.createDataFrame(rows, "seq_id string, input_ids array<int>")
    out = encoding.mask_tokens(df, vocab_size=10, probability=0.15).collect()
    chosen = hidden = 0
    for r in out:
        hits = 0
        for given, masked, label in zip(
            r["input_ids"], r["masked_ids"], r["mask_labels"], strict=True
        ):
            if label == encoding.IGNORE:
                assert masked == given
            else:
                assert given not in (0, 3) and label == given
                assert masked == 2 or 4 <= masked < 10
                hits += 1
                hidden += masked == 2
        eligible = sum(g not in (0, 3) for g in r["input_ids"])
        assert (hits > 0) == (eligible > 0)
        chosen += hits
    assert 0.7 < hidden / chosen < 0.9


def test_time_encoding_and_padding(spark):
    schema = "seq_id string, t array<bigint>, x array<array<double>>, y_seq array<int>, split string"
    rows = [
        ("a", [10, 12, 20], [[1.0], [3.0], [9.0]], [0, 1, 0], "train"),
        ("b", [5], [[2.0]], [1], "train"),
    ]
    df = spark.createDataFrame(rows, schema)
    gaps = encoding.event_gaps(encoding.event_rows(df))
    assert sorted(r["dt"] for r in gaps.collect()) == [0, 0, 2, 8]
    clip = encoding.gap_clip(gaps, 60)
    assert clip.first()["dt_clip"] == pytest.approx(2 + 6 * 0.99)
    none = encoding.gap_clip(gaps.where("seq_id = 'b'"), 60)
    assert none.first()["dt_clip"] == 60.0
    fixed = spark.createDataFrame([(4.0,)], "dt_clip double")
    timed = encoding.time_encode(df, fixed, 2)
    padded = {r["seq_id"]: r for r in encoding.pad_sequences(timed, 2, 1).collect()}
    assert padded["a"]["dt_norm"] == [0.0, 1.0] and padded["a"]["t_norm"] == [0.0, 2.0]
    assert padded["a"]["x"] == [[3.0], [9.0]] and padded["a"]["mask"] == [1, 1]
    assert padded["b"]["x"] == [[2.0], [0.0]] and padded["b"]["y_seq"] == [1, -100]
    assert padded["b"]["mask"] == [1, 0] and padded["b"]["dt_norm"] == [0.0, 0.0]


def test_inferred_length(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "seq_len int")
    assert encoding.inferred_length(df).first()["max_len"] == 96
    assert encoding.inferred_length(df, reserve=0, cap=50).first()["max_len"] == 50
    assert encoding.inferred_length(df.where("seq_len < 3")).first()["max_len"] == 8


def test_next_token_scores(spark):
    schema = "seq_id string, tokens array<string>"
    train = spark.createDataFrame([("t1", ["a", "b", "a"]), ("t2", ["a", "b", "c"])], schema)
    scored = spark.createDataFrame([("s", ["a", "b", "c", "q"])], schema)
    out = scoring.next_token_scores(scored, train, g=1).first()
    # [CLS]>a and a>b are candidates; b>c ties with b>a and loses; c>q is unseen.
    assert out["error_ratio"] == pytest.approx(0.5)
    import math

    losses = [3 / (2 + 4), 3 / (2 + 4), 2 / (2 + 4), 1 / (0 + 4)]
    assert out["mean_loss"] == pytest.approx(-sum(map(math.log, losses)) / 4)


def test_decay_equals_the_fold(spark):
    import math

    events = [("s", i, t, [float(v)]) for i, (t, v) in enumerate([(0, 1), (5, 2), (5, 3), (60, 4)])]
    df = spark.createDataFrame(events, "seq_id string, pos int, t long, x array<double>")
    # The last rates fade to nothing between events and pass many spans.
    for rate in (0.1, 1.0, 30.0, 1e4):
        rows = sorted(scoring.decayed_state(df, ["v"], rate).collect(), key=lambda r: r["pos"])
        state, before = 0.0, 0
        for r, (_, _, t, x) in zip(rows, events, strict=True):
            state = state * math.exp(-rate * (t - before)) + x[0]
            before = t
            assert r["v_state"] == pytest.approx(state)
