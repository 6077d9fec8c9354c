"""Queries on flow graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import (
    DAY_SECONDS, EDGE_K, EDGES, FLOWS, GRAPH_SECONDS, GRAPH_SPLIT, GRAPHS, SEED, query, tidy, tidy_sql,
    with_ctes,
)
from flowloom.operators import graphs, splits
from flowloom.plans.ordered import group_sizes
from flowloom.plans.staging import stage
from flowloom.sources.adapters import lineitems_as_flows, read_flows, read_table

FEATURES = ["value", "k"]
NODE_SQL = with_ctes(FLOWS, GRAPHS)
EDGE_SQL = with_ctes(FLOWS, GRAPHS, EDGES)
SPLIT_SQL = with_ctes(FLOWS, GRAPHS, GRAPH_SPLIT)


def keyed(spark, sf_dir):
    return graphs.keyed_flows(read_flows(spark, sf_dir), GRAPH_SECONDS)


def nodes(spark, sf_dir):
    return nodes_with_sizes(spark, sf_dir)[0]


def nodes_with_sizes(spark, sf_dir):
    """Numbered nodes, and the flows of the largest graph and of all, which are measured once."""
    columns = ["graph_id", "day", "window_id", "timestamp", "flow_id", "source_ip",
               "destination_ip", "destination_port", "protocol", "y", *FEATURES]
    flows = keyed(spark, sf_dir).select(*columns)
    sizes = group_sizes(flows, ["graph_id"])
    return graphs.number_nodes(graphs.by_graph(flows, sizes), sizes[0]), sizes


def edges_of_nodes(spark, sf_dir, **options):
    numbered, sizes = nodes_with_sizes(spark, sf_dir)
    return graphs.graph_edges(numbered, largest=sizes[0], **options)


def stored_nodes(spark, sf_dir):
    """Node numbers are needed several times, so the table is written once; and its sizes."""
    numbered, sizes = nodes_with_sizes(spark, sf_dir)
    return stage(numbered), sizes


def graphs_split(spark, sf_dir):
    summary = graphs.graph_summary(keyed(spark, sf_dir))
    return splits.stratified_split(summary, "graph_id", "graph_y", SEED, "split")


@query("graph_summary", f"""{NODE_SQL}
SELECT graph_id, day, window_id, graph_y, n_nodes, n_pos_nodes,
  round(attack_ratio, 6) AS attack_ratio FROM graphs""")
def graph_summary(spark, sf_dir):
    summary = graphs.graph_summary(keyed(spark, sf_dir))
    return summary.withColumn("attack_ratio", F.round("attack_ratio", 6))


BULK_SQL = f"""
bulk AS (SELECT strftime(l_shipdate, '%Y') AS day,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) // {DAY_SECONDS} AS window_id,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""


@query("graph_summary_orders", f"""{with_ctes(BULK_SQL)}
SELECT day || '_' || CAST(window_id AS VARCHAR) AS graph_id, day, window_id, max(y) AS graph_y,
  count(*) AS n_nodes, CAST(sum(y) AS BIGINT) AS n_pos_nodes,
  round(sum(y) / count(*)::DOUBLE, 6) AS attack_ratio
FROM bulk GROUP BY day, window_id""")
def graph_summary_orders(spark, sf_dir):
    flows = lineitems_as_flows(read_table(spark, sf_dir, "lineitem"))
    summary = graphs.graph_summary(graphs.keyed_flows(flows, DAY_SECONDS))
    return summary.withColumn("attack_ratio", F.round("attack_ratio", 6))


@query("node_ids", f"{NODE_SQL} SELECT graph_id, flow_id, node_id FROM nodes")
def node_ids(spark, sf_dir):
    return nodes(spark, sf_dir).select("graph_id", "flow_id", "node_id")


def _chain(name):
    def run(spark, sf_dir):
        return graphs.chain_edges(nodes(spark, sf_dir), name, EDGE_K)

    query(f"chain_edges_{name}", f"{EDGE_SQL} SELECT graph_id, src, dst FROM chain_{name}")(run)


for _name in graphs.CHAINS:
    _chain(_name)


@query("graph_edges", f"{EDGE_SQL} SELECT graph_id, src, dst FROM edges")
def graph_edges(spark, sf_dir):
    return edges_of_nodes(spark, sf_dir, k=EDGE_K)


@query("graphs_with_split", f"""{SPLIT_SQL}
SELECT graph_id, day, graph_y, n_nodes, n_pos_nodes, split FROM graph_split""")
def graphs_with_split(spark, sf_dir):
    return graphs_split(spark, sf_dir).select(
        "graph_id", "day", "graph_y", "n_nodes", "n_pos_nodes", "split"
    )


@query("graph_nodes", f"""{SPLIT_SQL}
SELECT n.graph_id, n.day, n.window_id, s.split, n.node_id, n.y, n.value, n.k
FROM nodes n JOIN graph_split s USING (graph_id)""")
def graph_nodes(spark, sf_dir):
    return graphs.node_table(nodes(spark, sf_dir), graphs_split(spark, sf_dir), FEATURES)


@query("graph_edges_split", f"""{with_ctes(FLOWS, GRAPHS, EDGES, GRAPH_SPLIT)}
SELECT e.graph_id, e.src, e.dst, s.day, s.window_id, s.split
FROM edges e JOIN graph_split s USING (graph_id)""")
def graph_edges_split(spark, sf_dir):
    edges = edges_of_nodes(spark, sf_dir, k=EDGE_K)
    return graphs.edge_table(edges, graphs_split(spark, sf_dir))


BLOCK = 8


@query("graph_assemble", f"""{EDGE_SQL},
node_blocks AS (SELECT graph_id, node_id // {BLOCK} AS block,
  string_agg(node_id || ':' || y, ',' ORDER BY node_id) AS nodes FROM nodes GROUP BY ALL),
edge_blocks AS (SELECT graph_id, src // {BLOCK} AS block,
  string_agg(src || '>' || dst, ',' ORDER BY src, dst) AS edges FROM edges GROUP BY ALL)
SELECT graph_id, CAST(block AS BIGINT) AS block, nodes, coalesce(edges, '') AS edges
FROM node_blocks LEFT JOIN edge_blocks USING (graph_id, block)""")
def graph_assemble(spark, sf_dir):
    numbered, sizes = stored_nodes(spark, sf_dir)
    numbered = graphs.by_graph(numbered, sizes)
    edges = graphs.graph_edges(numbered, k=EDGE_K, largest=sizes[0])
    blocks = graphs.assemble_graphs(numbered, edges, BLOCK)
    return blocks.select(
        "graph_id",
        "block",
        F.array_join(
            F.transform("nodes", lambda n: F.concat_ws(":", n["node_id"], n["y"])), ","
        ).alias("nodes"),
        F.coalesce(
            F.array_join(
                F.transform("edges", lambda e: F.concat_ws(">", e["src"], e["dst"])), ","
            ),
            F.lit(""),
        ).alias("edges"),
    )


@query("node_id_check", f"""{NODE_SQL}
SELECT graph_id, min(node_id) AS min_id, max(node_id) AS max_id, count(*) AS n_nodes,
  min(node_id) = 0 AND max(node_id) = count(*) - 1 AS is_contiguous
FROM nodes GROUP BY graph_id""")
def node_id_check(spark, sf_dir):
    return graphs.node_id_check(nodes(spark, sf_dir))


ONE_HOP = """
hop1 AS (SELECT e.graph_id, e.dst AS node_id, avg(n.value) AS nb1_value, avg(n.k) AS nb1_k
  FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id = e.src
  GROUP BY e.graph_id, e.dst)"""


@query("neighbour_mean", f"""{with_ctes(FLOWS, GRAPHS, EDGES, ONE_HOP)}
SELECT n.graph_id, n.node_id, {tidy_sql('h.nb1_value')} AS nb_value,
  {tidy_sql('h.nb1_k')} AS nb_k
FROM nodes n LEFT JOIN hop1 h USING (graph_id, node_id)""")
def neighbour_mean(spark, sf_dir):
    numbered, sizes = stored_nodes(spark, sf_dir)
    means = graphs.context_means(numbered, FEATURES, sizes, hops=1, k=EDGE_K)
    means = means.withColumnsRenamed({f"nb1_{c}": f"nb_{c}" for c in FEATURES})
    return means.select(
        "graph_id", "node_id", *[tidy(f"nb_{c}") for c in FEATURES]
    )


@query("neighbour_mean_2hop", f"""{with_ctes(FLOWS, GRAPHS, EDGES, ONE_HOP)},
hop2 AS (SELECT e.graph_id, e.dst AS node_id, avg(h.nb1_value) AS nb2_value, avg(h.nb1_k) AS nb2_k
  FROM edges e JOIN hop1 h ON h.graph_id = e.graph_id AND h.node_id = e.src
  GROUP BY e.graph_id, e.dst)
SELECT n.graph_id, n.node_id, {tidy_sql('a.nb1_value')} AS nb1_value,
  {tidy_sql('b.nb2_value')} AS nb2_value, {tidy_sql('a.nb1_k')} AS nb1_k,
  {tidy_sql('b.nb2_k')} AS nb2_k
FROM nodes n LEFT JOIN hop1 a USING (graph_id, node_id)
LEFT JOIN hop2 b USING (graph_id, node_id)""")
def neighbour_mean_2hop(spark, sf_dir):
    numbered, sizes = stored_nodes(spark, sf_dir)
    means = graphs.context_means(numbered, FEATURES, sizes, k=EDGE_K)
    names = [f"{hop}_{c}" for hop in ("nb1", "nb2") for c in FEATURES]
    return means.select("graph_id", "node_id", *[tidy(c) for c in names])
