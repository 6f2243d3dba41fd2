"""Queries of graph discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph
from weft.plans.triple_queries import _GATE, gate
from weft.plans.views import KNOWS
from weft.registry import query

_EDGES = f"edges AS (SELECT DISTINCT doc_url AS src, regexp_replace(o, '#.*$', '') AS dst FROM v_triple WHERE p = '{KNOWS}' AND doc_url <> regexp_replace(o, '#.*$', ''))"
_SEEDS = "seeds AS (SELECT doc_url FROM v_person WHERE c_custkey % 100 = 3)"


def _seeds(v):
    return v.person.filter("c_custkey % 100 = 3").select("doc_url")


@query(f"WITH {_EDGES} SELECT * FROM edges")
def knows_edges(v):
    return graph.knows_edges(v.triple)


@query(f"WITH {_EDGES}, {_SEEDS}, reach(doc_url, depth) AS (SELECT doc_url, 0 FROM seeds UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = doc_url WHERE depth < 3) SELECT doc_url, min(depth) AS depth FROM reach GROUP BY doc_url")
def bfs_expand(v):
    return graph.expand(_seeds(v), graph.knows_edges(v.triple))


@query(f"""WITH {_EDGES}, {_SEEDS}, {_GATE}, reach(doc_url, depth) AS (SELECT doc_url, 0 FROM seeds WHERE doc_url NOT IN (SELECT doc_url FROM gate)
  UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = doc_url WHERE depth < 3 AND dst NOT IN (SELECT doc_url FROM gate)) SELECT doc_url, min(depth) AS depth FROM reach GROUP BY doc_url""")
def reach_with_gate(v):
    return graph.expand(_seeds(v), graph.knows_edges(v.triple), gate=gate(v).select("doc_url").distinct())


def _rounds(budget, outlinks):
    out = f"WITH {_EDGES}, {_SEEDS}, capped AS (SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= {outlinks}),\n"
    out += "l0 AS (SELECT doc_url, doc_url AS root_seed, CAST(NULL AS VARCHAR) AS discovered_from, 0 AS depth FROM seeds)"
    for n in range(1, 4):
        seen = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(n))
        out += f""", f{n} AS (SELECT dst AS doc_url, min((root_seed, src)) AS f FROM l{n - 1} JOIN capped ON src = doc_url
  WHERE dst NOT IN (SELECT doc_url FROM ({seen})) GROUP BY dst),
l{n} AS (SELECT doc_url, f[1] AS root_seed, f[2] AS discovered_from, {n} AS depth FROM f{n}
  QUALIFY row_number() OVER (PARTITION BY f[1] ORDER BY f[2], doc_url) <= {budget} - (SELECT count(*) FROM ({seen}) AS x WHERE x.root_seed = f{n}.f[1] AND x.depth > 0))"""
    return out + " SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3"


@query(_rounds(25, 5))
def bfs_budgeted(v):
    return graph.expand_budgeted(_seeds(v), graph.knows_edges(v.triple), budget=25, outlinks=5)


@query(f"WITH {_EDGES} SELECT src, count(*) AS n, count(*) > 12 AS over FROM edges GROUP BY src")
def fanout_report(v):
    return graph.fanout(graph.knows_edges(v.triple), 12)


@query(f"WITH {_EDGES} SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 8")
def outlink_cap(v):
    return graph.outlink_cap(graph.knows_edges(v.triple), 8)


@query("SELECT c_custkey, doc_url, depth, root_seed, discovered_from FROM (SELECT *, concat('https://c', c_custkey // 2, '.example/card') AS discovered_from FROM v_doc WHERE root_seed IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY root_seed ORDER BY depth, discovered_from, doc_url) <= CAST(substr(root_seed, 5) AS INT)")
def subtree_budget(v):
    parent = F.concat(F.lit("https://c"), F.floor(F.col("c_custkey") / 2), F.lit(".example/card"))
    found = v.doc.select("c_custkey", "doc_url", "depth", "root_seed", parent.alias("discovered_from"))
    budgets = v.doc.filter("root_seed IS NOT NULL").select("root_seed", F.substring("root_seed", 5, 9).cast("int").alias("remaining")).distinct()
    return graph.subtree_budget(found, budgets)


@query("SELECT doc_url FROM (SELECT concat(doc_url, '/new') AS doc_url FROM v_doc ORDER BY 1 LIMIT 1000 - (SELECT count(*) FROM v_doc WHERE state IN ('pending', 'claimed')))")
def frontier_cap(v):
    from weft.operators.crawl import frontier_depth

    live = frontier_depth(v.doc).first()[0]
    return graph.frontier_cap(v.doc.select(F.concat("doc_url", F.lit("/new")).alias("doc_url")), live, 1000)


@query(f"SELECT doc_url AS src, regexp_replace(o, '#.*$', '') AS dst, min(o) AS o FROM v_triple WHERE p = '{KNOWS}' GROUP BY ALL")
def in_doc_dedup(v):
    return graph.first_links(v.triple)


@query(f"WITH {_EDGES} SELECT DISTINCT dst AS doc_url FROM edges WHERE dst NOT IN (SELECT doc_url FROM v_doc WHERE c_custkey % 3 = 0)")
def new_links(v):
    return graph.new_links(graph.knows_edges(v.triple), v.doc.filter("c_custkey % 3 = 0"))
