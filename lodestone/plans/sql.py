"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

from lodestone.functions import BLOOM, BLOOM_ENTRIES
from lodestone.operators.events import SCENARIOS, Scenario


def d(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def top(source: str, by: str, k: int, order: str = "dist, id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order})::INT AS rk FROM {source}) WHERE rk <= {k}"


def pruned(name: str, candidates: str, r: int = 6, alpha: float = 1.2) -> str:
    """Common tables {name}_c, {name}_p and {name}: the pruning fold over candidates (src, dst, dist)."""
    return f"""{name}_c AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rk FROM ({candidates})),
    {name}_p AS (SELECT DISTINCT src, 0::BIGINT AS rk, []::BIGINT[] AS sel FROM {name}_c UNION ALL
      SELECT p.src, c.rk, CASE WHEN len(p.sel) >= {r} OR EXISTS (SELECT 1 FROM dd x WHERE x.src = c.dst AND list_contains(p.sel, x.dst) AND {alpha}::DOUBLE * x.dist <= c.dist)
        THEN p.sel ELSE list_append(p.sel, c.dst) END FROM {name}_p p JOIN {name}_c c ON c.src = p.src AND c.rk = p.rk + 1),
    {name}_s AS (SELECT src, arg_max(sel, rk) AS sel FROM {name}_p GROUP BY src),
    {name} AS (SELECT s.src, (list_position(s.sel, c.dst))::INT AS ord, c.dst, c.dist FROM {name}_s s JOIN {name}_c c ON c.src = s.src AND list_contains(s.sel, c.dst))"""


LOG_TYPE = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'query' END"

#: name -> (what it needs, its body)
TABLES: dict[str, tuple[str, str]] = {
    "v": ("", "SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS vec, label FROM embeddings"),
    "q": ("v", "SELECT id AS qid, vec AS qvec FROM v WHERE id % 20 = 0"),
    "dead": ("v", "SELECT id FROM v WHERE id % 7 = 3"),
    "fresh": ("v", "SELECT * FROM v WHERE id % 5 = 4"),
    "static": ("v", "SELECT * FROM v WHERE id % 5 <> 4"),
    "qd": ("q", f"SELECT qid, id, label, {d('qvec', 'vec')} AS dist FROM q, v"),
    "dd": ("v", f"SELECT a.id AS src, b.id AS dst, {d('a.vec', 'b.vec')} AS dist FROM v a, v b WHERE a.id <> b.id"),
    "edges": ("dd", top("dd", "src", 8, "dist, dst")),
    "cand": ("dd", top("dd", "src", 32, "dist, dst")),
    "log": ("", f"SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, epoch_us(ts) AS t, {LOG_TYPE} AS type, event_id % 500 AS id, value FROM events"),
    "truth": ("qd", top("qd", "qid", 10)),
    "approx": ("qd", top("(SELECT * FROM qd WHERE label <> 3)", "qid", 10)),
    "indeg": ("edges", "SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN edges e ON e.dst = v.id GROUP BY v.id"),
    "hop2": ("edges", "SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.dst = b.dst)"),
    "hit": ("edges dead", "SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM dead) AND src NOT IN (SELECT id FROM dead)"),
    "liveset": ("log", "SELECT id FROM log WHERE type <> 'query' GROUP BY id HAVING arg_max(type, seq) = 'insert'"),
    "piv": ("v", "SELECT c.c::INT AS chunk, id::INT AS code, vec[8 * c.c + 1 : 8 * c.c + 8] AS sub FROM v, range(8) c(c) WHERE id < 16"),
    "codes": ("piv", f"SELECT id, chunk, arg_min(code, {{'d': {d('vec[8 * chunk + 1 : 8 * chunk + 8]', 'sub')}, 'c': code}}) AS code FROM v, piv GROUP BY id, chunk"),
    "pqt": ("piv q", f"SELECT qid, chunk, code, {d('qvec[8 * chunk + 1 : 8 * chunk + 8]', 'sub')} AS d2 FROM q, piv"),
    "adc": ("codes pqt", "SELECT qid, id, round(sum(d2), 9) AS dist FROM codes JOIN pqt USING (chunk, code) GROUP BY qid, id"),
    "nrm": ("v", f"SELECT id, vec, label, sqrt({ip('vec', 'vec')}) AS n FROM v"),
    "mb": ("nrm", f"SELECT id, vec, list_append(list_transform(vec, lambda x: x / m), sqrt(greatest(0, 1 - {ip('vec', 'vec')} / (m * m)))) AS u FROM nrm, (SELECT max(n) AS m FROM nrm)"),
    "mq": ("nrm", "SELECT id AS qid, vec AS qvec, list_append(list_transform(vec, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END), 0) AS w FROM nrm WHERE id % 20 = 0"),
    "victim": ("log liveset", """SELECT id, max(CASE WHEN type = 'insert' THEN seq END) AS born,
        greatest(max(CASE WHEN type = 'insert' THEN seq END), coalesce(max(CASE WHEN type = 'query' THEN seq END), 0)) AS used FROM log WHERE id IN (SELECT id FROM liveset) GROUP BY id"""),
    "nb": ("edges qd", "SELECT qd.qid, e.src, list({'d': qd.dist, 'id': qd.id}) AS l FROM edges e JOIN qd ON qd.id = e.dst GROUP BY qd.qid, e.src"),
    "nblive": ("edges qd dead", "SELECT qd.qid, e.src, list({'d': qd.dist, 'id': qd.id}) FILTER (WHERE qd.id NOT IN (SELECT id FROM dead)) AS l FROM edges e JOIN qd ON qd.id = e.dst GROUP BY qd.qid, e.src"),
    **{f"tc{k}": (f"tp{k}", f"SELECT id, chunk, arg_min(code, {{'d': {d('vec[8 * chunk + 1 : 8 * chunk + 8]', 'sub')}, 'c': code}}) AS code FROM v, tp{k} GROUP BY id, chunk") for k in (0, 1, 2)},
    **{f"tp{k + 1}": (f"tc{k}", f"""SELECT chunk, code, coalesce(mean, sub) AS sub FROM tp{k} LEFT JOIN (SELECT chunk, code, list(x ORDER BY i) AS mean FROM (
        SELECT chunk, code, i, round(avg(vec[8 * chunk + i]), 9) AS x FROM tc{k} JOIN v USING (id), range(1, 9) r(i) GROUP BY ALL) GROUP BY ALL) USING (chunk, code)""") for k in (0, 1)},
    "tp0": ("piv", "SELECT chunk, code, sub FROM piv"),
    "tadc": ("tc2 q", f"SELECT qid, id, round(sum({d('qvec[8 * chunk + 1 : 8 * chunk + 8]', 'sub')}), 9) AS dist FROM tc2 JOIN tp2 USING (chunk, code), q GROUP BY qid, id"),
    "nbpq": ("edges tadc dead", "SELECT p.qid, e.src, list({'d': p.dist, 'id': p.id}) FILTER (WHERE p.id NOT IN (SELECT id FROM dead)) AS l FROM edges e JOIN tadc p ON p.id = e.dst GROUP BY p.qid, e.src"),
    "sedges": ("dd", top("(SELECT * FROM dd WHERE src % 5 <> 4 AND dst % 5 <> 4)", "src", 8, "dist, dst")),
    "nbstatic": ("sedges qd dead", "SELECT qd.qid, e.src, list({'d': qd.dist, 'id': qd.id}) FILTER (WHERE qd.id NOT IN (SELECT id FROM dead)) AS l FROM sedges e JOIN qd ON qd.id = e.dst GROUP BY qd.qid, e.src"),
    "num": ("v", "SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM v"),
    "near8": ("edges", "SELECT src, list_sort(list(dst)) AS nbrs FROM edges GROUP BY src"),
    "filed": ("num near8", "SELECT num.place AS id, vec[1] AS first, vec[64] AS last, array_to_string(nbrs, ',') AS nbrs FROM num JOIN near8 ON near8.src = num.id"),
    "qat": ("truth", "SELECT dense_rank() OVER (ORDER BY qid) - 1 AS place, rk, id, dist FROM truth"),
    "streamed": ("log static liveset", "SELECT id FROM static WHERE id NOT IN (SELECT id FROM log WHERE type <> 'query' GROUP BY id HAVING arg_max(type, seq) = 'delete') UNION SELECT id FROM liveset"),
    "recent": ("log", "SELECT seq, id FROM log WHERE type = 'insert' ORDER BY seq DESC LIMIT 10"),
}


def sql(needs: str, body: str, extra: str = "") -> str:
    """body with the tables that it needs before it; extra are further tables."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in TABLES[name][0].split():
            need(other)
        if name not in order:
            order.append(name)

    for n in needs.split():
        need(n)
    parts = [f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in order]
    parts += [extra] if extra else []
    return f"WITH {'RECURSIVE ' if extra else ''}{', '.join(parts)} {body}" if parts else body


def exploded(select: str, column: str, source: str) -> str:
    return f"SELECT {select}, (i - 1)::INT AS pos, round({column}[i], 9) + 0.0 AS x FROM {source}, range(1, 66) r(i) WHERE i <= len({column})"


def walk(neighbours: str, beam: int = 10, distances: str = "qd", start: str = "7", g: str = "g") -> str:
    """Table g: the states of a best-first walk of every query from the node start."""
    return f"""{g}(qid, step, wl, seen, parent) AS (
      SELECT qid, 0, [{{'d': dist, 'id': id}}], []::BIGINT[], id FROM {distances} WHERE id = {start} UNION ALL
      SELECT qid, step + 1, wl, seen, (list_filter(wl, lambda w: NOT list_contains(seen, w.id))[1]).id FROM (
        SELECT {g}.qid, {g}.step, list_append({g}.seen, {g}.parent) AS seen, list_sort(list_distinct(list_concat({g}.wl, coalesce(n.l, []))))[1:{beam}] AS wl
        FROM {g} LEFT JOIN {neighbours} n ON n.qid = {g}.qid AND n.src = {g}.parent WHERE {g}.parent IS NOT NULL))"""


def lists(name: str, edges: str, distances: str) -> str:
    """Table name: each node's partners with their distance to each query; every node of edges has a row, if only of NULL."""
    return f"""{name} AS (SELECT z.qid, e.src, list({{'d': x.dist, 'id': x.id}}) FILTER (WHERE x.id IS NOT NULL) AS l
      FROM {edges} e CROSS JOIN (SELECT DISTINCT qid FROM {distances}) z LEFT JOIN {distances} x ON x.qid = z.qid AND x.id = e.dst GROUP BY z.qid, e.src)"""


def medoid(name: str, vectors: str) -> str:
    """Tables {name}_m, the mean of vectors, and name, the id of the vector nearest to it."""
    return f"""{name}_m AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(vec[i]) AS x FROM {vectors}, range(1, 65) r(i) GROUP BY i)),
    {name} AS (SELECT arg_min(id, {{'d': round({d("vec", "mean")}, 12), 'id': id}}) AS id FROM {vectors}, {name}_m)"""


EXPANDED = "(SELECT qid AS src, unnest(arg_max(seen, step)) AS dst FROM g GROUP BY qid)"  # of the walk g


def inserted(old: str, o: str = "o", x: str = "x", expanded: str = EXPANDED) -> str:
    """Tables o and x: pruned edges of what a walk has found for new nodes, and those of the nodes of old that they lead to."""
    return (
        pruned(o, f"SELECT dd.* FROM dd JOIN {expanded} USING (src, dst)") + ", "
        + pruned(x, f"SELECT dd.* FROM dd JOIN (SELECT src, dst FROM {old} WHERE src IN (SELECT dst FROM {o}) UNION SELECT dst, src FROM {o}) USING (src, dst)")
    )


def after(old: str, o: str, x: str) -> str:
    """The edges of old after o and x have come."""
    return f"SELECT src, ord, dst, dist FROM {old} WHERE src NOT IN (SELECT dst FROM {o}) UNION ALL SELECT src, ord, dst, dist FROM {o} UNION ALL SELECT src, ord, dst, dist FROM {x}"


def found_by(g: str, gone: str = "NULL") -> str:
    """What the walk g has expanded, without ids in gone."""
    return f"(SELECT src, dst FROM (SELECT qid AS src, unnest(arg_max(seen, step)) AS dst FROM {g} GROUP BY qid) WHERE dst NOT IN (SELECT id FROM {gone}))" if gone != "NULL" else f"(SELECT qid AS src, unnest(arg_max(seen, step)) AS dst FROM {g} GROUP BY qid)"


def grown(rounds: int) -> str:
    """Tables b0 to b{rounds}: the graph after each batch of growing by doubling, ids modulo a power of two."""
    parts = [f"s0 AS (SELECT * FROM v WHERE id % {1 << rounds} = 0)", pruned("b0", "SELECT src, dst, dist FROM (" + top(f"(SELECT * FROM dd WHERE src % {1 << rounds} = 0 AND dst % {1 << rounds} = 0)", "src", 32, "dist, dst") + ")"), medoid("m", "s0")]
    for i in range(1, rounds + 1):
        so_far, batch = (f"{{0}} % {1 << rounds} < {1 << i - 1}", f"{{0}} % {1 << rounds} BETWEEN {1 << i - 1} AND {(1 << i) - 1}")
        parts += [
            f"fd{i} AS (SELECT src AS qid, dst AS id, dist FROM dd WHERE {batch.format('src')} AND {so_far.format('dst')})",
            lists(f"nf{i}", f"b{i - 1}", f"fd{i}"), walk(f"nf{i}", 24, f"fd{i}", "(SELECT id FROM m)", f"g{i}"),
            inserted(f"b{i - 1}", f"o{i}", f"x{i}", found_by(f"g{i}")), f"b{i} AS ({after(f'b{i - 1}', f'o{i}', f'x{i}')})",
        ]
    return ", ".join(parts)


def streamed_graph(parts: int = 2) -> str:
    """Tables b{i}, the graph after each part of the log, r, the answers, of an index over static that inserts of id mod 5 = 4 and deletes of id mod 7 = 3 change."""
    out = ["ad AS (SELECT src AS qid, dst AS id, dist FROM dd UNION ALL SELECT id, id, 0 FROM v)", "sd AS (SELECT * FROM dd WHERE src % 5 <> 4 AND dst % 5 <> 4)",
        pruned("b0", "SELECT src, dst, dist FROM (" + top("sd", "src", 32, "dist, dst") + ")"), medoid("m", "static"), "k0 AS (SELECT id FROM static)", "d0 AS (SELECT id FROM v WHERE FALSE)"]
    for i in range(1, parts + 1):
        p = f"SELECT * FROM log WHERE id IN (SELECT id FROM v) AND seq > (SELECT max(seq) FROM log) * {i - 1} // {parts} AND seq <= (SELECT max(seq) FROM log) * {i} // {parts}"
        out += [
            f"p{i} AS ({p})", f"c{i} AS (SELECT id, arg_max(type, seq) AS type FROM p{i} WHERE type = 'insert' AND id % 5 = 4 OR type = 'delete' AND id % 7 = 3 GROUP BY id)",
            f"n{i} AS (SELECT id FROM c{i} WHERE type = 'insert')", f"k{i} AS (SELECT id FROM k{i - 1} UNION SELECT id FROM n{i})",
            f"d{i} AS (SELECT id FROM (SELECT id FROM d{i - 1} UNION SELECT id FROM c{i} WHERE type = 'delete' AND id IN (SELECT id FROM k{i - 1})) WHERE id NOT IN (SELECT id FROM n{i}))",
            f"gone{i} AS (SELECT id FROM d{i - 1} UNION SELECT id FROM c{i})",
            f"fd{i} AS (SELECT * FROM ad WHERE qid IN (SELECT id FROM n{i}) AND id IN (SELECT id FROM k{i - 1}))", f"lf{i} AS (SELECT * FROM fd{i} WHERE id NOT IN (SELECT id FROM gone{i}))",
            lists(f"nf{i}", f"b{i - 1}", f"lf{i}"), walk(f"nf{i}", 24, f"fd{i}", "(SELECT id FROM m)", f"g{i}"),
            f"e{i} AS (SELECT * FROM b{i - 1} WHERE src NOT IN (SELECT id FROM n{i}) AND dst NOT IN (SELECT id FROM n{i}))",
            inserted(f"e{i}", f"o{i}", f"x{i}", found_by(f"g{i}", f"gone{i}")), f"b{i} AS ({after(f'e{i}', f'o{i}', f'x{i}')})",
            f"fq{i} AS (SELECT * FROM ad WHERE qid IN (SELECT id FROM p{i} WHERE type = 'query' AND id % 20 = 0) AND id IN (SELECT id FROM k{i}))",
            f"lq{i} AS (SELECT * FROM fq{i} WHERE id NOT IN (SELECT id FROM d{i}))", lists(f"nq{i}", f"b{i}", f"lq{i}"), walk(f"nq{i}", 24, f"fq{i}", "(SELECT id FROM m)", f"h{i}"),
            f"""r{i} AS (SELECT p.seq AS qid, rk, w.id, w.dist FROM p{i} p JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rk FROM (
                SELECT qid, w.id, w.d AS dist FROM (SELECT qid, unnest(arg_max(wl, step)) AS w FROM h{i} GROUP BY qid)) WHERE id NOT IN (SELECT id FROM d{i})) w ON w.qid = p.id WHERE p.type = 'query' AND rk <= 10)""",
        ]
    return ", ".join(out)


def fnv(start: int, factor: int) -> str:
    h = f"{start}::UBIGINT"
    for shift in (0, 8, 16, 24):
        h = f"(xor({h}, ((id >> {shift}) & 255)::UBIGINT)::HUGEINT * {factor} % 18446744073709551616::HUGEINT)::UBIGINT"
    return f"({h} % {BLOOM_ENTRIES})::BIGINT"


CSV = "array_to_string(list_sort(list({0})), ',')"
_numbers = {str: "'{}'", float: "{!r}::DOUBLE", int: "{}::INT"}
_scenario_rows = ", ".join("(" + ", ".join(_numbers[type(x)].format(x) for x in (getattr(s, n) for n in Scenario.__dataclass_fields__)) + ")" for s in SCENARIOS)

ORACLE_SQL: dict[str, str] = {
    "q_l2_distance": sql("qd", "SELECT qid, id, dist FROM qd"),
    "q_knn_exact": sql("truth", "SELECT qid, rk, id, dist FROM truth"),
    "q_knn_exact_filtered": sql("qd dead", f"SELECT qid, rk, id, dist FROM ({top('(SELECT * FROM qd WHERE id NOT IN (SELECT id FROM dead))', 'qid', 10)})"),
    "q_fresh_to_static_dist": sql("fresh static", f"SELECT a.id AS fid, b.id AS sid, {d('a.vec', 'b.vec')} AS dist FROM fresh a, static b"),
    "q_fresh_edges": sql("fresh static", f"SELECT src, rk, dst, dist FROM ({top('(SELECT a.id AS src, b.id AS dst, ' + d('a.vec', 'b.vec') + ' AS dist FROM fresh a, static b)', 'src', 8, 'dist, dst')})"),
    "q_topk_rerank": sql("qd", f"SELECT qid, rk, id, dist FROM ({top('(SELECT qd.* FROM qd JOIN rough USING (qid, id))', 'qid', 10)})",
        "rough AS (" + top("(SELECT qid, id, " + d("qvec[1:16]", "vec[1:16]") + " AS dist FROM q, v)", "qid", 40) + ")"),
    "q_normalize": sql("nrm", exploded("id", "u", "(SELECT id, list_transform(vec, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM nrm)")),
    "q_pad_vector": sql("v", "SELECT id, 72::INT AS n_long, 48::INT AS n_short, 0.0::DOUBLE AS last_long, vec[64] AS x63, vec[48] AS last_short FROM v"),
    "q_mips_transform": sql("mb mq", exploded("kind, id", "u", "(SELECT 'base' AS kind, id, u FROM mb UNION ALL SELECT 'query', qid, w FROM mq)")),
    "q_mips_topk": sql("mb mq", f"SELECT qid, rk, id, ip FROM ({top('(SELECT qid, id, round(' + d('w', 'u') + ', 9) AS dist, round(' + ip('qvec', 'vec') + ', 9) AS ip FROM mb, mq)', 'qid', 10)})"),
    "q_delete_filter": sql("edges dead", "SELECT src, dst FROM edges WHERE dst NOT IN (SELECT id FROM dead)"),
    "q_is_deleted": sql("dead", "SELECT id, id IN (SELECT id FROM dead) AS deleted FROM (SELECT id FROM v UNION ALL SELECT * FROM range(1000000, 1000010))"),
    "q_has_edge": sql("edges", "SELECT src, dst, EXISTS (SELECT 1 FROM edges e WHERE e.src = p.src AND e.dst = p.dst OR e.src = p.dst AND e.dst = p.src) AS has_edge FROM (SELECT id AS src, (id * 7 + 1) % 500 AS dst FROM v) p"),
    "q_bloom_hash": sql("v", f"SELECT id, {fnv(*BLOOM[0])} AS h1, {fnv(*BLOOM[1])} AS h2 FROM v"),
    "q_segment_route": sql("v", "SELECT id, CASE WHEN id < n THEN 'static' ELSE 'fresh' END AS segment, CASE WHEN id < n THEN id ELSE id - n END AS place FROM v, (SELECT floor(count(*) * 4 / 5)::BIGINT AS n FROM v)"),
    "q_union_candidates": sql("truth approx", "SELECT qid, id FROM truth UNION SELECT qid, id FROM approx"),
    "q_intersect_topk": sql("truth approx", "SELECT qid, id FROM truth INTERSECT SELECT qid, id FROM approx"),
    "q_except_deleted": sql("dead", "SELECT id FROM v EXCEPT ALL SELECT id FROM dead"),
    "q_mark_deleted": sql("v", "SELECT id FROM v WHERE id % 7 = 3 OR id % 11 = 3"),
    "q_deleted_count": sql("dead", "SELECT count(DISTINCT id) AS n_deleted FROM (SELECT id FROM dead UNION ALL SELECT id FROM dead)"),
    "q_edge_distances": sql("edges", "SELECT src, dst, dist FROM edges"),
    "q_expand_neighbors": sql("edges q", "SELECT src, rk AS ord, dst FROM edges WHERE src IN (SELECT qid FROM q)"),
    "q_adjacency_sorted": sql("edges", f"SELECT src AS id, count(*)::INT AS degree, {CSV.format('dst')} AS nbrs FROM edges GROUP BY src"),
    "q_neighbors_of": sql("edges", "SELECT src AS id, (row_number() OVER (ORDER BY dst) - 1)::INT AS ord, dst AS nbr FROM edges WHERE src = 7"),
    "q_out_degree": sql("edges", "SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id"),
    "q_in_degree": sql("indeg", "SELECT id, degree FROM indeg"),
    "q_prunable_nodes": sql("indeg", "SELECT id FROM indeg WHERE degree > 0"),
    "q_reverse_edges": sql("edges", f"SELECT dst AS id, count(*)::INT AS n, {CSV.format('src')} AS srcs FROM edges GROUP BY dst"),
    "q_degree_histogram": sql("indeg", "SELECT degree, count(*) AS n FROM indeg GROUP BY degree"),
    "q_graph_validate": sql("edges", """SELECT (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE src = dst) AS n_loops,
        (SELECT count(*) FROM (SELECT src FROM edges GROUP BY src HAVING count(*) > 8)) AS n_over, (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT id FROM v)) AS n_lost"""),
    "q_two_hop": sql("hop2", "SELECT src, dst FROM hop2"),
    "q_affected_nodes": sql("hit", "SELECT id FROM hit"),
    "q_bfs_reach": sql("edges", "SELECT id, min(depth) AS depth FROM r GROUP BY id",
        "r(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.id WHERE r.depth < 12)"),
    "q_random_graph": sql("v", "SELECT id AS src, j::INT AS ord, (id * 1103515245 + j * 1299721 + 12345) % n AS dst FROM v, range(1, 9) r(j), (SELECT count(*) AS n FROM v)"),
    "q_robust_prune": sql("cand", "SELECT src, ord, dst, dist FROM p", pruned("p", "SELECT src, dst, dist FROM cand")),
    "q_build_out_edges": sql("hop2", "SELECT src, ord, dst, dist FROM p", pruned("p",
        "SELECT * FROM (" + top("(SELECT dd.* FROM dd JOIN (SELECT src, dst FROM edges UNION SELECT src, dst FROM hop2) USING (src, dst))", "src", 32, "dist, dst") + ")")),
    "q_apply_reverse_edges": sql("cand", "SELECT src, ord, dst, dist FROM p2", pruned("p", "SELECT src, dst, dist FROM cand") + ", "
        + pruned("p2", "SELECT dd.* FROM dd JOIN (SELECT src, dst FROM p UNION SELECT dst, src FROM p) USING (src, dst)")),
    "q_consolidate_candidates": sql("hit", "SELECT src, rk, dst, dist FROM (" + top("(SELECT dd.* FROM dd JOIN (SELECT src, dst FROM near UNION SELECT n.src, l.dst FROM near n JOIN lv l ON l.src = n.dst WHERE n.src <> l.dst) USING (src, dst))", "src", 24, "dist, dst") + ")",
        "lv AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)), near AS (SELECT * FROM lv WHERE src IN (SELECT id FROM hit))"),
    "q_search_step": sql("edges qd dead", "SELECT qd.qid, qd.id, qd.dist FROM edges e JOIN qd ON qd.id = e.dst WHERE e.src = 7 AND e.dst <> 7 AND e.dst NOT IN (SELECT id FROM dead)"),
    "q_greedy_search": sql("nb", """SELECT qid, i::INT AS rk, wl[i].id AS id, wl[i].d AS dist FROM (SELECT qid, arg_max(wl, step) AS wl FROM g GROUP BY qid), range(1, 11) r(i) WHERE i <= len(wl)""", walk("nb")),
    "q_ann_topk": sql("nblive", "SELECT qid, rk, id, dist FROM (" + top("(SELECT s.qid, qd.id, qd.dist FROM (SELECT qid, arg_max(seen, step) AS seen FROM g GROUP BY qid) s JOIN qd ON qd.qid = s.qid AND list_contains(s.seen, qd.id) AND qd.id NOT IN (SELECT id FROM dead))", "qid", 10) + ")", walk("nblive")),
    "q_search_cost": sql("nb qd", """SELECT qid, max(step)::INT AS steps, (SELECT count(DISTINCT x.id)::INT FROM (SELECT 7::BIGINT AS id UNION ALL
        SELECT n.id FROM (SELECT unnest(l).id AS id FROM nb WHERE nb.qid = s.qid AND list_contains(s.seen, nb.src)) n) x) AS evals
        FROM (SELECT qid, max(step) AS step, arg_max(seen, step) AS seen FROM g GROUP BY qid) s GROUP BY qid, seen""", walk("nb")),
    "q_dual_search": sql("nbstatic qd dead", """SELECT qid, rk, id, segment, dist FROM (""" + top("""(SELECT qid, wl[i].id AS id, 'static' AS segment, wl[i].d AS dist FROM (SELECT qid, arg_max(wl, step) AS wl FROM g GROUP BY qid), range(1, 11) r(i) WHERE i <= len(wl)
        UNION ALL SELECT qid, id, 'fresh', dist FROM qd WHERE id % 5 = 4 AND id NOT IN (SELECT id FROM dead))""", "qid", 10) + ")", walk("nbstatic")),
    "q_pq_train": sql("tp2", "SELECT chunk, code, (i - 1)::INT AS pos, round(sub[i], 9) + 0.0 AS x FROM tp2, range(1, 9) r(i)"),
    "q_pq_search": sql("nbpq qd dead", "SELECT qid, rk, id, dist FROM (" + top("(SELECT s.qid, qd.id, qd.dist FROM (SELECT qid, arg_max(seen, step) AS seen FROM g GROUP BY qid) s JOIN qd ON qd.qid = s.qid AND list_contains(s.seen, qd.id) AND qd.id NOT IN (SELECT id FROM dead))", "qid", 10) + ")", walk("nbpq", 10, "tadc")),
    "q_fixed_mix": sql("q fresh dead", """SELECT seq, (seq - 1) * 10 AS t, type, id FROM (SELECT row_number() OVER (ORDER BY k * 2654435761 % 4294967296, k) AS seq, type, id FROM (
        SELECT 'query' AS type, qid AS id, 3 * qid AS k FROM q UNION ALL SELECT 'insert', id, 3 * id + 1 FROM fresh UNION ALL SELECT 'delete', id, 3 * id + 2 FROM dead))"""),
    "q_worklist_merge": sql("qd", "SELECT b.*, n.next_parent FROM (SELECT qid, rk, id, dist, is_new FROM (" + top("m", "qid", 10, "dist, is_new, id") + ")) b LEFT JOIN (SELECT qid, arg_min(id, {'d': dist, 'i': id}) AS next_parent FROM (" + top("m", "qid", 10, "dist, is_new, id") + ") WHERE id % 2 = 1 GROUP BY qid) n USING (qid)",
        "m AS (SELECT qid, id, dist, min(is_new)::INT AS is_new FROM (SELECT qid, id, dist, 0 AS is_new FROM (" + top("(SELECT * FROM qd WHERE label % 2 = 0)", "qid", 8) + ") UNION ALL SELECT qid, id, dist, 1 FROM (" + top("(SELECT * FROM qd WHERE label % 3 = 0)", "qid", 8) + ")) GROUP BY qid, id, dist)"),
    "q_candidate_merge": sql("edges qd", "SELECT qid, rk, id, dist FROM (" + top("(SELECT qd.* FROM qd JOIN (SELECT qid, id FROM (" + top("qd", "qid", 20) + ") UNION SELECT src, dst FROM edges WHERE src % 20 = 0) USING (qid, id))", "qid", 24) + ")"),
    "q_dual_search_exact": sql("qd dead", "SELECT qid, rk, id, CASE WHEN id % 5 = 4 THEN 'fresh' ELSE 'static' END AS segment, dist FROM (" + top("(SELECT * FROM qd WHERE id NOT IN (SELECT id FROM dead))", "qid", 10) + ")"),
    "q_pq_encode": sql("codes", "SELECT id, chunk, code FROM codes"),
    "q_pq_distance_table": sql("pqt", "SELECT qid, chunk, code, d2 FROM pqt"),
    "q_pq_adc_distance": sql("adc", f"SELECT qid, rk, id, dist FROM ({top('adc', 'qid', 10)})"),
    "q_pq_rerank": sql("adc qd", "SELECT qid, rk, id, dist FROM (" + top("(SELECT qd.* FROM qd JOIN (SELECT qid, id FROM (" + top("adc", "qid", 40) + ")) USING (qid, id))", "qid", 10) + ")"),
    "q_recall_at_k": sql("truth approx", "SELECT 10::INT AS k, (SELECT count(*) FROM truth JOIN approx USING (qid, id)) * 100.0::DOUBLE / (count(DISTINCT qid) * 10) AS recall FROM truth"),
    "q_recall_multi_k": sql("truth approx", "SELECT k::INT AS k, (SELECT count(*) FROM truth t JOIN approx a USING (qid, id) WHERE t.rk <= k AND a.rk <= k) * 100.0::DOUBLE / ((SELECT count(DISTINCT qid) FROM truth) * k) AS recall FROM (VALUES (1), (5), (10)) x(k)"),
    "q_recall_per_query": sql("truth approx", "SELECT t.qid, count(a.id) * 100.0::DOUBLE / 10 AS recall FROM truth t LEFT JOIN approx a USING (qid, id) GROUP BY t.qid"),
    "q_recall_ties": sql("truth approx", "SELECT (SELECT count(*) FROM (SELECT qid, id, rank() OVER (PARTITION BY qid ORDER BY round(dist, 1)) AS r FROM qd) g JOIN approx USING (qid, id) WHERE r <= 10) * 100.0::DOUBLE / (count(DISTINCT qid) * 10) AS recall FROM qd"),
    "q_latency_stats": sql("log", "SELECT type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(count(value) / sum(value) * 1000.0, 6) AS qps FROM log GROUP BY type"),
    "q_index_stats": sql("v", """SELECT count(*) - count_if(id % 5 = 4) AS n_static, count_if(id % 5 = 4)::BIGINT AS n_fresh, count_if(id % 7 = 3)::BIGINT AS n_deleted, count(*) - count_if(id % 7 = 3) AS n_active,
        count_if(id % 7 = 3) * 100.0::DOUBLE / count(*) AS pct_deleted, count_if(id % 5 = 4) * 100.0::DOUBLE / floor((count(*) - count_if(id % 5 = 4)) * 0.1::DOUBLE) AS pct_full FROM v"""),
    "q_gather_queries": sql("log q", "SELECT seq, qid, qvec[1] AS first, qvec[64] AS last FROM log JOIN q ON qid = id WHERE type = 'query'"),
    "q_should_consolidate": sql("dead", "SELECT nd AS n_deleted, floor(n * 5 / 100)::BIGINT AS threshold, nd >= floor(n * 5 / 100) AS due FROM (SELECT count(*) AS n FROM v), (SELECT count(*) AS nd FROM dead)"),
    "q_merge_segments": sql("dead", "SELECT id, 'static' AS segment FROM v WHERE id NOT IN (SELECT id FROM dead)"),
    "q_fresh_insert": sql("log static", "SELECT id, seq, place FROM (SELECT id, seq, row_number() OVER (ORDER BY seq) AS place FROM (SELECT id, min(seq) AS seq FROM log WHERE type = 'insert' GROUP BY id)), (SELECT floor(count(*) / 10) AS cap FROM static) WHERE place <= cap"),
    "q_events_normalize": sql("log", "SELECT seq, type, t, id FROM log"),
    "q_events_valid": sql("log v", "SELECT seq, type, log.id FROM log LEFT JOIN (SELECT id, vec FROM v WHERE label <> 3) w ON w.id = log.id WHERE w.vec IS NOT NULL OR type = 'delete'"),
    "q_workload_summary": sql("log", "SELECT type, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM log) AS pct FROM log GROUP BY type"),
    "q_validate_workload": sql("log", """SELECT (SELECT count(*) FROM log) AS n, (SELECT count_if(t < b)::BIGINT FROM (SELECT t, lag(t) OVER (ORDER BY seq) AS b FROM log)) AS n_back,
        (SELECT count(*) FROM log WHERE type NOT IN ('insert', 'delete', 'query')) AS n_type, (SELECT count(*) FROM log WHERE id IS NULL) AS n_id,
        (SELECT count(*) FROM log x WHERE type = 'delete' AND seq < (SELECT coalesce(min(seq), 1000000000) FROM log y WHERE y.id = x.id AND y.type = 'insert')) AS n_orphan_deletes"""),
    "q_ratio_stats": sql("liveset", """SELECT count(*) AS n, count_if(type = 'insert') / count(*) AS insert_ratio, count_if(type = 'delete') / count(*) AS delete_ratio, count_if(type = 'query') / count(*) AS query_ratio,
        (SELECT count(*) FROM (SELECT type, lag(type) OVER (PARTITION BY id ORDER BY seq) AS b FROM log WHERE type <> 'query') WHERE type = 'delete' AND coalesce(b, 'delete') = 'delete') AS n_failed_deletes,
        (SELECT count(*) FROM liveset) AS n_live FROM log"""),
    "q_unique_inserts": sql("log", "SELECT count(DISTINCT id) AS n_ids FROM log WHERE type = 'insert'"),
    "q_live_set_asof": sql("log", "SELECT id FROM log WHERE type <> 'query' AND seq <= (SELECT floor(max(seq) / 2) FROM log) GROUP BY id HAVING arg_max(type, seq) = 'insert'"),
    "q_temporal_knn": sql("log qd", "SELECT seq, rk, id, dist FROM (" + top("(SELECT a.seq, qd.id, qd.dist FROM (SELECT seq, id AS qid FROM log WHERE type = 'query') a JOIN qd USING (qid) JOIN iv ON iv.id = qd.id AND iv.since < a.seq AND (iv.until IS NULL OR a.seq < iv.until))", "seq", 3) + ")",
        "iv AS (SELECT id, seq AS since, until FROM (SELECT id, seq, type, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS until FROM log WHERE type <> 'query') WHERE type = 'insert')"),
    "q_uniform_clock": sql("log", "SELECT seq, count(*) OVER (ORDER BY seq) AS t FROM log"),
    "q_decay_interval": sql("log", "SELECT seq, greatest(1, floor(10.0::DOUBLE / (pow(0.9::DOUBLE, ((seq - 1) % 500)::DOUBLE) + 0.1::DOUBLE))::INT) AS wait FROM log WHERE (seq - 1) // 500 % 2 = 1"),
    "q_cluster_drift": sql("v", exploded("id", "u", "(SELECT id, list_transform(w, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT id, w, sqrt(" + ip("w", "w") + ") AS n FROM (SELECT id, list_transform(list_zip(vec, range(64)), lambda z: z[1] + 0.01::DOUBLE * (label + 1) * (z[2]::INT % 3)) AS w FROM v)))")),
    "q_delete_fifo": sql("victim", "SELECT 'fifo' AS policy, arg_min(id, born) AS id FROM victim"),
    "q_delete_lru": sql("victim", "SELECT 'lru' AS policy, arg_min(id, used) AS id FROM victim"),
    "q_delete_clustered": sql("victim", "SELECT 'clustered_low' AS policy, min(id) AS id FROM victim UNION ALL SELECT 'clustered_high', max(id) FROM victim"),
    "q_zipf_cdf": sql("q", "SELECT qid, i, round(w / sum(w) OVER (), 9) AS p, round(sum(w) OVER (ORDER BY i) / sum(w) OVER (), 9) AS cdf FROM (SELECT qid, i, pow(i::DOUBLE, -1.2::DOUBLE) AS w FROM (SELECT qid, row_number() OVER (ORDER BY qid) AS i FROM q))"),
    "q_recent_inserts": sql("recent", "SELECT seq, id FROM recent"),
    "q_coupled_query": sql("recent q", "SELECT seq, id, query_id, dist FROM (" + top("(SELECT r.seq, v.id, q.qid AS query_id, " + d("v.vec", "q.qvec") + " AS dist FROM recent r JOIN v USING (id), q)", "seq", 1, "dist, query_id") + ")"),
    "q_scenarios": sql("v log", f"""SELECT *, least(floor(n_events * insert_ratio)::BIGINT, n_pool) AS n_inserts, floor(n_events * delete_ratio)::BIGINT AS n_deletes,
        n_events - floor(n_events * insert_ratio)::BIGINT - floor(n_events * delete_ratio)::BIGINT AS n_queries FROM (SELECT *, floor(n_vectors * base_init_ratio)::BIGINT AS n_base, n_vectors - floor(n_vectors * base_init_ratio)::BIGINT AS n_pool
        FROM (VALUES {_scenario_rows}) s({', '.join(Scenario.__dataclass_fields__)}), (SELECT count(*) AS n_vectors FROM v), (SELECT count(*) AS n_events FROM log))"""),
    "q_base_split": sql("v", "SELECT id, CASE WHEN rn <= n THEN 'initial' ELSE 'pool' END AS part FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM v), (SELECT floor(count(*) * 7 / 10) AS n FROM v)"),
    # Files: ids count from 0 in order; elements of files have 32 bits.
    "q_scan_fvecs": sql("num", exploded("place AS id", "vec", "num")),
    # The number is filtered before 1 is taken from it: DuckDB 2.0.0 answers row_number() - 1 < 100 over a materialised table with 99 rows.
    "q_scan_fvecs_first": sql("v", exploded("n - 1 AS id", "vec", "(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM v) WHERE n <= 100)")),
    "q_scan_bin": sql("num", exploded("place AS id", "vec", "num")),
    "q_scan_bin_aligned": sql("num", "SELECT place AS id, (i - 1)::INT AS pos, CASE WHEN i <= 64 THEN round(vec[i], 9) + 0.0 ELSE 0 END AS x FROM num, range(1, 73) r(i)"),
    "q_scan_ivecs": sql("near8", "SELECT place AS id, (i - 1)::INT AS pos, nbrs[i] AS nbr FROM (SELECT row_number() OVER (ORDER BY src) - 1 AS place, nbrs FROM near8), range(1, 9) r(i)"),
    "q_vecs_to_bin": sql("num", exploded("place AS id", "vec", "num")),
    "q_scan_truth": sql("qat", "SELECT place AS qid, rk, id FROM qat"),
    "q_scan_truth_dists": sql("qat", "SELECT place AS qid, rk, id, dist::FLOAT::DOUBLE AS dist FROM qat"),
    "q_scan_truth_sniffed": sql("qat", "SELECT place AS qid, rk, id FROM qat"),
    "q_scan_packed_graph": sql("filed", "SELECT id, first, last, nbrs FROM filed"),
    "q_scan_static": sql("filed", "SELECT id, first, last, nbrs FROM filed"),
    "q_scan_sectors": sql("filed", "SELECT id, first, last, nbrs, n, 64::BIGINT AS dim, 7::BIGINT AS medoid, 292::BIGINT AS node_bytes, 14::BIGINT AS per_sector, (1 + (n + 13) // 14) * 4096 AS file_bytes FROM filed, (SELECT count(*) AS n FROM v)"),
    "q_scan_pq_pivots": sql("piv", "SELECT chunk, code, (i - 1)::INT AS pos, round(sub[i], 9) + 0.0 AS x FROM piv, range(1, 9) r(i)"),
    "q_scan_pq_codes": sql("codes num", "SELECT place AS id, chunk, code, (8 * chunk)::INT AS lo, (8 * chunk + 8)::INT AS hi FROM codes JOIN num USING (id)"),
    "q_metrics_text": sql("fresh dead", """SELECT unnest(['n_static', 'n_fresh', 'n_deleted', 'n_active', 'pct_deleted', 'pct_full']) AS name,
        unnest([(n - f)::DOUBLE, f::DOUBLE, d::DOUBLE, (n - d)::DOUBLE, d * 100.0::DOUBLE / n, f * 100.0::DOUBLE / floor((n - f) * 0.1::DOUBLE)]) AS value
        FROM (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM fresh) AS f, (SELECT count(*) FROM dead) AS d)"""),
    "q_scan_events": sql("log", "SELECT seq, type, t, id FROM log"),
    "q_scan_events_bad": sql("log", "SELECT count_if(seq % 7 = 0 OR seq % 13 = 0)::BIGINT AS n_bad, count_if(seq % 7 = 0)::BIGINT AS n_broken, least(100, count(*)) AS n_first FROM log"),
    "q_sql_functions": sql("edges", "SELECT src, dst, dist FROM edges"),
    "q_gather_vectors": sql("edges q", "SELECT src, dst, vec[1] AS first, vec[64] AS last FROM edges JOIN q ON qid = src JOIN v ON v.id = dst"),
    "q_reverse_union": sql("edges", f"SELECT src, dst, {d('a.vec', 'b.vec')} AS dist FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) JOIN v a ON a.id = src JOIN v b ON b.id = dst"),
    "q_rank_bounds": sql("qd truth", "SELECT qid, count_if(qd.dist < t.dist)::BIGINT AS lower, count_if(qd.dist <= t.dist)::BIGINT AS upper FROM qd JOIN (SELECT qid, dist FROM truth WHERE rk = 5) t USING (qid) GROUP BY qid"),
    "q_epoch_consolidate": sql("dead", "SELECT 2 AS epoch, d AS n_removed, n - d AS n_nodes, 0::BIGINT AS n_loops, 0::BIGINT AS n_lost, 0::BIGINT AS n_over, 0::BIGINT AS n_tombstones FROM (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM dead) AS d)"),
    "q_stream_live": sql("streamed v", "SELECT id, vec[1] AS first FROM streamed JOIN v USING (id)"),
    "q_stream_answers": sql("streamed qd", "SELECT qid, rk, id, dist FROM (" + top("(SELECT seq AS qid, qd.id, dist FROM log JOIN qd ON qd.qid = log.id AND log.type = 'query' JOIN streamed s ON s.id = qd.id)", "qid", 10) + ")"),
    "q_stream_counts": sql("log", """SELECT start, type, count(*) AS n FROM (SELECT t // 86400000000 * 86400000000 AS start, type FROM log), (SELECT max(t) // 1000 * 1000 AS now FROM log)
        WHERE start + 86400000000 <= now - 3600000000 GROUP BY start, type"""),
}
ORACLE_SQL["q_epoch_search"] = ORACLE_SQL["q_ann_topk"]

# Building and upkeep, from the walk to the pruned edges.
ORACLE_SQL["q_insert_batch"] = sql("dd static", "SELECT src, ord, dst, dist FROM b WHERE src NOT IN (SELECT dst FROM o) UNION ALL SELECT src, ord, dst, dist FROM o UNION ALL SELECT src, ord, dst, dist FROM x", ", ".join((
    "sd AS (SELECT * FROM dd WHERE src % 5 <> 4 AND dst % 5 <> 4)", "fd AS (SELECT src AS qid, dst AS id, dist FROM dd WHERE src % 5 = 4 AND dst % 5 <> 4)",
    pruned("b", "SELECT src, dst, dist FROM (" + top("sd", "src", 32, "dist, dst") + ")"), medoid("m", "static"), lists("nf", "b", "fd"), walk("nf", 24, "fd", "(SELECT id FROM m)"), inserted("b"))))
ORACLE_SQL["q_reinsert"] = sql("cand dead", "SELECT src, ord, dst, dist FROM kept WHERE src NOT IN (SELECT dst FROM o) UNION ALL SELECT src, ord, dst, dist FROM o UNION ALL SELECT src, ord, dst, dist FROM x", ", ".join((
    pruned("p", "SELECT src, dst, dist FROM cand"), "kept AS (SELECT * FROM p WHERE dst NOT IN (SELECT id FROM dead) AND NOT (src % 2 = 0 AND src IN (SELECT id FROM dead)))",
    "fd AS (SELECT src AS qid, dst AS id, dist FROM dd WHERE src % 2 = 0 AND src IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead))",
    lists("nf", "p", "fd"), walk("nf", 24, "fd"), inserted("kept"))))
ORACLE_SQL["q_consolidate"] = sql("cand dead", "SELECT src, ord, dst, dist FROM p WHERE src NOT IN (SELECT id FROM dead) AND src NOT IN (SELECT id FROM torn) UNION ALL SELECT src, ord, dst, dist FROM x", ", ".join((
    pruned("p", "SELECT src, dst, dist FROM cand"), "torn AS (SELECT DISTINCT src AS id FROM p WHERE dst IN (SELECT id FROM dead) AND src NOT IN (SELECT id FROM dead))",
    "lv AS (SELECT src, dst FROM p WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)), near AS (SELECT * FROM lv WHERE src IN (SELECT id FROM torn))",
    "c AS (SELECT src, dst, dist FROM (" + top("(SELECT dd.* FROM dd JOIN (SELECT src, dst FROM near UNION SELECT n.src, l.dst FROM near n JOIN lv l ON l.src = n.dst WHERE n.src <> l.dst) USING (src, dst))", "src", 24, "dist, dst") + "))",
    "few AS (SELECT id FROM torn WHERE (SELECT count(*) FROM c WHERE c.src = torn.id) < 6)", "live AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM dead))", medoid("m", "live"),
    "fd AS (SELECT few.id AS qid, live.id, coalesce(dd.dist, 0) AS dist FROM few CROSS JOIN live LEFT JOIN dd ON dd.src = few.id AND dd.dst = live.id)",
    lists("nf", "p", "fd"), walk("nf", 24, "fd", "(SELECT id FROM m)"),
    "more AS (SELECT qid AS src, wl[i].id AS dst FROM (SELECT qid, arg_max(wl, step) AS wl FROM g GROUP BY qid), range(1, 14) r(i) WHERE i <= len(wl))",
    pruned("x", "SELECT src, dst, dist FROM c UNION SELECT dd.* FROM dd JOIN more USING (src, dst)"))))
ORACLE_SQL["q_build_graph"] = sql("dd", "SELECT src, ord, dst, dist FROM b2", grown(2))
ORACLE_SQL["q_refine_graph"] = sql("edges", "SELECT src, ord, dst, dist FROM x", ", ".join((
    "b AS (SELECT * FROM edges WHERE rk <= 6)", "ad AS (SELECT src AS qid, dst AS id, dist FROM dd UNION ALL SELECT id, id, 0 FROM v)", medoid("m", "v"), lists("nf", "b", "ad"), walk("nf", 24, "ad", "(SELECT id FROM m)"),
    pruned("p", f"SELECT dd.* FROM dd JOIN (SELECT src, dst FROM {EXPANDED} UNION SELECT src, dst FROM b) USING (src, dst)"),
    pruned("x", "SELECT dd.* FROM dd JOIN (SELECT src, dst FROM p UNION SELECT dst, src FROM p) USING (src, dst)"))))
ORACLE_SQL["q_stream_graph"] = sql("dd static log", "SELECT qid, rk, id, dist FROM r1 UNION ALL SELECT qid, rk, id, dist FROM r2", streamed_graph())
ORACLE_SQL["q_stream_graph_edges"] = sql("dd static log", "SELECT src, ord, dst, dist FROM b2", streamed_graph())
ORACLE_SQL["q_epoch_upsert"] = sql("cand dead", "SELECT *, (SELECT count(*) FROM dead WHERE id NOT IN (SELECT id FROM n)) AS n_tombstones, (SELECT count(*) FROM v) AS n_vectors FROM (" + after("e", "o", "x") + ")", ", ".join((
    pruned("p", "SELECT src, dst, dist FROM cand"), "n AS (SELECT id FROM v WHERE id % 10 = 3)", "e AS (SELECT * FROM p WHERE src NOT IN (SELECT id FROM n) AND dst NOT IN (SELECT id FROM n))",
    "ad AS (SELECT src AS qid, dst AS id, dist FROM dd WHERE src IN (SELECT id FROM n) UNION ALL SELECT id, id, 0 FROM n)", "gone AS (SELECT id FROM dead UNION SELECT id FROM n)",
    "fd AS (SELECT * FROM ad WHERE id NOT IN (SELECT id FROM gone))", lists("nf", "p", "fd"), walk("nf", 24, "ad"), inserted("e", "o", "x", found_by("g", "gone")))))
ORACLE_SQL["q_repeated_edges"] = ORACLE_SQL["q_greedy_search"]
ORACLE_SQL["q_sharded_search"] = sql("q", "SELECT count(*) AS n_queries, count(*) * 10 AS n_answers, TRUE AS near FROM q")
ORACLE_SQL["q_knn_udtf"] = ORACLE_SQL["q_knn_exact"]
ORACLE_SQL["q_stream_events"] = ORACLE_SQL["q_stream_live"]
ORACLE_SQL["q_deleted_bitmap"] = sql("v", "SELECT id, id % 7 = 3 OR id % 11 = 3 AS deleted, (SELECT count(*) FROM v WHERE id % 7 = 3 OR id % 11 = 3) AS n_deleted FROM v")
ORACLE_SQL["q_stream_state"] = sql("log", """SELECT id, arg_max(type, seq) = 'insert' AS live, max(seq) AS seq, count_if(type = 'insert')::BIGINT AS inserts, count_if(type = 'delete')::BIGINT AS deletes
    FROM log WHERE type <> 'query' AND id IN (SELECT vec_id FROM embeddings) GROUP BY id""")
ORACLE_SQL["q_mips_search"] = sql("mb mq", "SELECT qid, i::INT AS rk, wl[i].id AS id, wl[i].d AS dist FROM (SELECT qid, arg_max(wl, step) AS wl FROM g GROUP BY qid), range(1, 11) r(i) WHERE i <= len(wl)", ", ".join((
    "bm AS MATERIALIZED (SELECT id, list_transform(u, lambda x: round(x, 9) + 0.0) AS u FROM mb)", "qm AS MATERIALIZED (SELECT qid, list_transform(w, lambda x: round(x, 9) + 0.0) AS w FROM mq)",
    f"dm AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, {d('a.u', 'b.u')} AS dist FROM bm a, bm b WHERE a.id <> b.id)", f"qdm AS MATERIALIZED (SELECT qid, id, {d('w', 'u')} AS dist FROM qm, bm)",
    "em AS MATERIALIZED (" + top("dm", "src", 8, "dist, dst") + ")", "nm AS MATERIALIZED (SELECT qdm.qid, e.src, list({'d': qdm.dist, 'id': qdm.id}) AS l FROM em e JOIN qdm ON qdm.id = e.dst GROUP BY qdm.qid, e.src)",
    walk("nm", 10, "qdm"))))
