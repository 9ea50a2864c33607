"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from foldstone.config import CHORD, HOP_NODES, NEAREST, RoutingTable

_LOW = "('0x' || substring(fingerprint, 57, 8))::BIGINT"
BUCKET = f"({_LOW} & 32767)"
KEY = f"(({_LOW} >> 15) & 65535)"
_TOP = "(('0x' || substring(fingerprint, 1, 4))::BIGINT >> 1)"
MASK = "(" + " | ".join(f"(1::BIGINT << (({_TOP} >> {5 * j}) & 31)::INT)" for j in range(3)) + ")"


def pages(table: str, key: str, text: str, keep: str = "", size: int = 8192) -> str:
    """CTE pg: pages as hex, with fingerprints."""
    extra = f", {keep}" if keep else ""
    return f"""cut AS (SELECT {key}{extra}, hex(encode(coalesce({text}, ''))) AS h FROM {table}),
    num AS (SELECT *, unnest(range(0, greatest(1, ceil(length(h) / {size}.0)::BIGINT))) AS i FROM cut),
    pg AS (SELECT {key}{extra}, i::INT AS page_no, ({key} * 1048576 + i)::BIGINT AS seq, sha256(unhex(rpad(substring(h, (i * {size} + 1)::BIGINT, {size}), {size}, '0'))) AS fingerprint FROM num)"""


DOCS = pages("documents", "doc_id", "text", "source, lang")
OPS = """ops AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'ERASEREF' WHEN 'purchase' THEN 'READSSD' ELSE 'WRITE2FREE' END AS op,
    user_id AS host_data_node, (event_id & 4294967295) AS host_lba, sha256(coalesce(props, '')) AS fingerprint FROM events)"""
COUNTED = (
    OPS
    + """,
    sums AS (SELECT *, sum(CASE op WHEN 'WRITE2FREE' THEN 1 WHEN 'ERASEREF' THEN -1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY seq) AS s FROM ops),
    clamped AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY fingerprint ORDER BY seq)) AS ref_count FROM sums),
    prior AS (SELECT *, coalesce(lag(ref_count) OVER (PARTITION BY fingerprint ORDER BY seq), 0) AS prev FROM clamped),
    counted AS (SELECT seq, op, host_data_node, host_lba, fingerprint, ref_count::BIGINT AS ref_count, prev > 0 AS hit,
        op = 'WRITE2FREE' AND prev = 0 AS is_alloc, op = 'ERASEREF' AND prev = 1 AS is_gc FROM prior)"""
)


def owner(h: str, t: RoutingTable) -> str:
    cases = " ".join(f"WHEN ({h} - {s} + {1 << t.bits}) % {1 << t.bits} < {n} THEN {i}" for i, (s, n, _) in reversed(list(enumerate(t.entries))))
    return f"(CASE {cases} END)"


def _min_dist(parts: list[str]) -> str:
    return "list_min([" + ", ".join(f"({p}) * 16 + {i}" for i, p in enumerate(parts)) + "]) % 16"


def nearest(h: str, t: RoutingTable) -> str:
    n = 1 << t.bits
    return _min_dist([f"least(({s} - {h} + {n}) % {n}, ({h} - {(s + k) % n} + {n}) % {n})" for s, k, _ in t.entries])


def _run(tests: list[str]) -> str:
    return "(CASE " + " ".join(f"WHEN NOT ({x}) THEN {max(i - 1, 0)}" for i, x in enumerate(tests)) + f" ELSE {len(tests) - 1} END)"


def chord(h: str, t: RoutingTable) -> str:
    n, a = 1 << t.bits, t.entries[0][0]
    return _run([f"{(s - a) % n} <= ({h} - {a} + {n}) % {n}" for s, _, _ in t.entries])


def channel(h: str, t: RoutingTable) -> str:
    return f"coalesce({owner(h, t)}, {nearest(h, t) if t.mode == 'nearest' else chord(h, t)})"


def result(d: str, t: RoutingTable) -> str:
    n, nodes = 1 << t.node_bits, [x for _, _, x in t.entries]
    if t.mode == "nearest":
        return _min_dist([f"least(({d} - {x} + {n}) % {n}, ({x} - {d} + {n}) % {n})" for x in nodes])
    exact = "CASE " + " ".join(f"WHEN {d} = {x} THEN {i}" for i, x in enumerate(nodes)) + " END"
    return f"coalesce({exact}, {_run([f'{(x - nodes[0]) % n} <= ({d} - {nodes[0]} + {n}) % {n}' for x in nodes])})"


def node_of(ch: str, t: RoutingTable) -> str:
    return f"(CASE {ch} " + " ".join(f"WHEN {i} THEN {x}" for i, (_, _, x) in enumerate(t.entries)) + " END)"


NODE = node_of(channel(KEY, NEAREST), NEAREST)
RESPONSES = (
    COUNTED
    + f""",
    fresh AS (SELECT seq, row_number() OVER (ORDER BY seq) AS lba FROM counted WHERE is_alloc),
    held AS (SELECT c.*, last_value(lba IGNORE NULLS) OVER (PARTITION BY fingerprint ORDER BY c.seq ROWS UNBOUNDED PRECEDING) AS last_lba FROM counted c LEFT JOIN fresh USING (seq)),
    resp AS (SELECT seq, fingerprint, ref_count, (CASE WHEN hit OR is_alloc THEN last_lba ELSE 0 END)::BIGINT AS ssd_lba, {NODE}::INT AS node_idx,
        (CASE WHEN op = 'WRITE2FREE' THEN host_lba ELSE 0 END)::BIGINT AS host_lba_start, 1::BIGINT AS host_lba_len,
        (CASE WHEN op = 'WRITE2FREE' THEN host_data_node ELSE 0 END)::BIGINT AS host_data_node,
        CASE op WHEN 'WRITE2FREE' THEN ref_count = 1 WHEN 'ERASEREF' THEN hit AND ref_count = 0 ELSE true END AS is_exec, op, hit OR is_alloc AS hit FROM held)"""
)
TABLE = COUNTED + ", live AS (SELECT fingerprint, arg_max(ref_count, seq) AS ref_count FROM counted GROUP BY 1 HAVING arg_max(ref_count, seq) > 0)"
FILTERS = TABLE + f", flt AS (SELECT {BUCKET} AS bucket, bit_or({MASK}) AS bloom, count(*) AS entries FROM live GROUP BY 1)"
FPS = "fps AS (SELECT DISTINCT fingerprint FROM pg)"


def hop_sql() -> str:
    n = len(HOP_NODES)
    step = "CASE cur " + " ".join(f"WHEN {i} THEN CASE WHEN {owner('h', t)} = 0 THEN {i} ELSE {node_of(channel('h', t), t)} END" for i, t in HOP_NODES.items()) + " END"
    return f"""WITH RECURSIVE {DOCS}, start AS (SELECT seq, {KEY} AS h, (doc_id % {n})::INT AS src_node FROM pg),
    walk(seq, h, src_node, cur, hops, k) AS (SELECT seq, h, src_node, src_node, 0, 0 FROM start
        UNION ALL SELECT seq, h, src_node, ({step})::INT, hops + (({step}) <> cur)::INT, k + 1 FROM walk WHERE k < {n})
    SELECT seq, h::INT AS h, src_node, cur::INT AS final_node, hops::INT AS hops FROM walk WHERE k = {n}"""


SQL: dict[str, str] = {
    "page_chunks": f"WITH {DOCS} SELECT doc_id, page_no, seq, fingerprint FROM pg",
    "page_chunks_html": f"WITH {pages('pages', 'page_id', 'html')} SELECT page_id, page_no, seq, fingerprint FROM pg",
    "page_fingerprint_sha256": f"WITH {DOCS} SELECT seq, fingerprint FROM pg",
    "op_decode_dispatch": f"WITH {OPS} SELECT seq, op, op = 'WRITE2FREE' AS needs_digest, (CASE WHEN op = 'WRITE2FREE' THEN host_lba ELSE 0 END)::BIGINT AS host_lba_start, 1::BIGINT AS host_lba_len, (CASE WHEN op = 'WRITE2FREE' THEN host_data_node ELSE 0 END)::BIGINT AS host_data_node FROM ops",
    "slice_write_instr": "SELECT conv_id AS instr, turn AS page_no, ((conv_id * 64 + turn - min(turn) OVER (PARTITION BY conv_id)) & 4294967295)::BIGINT AS host_lba, 1::BIGINT AS host_lba_len, sha256(coalesce(text, '')) AS fingerprint FROM conversations",
    "refcount_write_only": f"WITH {DOCS} SELECT seq, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY seq)::BIGINT AS ref_count, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1 AS is_exec FROM pg",
    "refcount_mixed_ops": f"WITH {COUNTED} SELECT seq, op, fingerprint, ref_count, hit, is_alloc, is_gc FROM counted",
    "responses_full": f"WITH {RESPONSES} SELECT * FROM resp",
    "ssd_commands": f"""WITH {RESPONSES} SELECT seq, fingerprint, ref_count, host_data_node AS ssd_node, ssd_lba AS ssd_lba_start, 1::BIGINT AS ssd_lba_len, node_idx,
        CASE op WHEN 'WRITE2FREE' THEN CASE WHEN ref_count = 1 THEN 'WRITE' ELSE 'UPDATEHEADER' END WHEN 'ERASEREF' THEN CASE WHEN ref_count = 0 THEN 'ERASE' ELSE 'UPDATEHEADER' END ELSE 'READ' END AS ssd_op FROM resp WHERE hit""",
    "unique_pages_store": f"WITH {DOCS} SELECT min(seq) AS seq, fingerprint FROM pg GROUP BY 2",
    "alloc_fresh_lba": f"WITH {DOCS}, firsts AS (SELECT fingerprint, min(seq) AS seq FROM pg GROUP BY 1) SELECT fingerprint, seq, row_number() OVER (ORDER BY seq)::BIGINT AS ssd_lba FROM firsts",
    "fp_table_snapshot": f"WITH {RESPONSES}, fin AS (SELECT fingerprint, arg_max(ref_count, seq) AS ref_count, arg_max(ssd_lba, seq) AS ssd_lba, max(node_idx) AS node_idx FROM (SELECT * FROM resp WHERE hit) GROUP BY 1) SELECT fingerprint, ref_count, ssd_lba, {BUCKET} AS bucket, node_idx FROM fin WHERE ref_count > 0",
    "gc_events": f"WITH {COUNTED} SELECT seq, fingerprint FROM counted WHERE is_gc",
    "lookup_vs_snapshot": f"WITH {TABLE} SELECT o.seq, o.fingerprint, coalesce(l.ref_count, 0)::BIGINT AS ref_count, l.ref_count IS NOT NULL AS hit FROM ops o LEFT JOIN live l USING (fingerprint) WHERE op = 'READSSD'",
    "bucket_occupancy": f"WITH {DOCS}, {FPS} SELECT {BUCKET} AS bucket, count(*) AS entries, greatest(count(*) - 8, 0)::BIGINT AS over_size FROM fps GROUP BY 1",
    "bloom_masks": f"WITH {DOCS}, {FPS} SELECT fingerprint, {BUCKET} AS bucket, {MASK} AS mask FROM fps",
    "bloom_filter_per_bucket": f"WITH {FILTERS} SELECT * FROM flt",
    "bloom_probe_skip_rate": f"WITH {FILTERS} SELECT count(*) AS probes, count(*) FILTER (WHERE (coalesce(bloom, 0) & {MASK}) <> {MASK}) AS skipped FROM ops LEFT JOIN flt ON bucket = {BUCKET} WHERE op <> 'WRITE2FREE'",
    "route_owner_inside": f"WITH {DOCS} SELECT seq, {KEY}::INT AS h, coalesce({owner(KEY, NEAREST)}, -1)::INT AS channel FROM pg",
    "route_nearest": f"WITH {DOCS} SELECT seq, {KEY}::INT AS h, ({channel(KEY, NEAREST)})::INT AS channel, {node_of(channel(KEY, NEAREST), NEAREST)}::INT AS node_idx FROM pg",
    "route_chord": f"WITH {DOCS} SELECT seq, {KEY}::INT AS h, ({channel(KEY, CHORD)})::INT AS channel, {node_of(channel(KEY, CHORD), CHORD)}::INT AS node_idx FROM pg",
    "route_result_nearest": f"SELECT event_id AS seq, (user_id % 16)::INT AS dst_node, ({result('(user_id % 16)', NEAREST)})::INT AS channel FROM events",
    "route_result_chord": f"SELECT event_id AS seq, (user_id % 16)::INT AS dst_node, ({result('(user_id % 16)', CHORD)})::INT AS channel FROM events",
    "route_multi_hop": hop_sql(),
    "deal_round_robin": f"WITH {DOCS} SELECT seq, fingerprint, (((row_number() OVER (ORDER BY seq) - 1) // 2) % 4)::INT AS channel FROM pg",
    "node_load": f"WITH {DOCS} SELECT {NODE}::INT AS node_idx, count(*) AS pages, count(DISTINCT fingerprint) AS fingerprints FROM pg GROUP BY 1",
    "merge_local_remote": f"WITH {OPS} SELECT seq, op, fingerprint, (user_node % 4)::INT AS src_node, user_node % 4 = 0 AS is_local FROM (SELECT *, host_data_node AS user_node FROM ops)",
    "in_order_retire": f"WITH {COUNTED} SELECT row_number() OVER (ORDER BY seq)::BIGINT AS slot, seq, op, ref_count FROM counted",
    "dedup_ratio_by_source": f"WITH {DOCS} SELECT source, count(*) AS pages, count(DISTINCT fingerprint) AS unique_pages, (count(*) - count(DISTINCT fingerprint)) * 4096 AS bytes_saved, count(*)::DOUBLE / count(DISTINCT fingerprint) AS dedup_ratio FROM pg GROUP BY 1",
    "refcount_histogram": f"WITH {DOCS}, c AS (SELECT fingerprint, count(*) AS ref_count FROM pg GROUP BY 1) SELECT ref_count, count(*) AS fingerprints FROM c GROUP BY 1",
    "page_lives": f"WITH {COUNTED}, c AS (SELECT fingerprint, arg_max(ref_count, seq) AS n, bool_or(is_alloc) AS stored FROM counted GROUP BY 1) SELECT count(*) FILTER (WHERE stored) AS unique_pages, count(*) FILTER (WHERE n > 0) AS live_pages, count(*) FILTER (WHERE stored AND n = 0) AS dead_pages FROM c",
    "cross_source_overlap": f"WITH {DOCS}, c AS (SELECT fingerprint, count(DISTINCT source) AS sources, count(*) AS pages FROM pg GROUP BY 1) SELECT fingerprint, sources, pages FROM c WHERE sources > 1",
    "storage_op_mix": f"WITH {RESPONSES} SELECT op, is_exec, hit, count(*) AS ops FROM resp GROUP BY ALL",
    "read_back_pages": f"WITH {COUNTED}, lives AS (SELECT fingerprint, seq AS stored_seq FROM counted WHERE is_alloc) SELECT r.seq, r.fingerprint, (CASE WHEN r.hit THEN l.stored_seq END)::BIGINT AS stored_seq FROM counted r ASOF LEFT JOIN lives l ON r.fingerprint = l.fingerprint AND r.seq >= l.stored_seq WHERE r.op = 'READSSD'",
    "stream_refcount": f"WITH {COUNTED} SELECT seq, op, fingerprint, ref_count, hit FROM counted",
}
