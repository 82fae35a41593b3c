"""DuckDB SQL that gives the same rows as the queries of this package."""

from __future__ import annotations

from lodestar.plans import queries as q

BASE = "base AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS qid, v AS qv FROM base WHERE id % 20 = 0)"
IP = "1 - list_inner_product(qv, v)"
L2 = "list_sum(list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
NORM = "(sqrt(list_inner_product({0}, {0})) + 1e-30)"
COSINE = f"1 - list_inner_product(qv, v) / ({NORM.format('qv')} * {NORM.format('v')})"


def sql(*ctes: str, final: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + final


def top(pairs: str, k: int = q.K, extra: str = "") -> str:
    """The k nearest of (qid, id, dist) with ranks."""
    return (
        f"SELECT qid, id, rank, round(dist, 4) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM ({pairs})) "
        f"WHERE rank <= {k} {extra}"
    )


def all_pairs(dist: str, where: str = "true") -> str:
    return f"SELECT qid, id, {dist} AS dist FROM q, base WHERE {where}"


def kmeans(metric: str, iterations: int, empty: str, name: str = "c") -> list[str]:
    """CTEs <name>0..: centroids (cid, cv); a<name>t: assignment (id, cid) under the centroids of step t."""
    n, d = "(SELECT count(*) FROM base)", q.DIM
    order = "list_inner_product(b.v, c.cv) DESC" if metric == "ip" else L2.replace("qv", "b.v").replace(", v)", ", c.cv)")
    out = [f"{name}0 AS (SELECT r.cid, b.v AS cv FROM (SELECT unnest(range({q.NLIST})) AS cid) r JOIN base b ON b.id = (r.cid * 9973) % {n})"]
    for t in range(iterations + 1):
        out.append(
            f"a{name}{t} AS (SELECT id, cid FROM (SELECT b.id, c.cid, row_number() OVER (PARTITION BY b.id ORDER BY {order}, c.cid) AS r FROM base b, {name}{t} c) WHERE r = 1)"
        )
        if t < iterations:
            fill = f"list_transform(range({d}), lambda x: 0.0::DOUBLE)" if empty == "zero" else f"(SELECT b.v FROM base b WHERE b.id = ({t + 1}::BIGINT * 1315423911 + e.cid::BIGINT * 2654435761) % {n})"
            out.append(
                f"{name}{t + 1} AS (SELECT e.cid, coalesce(m.cv, {fill}) AS cv FROM (SELECT unnest(range({q.NLIST})) AS cid) e LEFT JOIN "
                f"(SELECT cid, list(x ORDER BY d) AS cv FROM (SELECT a.cid, r.d, avg(b.v[r.d]) AS x FROM a{name}{t} a JOIN base b USING (id), (SELECT unnest(range(1, {d + 1})) AS d) r GROUP BY a.cid, r.d) GROUP BY cid) m USING (cid))"
            )
    return out


T = q.ITERATIONS
IVF = kmeans("ip", T, "reseed")
LISTS = f"lists AS (SELECT id, cid FROM ac{T})"
SCORES = f"scores AS (SELECT qid, cid, list_inner_product(qv, cv) AS score, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(qv, cv) DESC, cid) AS rank FROM q, c{T})"


def probes(n: int = q.NPROBE) -> str:
    return f"probes AS (SELECT * FROM scores WHERE rank <= {n})"


def adaptive(low: int, high: int, tau: float, coverage: float, name: str = "probes") -> str:
    weights = f"SELECT *, exp((score - max(score) OVER (PARTITION BY qid)) / {tau}) AS w FROM scores WHERE rank <= {high}"
    shares = f"SELECT *, w / sum(w) OVER (PARTITION BY qid) AS s FROM ({weights})"
    cum = f"SELECT *, coalesce(sum(s) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({shares})"
    return f"{name} AS (SELECT qid, cid, score, rank FROM ({cum}) WHERE rank <= {low} OR before < {coverage})"


def probed_pairs(dist: str = IP, table: str = "probes") -> str:
    return f"SELECT qid, id, {dist} AS dist FROM {table} p JOIN lists USING (cid) JOIN base USING (id) JOIN q USING (qid)"


FIXED = (BASE, *IVF, LISTS, SCORES, probes())
SIZES = "sizes AS (SELECT cid, count(*) AS n FROM lists GROUP BY cid)"

# scalar quantization
SCALE = "s AS (SELECT 127.0::DOUBLE / max(list_max(list_transform(v, lambda x: abs(x)))) AS scale FROM base)"
CODE = "list_transform({0}, lambda x: greatest(-128, least(127, round(x * scale)))::INTEGER)"
SQ = (
    BASE,
    SCALE,
    f"codes AS (SELECT id, {CODE.format('v')} AS code FROM base, s)",
    f"qcodes AS (SELECT qid, {CODE.format('qv')} AS qcode FROM q, s)",
    "short AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(qcode::DOUBLE[], code::DOUBLE[]) DESC, id) AS r "
    f"FROM qcodes, codes) WHERE r <= {q.SQ_NPROBE})",
)
RERANKED = f"SELECT qid, id, {IP} AS dist FROM short JOIN base USING (id) JOIN q USING (qid)"

# product quantization
M, KS, SUB = q.PQ_M, q.PQ_KS, q.DIM // q.PQ_M
PART = "{0}[m * " + str(SUB) + " + 1 : m * " + str(SUB) + " + " + str(SUB) + "]"
BOOK = (
    f"book AS (SELECT m, k, {PART.format('b.v')} AS w FROM (SELECT unnest(range({M})) AS m), (SELECT unnest(range({KS})) AS k), base b "
    f"WHERE b.id = ((m * {KS} + k) * 9973 + 42) % (SELECT count(*) FROM base))"
)
PQ_CODES = (
    "pqcodes AS (SELECT id, m, k FROM (SELECT b.id, m, k, row_number() OVER (PARTITION BY b.id, m ORDER BY "
    f"list_inner_product({PART.format('b.v')}, w) DESC, k) AS r FROM base b, book) WHERE r = 1)"
)
LUT = f"lut AS (SELECT qid, m, k, list_inner_product({PART.format('qv')}, w) AS x FROM q, book)"


SHARE, SHARE_OF_PART = (f"(SELECT greatest({q.K}, count(*) // {q.SHORT_SHARE * n}) FROM base)" for n in (1, q.PARTS))


def shortlist(pairs: str, keep: str, score: str = "sum(x)", more: str = "") -> str:
    """short: the ``keep`` best of each qid by the table score over the codes of (qid, id) in ``pairs``."""
    return (
        f"short AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid{more} ORDER BY dist, id) AS r FROM "
        f"(SELECT qid, id{more}, 1 - {score} AS dist FROM ({pairs}) p JOIN pqcodes USING (id) JOIN lut USING (qid, m, k) GROUP BY qid, id{more})) WHERE r <= {keep})"
    )


PAIRS = "pairs AS (SELECT qid, id, cid FROM probes JOIN lists USING (cid))"

# residual product quantization
S, N = q.RESIDUAL_SAMPLES, "(SELECT count(*) FROM base)"


RSUB = q.DIM // q.RESIDUAL_M
RPART = "{0}[m * " + str(RSUB) + " + 1 : m * " + str(RSUB) + " + " + str(RSUB) + "]"


def residual(iterations: int) -> list[str]:
    gap = "list_sum(list_transform(list_zip(r.x, w.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = [
        f"res AS (SELECT b.id, l.cid, list_transform(list_zip(b.v, c.cv), lambda p: p[1] - p[2]) AS r FROM base b JOIN lists l USING (id) JOIN c{T} c USING (cid))",
        f"samples AS (SELECT i, m, {RPART.format('res.r')} AS x FROM (SELECT unnest(range({S})) AS i) JOIN res ON res.id = (i * 9973 + 123) % {N}, (SELECT unnest(range({q.RESIDUAL_M})) AS m))",
        f"w0 AS (SELECT m, k, x AS w FROM (SELECT unnest(range({q.RESIDUAL_KS})) AS k) JOIN samples ON i = k % {S})",
    ]
    for t in range(iterations):
        out.append(f"n{t} AS (SELECT * FROM (SELECT r.i, r.m, r.x, w.k, row_number() OVER (PARTITION BY r.i, r.m ORDER BY {gap}, w.k) AS o FROM samples r JOIN w{t} w USING (m)) WHERE o = 1)")
        out.append(
            f"w{t + 1} AS (SELECT o.m, o.k, coalesce(n.w, o.w) AS w FROM w{t} o LEFT JOIN (SELECT m, k, list(a ORDER BY d) AS w FROM "
            f"(SELECT m, k, d, avg(x[d]) AS a FROM n{t}, (SELECT unnest(range(1, {RSUB + 1})) AS d) GROUP BY m, k, d) GROUP BY m, k) n USING (m, k))"
        )
    out.append(
        "pqcodes AS (SELECT id, m, k FROM (SELECT r.id, r.m, w.k, row_number() OVER (PARTITION BY r.id, r.m ORDER BY "
        f"{gap}, w.k) AS o FROM (SELECT id, m, {RPART.format('r')} AS x FROM res, (SELECT unnest(range({q.RESIDUAL_M})) AS m)) r JOIN w{iterations} w USING (m)) WHERE o = 1)"
    )
    out.append(f"lut AS (SELECT qid, m, k, list_inner_product({RPART.format('qv')}, w) AS x FROM q, w{iterations})")
    return out


RESIDUAL = (*FIXED, *residual(3), PAIRS)
RESIDUAL_DIST = (
    "SELECT qid, id, 1 - (any_value(score) + sum(x)) AS dist FROM pairs JOIN scores USING (qid, cid) JOIN pqcodes USING (id) JOIN lut USING (qid, m, k) GROUP BY qid, id"
)

# partitions
P = q.PARTS


def halves(x: str, factor: int) -> str:
    """x * factor mod 2**64 without overflow, by the halves of x."""
    high, low = factor >> 32, factor % (1 << 32)
    xl, xh = f"({x} % 4294967296)", f"({x} // 4294967296)"
    return f"(({xl} * {low}) + (({xl} * {high} + {xh} * {low}) % 4294967296) * 4294967296) % 18446744073709551616"


def hash_owner() -> str:
    fold = lambda x: f"xor({x}, {x} >> 33)"
    return (
        f"SELECT id, (x5 % {P})::BIGINT AS part FROM (SELECT id, {fold('x4')} AS x5 FROM (SELECT id, {halves('x3', 0xC4CEB9FE1A85EC53)} AS x4 FROM "
        f"(SELECT id, {fold('x2')} AS x3 FROM (SELECT id, {halves('x1', 0xFF51AFD7ED558CCD)} AS x2 FROM (SELECT id, {fold('x0')} AS x1 FROM (SELECT id, id::UHUGEINT AS x0 FROM base))))))"
    )


BLOCK = f"CASE WHEN id < (n // {P} + 1) * (n % {P}) THEN id // (n // {P} + 1) ELSE n % {P} + (id - (n // {P} + 1) * (n % {P})) // (n // {P}) END"
BLOCKS = f"parted AS (SELECT id, v, ({BLOCK})::BIGINT AS part FROM base, (SELECT count(*) AS n FROM base))"


def sweep() -> str:
    ctes, rows = [BASE, *IVF, LISTS, SCORES, SIZES, f"truth AS ({top(all_pairs(IP)).replace('round(dist, 4) + 0.0 AS dist', 'dist')})"], []
    grid = [("fixed", n, 0.0, 0.0) for n in q.SWEEP_NPROBE] + [("adaptive", 0, t, c) for t in q.SWEEP_TAU for c in q.SWEEP_COVERAGE]
    for i, (method, nprobe, tau, coverage) in enumerate(grid):
        name = f"p{i}"
        ctes.append(f"{name} AS (SELECT * FROM scores WHERE rank <= {nprobe})" if method == "fixed" else adaptive(2, 16, tau, coverage, name))
        ctes.append(f"r{i} AS ({top(probed_pairs(table=name))})")
        hits = f"(SELECT count(*) FROM r{i} JOIN truth USING (qid, id))"
        per = f"(SELECT qid, count(*) AS np, sum(n) AS cand FROM {name} JOIN sizes USING (cid) GROUP BY qid)"
        rows.append(
            f"SELECT '{method}' AS method, {nprobe}::BIGINT AS nprobe, {tau}::DOUBLE AS tau, {coverage}::DOUBLE AS coverage, "
            f"round({hits} / ((SELECT count(*) FROM q) * {q.K}.0::DOUBLE), 6) AS recall, round(avg(np), 6) AS probes, round(avg(cand), 6) AS candidates FROM {per}"
        )
    return sql(*ctes, final=" UNION ALL ".join(rows))


DOCS = (
    BASE,
    f"pairs AS (SELECT qid, id // 5 AS doc_id, id, {L2} AS dist FROM q, base)",
    "firsts AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS place FROM (SELECT qid, doc_id, id, dist FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY dist, id) AS r FROM pairs) WHERE r = 1))",
)
BYTE = "list_transform({0}, lambda x: floor((x + 1) * 127.5))"

ORACLES: dict[str, str] = {
    "flat_ip_topk": sql(BASE, final=top(all_pairs(IP))),
    "flat_sql_topk": sql(BASE, final=top(all_pairs(IP))),
    "closer_first": sql(BASE, final=top(all_pairs(IP))),
    "flat_l2_topk": sql(BASE, final=top(all_pairs(L2))),
    "flat_cosine_topk": sql(BASE, final=top(all_pairs(COSINE))),
    "flat_int_l2_topk": sql(
        BASE.replace("base AS", "raw AS").replace("FROM base", "FROM bytes").replace(", q AS", f", bytes AS (SELECT id, {BYTE.format('v')} AS v FROM raw), base AS (SELECT * FROM bytes), q AS"),
        final=top(all_pairs(L2)),
    ),
    "flat_filtered_topk": sql(BASE, final=top(all_pairs(L2, "label < 5"))),
    "epsilon_search": sql(BASE, final=top(all_pairs(L2), 1 << 62, "AND dist <= 1.2")),
    "multivector_docs": sql(
        *DOCS,
        final="SELECT p.qid, p.doc_id, p.id, row_number() OVER (PARTITION BY p.qid ORDER BY p.dist, p.id) AS rank, round(p.dist, 4) + 0.0 AS dist FROM pairs p "
        "LEFT JOIN (SELECT * FROM firsts WHERE place = 6) f USING (qid) WHERE f.id IS NULL OR p.dist < f.dist OR (p.dist = f.dist AND p.id < f.id)",
    ),
    "sq_train": sql(BASE, SCALE, final="SELECT round(scale, 6) AS scale FROM s"),
    "sq_encode": sql(*SQ[:3], final="SELECT id, array_to_string(code, ',') AS code FROM codes"),
    "sq_search": sql(*SQ, final=top(RERANKED)),
    "recall_at_k": sql(
        *SQ,
        f"found AS ({top(RERANKED)})",
        f"truth AS ({top(all_pairs(IP))})",
        final=f"SELECT qid, count(t.id) AS hits, round(count(t.id) / {q.K}.0::DOUBLE, 4) AS recall FROM q LEFT JOIN (SELECT f.qid, f.id FROM found f JOIN truth USING (qid, id)) t USING (qid) GROUP BY qid",
    ),
    "kmeans_l2": sql(BASE, *kmeans("l2", T, "reseed"), final=f"SELECT id, cid FROM ac{T}"),
    "kmeans_ip_stale": sql(BASE, *kmeans("ip", T, "zero"), final=f"SELECT id, cid FROM ac{T - 1}"),
    "kmeans_centroids": sql(BASE, *IVF, final=f"SELECT cid, d AS dim, round(cv[d + 1], 6) AS value FROM c{T}, (SELECT unnest(range({q.DIM})) AS d)"),
    "ivf_lists": sql(*FIXED, final="SELECT cid, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM lists GROUP BY cid"),
    "ivf_list_stats": sql(*FIXED, SIZES, final="SELECT count(*) AS lists, max(n) AS largest, min(n) AS smallest, round(avg(n), 4) AS mean FROM sizes"),
    "ivf_probe": sql(*FIXED, final="SELECT qid, cid, rank, round(score, 6) AS score FROM probes"),
    "ivf_search_fixed": sql(*FIXED, final=top(probed_pairs())),
    "ivf_union_search": sql(*FIXED, final=top(probed_pairs())),
    "dist_ivf_topk": sql(*FIXED, final=top(probed_pairs())),
    "ivf_union_rows": sql(*FIXED, final="SELECT id, cid FROM lists WHERE cid IN (SELECT cid FROM probes)"),
    "ivf_valid_pairs": sql(*FIXED, final="SELECT qid, id FROM probes JOIN lists USING (cid)"),
    "ivf_candidates": sql(*FIXED, SIZES, final="SELECT qid, count(*) AS nprobe, sum(n)::BIGINT AS candidates FROM probes JOIN sizes USING (cid) GROUP BY qid"),
    "ivf_batch_stats": sql(
        *FIXED,
        SIZES,
        "rows AS (SELECT qid // 200 AS batch, qid, cid, n FROM probes JOIN sizes USING (cid))",
        final="SELECT batch, pairs, n_queries, lists, union_rows FROM (SELECT batch, sum(n)::BIGINT AS pairs, count(DISTINCT qid) AS n_queries FROM rows GROUP BY batch) "
        "JOIN (SELECT batch, count(*) AS lists, sum(n)::BIGINT AS union_rows FROM (SELECT DISTINCT batch, cid, n FROM rows) GROUP BY batch) USING (batch)",
    ),
    "ivf_fullscan_l2build": sql(BASE, *kmeans("l2", T, "reseed"), LISTS, SCORES, probes(), final=top(probed_pairs())),
    "adaptive_probe": sql(BASE, *IVF, LISTS, SCORES, adaptive(*q.ADAPTIVE), final="SELECT qid, cid, rank FROM probes"),
    "adaptive_search": sql(BASE, *IVF, LISTS, SCORES, adaptive(*q.ADAPTIVE), final=top(probed_pairs())),
    "adaptive_sweep": sweep(),
    "pq_codebook": sql(BASE, BOOK, final=f"SELECT m, k, d AS dim, round(w[d + 1], 6) AS value FROM book, (SELECT unnest(range({SUB})) AS d)"),
    "pq_encode": sql(BASE, BOOK, PQ_CODES, final="SELECT id, string_agg(k::VARCHAR, ',' ORDER BY m) AS code FROM pqcodes GROUP BY id"),
    "pq_lut": sql(BASE, BOOK, LUT, final=f"SELECT qid, m * {KS} + k AS at, round(x, 6) AS value FROM lut"),
    "pq_search": sql(BASE, BOOK, PQ_CODES, LUT, shortlist("SELECT qid, id FROM q, base", SHARE), final=top(RERANKED)),
    "ivfpq_search": sql(*FIXED, BOOK, PQ_CODES, LUT, PAIRS, shortlist("SELECT qid, id FROM pairs", SHARE), final=top(RERANKED)),
    "ivfpq_residual_search": sql(*RESIDUAL, final=top(RESIDUAL_DIST)),
    "ivfpq_rerank": sql(
        *RESIDUAL,
        f"short AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM ({RESIDUAL_DIST})) WHERE r <= {SHARE})",
        final=top(RERANKED),
    ),
    "partition_block": sql(BASE, BLOCKS, final="SELECT id, part FROM parted"),
    "partition_cyclic": sql(BASE, final=f"SELECT id, id % {P} AS part FROM base"),
    "partition_hash": sql(BASE, final=hash_owner()),
    "partition_stats": sql(BASE, final=f"SELECT part, count(*) AS n FROM ({hash_owner()}) GROUP BY part"),
    "partition_centroids": sql(BASE, BLOCKS, final=f"SELECT part, d AS dim, round(avg(v[d + 1]), 6) AS value FROM parted, (SELECT unnest(range({q.DIM})) AS d) GROUP BY part, d"),
    "dist_ivfpq_topk": sql(
        *FIXED, BOOK, PQ_CODES, LUT, PAIRS, BLOCKS, shortlist("SELECT qid, id, part FROM pairs JOIN parted USING (id)", SHARE_OF_PART, more=", part"), final=top(RERANKED)
    ),
    "fbin_scan": sql(BASE, final=f"SELECT id, d AS dim, round(v[d + 1], 6) AS value FROM base, (SELECT unnest(range({q.DIM})) AS d)"),
    "delete_then_search": sql(BASE, final=top(all_pairs(L2, "id NOT IN (0, 20, 40)"))),
    "upsert_then_search": sql(BASE, final=top("SELECT qid, id, 1 - list_inner_product(qv, CASE WHEN label = 0 THEN list_transform(v, lambda x: -x) ELSE v END) AS dist FROM q, base")),
    "hnsw_exhaustive_ef": sql(BASE, final=top(all_pairs(IP))),
    "search_recall": " UNION ALL ".join(f"SELECT '{x}' AS name, true AS reached" for x in q.RECALLED),
    "hnsw_integrity": "SELECT ''::VARCHAR AS part, 0::BIGINT AS node, ''::VARCHAR AS problem WHERE false",
}
ORACLES |= {"hnsw_filtered": ORACLES["flat_filtered_topk"], "hnsw_epsilon": ORACLES["epsilon_search"], "hnsw_documents": ORACLES["multivector_docs"]}
