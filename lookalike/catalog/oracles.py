"""SQL that gives the same rows as the queries, for any engine with lists.

Common parts are named subqueries; ``sql(parts, body)`` puts those a query
needs in front of it.
"""

from __future__ import annotations

from ..config import LOOKUP_TABLES

ORACLES: dict[str, str] = {}


def draw(*parts: str) -> str:
    """The repeatable number in [0, 1) of ``functions.arrays.uniform``."""
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT / 4294967296.0)"


def tidy(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def vector_text(expr: str) -> str:
    return (
        f"array_to_string(list_transform({expr}, "
        "lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',')"
    )


def distance(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), "
        "lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    )


def _described(source: str, name: str) -> dict[str, str]:
    """Bits and tokens of the vectors in ``source``."""
    return {
        f"{name}_lum": f"""
            SELECT image_id, e,
                   list_transform(e, lambda v: v / 3 * 0.21 + v / 3 * 0.72 + v / 3 * 0.07) AS lum
            FROM {source}""",
        f"{name}_avg": f"SELECT image_id, e, lum, list_sum(lum) / len(lum) AS avg FROM {name}_lum",
        f"{name}_bits": f"""
            SELECT image_id, e, array_to_string(list_transform(lum,
                   lambda v: CASE WHEN v >= avg THEN '1' ELSE '0' END), '') AS bits
            FROM {name}_avg""",
        name: f"""
            SELECT image_id, e, bits,
                   list_transform(range(0, 8), lambda i: md5(substr(bits, i * 8 + 1, 8))) AS phash,
                   list_transform(range(0, 7), lambda i: md5(substr(bits, i * 10 + 1, 10))) AS ward
            FROM {name}_bits""",
        f"{name}_grams": f"""
            SELECT image_id, unnest(list_transform(range(1, 8),
                   lambda i: phash[i] || '-' || phash[i + 1])) AS token
            FROM {name}""",
        f"{name}_wards": f"SELECT image_id, unnest(ward) AS token FROM {name}",
    }


def _assign(centers: str, columns: str = "image_id, e") -> str:
    return f"""
        SELECT {columns}, arg_min(cluster_id, d) AS cluster_id, min(d) AS distance
        FROM (SELECT {columns}, cluster_id, {distance('e', 'center')} AS d FROM items, {centers})
        GROUP BY {columns}"""


def _moved(assigned: str) -> str:
    return f"""
        SELECT cluster_id, list(m ORDER BY p) AS center, any_value(n) AS n
        FROM (SELECT cluster_id, p, avg(e[p]) AS m, count(*) AS n
              FROM {assigned}, range(1, 65) r(p) GROUP BY cluster_id, p)
        GROUP BY cluster_id"""


PARTS: dict[str, str] = {
    "img": """
        SELECT vec_id AS image_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
        FROM embeddings""",
    # --- altered copies
    "px": "SELECT image_id, p, p // 8 AS y, p % 8 AS x, e[p + 1] AS v FROM img, range(64) r(p)",
    "blocks": """
        SELECT image_id, y // 3 AS br, x // 3 AS bc, median(v) AS med FROM px
        WHERE y // 3 < 2 AND x // 3 < 2 GROUP BY ALL""",
    "hits": f"SELECT * FROM blocks WHERE {draw('7', 'image_id', 'br', 'bc')} < 0.14",
    "fuzzy_px": """
        SELECT px.image_id, p, coalesce(med, v) AS v
        FROM px LEFT JOIN hits ON px.image_id = hits.image_id AND y // 3 = br AND x // 3 = bc""",
    "fuzzy": "SELECT image_id, list(v ORDER BY p) AS e FROM fuzzy_px GROUP BY image_id",
    # --- tokens of originals and copies
    **_described("img", "items"),
    **_described("fuzzy", "cands"),
    # --- k-means
    "draws": "SELECT image_id, e, md5('1|' || image_id || '|0') AS draw FROM items",
    "c0": """
        SELECT row_number() OVER (ORDER BY draw, image_id) - 1 AS cluster_id, e AS center
        FROM (SELECT * FROM draws ORDER BY draw, image_id LIMIT 8)""",
    "a0": _assign("c0"),
    "c1": _moved("a0"),
    "a1": _assign("c1"),
    "c2": _moved("a1"),
    "assigned": f"""
        SELECT items.*, near.cluster_id, near.distance
        FROM items JOIN ({_assign('c2')}) near USING (image_id)""",
    "shift": f"SELECT sum({distance('c1.center', 'c2.center')}) AS shift FROM c1 JOIN c2 USING (cluster_id)",
    "fit_sse": "SELECT sum(distance) AS sse FROM a1",
    # --- token counts and lookups
    "counts": """
        SELECT kind, cluster_id, token, count(*) AS n FROM (
            SELECT 'phash' AS kind, cluster_id, unnest(phash) AS token FROM assigned
            UNION ALL
            SELECT 'ward', cluster_id, unnest(ward) FROM assigned)
        GROUP BY ALL""",
    "known": """
        SELECT 'phash' AS kind, image_id, cluster_id, token
        FROM items_grams JOIN assigned USING (image_id)
        UNION ALL
        SELECT 'ward', image_id, cluster_id, token
        FROM items_wards JOIN assigned USING (image_id)""",
    # --- candidates and their clusters
    "cand_single": """
        SELECT 'phash' AS kind, image_id AS cand, unnest(phash) AS token FROM cands
        UNION ALL
        SELECT 'ward', image_id, unnest(ward) FROM cands""",
    "scores": """
        SELECT kind, cand, cluster_id, sum(n)::BIGINT AS score
        FROM cand_single JOIN counts USING (kind, token) GROUP BY ALL""",
    "by_token": """
        SELECT kind, c.image_id AS cand, coalesce(cluster_id, 0) AS cluster_id
        FROM (VALUES ('phash'), ('ward')) k(kind), cands c
        LEFT JOIN (SELECT kind AS k2, cand, cluster_id FROM scores
                   QUALIFY row_number() OVER (PARTITION BY kind, cand
                                              ORDER BY score DESC, cluster_id) = 1) s
        ON s.cand = c.image_id AND s.k2 = k.kind""",
    "cand_dist": f"""
        SELECT image_id AS cand, cluster_id, {distance('e', 'center')} AS distance FROM cands, c2""",
    "by_distance": """
        SELECT cand, arg_min(cluster_id, distance) AS cluster_id, min(distance) AS distance
        FROM cand_dist GROUP BY cand""",
    "picked": """
        SELECT p.cand, pick, cluster_id, distance FROM (
            SELECT cand, kind AS pick, cluster_id FROM by_token
            UNION ALL
            SELECT cand, 'distance', cluster_id FROM by_distance) p
        JOIN cand_dist USING (cand, cluster_id)""",
    "cand_both": """
        SELECT 'phash' AS kind, image_id AS cand, token FROM cands_grams
        UNION ALL
        SELECT 'ward', image_id, token FROM cands_wards""",
    "asked": "SELECT kind, cand, pick, cluster_id, token FROM cand_both JOIN picked USING (cand)",
    "weights": "SELECT kind, cluster_id, count(*) AS n_b FROM known GROUP BY ALL",
    "weighed": "SELECT asked.*, n_b FROM asked JOIN weights USING (kind, cluster_id)",
    # --- votes
    "votes": """
        SELECT kind, cand, image_id, sum(n_b)::BIGINT AS votes
        FROM weighed JOIN known USING (kind, token) GROUP BY ALL""",
    "strict_votes": """
        SELECT kind, cand, image_id, count(*) AS votes
        FROM asked JOIN known USING (kind, token, cluster_id) GROUP BY ALL""",
}


def best(source: str, *keys: str) -> str:
    """Best match, its votes and all votes per key; lowest id on ties."""
    names = ", ".join(keys)
    return f"""
        SELECT {names}, image_id AS best_match, votes AS agree_count, total FROM (
            SELECT *, (sum(votes) OVER (PARTITION BY {names}))::BIGINT AS total FROM {source})
        QUALIFY row_number() OVER (PARTITION BY {names} ORDER BY votes DESC, image_id) = 1"""


def joined(source: str) -> str:
    return f"""
        SELECT w.cand, w.best_match AS ward_best, w.agree_count AS ward_votes,
               w.total AS ward_total, p.best_match AS phash_best,
               p.agree_count AS phash_votes, p.total AS phash_total
        FROM ({best(source, 'kind', 'cand')}) w JOIN ({best(source, 'kind', 'cand')}) p
        ON w.cand = p.cand AND w.kind = 'ward' AND p.kind = 'phash'"""


def fused(source: str) -> str:
    added = f"(SELECT cand, image_id, sum(votes)::BIGINT AS votes FROM {source} GROUP BY ALL)"
    return best(added, "cand")


def sql(body: str) -> str:
    """``body`` with all named subqueries it needs, directly or not."""
    import re

    needed: set[str] = set()

    def look(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                look(PARTS[name])

    look(body)
    ordered = [f"{name} AS MATERIALIZED ({PARTS[name]})" for name in PARTS if name in needed]
    return (f"WITH {', '.join(ordered)} " if ordered else "") + body


def oracle(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


# --- sources -----------------------------------------------------------------

oracle(
    "image_scan",
    "SELECT image_id || '.png' AS name, 'PNG' AS format, true AS is_whole FROM img",
)
oracle(
    "image_meta",
    """SELECT image_id || '.png' AS name, 'PNG' AS format, 8 AS width, 8 AS height,
              3 AS n_channels, true AS is_valid FROM img""",
)
oracle(
    "pixel_rows",
    """SELECT image_id || '.png' AS image_id, p AS pos, p % 8 AS x, p // 8 AS y,
              floor((e[p + 1] + 1) * 127.5) AS r, floor((e[(p + 21) % 64 + 1] + 1) * 127.5) AS g,
              floor((e[(p + 42) % 64 + 1] + 1) * 127.5) AS b
       FROM img, range(64) t(p)""",
)
oracle(
    "measures_io",
    f"""SELECT image_id, {vector_text('e')} AS features,
               array_to_string(phash, ',') AS phash FROM items""",
)
oracle(
    "lookup_io",
    "SELECT token, image_id, cluster_id FROM items_grams JOIN assigned USING (image_id)",
)
oracle(
    "asset_key",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
               url, '/', '', 'g'), '\._', '', 'g'), '^\.', '') AS asset_key FROM pages""",
)
oracle(
    "random_pairs",
    f"""SELECT o_orderkey, round({draw("'0'", 'o_orderkey', "'x'")}, 9) AS x,
               round({draw("'0'", 'o_orderkey', "'y'")}, 9) AS y FROM orders""",
)
oracle("reuse_measures", "SELECT image_id, unnest(phash) AS token FROM cands")

# --- measures ----------------------------------------------------------------

oracle(
    "select_full",
    """SELECT image_id, 0 AS sel_id, true AS is_full, 8 AS width, 8 AS height, p AS pos,
              e[p + 1] AS v FROM img, range(64) t(p)""",
)
oracle(
    "select_patches",
    f"""SELECT image_id, sel_id, false AS is_full, 4 AS width, 4 AS height, p AS pos,
               e[(r0 + p // 4) * 8 + c0 + p % 4 + 1] AS v
        FROM (SELECT image_id, e, s AS sel_id,
                     floor({draw("'0'", 'image_id', 's', "'row'")} * 5)::BIGINT AS r0,
                     floor({draw("'0'", 'image_id', 's', "'col'")} * 5)::BIGINT AS c0
              FROM img, range(1, 5) t(s)), range(16) t2(p)""",
)
oracle(
    "select_quadrants",
    """SELECT image_id, sel_id, false AS is_full, w AS width, h AS height, p AS pos,
              e[(r0 + p // w) * 8 + c0 + p % w + 1] AS v
       FROM img, (VALUES (1, 0, 4, 0, 4), (2, 0, 4, 4, 4), (3, 4, 4, 0, 4), (4, 4, 4, 4, 4))
            q(sel_id, r0, h, c0, w), range(16) t(p)
       WHERE p < w * h""",
)
oracle(
    "to_rgb",
    """SELECT image_id, band, pos,
              CASE WHEN image_id % 4 + 1 >= 3 THEN e[(band * 16 + pos) % 64 + 1]
                   ELSE e[pos + 1] / 3 END AS v
       FROM img, range(3) b(band), range(64) t(pos)""",
)
_RESIZE_COLS = 5  # int(5 * 8 / 8 + 0.5)
oracle(
    "resize",
    f"""WITH rows AS (SELECT r, greatest(0, least(7, (r + 0.5) * 8 / 5 - 0.5)) AS s FROM range(5) t(r)),
             cols AS (SELECT c, greatest(0, least(7, (c + 0.5) * 8 / {_RESIZE_COLS} - 0.5)) AS s
                      FROM range({_RESIZE_COLS}) t(c)),
             taps AS (SELECT r, c, floor(rows.s)::INT AS y0, least(floor(rows.s)::INT + 1, 7) AS y1,
                             rows.s - floor(rows.s) AS ty, floor(cols.s)::INT AS x0,
                             least(floor(cols.s)::INT + 1, 7) AS x1, cols.s - floor(cols.s) AS tx
                      FROM rows, cols)
        SELECT vec_id AS image_id, {_RESIZE_COLS} AS width, 5 AS height, band,
               r * {_RESIZE_COLS} + c AS pos,
               {tidy('''
                 (e[(band * 21 + y0 * 8 + x0) % 64 + 1] * (1 - tx) + e[(band * 21 + y0 * 8 + x1) % 64 + 1] * tx)
                 * (1 - ty)
                 + (e[(band * 21 + y1 * 8 + x0) % 64 + 1] * (1 - tx)
                    + e[(band * 21 + y1 * 8 + x1) % 64 + 1] * tx) * ty''')} AS v
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(3) b(band), taps""",
)
_PERCENTILES = """
    (SELECT image_id, band * 7 + q AS pos,
            quantile_cont(e[(band * 21 + p) % 64 + 1], [0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95])[q + 1] AS v
     FROM img, range(3) b(band), range(64) t(p), range(7) k(q) GROUP BY image_id, band, q)"""
oracle("band_percentiles", f"SELECT image_id, pos, {tidy('v')} AS v FROM {_PERCENTILES}")
oracle(
    "luminosity",
    f"""SELECT image_id, p AS pos,
               {tidy('e[p + 1] * 0.21 + e[(p + 21) % 64 + 1] * 0.72 + e[(p + 42) % 64 + 1] * 0.07')} AS v
        FROM img, range(64) t(p)""",
)
oracle("phash_bits", "SELECT image_id, bits FROM items")
oracle("phash_blocks", "SELECT image_id, p AS pos, phash[p + 1] AS token FROM items, range(8) t(p)")
oracle("phash_ngrams", "SELECT image_id, token FROM items_grams")
oracle(
    "word_ngrams",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'),
                          lambda x: x <> '') AS words FROM documents),
             g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 1, 1)),
                          lambda i: words[i] || '-' || words[i + 1] || '-' || words[i + 2])) AS token
                   FROM w)
        SELECT token, count(*) AS n, min(doc_id) AS first_doc FROM g GROUP BY token""",
)


def _centroids(rounds: int) -> str:
    """Parts for k-means of the 64 coloured pixels of every vector, k = 3."""
    parts = [
        """cpx AS MATERIALIZED (
             SELECT image_id, p, e[p + 1] AS r, e[(p + 21) % 64 + 1] AS g, e[(p + 42) % 64 + 1] AS b,
                    row_number() OVER (PARTITION BY image_id ORDER BY
                        md5('0|' || image_id || '|0|' || p), p) - 1 AS place
             FROM img, range(64) t(p))""",
        "k0 AS MATERIALIZED (SELECT image_id, place AS i, r, g, b FROM cpx WHERE place < 3)",
    ]
    for n in range(rounds):
        parts.append(
            f"""k{n + 1} AS MATERIALIZED (
                 SELECT o.image_id, o.i, coalesce(m.r, o.r) AS r, coalesce(m.g, o.g) AS g,
                        coalesce(m.b, o.b) AS b
                 FROM k{n} o LEFT JOIN (
                   SELECT image_id, i, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM (
                     SELECT c.image_id, c.p, c.r, c.g, c.b, k.i FROM cpx c JOIN k{n} k USING (image_id)
                     QUALIFY row_number() OVER (PARTITION BY c.image_id, c.p ORDER BY
                        (c.r - k.r) * (c.r - k.r) + (c.g - k.g) * (c.g - k.g)
                        + (c.b - k.b) * (c.b - k.b), k.i) = 1)
                   GROUP BY image_id, i) m USING (image_id, i))"""
        )
    parts.append(
        f"""cen AS MATERIALIZED (
             SELECT image_id, (place - 1) * 3 + band AS pos, [r, g, b][band + 1] AS v
             FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY
                          r * 0.21 + g * 0.72 + b * 0.07, r, g, b) AS place FROM k{rounds}),
                  range(3) t(band))"""
    )
    return ", ".join([f"img AS MATERIALIZED ({PARTS['img']})", *parts])


ORACLES["color_centroids"] = (
    f"WITH {_centroids(2)} SELECT image_id, pos, {tidy('v')} AS v FROM cen"
)
ORACLES["feature_vector"] = f"""
    WITH {_centroids(1)}
    SELECT image_id, pos, {tidy('v')} AS v FROM cen
    UNION ALL SELECT image_id, pos + 9, {tidy('v')} FROM {_PERCENTILES}"""

def _regions(rounds: int, target: int) -> str:
    """Parts for merging the 48 values of a 4x4 picture: per round the priced
    edges (k), the pairs that merge (p), nodes (n), edges (e) and members (m)."""
    at = lambda y, x: f"e[(band * 21 + (2 * r + {y}) * 8 + 2 * c + {x}) % 64 + 1]"
    parts = [
        f"img AS MATERIALIZED ({PARTS['img']})",
        f"""n0 AS MATERIALIZED (
             SELECT image_id, (r * 4 + c) * 3 + band AS r, 1.0::DOUBLE AS n,
                    (({at(0, 0)} * 0.5::DOUBLE + {at(0, 1)} * 0.5::DOUBLE) * 0.5::DOUBLE
                     + ({at(1, 0)} * 0.5::DOUBLE + {at(1, 1)} * 0.5::DOUBLE) * 0.5::DOUBLE) AS m
             FROM img, range(4) y(r), range(4) x(c), range(3) b(band))""",
        """e0 AS MATERIALIZED (
             SELECT image_id, r AS a, r + d AS b FROM n0, (VALUES (1), (3)) s(d)
             WHERE (d = 1 AND r % 3 < 2) OR (d = 3 AND r + 3 < 48))""",
        "m0 AS MATERIALIZED (SELECT image_id, r AS pos, r FROM n0)",
    ]
    for i in range(rounds):
        parts += [
            f"""k{i} AS MATERIALIZED (
                 SELECT image_id, a, b, row_number() OVER (PARTITION BY image_id ORDER BY cost, tie, a, b) AS rk
                 FROM (SELECT e.image_id, a, b, md5(a || '|' || b) AS tie,
                              x.n * y.n / (x.n + y.n) * (x.m - y.m) * (x.m - y.m) AS cost
                       FROM e{i} e JOIN n{i} x ON e.image_id = x.image_id AND e.a = x.r
                                   JOIN n{i} y ON e.image_id = y.image_id AND e.b = y.r))""",
            f"""p{i} AS MATERIALIZED (
                 WITH ends AS (SELECT image_id, a AS r, rk FROM k{i} UNION ALL SELECT image_id, b, rk FROM k{i}),
                      best AS (SELECT image_id, r, min(rk) AS rk FROM ends GROUP BY ALL),
                      live AS (SELECT image_id, count(*) AS c FROM n{i} GROUP BY ALL)
                 SELECT image_id, a, b FROM k{i}
                 JOIN best u USING (image_id, rk) JOIN best v USING (image_id, rk) JOIN live USING (image_id)
                 WHERE u.r = a AND v.r = b
                 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rk) <= any_value(c) OVER (PARTITION BY image_id) - {target})""",
            f"""n{i + 1} AS MATERIALIZED (
                 SELECT x.image_id, x.r, x.n + coalesce(y.n, 0) AS n,
                        CASE WHEN y.n IS NULL THEN x.m ELSE (x.n * x.m + y.n * y.m) / (x.n + y.n) END AS m
                 FROM n{i} x LEFT JOIN p{i} p ON p.image_id = x.image_id AND p.a = x.r
                             LEFT JOIN n{i} y ON y.image_id = x.image_id AND y.r = p.b
                 ANTI JOIN p{i} q ON q.image_id = x.image_id AND q.b = x.r)""",
            f"""m{i + 1} AS MATERIALIZED (
                 SELECT m.image_id, pos, coalesce(p.a, m.r) AS r
                 FROM m{i} m LEFT JOIN p{i} p ON p.image_id = m.image_id AND p.b = m.r)""",
            f"""e{i + 1} AS MATERIALIZED (
                 SELECT DISTINCT image_id, least(a, b) AS a, greatest(a, b) AS b
                 FROM (SELECT e.image_id, coalesce(p.a, e.a) AS a, coalesce(q.a, e.b) AS b
                       FROM e{i} e LEFT JOIN p{i} p ON p.image_id = e.image_id AND p.b = e.a
                                   LEFT JOIN p{i} q ON q.image_id = e.image_id AND q.b = e.b)
                 WHERE a <> b)""",
        ]
    return ", ".join(parts)


#: More rounds than any of these small pictures needs.
REGION_ROUNDS = 24
ORACLES["region_tokens"] = f"""
    WITH {_regions(REGION_ROUNDS, 5)}
    SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY r) - 1)::INT AS region,
           md5(string_agg((pos - r)::VARCHAR, ',' ORDER BY pos)) AS token
    FROM m{REGION_ROUNDS} GROUP BY image_id, r"""

_COVARIANCE = """
    (SELECT image_id, count(*) AS n, var_samp(r) AS xx, covar_samp(r, g) AS xy,
            covar_samp(r, b) AS xz, var_samp(g) AS yy, covar_samp(g, b) AS yz, var_samp(b) AS zz
     FROM (SELECT l_suppkey AS image_id, l_quantity AS r, l_extendedprice / 1000.0 AS g,
                  l_discount AS b FROM lineitem) GROUP BY image_id)"""
oracle(
    "pixel_covariance",
    "SELECT image_id, n, "
    + ", ".join(f"{tidy(c, 5)} AS {c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
    + f" FROM {_COVARIANCE}",
)
oracle(
    "pca_measures",
    f"""WITH cov AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {_COVARIANCE}),
             s AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2
                          + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM cov),
             d AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz)
                          - xy * (xy * (zz - q) - yz * xz)
                          + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM s),
             f AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS phi FROM d),
             v AS (SELECT image_id, q, q + 2 * p * cos(phi) AS big,
                          q + 2 * p * cos(phi + 2 * pi() / 3) AS small FROM f)
        SELECT image_id, {tidy('big', 5)} AS var0, {tidy('3 * q - big - small', 5)} AS var1,
               {tidy('small', 5)} AS var2, 0.0::DOUBLE AS off_axis, 0.0::DOUBLE AS off_length
        FROM v""",
)

# --- clustering --------------------------------------------------------------

oracle(
    "project_measures",
    f"""SELECT image_id, {vector_text('e')} AS features, array_to_string(phash, ',') AS phash,
               array_to_string(ward, ',') AS ward FROM items""",
)
oracle(
    "seed_sample",
    f"SELECT image_id, draw, {vector_text('e')} AS features FROM draws ORDER BY draw, image_id LIMIT 8",
)
oracle("nearest_center", f"SELECT image_id, cluster_id, {tidy('distance')} AS distance FROM a0")
_CENTER_ROWS = "SELECT cluster_id, n, p AS pos, {v} AS v FROM {source}, range(64) t(p)"
oracle("lloyd_step", _CENTER_ROWS.format(source="c1", v=tidy("center[p + 1]")))
#: Final centres with the number of items nearest to them.
_FINAL = """(SELECT c2.cluster_id, c2.center, coalesce(s.n, 0) AS n FROM c2 LEFT JOIN
             (SELECT cluster_id, count(*) AS n FROM assigned GROUP BY ALL) s USING (cluster_id))"""
oracle("cluster_items", _CENTER_ROWS.format(source=_FINAL, v=tidy("center[p + 1]")))
oracle("center_shift", f"SELECT 2 AS rounds, {tidy('shift')} AS shift FROM shift")
oracle("within_sse", f"SELECT count(*) AS n, {tidy('sum(distance)', 5)} AS sse FROM assigned")
oracle("cluster_token_counts", "SELECT kind, cluster_id, token, n FROM counts")
oracle(
    "cluster_top_tokens",
    """SELECT kind, cluster_id, token, n FROM counts WHERE kind = 'ward' AND cluster_id = 0
       ORDER BY n DESC, token LIMIT 20""",
)
oracle(
    "token_cap",
    """SELECT kind, cluster_id, token, n FROM counts
       QUALIFY row_number() OVER (PARTITION BY kind, cluster_id ORDER BY n DESC, token)
               <= CASE kind WHEN 'phash' THEN 40 ELSE 30 END""",
)
oracle(
    "token_heavy_hitters",
    """SELECT * FROM (
       WITH t AS (SELECT cluster_id, token, n, ('0x' || substr(md5(token), 1, 8))::BIGINT % 4096 AS bucket
                  FROM counts WHERE kind = 'ward'),
            b AS (SELECT cluster_id, bucket, sum(n) AS most FROM t GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY most DESC, bucket) AS place FROM b),
            f AS (SELECT t.cluster_id, token, n FROM t JOIN r USING (cluster_id, bucket) WHERE place <= 40
                  QUALIFY row_number() OVER (PARTITION BY t.cluster_id ORDER BY n DESC, token) <= 10)
       SELECT f.cluster_id, token, n,
              greatest(0, coalesce(most, 0) - CASE WHEN count(*) OVER w < 10 THEN 0 ELSE min(n) OVER w END)::BIGINT
              AS error
       FROM f LEFT JOIN (SELECT cluster_id, most FROM r WHERE place = 41) USING (cluster_id)
       WINDOW w AS (PARTITION BY f.cluster_id))""",
)
oracle(
    "fit_meta",
    f"""SELECT 'n' AS name, cluster_id, n::DOUBLE AS value FROM {_FINAL}
        UNION ALL SELECT 'rounds', -1, 2.0
        UNION ALL SELECT 'shift', -1, {tidy('shift')} FROM shift
        UNION ALL SELECT 'sse', -1, {tidy('sum(distance)', 5)} FROM assigned""",
)

_KNOWN_PHASH = "(SELECT * FROM known WHERE kind = 'phash') k JOIN assigned a USING (image_id)"
_KNOWN_WARD = "(SELECT * FROM known WHERE kind = 'ward') k JOIN assigned a USING (image_id)"
_VECTOR = f"{vector_text('a.e')} AS features"
_LOOKUP_COLUMNS = {
    "phash": "k.token",
    "ward": "k.token",
    "key": "a.image_id AS image_id",
    "cluster": "a.cluster_id AS cluster_id",
    "flattened": _VECTOR,
}
_LOOKUP_BODIES = {}
for _name in LOOKUP_TABLES:
    _left, _right = _name.split("_to_")
    _source = (
        _KNOWN_PHASH if "phash" in _name else _KNOWN_WARD if "ward" in _name else "assigned a"
    )
    _LOOKUP_BODIES[_name] = (
        f"SELECT {_LOOKUP_COLUMNS[_left]}, {_LOOKUP_COLUMNS[_right]} FROM {_source}"
    )
    oracle(_name, _LOOKUP_BODIES[_name])
oracle(
    "token_lookups",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n FROM ({body})"
        for name, body in _LOOKUP_BODIES.items()
    ),
)

# --- search ------------------------------------------------------------------

oracle("cluster_token_score", "SELECT kind, cand, 0 AS sel_id, cluster_id, score FROM scores")
oracle("best_cluster_by_token", "SELECT kind, cand, 0 AS sel_id, cluster_id FROM by_token")
oracle(
    "best_cluster_by_distance",
    f"SELECT cand, 0 AS sel_id, cluster_id, {tidy('distance')} AS distance FROM by_distance",
)
oracle(
    "assign_clusters",
    f"SELECT cand, 0 AS sel_id, pick, cluster_id, {tidy('distance')} AS distance FROM picked",
)
oracle(
    "sort_by_distance",
    f"SELECT cand, pick, {tidy('distance')} AS distance FROM picked ORDER BY picked.distance, cand, pick",
)
oracle("candidate_tokens", "SELECT kind, cand, 0 AS sel_id, pick, cluster_id, token FROM asked")
oracle("join_on_cluster", "SELECT kind, cand, 0 AS sel_id, pick, cluster_id, token, n_b FROM weighed")
oracle(
    "join_token_key",
    """SELECT kind, token, 'cand' AS side, cand AS id, sum(n_b)::BIGINT AS n
       FROM weighed SEMI JOIN known USING (kind, token) GROUP BY ALL
       UNION ALL
       SELECT kind, token, 'image', image_id, count(*)
       FROM known SEMI JOIN weighed USING (kind, token) GROUP BY ALL""",
)
oracle("vote_counts", "SELECT kind, cand, image_id, votes FROM votes")
oracle("best_with_total", best("votes", "kind", "cand"))
oracle("final_matches", joined("votes"))
oracle("fused_votes", fused("votes"))
_PLAIN = """(SELECT image_id AS cand, k.image_id, count(*) AS votes
             FROM cands_grams c JOIN items_grams k USING (token) GROUP BY ALL)""".replace(
    "image_id AS cand", "c.image_id AS cand"
)
oracle("nearest_original", best(_PLAIN, "cand"))
oracle(
    "match_pairs",
    f"""SELECT b.cand, b.best_match, {vector_text('f.e')} AS cand_content,
               {vector_text('i.e')} AS match_content
        FROM ({best(_PLAIN, 'cand')}) b JOIN fuzzy f ON f.image_id = b.cand
        JOIN img i ON i.image_id = b.best_match""",
)
oracle("match_samples", f"{joined('votes')} ORDER BY w.cand LIMIT 100")


def _all(source: str) -> str:
    return f"""
        SELECT j.*, f.best_match AS fused_best, f.agree_count AS fused_votes,
               f.total AS fused_total
        FROM ({joined(source)}) j JOIN ({fused(source)}) f USING (cand)"""


oracle("find_similar", _all("votes"))
oracle("find_similar_strict", _all("strict_votes"))
_FIRST_ROUND = f"({best(_PLAIN, 'cand')})"
_SECOND_ROUND = f"""(
    SELECT c.image_id AS cand, k.image_id, count(*) AS votes
    FROM items_grams c JOIN items_grams k USING (token)
    WHERE c.image_id IN (SELECT best_match FROM {_FIRST_ROUND})
      AND k.image_id NOT IN (SELECT best_match FROM {_FIRST_ROUND})
    GROUP BY ALL)"""
oracle(
    "search_rounds",
    f"""SELECT 1 AS round, cand, best_match, agree_count, total FROM {_FIRST_ROUND}
        UNION ALL
        SELECT 2, cand, best_match, agree_count, total FROM ({best(_SECOND_ROUND, 'cand')})""",
)
oracle(
    "token_pair_join",
    """SELECT token, 'cand' AS side, image_id AS id, count(*) AS n
       FROM cands_wards SEMI JOIN items_wards USING (token) GROUP BY ALL
       UNION ALL
       SELECT token, 'image', image_id, count(*)
       FROM items_wards SEMI JOIN cands_wards USING (token) GROUP BY ALL""",
)
_SHARED = """(SELECT DISTINCT token FROM cands_wards JOIN items_wards USING (token)
              ORDER BY token LIMIT 4)"""
oracle(
    "token_pair_groups",
    f"""SELECT token, 'cand' AS side, image_id AS id, count(*) AS n
        FROM cands_wards WHERE token IN {_SHARED} GROUP BY ALL
        UNION ALL
        SELECT token, 'image', image_id, count(*)
        FROM items_wards WHERE token IN {_SHARED} GROUP BY ALL""",
)
oracle(
    "outer_token_groups",
    """SELECT token, 'cand' AS side, image_id AS id, count(*) AS n FROM cands_wards GROUP BY ALL
       UNION ALL
       SELECT token, 'image', image_id, count(*) FROM items_wards GROUP BY ALL""",
)
oracle(
    "cluster_neighbors",
    """SELECT cluster_id, 'cand' AS side, cand AS id, 0 AS sel_id FROM by_distance
       UNION ALL SELECT cluster_id, 'image', image_id, 0 FROM assigned""",
)

# --- altered copies ----------------------------------------------------------

oracle("block_median_fuzz", "SELECT image_id, p AS pos, v FROM fuzzy_px")

# --- exploration -------------------------------------------------------------

oracle(
    "map_products",
    f"""SELECT l_orderkey, l_linenumber, {tidy('l_quantity * l_quantity')} AS xx,
               {tidy('l_discount * l_discount')} AS yy, {tidy('l_quantity * l_discount')} AS xy
        FROM lineitem""",
)
oracle(
    "moment_ratio",
    f"""SELECT {tidy('''sum(l_quantity * l_discount) * 1e6
                        / (sum(l_discount * l_discount) * sum(l_quantity * l_quantity))''')} AS ratio_e6,
               {tidy('corr(l_quantity, l_discount)')} AS correlation FROM lineitem""",
)
oracle(
    "word_count",
    r"""SELECT word, count(*) AS n FROM (
          SELECT unnest(string_split_regex(text, '[ \t\n\r\f\v]+')) AS word FROM documents)
        WHERE word <> '' GROUP BY word ORDER BY n DESC, word""",
)
oracle(
    "inspect_type",
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", replace(lower(typeof({c})), 'varchar', 'string') AS type
            FROM documents LIMIT 1)"""
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
oracle("row_count", "SELECT count(*) AS n FROM documents")
oracle(
    "take_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10"
)
_NATIVE = """
    (SELECT l_suppkey AS image_id, band, unnest([5.0, 25.0, 50.0, 75.0, 95.0]::DOUBLE[]) AS q,
            unnest(quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95])) AS pct
     FROM (SELECT l_suppkey, unnest(['r', 'g', 'b']) AS band,
                  unnest([l_quantity, l_extendedprice / 1000.0, l_discount]) AS v FROM lineitem)
     GROUP BY l_suppkey, band)"""
oracle(
    "native_band_percentiles",
    f"SELECT image_id, band, q, {tidy('pct', 9)} AS pct FROM {_NATIVE}",
)
oracle(
    "mean_of_percentiles",
    f"SELECT band, q, {tidy('avg(pct)', 9)} AS mean_pct FROM {_NATIVE} GROUP BY band, q",
)
oracle(
    "mean_color_bins",
    """SELECT band, (floor(mean / 5) * 5)::BIGINT AS bin, image_id,
              count(*) OVER (PARTITION BY band, floor(mean / 5)) AS n_images
       FROM (SELECT l_suppkey AS image_id, unnest(['r', 'g', 'b']) AS band,
                    unnest([avg(l_quantity), avg(l_extendedprice / 1000.0), avg(l_discount)]) AS mean
             FROM lineitem GROUP BY l_suppkey)
       ORDER BY band, bin, image_id""",
)
_MEDIANS = """
    (SELECT image_id, band, quantile_cont(e[(band * 21 + p) % 64 + 1], 0.5) AS median
     FROM img, range(3) b(band), range(64) t(p) GROUP BY image_id, band)"""
oracle("histo_median", f"SELECT image_id, band, {tidy('median')} AS median FROM {_MEDIANS}")
oracle(
    "lowest_by_median",
    f"""SELECT image_id, band, {tidy('median')} AS median,
               row_number() OVER (PARTITION BY band ORDER BY m.median, image_id) AS place
        FROM {_MEDIANS} m
        QUALIFY row_number() OVER (PARTITION BY band ORDER BY m.median, image_id) <= 5""",
)
_A = "(SELECT c_custkey AS k, c_name AS a_name FROM customer) a"
_B = "(SELECT o_custkey AS k, o_orderkey AS b_order FROM orders) b"
for _name, _first, _kind, _second in (
    ("inner_join_ab", _A, "JOIN", _B),
    ("inner_join_ba", _B, "JOIN", _A),
    ("right_join_ab", _A, "RIGHT JOIN", _B),
    ("left_join_ba", _B, "LEFT JOIN", _A),
    ("right_join_ba", _B, "RIGHT JOIN", _A),
    ("left_join_ab", _A, "LEFT JOIN", _B),
    ("full_join_ab", _A, "FULL JOIN", _B),
):
    oracle(_name, f"SELECT k, a_name, b_order FROM {_first} {_kind} {_second} USING (k)")
