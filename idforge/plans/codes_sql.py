"""DuckDB text of the seeded quantiser, shared by the queries on codes."""


def codes_cte(size: int, subspaces: int, levels: int, dim: int = 64) -> str:
    """Common tables up to ``codes (vec_id, codes)`` and ``last (vec_id, s, r)``, the final residuals."""
    d = dim // subspaces
    out = [f"r0 AS (SELECT vec_id, s, list_slice(embedding::DOUBLE[], s * {d} + 1, s * {d} + {d}) AS r FROM embeddings, range({subspaces}) t(s))"]
    for k in range(levels):
        out.append(f"b{k} AS (SELECT s, vec_id - {k * size} AS code, r AS c FROM r{k} WHERE vec_id >= {k * size} AND vec_id < {(k + 1) * size})")
        out.append(f"""n{k} AS (SELECT vec_id, s, code, r, c FROM (
  SELECT vec_id, r{k}.s, code, r, c, row_number() OVER (PARTITION BY vec_id, r{k}.s ORDER BY list_sum(list_transform(range(1, {d} + 1), lambda i: (r[i] - c[i]) * (r[i] - c[i]))), code) AS k
  FROM r{k} JOIN b{k} ON r{k}.s = b{k}.s) WHERE k = 1)""")
        out.append(f"r{k + 1} AS (SELECT vec_id, s, list_transform(range(1, {d} + 1), lambda i: r[i] - c[i]) AS r FROM n{k})")
    every = " UNION ALL ".join(f"SELECT vec_id, {k} * {subspaces} + s AS p, code FROM n{k}" for k in range(levels))
    out.append(f"codes AS (SELECT vec_id, list(code::INT ORDER BY p) AS codes FROM ({every}) GROUP BY vec_id)")
    out.append(f"last AS (SELECT * FROM r{levels})")
    return "WITH " + ",\n".join(out)
