"""DuckDB SQL for the queries of ``queries``, written from the formulas, not from the DataFrame code."""

from __future__ import annotations

M = 64
X = "x AS (SELECT vec_id AS row_id, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
MEANS = "lm AS (SELECT row_id, j, avg(v) AS v FROM (SELECT label::BIGINT AS row_id, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)"
CENTRED = "c AS (SELECT row_id, j, v - avg(v) OVER (PARTITION BY j) AS v FROM x)"
COV = "cov AS (SELECT p.j AS a, q.j AS b, sum(p.v * q.v) / (SELECT count(*) - 1 FROM embeddings) AS c FROM c p JOIN c q USING (row_id) GROUP BY ALL)"
SERIES = """b AS (
  SELECT event_type AS signal_id, floor((epoch_us(ts) - 1704067200000000) / 21600000000)::BIGINT AS t, round(sum(value), 6) AS x FROM events GROUP BY ALL
), g AS (
  SELECT signal_id, unnest(range((SELECT max(t) + 1 FROM b))) AS t FROM (SELECT DISTINCT signal_id FROM b)
), s AS (SELECT g.signal_id, g.t, coalesce(b.x, 0.0::DOUBLE) AS x FROM g LEFT JOIN b USING (signal_id, t))"""
HANKEL = "h AS (SELECT signal_id, t - j AS i, j, x FROM s, range(12) r(j) WHERE t - j BETWEEN 0 AND (SELECT max(t) FROM s) - 11)"


def dft(source: str, name: str = "f", key: str = "row_id", m: int = M, conjugate: int = -1) -> str:
    angle = f"2 * pi() * ((j * k) % {m}) / {m}"
    return f"{name} AS (SELECT {key}, k, sum(v * cos({angle})) / sqrt({m}) AS re, {conjugate} * sum(v * sin({angle})) / sqrt({m}) AS im FROM {source}, range({m}) r(k) GROUP BY ALL)"


def gram(source: str = "f") -> str:
    return f"gram AS (SELECT p.k AS k, q.k AS l, sum(p.re * q.re + p.im * q.im) AS re, sum(p.re * q.im - p.im * q.re) AS im FROM {source} p JOIN {source} q USING (row_id) GROUP BY ALL)"


def eig(conjugate: bool) -> str:
    """V^H C V or V C V of cov (a, b, c)."""
    sign = 1 if conjugate else -1
    left, right = f"2 * pi() * ((a * k) % {M}) / {M}", f"2 * pi() * ((b * l) % {M}) / {M}"
    return (
        f"half AS (SELECT a, l, sum(c * cos({right})) / sqrt({M}) AS re, -sum(c * sin({right})) / sqrt({M}) AS im FROM cov, range({M}) r(l) GROUP BY ALL), "
        f"gram AS (SELECT k, l, sum(re * cos({left}) - {sign} * im * sin({left})) / sqrt({M}) AS re, sum({sign} * re * sin({left}) + im * cos({left})) / sqrt({M}) AS im FROM half, range({M}) r(k) GROUP BY ALL)"
    )


def kappa(size: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"SELECT {head}d / m / (d / m + o / (m * m - m)) AS kappa FROM (SELECT {head}sum(CASE WHEN k = l THEN {size} ELSE 0 END) AS d, sum(CASE WHEN k = l THEN 0 ELSE {size} END) AS o, {M}::DOUBLE AS m FROM gram {tail})"


MODULUS, REAL = "sqrt(re * re + im * im)", "abs(re)"


def r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


FREQ = f"CASE WHEN 2 * k < {M} THEN k ELSE k - {M} END * 64.0::DOUBLE / {M}"
SPECTRUM = f"p AS (SELECT k, sum(re * re + im * im) / {M} AS power FROM f GROUP BY k)"
FILTERS = "fl AS (SELECT g, 0.5::DOUBLE AS gamma, 1.0::DOUBLE + size / 25.0::DOUBLE AS sigma, size * pi() / 50 AS theta, 2.0::DOUBLE + size / 10.0::DOUBLE AS lam, 0.1::DOUBLE AS psi FROM (SELECT p_partkey % 64 AS g, avg(p_size) AS size FROM part GROUP BY ALL))"
PART_FILTERS = "fl AS (SELECT p_partkey AS g, 0.5::DOUBLE AS gamma, 1.0::DOUBLE + p_size / 25.0::DOUBLE AS sigma, p_size * pi() / 50 AS theta, 2.0::DOUBLE + p_size / 10.0::DOUBLE AS lam, 0.1::DOUBLE AS psi FROM part)"
BASIS = """gr AS (SELECT g, gamma, sigma, theta, lam, psi, xi, yi, -4 + xi * 8.0::DOUBLE / 7 AS gx, -4 + yi * 8.0::DOUBLE / 7 AS gy FROM fl, range(8) a(xi), range(8) b(yi)),
ro AS (SELECT *, gx * cos(theta) + gy * sin(theta) AS al, -gx * sin(theta) + gy * cos(theta) AS ac FROM gr),
bs AS (SELECT g, xi, yi, exp(-0.5::DOUBLE * (al * al / (sigma * sigma) + ac * ac * gamma * gamma / (sigma * sigma))) * cos(2 * pi() / lam * al + psi) AS v FROM ro)"""
MADE = "made AS (SELECT row_id AS window_id, xi * 8 + yi AS p, sum(x.v * bs.v) AS v FROM x JOIN bs ON x.j = bs.g GROUP BY ALL)"
FLAT = "w AS (SELECT (row_id * 64 + j) // 64 AS window_id, (row_id * 64 + j) % 64 AS p, v FROM x)"
NEAREST = f"""{SERIES}, lfp AS (SELECT t::DOUBLE AS time, x FROM s WHERE signal_id = 'view'),
tr AS (SELECT event_id AS trigger, (epoch_us(ts) - 1704067200000000) / 21600000000.0::DOUBLE AS began FROM events WHERE event_type = 'purchase'),
o AS (SELECT trigger, n::BIGINT AS shift, began + n AS time FROM tr, range(-2, 3) q(n)),
e AS (SELECT o.trigger, o.shift, o.time, l.time AS found_time, l.x AS lfp, row_number() OVER (PARTITION BY o.trigger, o.shift ORDER BY abs(l.time - o.time), l.time DESC) AS n
      FROM o JOIN lfp l ON l.time BETWEEN least(o.time, (SELECT max(time) FROM lfp)) - 1 AND greatest(o.time, 0) + 1)"""


def oracle_sql() -> dict[str, str]:
    cov = f"WITH {X}, {CENTRED}, {COV}"
    fourier = f"WITH {X}, {dft('x')}"
    counts = "SELECT signal_id, t, least(t + 1, n - t, {middle}) AS cells FROM (SELECT signal_id, t, count(*) OVER (PARTITION BY signal_id) AS n FROM s)"
    scored = "z AS (SELECT row_id, j, (v - avg(v) OVER q) / stddev_pop(v) OVER q AS v FROM x WINDOW q AS (PARTITION BY row_id))"
    sql = {
        "center_columns": f"WITH {X}, {CENTRED} SELECT row_id, j, {r('v', 6, 'v')} FROM c",
        "circulant_matrix": f"WITH {MEANS} SELECT row_id, n AS shift, (j + n) % 64 AS j, {r('v', 6, 'v')} FROM lm, range(64) q(n)",
        "tile_rows": f"WITH {MEANS} SELECT row_id, n AS copy, j, {r('v', 6, 'v')} FROM lm, range(20) q(n)",
        "gaussian_pulse": f"SELECT p_partkey, i, {r('10 * exp(-0.5::DOUBLE * pow((-100 + i * 10.0::DOUBLE) / p_size, 2)) / (p_size * sqrt(2 * pi()))', 8, 'v')} FROM part, range(21) q(i)",
        "mix_signals": f"WITH {X} SELECT a.row_id, a.j, {r('a.v + b.v', 6, 'v')} FROM x a JOIN x b ON a.row_id = b.row_id AND b.j = (a.j + 63) % 64",
        "dft_rows": f"{fourier} SELECT row_id, k, {r('re', 6, 're')}, {r('im', 6, 'im')} FROM f",
        "dft_basis": f"WITH {MEANS}, {dft('lm')} SELECT row_id, k, {r('re', 6, 're')}, {r('im', 6, 'im')} FROM f",
        "column_norms": f"{fourier} SELECT k, {r('sqrt(sum(re * re + im * im))', 6, 'norm')} FROM f GROUP BY k",
        "eigenspectrum_full": f"{fourier}, {SPECTRUM} SELECT k, {r(FREQ, 6, 'freq')}, {r('power', 6, 'power')} FROM p",
        "eigenspectrum_pos": f"{fourier}, {SPECTRUM} SELECT k, {r(FREQ, 6, 'freq')}, {r('power', 6, 'power')} FROM p WHERE 2 * k < {M}",
        "spectrum_normalized": f"{fourier}, {SPECTRUM} SELECT k, {r(FREQ, 6, 'freq')}, {r('power / avg(power) OVER ()', 6, 'power')} FROM p WHERE 2 * k < {M}",
        "fft_frequencies": f"WITH {SERIES} SELECT signal_id, t AS k, {r('CASE WHEN 2 * t < n THEN t ELSE t - n END * 4.0::DOUBLE / n', 8, 'freq')} FROM (SELECT signal_id, t, count(*) OVER (PARTITION BY signal_id) AS n FROM s)",
        "covariance": f"{cov} SELECT a, b, {r('c', 8, 'c')} FROM cov",
        "cov_eigenspectrum": f"{cov} SELECT k, {r(FREQ, 6, 'freq')}, {r(f'sum(c * cos(2 * pi() * ((k * (a - b + {M})) % {M}) / {M})) / {M}', 6, 'power')} FROM cov, range({M // 2}) q(k) GROUP BY k",
        "dft2": f"{cov}, {eig(False)} SELECT k, l, {r('re', 6, 're')}, {r('im', 6, 'im')} FROM gram",
        "fourier_eig": f"{cov}, {eig(True)} SELECT k, l, {r('re', 6, 're')}, {r('im', 6, 'im')} FROM gram",
        "fourier_gram": f"{fourier}, {gram()} SELECT k, l, {r('re', 6, 're')}, {r('im', 6, 'im')} FROM gram",
        "kappa_svd": f"WITH {X}, {CENTRED}, {dft('c')}, {gram()} SELECT {r('kappa', 6, 'kappa')} FROM ({kappa(MODULUS)})",
        "kappa_eig": f"{cov}, {eig(True)} SELECT {r('kappa', 6, 'kappa')} FROM ({kappa(MODULUS)})",
        "kappa_raw": f"{fourier}, {gram()} SELECT {r('kappa', 6, 'kappa')} FROM ({kappa(MODULUS)})",
        "kappa_fft": f"{fourier}, {gram()} SELECT {r('kappa', 6, 'kappa')} FROM ({kappa(REAL)})",
        "kappa_of_covariance": f"{cov}, y AS (SELECT a AS row_id, b AS j, c - avg(c) OVER (PARTITION BY b) AS v FROM cov), {dft('y')}, {gram()} SELECT {r('kappa', 6, 'kappa')} FROM ({kappa(MODULUS)})",
        "epsilon": f"{cov}, {eig(True)} SELECT {r(f'sum(CASE WHEN k <> l THEN re * re + im * im ELSE 0 END) / {M}', 6, 'epsilon')} FROM gram",
        "kappa_convergence": f"""WITH {X}, pick AS (
            SELECT size, rep, vec_id AS row_id, row_number() OVER (PARTITION BY size, rep ORDER BY md5(size || ':' || rep || ':' || vec_id), vec_id) AS n
            FROM embeddings, (VALUES (10), (40), (160)) a(size), range(3) b(rep)
          ), u AS (SELECT size, rep, row_id, j, v - avg(v) OVER (PARTITION BY size, rep, j) AS v FROM pick JOIN x USING (row_id) WHERE n <= size),
          t AS (SELECT size, rep, count(DISTINCT row_id) AS rows FROM u GROUP BY ALL),
          cov AS (SELECT size, rep, p.j AS a, q.j AS b, sum(p.v * q.v) / (any_value(rows) - 1) AS c FROM u p JOIN u q USING (size, rep, row_id) JOIN t USING (size, rep) GROUP BY ALL),
          y AS (SELECT size, rep, a AS row_id, b AS j, c - avg(c) OVER (PARTITION BY size, rep, b) AS v FROM cov), {dft('y', key='size, rep, row_id')},
          gram AS (SELECT p.size, p.rep, p.k AS k, q.k AS l, sum(p.re * q.re + p.im * q.im) AS re, sum(p.re * q.im - p.im * q.re) AS im FROM f p JOIN f q USING (size, rep, row_id) GROUP BY ALL)
          SELECT size::BIGINT AS size, {r(f'size / {M}', 6, 'ratio')}, {r('avg(kappa)', 6, 'kappa')} FROM ({kappa(MODULUS, 'size, rep')}) GROUP BY size""",
        "spectrum_inversion": f"""{fourier}, {CENTRED}, {dft('c', 'fc')},
          lam AS (SELECT k, sum(re * re + im * im) / (SELECT count(*) - 1 FROM embeddings) AS lam FROM fc GROUP BY k),
          nrm AS (SELECT k, sum(re * re + im * im) AS total FROM f GROUP BY k),
          y AS (SELECT row_id, k, re * sqrt(lam / total) AS re, im * sqrt(lam / total) AS im FROM f JOIN lam USING (k) JOIN nrm USING (k))
          SELECT row_id, j, {r(f'sum(re * cos(2 * pi() * ((j * k) % {M}) / {M}) - im * sin(2 * pi() * ((j * k) % {M}) / {M})) / sqrt({M})', 6, 'v')} FROM y, range({M}) q(j) GROUP BY row_id, j""",
        "mean_psd": f"WITH {X}, {scored}, {dft('z')} SELECT k, {r(FREQ, 6, 'freq')}, {r(f'avg(re * re + im * im) * {M}', 6, 'power')} FROM f WHERE k >= 1 AND 2 * k < {M} GROUP BY k",
        "welch_psd": f"""WITH {X}, hann AS (SELECT i, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 16) AS w FROM range(16) q(i)),
          seg AS (SELECT row_id, s, j - 8 * s AS i, v - avg(v) OVER (PARTITION BY row_id, s) AS v FROM x, range(7) q(s) WHERE j - 8 * s BETWEEN 0 AND 15),
          p AS (SELECT row_id, s, k, pow(sum(v * w * cos(2 * pi() * ((i * k) % 16) / 16)), 2) + pow(sum(v * w * sin(2 * pi() * ((i * k) % 16) / 16)), 2) AS p FROM seg JOIN hann USING (i), range(9) q(k) GROUP BY ALL)
          SELECT row_id, k, k * 4.0::DOUBLE AS freq, {r('avg(p) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (64 * (SELECT sum(w * w) FROM hann))', 8, 'power')} FROM p GROUP BY row_id, k""",
        "matrix_multiply": f"{cov} SELECT p.a AS i, q.b AS j, {r('sum(p.c * q.c)', 8, 'v')} FROM cov p JOIN cov q ON p.b = q.a GROUP BY ALL",
        "matrix_trace": f"{cov} SELECT {r('sum(c)', 8, 'trace')} FROM cov WHERE a = b",
        "hankel_embed": f"WITH {SERIES}, {HANKEL} SELECT signal_id, i, j, {r('x', 6, 'x')} FROM h",
        "hankel_average": f"WITH {SERIES}, {HANKEL} SELECT signal_id, i + j AS t, {r('avg(x)', 6, 'y')} FROM h GROUP BY signal_id, i + j",
        "lag_covariance": f"WITH {SERIES}, {HANKEL} SELECT p.signal_id, p.j AS i, q.j AS j, {r('sum(p.x * q.x)', 4, 'c')} FROM h p JOIN h q USING (signal_id, i) GROUP BY ALL",
        "diagonal_counts": f"WITH {SERIES} {counts.format(middle='n - 49, 50')}",
        "diagonal_counts_compat": f"WITH {SERIES} {counts.format(middle='n - 98, 50')}",
        "ssa_reconstruct_all": f"WITH {SERIES} SELECT signal_id, t, {r('x', 4, 'y')} FROM s",
        "ssa_residual": f"WITH {SERIES} SELECT signal_id, t, 0.0::DOUBLE AS residual FROM s",
        "gabor_grid": f"SELECT p_partkey, xi, yi, {r('-ceil(n / 2.0::DOUBLE) + xi * n::DOUBLE / (n - 1)', 8, 'gx')}, {r('-ceil(n / 2.0::DOUBLE) + yi * n::DOUBLE / (n - 1)', 8, 'gy')} FROM (SELECT p_partkey, 4 + p_size % 5 AS n FROM part), range(8) a(xi), range(8) b(yi) WHERE xi < n AND yi < n",
        "gabor_basis": f"WITH {PART_FILTERS}, {BASIS} SELECT g, xi, yi, {r('v', 8, 'v')} FROM bs",
        "gabor_forward": f"WITH {X}, {FILTERS}, {BASIS}, {MADE} SELECT window_id, p, {r('v', 6, 'v')} FROM made",
        "gabor_mse": f"WITH {X}, {FILTERS}, {BASIS}, {MADE}, {FLAT} SELECT {r('avg(pow(made.v - w.v, 2))', 6, 'mse')} FROM made JOIN w USING (window_id, p)",
        "gabor_sparsity": f"WITH {X} SELECT {r('0.01::DOUBLE * sum(abs(v)) / sqrt(sum(v * v))', 6, 'penalty')} FROM x",
        "global_standardize": f"WITH {X}, {FLAT} SELECT window_id, p, {r('(v - avg(v) OVER ()) / stddev_samp(v) OVER ()', 6, 'v')} FROM w",
        "image_windows": f"WITH {X} SELECT (row_id // 8) * 8 + j // 8 AS window_id, (row_id % 8) * 8 + j % 8 AS p, {r('v', 6, 'v')} FROM x",
        "image_crop": f"WITH {X} SELECT row_id AS y, j AS x, {r('v', 6, 'v')} FROM x WHERE j < 48",
        "image_mse": f"WITH {X} SELECT {r('avg(pow(z - v, 2))', 4, 'mse')} FROM (SELECT v, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM x)",
        "distinct_types": "SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'",
        "epoch_nearest": f"WITH {NEAREST} SELECT trigger, {r('time', 6, 'time')}, shift, {r('found_time', 6, 'found_time')}, {r('lfp', 6, 'lfp')} FROM e WHERE n = 1",
        "epoch_rows": f"WITH {NEAREST} SELECT trigger, shift + 2 AS place, {r('lfp', 6, 'v')} FROM e WHERE n = 1",
        "drop_nan_rows": f"WITH {X} SELECT row_id, j, {r('v', 6, 'v')} FROM x WHERE row_id % 50 <> 0",
        "limit_rows": "SELECT event_type, event_id FROM events ORDER BY event_type, event_id LIMIT 500",
        "sample_rows": "SELECT vec_id AS row_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 200",
        "shuffled_rows": "SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS place FROM embeddings",
        "label_format": "SELECT event_type || '_of_' || user_id || '_users' AS name, upper(event_type[1]) || event_type[2:] || ' Of ' || user_id || ' Users' AS label, count(*) AS n FROM events GROUP BY event_type, user_id",
        "row_gather": f"WITH {X} SELECT row_id, j, {r('v', 6, 'v')} FROM x WHERE row_id % 10 = 0",
        "stacked_shuffles": "SELECT seed, vec_id AS row_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || vec_id), vec_id) - 1 AS place FROM embeddings, range(20) s(seed)",
        "padded_rows": f"WITH {SERIES}, n AS (SELECT signal_id, max(t) + 1 AS n FROM s GROUP BY signal_id), c AS (SELECT signal_id, unnest(range(n + 50)) AS j FROM n) SELECT signal_id, j, {r('coalesce(x, 0)', 6, 'v')} FROM c LEFT JOIN (SELECT signal_id, t + 20 AS j, x FROM s) USING (signal_id, j)",
        "first_row": f"SELECT event_type, event_id, user_id, {r('value', 6, 'value')} FROM events WHERE value >= 1 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1",
        "skipped_names": f"WITH {SERIES} SELECT event_type AS name, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type <> 'error' AND event_type NOT IN (SELECT signal_id FROM s WHERE x = 0) GROUP BY event_type",
        "svd_energy": f"WITH {X} SELECT {r('sum(v * v)', 4, 'energy')} FROM x",
        "subspace_energy": f"WITH {X} SELECT {r('sum(v * v)', 4, 'energy')} FROM x",
        "svd_rebuilt": f"WITH {X} SELECT row_id, j, {r('v', 4, 'v')} FROM x",
        "low_rank_full": f"WITH {X} SELECT row_id, j, {r('v', 4, 'v')} FROM x",
        "pca_variance": f"WITH {X} SELECT {r('sum(c)', 4, 'variance')} FROM (SELECT var_samp(v) AS c FROM x GROUP BY j)",
        "ssa_energy": f"WITH {SERIES}, {HANKEL} SELECT signal_id, {r('sum(x * x)', 2, 'energy')} FROM h GROUP BY signal_id",
        "ssa_long_energy": f"WITH {SERIES}, {HANKEL} SELECT signal_id, {r('sum(x * x)', 2, 'energy')} FROM h GROUP BY signal_id",
        "row_zscore": f"WITH {X}, {scored} SELECT row_id, j, {r('v', 6, 'v')} FROM z",
    }
    return sql
