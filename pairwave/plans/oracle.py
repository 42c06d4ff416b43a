"""DuckDB SQL for the queries of the signal engine, put together from a few expressions."""

from __future__ import annotations

from pairwave.plans import queries as q

SEED, C = q.CONFIG.seed, q.CONFIG


def u(slot: str, i: str = "i") -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', ({i})::VARCHAR, '{slot}')), 1, 12))::UBIGINT::BIGINT::DOUBLE / pow(2.0::DOUBLE, 48))"


def between(slot: str, lo: float, hi: float) -> str:
    return f"({lo}::DOUBLE + {hi - lo}::DOUBLE * {u(slot)})"


def doubles(values: tuple[float, ...]) -> str:
    return "([" + ", ".join(f"{v}::DOUBLE" for v in values) + "])"


def check(x: str) -> str:
    return f"round(list_sum(list_transform({x}, lambda v, p: v * p)), 6) + 0.0::DOUBLE"


def six(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0::DOUBLE"


def rms(x: str) -> str:
    return f"greatest(sqrt(list_sum(list_transform({x}, lambda v: v * v)) / len({x})), 1e-12::DOUBLE)"


def peak(x: str) -> str:
    return f"list_max(list_transform({x}, lambda v: abs(v)))"


def convolved(x: str, h: tuple[float, ...]) -> str:
    return f"list_transform(range(len({x})), lambda k: list_sum(list_transform(range(least(k, {len(h) - 1}) + 1), lambda j: ({x})[k - j + 1] * {doubles(h)}[j + 1])))"


def segment(x: str, length: int, draw: str) -> str:
    start = f"floor({draw} * (abs(len({x}) - {length}) + 1))::BIGINT"
    zeros = lambda n: f"list_transform(range({n}), lambda z: 0.0::DOUBLE)"
    return f"CASE WHEN len({x}) >= {length} THEN ({x})[{start} + 1 : {start} + {length}] ELSE list_concat({zeros(start)}, {x}, {zeros(f'{length} - len({x}) - {start}')}) END"


def normal(p: str) -> str:
    return f"CASE WHEN {p} < 1e-8 THEN 1.0::DOUBLE ELSE {C.peak_norm_target}::DOUBLE / {p} END"


def db(x: str) -> str:
    return f"greatest(20 * log10(greatest({x}, 1e-12::DOUBLE)), -120::DOUBLE)"


V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"
PLAN = f"""{V},
    sp AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, printf('speech/%06d.wav', vec_id) AS name, x FROM v WHERE label < 5),
    np AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, printf('noise/%06d.wav', vec_id) AS name, x FROM v WHERE label >= 5),
    k AS (SELECT (SELECT count(*) FROM sp) AS n_s, (SELECT count(*) FROM np) AS n_n),
    plan AS (SELECT i, floor({u("speech")} * n_s)::BIGINT AS s_ord, floor({u("noise")} * n_n)::BIGINT AS n_ord, {between("snr", C.snr_min, C.snr_max)} AS snr_db,
             floor({u("rir_near")} * {q.RESPONSES})::BIGINT AS near_ord, floor({u("rir_far")} * {q.RESPONSES})::BIGINT AS far_ord, floor({u("rir_far")} * {q.RESPONSES - 1})::BIGINT AS other_ord
             FROM range((SELECT count(*) FROM embeddings)) t(i), k)"""
PAIRS = f"""{PLAN},
    p AS (SELECT i, snr_db, sp.name AS speech_file, np.name AS noise_file, {segment("sp.x", q.SEGMENT, u("soff"))} AS s0, {segment("np.x", q.SEGMENT, u("noff"))} AS n0
          FROM plan JOIN sp ON sp.ord = s_ord JOIN np ON np.ord = n_ord),
    c AS (SELECT i, snr_db, speech_file, noise_file, {convolved("s0", q.NEAR)} AS s, {convolved("n0", q.FAR)} AS n FROM p),
    g AS (SELECT *, {rms("s")} / pow(10::DOUBLE, snr_db / 20) / {rms("n")} AS gain FROM c),
    m AS (SELECT *, list_transform(range({q.SEGMENT}), lambda a: s[a + 1] + n[a + 1] * gain) AS noisy FROM g),
    z AS (SELECT *, {normal(peak("noisy"))} AS scale FROM m)"""
RANKED = f"""t AS (SELECT count(*) AS total FROM embeddings),
    r AS (SELECT i, row_number() OVER (ORDER BY {u("split")}, i) - 1 AS rank FROM range((SELECT total FROM t)) x(i)),
    a AS (SELECT i, CASE WHEN rank < floor(total * {C.train_ratio}::DOUBLE) THEN 'train' WHEN rank < floor(total * {C.train_ratio}::DOUBLE) + floor(total * {C.val_ratio}::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r, t),
    l AS (SELECT i, split, row_number() OVER (PARTITION BY split ORDER BY i) - 1 AS local_idx FROM a)"""
FILES = f"""WITH f AS (SELECT concat_ws('/', source, lang, printf('%06d', doc_id) || ({list(q.ENDINGS)})[doc_id % 7 + 1]) AS path, n_chars AS length FROM documents),
    e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM f),
    a AS (SELECT * FROM e WHERE ext IN ('.aif', '.aiff', '.flac', '.mp3', '.ogg', '.wav'))"""
EVENTS = f"""WITH e AS (SELECT user_id AS stream_id, ts, event_id AS seq, event_type AS kind, value,
        ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {q.BLOCK})::BIGINT AS block_idx FROM events),
    b AS (SELECT stream_id, block_idx, count(*) AS n, max(abs(value)) AS peak, max(ts) AS last_ts FROM e GROUP BY ALL)"""
HOUR = "(date_diff('day', DATE '1970-01-01', {0}::DATE) * 24 + hour({0}))::BIGINT"


def path_of(kind: str) -> str:
    return f"split || '/{kind}/' || CASE WHEN local_idx < 1000000 THEN printf('%06d', local_idx) ELSE local_idx::VARCHAR END || '.wav'"


def rooms() -> str:
    dims = ", ".join(f"{between(f'room_{a}', *r)} AS dim_{a}" for a, r in zip("xyz", C.room_dim_range, strict=True))
    mics = ", ".join(f"dim_{a} / 2 + {between(f'mic_{a}', -0.5, 0.5)} AS mic_{a}" for a in "xyz")
    across = ", ".join(f"dim_{a} * dim_{b} / sqrt(dim_{a} * dim_{a} + dim_{b} * dim_{b})" for a, b in ("xy", "xz", "yz"))
    return f"""WITH d AS (SELECT i, {dims}, {between("rt60", *C.rt60_range)} AS rt60 FROM range((SELECT count(*) FROM embeddings)) t(i)),
        r AS (SELECT *, {mics}, 24 * ln(10::DOUBLE) * (dim_x * dim_y * dim_z) / (343.0::DOUBLE * (2 * (dim_x * dim_y + dim_x * dim_z + dim_y * dim_z)) * rt60) AS absorption,
              ceil(343.0::DOUBLE * rt60 / least({across}) - 1)::BIGINT AS full_order FROM d)"""


def near_or_far(name: str, distance: tuple[float, float], rise: float) -> str:
    away, angle = between(f"{name}_d", *distance), between(f"{name}_angle", 0.0, 6.283185307179586)
    free = (f"mic_x + {away} * cos({angle})", f"mic_y + {away} * sin({angle})", f"mic_z + {between(f'{name}_z', -rise, rise)}")
    return ", ".join(f"{six(f'greatest(0.1::DOUBLE, least({p}, dim_{a} - 0.1::DOUBLE))')} AS {name}_{a}" for p, a in zip(free, "xyz", strict=True))


def devices() -> str:
    rows = ", ".join(f"({i}, '{n}', {a}, {b})" for i, n, a, b, _ in q.DEVICES)
    part = lambda d: f"SELECT '{d}' AS direction, i::BIGINT AS index, name || '  (' || n_{d} || 'ch)' AS label, i = {q.DEFAULT_IN} AS is_default_input, i = {q.DEFAULT_OUT} AS is_default_output FROM d WHERE n_{d} > 0"
    return f"WITH d(i, name, n_input, n_output) AS (VALUES {rows}) {part('input')} UNION ALL {part('output')}"


def of_vectors(y: str) -> str:
    return f"{V}, y AS (SELECT vec_id, {y} AS y FROM v) SELECT vec_id, len(y)::BIGINT AS n, {check('y')} AS checksum FROM y"


def one_check(y: str, more: str = "") -> str:
    return f"{V}, y AS (SELECT vec_id, label, {y} AS y FROM v) SELECT vec_id, {more} {check('y')} AS checksum FROM y"


CLIP = "least(greatest(v, -1::DOUBLE), 1::DOUBLE)"
FANNED = ", ".join(f"x[2 * f + {c % 2 + 1}]" for c in range(q.CHANNELS))
CONTROL = f"""SELECT stream_id, seq, {six("coalesce(last_value(CASE WHEN kind = 'signup' THEN value / 100 END IGNORE NULLS) OVER w, 0.0)")} AS gain_db,
    {six("coalesce(last_value(CASE WHEN kind = 'click' THEN least(greatest(value / 100, 0.0::DOUBLE), 1.0::DOUBLE) END IGNORE NULLS) OVER w, 1.0)")} AS strength
    FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
MANIFEST = f"""SELECT l.i::BIGINT AS index, l.split, speech_file, noise_file, round(snr_db, 2) + 0.0::DOUBLE AS snr_db, 'synthetic' AS rir_type, {path_of("noisy").replace("split", "l.split")} AS noisy_file, {path_of("clean").replace("split", "l.split")} AS clean_file
    FROM l JOIN z ON z.i = l.i"""

DEVICE = "greatest(coalesce(floor(arg), -1), -1)::BIGINT"


def held(command: str, value: str, first: str) -> str:
    return f"coalesce(last_value(CASE WHEN command = '{command}' THEN {value} END IGNORE NULLS) OVER w, {first})"


MONO = f"list_transform(range({q.BLOCK // q.CHANNELS_IN}), lambda f: x[{q.CHANNELS_IN} * f + 1])"
LIVE = f"""WITH e0 AS (SELECT user_id AS stream_id, ts, event_id AS seq, event_type AS kind, (value - 50) / 200 AS value,
        CASE WHEN event_type = 'signup' THEN 'SET_GAIN' WHEN event_type = 'click' THEN 'SET_STRENGTH' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'SET_ENABLED'
             WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'SET_INPUT_DEVICE' WHEN event_type = 'purchase' AND event_id % 4 = 1 THEN 'SET_OUTPUT_DEVICE'
             WHEN event_type = 'purchase' AND event_id % 4 = 2 THEN 'GET_DEVICES' WHEN event_type = 'purchase' AND event_id % 40 = 3 THEN 'SHUTDOWN' END AS command,
        CASE WHEN event_type IN ('signup', 'click') AND event_id % 5 > 0 THEN value / 100 WHEN event_type = 'view' THEN floor(value)::BIGINT % 2 WHEN event_type = 'purchase' THEN floor(value)::BIGINT % 6 - 1 END::DOUBLE AS arg FROM events),
    e AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN command = 'SHUTDOWN' THEN 1 ELSE 0 END) OVER w, 0) AS stopped FROM e0 WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE stopped = 0),
    s AS (SELECT *, {held('SET_ENABLED', 'coalesce(arg, 0) <> 0', 'true')} AS enabled, {held('SET_STRENGTH', 'CASE WHEN arg IS NOT NULL THEN least(greatest(arg, 0.0::DOUBLE), 1.0::DOUBLE) END', '1.0::DOUBLE')} AS strength, {held('SET_GAIN', 'arg', '0.0::DOUBLE')} AS gain_db,
                 {held('SET_INPUT_DEVICE', DEVICE, '-1')} AS input_device, {held('SET_OUTPUT_DEVICE', DEVICE, '-1')} AS output_device,
                 sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS faults,
                 ((row_number() OVER (PARTITION BY stream_id ORDER BY ts, seq) - 1) // {q.BLOCK})::BIGINT AS block_idx
          FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT stream_id, block_idx, list(value ORDER BY ts, seq) AS x, {", ".join(f"arg_min({c}, (ts, seq)) AS {c}" for c in q.CONTROLS)}, max(faults)::BIGINT AS faults, max(ts) AS last_ts, arg_max(seq, (ts, seq)) AS seq
          FROM s GROUP BY 1, 2 HAVING count(*) = {q.BLOCK}),
    d AS (SELECT *, {MONO} AS dry FROM b),
    n AS (SELECT *, CASE WHEN enabled THEN list_transform(dry, lambda v, p: (1 - strength) * v + strength * (v + CASE WHEN p > 1 THEN dry[p - 1] ELSE 0.0::DOUBLE END) / 2) ELSE dry END AS wet FROM d),
    z0 AS (SELECT *, list_transform(wet, lambda v: least(greatest(v * pow(10::DOUBLE, gain_db / 20), -1::DOUBLE), 1::DOUBLE)) AS y, {peak("x")} AS in_peak FROM n),
    z AS (SELECT *, {peak("y")} AS out_peak FROM z0),
    k AS (SELECT stream_id, {HOUR.format("last_ts")} AS tick, unnest(arg_max(struct_pack(seq := seq, in_peak := in_peak, out_peak := out_peak, faults := faults), block_idx)) FROM z GROUP BY 1, 2)"""
LIVE_COLUMNS = f"stream_id, block_idx, enabled, {six('strength')} AS strength, {six('gain_db')} AS gain_db, faults, {six('in_peak')} AS in_peak, {six('out_peak')} AS out_peak, {check(f'flatten(list_transform(y, lambda v: list_transform(range({q.CHANNELS_OUT}), lambda c: v)))')} AS checksum"
PROBLEM = f"""CASE WHEN command IN ('SET_STRENGTH', 'SET_GAIN') AND arg IS NULL THEN command || ': not a number'
    WHEN command IN ('SET_INPUT_DEVICE', 'SET_OUTPUT_DEVICE') AND arg >= 0 AND floor(arg)::BIGINT NOT IN ({", ".join(str(d[0]) for d in q.DEVICES)}) THEN command || ': no device ' || floor(arg)::BIGINT END"""
ANSWERS = f"""a AS (SELECT stream_id, seq, command, {PROBLEM} AS problem FROM e),
    answers AS (SELECT stream_id, seq, CASE WHEN problem IS NOT NULL THEN 'ERROR' WHEN command = 'GET_DEVICES' THEN 'DEVICE_LIST' ELSE 'ENGINE_STOPPED' END AS event,
        coalesce(problem, CASE WHEN command = 'GET_DEVICES' THEN '{", ".join(d[1] for d in q.DEVICES)}' END) AS payload, NULL::DOUBLE AS input_db, NULL::DOUBLE AS output_db, NULL::BIGINT AS faults
        FROM a WHERE problem IS NOT NULL OR command IN ('GET_DEVICES', 'SHUTDOWN'))"""

SQL: dict[str, str] = {
    "corpus_discover": f"{FILES} SELECT path, ext, length FROM a",
    "corpus_order": f"{FILES} SELECT row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS ord, path FROM a",
    "downmix": of_vectors("list_transform(range(len(x) // 2), lambda f: (x[2 * f + 1] + x[2 * f + 2]) / 2)"),
    "resample_fir": of_vectors(
        f"list_transform(range(ceil(len(x) * {q.UP} / {q.DOWN})::BIGINT), lambda m: list_sum(list_transform(range({len(q.TAPS)}), lambda j: "
        f"CASE WHEN m * {q.DOWN} + {len(q.TAPS) // 2} - j >= 0 AND (m * {q.DOWN} + {len(q.TAPS) // 2} - j) % {q.UP} = 0 AND m * {q.DOWN} + {len(q.TAPS) // 2} - j < len(x) * {q.UP} "
        f"THEN x[(m * {q.DOWN} + {len(q.TAPS) // 2} - j) // {q.UP} + 1] * {doubles(q.TAPS)}[j + 1] ELSE 0.0::DOUBLE END)))"
    ),
    "signal_rms": f"{V} SELECT vec_id, {six(rms('list_transform(x, lambda e, p: e * p)'))} AS rms FROM v",
    "signal_peak": f"{V} SELECT vec_id, {six(peak('x'))} AS peak FROM v",
    "segment_cut": of_vectors(segment("x", q.SEGMENT, u("soff", "vec_id"))),
    "segment_pad": of_vectors(segment("x", q.PADDED, u("soff", "vec_id"))),
    "convolve_array": of_vectors(convolved("x", q.NEAR)),
    "convolve_join": of_vectors(convolved("x", q.NEAR)),
    "fft_convolve": of_vectors(convolved("x", q.NEAR)),
    "convolve_chunked": of_vectors(convolved("x", q.NEAR)),
    "pair_sample": f"{PAIRS} SELECT i AS global_idx, speech_file, noise_file FROM p",
    "visit_pairs": f"{PAIRS} SELECT i AS global_idx, speech_file, noise_file, {check('s0')} AS speech_sum, {check('n0')} AS noise_sum FROM p",
    "wav_source": one_check("x", f"{C.target_sr}::BIGINT AS sr, len(y)::BIGINT AS frames,"),
    "rir_pair": f"{PLAN} SELECT i AS global_idx, near_ord AS rir_near_ord, far_ord AS rir_far_ord, other_ord + CASE WHEN other_ord >= near_ord THEN 1 ELSE 0 END AS rir_far_distinct_ord FROM plan",
    "snr_gain": f"{PAIRS} SELECT i AS global_idx, {six('gain')} AS gain FROM g",
    "mix_snr": f"{PAIRS} SELECT i AS global_idx, {check('noisy')} AS noisy_sum, {check('s')} AS clean_sum FROM m",
    "joint_normalise": f"{PAIRS} SELECT i AS global_idx, {check('list_transform(noisy, lambda e: e * scale)')} AS noisy_sum, {check('list_transform(s, lambda e: e * scale)')} AS clean_sum FROM z",
    "peak_normalise": one_check(f"list_transform(x, lambda e: e * ({normal(peak('x'))}))"),
    "split_sizes": f"SELECT n AS total, floor(n * {C.train_ratio}::DOUBLE)::BIGINT AS train, floor(n * {C.val_ratio}::DOUBLE)::BIGINT AS val, n - floor(n * {C.train_ratio}::DOUBLE)::BIGINT - floor(n * {C.val_ratio}::DOUBLE)::BIGINT AS test FROM (SELECT unnest({list(q.TOTALS)})::BIGINT AS n)",
    "split_assign": f"WITH {RANKED} SELECT i AS global_idx, split FROM a",
    "local_index": f"WITH {RANKED} SELECT i AS global_idx, split, local_idx FROM l",
    "output_paths": f"WITH {RANKED}, w AS (SELECT * FROM l UNION ALL SELECT i, split, local_idx + 1000000 FROM l) SELECT i AS global_idx, local_idx, {path_of('noisy')} AS noisy_file, {path_of('clean')} AS clean_file FROM w",
    "room_params": f"{rooms()} SELECT i AS global_idx, {', '.join(f'{six(n)} AS {n}' for n in [*(f'{k}_{a}' for k in ('dim', 'mic') for a in 'xyz'), 'rt60'])} FROM r",
    "inverse_sabine": f"{rooms()} SELECT i AS global_idx, {six('absorption')} AS absorption, full_order, least(full_order, 50)::BIGINT AS max_order, full_order > 50 AS order_capped, absorption <= 1 AS feasible FROM r",
    "source_positions": f"{rooms()} SELECT i AS global_idx, {near_or_far('near', C.nearfield_dist, 0.3)}, {near_or_far('far', C.farfield_dist, 0.5)} FROM r",
    "mix_pipeline": f"{PAIRS}, {RANKED} SELECT l.i AS global_idx, split, local_idx, speech_file, noise_file, {six('snr_db')} AS snr_db, {check('list_transform(noisy, lambda e: e * scale)')} AS noisy_sum, {check('list_transform(s, lambda e: e * scale)')} AS clean_sum FROM l JOIN z ON z.i = l.i",
    "manifest_rows": f"{PAIRS}, {RANKED} {MANIFEST}",
    "manifest_json": f"{PAIRS}, {RANKED}, j AS ({MANIFEST}) SELECT index, json_object('index', index, 'speech_file', speech_file, 'noise_file', noise_file, 'snr_db', snr_db, 'rir_type', rir_type, 'noisy_file', noisy_file, 'clean_file', clean_file)::VARCHAR AS json FROM j",
    "manifest_summary": f"WITH {RANKED} SELECT s AS split, (SELECT count(*) FROM l WHERE split = s) AS count FROM (SELECT unnest(['train', 'val', 'test']) AS s)",
    "pcm16": f"{V}, y AS (SELECT vec_id, list_transform(x, lambda e: round(least(greatest(e * 4, -1::DOUBLE), 1::DOUBLE) * 32767)::BIGINT) AS y FROM v) SELECT vec_id, list_sum(y)::BIGINT AS total, list_max(y) AS most FROM y",
    "wav_roundtrip": one_check(f"list_transform(x, lambda v: round({CLIP} * 32767) / 32768)", "48000::BIGINT AS sr,"),
    "gain_clip": f"{V}, y AS (SELECT vec_id, list_transform(x, lambda e: least(greatest(e * pow(10::DOUBLE, {4 * q.GAIN_DB}::DOUBLE / 20), -1::DOUBLE), 1::DOUBLE)) AS y FROM v) SELECT vec_id, {six(peak('y'))} AS peak, {check('y')} AS checksum FROM y",
    "wet_dry": f"{V}, w AS (SELECT vec_id, x, {convolved('x', q.FAR)} AS w FROM v) SELECT vec_id, {check(f'list_transform(range(len(x)), lambda a: {1 - q.STRENGTH}::DOUBLE * x[a + 1] + {q.STRENGTH}::DOUBLE * w[a + 1])')} AS checksum FROM w",
    "enabled_switch": one_check(f"CASE WHEN label % 2 = 0 THEN {convolved('x', q.FAR)} ELSE x END", "label % 2 = 0 AS enabled,"),
    "channel_fanout": of_vectors(f"flatten(list_transform(range(len(x) // 2), lambda f: [{FANNED}]))"),
    "denoiser_udf": one_check(f"list_transform(x, lambda e, p: {1 - q.STRENGTH}::DOUBLE * e + {q.STRENGTH}::DOUBLE * (e + CASE WHEN p > 1 THEN x[p - 1] ELSE 0.0::DOUBLE END) / 2)"),
    "denoiser_passthrough": one_check("x"),
    "channel_slice": of_vectors("flatten(list_transform(range(len(x) // 4), lambda f: x[4 * f + 1 : 4 * f + 3]))"),
    "percent_label": "SELECT event_id, printf('%d %%', floor(value)::BIGINT % 101) AS label FROM events",
    "status_text": f"{EVENTS} SELECT stream_id, seq, 'Engine running' || CASE WHEN n > 0 THEN '  |  x-runs: ' || n ELSE '' END AS text FROM (SELECT stream_id, seq, (sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS n FROM e)",
    "control_state": f"{LIVE} SELECT stream_id, seq, enabled, {six('strength')} AS strength, {six('gain_db')} AS gain_db, input_device, output_device FROM s",
    "live_blocks": f"{LIVE} SELECT {LIVE_COLUMNS}, input_device, output_device FROM z",
    "stream_live": f"{LIVE} SELECT {LIVE_COLUMNS} FROM z",
    "engine_events": f"{LIVE}, {ANSWERS} SELECT * FROM answers UNION ALL SELECT stream_id, seq, 'STATUS', NULL, {six(db('in_peak'))}, {six(db('out_peak'))}, faults FROM k",
    "stream_answers": f"{LIVE}, {ANSWERS} SELECT stream_id, seq, event, payload FROM answers",
    "device_filter": devices(),
    "block_meter": f"{EVENTS} SELECT stream_id, block_idx, n, {six('peak')} AS peak, {six(db('peak'))} AS level_db FROM b",
    "status_last": f"{EVENTS} SELECT stream_id, {HOUR.format('last_ts')} AS tick, {six('arg_max(' + db('peak') + ', block_idx)')} AS level_db FROM b GROUP BY 1, 2",
    "xrun_cumulative": f"{EVENTS} SELECT stream_id, seq, (sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS faults FROM e",
    "control_asof": f"{EVENTS} {CONTROL}",
    "meter_value": f"SELECT event_id, greatest(-60, least(0, trunc({db('value / 1000')})))::BIGINT AS meter FROM events",
    "level_label": f"WITH e AS (SELECT event_id, {db('value / 1000')} AS d FROM events) SELECT event_id, CASE WHEN d <= -120 THEN '-∞' ELSE printf('%.0f', d) END AS label FROM e",
    "gain_label": "WITH e AS (SELECT event_id, (floor(value)::BIGINT % 241 - 120) AS slider FROM events) SELECT event_id, slider, printf('%+.1f dB', slider / 10::DOUBLE) AS label FROM e",
    "stream_blocks": f"{EVENTS} SELECT stream_id, block_idx, {six('max(abs(value))')} AS peak, max(f)::BIGINT AS faults FROM (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS f FROM e) GROUP BY 1, 2 HAVING count(*) = {q.BLOCK}",
    "stream_control": f"{EVENTS} {CONTROL}",
    "stream_status": f"{LIVE} SELECT stream_id, tick, {six(db('in_peak'))} AS input_db, {six(db('out_peak'))} AS output_db, faults FROM k",
}

# The same of all events as one stream, and of signals in chunks.
for scan, twin in (("scan_blocks", "block_meter"), ("scan_faults", "xrun_cumulative"), ("scan_control", "control_asof")):
    SQL[scan] = SQL[twin].replace("user_id AS stream_id", "0::BIGINT AS stream_id").replace("PARTITION BY user_id ", "")
SQL["resample_chunked"] = SQL["resample_fir"]
SQL |= {"processor_blocks": SQL["stream_blocks"], "processor_control": SQL["stream_control"], "ordered_control": SQL["control_state"]}
SQL["stream_progress"] = "SELECT count(*) AS rows_in, count(*) AS made, count(*) FILTER (event_type = 'error') AS faults FROM events"
SQL["stream_backlog"] = f"""WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS o, count(*) OVER () AS n FROM events)
    SELECT (o // {q.ADMITTED}) * {q.ADMITTED} AS start, max(o) + 1 AS "end", max(n) - max(o) - 1 AS backlog, count(*) AS rows, count(*) FILTER (event_type = 'error') AS faults, max(event_id) AS last_event
    FROM e GROUP BY 1"""
SQL["split_by_source"] = f"""{V}, {RANKED},
    f AS (SELECT CASE WHEN label < 5 THEN 'speech' ELSE 'noise' END AS pool, printf('%s/%06d.wav', CASE WHEN label < 5 THEN 'speech' ELSE 'noise' END, vec_id) AS name, len(x) AS weight, {u("source", "vec_id")} AS draw FROM v),
    m AS (SELECT *, (sum(weight) OVER (PARTITION BY pool ORDER BY draw, name ROWS UNBOUNDED PRECEDING) - weight / 2) / sum(weight) OVER (PARTITION BY pool) AS share FROM f),
    p AS (SELECT pool, name, CASE WHEN share < {C.train_ratio}::DOUBLE THEN 'train' WHEN share < {C.train_ratio + C.val_ratio}::DOUBLE THEN 'val' ELSE 'test' END AS split FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY pool, split ORDER BY {u("pool", "name")}, name) - 1 AS ord FROM p),
    k AS (SELECT pool, split, count(*) AS n FROM p GROUP BY pool, split)
    SELECT a.i AS global_idx, a.split, s.name AS speech_file, z.name AS noise_file FROM a
    LEFT JOIN k ks ON ks.pool = 'speech' AND ks.split = a.split LEFT JOIN k kn ON kn.pool = 'noise' AND kn.split = a.split
    LEFT JOIN o s ON s.pool = 'speech' AND s.split = a.split AND s.ord = floor({u("speech", "a.i")} * ks.n)
    LEFT JOIN o z ON z.pool = 'noise' AND z.split = a.split AND z.ord = floor({u("noise", "a.i")} * kn.n)"""
