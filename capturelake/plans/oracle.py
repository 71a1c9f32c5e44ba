"""DuckDB SQL with the rows of the engine's queries, written independently:
loops where the engine has closed forms, theta joins where it has hash joins,
folds where it has folds."""

from __future__ import annotations

from capturelake.functions.rate import AUDIO_RATES
from capturelake.plans import cutting, files
from capturelake.plans import queries as q
from capturelake.plans.derived import DUCK_CAPTURES, DUCK_COMPANIONS, DUCK_CUTS, DUCK_FRAMES

_RATES = ", ".join(map(str, AUDIO_RATES))
_AUDIO = f"len(list_filter([{_RATES}], lambda a: abs(header_rate - a) <= a * 0.05::DOUBLE)) > 0"


def _msps(path: str) -> str:
    tokens = rf"regexp_extract_all({path}, '(\d+(?:\.\d*)?(?:[mM][sS][pP][sS])?)', 1)"
    return f"list_filter(list_transform(list_filter({tokens}, lambda t: lower(t) LIKE '%msps'), lambda t: TRY_CAST(left(t, length(t) - 4) AS DOUBLE)), lambda x: x > 0)[1]"


_REAL = f"CASE WHEN {_AUDIO} THEN header_rate::DOUBLE WHEN {_msps('stem')} > 0 THEN {_msps('stem')} * 1000000::DOUBLE ELSE header_rate * 1000::DOUBLE END"
_RATED = f"rated AS (SELECT *, {_REAL} AS real, {_AUDIO} AS audio FROM captures)"
_WIDTH = "(channels * (bps // 8))::BIGINT"
_BOUND = f"CASE WHEN min_block > 0 AND max_frame > 0 THEN (declared // min_block + 1)::HUGEINT * max_frame ELSE declared::HUGEINT * {_WIDTH} * 105 // 100 + 65536 END"
_STATS = "min_block > 0 AND max_block > 0 AND min_frame > 0 AND max_frame > 0"
# the loops: which numbers of wraps fit the frames' statistics, and the first that holds the payload
_UNWRAPPED = f"""
fine AS (SELECT *, CASE WHEN audio_bytes = 0 THEN true WHEN declared = 0 THEN false ELSE audio_bytes <= {_BOUND} END AS trusted FROM rated),
tried AS (
  SELECT *, CASE WHEN {_STATS} AND declared > 0 AND NOT trusted THEN list_filter(range(1, 4097), lambda k:
      declared + k * 68719476736 >= audio_bytes // max_frame * min_block AND declared + k * 68719476736 <= audio_bytes // min_frame * max_block) ELSE [] END AS exact,
    CASE WHEN {_WIDTH} > 0 AND NOT trusted THEN list_filter(range(1, 4097), lambda k: declared + k * 68719476736 >= (audio_bytes + {_WIDTH} - 1) // {_WIDTH})[1] END AS rough
  FROM fine),
unwrapped AS (
  SELECT *, CASE WHEN trusted THEN 0 WHEN len(exact) = 1 THEN exact[1] ELSE coalesce(rough, 0) END AS wraps,
    NOT trusted AND len(exact) <> 1 AND rough IS NOT NULL AS estimated, NOT trusted AND len(exact) <> 1 AND rough IS NULL AS beyond
  FROM tried)"""


def _ms(s: str) -> str:
    return f"(floor(greatest({s}, 0)) * 1000 + round((greatest({s}, 0) - floor(greatest({s}, 0))) * 1000))::BIGINT"


def _hms(s: str) -> str:
    m = _ms(s)
    return f"CASE WHEN {s} IS NOT NULL THEN printf('%02d:%02d:%02d.%03d', {m} // 3600000, {m} // 60000 % 60, {m} // 1000 % 60, {m} % 1000) END"


_LIMIT = 9223372036854775807


def _planned(start: str, length: str, rate: str, total: str, known: str, source: str, keep: str) -> str:
    bad = f"""CASE WHEN {rate} IS NULL OR NOT isfinite({rate}) OR {rate} <= 0 THEN 'sample rate is zero or invalid'
      WHEN {length} IS NULL OR NOT isfinite({length}) OR {length} <= 0 THEN 'length must be > 0'
      WHEN {start} IS NULL OR NOT isfinite({start}) OR {start} < 0 THEN 'start must be >= 0' END"""
    return f"""
p1 AS (SELECT {keep}, {start} AS st, {length} AS le, {rate} AS ra, {total} AS tot, {known} AS kn, {bad} AS bad FROM {source}),
p2 AS (SELECT *, CASE WHEN bad IS NULL THEN least(round(st * ra), 9.2e18)::HUGEINT END AS first, CASE WHEN bad IS NULL THEN least(round(le * ra), 9.2e18)::HUGEINT END AS own FROM p1),
p3 AS (SELECT *, coalesce(bad, CASE WHEN kn AND first >= tot THEN 'start is at or past the end of the file' END) AS error FROM p2),
p4 AS (SELECT *, greatest(1, CASE WHEN kn THEN least(own, tot - first) ELSE own END) AS length FROM p3),
planned AS (SELECT *, CASE WHEN error IS NULL THEN first::BIGINT END AS start_samples, CASE WHEN error IS NULL THEN length::BIGINT END AS length_samples,
  CASE WHEN error IS NULL THEN least(first + length, {_LIMIT})::BIGINT END AS end_sample, CASE WHEN kn AND bad IS NULL THEN tot / ra END AS real_total_seconds FROM p4)"""


_GIVEN = "coalesce(tag_rate > 0, false)"
_SCALE = "CASE WHEN tag_rate > 0 AND tag_rate < 1000000 THEN 1000 ELSE 1 END"
_TAGGED = f"CASE WHEN tag_total > 0 THEN least(tag_total::HUGEINT * {_SCALE}, 18446744073709551615::HUGEINT) END"
_SMALL = "scaled IS NOT NULL AND payload > 0 AND width > 0 AND scaled * width < payload"
_SANE = f"""
s1 AS (SELECT *, {_TAGGED} AS scaled, greatest(file_size - audio_offset, 0) AS payload, {_WIDTH} AS width FROM captures),
s2 AS (SELECT *, CASE WHEN {_SMALL} THEN CASE WHEN scaled * width * 1000 >= payload THEN 'kilo' ELSE 'drop' END ELSE 'keep' END AS verdict FROM s1),
sane AS (SELECT *, CASE verdict WHEN 'keep' THEN scaled WHEN 'kilo' THEN least(scaled * 1000, 18446744073709551615::HUGEINT) END AS kept,
  CASE WHEN verdict <> 'keep' THEN 'tag total ' || scaled || ' is too small for ' || payload || ' payload bytes: ' || CASE verdict WHEN 'kilo' THEN 'taken times 1000' ELSE 'ignored' END END AS sanity,
  CASE WHEN tag_total > 0 AND tag_rate > 0 AND abs(tag_total / tag_rate - tag_duration) > 1
    THEN 'tags disagree: total over rate is ' || floor(tag_total / tag_rate * 1000)::BIGINT || ' ms, duration ' || floor(tag_duration * 1000)::BIGINT || ' ms' END AS mismatch FROM s2)"""
_BASE = r"CASE WHEN regexp_matches({s}, '[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}}_[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{2}}') THEN regexp_extract({s}, '^(.*?[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}}_[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{2}})', 1, 's') ELSE {s} END"
_PAIRS = f"""
based AS (SELECT *, {_BASE.format(s="stem")} AS base FROM captures),
pairs AS (SELECT b.capture_id, lower(c.ext) AS kind, c.name, c.duration_s FROM based b JOIN companions c ON b.dir = c.dir AND starts_with(c.stem, b.base) AND lower(c.ext) IN ('log', 'wav'))"""
_FIRST = f"""{_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY kind, name) AS rn FROM pairs WHERE duration_s > 0)"""
_RESOLVED = f"""
{_RATED},
r1 AS (SELECT r.* EXCLUDE (audio_bytes, real), greatest(file_size - audio_offset, 0) AS audio_bytes, CASE WHEN {_GIVEN} THEN tag_rate::DOUBLE * {_SCALE} ELSE real END AS real FROM rated r),
{_UNWRAPPED.replace("FROM rated)", "FROM r1)").strip()},
{_SANE.strip().replace("FROM captures)", "FROM unwrapped)")},
{_FIRST.strip()},
given AS (SELECT capture_id, min(duration_s) AS told FROM ranked WHERE rn = 1 GROUP BY capture_id),
resolved AS (
  SELECT x.capture_id, x.real, x.wraps AS w, x.estimated AS e,
    CASE WHEN kept IS NOT NULL THEN 'vorbis-tag' WHEN declared > 0 AND audio_offset > 0 AND file_size > audio_offset THEN 'unwrapped'
      WHEN declared > 0 THEN 'plain' WHEN told > 0 THEN 'companion-file' WHEN audio_offset > 0 AND file_size > audio_offset AND scanned > 0 THEN 'scanned-from-frames' ELSE 'none' END AS how,
    kept, declared, told, scanned
  FROM sane x LEFT JOIN given g ON x.capture_id = g.capture_id)"""
_TOTAL = "CASE how WHEN 'vorbis-tag' THEN kept WHEN 'unwrapped' THEN declared + w * 68719476736::HUGEINT WHEN 'plain' THEN declared WHEN 'companion-file' THEN round(told * real) WHEN 'scanned-from-frames' THEN scanned END"
_SIGNAL = "signal AS (SELECT vec_id AS capture_id, unnest(embedding)::DOUBLE AS value, unnest(range(0, len(embedding)))::BIGINT AS pos FROM embeddings)"
_CUT_SIGNAL = f"WITH {_SIGNAL} SELECT capture_id, pos, value FROM signal WHERE pos >= capture_id % 40 AND pos < capture_id % 40 + capture_id % 30 + 1"
_PARTED = r"""parted AS (SELECT *, CASE WHEN contains(path, '/') THEN CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END ELSE '' END AS dir,
  regexp_extract(path, '([^/]*)$', 1) AS file FROM paths),
named AS (SELECT *, CASE WHEN strpos(file[2:], '.') > 0 THEN left(file, length(file) - strpos(reverse(file), '.')) ELSE file END AS stem,
  CASE WHEN strpos(file[2:], '.') > 0 THEN right(file, strpos(reverse(file), '.') - 1) END AS ext FROM parted)"""
_PATHS = f"paths AS (SELECT p_partkey, {q.PATHS} AS path FROM part)"
_NAME = "CASE dir WHEN '' THEN './' WHEN '/' THEN '/' ELSE dir || '/' END || stem || CASE WHEN n > 1 THEN '-cut-' || n ELSE '-cut' END || '.' || coalesce(ext, 'flac')"
_FOLD = """(SELECT path, list_reduce(list_prepend({'off': -1::BIGINT, 'bs': 0::BIGINT, 'number': -1::BIGINT, 'variable': false, 'n': 0::BIGINT, 'counted': 0::BIGINT, 'next': 0::BIGINT},
    list({'off': off, 'bs': block_size::BIGINT, 'number': number, 'variable': variable, 'n': 0::BIGINT, 'counted': 0::BIGINT, 'next': 0::BIGINT} ORDER BY off)),
  lambda a, f: CASE WHEN f.off >= a.next AND f.number = CASE WHEN f.variable THEN a.counted ELSE a.n END
    THEN {'off': f.off, 'bs': f.bs, 'number': f.number, 'variable': f.variable, 'n': a.n + 1, 'counted': a.counted + f.bs, 'next': f.off + 6} ELSE a END) AS s FROM frames GROUP BY path)"""
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_MARKERS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in q.MARKERS.items()) + " FROM events"
_CRC = "list_reduce(list_prepend(0, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1)))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor((x << 1) & 255, CASE WHEN x & 128 > 0 THEN 7 ELSE 0 END)))"
_TAIL = "CASE WHEN n > 1 THEN '-cut-' || n ELSE '-cut' END"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


_STATE = _with(DUCK_CAPTURES, DUCK_COMPANIONS, _RESOLVED)
_CHAINED = f"WITH {DUCK_FRAMES} SELECT path AS capture_id, s.counted AS counted, s.n AS n_frames FROM {_FOLD}"

ORACLE: dict[str, str] = {
    "flagship": _with(DUCK_CAPTURES, _RATED, _UNWRAPPED, _planned("60::DOUBLE", "10::DOUBLE", "real", "declared + wraps * 68719476736", "declared > 0", "unwrapped", "capture_id, real, audio, declared, wraps, estimated"))
    + f"SELECT capture_id, real AS real_rate_hz, NOT audio AS is_rf, (declared + wraps * 68719476736)::BIGINT AS total_samples, wraps::INT AS wraps, estimated, {_hms('((declared + wraps * 68719476736) / real)')} AS duration, start_samples, length_samples, end_sample, error FROM planned",
    "rate_resolve": _with(DUCK_CAPTURES, _RATED) + "SELECT capture_id, real AS real_rate_hz, NOT audio AS is_rf FROM rated",
    "rate_range_join": _with(DUCK_CAPTURES, f"r AS (SELECT unnest([{_RATES}]) AS rate)") + "SELECT capture_id, header_rate FROM captures WHERE EXISTS (SELECT 1 FROM r WHERE header_rate BETWEEN rate * 0.95 AND rate * 1.05)",
    "rate_tag_override": _with(DUCK_CAPTURES, _RATED) + f"SELECT capture_id, CASE WHEN {_GIVEN} THEN tag_rate::DOUBLE * {_SCALE} ELSE real END AS real_rate_hz, {_GIVEN} OR NOT audio AS is_rf, {_GIVEN} AS rate_from_vorbis, ({_SCALE})::BIGINT AS scale FROM rated",
    "msps_extract": f"SELECT p_partkey, {_msps('path')} AS msps FROM (SELECT p_partkey, {q.PART_PATH} AS path FROM part)",
    "capture_base": _with(DUCK_CAPTURES) + f"SELECT capture_id, {_BASE.format(s='stem')} AS base FROM captures",
    "path_parts": _with(_PATHS, _PARTED) + "SELECT p_partkey, dir, stem, ext FROM named",
    "flac_filter": _with(_PATHS) + "SELECT p_partkey, path FROM paths WHERE path ILIKE '%.flac'",
    "log_duration": rf"SELECT doc_id, list_filter(list_transform(regexp_extract_all(log, '(?i)duration[:= \t\n\f\r]*([0-9.]+)', 1), lambda t: TRY_CAST(t AS DOUBLE)), lambda x: x IS NOT NULL)[1] AS duration_s FROM (SELECT doc_id, {q.LOG_TEXT} AS log FROM documents)",
    "hms_parse": f"""WITH t AS (SELECT event_id, string_split(trim({q.HMS_TEXT}), ':') AS p FROM events),
n AS (SELECT event_id, p, list_transform(p, lambda x: CASE WHEN regexp_full_match(trim(x), '{_NUMBER}') THEN TRY_CAST(trim(x) AS DOUBLE) END) AS v FROM t),
f AS (SELECT event_id, len(p) AS k, v[-1] AS s, CASE WHEN len(p) >= 2 THEN v[-2] ELSE 0 END AS m, CASE WHEN len(p) >= 3 THEN v[-3] ELSE 0 END AS h FROM n)
SELECT event_id, CASE WHEN k <= 3 AND h >= 0 AND m >= 0 AND m < 60 AND s >= 0 AND s < 60 THEN h * 3600 + m * 60 + s END AS seconds FROM f""",
    "hms_format": f"WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS DOUBLE) + 0.9996::DOUBLE WHEN 1 THEN CAST(-3 AS DOUBLE) WHEN 2 THEN 3599.9999::DOUBLE ELSE value * 10 END AS s FROM events) SELECT event_id, {_hms('s')} AS hms, round(s * 10)::BIGINT AS deciseconds FROM t",
    "format_thousands": _with(DUCK_CAPTURES) + "SELECT capture_id, regexp_replace(reverse(regexp_replace(reverse(declared::VARCHAR), '([0-9]{3})', '\\1,', 'g')), '^,', '') AS text FROM captures",
    "real_duration": _with(DUCK_CAPTURES, _RATED) + "SELECT capture_id, declared / real AS seconds FROM rated",
    "tag_lookup": f"""WITH t AS (SELECT doc_id, {q.TAG_VALUE} AS v, {q.TAG_TIME} AS d FROM documents),
n AS (SELECT *, CASE WHEN regexp_full_match(v, '[+]?[0-9]+') THEN TRY_CAST(ltrim(v, '+') AS HUGEINT) END AS x FROM t)
SELECT doc_id, CASE WHEN x <= 18446744073709551615::HUGEINT THEN x::VARCHAR END AS total, CASE WHEN regexp_full_match(d, '{_NUMBER}') THEN TRY_CAST(d AS DOUBLE) END AS duration, NULL::VARCHAR AS album FROM n""",
    "tag_total_scale": _with(DUCK_CAPTURES) + f"SELECT capture_id, ({_TAGGED})::BIGINT AS total FROM captures",
    "tag_consistency": _with(DUCK_CAPTURES, _SANE) + "SELECT capture_id, mismatch AS warning FROM sane",
    "payload_sanity": _with(DUCK_CAPTURES, _SANE) + "SELECT capture_id, payload::BIGINT AS payload, width AS bytes_per_sample, kept::BIGINT AS total, sanity AS warning FROM sane",
    "warnings_concat": _with(DUCK_CAPTURES, _SANE) + "SELECT capture_id, concat_ws('; ', mismatch, sanity) AS warnings FROM sane",
    "wrap_correct": _with(DUCK_CAPTURES, _RATED, _UNWRAPPED) + "SELECT capture_id, trusted, (declared + wraps * 68719476736)::BIGINT AS total, wraps::INT AS wraps, estimated, beyond FROM unwrapped",
    "companion_join": _with(DUCK_CAPTURES, DUCK_COMPANIONS, _PAIRS) + "SELECT c.capture_id, kind, name, duration_s FROM captures c LEFT JOIN pairs p ON c.capture_id = p.capture_id",
    "companion_first": _with(DUCK_CAPTURES, DUCK_COMPANIONS, _FIRST) + "SELECT r.capture_id, r.duration_s, r.name, n_companions FROM ranked r JOIN (SELECT capture_id, count(*) AS n_companions FROM pairs GROUP BY capture_id) n ON r.capture_id = n.capture_id WHERE rn = 1",
    "companion_first_window": _with(DUCK_CAPTURES, DUCK_COMPANIONS, _FIRST) + "SELECT capture_id, duration_s, name FROM ranked WHERE rn = 1",
    "resolve_total": _STATE + f"SELECT capture_id, ({_TOTAL})::BIGINT AS total_samples, how <> 'none' AS total_samples_known, CASE WHEN how = 'unwrapped' THEN w ELSE 0 END::INT AS total_samples_wraps, how = 'unwrapped' AND e AS total_samples_estimated, real AS real_rate_hz FROM resolved",
    "provenance": _STATE + """SELECT CASE WHEN how IN ('vorbis-tag', 'companion-file', 'scanned-from-frames') THEN how WHEN how = 'unwrapped' AND w > 0 THEN 'wrap-corrected' ELSE 'header' END AS provenance,
  CASE WHEN how = 'companion-file' THEN 'rounded' WHEN how = 'unwrapped' AND e THEN 'estimated' ELSE 'exact' END AS exactness, count(*) AS n FROM resolved GROUP BY ALL""",
    "scan_sanity": _with(DUCK_CAPTURES) + f"SELECT capture_id, CASE WHEN {_WIDTH} > 0 AND scanned::HUGEINT * {_WIDTH} < audio_bytes THEN 'scanned ' || scanned || ' samples are too few for ' || audio_bytes || ' payload bytes' END AS warning FROM captures",
    "frame_chain": _CHAINED,
    "frame_chain_in_order": _CHAINED,
    "frame_chain_ranges": _CHAINED,
    "frame_sum": f"WITH {DUCK_FRAMES} SELECT path AS capture_id, sum(block_size)::BIGINT AS counted, count(*) AS n_frames FROM frames GROUP BY path",
    "frame_running_pos": f"WITH {DUCK_FRAMES} SELECT path AS capture_id, off, (sum(block_size) OVER (PARTITION BY path ORDER BY off) - block_size)::BIGINT AS start_sample FROM frames",
    "frame_gap_check": f"WITH {DUCK_FRAMES} SELECT path AS capture_id, off, number = coalesce(lag(number) OVER (PARTITION BY path ORDER BY off) + 1, 0) AS in_sequence FROM frames",
    "cut_plan": _with(DUCK_CAPTURES, DUCK_CUTS, _RATED, _UNWRAPPED, "asked AS (SELECT c.*, u.real, u.declared + u.wraps * 68719476736 AS total, coalesce(u.declared > 0, false) AS known FROM cuts c LEFT JOIN unwrapped u ON c.capture_id = u.capture_id)", _planned("start_sec", "len_sec", "real", "total", "known", "asked", "event_id"))
    + "SELECT event_id, error, start_samples, length_samples, end_sample, real_total_seconds FROM planned",
    "marker_normalise": f"""WITH m AS ({_MARKERS}),
k AS (SELECT *, greatest(span, 1) AS sp, greatest(hi, lo) AS rh, greatest(a, lo) AS ri, CASE WHEN total_s > 0 THEN least(t, total_s) ELSE t END AS tc FROM m),
o AS (SELECT *, CASE WHEN least(b, rh) < ri + sp THEN least(rh, ri + sp) ELSE least(b, rh) END AS ro FROM k)
SELECT event_id, CASE WHEN out_s - greatest(t, 0) < 0.1::DOUBLE THEN out_s - 0.1::DOUBLE ELSE greatest(t, 0) END AS new_in,
  CASE WHEN tc - in_s < 0.1::DOUBLE THEN in_s + 0.1::DOUBLE ELSE tc END AS new_out, CASE WHEN out_s <= in_s THEN 'OUT must be after IN.' END AS error,
  CASE WHEN hi <= lo THEN lo ELSE greatest(lo, least(v, b - sp)) END AS slider_in, CASE WHEN hi <= lo THEN hi ELSE greatest(a + sp, least(v, hi)) END AS slider_out,
  rh AS range_high, CASE WHEN ri > ro - sp THEN greatest(lo, ro - sp) ELSE ri END AS range_in, ro AS range_out FROM o""",
    "trim_rows": _CUT_SIGNAL,
    "trim_blocks": _CUT_SIGNAL,
    "trim_array": "SELECT vec_id AS capture_id, len(x)::BIGINT AS n, x[1]::DOUBLE AS first_value, x[-1]::DOUBLE AS last_value FROM (SELECT vec_id, embedding[(vec_id % 70 + 1):(vec_id % 70 + vec_id % 30 + 1)] AS x FROM embeddings)",
    "output_name": _with(
        f"paths AS (SELECT p_partkey, {q.PATHS} AS path FROM part UNION ALL SELECT p_partkey, {q.PATHS} || '.flac' FROM part WHERE p_partkey % 6 = 1)",
        _PARTED,
        f"there AS (SELECT {_NAME} AS name FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS n FROM named WHERE p_partkey % 2 = 0 UNION ALL SELECT *, 2 FROM named WHERE p_partkey % 4 = 0 UNION ALL SELECT *, 3 FROM named WHERE p_partkey % 3 = 0))",
        f"offered AS (SELECT path, n, {_NAME} AS name FROM (SELECT DISTINCT path, dir, stem, ext FROM named), range(1, 8) r(n))",
        "turns AS (SELECT path, row_number() OVER (PARTITION BY name ORDER BY path) AS turn FROM offered WHERE n = 1)",
        "free AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY n) AS k FROM offered WHERE name NOT IN (SELECT name FROM there))",
    )
    + "SELECT f.path, f.name AS output FROM free f JOIN turns t ON f.path = t.path AND f.k = t.turn",
    "utf8_truncate": """WITH t AS (SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'é€😀' WHEN 1 THEN 'ab' ELSE 'ü' END, p_name, 'éé') AS t FROM part)
SELECT p_partkey, list_filter(list_transform(range(0, length(t) + 1), lambda i: substr(t, 1, i)), lambda s: octet_length(encode(s)) <= 7)[-1] AS short,
  list_filter(list_transform(range(0, length(t) + 1), lambda i: substr(t, 1, i)), lambda s: octet_length(encode(s)) <= 15)[-1] AS long FROM t""",
    "crc8": f"SELECT p_partkey, ({_CRC})::INT AS crc FROM part",
    "streaminfo_unpack": _with(DUCK_CAPTURES) + "SELECT capture_id, min_block, max_block, min_frame, max_frame, header_rate AS rate, channels, bps, declared AS total, declared > 0 AS known FROM captures",
    "flac_header_scan": _with(DUCK_CAPTURES) + "SELECT capture_id, true AS ok, header_rate AS rate, declared AS total, bps, channels, min_block, max_block, min_frame, max_frame, tag_total FROM captures",
    "frame_scan": _with(DUCK_CAPTURES) + "SELECT capture_id, 0::BIGINT AS off, 192 AS block_size, 6 AS hlen, capture_id % 128 AS number, false AS variable FROM captures UNION ALL SELECT capture_id, 6 + capture_id % 20, 192, 6, capture_id % 127, false FROM captures",
    "wav_header": _with(DUCK_CAPTURES) + "SELECT capture_id, CASE WHEN capture_id % 11 <> 0 AND capture_id % 9 > 1 AND capture_id * 192 % 4000000000 > 0 THEN (capture_id * 192 % 4000000000) / (channels * (bps / 8)) / header_rate END AS duration_s FROM captures",
}
ORACLE |= {f"{name}_sql": ORACLE[name] for name in ("cut_plan", "rate_resolve", "capture_base")}
ORACLE |= files.ORACLE | cutting.ORACLE
