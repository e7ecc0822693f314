"""DuckDB SQL for the queries of :mod:`tidelog.plans.catalogue`, and the literals both share."""

from __future__ import annotations

#: Memtable limit of the fixtures, in bytes.
LIMIT = 16 << 10
PUTS = [("key1", "a"), ("key1", "b"), ("key3", ""), ("new key", "c"), ("gone key", None)]

_LOG = """ops AS (
  SELECT 'key' || CAST(user_id AS VARCHAR) AS key, event_type = 'error' AS asked_delete,
         event_type = 'error' OR (event_type = 'view' AND event_id % 10 = 0) AS gone,
         event_type || ':' || CAST(event_id AS VARCHAR) AS given, event_id + 1 AS seq FROM events),
log AS (SELECT key, CASE WHEN NOT gone THEN given END AS value, CAST(gone AS INTEGER) AS op, seq FROM ops),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS age FROM log),
newest AS (SELECT key, value, op, seq FROM ranked WHERE age = 1),
live AS (SELECT key, value, seq FROM newest WHERE op = 0),
probes AS (SELECT event_id AS pos, 'key' || CAST(user_id * 2 AS VARCHAR) AS key FROM events)"""
_CUT = f"""sized AS (SELECT *, strlen(key) + coalesce(strlen(value), 0) AS n_bytes FROM log),
summed AS (SELECT *, CAST(sum(n_bytes) OVER (ORDER BY seq) AS BIGINT) AS total FROM sized),
bases AS (
  SELECT 0 AS memtable_id, CAST(0 AS BIGINT) AS base
  UNION ALL
  SELECT max(memtable_id) + 1, min(total) FROM bases, summed WHERE total >= base + {LIMIT} HAVING min(total) IS NOT NULL),
spans AS (SELECT memtable_id, base, lead(base) OVER (ORDER BY memtable_id) AS until FROM bases),
cut AS (SELECT s.key, s.value, s.op, s.seq, s.n_bytes, CAST(p.memtable_id AS BIGINT) AS memtable_id
        FROM summed s JOIN spans p ON s.total > p.base AND (p.until IS NULL OR s.total <= p.until)),
tiered AS (SELECT *, CASE WHEN m = memtable_id THEN 0 WHEN m - memtable_id <= 2 THEN 1 WHEN m - memtable_id <= 5 THEN 2 ELSE 3 END AS tier
           FROM (SELECT *, max(memtable_id) OVER () AS m FROM cut)),
files AS (SELECT memtable_id AS sst_id, tier - 2 AS level, min(key) AS smallest_key, max(key) AS largest_key
          FROM tiered WHERE tier >= 2 GROUP BY ALL)"""


def _q(body: str, cut: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if cut or more else ''}{_LOG}{', ' + _CUT if cut else ''}{', ' + more if more else ''} {body}"


def _get(key: str) -> str:
    return _q(f"SELECT k.key, coalesce(n.op, 2) AS status, n.value FROM (SELECT {key} AS key) k LEFT JOIN newest n USING (key)")


def _literal(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _batch(delete: bool) -> str:
    rows = ", ".join(f"({i}, '{k}', {_literal(None if delete else v)})" for i, (k, v) in enumerate(PUTS))
    return _q("SELECT key, value, CAST(op AS INTEGER) AS op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM "
              "(SELECT key, value, op, seq FROM log UNION ALL SELECT key, nullif(value, ''), CASE WHEN coalesce(value, '') = '' THEN 1 ELSE 0 END, "
              f"(SELECT max(seq) FROM log) + 1 + i FROM (VALUES {rows}) AS b(i, key, value))) "
              f"WHERE r = 1 AND key IN ({', '.join(sorted({f'{chr(39)}{k}{chr(39)}' for k, _ in PUTS}))})")


def _fold(rows: str, group: str, into: str, limit: int) -> str:
    """``{into}``: rows of ``rows`` (with ``total``, a running sum within ``group``) and the number ``m`` of their greedy cut."""
    return f"""{into}_bases AS (SELECT DISTINCT {group}, 0 AS m, CAST(0 AS BIGINT) AS base FROM {rows} UNION ALL
  SELECT b.{group}, max(m) + 1, min(total) FROM {into}_bases b JOIN {rows} r ON r.{group} = b.{group} AND total >= base + {limit} GROUP BY b.{group}),
{into}_spans AS (SELECT *, lead(base) OVER (PARTITION BY {group} ORDER BY m) AS until FROM {into}_bases),
{into} AS (SELECT r.*, m FROM {rows} r JOIN {into}_spans s ON r.{group} = s.{group} AND total > base AND (until IS NULL OR total <= until))"""


#: The edits of a store with three flushes of a quarter of the log each, a compaction, and a flush of the last quarter.
_EDITS = f"""sized AS (SELECT *, strlen(key) + coalesce(strlen(value), 0) AS n_bytes, (seq - 1) * 4 // (SELECT count(*) FROM log) AS part FROM log),
quarters AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY part ORDER BY seq) AS BIGINT) AS total FROM sized),
{_fold("quarters", "part", "quarter_cut", LIMIT)},
flushed AS (SELECT part, m, min(key) AS smallest_key, max(key) AS largest_key, CAST(sum(n_bytes) AS BIGINT) AS size,
  row_number() OVER (ORDER BY part, m) - 1 AS no FROM quarter_cut GROUP BY part, m),
upper AS (SELECT * FROM flushed WHERE part < 3),
reach AS (SELECT smallest_key AS lo, largest_key AS hi, 0 AS round FROM upper WHERE no = 0 UNION ALL
  SELECT min(smallest_key), max(largest_key), max(round) + 1 FROM reach JOIN upper ON largest_key >= lo AND smallest_key <= hi
  WHERE round < 20 HAVING min(smallest_key) IS NOT NULL),
inputs AS (SELECT * FROM upper, (SELECT min(lo) AS lo, max(hi) AS hi FROM reach) WHERE largest_key >= lo AND smallest_key <= hi),
best AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM quarter_cut c SEMI JOIN inputs USING (part, m)) WHERE r = 1),
kept AS (SELECT 0 AS run, key, n_bytes, CAST(sum(n_bytes) OVER (ORDER BY key) AS BIGINT) AS total FROM best b WHERE op = 0 OR EXISTS (
  SELECT 1 FROM upper u ANTI JOIN inputs USING (no) WHERE b.key BETWEEN u.smallest_key AND u.largest_key)),
{_fold("kept", "run", "merged_cut", LIMIT)},
outputs AS (SELECT m, min(key) AS smallest_key, max(key) AS largest_key, CAST(sum(n_bytes) AS BIGINT) AS size FROM merged_cut GROUP BY m),
added AS (SELECT CAST(CASE WHEN part < 3 THEN part + 1 ELSE 5 END AS BIGINT) AS edit_id,
    CAST(no + CASE WHEN part < 3 THEN 0 ELSE (SELECT count(*) FROM outputs) END AS BIGINT) AS sst_id, 0 AS level, size, smallest_key, largest_key FROM flushed
  UNION ALL SELECT 4, (SELECT count(*) FROM upper) + m, 1, size, smallest_key, largest_key FROM outputs),
gone AS (SELECT CAST(no AS BIGINT) AS sst_id, 4 AS gone FROM inputs),
heads AS (SELECT CAST(i AS BIGINT) AS edit_id FROM range(6) AS t(i)),
versions AS (SELECT h.edit_id AS version_id, a.* EXCLUDE (edit_id) FROM added a LEFT JOIN gone g USING (sst_id)
  JOIN heads h ON h.edit_id >= a.edit_id AND (g.gone IS NULL OR h.edit_id < g.gone))"""


_CLOSURE = """closure AS (
  SELECT smallest_key AS lo, largest_key AS hi, 0 AS round FROM files WHERE level = 0 AND sst_id = (SELECT min(sst_id) FROM files WHERE level = 0)
  UNION ALL
  SELECT min(f.smallest_key), max(f.largest_key), max(round) + 1 FROM closure c JOIN files f ON f.level = 0 AND f.largest_key >= c.lo AND f.smallest_key <= c.hi
  WHERE round < 20 HAVING min(f.smallest_key) IS NOT NULL),
span AS (SELECT min(lo) AS lo, max(hi) AS hi FROM closure)"""
_MERGED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM tiered WHERE tier {}) WHERE r = 1"

ORACLES: dict[str, str] = {
    "live_snapshot": _q("SELECT * FROM live"),
    "get_point": _get("'key1'"),
    "get_deleted": _get("(SELECT min(key) FROM newest WHERE op = 1)"),
    "get_absent": _get("'no such key'"),
    "multi_get": _q("SELECT pos, p.key, coalesce(n.op, 2) AS status, n.value FROM probes p LEFT JOIN newest n USING (key)"),
    "as_of_snapshot": _q("SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log "
                         "WHERE seq <= (SELECT max(seq) // 2 FROM log)) WHERE r = 1 AND op = 0"),
    "history": _q("SELECT key, seq, op, age FROM ranked"),
    "versions_per_key": _q("SELECT key, count(*) AS n_versions, CAST(sum(op) AS BIGINT) AS n_tombstones FROM log GROUP BY key"),
    "prefix_raw": _q("SELECT key, value, op, seq FROM log WHERE starts_with(key, 'key1')"),
    "prefix_live": _q("SELECT key, value, seq FROM live WHERE starts_with(key, 'key1')"),
    "key_range": _q("SELECT key, value, seq FROM live WHERE key >= 'key2' AND key < 'key5'"),
    "lower_bound": _q("SELECT key, value, op, seq FROM log WHERE key >= 'key5x' ORDER BY key, seq DESC LIMIT 1"),
    "seek_first": _q("SELECT key, value, op, seq FROM log ORDER BY key, seq DESC LIMIT 1"),
    "seek_last": _q("SELECT key, value, op, seq FROM log ORDER BY key DESC, seq LIMIT 1"),
    "next_prev": _q("SELECT key, seq, lead(key) OVER w AS next_key, lead(seq) OVER w AS next_seq, lag(key) OVER w AS prev_key, "
                    "lag(seq) OVER w AS prev_seq FROM log WINDOW w AS (ORDER BY key, seq DESC)"),
    "merge_forward": _q("SELECT key, seq, op, row_number() OVER (ORDER BY key, seq DESC) - 1 AS position FROM log"),
    "merge_reverse": _q("SELECT key, seq, op, row_number() OVER (ORDER BY key DESC, seq) - 1 AS position FROM log"),
    "orders_put_get": "SELECT DISTINCT 'key' || CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey IS NULL THEN 2 ELSE 0 END AS status, "
                      "'value' || CAST(o_custkey AS VARCHAR) AS value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "page_store_get": "SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '#none' END AS key, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 2 END AS status, "
                      "CASE WHEN page_id % 2 = 0 THEN strlen(html) END AS n_bytes, CASE WHEN page_id % 2 = 0 THEN md5(html) END AS value_md5 FROM pages",
    "batch_put": _batch(False),
    "batch_delete": _batch(True),
    "empty_put_is_delete": _q("SELECT CASE WHEN asked_delete THEN 'delete' ELSE 'empty put' END AS origin, count(*) AS n_tombstones FROM ops WHERE gone GROUP BY 1"),
    "memtable_bytes": _q("SELECT count(*) AS n_versions, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS n_bytes FROM log"),
    "memtable_cuts": _q("SELECT memtable_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_versions, CAST(sum(n_bytes) AS BIGINT) AS n_bytes "
                        "FROM cut GROUP BY memtable_id", cut=True),
    "flush_batches": _q("SELECT memtable_id // 4 AS batch_id, count(DISTINCT memtable_id) AS n_memtables, count(*) AS n_versions, "
                        "CAST(sum(n_bytes) AS BIGINT) AS n_bytes, count(DISTINCT CASE WHEN tier > 0 THEN memtable_id END) = 4 AS flushed "
                        "FROM tiered GROUP BY 1", cut=True),
    "sst_metadata": _q("SELECT memtable_id AS sst_id, min(key) AS smallest_key, max(key) AS largest_key, min(seq) AS min_seq, max(seq) AS max_seq, "
                       "count(*) AS n_entries, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM cut GROUP BY 1", cut=True),
    "entry_sizes": _q("SELECT op, CAST(sum(13 + strlen(key) + coalesce(4 + strlen(value), 0)) AS BIGINT) AS n_bytes, count(*) AS n_entries FROM log GROUP BY op"),
    "block_layout": _q(
        "SELECT sst_id, block_id, smallest_key, largest_key, n_entries, size, CAST(sum(size) OVER (PARTITION BY sst_id ORDER BY block_id) AS BIGINT) - size "
        "AS start_offset FROM (SELECT e.sst_id, CAST(b.block_id AS BIGINT) AS block_id, min(key) AS smallest_key, max(key) AS largest_key, count(*) AS n_entries, "
        "CAST(sum(n) + 16 AS BIGINT) AS size FROM entries e JOIN block_spans b ON e.sst_id = b.sst_id AND e.total > b.base "
        "AND (b.until IS NULL OR e.total <= b.until) GROUP BY ALL)", cut=True,
        more="entries AS (SELECT memtable_id AS sst_id, key, n, CAST(sum(n) OVER (PARTITION BY memtable_id ORDER BY key, seq DESC) AS BIGINT) AS total "
             "FROM (SELECT *, 29 + strlen(key) + coalesce(4 + strlen(value), 0) AS n FROM cut)), "
             "block_bases AS (SELECT DISTINCT sst_id, 0 AS block_id, CAST(0 AS BIGINT) AS base FROM entries UNION ALL "
             "SELECT b.sst_id, max(block_id) + 1, min(total) FROM block_bases b JOIN entries e ON e.sst_id = b.sst_id AND total >= base + 4096 GROUP BY b.sst_id), "
             "block_spans AS (SELECT *, lead(base) OVER (PARTITION BY sst_id ORDER BY block_id) AS until FROM (SELECT b.* FROM block_bases b "
             "WHERE EXISTS (SELECT 1 FROM entries e WHERE e.sst_id = b.sst_id AND e.total > b.base)))"),
    "level_candidates": _q("SELECT key, sst_id, level FROM (SELECT DISTINCT key FROM probes) JOIN files ON key BETWEEN smallest_key AND largest_key", cut=True),
    "tiered_get": _q("SELECT p.key, coalesce(op, 2) AS status, value, tier FROM (SELECT DISTINCT key FROM probes) p LEFT JOIN (SELECT * FROM (SELECT *, "
                     "row_number() OVER (PARTITION BY key ORDER BY tier, seq DESC) AS r FROM tiered) WHERE r = 1) t USING (key)", cut=True),
    "compaction_score": _q("SELECT level, count(*) AS n_files, CASE WHEN level = 0 THEN count(*) / 6.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM files GROUP BY level", cut=True),
    "level_pick": _q("SELECT level, score, score >= 1 AS due FROM (SELECT level, CASE WHEN level = 0 THEN count(*) / 6.0::DOUBLE ELSE 0.0::DOUBLE END AS score "
                     "FROM files GROUP BY level) ORDER BY score DESC, level DESC LIMIT 1", cut=True),
    "l0_overlap_closure": _q("SELECT sst_id, smallest_key, largest_key FROM files, span WHERE level = 0 AND largest_key >= lo AND smallest_key <= hi", cut=True, more=_CLOSURE),
    "next_level_inputs": _q("SELECT sst_id, level FROM files, span WHERE level = 1 AND largest_key >= lo AND smallest_key <= hi", cut=True, more=_CLOSURE),
    "compaction_merge": _q(f"SELECT key, value, op, seq FROM ({_MERGED.format('>= 2')}) WHERE op = 0", cut=True),
    "compaction_merge_level0": _q(f"SELECT key, value, op, seq FROM ({_MERGED.format('= 2')}) m WHERE op = 0 OR EXISTS (SELECT 1 FROM files f "
                                  "WHERE f.level = 1 AND m.key BETWEEN f.smallest_key AND f.largest_key)", cut=True),
    "compaction_stats": _q(f"SELECT n_in, n_in - n_keys AS n_superseded, n_keys - n_kept AS n_tombstones_dropped, n_kept FROM (SELECT count(*) AS n_keys, "
                           f"count(*) FILTER (WHERE op = 0) AS n_kept FROM ({_MERGED.format('>= 2')})), (SELECT count(*) AS n_in FROM tiered WHERE tier >= 2)", cut=True),
    "compaction_split": _q(
        "SELECT CAST(b.file_no AS BIGINT) AS file_no, min(key) AS smallest_key, max(key) AS largest_key, count(*) AS n_entries, CAST(sum(n) AS BIGINT) AS n_bytes "
        "FROM out_rows e JOIN out_spans b ON e.total > b.base AND (b.until IS NULL OR e.total <= b.until) GROUP BY 1",
        more="out_rows AS (SELECT key, n, CAST(sum(n) OVER (ORDER BY key) AS BIGINT) AS total FROM (SELECT key, strlen(key) + strlen(value) AS n FROM live)), "
             "out_bases AS (SELECT 0 AS file_no, CAST(0 AS BIGINT) AS base UNION ALL SELECT max(file_no) + 1, min(total) FROM out_bases, out_rows "
             f"WHERE total >= base + {LIMIT // 16} HAVING min(total) IS NOT NULL), "
             "out_spans AS (SELECT *, lead(base) OVER (ORDER BY file_no) AS until FROM out_bases)"),
    "manifest_replay": _q("SELECT sst_id, CAST(level AS INTEGER) AS level, size, smallest_key, largest_key FROM added WHERE sst_id NOT IN (SELECT sst_id FROM gone)", more=_EDITS),
    "manifest_counters": _q("SELECT max(sst_id) + 1 AS next_table_id, (SELECT max(seq) FROM log) AS sequence_number FROM added", more=_EDITS),
    "version_apply": _q("SELECT version_id, sst_id, CAST(level AS INTEGER) AS level FROM versions", more=_EDITS),
    "obsolete_files": _q("SELECT sst_id, CAST(level AS INTEGER) AS level FROM added WHERE sst_id NOT IN (SELECT sst_id FROM versions WHERE version_id >= 4)", more=_EDITS),
    "store_scan": _q("SELECT key, seq, op, value, row_number() OVER (ORDER BY key DESC, seq) - 1 AS position FROM log WHERE key >= 'key12'"),
    "store_snapshot": _q("SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log "
                         "WHERE (seq - 1) * 2 // (SELECT count(*) FROM log) = 0) WHERE r = 1 AND op = 0"),
    "recovered_snapshot": _q("SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM cut "
                             "WHERE memtable_id < (SELECT max(memtable_id) // 4 * 4 FROM cut)) WHERE r = 1 AND op = 0", cut=True),
    "store_reopened": _q("SELECT * FROM live"),
    "sst_round_trip": _q("SELECT * FROM log"),
    "stream_ingest_latest": _q("SELECT * FROM newest"),
    "stream_state_latest": _q("SELECT * FROM newest"),
}
