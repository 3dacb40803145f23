"""DuckDB SQL of every query: one chain of named steps, and a last SELECT for each query."""

from __future__ import annotations

STEPS = r"""
ev AS (
  SELECT event_id AS seq, epoch_us(ts) AS t_us, 'user-' || (user_id % 12) AS caller,
         upper('app.' || event_type || '/tier' || CAST(floor(value / 40) AS INTEGER) || '/write') AS op,
         upper('app.' || event_type) AS prov,
         '10.0.' || (user_id % 12) || '.' || CAST(floor(value / 4) AS INTEGER) AS ip,
         'sub-' || CAST(floor(value / 100) AS INTEGER) AS sub,
         'rg-' || CAST(floor(value / 50) AS INTEGER) AS rg,
         regexp_replace(upper('app.' || event_type || '/tier' || CAST(floor(value / 40) AS INTEGER) || '/write'), '/[^/]*$', '') AS rtype,
         'c-' || CAST(floor(user_id / 2) AS INTEGER) || '-' || CAST(floor(epoch_us(ts) / 1e6 / 86400 / 3) AS INTEGER) AS corr
  FROM events),
spans AS (SELECT rg AS grp, corr AS id, arg_min(caller, (t_us, seq)) AS party, min(t_us) AS beg, max(t_us) AS fin FROM ev GROUP BY rg, corr),
span AS (SELECT min(t_us) AS lo, max(t_us) - min(t_us) AS span FROM ev),
parts AS (
  SELECT ev.*, CASE WHEN t_us < lo + 0.70e0 * span THEN 'train' WHEN t_us >= lo + 0.85e0 * span THEN 'test' ELSE 'val' END AS part
  FROM ev, span),
hist AS (
  SELECT *, coalesce(lag(op, 1) OVER w, 'START') AS h1, coalesce(lag(op, 2) OVER w, 'START') AS h2,
         coalesce(lag(op, 3) OVER w, 'START') AS h3, coalesce(lag(op, 4) OVER w, 'START') AS h4,
         row_number() OVER w AS idx, count(*) OVER (PARTITION BY part, corr) AS n,
         (t_us - first_value(t_us) OVER w) / 1e6 AS elapsed
  FROM parts WHERE part <> 'val' WINDOW w AS (PARTITION BY part, corr ORDER BY t_us, seq)),
train AS (SELECT * FROM hist WHERE part = 'train'),
test AS (SELECT *, CAST(floor(t_us / 1800000000.0) AS BIGINT) AS bucket FROM hist WHERE part = 'test'),
m_ngram AS (SELECT caller, h4, h3, h2, h1, op, count(*) AS cnt FROM train GROUP BY ALL),
m_max AS (SELECT coalesce(max(cnt), 1) AS max_cnt FROM m_ngram),
m_op AS (SELECT op, avg(elapsed) AS dur_mean, stddev_pop(elapsed) AS dur_std, avg(idx) AS idx_mean, stddev_pop(idx) AS idx_std FROM train GROUP BY op),
m_seen AS (
  SELECT DISTINCT caller, 'op' AS dim, op AS val FROM train UNION SELECT DISTINCT caller, 'prov', prov FROM train
  UNION SELECT DISTINCT caller, 'sub', sub FROM train UNION SELECT DISTINCT caller, 'rg', rg FROM train
  UNION SELECT DISTINCT caller, 'rtype', rtype FROM train UNION SELECT DISTINCT caller, 'ip', ip FROM train),
m_sess AS (
  SELECT caller, CAST(floor(t_us / 1800000000.0) AS BIGINT) AS bucket, count(*) AS events, (min(t_us) % 86400000000) / 3.6e9 AS hour
  FROM train GROUP BY 1, 2),
m_caller AS (SELECT caller, avg(events) AS rate_mean, stddev_pop(events) AS rate_std, avg(hour) AS hour_mean FROM m_sess GROUP BY caller),
scored AS (
  SELECT t.*, CASE WHEN g.cnt IS NULL THEN 1.0e0 ELSE 0.0e0 END AS struct, 1.0e0 - coalesce(g.cnt, 0) / CAST(max_cnt AS DOUBLE) AS rarity,
         CASE WHEN o.op IS NULL THEN 1.0e0 ELSE least(abs(elapsed - dur_mean) / (dur_std + 1e-6) / 5, 1.0e0) END AS dur_dev,
         CASE WHEN o.op IS NULL THEN 1.0e0 ELSE least(abs(idx - idx_mean) / (idx_std + 1e-6) / 5, 1.0e0) END AS len_dev
  FROM test t CROSS JOIN m_max LEFT JOIN m_ngram g USING (caller, h4, h3, h2, h1, op) LEFT JOIN m_op o ON t.op = o.op),
lc AS (
  SELECT corr AS correlation_id, arg_min(caller, idx) AS caller, min(t_us) AS first_t, arg_min(seq, idx) AS first_seq, max(t_us) AS last_t,
         count(*) AS events, max(struct) AS struct, max(rarity) AS rarity, max(dur_dev) AS dur_dev, max(len_dev) AS len_dev,
         CASE WHEN count(DISTINCT prov) > 1 OR count(DISTINCT rg) > 1 OR count(DISTINCT sub) > 1 THEN 1.0e0 ELSE 0.0e0 END AS context,
         string_agg(op, ' -> ' ORDER BY idx) FILTER (idx <= 10) AS first_ops,
         string_agg(op, ' -> ' ORDER BY idx) FILTER (idx > n - 10) AS last_ops
  FROM scored GROUP BY corr),
ranked_pat AS (
  SELECT *, row_number() OVER (PARTITION BY caller, last_ops, struct, context ORDER BY first_t, first_seq) AS rn,
         count(*) OVER (PARTITION BY caller, last_ops, struct, context) AS pattern_count FROM lc),
pat AS (SELECT * FROM ranked_pat WHERE rn = 1),
sig AS (
  SELECT *, round(struct + rarity + dur_dev + len_dev + context, 3) AS total_score,
         CAST((struct = 1) AS BIGINT) + CAST((rarity > 0.8 AND struct < 0.5) AS BIGINT) + CAST((dur_dev > 0.8 AND struct < 0.5) AS BIGINT)
           + CAST((context > 0) AS BIGINT) + CAST((len_dev > 0.8) AS BIGINT) AS effective_signal_count,
         concat_ws(' and ', CASE WHEN struct > 0.5 THEN 'unseen sequence' END, CASE WHEN dur_dev > 0.5 THEN 'unusual timing' END,
                   CASE WHEN context > 0.5 THEN 'cross-boundary context shift' END) AS why
  FROM pat),
iso AS (SELECT 1),
a_rows AS (
  SELECT CASE WHEN first_t % 1000000 = 0 THEN strftime(make_timestamp(first_t), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(first_t), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00 — '
           || CASE WHEN last_t % 1000000 = 0 THEN strftime(make_timestamp(last_t), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(last_t), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS timestamp_range,
         caller, correlation_id, total_score, effective_signal_count, pattern_count, round(struct, 3) AS structural_violation,
         round(rarity, 3) AS sequence_rarity, round(dur_dev, 3) AS duration_deviation, round(len_dev, 3) AS length_deviation,
         round(context, 3) AS context_inconsistency,
         CASE WHEN why = '' THEN 'Minor deviation.' ELSE 'CorrelationId exhibited ' || why END AS explanation,
         first_ops AS sequence_context, first_t, first_seq
  FROM sig),
a_total AS (
  SELECT *, row_number() OVER (ORDER BY total_score DESC, effective_signal_count DESC, first_t, first_seq) AS csv_pos FROM a_rows
  QUALIFY csv_pos <= 20),
a_context AS (
  SELECT *, 20 + row_number() OVER (ORDER BY context_inconsistency DESC, total_score DESC, effective_signal_count DESC, first_t, first_seq) AS csv_pos
  FROM a_rows WHERE context_inconsistency > 0 AND correlation_id NOT IN (SELECT correlation_id FROM a_total) QUALIFY csv_pos <= 40),
a_alerts AS (SELECT * FROM a_total UNION ALL SELECT * FROM a_context),
t_vals AS (
  SELECT DISTINCT caller, bucket, 'op' AS dim, op AS val FROM test UNION SELECT caller, bucket, 'prov', prov FROM test
  UNION SELECT caller, bucket, 'sub', sub FROM test UNION SELECT caller, bucket, 'rg', rg FROM test
  UNION SELECT caller, bucket, 'rtype', rtype FROM test UNION SELECT caller, bucket, 'ip', ip FROM test),
t_new AS (SELECT t.* FROM t_vals t LEFT JOIN m_seen s USING (caller, dim, val) WHERE s.caller IS NULL),
s_base AS (
  SELECT caller, bucket, min(t_us) AS first_t, arg_min(seq, (t_us, seq)) AS first_seq, max(t_us) AS last_t, count(*) AS events
  FROM test GROUP BY caller, bucket),
ses AS (
  SELECT b.*, coalesce(f.new_op, 0.0e0) AS new_op, coalesce(f.new_prov, 0.0e0) AS new_prov, coalesce(f.new_sub, 0.0e0) AS new_sub,
         coalesce(f.new_rg, 0.0e0) AS new_rg, coalesce(f.new_type, 0.0e0) AS new_type, coalesce(f.new_ip, 0.0e0) AS new_ip,
         least(abs(b.events - coalesce(c.rate_mean, 0)) / (coalesce(c.rate_std, 1) + 1e-6) / 5, 1.0e0) AS activity_dev,
         least(abs(b.h - coalesce(c.hour_mean, b.h)), 24 - abs(b.h - coalesce(c.hour_mean, b.h))) / 12 AS hour_dev
  FROM (SELECT *, (first_t % 86400000000) / 3.6e9 AS h FROM s_base) b
  LEFT JOIN (SELECT caller, bucket, max(CASE dim WHEN 'op' THEN 1.0e0 ELSE 0 END) AS new_op, max(CASE dim WHEN 'prov' THEN 1.0e0 ELSE 0 END) AS new_prov,
                    max(CASE dim WHEN 'sub' THEN 1.0e0 ELSE 0 END) AS new_sub, max(CASE dim WHEN 'rg' THEN 1.0e0 ELSE 0 END) AS new_rg,
                    max(CASE dim WHEN 'rtype' THEN 1.0e0 ELSE 0 END) AS new_type, max(CASE dim WHEN 'ip' THEN 1.0e0 ELSE 0 END) AS new_ip
             FROM t_new GROUP BY caller, bucket) f USING (caller, bucket)
  LEFT JOIN m_caller c USING (caller)),
s_sig0 AS (
  SELECT *, greatest(new_prov, new_sub, new_rg, new_type) AS scope, CASE WHEN activity_dev > 0.8 THEN activity_dev ELSE -1 END AS act_on,
         CASE WHEN hour_dev > 0.8 THEN hour_dev ELSE -1 END AS hour_on FROM ses),
s_sig AS (
  SELECT *, round(new_op + new_prov + new_sub + new_rg + new_type + new_ip + activity_dev + hour_dev, 3) AS total_score,
         CAST((new_op > 0) AS BIGINT) + CAST((new_ip > 0) AS BIGINT) + CAST((activity_dev > 0.8) AS BIGINT) + CAST((hour_dev > 0.8) AS BIGINT)
           + CAST((scope > 0) AS BIGINT) AS effective_signal_count,
         CASE WHEN greatest(new_op, new_ip, act_on, hour_on, scope) <= 0 THEN 'None'
              WHEN new_op >= greatest(new_ip, act_on, hour_on, scope) THEN 'New Operations'
              WHEN new_ip >= greatest(act_on, hour_on, scope) THEN 'New IP'
              WHEN act_on >= greatest(hour_on, scope) THEN 'Activity Spike'
              WHEN hour_on >= scope THEN 'Hour Deviation' ELSE 'Context/Role Expansion' END AS dominant_signal,
         concat_ws(', ', CASE WHEN new_op > 0 THEN 'new operations' END, CASE WHEN new_ip > 0 THEN 'new IP' END,
                   CASE WHEN activity_dev > 0.8 THEN 'volume spike' END, CASE WHEN hour_dev > 0.8 THEN 'unusual hour' END) AS why
  FROM s_sig0),
s_ops AS (
  SELECT caller, bucket, op, min((t_us, seq)) AS seen_at FROM test GROUP BY caller, bucket, op),
s_shown AS (
  SELECT caller, bucket, string_agg(op, ', ' ORDER BY k) AS session_context
  FROM (SELECT *, row_number() OVER (PARTITION BY caller, bucket ORDER BY seen_at) AS k FROM s_ops) WHERE k <= 10 GROUP BY caller, bucket),
b_alerts AS (
  SELECT CASE WHEN first_t % 1000000 = 0 THEN strftime(make_timestamp(first_t), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(first_t), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00 — '
           || CASE WHEN last_t % 1000000 = 0 THEN strftime(make_timestamp(last_t), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(last_t), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS timestamp_range,
         caller, total_score, effective_signal_count, dominant_signal, new_op, new_prov, new_sub, new_rg, new_type, new_ip,
         round(activity_dev, 3) AS activity_dev, round(hour_dev, 3) AS hour_dev,
         CASE WHEN why = '' THEN 'Minor deviation.' ELSE 'Caller session: ' || why END AS explanation, session_context,
         row_number() OVER (ORDER BY total_score DESC, effective_signal_count DESC, first_t, first_seq) AS csv_pos
  FROM s_sig JOIN s_shown USING (caller, bucket) QUALIFY csv_pos <= 100),
a_diag AS (
  SELECT *, string_split(sequence_context, ' -> ')[-1] AS last_op,
         CASE WHEN effective_signal_count >= 2 THEN 'HIGH_CONFIDENCE' WHEN effective_signal_count = 1 AND structural_violation = 1 THEN 'LOW_CONFIDENCE'
              WHEN effective_signal_count = 1 THEN 'MODERATE' ELSE 'UNCLASSIFIED' END AS uncertainty,
         CASE WHEN context_inconsistency > 0 THEN 1 WHEN structural_violation = 1 AND duration_deviation > 0.8 THEN 2 WHEN structural_violation = 1 THEN 3
              WHEN duration_deviation > 0.8 THEN 4 WHEN length_deviation > 0.8 THEN 5 ELSE 6 END AS rule FROM a_alerts),
a_told AS (
  SELECT *, ['Lateral Boundary Crossing', 'Critical Deployment/Migration Shift', 'New Microservice Routine', 'Latency / Retry Loop', 'Stalled Operation', 'Unclassified Structural Anomaly'][rule] AS category,
         CASE rule WHEN 1 THEN 'CorrelationId unexpectedly traversed distinct resource groups or providers during `' || last_op || '`.'
                   WHEN 2 THEN 'Unseen sequence path combined with massive latency, likely indicating a failed backend deployment involving `' || last_op || '`.'
                   WHEN 3 THEN 'Strictly unseen workflow path to `' || last_op || '`, likely an unmodeled script or manual intervention.'
                   WHEN 4 THEN 'Standard workflow path, but extreme timing delay indicative of a backend retry loop terminating at `' || last_op || '`.'
                   WHEN 5 THEN 'Abnormal volume of events within the same CorrelationId cycle.' ELSE 'Sequence violates historical n-gram priors.' END AS cause
  FROM a_diag),
b_diag AS (
  SELECT *, string_split(session_context, ', ')[1] AS first_op,
         CASE WHEN effective_signal_count >= 2 THEN 'HIGH_CONFIDENCE' WHEN effective_signal_count = 1 AND new_op = 1 THEN 'LOW_CONFIDENCE'
              WHEN effective_signal_count = 1 THEN 'MODERATE' ELSE 'UNCLASSIFIED' END AS uncertainty,
         CASE WHEN new_ip = 1 AND new_op = 1 AND activity_dev > 0.5 THEN 1 WHEN new_ip = 1 AND new_op = 0 AND new_prov = 0 THEN 2
              WHEN new_op = 1 AND activity_dev > 0.8 AND new_ip = 0 THEN 3 WHEN (new_rg = 1 OR new_prov = 1) AND new_ip = 0 THEN 4
              WHEN hour_dev > 0.8 AND new_op = 1 THEN 5 ELSE 6 END AS rule FROM b_alerts),
b_told AS (
  SELECT *, ['Possible Credential/Token Compromise', 'VPN / Routing Shift', 'Automation / Batch Script Change', 'RBAC Role Expansion', 'Off-Hours Deviation', 'Unclassified Behavioral Drift'][rule] AS category,
         CASE rule WHEN 1 THEN 'Identity used a brand new IP to execute unseen operations (`' || first_op || '`) at an unusually high volume.'
                   WHEN 2 THEN 'Identity executed standard business operations from a previously unseen IP space.'
                   WHEN 3 THEN 'Massive volume spike of unseen operations (`' || first_op || '`) from a known IP, indicating a cron job or automation change.'
                   WHEN 4 THEN 'Identity began operating in previously unseen resource groups or providers, suggesting a recent permissions grant.'
                   WHEN 5 THEN 'Identity executed unseen operations during an historically inactive hour.' ELSE 'Session deviates from standard historical actor baseline.' END AS cause
  FROM b_diag),
qa1 AS (SELECT *, row_number() OVER (ORDER BY total_score DESC, timestamp_range DESC, csv_pos) AS number FROM a_told QUALIFY number <= 20),
qa2 AS (
  SELECT *, row_number() OVER (ORDER BY context_inconsistency DESC, total_score DESC, csv_pos) AS number FROM a_told
  WHERE context_inconsistency > 0 AND csv_pos NOT IN (SELECT csv_pos FROM qa1) QUALIFY number <= 20),
all_h AS (
  SELECT *, coalesce(lag(op, 1) OVER w, 'START') AS h1, coalesce(lag(op, 2) OVER w, 'START') AS h2, coalesce(lag(op, 3) OVER w, 'START') AS h3,
         coalesce(lag(op, 4) OVER w, 'START') AS h4, row_number() OVER w AS idx, (t_us - first_value(t_us) OVER w) / 1e6 AS elapsed
  FROM ev WINDOW w AS (PARTITION BY corr ORDER BY t_us, seq)),
kept AS (SELECT * FROM all_h WHERE t_us // 864000000000 <> (SELECT DISTINCT t_us // 864000000000 AS p FROM ev ORDER BY p LIMIT 1 OFFSET 1)),
k_sess AS (SELECT caller, t_us // 1800000000 AS bucket, count(*) AS events, (min(t_us) % 86400000000) / 3.6e9 AS hour FROM kept GROUP BY 1, 2),
n_ngram AS (SELECT caller, h4, h3, h2, h1, op, count(*) AS cnt FROM test GROUP BY ALL),
n_op AS (SELECT op, avg(elapsed) AS dur_mean, avg(idx) AS idx_mean FROM test GROUP BY op),
grams AS (
  SELECT coalesce(a.caller, b.caller) AS caller, coalesce(a.h4, b.h4) AS h4, coalesce(a.h3, b.h3) AS h3, coalesce(a.h2, b.h2) AS h2, coalesce(a.h1, b.h1) AS h1,
         coalesce(a.op, b.op) AS op, coalesce(a.cnt, 0) AS old_cnt, coalesce(b.cnt, 0) AS new_cnt,
         CASE WHEN a.cnt IS NULL THEN 'new' WHEN b.cnt IS NULL THEN 'lost' ELSE 'kept' END AS change
  FROM m_ngram a FULL JOIN n_ngram b ON a.caller IS NOT DISTINCT FROM b.caller AND a.h4 = b.h4 AND a.h3 = b.h3 AND a.h2 = b.h2 AND a.h1 = b.h1 AND a.op = b.op),
outcomes AS (
  SELECT 'A' AS track, caller, total_score, CASE WHEN effective_signal_count >= 2 THEN 'HIGH_CONFIDENCE' WHEN effective_signal_count = 1 AND structural_violation = 1 THEN 'LOW_CONFIDENCE'
           WHEN effective_signal_count = 1 THEN 'MODERATE' ELSE 'UNCLASSIFIED' END AS uncertainty,
         CASE WHEN context_inconsistency > 0 THEN 'Lateral Boundary Crossing' WHEN structural_violation = 1 AND duration_deviation > 0.8 THEN 'Critical Deployment/Migration Shift'
           WHEN structural_violation = 1 THEN 'New Microservice Routine' WHEN duration_deviation > 0.8 THEN 'Latency / Retry Loop'
           WHEN length_deviation > 0.8 THEN 'Stalled Operation' ELSE 'Unclassified Structural Anomaly' END AS category FROM a_rows
  UNION ALL
  SELECT 'B', caller, total_score, CASE WHEN effective_signal_count >= 2 THEN 'HIGH_CONFIDENCE' WHEN effective_signal_count = 1 AND new_op = 1 THEN 'LOW_CONFIDENCE'
           WHEN effective_signal_count = 1 THEN 'MODERATE' ELSE 'UNCLASSIFIED' END,
         CASE WHEN new_ip = 1 AND new_op = 1 AND round(activity_dev, 3) > 0.5 THEN 'Possible Credential/Token Compromise' WHEN new_ip = 1 AND new_op = 0 AND new_prov = 0 THEN 'VPN / Routing Shift'
           WHEN new_op = 1 AND round(activity_dev, 3) > 0.8 AND new_ip = 0 THEN 'Automation / Batch Script Change' WHEN (new_rg = 1 OR new_prov = 1) AND new_ip = 0 THEN 'RBAC Role Expansion'
           WHEN round(hour_dev, 3) > 0.8 AND new_op = 1 THEN 'Off-Hours Deviation' ELSE 'Unclassified Behavioral Drift' END FROM s_sig),
verdicts AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS track, 'bucket-' || (doc_id % 6) AS bucket,
         CASE WHEN toxic = 1 THEN 'CONFIRMED_ANOMALY' WHEN quality = 1 AND doc_id % 5 = 0 THEN 'UNREVIEWED' ELSE 'BENIGN_FALSE_POSITIVE' END AS decision
  FROM labels)
"""

_A = "timestamp_range, caller, correlation_id, total_score, effective_signal_count, pattern_count, structural_violation, sequence_rarity, duration_deviation, length_deviation, context_inconsistency, explanation, sequence_context, csv_pos"
_B = "timestamp_range, caller, total_score, effective_signal_count, dominant_signal, new_op, new_prov, new_sub, new_rg, new_type, new_ip, activity_dev, hour_dev, explanation, session_context, csv_pos"
_TOLD = "category, cause, uncertainty"
_ISO = "CASE WHEN {0} % 1000000 = 0 THEN strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"



def _cells(artefact: str, columns: str, table: str) -> str:
    """Published cells of an alert table, scores with three digits."""
    texts = ("timestamp_range", "caller", "correlation_id", "dominant_signal", "explanation", "sequence_context", "session_context")
    counts = ("effective_signal_count", "pattern_count")
    names = [c for c in columns.split(", ") if c != "csv_pos"]
    told = [c if c in texts else f"CAST({c} AS VARCHAR) AS {c}" if c in counts else f"CAST(CAST({c} AS DECIMAL(18, 3)) AS VARCHAR) AS {c}" for c in names]
    return f"SELECT '{artefact}' AS artefact, csv_pos AS pos, field, value FROM (SELECT csv_pos, {', '.join(told)} FROM {table}) UNPIVOT (value FOR field IN ({', '.join(names)}))"


def _entries(queue: str, table: str, number: str, subject: str, scores: dict[str, str]) -> str:
    """Entries of a queue as the packet shows them."""
    told = " || ' | ' || ".join(f"'{label} `' || {column} || '`'" for label, column in scores.items())
    lines = f"'{queue}-' || {number} || '. `' || {subject} || '`', '**Window:** ' || timestamp_range, '**Uncertainty:** ' || uncertainty, '**Category:** ' || category, '**Cause:** ' || cause, '**Scores:** ' || {told}"
    return f"SELECT 'diagnosed_review_packet.md', {number}, '{queue}', concat_ws(chr(10), {lines}) FROM {table} WHERE {number} <= 20"


_SCORES_A = {
    "Total": "total_score", "Eff. Signals": "effective_signal_count", "Pattern Instances": "pattern_count", "Struct": "structural_violation",
    "Rarity": "sequence_rarity", "Duration": "duration_deviation", "Length": "length_deviation", "Context": "context_inconsistency",
}
_SCORES_B = {
    "Total": "total_score", "Eff. Signals": "effective_signal_count", "Dominant Signal": "dominant_signal", "New Ops": "new_op",
    "New IP": "new_ip", "New RG": "new_rg", "Act Spike": "activity_dev", "Hour Dev": "hour_dev",
}

LAST = {
    "ingest_canonical": "SELECT * FROM ev",
    "ingest_derive_rtype": "SELECT op, rtype, count(*) AS events FROM ev GROUP BY op, rtype",
    "ingest_defaults": r"""SELECT event_id AS seq,
        CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 THEN 'UNKNOWN' WHEN event_id % 5 = 2 THEN '' ELSE trim(event_type) END AS name,
        CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 THEN 'user-' || user_id ELSE 'first' END AS chained FROM events""",
    "ingest_csv_generic": r"""SELECT epoch_us(ts) AS t_us,
        upper(event_type || CASE event_id % 5 WHEN 0 THEN ', "x"/w' WHEN 1 THEN chr(10) || 'line/w' ELSE '/write' END) AS op,
        CASE event_id % 3 WHEN 2 THEN '' ELSE 'UNKNOWN' END AS prov, 'user-' || user_id AS caller,
        CASE WHEN event_id % 2 = 0 THEN '10.0.0.1' ELSE 'UNKNOWN' END AS ip, 'sub' AS sub, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' ELSE 'Rg' END AS rg,
        CASE WHEN event_id % 6 = 0 THEN 'TYPE' ELSE upper(event_type || CASE event_id % 5 WHEN 0 THEN ', "x"' WHEN 1 THEN chr(10) || 'line' ELSE '' END) END AS rtype,
        'c-' || user_id AS corr FROM events WHERE event_id % 11 <> 0""",
    "ingest_csv_native": """SELECT epoch_us(ts) AS t_us, upper('app/' || event_type || CASE WHEN event_id % 3 = 0 THEN '/read' ELSE '' END) AS op, 'PROV' AS prov,
        CAST(user_id AS VARCHAR) AS caller, 'UNKNOWN' AS ip, 'UNKNOWN' AS sub, 'UNKNOWN' AS rg,
        CASE WHEN event_id % 3 = 0 THEN upper('app/' || event_type) ELSE 'APP' END AS rtype, 'k' || user_id AS corr FROM events WHERE event_id % 13 <> 0""",
    "parse_times": """SELECT event_id AS seq,
        CASE event_id % 10 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t - 7200000000 WHEN 3 THEN t - t % 1000000 WHEN 4 THEN t - t % 86400000000
          WHEN 5 THEN t - t % 1000000 WHEN 6 THEN t - t % 3600000000 WHEN 9 THEN t END AS iso_us,
        CASE event_id % 7 WHEN 0 THEN t WHEN 1 THEN t - t % 1000000 WHEN 4 THEN 12250000 WHEN 5 THEN 1000000000 END AS number_us
        FROM (SELECT event_id, epoch_us(ts) AS t FROM events)""",
    "feedback_append_roundtrip": """SELECT CAST(doc_id AS VARCHAR) AS alert_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS track,
        CASE WHEN toxic = 1 THEN 'CONFIRMED_ANOMALY' WHEN quality = 1 AND doc_id % 5 = 0 THEN 'UNREVIEWED' ELSE 'BENIGN_FALSE_POSITIVE' END AS decision,
        'label of bucket-' || (doc_id % 6) AS reason, CASE WHEN doc_id % 2 = 0 THEN 'SOC_ANALYST' ELSE 'second' END AS analyst_id, 1 AS reviewer_count,
        CASE WHEN doc_id % 2 = 0 THEN 'SOC_ANALYST' ELSE 'second' END AS reviewer_ids,
        CASE WHEN toxic = 1 OR quality <> 1 OR doc_id % 5 <> 0 THEN 'CERTAIN' END AS confidence, CASE WHEN doc_id % 2 = 1 THEN 'ticket' END AS fn_source, 0 AS disagreement_flag
        FROM labels""",
    "artefacts_roundtrip": "\nUNION ALL ".join([
        _cells("top_lifecycle_anomalies.csv", _A, "a_alerts"), _cells("top_actor_anomalies.csv", _B, "b_alerts"),
        "SELECT 'manifest.json', CAST(0 AS BIGINT), field, value FROM (VALUES ('generated_utc', 'a time'), ('track_a_scored', (SELECT CAST(count(*) AS VARCHAR) FROM lc)), "
        "('track_b_scored', (SELECT CAST(count(*) AS VARCHAR) FROM ses)), ('track_a_deduplicated_patterns', (SELECT CAST(count(*) AS VARCHAR) FROM pat))) m(field, value)",
        "SELECT 'diagnosed_review_packet.md', row_number() OVER (ORDER BY place), 'heading', value FROM (VALUES (1, '# Diagnosed Analyst Review Packet'), "
        "(2, '## Track A — Queue 1: Top 20 by Total Score'), (3, '## Track A — Queue 2: Top 20 by Context Inconsistency'), "
        "(4, '## Track B — Caller 30-Minute Session Drift')) h(place, value) WHERE place <> 3 OR EXISTS (SELECT 1 FROM qa2)",
        _entries("A1", "qa1", "number", "correlation_id", _SCORES_A), _entries("A2", "qa2", "number", "correlation_id", _SCORES_A), _entries("B", "b_told", "csv_pos", "caller", _SCORES_B),
    ]),
    "input_guards": """SELECT "case", error, message, CASE "case" WHEN 'some unreadable times' THEN timed WHEN 'dry run' THEN timed WHEN 'both parts' THEN dealt END AS events
        FROM (VALUES ('missing file', 'FileNotFoundError', 'There is no log export at <path>; --input takes the path of one.'),
            ('empty file', 'ValueError', 'No header line in <path>: the file is empty.'),
            ('unknown headers', 'ValueError', 'The headers of <path> fit neither layout. They are [''caller_ip'', ''correlation_id'', ''operation'', ''provider'', ''resource_group'', ''resource_type'', ''subscription'', ''timestamp_epoch'']; the native layout needs [''caller'', ''correlationid'', ''operationnamevalue'', ''timegenerated''], the generic one [''caller'', ''correlation_id'', ''operation'', ''timestamp_epoch''].'),
            ('no readable time', 'ValueError', 'Not one row of <path> has a readable time.'),
            ('some unreadable times', NULL, NULL), ('dry run', NULL, NULL),
            ('nothing to learn from', 'ValueError', 'No event falls into the first 70 % of the time span, so there is nothing to learn from.'),
            ('nothing to score', 'ValueError', 'No event falls into the last 15 % of the time span, so there is nothing to score.'), ('both parts', NULL, NULL)) c("case", error, message)
        CROSS JOIN (SELECT count(*) FILTER (seq % 7 <> 0) AS timed, count(*) FILTER (part <> 'val') AS dealt FROM parts)""",
    "asof_last_other_address": """SELECT e.seq, max_by(p.seq, (p.t_us, p.seq)) AS other_seq, max_by(p.ip, (p.t_us, p.seq)) AS other_ip, e.t_us - max(p.t_us) AS since_us
        FROM ev e LEFT JOIN ev p ON p.caller = e.caller AND p.ip <> e.ip AND (p.t_us < e.t_us OR p.t_us = e.t_us AND p.seq < e.seq) GROUP BY e.seq, e.t_us""",
    "asof_error_last_purchase": """SELECT e.seq, p.seq AS last_seq, p.op AS last_op, e.t_us - p.t_us AS since_us
        FROM (SELECT * FROM ev WHERE prov = 'APP.ERROR') e ASOF LEFT JOIN (SELECT * FROM ev WHERE prov = 'APP.PURCHASE') p ON e.caller = p.caller AND e.t_us >= p.t_us""",
    "gap_sessions": """SELECT caller, min(t_us) AS session_start, max(t_us) AS session_end, count(*) AS events
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY caller ORDER BY t_us, seq) AS k
              FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY caller ORDER BY t_us, seq) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM ev))
        GROUP BY caller, k""",
    "range_frame_half_hour": """SELECT seq, count(*) OVER w AS events, max(op) OVER w AS last_op
        FROM ev WINDOW w AS (PARTITION BY caller ORDER BY t_us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW)""",
    "lifecycles_open_together": """SELECT a.grp, a.party AS party_a, b.party AS party_b, count(*) AS pairs, CAST(sum(least(a.fin, b.fin) - greatest(a.beg, b.beg)) AS BIGINT) AS shared_us
        FROM spans a JOIN spans b ON a.grp = b.grp AND a.party < b.party AND a.beg <= b.fin AND b.beg <= a.fin GROUP BY ALL""",
    "baselines_merged_ngrams": "SELECT caller, h4, h3, h2, h1, op, count(*) AS cnt FROM kept GROUP BY ALL",
    "baselines_merged_operations": """SELECT op, round(avg(elapsed), 3) AS dur_mean, round(stddev_pop(elapsed), 3) AS dur_std, round(avg(idx), 6) AS idx_mean,
        round(stddev_pop(idx), 6) AS idx_std FROM kept GROUP BY op""",
    "baselines_merged_callers": """SELECT * FROM (SELECT caller, round(avg(events), 6) AS rate_mean, round(stddev_pop(events), 6) AS rate_std, round(avg(hour), 6) AS hour_mean FROM k_sess GROUP BY caller)
        JOIN (SELECT caller, count(DISTINCT op) AS op_values, count(DISTINCT prov) AS prov_values, count(DISTINCT sub) AS sub_values, count(DISTINCT rg) AS rg_values,
                count(DISTINCT rtype) AS rtype_values, count(DISTINCT ip) AS ip_values FROM kept GROUP BY caller) USING (caller)""",
    "generation_ngram_changes": "SELECT * FROM grams",
    "generation_caller_drift": """SELECT caller, any_value(n) AS new, any_value(l) AS lost, any_value(k) AS kept, CAST(any_value(o) AS BIGINT) AS old_events, CAST(any_value(w) AS BIGINT) AS new_events,
        CASE WHEN any_value(o) > 0 AND any_value(w) > 0 THEN round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) END AS divergence
        FROM (SELECT g.*, n, l, k, o, w, old_cnt / CAST(o AS DOUBLE) AS p, new_cnt / CAST(w AS DOUBLE) AS q FROM grams g
              JOIN (SELECT caller, count(*) FILTER (change = 'new') AS n, count(*) FILTER (change = 'lost') AS l, count(*) FILTER (change = 'kept') AS k,
                      sum(old_cnt) AS o, sum(new_cnt) AS w FROM grams GROUP BY caller) USING (caller)) GROUP BY caller""",
    "generation_seen_changes": """SELECT caller, dim, count(*) FILTER (was IS NULL) AS new, count(*) FILTER ("is" IS NULL) AS lost, count(*) FILTER (was AND "is") AS kept
        FROM (SELECT *, true AS was FROM m_seen) FULL JOIN (SELECT DISTINCT caller, dim, val, true AS "is" FROM t_vals) USING (caller, dim, val) GROUP BY caller, dim""",
    "generation_operation_shift": """SELECT coalesce(a.op, b.op) AS op, CASE WHEN a.op IS NULL THEN 'new' WHEN b.op IS NULL THEN 'lost' ELSE 'kept' END AS change,
        round((b.dur_mean - a.dur_mean) / nullif(a.dur_std, 0), 6) AS dur_shift, round((b.idx_mean - a.idx_mean) / nullif(a.idx_std, 0), 6) AS idx_shift
        FROM m_op a FULL JOIN n_op b ON a.op IS NOT DISTINCT FROM b.op""",
    "outcomes_by_cause": """SELECT track, category, caller, CAST(grouping(track, category, caller) AS BIGINT) AS level, count(*) AS outcomes, max(total_score) AS highest, round(avg(total_score), 6) AS mean_score
        FROM outcomes GROUP BY GROUPING SETS ((track, category, caller), (track, category), (track, caller), (caller), (track), ())""",
    "outcomes_by_confidence": """SELECT track, uncertainty, category, CAST(grouping(track, uncertainty, category) AS BIGINT) AS level, count(*) AS outcomes, max(total_score) AS highest,
        round(avg(total_score), 6) AS mean_score FROM outcomes GROUP BY ROLLUP (track, uncertainty, category)""",
    "verdict_cube": """SELECT track, bucket, decision, CAST(grouping(track, bucket, decision) AS BIGINT) AS level, count(*) AS verdicts
        FROM verdicts GROUP BY CUBE (track, bucket, decision)""",
    "sketch_distincts": "\nUNION ALL ".join(
        f"SELECT op, '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS within FROM hist GROUP BY op" for c in ("caller", "ip", "corr")
    ),
    "sketch_elapsed_quantiles": """SELECT op, share, count(*) AS "values", true AS within
        FROM hist, (VALUES (0.5e0), (0.9e0), (0.99e0)) s(share) GROUP BY op, share""",
    "time_bucket_30m": "SELECT seq, CAST(floor(t_us / 1800000000.0) AS BIGINT) AS bucket FROM ev",
    "hour_of_day": "SELECT seq, round((t_us % 86400000000) / 3.6e9, 6) AS hour FROM ev",
    "iso_range_format": f"SELECT seq, {_ISO.format('t_us')} || ' — ' || {_ISO.format('(t_us + 90000000)')} AS window_text FROM ev",
    "chrono_split_counts": "SELECT part, count(*) AS events FROM parts GROUP BY part",
    "chrono_split_rows": "SELECT seq, part FROM parts",
    "ngram_history": "SELECT seq, part, h1, h2, h3, h4 FROM hist",
    "lifecycle_position": "SELECT seq, idx, n FROM hist",
    "lifecycle_elapsed": "SELECT seq, round(elapsed, 6) AS elapsed FROM hist",
    "model_ngram_counts": "SELECT * FROM m_ngram",
    "model_ngram_max": "SELECT max_cnt FROM m_max",
    "model_op_duration": "SELECT op, round(dur_mean, 6) AS dur_mean, round(dur_std, 6) AS dur_std FROM m_op",
    "model_op_index": "SELECT op, round(idx_mean, 6) AS idx_mean, round(idx_std, 6) AS idx_std FROM m_op",
    **{f"model_seen_{'type' if d == 'rtype' else d}": f"SELECT caller, val FROM m_seen WHERE dim = '{d}'" for d in ("op", "prov", "sub", "rg", "rtype", "ip")},
    "model_session_counts": "SELECT caller, bucket, events, round(hour, 6) AS hour FROM m_sess",
    "model_caller_baseline": "SELECT caller, round(rate_mean, 6) AS rate_mean, round(rate_std, 6) AS rate_std, round(hour_mean, 6) AS hour_mean FROM m_caller",
    "score_event_structural": "SELECT seq, struct FROM scored",
    "score_event_rarity": "SELECT seq, round(rarity, 6) AS rarity FROM scored",
    "score_event_duration": "SELECT seq, round(dur_dev, 6) AS dur_dev FROM scored",
    "score_event_length": "SELECT seq, round(len_dev, 6) AS len_dev FROM scored",
    "lifecycle_first_caller": "SELECT correlation_id, caller FROM lc",
    "lifecycle_ops_first10": "SELECT correlation_id, first_ops FROM lc",
    "lifecycle_ops_last10": "SELECT correlation_id, last_ops FROM lc",
    "lifecycle_context": "SELECT correlation_id, context FROM lc",
    "lifecycle_scores": """SELECT correlation_id, caller, first_t, last_t, events, struct, round(rarity, 6) AS rarity,
        round(dur_dev, 6) AS dur_dev, round(len_dev, 6) AS len_dev, context FROM lc""",
    "lifecycle_signals": "SELECT correlation_id, total_score, effective_signal_count FROM sig",
    "lifecycle_explanation": "SELECT correlation_id, explanation FROM a_rows",
    "lifecycle_patterns": "SELECT correlation_id, caller, last_ops, struct, context, pattern_count FROM pat",
    "top20_total": f"SELECT {_A} FROM a_total",
    "top20_context": f"SELECT {_A} FROM a_context",
    "lifecycle_alerts": f"SELECT {_A} FROM a_alerts",
    "session_new_entities": "SELECT caller, bucket, new_op, new_prov, new_sub, new_rg, new_type, new_ip FROM ses",
    "session_activity_dev": "SELECT caller, bucket, events, round(activity_dev, 6) AS activity_dev FROM ses",
    "session_hour_dev": "SELECT caller, bucket, round(hour_dev, 6) AS hour_dev FROM ses",
    "session_scores": """SELECT caller, bucket, first_t, last_t, events, new_op, new_prov, new_sub, new_rg, new_type, new_ip,
        round(activity_dev, 6) AS activity_dev, round(hour_dev, 6) AS hour_dev FROM ses""",
    "session_dominant_signal": "SELECT caller, bucket, total_score, effective_signal_count, dominant_signal FROM s_sig",
    "session_context": "SELECT caller, bucket, session_context FROM s_shown",
    "session_alerts_top100": f"SELECT {_B} FROM b_alerts",
    "diagnose_lifecycle": f"SELECT correlation_id, {_TOLD} FROM a_told",
    "diagnose_session": f"SELECT csv_pos, caller, {_TOLD} FROM b_told",
    "packet_queue_a1": f"SELECT number, {_A}, {_TOLD} FROM qa1",
    "packet_queue_a2": f"SELECT number, {_A}, {_TOLD} FROM qa2",
    "packet_queue_b": f"SELECT csv_pos AS number, {_B}, {_TOLD} FROM b_told WHERE csv_pos <= 20",
    "component_percentiles": "\nUNION ALL ".join(
        f"SELECT '{c}' AS component, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.99), 6) AS p99 FROM lc"
        for c in ("struct", "rarity", "dur_dev", "len_dev")
    ),
    "manifest_counts": """SELECT (SELECT count(*) FROM lc) AS track_a_scored, (SELECT count(*) FROM lc WHERE context > 0) AS context_nonzero,
        (SELECT count(*) FROM ses) AS track_b_scored, (SELECT count(*) FROM pat) AS track_a_deduplicated_patterns""",
    "verdict_effectiveness": """SELECT track, bucket, count(*) FILTER (decision = 'CONFIRMED_ANOMALY') AS confirmed,
        count(*) FILTER (decision = 'BENIGN_FALSE_POSITIVE') AS false_positives, count(*) FILTER (decision = 'UNREVIEWED') AS unreviewed,
        round(count(*) FILTER (decision = 'CONFIRMED_ANOMALY') / CAST(nullif(count(*) FILTER (decision <> 'UNREVIEWED'), 0) AS DOUBLE), 6) AS precision
        FROM verdicts GROUP BY track, bucket""",
    "next_op_topk_accuracy": """SELECT count(*) AS events, round(avg(CASE WHEN r.k = 1 THEN 1.0e0 ELSE 0 END), 6) AS top1,
        round(avg(CASE WHEN r.k <= 3 THEN 1.0e0 ELSE 0 END), 6) AS top3
        FROM test LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY caller, h4, h3, h2, h1 ORDER BY cnt DESC, op) AS k FROM m_ngram) r
        USING (caller, h4, h3, h2, h1, op)""",
    "new_entity_listing": "SELECT caller, bucket, dim, val FROM t_new",
}

ORACLE = {name: f"WITH {STEPS}\n{last}" for name, last in LAST.items()}
