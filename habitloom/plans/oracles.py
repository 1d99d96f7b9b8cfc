"""The registered queries as SQL over the same tables.

Definitions are stated directly (all pairs, refits, order-by windows), not by
the routes the Spark operators take.
"""

_BLOCKS = {
    "ev": """
raw AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS seq_id,
    CASE WHEN day(ts) <= 15 THEN 'source' ELSE 'target' END AS corpus_id,
    CAST(isodow(ts) - 1 AS INTEGER) AS day, CAST(hour(ts) // 3 AS INTEGER) AS hour_slot,
    CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS device_id,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
ev AS (
  SELECT corpus_id, seq_id,
    CAST(row_number() OVER (PARTITION BY corpus_id, seq_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
    day, hour_slot, device_id, CAST(device_id * 4 + k // 25 AS INTEGER) AS action_id
  FROM raw)""",
    "steps_next": """
nx AS (
  SELECT corpus_id, seq_id, device_id, action_id,
    lead(device_id) OVER (PARTITION BY corpus_id, seq_id ORDER BY pos) AS next_device,
    lead(action_id) OVER (PARTITION BY corpus_id, seq_id ORDER BY pos) AS next_action
  FROM ev)""",
    "dist": """
dist AS (
  SELECT corpus_id, 'd:' || device_id AS device, count(*) AS n,
    count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY corpus_id) AS p
  FROM ev GROUP BY 1, 2)""",
    "trans": """
trans AS (
  SELECT corpus_id, device_id AS s, next_device AS t, count(*) AS n FROM nx WHERE next_device IS NOT NULL GROUP BY 1, 2, 3),
tm AS (
  SELECT corpus_id, 'd:' || s AS source, 'd:' || t AS target, n,
    n::DOUBLE / sum(n) OVER (PARTITION BY corpus_id, s) AS value
  FROM trans)""",
    "prec": """
lastpos AS (SELECT corpus_id, seq_id, device_id, max(pos) AS mp FROM ev GROUP BY 1, 2, 3),
prec AS (
  SELECT e.corpus_id, 'd:' || e.device_id AS source, 'd:' || l.device_id AS target, count(*)::DOUBLE / any_value(d.n) AS value
  FROM ev e JOIN lastpos l ON l.corpus_id = e.corpus_id AND l.seq_id = e.seq_id AND l.mp > e.pos AND l.device_id <> e.device_id
  JOIN (SELECT corpus_id, device_id, count(*) AS n FROM ev GROUP BY 1, 2) d ON d.corpus_id = e.corpus_id AND d.device_id = e.device_id
  GROUP BY 1, 2, 3),
prior AS (SELECT source, target, value AS weight FROM prec WHERE corpus_id = 'source')""",
    "shares": """
src AS (SELECT device, p FROM dist WHERE corpus_id = 'source'),
tgt AS (SELECT device, p FROM dist WHERE corpus_id = 'target')""",
    "guard": """
ends AS (
  SELECT p.source, p.target, p.weight,
    coalesce(so.p, 0) AS s_obs, coalesce(st.p, 0) AS s_tgt, coalesce(t_o.p, 0) AS t_obs, coalesce(tt.p, 0) AS t_tgt
  FROM prior p LEFT JOIN src so ON so.device = p.source LEFT JOIN tgt st ON st.device = p.source
  LEFT JOIN src t_o ON t_o.device = p.target LEFT JOIN tgt tt ON tt.device = p.target),
guard AS (
  SELECT *, s_obs / greatest(s_tgt, 0.001, 1e-8) AS s_ratio, t_obs / greatest(t_tgt, 0.001, 1e-8) AS t_ratio,
    s_obs / greatest(s_tgt, 0.001, 1e-8) > 1.0 AS s_over, t_obs / greatest(t_tgt, 0.001, 1e-8) > 1.0 AS t_over
  FROM ends)""",
    "known": """
known AS (SELECT corpus_id, seq_id, pos, action_id - 4 * device_id AS verb, CASE WHEN device_id <= 2 THEN device_id ELSE -1 END AS k FROM ev),
known_next AS (SELECT corpus_id, k, lead(k) OVER (PARTITION BY corpus_id, seq_id ORDER BY pos) AS next_k FROM known)""",
    "fuse": """
kept_steps AS (
  SELECT 'd:' || k AS source, 'd:' || next_k AS target, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY k) AS score
  FROM known_next WHERE corpus_id = 'source' AND next_k IS NOT NULL GROUP BY k, next_k),
fuse AS (
  SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, a.n, a.score, b.weight,
    coalesce(a.score, 0) / (SELECT max(score) FROM kept_steps) AS nt,
    coalesce(b.weight, 0) / (SELECT max(weight) FROM prior) AS nc
  FROM kept_steps a FULL OUTER JOIN prior b ON a.source = b.source AND a.target = b.target)""",
    "cons": """
strength AS (SELECT source, target, weight, weight / (SELECT max(weight) FROM prior) AS norm FROM prior),
cons AS (
  SELECT e.corpus_id, e.seq_id, count(b.pos) AS pairs, count(CASE WHEN s.weight > 0 THEN 1 END) AS supported,
    CASE WHEN count(b.pos) = 0 THEN 1.0 ELSE sum(coalesce(s.norm, 0)) / count(b.pos) END AS score
  FROM ev e LEFT JOIN ev b ON b.corpus_id = e.corpus_id AND b.seq_id = e.seq_id AND b.pos > e.pos
  LEFT JOIN strength s ON s.source = 'd:' || e.device_id AND s.target = 'd:' || b.device_id
  GROUP BY 1, 2)""",
    "tv": """
seqshare AS (
  SELECT corpus_id, seq_id, 'd:' || device_id AS device, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY corpus_id, seq_id) AS share
  FROM ev GROUP BY 1, 2, 3),
tv AS (
  SELECT q.corpus_id, q.seq_id, 0.5 * sum(abs(coalesce(s.share, 0) - t.p)) AS penalty
  FROM (SELECT DISTINCT corpus_id, seq_id FROM ev) q CROSS JOIN tgt t
  LEFT JOIN seqshare s ON s.corpus_id = q.corpus_id AND s.seq_id = q.seq_id AND s.device = t.device
  GROUP BY 1, 2)""",
    "scores": """
scores AS (
  SELECT c.corpus_id, c.seq_id, c.pairs, c.supported, c.score, tv.penalty, l.loss,
    0.5 * greatest(l.loss, 0) - 1.5 * (1 - c.score) - 0.8 * tv.penalty AS final
  FROM cons c JOIN tv USING (corpus_id, seq_id)
  JOIN (SELECT corpus_id, seq_id, avg(action_id) / 20 - 0.1 AS loss FROM ev GROUP BY 1, 2) l USING (corpus_id, seq_id))""",
    "tok": """
pv AS (
  SELECT *, lag(action_id) OVER w AS pa, lag(hour_slot) OVER w AS ph, lag(device_id) OVER w AS pd
  FROM ev WINDOW w AS (PARTITION BY corpus_id, seq_id ORDER BY pos)),
tok AS (
  SELECT 'spring' AS env, corpus_id, seq_id, pos, coalesce(pa, CAST(-2147483648 AS INTEGER)) AS prev, action_id AS token, 20 AS v FROM pv
  UNION ALL SELECT 'night', corpus_id, seq_id, pos, coalesce(ph, CAST(-2147483648 AS INTEGER)), hour_slot, 8 FROM pv
  UNION ALL SELECT 'multiple', corpus_id, seq_id, pos, coalesce(pd, CAST(-2147483648 AS INTEGER)), device_id, 5 FROM pv)""",
    "loss": """
cnt AS (SELECT env, prev, token, count(*) AS n FROM tok WHERE corpus_id = 'source' GROUP BY 1, 2, 3),
ctx AS (SELECT env, prev, count(*) AS n FROM tok WHERE corpus_id = 'source' GROUP BY 1, 2),
loss AS (
  SELECT t.env, t.corpus_id, t.seq_id, count(*) AS n_tokens,
    avg(-ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + t.v))) AS loss
  FROM tok t LEFT JOIN cnt c USING (env, prev, token) LEFT JOIN ctx x USING (env, prev) GROUP BY 1, 2, 3)""",
    "split": """
ids AS (SELECT corpus_id, seq_id FROM ev WHERE pos = 0),
ordered AS (
  SELECT corpus_id, seq_id, count(*) OVER () AS n,
    row_number() OVER (ORDER BY CAST('0x' || substr(md5('2024:' || corpus_id || ':' || seq_id), 1, 13) AS BIGINT), corpus_id, seq_id) AS place
  FROM ids),
split AS (SELECT corpus_id, seq_id, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM ordered)""",
    "filt": """
stok AS (SELECT * FROM tok WHERE env = 'multiple'),
fcnt AS (SELECT prev, token, count(*) AS n FROM stok GROUP BY 1, 2),
fctx AS (SELECT prev, count(*) AS n FROM stok GROUP BY 1),
floss AS (
  SELECT t.corpus_id, t.seq_id, avg(-ln((c.n + 1)::DOUBLE / (x.n + 5))) AS loss
  FROM stok t JOIN fcnt c USING (prev, token) JOIN fctx x USING (prev) GROUP BY 1, 2),
fout AS (
  SELECT *, loss > (SELECT quantile_cont(loss, 0.75) + 1.5 * (quantile_cont(loss, 0.75) - quantile_cont(loss, 0.25)) FROM floss) AS is_outlier
  FROM floss),
fsplit AS (
  SELECT corpus_id, seq_id, count(*) OVER () AS n,
    row_number() OVER (ORDER BY CAST('0x' || substr(md5('2024:' || corpus_id || ':' || seq_id), 1, 13) AS BIGINT), corpus_id, seq_id) AS place
  FROM fout WHERE NOT is_outlier),
ftrain AS (SELECT t.* FROM stok t JOIN fsplit s USING (corpus_id, seq_id) WHERE s.place <= floor(s.n * 0.8::DOUBLE)),
fval AS (SELECT t.* FROM stok t JOIN fsplit s USING (corpus_id, seq_id) WHERE s.place > floor(s.n * 0.8::DOUBLE)),
fval_len AS (SELECT corpus_id, seq_id, count(*) AS len FROM fval GROUP BY 1, 2),
fval_w AS (
  SELECT v.prev, v.token, sum(1.0::DOUBLE / l.len) / (SELECT count(*) FROM fval_len) AS w
  FROM fval v JOIN fval_len l USING (corpus_id, seq_id) GROUP BY 1, 2),
fn AS (SELECT prev, token, count(*) AS n FROM ftrain GROUP BY 1, 2),
fnx AS (SELECT prev, count(*) AS n FROM ftrain GROUP BY 1),
od AS (SELECT t.corpus_id, t.seq_id, prev, token, count(*) AS d FROM stok t JOIN fout o USING (corpus_id, seq_id) WHERE o.is_outlier GROUP BY 1, 2, 3, 4),
odx AS (SELECT corpus_id, seq_id, prev, sum(d)::BIGINT AS d FROM od GROUP BY 1, 2, 3),
refit AS (
  SELECT o.corpus_id, o.seq_id,
    sum(w.w * (
      ln((coalesce(b.n, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + 5))
      - ln((coalesce(b.n, 0) + coalesce(d.d, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + coalesce(dx.d, 0) + 5)))) AS change
  FROM (SELECT corpus_id, seq_id FROM fout WHERE is_outlier) o CROSS JOIN fval_w w
  LEFT JOIN fn b ON b.prev = w.prev AND b.token = w.token LEFT JOIN fnx x ON x.prev = w.prev
  LEFT JOIN od d ON d.corpus_id = o.corpus_id AND d.seq_id = o.seq_id AND d.prev = w.prev AND d.token = w.token
  LEFT JOIN odx dx ON dx.corpus_id = o.corpus_id AND dx.seq_id = o.seq_id AND dx.prev = w.prev
  GROUP BY 1, 2),
filt AS (
  SELECT f.corpus_id, f.seq_id, f.is_outlier, CASE WHEN f.is_outlier THEN r.change <= 0 END AS readmit,
    NOT f.is_outlier OR coalesce(r.change <= 0, FALSE) AS kept, r.change
  FROM fout f LEFT JOIN refit r USING (corpus_id, seq_id))""",
    "attack": """
aimed AS (SELECT unnest(['spring', 'night', 'multiple']) AS env),
att AS (
  SELECT a.env, l.label, CASE WHEN l.label = 1 THEN 'attack:' ELSE 'normal:' END || a.env AS corpus_id, e.seq_id, e.pos, e.day,
    CAST(CASE WHEN l.label = 1 AND a.env = 'night' THEN 2 + e.hour_slot % 4 ELSE e.hour_slot END AS INTEGER) AS hour_slot,
    CAST(CASE WHEN l.label = 1 AND a.env = 'spring' THEN 1 WHEN l.label = 1 AND a.env = 'multiple' THEN 4 ELSE e.device_id END AS INTEGER) AS device_id,
    CAST(CASE WHEN l.label = 1 AND a.env = 'spring' THEN 4 ELSE e.action_id END AS INTEGER) AS action_id
  FROM ev e CROSS JOIN aimed a CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS label) l WHERE e.corpus_id = 'target')""",
    "detect": """
etok AS (SELECT t.*, s.part FROM tok t JOIN (
    SELECT o.corpus_id, o.seq_id, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS part
    FROM (SELECT corpus_id, seq_id, count(*) OVER () AS n, row_number() OVER (ORDER BY CAST('0x' || substr(md5('2024:' || corpus_id || ':' || seq_id), 1, 13) AS BIGINT), corpus_id, seq_id) AS place
      FROM ev WHERE pos = 0 AND corpus_id = 'source') o) s USING (corpus_id, seq_id)),
dcnt AS (SELECT env, prev, token, count(*) AS n FROM etok WHERE part = 'train' OR env = 'multiple' GROUP BY 1, 2, 3),
dctx AS (SELECT env, prev, count(*) AS n FROM etok WHERE part = 'train' OR env = 'multiple' GROUP BY 1, 2),
vloss AS (
  SELECT t.env, t.seq_id, avg(-ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + t.v))) AS loss
  FROM etok t LEFT JOIN dcnt c USING (env, prev, token) LEFT JOIN dctx x USING (env, prev)
  WHERE t.part = 'validation' OR t.env = 'multiple' GROUP BY 1, 2),
thr AS (SELECT env, CASE WHEN env = 'multiple' THEN quantile_cont(loss, 0.99) ELSE quantile_cont(loss, 0.95) END AS threshold FROM vloss GROUP BY env),
ptest AS (
  SELECT env, label, corpus_id, seq_id, CASE env WHEN 'spring' THEN action_id WHEN 'night' THEN hour_slot ELSE device_id END AS token,
    CASE env WHEN 'spring' THEN 20 WHEN 'night' THEN 8 ELSE 5 END AS v, pos FROM att),
ptok AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY corpus_id, seq_id ORDER BY pos), CAST(-2147483648 AS INTEGER)) AS prev FROM ptest),
ploss AS (
  SELECT t.env, t.label, t.corpus_id, t.seq_id, avg(-ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + t.v))) AS loss
  FROM ptok t LEFT JOIN dcnt c USING (env, prev, token) LEFT JOIN dctx x USING (env, prev) GROUP BY 1, 2, 3, 4),
pred AS (SELECT p.*, CASE WHEN loss < threshold THEN 0 ELSE 1 END AS predicted FROM ploss p JOIN thr USING (env)),
conf AS (
  SELECT env, count(CASE WHEN label = 1 AND predicted = 1 THEN 1 END) AS tp, count(CASE WHEN label = 0 AND predicted = 0 THEN 1 END) AS tn,
    count(CASE WHEN label = 0 AND predicted = 1 THEN 1 END) AS fp, count(CASE WHEN label = 1 AND predicted = 0 THEN 1 END) AS fn, count(*) AS test_size
  FROM pred GROUP BY 1),
pr AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r
  FROM conf),
eval AS (
  SELECT env, tp, tn, fp, fn, test_size, round(p, 9) AS precision, round(r, 9) AS recall, round((tp + tn)::DOUBLE / test_size, 9) AS accuracy,
    round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1,
    round(fp::DOUBLE / nullif(fp + tn, 0), 9) AS fpr, round(fn::DOUBLE / nullif(fn + tp, 0), 9) AS fnr
  FROM pr)""",
    "quality": """
kl AS (
  SELECT sum(p * ln(p / q)) AS kl FROM (
    SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM (
      SELECT coalesce(t.p, 0) + 1e-12 AS p, coalesce(s.p, 0) + 1e-12 AS q FROM tgt t FULL OUTER JOIN src s USING (device)))),
sim_t AS (
  SELECT sum(coalesce(a.value, 0) * coalesce(b.value, 0)) / (sqrt(sum(coalesce(a.value, 0) ** 2)) * sqrt(sum(coalesce(b.value, 0) ** 2))) AS s
  FROM (SELECT * FROM tm WHERE corpus_id = 'target') a FULL OUTER JOIN (SELECT * FROM tm WHERE corpus_id = 'source') b USING (source, target)),
sim_p AS (
  SELECT sum(coalesce(a.value, 0) * coalesce(b.value, 0)) / (sqrt(sum(coalesce(a.value, 0) ** 2)) * sqrt(sum(coalesce(b.value, 0) ** 2))) AS s
  FROM (SELECT * FROM prec WHERE corpus_id = 'target') a FULL OUTER JOIN (SELECT * FROM prec WHERE corpus_id = 'source') b USING (source, target))""",
    "all_quality": """
qe AS (SELECT corpus_id, seq_id, pos, device_id FROM ev UNION ALL SELECT corpus_id, seq_id, pos, device_id FROM att WHERE label = 1),
qv AS (SELECT DISTINCT corpus_id AS variant FROM qe WHERE corpus_id <> 'target'),
qd AS (SELECT corpus_id, device_id, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY corpus_id) AS p FROM qe GROUP BY 1, 2),
qkl AS (
  SELECT variant, sum(p * ln(p / q)) AS kl FROM (
    SELECT variant, p / sum(p) OVER (PARTITION BY variant) AS p, q / sum(q) OVER (PARTITION BY variant) AS q FROM (
      SELECT variant, device_id, sum(p) + 1e-12 AS p, sum(q) + 1e-12 AS q FROM (
        SELECT variant, device_id, p, 0 AS q FROM qv, qd WHERE corpus_id = 'target'
        UNION ALL SELECT corpus_id, device_id, 0, p FROM qd WHERE corpus_id <> 'target') GROUP BY 1, 2)) GROUP BY 1),
qnext AS (SELECT corpus_id, device_id AS s, lead(device_id) OVER (PARTITION BY corpus_id, seq_id ORDER BY pos) AS t FROM qe),
qlast AS (SELECT corpus_id, seq_id, device_id, max(pos) AS mp FROM qe GROUP BY 1, 2, 3),
qm AS (
  SELECT 'next' AS kind, corpus_id, s, t, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY corpus_id, s) AS v FROM qnext WHERE t IS NOT NULL GROUP BY 2, 3, 4
  UNION ALL
  SELECT 'later', e.corpus_id, e.device_id, l.device_id, count(*)::DOUBLE / any_value(d.n)
  FROM qe e JOIN qlast l ON l.corpus_id = e.corpus_id AND l.seq_id = e.seq_id AND l.mp > e.pos AND l.device_id <> e.device_id
  JOIN qd d ON d.corpus_id = e.corpus_id AND d.device_id = e.device_id GROUP BY 2, 3, 4),
qc AS (
  SELECT variant, kind, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS c FROM (
    SELECT variant, kind, s, t, sum(a) AS a, sum(b) AS b FROM (
      SELECT variant, kind, s, t, v AS a, 0::DOUBLE AS b FROM qv, qm WHERE corpus_id = 'target'
      UNION ALL SELECT corpus_id, kind, s, t, 0, v FROM qm WHERE corpus_id <> 'target') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
compared AS (
  SELECT variant, (SELECT count(*) FROM qe WHERE pos = 0 AND corpus_id = 'target') AS num_target_sequences,
    (SELECT count(*) FROM qe WHERE pos = 0 AND corpus_id = variant) AS num_synthetic_sequences, round(kl, 9) AS device_distribution_kl,
    (SELECT round(CASE WHEN isnan(c) THEN 0 ELSE c END, 9) FROM qc WHERE qc.variant = qkl.variant AND kind = 'next') AS transition_matrix_similarity,
    (SELECT round(CASE WHEN isnan(c) THEN 0 ELSE c END, 9) FROM qc WHERE qc.variant = qkl.variant AND kind = 'later') AS causal_graph_similarity
  FROM qkl)""",
    "cells": """
kinds AS (SELECT seed, variant FROM (SELECT unnest([42, 2024])::INTEGER AS seed), (SELECT unnest(['full', 'half']) AS variant)),
cev AS (
  SELECT dataset, seed, variant, dataset || '/' || seed || '/' || variant || '/' || corpus_id AS corpus_id, seq_id, pos, hour_slot, device_id, action_id
  FROM (SELECT *, CASE WHEN md5(seq_id)[1] < '8' THEN 'fr' ELSE 'sp' END AS dataset FROM ev WHERE corpus_id = 'source'), kinds
  WHERE variant = 'full' OR md5(seq_id)[2] < '8'),
cplace AS (
  SELECT dataset, seed, variant, corpus_id, seq_id, count(*) OVER w AS n, row_number() OVER (w ORDER BY CAST('0x' || substr(md5('2024:' || corpus_id || ':' || seq_id), 1, 13) AS BIGINT), corpus_id, seq_id) AS place
  FROM cev WHERE pos = 0 WINDOW w AS (PARTITION BY dataset, seed, variant)),
cparts AS (SELECT dataset, seed, variant, corpus_id, seq_id, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM cplace)""",
    "cell_detect": """
cenv AS (SELECT unnest(['spring', 'night', 'multiple']) AS env, unnest([20, 8, 5]) AS v),
ctok AS (
  SELECT env, v, dataset, seed, variant, corpus_id, seq_id, part, token,
    coalesce(lag(token) OVER (PARTITION BY env, corpus_id, seq_id ORDER BY pos), CAST(-2147483648 AS INTEGER)) AS prev
  FROM (SELECT *, CASE env WHEN 'spring' THEN action_id WHEN 'night' THEN hour_slot ELSE device_id END AS token FROM cev, cenv)
  JOIN cparts USING (dataset, seed, variant, corpus_id, seq_id)),
ccnt AS (SELECT env, dataset, seed, variant, prev, token, count(*) AS n FROM ctok WHERE part = 'train' OR env = 'multiple' GROUP BY ALL),
cctx AS (SELECT env, dataset, seed, variant, prev, sum(n) AS n FROM ccnt GROUP BY ALL),
cval AS (
  SELECT env, dataset, seed, variant, corpus_id, seq_id, avg(-ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + v))) AS loss
  FROM ctok LEFT JOIN ccnt c USING (env, dataset, seed, variant, prev, token) LEFT JOIN cctx x USING (env, dataset, seed, variant, prev)
  WHERE part = 'validation' OR env = 'multiple' GROUP BY ALL),
cthr AS (SELECT env, dataset, seed, variant, CASE WHEN env = 'multiple' THEN quantile_cont(loss, 0.99) WHEN env = 'spring' AND dataset = 'fr' THEN quantile_cont(loss, 0.955) ELSE quantile_cont(loss, 0.95) END AS threshold FROM cval GROUP BY env, dataset, seed, variant),
ctest AS (
  SELECT env, v, label, dataset, seed, variant, corpus_id, seq_id, token,
    coalesce(lag(token) OVER (PARTITION BY seed, variant, corpus_id, seq_id ORDER BY pos), CAST(-2147483648 AS INTEGER)) AS prev
  FROM (SELECT *, CASE WHEN md5(seq_id)[1] < '8' THEN 'fr' ELSE 'sp' END AS dataset, CASE env WHEN 'spring' THEN action_id WHEN 'night' THEN hour_slot ELSE device_id END AS token
    FROM att JOIN cenv USING (env)), kinds),
closs AS (
  SELECT env, dataset, seed, variant, label, corpus_id, seq_id, avg(-ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(x.n, 0) + v))) AS loss
  FROM ctest LEFT JOIN ccnt c USING (env, dataset, seed, variant, prev, token) LEFT JOIN cctx x USING (env, dataset, seed, variant, prev) GROUP BY ALL),
cconf AS (
  SELECT env, dataset, seed, variant, count(CASE WHEN label = 1 AND loss >= threshold THEN 1 END) AS tp, count(CASE WHEN label = 0 AND loss < threshold THEN 1 END) AS tn,
    count(CASE WHEN label = 0 AND loss >= threshold THEN 1 END) AS fp, count(CASE WHEN label = 1 AND loss < threshold THEN 1 END) AS fn, count(*) AS test_size
  FROM closs JOIN cthr USING (env, dataset, seed, variant) GROUP BY ALL)""",
    "faulty": """
bad AS (
  SELECT corpus_id, seq_id, pos, day + CASE WHEN pos = 3 THEN 7 ELSE 0 END AS day,
    hour_slot + CASE WHEN pos = 4 AND device_id = 0 THEN 8 ELSE 0 END AS hour_slot,
    device_id + CASE WHEN pos = 5 THEN 5 ELSE 0 END AS device_id,
    CASE WHEN pos >= 2 THEN (action_id * 7 + pos) % 23 ELSE action_id END AS action_id
  FROM ev),
whole AS (SELECT corpus_id, seq_id, flatten(list([day, hour_slot, device_id, action_id] ORDER BY pos)) AS flat FROM bad GROUP BY 1, 2),
faulty AS (
  SELECT corpus_id, seq_id, CASE WHEN flat[1] = 5 AND len(flat) = 4 THEN NULL WHEN flat[1] = 4 AND len(flat) = 4 THEN []
    WHEN flat[1] = 6 AND len(flat) >= 8 THEN flat[1:len(flat) - 1] ELSE flat END AS flat
  FROM whole)""",
    "checked": """
checked AS (
  SELECT f.corpus_id, f.seq_id, f.flat, i,
    flat[4 * i + 1] AS d, flat[4 * i + 2] AS h, flat[4 * i + 3] AS dev, flat[4 * i + 4] AS act
  FROM faulty f, unnest(range(0, len(f.flat) // 4)) AS u(i) WHERE f.flat IS NOT NULL),
found AS (
  SELECT corpus_id, seq_id, i, 1 AS o, 'day_out_of_range@event_' || i || ':' || d AS reason FROM checked WHERE d NOT BETWEEN 0 AND 6
  UNION ALL SELECT corpus_id, seq_id, i, 2, 'hour_slot_out_of_range@event_' || i || ':' || h FROM checked WHERE h NOT BETWEEN 0 AND 7
  UNION ALL SELECT corpus_id, seq_id, i, 3, 'illegal_device_id@event_' || i || ':' || dev FROM checked WHERE dev NOT BETWEEN 0 AND 4
  UNION ALL SELECT corpus_id, seq_id, i, 4, 'illegal_action_id@event_' || i || ':' || act FROM checked WHERE act NOT BETWEEN 0 AND 19
  UNION ALL SELECT corpus_id, seq_id, i, 5, 'device_action_mismatch@event_' || i || ':device=' || dev || ',action=' || act || ',expected_device=' || (act // 4)
    FROM checked WHERE dev BETWEEN 0 AND 4 AND act BETWEEN 0 AND 19 AND dev <> act // 4 AND NOT (act // 4 = 2 AND dev = 3)),
why AS (SELECT corpus_id, seq_id, string_agg(reason, ';' ORDER BY i, o) AS reasons FROM found GROUP BY 1, 2)""",
    "met": """
met AS (
  SELECT o_orderkey AS k, ['fr', 'sp', 'us'][o_custkey % 3 + 1] AS dataset, ['st', 'tt', 'nt'][o_orderkey % 3 + 1] AS scenario,
    2024 + o_custkey % 5 AS seed,
    ['baseline_gen', 'causal_gss_only', 'causal_tof_only', 'full_causal', 'zero_target_baseline', 'zero_target_causal_gss',
     'zero_target_causal_tof', 'zero_target_full', 'target_assisted_full', 'exploratory', 'old_run'][o_orderkey % 11 + 1] AS variant,
    CASE WHEN o_orderkey % 13 > 2 THEN round(o_totalprice / 500000, 9) END AS f1, round(o_totalprice / 500000, 9) AS precision,
    CASE WHEN o_orderkey % 5 > 0 THEN 0.5::DOUBLE END AS recall,
    CASE WHEN o_orderkey % 2 = 0 THEN TRUE WHEN o_orderkey % 4 = 1 THEN FALSE END AS used_causal_gss, o_orderkey % 1000 AS train_size,
    CASE WHEN o_orderkey % 17 = 0 THEN 'runs/diagnostics' WHEN o_orderkey % 19 = 0 THEN 'runs/run_beta0' ELSE 'runs/run' END AS run_dir
  FROM orders),
kept AS (
  SELECT *, run_dir || '/' || k || '.json' AS metrics_path FROM met
  WHERE variant NOT IN ('exploratory', 'old_run') AND run_dir = 'runs/run')""",
    "lin": """
lin AS (
  SELECT seq_id AS variant, 'stage_' || hour_slot AS stage, hour_slot AS stage_order,
    CASE WHEN hour_slot >= 6 THEN 'downstream_ad_evaluation' WHEN hour_slot = 5 THEN 'offline_generation_quality_evaluation' ELSE 'filtering' END AS purpose,
    CAST(row_number() OVER (PARTITION BY seq_id, hour_slot ORDER BY pos) - 1 AS INTEGER) AS event_index, pos,
    CASE WHEN action_id % 4 = 3 THEN 'write' ELSE 'read' END AS operation, 'data/' || device_id || '/' || (action_id // 2) AS path,
    device_id = 2 AS target_normal, device_id = 4 AND action_id % 4 = 1 AS target_attack,
    CASE WHEN min(pos) OVER (PARTITION BY seq_id, hour_slot) >= 3 THEN 'blocked' ELSE 'success' END AS status
  FROM ev),
stages AS (
  SELECT variant, stage, stage_order, min(purpose) AS purpose, min(status) AS status, count(*) AS num_events,
    count(CASE WHEN operation = 'read' THEN 1 END) AS num_reads, count(CASE WHEN operation = 'write' THEN 1 END) AS num_writes,
    bool_or(operation = 'read' AND target_normal) AS target_normal_consumed, bool_or(operation = 'read' AND target_attack) AS target_attack_consumed
  FROM lin GROUP BY 1, 2, 3)""",
}

_EV_COLUMNS = "corpus_id, seq_id, pos, day, hour_slot, device_id, action_id"
_FLAT = "array_to_string(flatten(list([day, hour_slot, device_id, action_id] ORDER BY pos)), ',')"

ORACLES = {}


def _sql(name, blocks, body):
    parts = [_BLOCKS[b].strip() for b in blocks.split()]
    body = body.strip()
    if body.startswith(","):  # further named blocks before the final SELECT
        body = body[1:].lstrip()
        ORACLES[name] = "WITH " + ",\n".join([*parts, body])
    else:
        ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# Sequences and projections
_sql("sequences_from_events", "ev", f"SELECT {_EV_COLUMNS} FROM ev")
_sql("flat_sequences", "ev", f"SELECT corpus_id, seq_id, 0::INTEGER AS start, {_FLAT} AS flat FROM ev GROUP BY 1, 2")
_sql("flatten_roundtrip", "ev", f"SELECT {_EV_COLUMNS} FROM ev")
_sql("flatten_parts", "ev", f"SELECT {_EV_COLUMNS} FROM ev")
_sql("pair_counts_by_part", "ev steps_next", """
SELECT a.corpus_id, a.seq_id, 'ordered' AS kind, a.device_id AS source, b.device_id AS target, count(*) AS n
FROM ev a JOIN ev b ON a.corpus_id = b.corpus_id AND a.seq_id = b.seq_id AND a.pos < b.pos GROUP BY ALL
UNION ALL SELECT corpus_id, seq_id, 'adjacent', device_id, next_device, count(*) FROM nx WHERE next_device IS NOT NULL GROUP BY ALL""")
_sql("hourly_corpora", "", """
WITH raw AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS seq_id,
    CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS corpus_id,
    coalesce(list_position(['click', 'error', 'purchase'], event_type), 0) - 1 AS device FROM events),
e AS (SELECT *, lag(device) OVER w AS before, lead(device) OVER w AS next, row_number() OVER w AS place FROM raw
  WINDOW w AS (PARTITION BY corpus_id, seq_id ORDER BY ts, event_id)),
edges AS (SELECT corpus_id, count(DISTINCT (device, next)) AS num_edges FROM e WHERE next IS NOT NULL GROUP BY 1)
SELECT corpus_id, count(*) FILTER (place = 1) AS num_sequences, num_edges, count(*) FILTER (before IS NULL) AS num_starts,
  count(*) FILTER (before = -1) AS num_after_unknown, CAST(max(place) * 4 AS INTEGER) AS longest
FROM e JOIN edges USING (corpus_id) GROUP BY corpus_id, num_edges""")
_sql("id_lists", "ev", """
SELECT corpus_id, seq_id, array_to_string(list(device_id ORDER BY pos), ',') AS device_ids,
  array_to_string(list(action_id ORDER BY pos), ',') AS action_ids FROM ev GROUP BY 1, 2""")
_sql("time_index", "ev", "SELECT corpus_id, seq_id, pos, day * 8 + hour_slot AS time_index, day * 24 + hour_slot * 3 AS hour_of_week FROM ev")
_sql("channel_counts", "ev", """
SELECT level, corpus_id, channel, count(*) AS n FROM (
  SELECT 'action' AS level, corpus_id, 'a:' || action_id AS channel FROM ev
  UNION ALL SELECT 'device', corpus_id, 'd:' || device_id FROM ev
  UNION ALL SELECT 'device_action', corpus_id, 'd:' || device_id || '|a:' || action_id FROM ev)
GROUP BY 1, 2, 3 HAVING count(*) >= 30""")
_sql("canonical_keys", "", """
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN event_type ELSE 'd:' || user_id END AS source_key, 'unknown' AS target_key,
  round(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN value + 1 WHEN 3 THEN value + 2 ELSE 0 END, 6) AS strength,
  CASE WHEN event_id % 5 = 3 THEN event_type ELSE 'device_' || user_id END AS name
FROM events""")
_sql("pad_truncate", "ev", """
SELECT corpus_id, seq_id, array_to_string(list_resize(flat, 40, 20), ',') AS padded,
  CAST(len(list_filter(list_resize(flat, 40, 20), lambda x: x <> 20)) AS INTEGER) AS num_unmasked
FROM (SELECT corpus_id, seq_id, flatten(list([day, hour_slot, device_id, action_id] ORDER BY pos)) AS flat FROM ev GROUP BY 1, 2)""")
_sql("detector_tokens", "ev tok", "SELECT env, corpus_id, seq_id, pos, prev, token FROM tok")

# Description
_sql("device_distribution", "ev dist", "SELECT corpus_id, device, n, round(p, 9) AS p FROM dist")
_sql("transition_graph", "ev steps_next trans", """
SELECT corpus_id, s AS source_device, t AS target_device, 'd:' || s AS source_device_key, 'd:' || t AS target_device_key,
  coalesce(['click', 'error', 'purchase', 'signup'][s + 1], 'device_' || s) AS source_name,
  coalesce(['click', 'error', 'purchase', 'signup'][t + 1], 'device_' || t) AS target_name,
  n AS count, round(n::DOUBLE / sum(n) OVER (PARTITION BY corpus_id, s), 9) AS transition_score
FROM trans""")
_sql("graph_size", "ev steps_next trans", """
SELECT corpus_id, (SELECT count(DISTINCT seq_id) FROM ev WHERE ev.corpus_id = t.corpus_id) AS num_sequences, count(*) AS num_edges
FROM trans t GROUP BY 1""")
_sql("transition_matrix_dense", "ev known", """
, n AS (SELECT corpus_id, k, next_k, count(*) AS n FROM known_next WHERE k >= 0 AND next_k >= 0 GROUP BY ALL)
SELECT g.corpus_id, 'd:' || g.k AS source, 'd:' || g.t AS target, round(coalesce(n::DOUBLE / sum(n) OVER (PARTITION BY g.corpus_id, g.k), 0), 9) AS value
FROM (SELECT * FROM (SELECT unnest(['source', 'target']) AS corpus_id), (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([0, 1, 2]) AS t)) g
LEFT JOIN n ON n.corpus_id = g.corpus_id AND n.k = g.k AND n.next_k = g.t""")
_sql("precedence_matrix", "ev prec", "SELECT corpus_id, source, target, round(value, 9) AS value FROM prec")
_sql("channel_order", "ev", """
SELECT 'd:' || d AS channel, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS channel_index FROM (SELECT DISTINCT device_id AS d FROM ev)""")
_sql("event_tensor_count", "ev", """
SELECT corpus_id, seq_id, CAST((day * 8 + hour_slot) % 56 AS INTEGER) AS slot, 'a:' || action_id AS channel, count(*)::DOUBLE AS value FROM ev GROUP BY 1, 2, 3, 4""")
_sql("event_tensor_binary", "ev", """
SELECT DISTINCT corpus_id, seq_id, CAST((day * 8 + hour_slot) % 56 AS INTEGER) AS slot, 'd:' || device_id AS channel, 1.0::DOUBLE AS value FROM ev""")
_sql("event_tensor_decay", "ev", """
SELECT corpus_id, seq_id, t::INTEGER AS slot, channel, round(sum(power(0.1::DOUBLE, t - slot)), 9) AS value
FROM (SELECT DISTINCT corpus_id, seq_id, day * 8 + hour_slot AS slot, 'd:' || device_id AS channel FROM ev), unnest(range(slot, 56)) AS u(t)
GROUP BY 1, 2, 3, 4""")
_sql("lag_windows", "ev", """
, cell AS (SELECT DISTINCT corpus_id, seq_id, day * 8 + hour_slot AS slot, 'd:' || device_id AS channel FROM ev),
grid AS (SELECT c.*, t::INTEGER AS t FROM (SELECT DISTINCT corpus_id, seq_id, channel FROM cell) c, unnest(range(0, 56)) AS u(t)),
dense AS (
  SELECT g.corpus_id, g.seq_id, g.channel, g.t, CASE WHEN c.slot IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS x
  FROM grid g LEFT JOIN cell c ON c.corpus_id = g.corpus_id AND c.seq_id = g.seq_id AND c.channel = g.channel AND c.slot = g.t),
lagged AS (
  SELECT corpus_id, seq_id, channel, t AS slot, x AS lag_0, lag(x, 1) OVER w AS lag_1, lag(x, 2) OVER w AS lag_2, lag(x, 3) OVER w AS lag_3, lag(x, 4) OVER w AS lag_4
  FROM dense WINDOW w AS (PARTITION BY corpus_id, seq_id, channel ORDER BY t))
SELECT * FROM lagged WHERE slot >= 4 AND lag_0 + lag_1 + lag_2 + lag_3 + lag_4 > 0""")
_sql("lag_moments", "ev", """
, cell AS (SELECT DISTINCT corpus_id, seq_id, day * 8 + hour_slot AS slot, device_id FROM ev),
placed AS (SELECT corpus_id, seq_id, t, CAST(slot - t + 4 AS INTEGER) AS place, device_id FROM cell, range(4, 56) r(t) WHERE slot BETWEEN t - 4 AND t)
SELECT place AS back, device_id AS source, CAST(NULL AS INTEGER) AS ahead, CAST(NULL AS INTEGER) AS target, count(*)::DOUBLE AS total FROM placed GROUP BY ALL
UNION ALL
SELECT a.place, a.device_id, b.place, b.device_id, count(*)::DOUBLE
FROM placed a JOIN placed b ON a.corpus_id = b.corpus_id AND a.seq_id = b.seq_id AND a.t = b.t AND a.place <= b.place GROUP BY ALL""")
# Dense windows of the source half: place 0 to 3 of each channel, then the slot that is predicted.
_WINDOWS = """
, cell AS (SELECT DISTINCT seq_id, day * 8 + hour_slot AS slot, {channel} AS id FROM ev WHERE corpus_id = 'source'),
ch AS (SELECT id, row_number() OVER (ORDER BY {order}) - 1 AS c FROM (SELECT DISTINCT id FROM cell)),
seqs AS (SELECT DISTINCT seq_id FROM cell),
total AS (SELECT count(*) * 52 AS n FROM seqs),
act AS (
  SELECT seq_id, c, t, sum({decay}) AS v FROM cell JOIN ch USING (id), range(0, 56) r(t) WHERE t >= slot {only} GROUP BY ALL),
placed AS (SELECT seq_id, w.t, a.t - w.t + 4 AS back, c, v FROM act a, range(4, 56) w(t) WHERE a.t BETWEEN w.t - 4 AND w.t),
mean AS (SELECT back, c, sum(v) / (SELECT n FROM total) AS m FROM placed GROUP BY ALL),
prods AS (
  SELECT a.back, a.c, b.back AS back2, b.c AS c2, sum(a.v * b.v) AS s
  FROM placed a JOIN placed b ON a.seq_id = b.seq_id AND a.t = b.t GROUP BY ALL),
cov AS (
  SELECT a.back, a.c, b.back AS back2, b.c AS c2, (coalesce(s, 0) - n * a.m * b.m) / (n - 1) AS v
  FROM total, mean a CROSS JOIN mean b LEFT JOIN prods p ON p.back = a.back AND p.c = a.c AND p.back2 = b.back AND p.c2 = b.c)"""
# Gaussian elimination of the augmented system, one row of features, then one column per target.
_sql("mined_prior", "ev", _WINDOWS.format(channel="device_id", order="id", decay="pow(0.1, t - slot)", only="") + """,
entry AS (
  SELECT back * (SELECT count(*) FROM ch) + c AS i, back2 * (SELECT count(*) FROM ch) + c2 AS j,
    v + CASE WHEN back = back2 AND c = c2 THEN 1e-6 ELSE 0 END AS v
  FROM cov WHERE back < 4),
lines AS (SELECT i, list(v ORDER BY j) AS line FROM entry GROUP BY i),
solved AS (
  WITH RECURSIVE step(k, m) AS (
    SELECT 1, (SELECT list(line ORDER BY i) FROM lines)
    UNION ALL
    SELECT k + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m[1]) + 1), lambda j:
      CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
    FROM step WHERE k <= len(m))
  SELECT m FROM step WHERE k = len(m) + 1),
w AS (
  SELECT f.back, f.c, g.c AS target, (SELECT m FROM solved)[f.back * (SELECT count(*) FROM ch) + f.c + 1][4 * (SELECT count(*) FROM ch) + g.c + 1] AS w
  FROM (SELECT * FROM mean WHERE back < 4) f CROSS JOIN ch g),
base AS (
  SELECT g.c AS target, e.m - sum(f.m * w.w) AS b FROM w JOIN mean f USING (back, c) JOIN ch g ON g.c = w.target JOIN mean e ON e.back = 4 AND e.c = g.c GROUP BY g.c, e.m),
said AS (SELECT seq_id, t, target, sum(p.v * w.w) AS x FROM placed p JOIN w USING (back, c) GROUP BY ALL),
missed AS (
  SELECT target, sum(abs(b + coalesce(x, 0) - coalesce(y.v, 0))) / (SELECT n FROM total) AS r
  FROM base CROSS JOIN seqs CROSS JOIN range(4, 56) s(t) LEFT JOIN said USING (seq_id, t, target)
  LEFT JOIN (SELECT seq_id, t, c AS target, v FROM placed WHERE back = 4) y USING (seq_id, t, target) GROUP BY target),
raw_edges AS (SELECT c AS s, w.target AS t, r * sum(abs(w)) AS v FROM w JOIN missed USING (target) GROUP BY c, w.target, r),
kept AS (
  SELECT a.s, a.t, CASE WHEN a.s = a.t THEN a.v ELSE a.v - b.v END AS v FROM raw_edges a JOIN raw_edges b ON b.s = a.t AND b.t = a.s),
scaled AS (SELECT s, t, v / (SELECT max(v) FROM kept) AS v FROM kept WHERE v > 0)
SELECT 'd:' || x.id AS source, 'd:' || y.id AS target, round(v, 6) AS weight
FROM scaled JOIN ch x ON x.c = s JOIN ch y ON y.c = t WHERE v >= 0.001""")
_sql("mined_action_equations", "ev", _WINDOWS.format(channel="action_id", order="id::VARCHAR", decay="1.0", only="AND t = slot") + """
SELECT back::INTEGER AS back, c::INTEGER AS source, c2::INTEGER AS target, round(v, 8) AS value FROM cov WHERE back < 4 AND back2 = 4""")
_sql("top_successors", "ev steps_next", """
, f AS (SELECT corpus_id, action_id AS action, next_action, count(*) AS n FROM nx WHERE next_action IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY corpus_id, action ORDER BY n DESC, next_action) AS INTEGER) AS rank FROM f)
SELECT a.corpus_id, a.action, r.next_action, r.n AS count, r.rank
FROM (SELECT DISTINCT corpus_id, action_id AS action FROM ev) a LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON r.corpus_id = a.corpus_id AND r.action = a.action""")
_sql("length_histogram", "ev", """
SELECT corpus_id, length::INTEGER AS length, count(*) AS n FROM (SELECT corpus_id, seq_id, 4 * count(*) AS length FROM ev GROUP BY 1, 2) GROUP BY 1, 2""")

# Comparison of corpora
_QUALITY = "ev steps_next dist shares trans prec quality"
_sql("device_kl", _QUALITY, "SELECT round(kl, 9) AS kl FROM kl")
_sql("transition_similarity", _QUALITY, "SELECT round(s, 9) AS similarity FROM sim_t")
_sql("precedence_similarity", _QUALITY, "SELECT round(s, 9) AS similarity FROM sim_p")
_SUMMARY = """
SELECT (SELECT count(*) FROM ev WHERE pos = 0 AND corpus_id = 'target') AS num_target_sequences,
  (SELECT count(*) FROM ev WHERE pos = 0 AND corpus_id = 'source') AS num_synthetic_sequences,
  (SELECT round(kl, 9) FROM kl) AS device_distribution_kl, (SELECT round(s, 9) FROM sim_t) AS transition_matrix_similarity,
  (SELECT round(s, 9) FROM sim_p) AS causal_graph_similarity"""
_sql("quality_summary", _QUALITY, _SUMMARY)
_sql("quality_by_variant", "ev attack all_quality", "SELECT * FROM compared")
_sql("case_study_matrices", "ev steps_next dist trans prec", """
, ch AS (SELECT DISTINCT 'd:' || device_id AS c FROM ev),
g AS (SELECT corpus_id, a.c AS source, b.c AS target FROM (SELECT unnest(['source', 'target']) AS corpus_id), ch a, ch b)
SELECT corpus_id, 'distribution' AS kind, device AS source, NULL AS target, round(p, 9) AS value FROM dist
UNION ALL SELECT g.corpus_id, 'transition', g.source, g.target, round(coalesce(tm.value, 0), 9) FROM g LEFT JOIN tm USING (corpus_id, source, target)
UNION ALL SELECT g.corpus_id, 'causal', g.source, g.target, round(coalesce(prec.value, 0), 9) FROM g LEFT JOIN prec USING (corpus_id, source, target)""")
_sql("tv_penalty", "ev dist shares tv", "SELECT corpus_id, seq_id, round(penalty, 9) AS distribution_penalty FROM tv")

# Edges
_sql("standardize_edges", "ev prec", """
SELECT source, target, CAST(source[3:] AS INTEGER) AS source_index, CAST(target[3:] AS INTEGER) AS target_index, round(weight, 9) AS weight, 4 AS lag FROM prior""")
_sql("named_edges", "ev prec", """
SELECT source, target, round(weight, 9) AS weight,
  coalesce(['click', 'error', 'purchase', 'signup'][CAST(source[3:] AS INTEGER) + 1], 'device_' || source[3:]) AS source_name,
  coalesce(['click', 'error', 'purchase', 'signup'][CAST(target[3:] AS INTEGER) + 1], 'device_' || target[3:]) AS target_name
FROM prior ORDER BY weight DESC, source, target LIMIT 12""")
_STATS = """
  count(*)::DOUBLE AS num_edges, count(l)::DOUBLE AS num_nonzero_edges, round(count(l)::DOUBLE / count(*), 9) AS nonzero_ratio,
  round(sum(l), 9) AS sum_strength, round(avg(l), 9) AS mean_strength, round(stddev_pop(l), 9) AS std_strength, round(min(l), 9) AS min_strength,
  round(quantile_cont(l, 0.5), 9) AS median_strength, round(quantile_cont(l, 0.9), 9) AS p90_strength, round(max(l), 9) AS max_strength"""
_sql("edge_statistics", "ev prec", "SELECT " + _STATS.replace("count(*)::DOUBLE AS", "count(*) AS").replace("count(l)::DOUBLE AS", "count(l) AS") + """,
  0.1::DOUBLE AS threshold FROM (SELECT CASE WHEN abs(weight) > 0.1 THEN weight END AS l FROM prior)""")
_sql("edge_statistics_delta", "ev dist shares prec", f"""
, w AS (SELECT 'before' AS side, weight AS l FROM prior
  UNION ALL SELECT 'after', weight * coalesce(a.p, 0) * coalesce(b.p, 0) FROM prior LEFT JOIN tgt a ON a.device = source LEFT JOIN tgt b ON b.device = target),
st AS (SELECT side, {_STATS}, 0.0::DOUBLE AS threshold FROM (SELECT side, CASE WHEN abs(l) > 0 THEN l END AS l FROM w) GROUP BY side)
SELECT * FROM st UNION ALL
SELECT 'delta', NULL, a.num_nonzero_edges - b.num_nonzero_edges, NULL, x.s, x.m, NULL, NULL, NULL, NULL, x.mx, NULL
FROM (SELECT * FROM st WHERE side = 'after') a, (SELECT * FROM st WHERE side = 'before') b,
  (SELECT round(sum(CASE side WHEN 'after' THEN s ELSE -s END), 9) AS s, round(sum(CASE side WHEN 'after' THEN m ELSE -m END), 9) AS m, round(sum(CASE side WHEN 'after' THEN mx ELSE -mx END), 9) AS mx
   FROM (SELECT side, sum(l) AS s, avg(l) AS m, max(l) AS mx FROM w WHERE l <> 0 GROUP BY side)) x""")
_sql("sparsify_prior", "ev prec", """
, d AS (SELECT a.source, a.target, a.weight - coalesce(b.weight, 0) AS w FROM prior a LEFT JOIN prior b ON b.source = a.target AND b.target = a.source),
n AS (SELECT source, target, w / (SELECT max(w) FROM d) AS w FROM d WHERE w > 0)
SELECT source, target, round(w, 9) AS weight FROM n WHERE w >= 0.05""")
_sql("top_edges", "ev prec", "SELECT source, target, round(weight, 9) AS weight FROM prior WHERE weight >= 0.01 ORDER BY prior.weight DESC, source, target LIMIT 7")
_sql("target_weighted_edges", "ev dist shares prec", """
SELECT source AS source_device_key, target AS target_device_key, round(weight, 9) AS raw_weight, round(a.p, 9) AS source_target_probability,
  round(b.p, 9) AS target_target_probability, round(a.p * b.p, 9) AS target_endpoint_weight, round(weight * a.p * b.p, 9) AS target_adapted_weight
FROM prior JOIN tgt a ON a.device = source JOIN tgt b ON b.device = target""")
_sql("target_weighted_matrix", "ev dist shares prec", """
SELECT source, target, round(weight * a.p * b.p, 9) AS weight FROM prior JOIN tgt a ON a.device = source JOIN tgt b ON b.device = target""")
_GUARD = "ev dist shares prec guard"
_GUARDED = """
SELECT source AS source_device_key, target AS target_device_key, round(weight, 9) AS raw_weight,
  round(CASE WHEN {hit} THEN weight * {left} ELSE weight END, 9) AS guarded_weight, CASE WHEN {hit} THEN '{mode}' ELSE 'keep' END AS guard_action,
  s_over AS source_overused, t_over AS target_overused, round(s_ratio, 9) AS source_overuse_ratio, round(t_ratio, 9) AS target_overuse_ratio"""
_sql("overuse_guard_suppress", _GUARD, _GUARDED.format(hit="t_over", left="0", mode="suppress") + """,
  CASE WHEN t_over THEN printf('%s overused: observed_freq=%.6f, target_freq=%.6f, ratio=%.3f', target, t_obs, t_tgt, t_ratio) ELSE '' END AS guard_reason
FROM guard""")
_sql("overuse_guard_downweight", _GUARD, _GUARDED.format(hit="(s_over OR t_over)", left="0.25", mode="downweight") + " FROM guard")
_sql("overused_devices", _GUARD, """
SELECT DISTINCT device, 'device_' || device[3:] AS device_name, round(o, 9) AS observed_freq, round(t, 9) AS target_freq, round(r, 9) AS ratio FROM (
  SELECT source AS device, s_obs AS o, s_tgt AS t, s_ratio AS r FROM guard WHERE s_over UNION ALL SELECT target, t_obs, t_tgt, t_ratio FROM guard WHERE t_over)""")
_sql("guard_counts", _GUARD, """
SELECT count(*) AS num_edges, count(CASE WHEN s_over AND t_over THEN 1 END) AS num_suppressed_edges, 0::BIGINT AS num_downweighted_edges FROM guard""")
_FUSE = "ev prec known fuse"
_FUSED = """
SELECT source AS source_device_key, target AS target_device_key, 'device_' || source[3:] AS source_name, 'device_' || target[3:] AS target_name,
  coalesce(n, 0) AS count, round(coalesce(score, 0), 9) AS transition_score, round(nt, 9) AS normalized_transition_score,
  round(coalesce(weight, 0), 9) AS raw_causal_strength, round(coalesce(weight, 0), 9) AS causal_strength, round(nc, 9) AS normalized_causal_strength,
  round({final}, 9) AS final_score, CASE WHEN score IS NULL THEN 'causal_relation_augmented' ELSE 'transition_existing' END AS edge_origin,
  CASE WHEN weight IS NOT NULL THEN 4 END AS lag
FROM fuse"""
_sql("fuse_multiplicative", _FUSE, _FUSED.format(final="CASE WHEN score IS NULL THEN 0.5 * nc ELSE nt * (1 + 0.5 * nc) END"))
_sql("fuse_unclean", _FUSE, _FUSED.format(final="CASE WHEN score IS NULL THEN 0.5 * nc ELSE nt * (1 + 0.5 * nc) END"))
_sql("fuse_additive", _FUSE, _FUSED.format(final="nt + 0.5 * nc") + " WHERE score IS NOT NULL ORDER BY nt + 0.5 * nc DESC, source, target LIMIT 10")
_sql("fuse_summary", _FUSE, """
SELECT (SELECT count(*) FROM kept_steps) AS input_transition_edges, (SELECT count(*) FROM prior) AS input_causal_edges, count(*) AS output_edges,
  count(CASE WHEN score IS NULL THEN 1 END) AS num_causal_relation_augmented_edges, round(avg(coalesce(weight, 0)), 9) AS avg_causal_strength
FROM fuse""")
_sql("hints_source_only", "ev steps_next trans prec", """
, st AS (SELECT 'd:' || s AS source, 'd:' || t AS target, n, n::DOUBLE / sum(n) OVER (PARTITION BY s) AS score FROM trans WHERE corpus_id = 'source'),
j AS (SELECT source, target, n, score, coalesce(weight, 0) AS w, score / (SELECT max(score) FROM st) AS nt, coalesce(weight, 0) / (SELECT max(weight) FROM prior) AS nc
  FROM st LEFT JOIN prior USING (source, target))
SELECT source AS source_device_key, target AS target_device_key, n AS count, round(score, 9) AS transition_score, round(nt, 9) AS normalized_transition_score,
  round(w, 9) AS raw_causal_strength, round(w, 9) AS causal_strength, round(nc, 9) AS normalized_causal_strength, round(nt * (1 + nc), 9) AS final_score
FROM j""")
_sql("hints_target_assisted", "ev steps_next dist shares trans prec", """
, a AS (SELECT source, target, weight * s.p * t.p AS w, os.p / s.p AS rs, ot.p / t.p AS rt
  FROM prior JOIN tgt s ON s.device = source JOIN tgt t ON t.device = target JOIN src os ON os.device = source JOIN src ot ON ot.device = target),
g AS (SELECT source, target, w AS raw, CASE WHEN rt > 1.0 THEN w * 0.25 ELSE w END AS w FROM a),
st AS (SELECT 'd:' || s AS source, 'd:' || t AS target, n, n::DOUBLE / sum(n) OVER (PARTITION BY s) AS score FROM trans WHERE corpus_id = 'source'),
j AS (SELECT source, target, n, score, coalesce(g.raw, 0) AS raw, coalesce(g.w, 0) AS w, score / (SELECT max(score) FROM st) AS nt, coalesce(g.w, 0) / (SELECT max(w) FROM g) AS nc
  FROM st LEFT JOIN g USING (source, target))
SELECT source AS source_device_key, target AS target_device_key, n AS count, round(score, 9) AS transition_score, round(nt, 9) AS normalized_transition_score,
  round(raw, 9) AS raw_causal_strength, round(w, 9) AS causal_strength, round(nc, 9) AS normalized_causal_strength, round(nt * (1 + nc), 9) AS final_score
FROM j""")

# Refinement
_sql("ordered_pairs", "ev prec cons", """
SELECT b.corpus_id, b.seq_id, b.pos AS target_index, a.device_id AS source, b.device_id AS target, count(*) AS n_pairs,
  round(coalesce(any_value(s.weight), 0), 9) AS causal_strength, round(coalesce(any_value(s.norm), 0), 9) AS normalized_causal_strength
FROM ev b JOIN ev a ON a.corpus_id = b.corpus_id AND a.seq_id = b.seq_id AND a.pos < b.pos
LEFT JOIN strength s ON s.source = 'd:' || a.device_id AND s.target = 'd:' || b.device_id
GROUP BY 1, 2, 3, 4, 5""")
_sql("causal_consistency", "ev prec cons", """
SELECT corpus_id, seq_id, pairs AS num_ordered_event_pairs, supported AS num_causally_supported_pairs, round(score, 9) AS causal_consistency_score FROM cons""")
_BLOCKS["left_over"] = "left_over AS (SELECT source, target, weight FROM guard WHERE NOT t_over)"
_BLOCKS["guarded_cons"] = _BLOCKS["cons"].replace("prior", "left_over")
_sql("guarded_scoring", _GUARD + " left_over guarded_cons", """
SELECT corpus_id, seq_id, pairs AS num_ordered_event_pairs, supported AS num_causally_supported_pairs, round(score, 9) AS causal_consistency_score FROM cons""")
_sql("consistency_summary", "ev prec cons", """
SELECT count(*) AS num_sequences, round(avg(score), 9) AS mean_causal_consistency_score, round(min(score), 9) AS min_causal_consistency_score,
  round(max(score), 9) AS max_causal_consistency_score FROM cons""")
_SCORES = "ev dist shares prec cons tv scores"
_sql("causal_tof_scores", _SCORES, """
SELECT corpus_id, seq_id, pairs AS num_ordered_event_pairs, supported AS num_causally_supported_pairs, round(score, 9) AS causal_consistency_score, round(1 - score, 9) AS causal_inconsistency,
  round(penalty, 9) AS distribution_penalty, round(loss, 9) AS reconstruction_loss, round(greatest(loss, 0), 9) AS reconstruction_term, round(final, 9) AS final_score, round(exp(final / 2), 9) AS sample_weight
FROM scores""")
_sql("causal_tof_filter", _SCORES, """
SELECT corpus_id, seq_id, round(exp(final / 2), 9) AS sample_weight, CASE WHEN exp(final / 2) >= 0.5 THEN 'keep' ELSE 'delete' END AS decision FROM scores""")
_sql("causal_tof_rank", _SCORES, """
SELECT corpus_id, seq_id, round(final, 9) AS final_score, row_number() OVER (ORDER BY round(final, 9) DESC, corpus_id, seq_id) AS rank, 'rank' AS decision FROM scores""")
_CLOCKS = """
, wait AS (
  SELECT corpus_id, seq_id, c, -ln((CAST('0x' || substr(md5('{seed}:' || corpus_id || ':' || seq_id || ':' || c), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight} AS e
  FROM {table}, unnest(range(1, {cap} + 1)) AS u(c)),
clock AS (SELECT corpus_id, seq_id, c, sum(e) OVER (PARTITION BY corpus_id, seq_id ORDER BY c) AS arrival FROM wait),
drawn AS (SELECT * FROM clock ORDER BY arrival LIMIT (SELECT count(*) FROM {table})),
copies AS (SELECT corpus_id, seq_id, count(*) AS copies FROM drawn GROUP BY 1, 2)"""
_sql("weighted_resample", _SCORES, _CLOCKS.format(seed=7, weight="exp(final / 2)", table="scores", cap=2) + " SELECT * FROM copies")
_sql("resample_report", _SCORES, _CLOCKS.format(seed=7, weight="exp(final / 2)", table="scores", cap=3) + """
SELECT 7 AS seed, 3 AS max_copies, sum(copies)::BIGINT AS resampled_size, count(CASE WHEN copies > 1 THEN 1 END) AS num_duplicated_sources,
  (SELECT count(*) FROM scores) - count(*) AS num_unused_sources FROM copies""")
_sql("corpus_lock", "ev prec cons", _CLOCKS.format(seed=2024, weight="exp(score - 1)", table="cons", cap=3) + f"""
SELECT corpus_id, seq_id || '#' || i AS seq_id, flat
FROM (SELECT corpus_id, seq_id, {_FLAT} AS flat FROM ev GROUP BY 1, 2) JOIN copies USING (corpus_id, seq_id), unnest(range(1, copies + 1)) AS u(i)""")
_sql("train_validation_split", "ev split", "SELECT corpus_id, seq_id, part FROM split")

# Detection
for _name, _env in (("action", "spring"), ("slot", "night"), ("device", "multiple")):
    _sql(f"markov_loss_{_name}", "ev tok loss", f"SELECT env, corpus_id, seq_id, n_tokens, round(loss, 9) AS loss FROM loss WHERE env = '{_env}'")
_sql("loss_summary", "ev tok loss", """
SELECT env, corpus_id, round(avg(loss), 9) AS loss_avg, round(min(loss), 9) AS loss_min, round(max(loss), 9) AS loss_max, count(*) AS n
FROM loss WHERE env = 'spring' GROUP BY 1, 2""")
_sql("iqr_outliers", "ev tok loss", """
, q AS (SELECT quantile_cont(loss, 0.75) + 1.5 * (quantile_cont(loss, 0.75) - quantile_cont(loss, 0.25)) AS fence FROM loss WHERE env = 'multiple')
SELECT env, corpus_id, seq_id, round(loss, 9) AS loss, round(fence, 9) AS upper_fence, loss > fence AS is_outlier FROM loss, q WHERE env = 'multiple'""")
_sql("utility_readmission", "ev tok filt", "SELECT corpus_id, seq_id, is_outlier, readmit, kept, round(change, 9) AS loss_change FROM filt")
_sql("loss_threshold", "ev tok loss", """
SELECT env, round(CASE WHEN env = 'multiple' THEN quantile_cont(loss, 0.99) ELSE quantile_cont(loss, 0.95) END, 9) AS threshold FROM loss GROUP BY env""")
_DETECT = "ev tok attack detect"
_sql("labelled_rows", "ev attack", f"""
SELECT way, env || '/' || seq_id AS seq_id, {_FLAT} AS flat, label FROM att, (SELECT unnest(['stored', 'tables']) AS way) GROUP BY way, env, att.seq_id, label""")
_sql("flat_detector_tokens", "ev", """
, q AS (SELECT corpus_id, seq_id, CAST(4 * pos + i AS INTEGER) AS pos, [day, hour_slot, device_id, action_id][i + 1] AS token FROM ev, range(4) r(i))
SELECT 'filter' AS env, corpus_id, seq_id, pos, coalesce(lag(token) OVER (PARTITION BY corpus_id, seq_id ORDER BY pos), CAST(-2147483648 AS INTEGER)) AS prev, token
FROM q QUALIFY pos < 40""")
_sql("anomaly_eval", _DETECT, "SELECT * FROM eval")
_sql("wide_percentiles", "", """
SELECT priority, round(quantile_cont(value, 0.05), 3) AS p05, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.955), 3) AS p955, round(max(value), 3) AS most
FROM (SELECT o_orderpriority AS priority,
  o_totalprice * ([1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2, 1e3, 1e4, 1e5]::DOUBLE[])[CAST(o_orderkey % 12 + 1 AS INTEGER)] * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END::DOUBLE AS value
  FROM orders) GROUP BY 1""")
_sql("sparse_vocabulary", "ev", """
SELECT corpus_id, seq_id, coalesce(string_agg('illegal_action_id@event_' || pos || ':' || CASE WHEN action_id % 2 = 1 THEN action_id + 2000000000 ELSE action_id END, ',' ORDER BY pos)
  FILTER (action_id >= 16), '') AS reasons FROM ev GROUP BY 1, 2""")
_sql("train_validation_split_cells", "ev cells", "SELECT * FROM cparts")
_sql("anomaly_eval_cells", "ev attack cells cell_detect", """
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall,
  round((tp + tn)::DOUBLE / test_size, 9) AS accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 9) AS f1,
  round(fp::DOUBLE / nullif(fp + tn, 0), 9) AS fpr, round(fn::DOUBLE / nullif(fn + tp, 0), 9) AS fnr
FROM cconf""")
_sql("cell_parameters", "met", """
SELECT dataset, env, n, field, percentile, filter_tag FROM (
  SELECT dataset, CASE scenario WHEN 'st' THEN 'spring' WHEN 'tt' THEN 'night' ELSE 'multiple' END AS env, count(*) AS n FROM met GROUP BY 1, 2)
JOIN (VALUES ('fr', 'spring', 'action_id', 95.5::DOUBLE, '0.918'), ('fr', 'night', 'hour_slot', 95.0, '0.92'), ('fr', 'multiple', 'device_id', 99.0, '0.915'),
  ('sp', 'spring', 'action_id', 95.0, '0.915'), ('sp', 'night', 'hour_slot', 95.0, '0.917'), ('sp', 'multiple', 'device_id', 99.0, '0.915'),
  ('us', 'spring', 'action_id', 95.0, '0.905'), ('us', 'night', 'hour_slot', 93.0, '0.919'), ('us', 'multiple', 'device_id', 99.0, '0.913'))
  AS p(dataset, env, field, percentile, filter_tag) USING (dataset, env)""")

# Validation
_sql("lenient_filter", "ev faulty", """
SELECT corpus_id, seq_id, array_to_string(flat, ',') AS flat FROM faulty WHERE len(flat) > 0 AND len(flat) % 4 = 0""")
_sql("validate_sequences", "ev faulty checked", """
SELECT f.corpus_id, f.seq_id, CASE WHEN flat IS NULL THEN 'missing_sequence' WHEN len(flat) = 0 THEN 'empty_sequence'
  ELSE concat_ws(';', CASE WHEN len(flat) % 4 <> 0 THEN 'length_not_multiple_of_4' END,
    CASE WHEN len(flat) <> 12 THEN 'length_mismatch:' || len(flat) || '!=expected_12' END, w.reasons) END AS reasons
FROM faulty f LEFT JOIN why w ON w.corpus_id = f.corpus_id AND w.seq_id = f.seq_id""")
_sql("validation_report", "ev faulty checked", """
, v AS (SELECT f.corpus_id, f.flat, flat IS NOT NULL AND len(flat) > 0 AND len(flat) % 4 = 0 AND w.reasons IS NULL AS ok
  FROM faulty f LEFT JOIN why w ON w.corpus_id = f.corpus_id AND w.seq_id = f.seq_id)
SELECT corpus_id, count(*) AS num_rows, count(CASE WHEN ok THEN 1 END) AS num_valid, count(CASE WHEN NOT ok THEN 1 END) AS num_invalid,
  count(DISTINCT CASE WHEN ok THEN flat END) AS unique_sequence_count,
  count(CASE WHEN ok THEN 1 END) - count(DISTINCT CASE WHEN ok THEN flat END) AS duplicate_sequence_count,
  round((count(CASE WHEN ok THEN 1 END) - count(DISTINCT CASE WHEN ok THEN flat END))::DOUBLE / count(CASE WHEN ok THEN 1 END), 9) AS duplicate_rate,
  CASE WHEN count(CASE WHEN NOT ok THEN 1 END) = 0 AND count(CASE WHEN ok THEN 1 END) = 1000 THEN 'valid' ELSE 'invalid' END AS status
FROM v GROUP BY 1""")

# Reporting
_sql("variant_dimension", "met", """
SELECT k || '.json' AS run, m.variant, dataset || '_' || scenario AS cell, canonical, TRUE AS used_filter, gss AS used_causal_gss, tof AS used_causal_tof, stage AS input_stage
FROM met m JOIN (VALUES
  ('baseline_gen', 'baseline_gen', FALSE, FALSE, 'published_gen_original_tof'),
  ('causal_gss_only', 'causal_gss_only', TRUE, FALSE, 'causal_gss_plus_gen_original_tof'),
  ('causal_tof_only', 'causal_tof_only', FALSE, TRUE, 'published_gen_original_tof_plus_causal_tof'),
  ('full_causal', 'target_assisted_full', TRUE, TRUE, 'target_assisted_causal_gss_plus_gen_original_tof_plus_target_assisted_causal_tof'),
  ('zero_target_baseline', 'zero_target_baseline', FALSE, FALSE, 'source_only_generation_plus_gen_original_tof'),
  ('zero_target_causal_gss', 'zero_target_causal_gss', TRUE, FALSE, 'source_only_causal_gss_plus_gen_original_tof'),
  ('zero_target_causal_tof', 'zero_target_causal_tof', FALSE, TRUE, 'source_only_generation_plus_gen_original_tof_plus_source_causal_tof'),
  ('zero_target_full', 'zero_target_full', TRUE, TRUE, 'source_only_causal_gss_plus_gen_original_tof_plus_source_causal_tof'),
  ('target_assisted_full', 'target_assisted_full', TRUE, TRUE, 'target_assisted_causal_gss_plus_gen_original_tof_plus_target_assisted_causal_tof'))
  AS d(variant, canonical, gss, tof, stage) ON d.variant = m.variant""")
_sql("typed_metrics", "met", """
SELECT dataset, scenario, seed, variant, 'syn_' || k AS input_pkl, used_causal_gss, train_size, precision, recall, f1, NULL::DOUBLE AS threshold,
  run_dir, run_dir || '/' || k || '.json' AS metrics_path FROM met""")
_sql("per_seed_results", "met", "SELECT dataset, scenario, seed, variant, f1, metrics_path FROM kept")
_KEPT_NAMES = ("baseline_gen", "causal_gss_only", "causal_tof_only", "full_causal", "zero_target_baseline", "zero_target_causal_gss",
               "zero_target_causal_tof", "zero_target_full", "target_assisted_full")
_sql("ablation_pivot", "met", "SELECT dataset, scenario, seed, " + ", ".join(
    f"max(CASE WHEN variant = '{v}' THEN f1 END) AS {v}_f1" for v in _KEPT_NAMES
) + """ FROM (SELECT *, row_number() OVER (PARTITION BY dataset, scenario, seed, variant ORDER BY metrics_path DESC) AS place FROM kept)
WHERE place = 1 GROUP BY 1, 2, 3""")
_sql("normalized_metrics", "", """
SELECT CASE WHEN k % 10 = 0 THEN 'dry_run' ELSE 'success' END AS status, dataset, scenario, k AS seed,
  CASE WHEN k % 2 = 0 THEN 'causal_gss_only' ELSE 'zero_target_full' END AS variant, env,
  round((k % 3)::DOUBLE / nullif(k % 3 + k % 5, 0), 9) AS fpr, round((k % 4)::DOUBLE / nullif(k % 4 + k % 7, 0), 9) AS fnr, o_totalprice AS threshold,
  'validation_percentile_' || CASE WHEN env = 'multiple' THEN '99.0' WHEN dataset = 'fr' AND env = 'spring' THEN '95.5' WHEN dataset = 'us' AND env = 'night' THEN '93.0' ELSE '95.0' END AS threshold_source,
  k % 100 AS train_size, k % 50 AS validation_size, k % 25 AS test_size, k % 1000 AS generated_size, 'cpu' AS device, CAST(NULL AS VARCHAR) AS requested_device,
  'runs/' || k || '/downstream_ad_metrics.json' AS metrics_path, CASE WHEN k % 3 = 0 THEN 'own' ELSE 'source_distribution_driven' END AS generator,
  'unknown' AS generation_model, TRUE AS manual_generation,
  CASE WHEN k % 2 = 0 THEN 'causal_gss_plus_gen_original_tof' ELSE 'source_only_causal_gss_plus_gen_original_tof_plus_source_causal_tof' END AS input_stage,
  TRUE AS used_causal_gss, k % 2 = 1 AS used_causal_tof, k % 200 AS num_generated_before_tof,
  CASE WHEN k % 2 = 0 THEN k % 90 ELSE k % 150 END AS num_generated_after_gen_tof, CASE WHEN k % 2 = 1 THEN k % 90 END AS num_generated_after_causal_tof
FROM (SELECT o_orderkey AS k, o_totalprice, ['fr', 'sp', 'us'][o_orderkey % 3 + 1] AS dataset, ['st', 'night', 'multiple'][o_custkey % 3 + 1] AS scenario,
  ['spring', 'night', 'multiple'][o_custkey % 3 + 1] AS env FROM orders)""")
_sql("provenance", "met", """
SELECT dataset, run_dir || '/' || k AS run_dir, CASE WHEN k % 3 = 0 THEN 'replay' ELSE 'source_distribution_driven' END AS generator,
  CASE WHEN k % 6 = 0 THEN 'm1' ELSE 'unknown' END AS generation_model, k % 3 <> 0 AS manual_generation FROM met""")
_sql("result_integrity", "", """
WITH p AS (
  SELECT o_orderkey AS k, ['fr', 'sp', 'us'][o_custkey % 3 + 1] || '_st/seed' || (o_custkey % 500) || '/downstream_ad/' AS folder, o_orderkey % 3 = 0 AS proposed,
    folder || CASE WHEN o_orderkey % 3 = 0 THEN 'zero_target_full/' ELSE 'zero_target_baseline/' END || o_orderkey || '.json' AS path FROM orders),
whole AS (SELECT * FROM p WHERE proposed AND k % 21 <> 0),
folders AS (
  SELECT folder, proposed FROM p
  UNION ALL SELECT ['fr', 'sp', 'us'][c_custkey % 3 + 1] || '_st/seed' || (c_custkey % 700) || '/downstream_ad/', FALSE FROM customer)
SELECT 'missing_metric_fields' AS kind, path,
  concat_ws(', ', CASE WHEN k % 11 = 0 THEN 'status' END, CASE WHEN k % 9 = 0 THEN 'f1' END) AS detail FROM whole WHERE k % 11 = 0 OR k % 9 = 0
UNION ALL SELECT 'variant_mismatch', path, 'wrong' FROM whole WHERE k % 15 = 0
UNION ALL SELECT 'experiment_coordinate_mismatch', path, 'path and payload disagree' FROM whole WHERE k % 10 = 0 OR k % 14 = 0
UNION ALL SELECT 'invalid_json', path, 'not a JSON object' FROM p WHERE k % 21 = 0
UNION ALL SELECT 'missing_proposed_metrics', folder || 'zero_target_full/', 'seed has no normalized proposed result' FROM folders GROUP BY folder HAVING NOT bool_or(proposed)""")
_sql("asset_grid", "", """
WITH cells AS (SELECT * FROM (SELECT unnest(['fr', 'sp', 'us']) AS ds), (VALUES ('st', 'spring'), ('tt', 'night'), ('nt', 'multiple')) v(sc, env)),
expected AS (
  SELECT ds || '_' || env AS cell, 'train' AS name, ds || '/' || env || '/trn' AS path, TRUE AS required FROM cells
  UNION ALL SELECT ds || '_' || env, 'test', ds || '/' || env || '/test', TRUE FROM cells
  UNION ALL SELECT ds || '_' || env, 'spare', ds || '/' || env || '/spare', FALSE FROM cells
  UNION ALL SELECT ds || '_' || env, 'other', ds || '_' || sc || '/other', TRUE FROM cells),
files AS (
  SELECT ['fr', 'us'][o_orderkey // 4 % 2 + 1] || '/' || ['spring', 'night'][o_custkey % 2 + 1] || '/' || ['trn', 'test', 'spare'][o_orderkey % 3 + 1] AS path, count(*) AS num_rows
  FROM orders GROUP BY 1)
SELECT e.cell, e.name, e.path, CASE WHEN f.path IS NOT NULL THEN 'ok' WHEN required THEN 'missing' ELSE 'optional_missing' END AS status, num_rows,
  f.path IS NULL AND required AS reported_missing
FROM expected e LEFT JOIN files f ON f.path = e.path""")
_sql("stage_funnel", "ev tok filt prec cons", """
SELECT 'zero_target_full' AS variant, count(*) AS before_filter, count(CASE WHEN kept THEN 1 END) AS after_filter,
  count(CASE WHEN kept AND exp((score - 1) / 2) >= 0.62 THEN 1 END) AS after_consistency
FROM filt JOIN cons USING (corpus_id, seq_id)""")
_sql("variant_comparison", "ev tok attack detect all_quality", """
SELECT split_part(variant, ':', 2) AS variant, f1, fpr, device_distribution_kl, transition_matrix_similarity, causal_graph_similarity
FROM compared JOIN eval ON variant = 'attack:' || env""")

# Lineage
_sql("stage_lineage", "ev lin", "SELECT * FROM stages")
_sql("stage_files", "ev lin", """
SELECT variant, stage, role, path, min(event_index) AS first_index FROM (
  SELECT variant, stage, path, event_index, CASE WHEN operation = 'read' THEN 'consumed' ELSE 'produced' END AS role FROM lin
  UNION ALL SELECT variant, stage, path, event_index, 'target_normal' FROM lin WHERE operation = 'read' AND target_normal
  UNION ALL SELECT variant, stage, path, event_index, 'target_attack' FROM lin WHERE operation = 'read' AND target_attack) GROUP BY 1, 2, 3, 4""")
_sql("boundary_violations", "ev lin", """
SELECT variant, stage, stage_order, purpose, event_index, operation, path, target_normal, target_attack, status FROM lin
WHERE operation = 'read' AND (target_normal OR target_attack) AND purpose = 'filtering'""")
_sql("merged_lineage", "ev lin", "SELECT variant, stage, event_index, pos::BIGINT AS merged_index, path FROM lin")
_sql("variant_lineage", "ev lin", """
SELECT variant, count(*) AS num_stages, sum(num_events)::BIGINT AS num_events, bool_or(target_normal_consumed) AS target_normal_consumed,
  bool_or(target_attack_consumed) AS target_attack_consumed,
  bool_or(purpose = 'filtering' AND target_normal_consumed) AS pre_evaluation_target_normal_consumed,
  bool_or(purpose = 'filtering' AND target_attack_consumed) AS pre_evaluation_target_attack_consumed,
  CASE WHEN bool_and(status = 'success') THEN 'success' ELSE 'mixed_or_blocked' END AS status
FROM stages GROUP BY 1""")
_sql("feedback_check", "ev lin", """
SELECT path FROM lin WHERE purpose = 'offline_generation_quality_evaluation' AND operation = 'write'
INTERSECT SELECT path FROM lin WHERE purpose = 'filtering' AND operation = 'read'""")

# Files written from the tables and read back
_sql("jsonl_scan", "ev", f"SELECT seq_id AS sequence_id, 0::INTEGER AS start, {_FLAT} AS sequence, CAST(NULL AS VARCHAR) AS problem FROM ev GROUP BY corpus_id, seq_id")
_sql("jsonl_faults", "ev", """
, written AS (
  SELECT corpus_id AS file, seq_id, count(*) AS events, CAST('0x' || substr(md5(seq_id), 1, 2) AS INTEGER) % 9 AS kind,
    row_number() OVER (PARTITION BY corpus_id ORDER BY seq_id) AS line_number
  FROM ev GROUP BY 1, 2),
judged AS (
  SELECT *, CASE kind WHEN 1 THEN 'sequence_not_list:int' WHEN 2 THEN 'sequence_not_list:str' WHEN 3 THEN 'sequence_not_list:dict'
    WHEN 4 THEN 'sequence_not_list:bool' WHEN 5 THEN 'sequence_not_list:float' WHEN 6 THEN 'non_integer_value:x' WHEN 7 THEN 'invalid_json'
    WHEN 8 THEN CASE WHEN events = 1 THEN 'missing_sequence' END END AS problem
  FROM written)
SELECT file, line_number, problem, CASE WHEN kind <> 7 THEN seq_id END AS sequence_id, CASE WHEN kind = 7 THEN 'broken ' || seq_id END AS line
FROM judged WHERE problem IS NOT NULL""")
_sql("vocabulary_scan", "ev", """
SELECT DISTINCT device_id AS id, ['click', 'error', 'purchase', 'signup', 'view'][device_id + 1] AS name FROM ev""")
_sql("action_vocabulary", "ev", """
SELECT DISTINCT action_id, device_name || ':' || action_id % 4 AS name, device_name, CASE WHEN device_id < 4 THEN device_id END AS device_id, action_id % 4 = 3 AS is_off
FROM (SELECT action_id, device_id, coalesce(['click', 'error', 'purchase', 'signup'][device_id + 1], 'Nothing') AS device_name FROM ev)""")
_sql("corpus_scan", "ev", f"SELECT corpus_id, seq_id, 0::INTEGER AS start, {_FLAT} AS flat FROM ev GROUP BY 1, 2")
_DENSE = """
, ch AS (SELECT DISTINCT corpus_id, 'd:' || device_id AS c FROM ev),
cells AS (
  SELECT a.corpus_id, a.c AS source, b.c AS target, coalesce(p.value, 0) AS weight FROM ch a JOIN ch b USING (corpus_id)
  LEFT JOIN prec p ON p.corpus_id = a.corpus_id AND p.source = a.c AND p.target = b.c)
SELECT corpus_id, 'cells' AS kind, source, target, round(weight, 9) AS weight, {lag} AS lag, '{name}' AS provenance FROM cells
UNION ALL SELECT corpus_id, 'edges', source, target, round(weight, 9), {lag}, '{name}' FROM cells WHERE weight > 0 AND source <> target"""
_sql("prior_scan", "ev prec", _DENSE.format(lag=3, name="existing_prior_json") + """ AND corpus_id = 'source'
UNION ALL VALUES ('target', 'edges', 'd:1', 'd:4', 0.75, 3, 'existing_prior_json'), ('target', 'edges', 'd:2', 'd:4', 0.5, 3, 'existing_prior_json')""")
_sql("matrix_scan", "ev prec", _DENSE.format(lag=4, name="prior_matrix_path"))
_sql("mined_route", "ev prec", """
, d AS (SELECT a.source, a.target, a.weight - coalesce(b.weight, 0) AS w FROM prior a LEFT JOIN prior b ON b.source = a.target AND b.target = a.source),
n AS (SELECT source, target, w / (SELECT max(w) FROM d) AS w FROM d WHERE w > 0),
cells AS (SELECT source, target, w FROM n WHERE w >= 0.001),
best AS (SELECT * FROM cells ORDER BY w DESC, source, target LIMIT 5)
SELECT 'cells' AS kind, source, target, round(w, 9) AS weight, 4 AS lag, 'mined_from_source' AS provenance FROM cells
UNION ALL SELECT 'edges', source, target, round(w, 9), 4, 'mined_from_source' FROM best""")
_sql("successor_scan", "ev steps_next", """
, f AS (SELECT corpus_id, action_id AS action, next_action, count(*) AS n FROM nx WHERE next_action IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, action ORDER BY n DESC, next_action) AS rank FROM f)
SELECT a.corpus_id AS context, a.action::VARCHAR AS action, r.next_action::VARCHAR AS next_action, r.n AS count, r.rank
FROM (SELECT DISTINCT corpus_id, action_id AS action FROM ev) a LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON r.corpus_id = a.corpus_id AND r.action = a.action""")
_sql("metrics_scan", "met", "SELECT dataset, scenario, seed, variant, f1, train_size, run_dir || '/' || k || '.json' AS metrics_path FROM met")
_sql("quality_scan", _QUALITY, f"SELECT 'baseline' AS variant, num_target_sequences, device_distribution_kl, causal_graph_similarity FROM ({_SUMMARY})")
_sql("lineage_scan", "ev lin", "SELECT variant, stage, stage_order, purpose, event_index::BIGINT AS event_index, operation, path, target_normal, target_attack, status FROM lin")
_sql("loss_scan", "ev tok", """
SELECT CAST(row_number() OVER (ORDER BY env, token, prev) - 1 AS INTEGER) AS row_index, count(*)::DOUBLE AS loss FROM tok GROUP BY env, token, prev""")
_sql("csv_sink", "met", "SELECT dataset, scenario, seed, variant, train_size, NULL::VARCHAR AS not_there FROM kept")
_sql("json_sink", "", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events")
def _files(name, rows, device, action):
    """Inventory of one text file per device: its actions with their counts."""
    return f"""{name} AS (
  SELECT 'device_id=' || d AS path, strlen(t) AS size, sha256(t) AS sha256
  FROM (SELECT d, string_agg(a || ':' || n, ' ' ORDER BY a) || chr(10) AS t FROM (SELECT {device} AS d, {action} AS a, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY d))"""


_MANIFEST = ", " + _files("files", "ev", "device_id", "action_id")
_sql("file_manifest", "ev", _MANIFEST + " SELECT * FROM files")
_sql("manifest_digest", "ev", _MANIFEST + """,
grouped AS (
  SELECT substr(md5(path), 1, 3) AS g, count(*) AS n, sha256(string_agg(path || '|' || size || '|' || sha256, chr(10) ORDER BY path || '|' || size || '|' || sha256)) AS digest
  FROM files GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS file_count, sha256(string_agg(digest, chr(10) ORDER BY g)) AS manifest_sha256 FROM grouped""")
_sql("snapshot_difference", "ev known", ", " + _files("before", "known", "k", "4 * k + verb") + ",\n"
     + _files("after", "(SELECT * FROM ev WHERE device_id <> 1 OR corpus_id = 'source')", "device_id", "action_id") + """
SELECT *, 'before' AS side FROM (SELECT * FROM before EXCEPT SELECT * FROM after)
UNION ALL SELECT *, 'after' FROM (SELECT * FROM after EXCEPT SELECT * FROM before)""")